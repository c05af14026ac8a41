"""Language-model scores of whole texts, and a word-count baseline.

Counts of all training words are taken over the whole corpus. A causal self-attention model over
subword ids is trained on every window of every training document, spread over the executors: each
round, copies are trained on slices of its windows and averaged. The slices follow from a hash, so
the model doesn't depend on the cluster's layout. A word's probability is a
mixture of what the attention model gives its subwords, its share of the training words, and its
share of the text's words before it; so frequent words are remembered whole and unknown ones are
spelled, once at full cost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention as net
from .common import id_crc, stored
from .subwords import runs, with_ends, word_bpe, word_ids, word_pieces

END = 49407
#: Frequent words that every worker holds with their ids and counts, at most; longer words than this many bytes are held by their SHA-256.
FREQUENT, LONGEST = 300_000, 64
#: Weights of a word's share of the training words and of the text so far (in which PRIOR more
#: words are held unseen); the spelling has the rest.
OWN_SHARE, SO_FAR, PRIOR = 0.4, 0.15, 5.0
#: Rounds of training, windows that a slice has about, windows that go as one row at most, and the steps of a slice at least.
ROUNDS, SLICE, TOGETHER, STEPS = 4, 8_192, 256, 128
#: Bytes of windows that a task holds at once, about, while it cuts or counts them.
AT_ONCE = 2_000_000
#: Words, about, of texts whose windows are cut, or go through the model, together.
WORDS = 20_000


def held_out(id_col: str) -> Column:
    return F.pmod(id_crc(id_col), F.lit(7)) == 2


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) over the column ``text``; each task adds up its own words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[bytes, int] = {}

        def out():
            return pa.record_batch({"word": pa.array(count.keys(), pa.binary()), "c": pa.array(count.values(), pa.int64())})

        for batch in batches:
            for _, names, which, _ in word_pieces(batch.column(0)):
                for word, n in zip(names, np.bincount(which, minlength=len(names)).tolist(), strict=True):
                    count[word] = count.get(word, 0) + n
                if len(count) > 400_000:
                    yield out()
                    count.clear()
        yield out()

    return rows.select("text").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def subword_counts(counts: DataFrame, path: str, size: int) -> np.ndarray:
    """How often each id occurs in the training words, from the table of distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, total = word_bpe(path), np.zeros(size)
        for batch in batches:
            ranks = [bpe.ranks(w) for w in batch.column(0).to_pylist()]
            n = np.repeat(batch.column(1).to_numpy().astype(float), [len(r) for r in ranks])
            total += np.bincount(bpe.ids[np.fromiter(chain.from_iterable(ranks), np.int64, len(n))], n, size)
        seen = np.nonzero(total)[0]
        yield pa.record_batch({"id": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.float64())})

    out = np.zeros(size)
    for r in counts.select("word", "c").mapInArrow(run, "id bigint, n double").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row an id at most
        out[r.id] = r.n
    return out


_WINDOWS = pa.schema([("part", pa.int32()), ("h", pa.int64()), ("n", pa.int64()), ("windows", pa.binary())])


def cut_windows(batches: Iterator[pa.RecordBatch], path: str, classes: np.ndarray, first: bytes = b"") -> Iterator[pa.RecordBatch]:
    """A task's part of ``training_windows``, in batches of about AT_ONCE bytes."""
    import xxhash

    table = word_ids(path, END, first)
    out: dict[str, list] = {k: [] for k in _WINDOWS.names}
    size = 0
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for first, names, which, lengths in word_pieces(batch.column(1)):
            number = with_ends(table.of(names).take(which), lengths)
            for texts, places in runs(lengths + 1, WORDS):
                own, n = table.ids(number[places])
                sizes = np.add.reduceat(n, np.cumsum(lengths[texts] + 1) - (lengths[texts] + 1))
                full, end = net.whole_windows(classes.take(own), sizes), 0
                for name, many in zip(ids[first + texts.start : first + texts.stop], (-(-sizes // net.SCORED)).tolist(), strict=True):
                    begin, end = end, end + many
                    for at in range(0, many, TOGETHER):
                        some = full[begin + at : min(begin + at + TOGETHER, end)]
                        raw = some.tobytes()
                        h = xxhash.xxh64_intdigest(raw, (name or 0) % 2**63 + at) >> 1
                        for k, v in zip(out, (h % ROUNDS, h // ROUNDS, len(some), raw), strict=True):
                            out[k].append(v)
                        size += len(raw)
                        if size >= AT_ONCE:
                            yield pa.record_batch(out, schema=_WINDOWS)
                            out, size = {k: [] for k in _WINDOWS.names}, 0
            table.trim()
    yield pa.record_batch(out, schema=_WINDOWS)


def training_windows(rows: DataFrame, path: str, classes: np.ndarray, sent: Broadcast | None = None) -> DataFrame:
    """(part, h, n, windows): every document cut into consecutive windows of class sequences, so each id is a target once.

    A row has up to TOGETHER windows of one document. Its round ``part`` and its hash ``h``, from which its slice
    follows, depend on the document and the place alone; so a task that runs again gives the same, and
    a long text is spread over rounds and slices. ``sent``: the frequent words, which workers hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from cut_windows(batches, path, classes, sent.value.words if sent else b"")

    return rows.select("doc_id", "text").mapInArrow(run, "part int, h bigint, n bigint, windows binary")


def _arrays(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return net.parts(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, net.CONTEXT + 1 + net.SCORED))


def _gathered(df: DataFrame, how: Column) -> np.ndarray:
    rows = df.groupBy("i").agg(how.alias("x")).toPandas().sort_values("i")  # one row a parameter
    return rows.x.to_numpy()


def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's part of ``bigram_counts``; about AT_ONCE bytes of windows at a time, as their pairs take several times that."""
    total = np.zeros((net.CLASSES + 1, net.CLASSES))
    most = max(1, AT_ONCE // (TOGETHER * (net.CONTEXT + 1 + net.SCORED)))
    for b in batches:
        for at in range(0, b.num_rows, most):
            inputs, targets, real = _arrays(b.column(0).slice(at, most).to_pylist())
            pairs = inputs[:, net.CONTEXT :][real].astype(np.int64) * net.CLASSES + targets[real]
            total += np.bincount(pairs, minlength=total.size).reshape(total.shape)
    yield pa.record_batch({"i": pa.array(np.arange(total.size), pa.int64()), "x": pa.array(total.ravel(), pa.float64())})


def bigram_counts(windows: DataFrame) -> np.ndarray:
    """How often each class follows each class, over all windows."""
    flat = _gathered(windows.select("windows").mapInArrow(count_pairs, "i bigint, x double"), F.sum("x"))
    return flat.reshape(net.CLASSES + 1, net.CLASSES) if len(flat) else np.zeros((net.CLASSES + 1, net.CLASSES))


def batches_of(n: int, size: int, steps: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """All of ``n`` places in an order by chance, ``size`` at a time, and all of them again until there are ``steps`` batches."""
    done = 0
    while done < steps:
        order = rng.permutation(n)
        for at in range(0, n, size):
            yield order[at : at + size]
            done += 1


def train(windows: DataFrame, rate: float = 0.01, batch: int = 64, steps: int = STEPS) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Averaged parameters after ROUNDS rounds, and the tables of counts.

    Every window is used in one round, in one slice; a slice of fewer than ``steps`` batches goes through all of them again.
    """
    sc = windows.sparkSession.sparkContext
    params, grams = net.fresh(), net.bigrams(bigram_counts(windows))
    total = windows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    slices = max(1, round(total / ROUNDS / SLICE))

    def slice_trainer(r: int, sent):
        def run(table: pa.Table) -> pa.Table:
            flat, grams = sent.value
            trainer = net.Trainer(net.unpacked(flat), grams, rate / (r + 1))
            table = table.sort_by([("h", "ascending"), ("windows", "ascending")])
            inputs, targets, real = _arrays(table.column("windows").to_pylist())
            for i in batches_of(len(inputs), batch, steps, np.random.default_rng(r)):
                trainer.update(inputs[i], targets[i], real[i])
            return pa.table({"slice": table.column("slice").slice(0, 1), "seen": pa.array([len(inputs)], pa.int64()), "flat": pa.array([net.packed(trainer.p).tobytes()], pa.binary())})

        return run

    for r in range(ROUNDS if total else 0):
        sent = sc.broadcast((net.packed(params), grams))

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros(len(net.packed(net.fresh()))), 0
            for b in batches:
                for n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    total, seen = total + n * np.frombuffer(raw, np.float32).astype(float), seen + n
            if seen:
                yield pa.record_batch({"i": pa.array(np.arange(len(total)), pa.int64()), "x": pa.array(total, pa.float64()), "w": pa.array(np.full(len(total), float(seen)), pa.float64())})

        mine = windows.filter(F.col("part") == r).select(F.pmod("h", F.lit(slices)).alias("slice"), "h", "windows")
        # Dealt out again, so that one task doesn't have a worker that trains and one that adds.
        trained = mine.groupBy("slice").applyInArrow(slice_trainer(r, sent), "slice bigint, seen bigint, flat binary").repartition("slice")
        trained = trained.select("seen", "flat").mapInArrow(added, "i bigint, x double, w double")
        flat = _gathered(trained, F.sum("x") / F.sum("w"))
        if len(flat):
            params = net.unpacked(flat.astype(np.float32))
    return params, grams


def _held(word: bytes) -> bytes:
    """The key under which a word is held: itself, or 0xFF, which UTF-8 never has, and its SHA-256."""
    return word if len(word) <= LONGEST else b"\xff" + hashlib.sha256(word).digest()


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """(word, c): the words, as they are held, above the lowest count that at most ``most`` words reach.

    The count is read from a histogram over counts on a logarithmic scale, which has at most some
    thousand steps however large the corpus.
    """
    step = F.floor(F.log2("c") * 64).cast("int")
    steps = counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("s")).collect()
    held, least = 0, None
    for r in steps:
        if held + r.n > most:
            break
        held, least = held + r.n, r.s
    key = F.when(F.length("word") <= LONGEST, F.col("word")).otherwise(F.concat(F.lit(bytearray(b"\xff")), F.unhex(F.sha2("word", 256))))
    return counts.filter(F.lit(False) if least is None else step >= least).select(key.alias("word"), "c")


class Frequent(NamedTuple):
    """Frequent words with line feeds between them, the most frequent first; their counts; and those of longer ones by their keys."""

    words: bytes
    counts: np.ndarray
    long: dict[bytes, int]


def frequent_words(counts: DataFrame, most: int) -> Frequent:
    rows = [(-r.c, bytes(r.word)) for r in _frequent(counts, most).toLocalIterator()]
    short = sorted(x for x in rows if x[1][:1] != b"\xff")
    return Frequent(b"\n".join(w for _, w in short), np.array([-c for c, _ in short], np.int64), {w: -c for c, w in rows if w[:1] == b"\xff"})


class Learned(NamedTuple):
    """What is learned from the training rows: the words' counts, and what every worker gets."""

    counts: DataFrame
    ends: int
    total: int
    distinct: int
    classes: net.Classes
    params: dict[str, np.ndarray]
    grams: tuple[np.ndarray, np.ndarray]


def learn(rows: DataFrame, tokenizer_path: str, frequent: int = FREQUENT) -> Learned:
    """Counts and the trained model of the rows (doc_id, text)."""
    counts = stored(word_counts(rows), "words")
    ends = rows.count()
    facts = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ids = subword_counts(counts, tokenizer_path, word_bpe(tokenizer_path).size)
    ids[END] += ends
    classes = net.Classes(ids)
    sent = rows.sparkSession.sparkContext.broadcast(frequent_words(counts, frequent))
    windows = stored(training_windows(rows, tokenizer_path, classes.of, sent), "windows", by="part")
    sent.destroy()
    params, grams = train(windows)
    return Learned(counts, ends, facts.n + ends, facts.v + (1 if ends else 0), classes, params, grams)


def score(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    A text is its words and one end. Cases: null and empty texts are the end alone; repeated rows
    each count in training and each give a row; a null id counts as empty text for the fold;
    without training rows N and V are 0 and the model gives every word its spelling by an even
    distribution; long texts and words are read whole; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return scored(rows, learn(rows.filter(~held_out("doc_id")), tokenizer_path, frequent), tokenizer_path, frequent)


def scored(rows: DataFrame, model: Learned, tokenizer_path: str, frequent: int = FREQUENT) -> DataFrame:
    """The scores of ``rows`` (doc_id, text) under a model."""
    total, ends, counts = model.total, model.ends, model.counts
    sent = rows.sparkSession.sparkContext.broadcast((model.classes.of, model.classes.share, net.packed(model.params), model.grams, frequent_words(counts, frequent)))
    per = math.log10(total + model.distinct + 1)
    own = OWN_SHARE if total else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, share, flat, grams, known = sent.value
        p, table = net.unpacked(flat), word_ids(tokenizer_path, END, known.words)
        counts, filled = np.zeros(table.most, np.int64), table.fixed
        counts[0], counts[1:filled] = ends, known.counts

        schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("word", pa.binary()), ("logp", pa.float64()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
        for batch in batches:
            for first, names, which, sizes in word_pieces(batch.column(1)):
                numbers = with_ends(table.of(names).take(which), sizes)
                if filled < len(table.names):
                    if len(table.names) > len(counts):
                        counts = np.concatenate((counts, np.zeros(len(table.names), np.int64)))
                    counts[filled : len(table.names)] = [known.long.get(_held(w), 0) if len(w) > LONGEST else 0 for w in table.names[filled:]]
                    filled = len(table.names)
                for texts, places in runs(sizes + 1, WORDS):
                    number, lengths = numbers[places], sizes[texts] + 1
                    begin = np.cumsum(lengths) - lengths
                    place = np.arange(len(number)) - np.repeat(begin, lengths)
                    ids, n = table.ids(number)
                    full = net.whole_windows(of.take(ids), np.add.reduceat(n, begin))
                    inputs, targets, real = net.parts(full)
                    logp = np.cumsum(np.append(0.0, net.log_probs(p, grams, inputs, targets)[real].astype(float))) / math.log(10)
                    stops = np.cumsum(n)
                    c = counts.take(number)
                    spelled = logp[stops] - logp[stops - n] + np.add.reduceat(share.take(ids), stops - n)
                    share_of = SO_FAR * _earlier(number, place) / (place + PRIOR) + (1 - own - SO_FAR) * 10.0 ** np.maximum(spelled, -290)
                    share_of += own * c / max(total, 1)
                    value, sure = np.log10(share_of), c > 0
                    sums = [np.add.reduceat(np.where(sure, x, 0), begin) for x in (1, np.log10(c + 1.0) - per, value)]
                    k = len(lengths)
                    name, mark = batch.column(0).slice(first + texts.start, k), batch.column(2).slice(first + texts.start, k)
                    yield pa.record_batch([name, mark, pa.nulls(k, pa.binary()), pa.nulls(k, pa.float64()), pa.array(lengths, pa.int64()), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.float64()), pa.array(sums[2], pa.float64())], schema=schema)
                    rare = np.nonzero(~sure)[0]
                    if m := len(rare):
                        text = pa.array(np.searchsorted(begin, rare, "right") - 1)
                        yield pa.record_batch([name.take(text), mark.take(text), pa.array([table.names[i] for i in number[rare].tolist()], pa.binary()), pa.array(value[rare], pa.float64()), *(pa.nulls(m, f.type) for f in list(schema)[4:])], schema=schema)
                table.trim()
                filled = min(filled, len(table.names))

    marked = rows.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    found = stored(marked.mapInArrow(run, "doc_id bigint, mark bigint, word binary, logp double, n bigint, known bigint, base double, score double"), "scores")
    rare = found.filter("word is not null").select("doc_id", "mark", "word", "logp").join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    mixed = F.log10(F.lit(own) * c / F.lit(float(max(total, 1))) + F.pow(F.lit(10.0), "logp"))
    rest = rare.select("doc_id", "mark", F.lit(0).cast("bigint").alias("rows"), F.lit(0).cast("bigint").alias("n"), (c > 0).cast("bigint").alias("known"), (F.log10(c + 1.0) - F.lit(per)).alias("base"), mixed.alias("score"))
    first = found.filter("word is null").select("doc_id", "mark", F.lit(1).cast("bigint").alias("rows"), "n", "known", "base", "score")
    # Equal rows give equal parts, so a group's sums are those of one row times their number.
    summed = first.unionByName(rest).groupBy("doc_id", "mark").agg(*(F.sum(x).alias(x) for x in ("rows", "n", "known", "base", "score")))
    one = summed.select("doc_id", F.explode(F.expr("sequence(1L, rows)")).alias("_"), *(F.expr(f"{x} div rows").alias(x) for x in ("n", "known")), *((F.col(x) / F.col("rows")).alias(x) for x in ("base", "score")))
    return one.select("doc_id", held_out("doc_id").alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def _earlier(number: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How often each word occurred before it in its text; ``place`` is each word's place in its text."""
    at = np.arange(len(number))
    ordered = np.sort((number << 32) | at)  # by word, then position
    position, which = ordered & 0xFFFFFFFF, ordered >> 32
    text = position - place[position]  # where the text begins
    new = np.append(True, (which[1:] != which[:-1]) | (text[1:] != text[:-1]))
    out = np.zeros(len(number))
    out[position] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out
