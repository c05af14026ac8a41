"""Phrase collocation mining with pivot partitioning.

Words that are frequent in their language are numbered, the most frequent first. Every n-gram belongs
to its rarest word, its pivot. Each occurrence of a word is routed to that word's partition with what
can belong to it: up to three words before that are more frequent, and up to three after that are at
least as frequent; rarer words and marks cut the fragment. An n-gram is counted at the first occurrence
of its pivot in it, so once. Equal fragments are summed in the task that made them. A partition mines
the n-grams of its pivots alone; a pivot with very many fragments is dealt to several partitions by a
hash of the fragment, and its n-grams' counts are added up afterwards.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Words that a worker's table holds at most, distinct words or n-grams that a task counts at once, and tokens or fragments worked on at once.
HELD, COUNTED, LOT = 1_500_000, 2_000_000, 1 << 20
#: The longest phrase.
WORDS = 4
_FLAT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0a\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz " + b"." * 10)
_NONE = np.int32(2**31 - 1)


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words in lower case (A-Z), with ``.`` for each mark or line end between them; no word is ``.``.

    Texts come in parts of about LOT bytes, cut at marks, as no phrase goes across one.
    """
    flat, at = text.translate(_FLAT), 0
    while len(flat) - at > LOT and (cut := flat.find(b".", at + LOT)) > 0:
        yield flat[at:cut].replace(b".", b" . ").split()
        at = cut
    yield flat[at:].replace(b".", b" . ").split()


def _own(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text"))


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, f) of all words."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                c.pop(b".", None)
                words = list(c)
                for a in range(0, len(words), 100_000):
                    some = words[a : a + 100_000]
                    yield pa.record_batch([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()), pa.array([c[w] for w in some], pa.int64())], schema=schema)
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for words in tokens(text):
                    counts.setdefault(lang, Counter()).update(words)
            if sum(map(len, counts.values())) > COUNTED:
                yield from out()
        yield from out()

    return rows.mapInArrow(run, "lang string, word binary, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def numbered(counts: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, id) of the words with f >= ``least``: ids from 1 on go by lang, then by falling f."""
    by = [F.col("lang"), F.col("f").desc(), F.col("word")]
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(counts.filter(F.col("f") >= least).repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("m", F.monotonically_increasing_id()), "words")
    part = F.shiftright("m", 33).cast("int")
    sizes = sorted((r.part, r.n) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = np.cumsum([0] + [n for _, n in sizes]).tolist()
    offsets = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "part int, before bigint")
    # A row a partition is broadcast.
    rows = rows.withColumn("part", part).join(F.broadcast(offsets), "part")
    return rows.select("lang", "word", "f", (F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int").alias("id"))


def fragments(ids: np.ndarray) -> np.ndarray:
    """What each pivot is sent: rows (pivot, three before from near to far, three after), 0 for none.

    ``ids``: numbers of a text's words, 0 where a text is cut. Rows with neither side are left out.
    """
    n = len(ids)
    p = np.full(n + 6, _NONE, np.int32)
    p[3 : n + 3] = np.where(ids > 0, ids, _NONE)
    own = p[3 : n + 3]
    columns = [ids]
    for side in (-1, 1):
        on = ids > 0
        for k in (1, 2, 3):
            other = p[3 + side * k : 3 + side * k + n]
            on = on & ((other < own) if side < 0 else (other <= own))
            columns.append(np.where(on, other, 0))
    keep = (columns[1] > 0) | (columns[4] > 0)
    return np.stack([c[keep] for c in columns], 1).astype(np.int32)


def _mixed(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        h = (h ^ rows[:, c].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _summed(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows of a matrix once, with the sum of ``n``."""
    if not len(rows):
        return rows, n
    h = _mixed(rows)
    order = np.argsort(h)
    h, new = h[order], (rows[order[1:]] != rows[order[:-1]]).any(1)
    if (new & (h[1:] == h[:-1])).any():  # different rows share a hash
        order = np.lexsort(rows.T)
        new = (rows[order[1:]] != rows[order[:-1]]).any(1)
    first = np.nonzero(np.append(True, new))[0]
    return rows[order[first]], np.add.reduceat(n[order], first)


_SENT = pa.schema([("pivot", pa.int32()), ("salt", pa.int32()), ("words", pa.binary()), ("n", pa.int64())])


def _sent(ids: np.ndarray, shards: dict[int, int]) -> pa.RecordBatch:
    """The fragments of numbered texts, equal ones once, with the shard of pivots that have several."""
    rows = fragments(ids)
    rows, n = _summed(rows, np.ones(len(rows), np.int64))
    salt = np.zeros(len(rows), np.int32)
    if shards and len(rows):
        hot = np.array(sorted(shards), np.int32)
        many = np.array([shards[h] for h in hot.tolist()], np.uint64)
        at = np.minimum(np.searchsorted(hot, rows[:, 0]), len(hot) - 1)
        split = hot[at] == rows[:, 0]
        salt[split] = (_mixed(rows[split]) % many[at[split]]).astype(np.int32)
    words = pa.FixedSizeBinaryArray.from_buffers(pa.binary(24), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows[:, 1:]).tobytes())])
    return pa.record_batch([pa.array(rows[:, 0], pa.int32()), pa.array(salt), words.cast(pa.binary()), pa.array(n, pa.int64())], schema=_SENT)


_SENT_SQL = "pivot int, salt int, words binary, n bigint"


def routed(rows: DataFrame, table: dict[str, tuple[int, bytes]], shards: dict[int, int]) -> DataFrame:
    """Fragments of whole texts, by a table of all frequent words in each worker: lang -> (first id, its words in order)."""
    sent = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, dict[bytes, int]] = {}
        held, size = [], 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if lang not in sent.value:
                    continue
                if lang not in tables:
                    first, words = sent.value[lang]
                    tables[lang] = {w: first + i for i, w in enumerate(words.split(b"\n"))}
                get = tables[lang].get
                for words in tokens(text):
                    held.append(np.array([get(w, 0) for w in words] + [0], np.int32))
                    size += len(held[-1])
                    if size > LOT:
                        yield _sent(np.concatenate(held), shards)
                        held, size = [], 0
        if held:
            yield _sent(np.concatenate(held), shards)

    return rows.mapInArrow(run, _SENT_SQL)


def routed_by_join(rows: DataFrame, words: DataFrame, table: dict[str, tuple[int, bytes]], shards: dict[int, int]) -> DataFrame:
    """The same where the frequent words don't fit a worker: its table has the most frequent ones, the others get their numbers by a join.

    So no frequent word is a key of the join. Pieces between marks are put together again by their number.
    """
    sent = rows.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([("row", pa.int64()), ("piece", pa.int64()), ("at", pa.int64()), ("lang", pa.string()), ("word", pa.binary()), ("id", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, dict[bytes, int]] = {}
        for batch in batches:
            for row, lang, text in zip(*(batch.column(c).to_pylist() for c in ("row", "lang", "text")), strict=True):
                if lang not in tables:
                    first, known = sent.value.get(lang, (1, b""))
                    tables[lang] = {w: first + i for i, w in enumerate(known.split(b"\n")) if w}
                piece = 0
                for found in tokens(text):
                    out: list[tuple] = []
                    for at, word in enumerate(found):
                        if word == b".":
                            piece += 1
                        else:
                            id_ = tables[lang].get(word)
                            out.append((row, piece, at, lang, None if id_ else word, id_))
                    piece += 1
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    every = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut, "row bigint, piece bigint, at bigint, lang string, word binary, id int")
    every = stored(every, "tokens")
    known = every.filter("id is not null").select("row", "piece", "at", "id")
    joined = every.filter("id is null").select("row", "piece", "at", "lang", "word").join(words.select("lang", "word", "id"), ["lang", "word"]).select("row", "piece", "at", "id")
    pieces = known.unionByName(joined).groupBy("row", "piece").agg(F.sort_array(F.collect_list(F.struct("at", "id"))).alias("w")).select(F.col("w.at").alias("at"), F.col("w.id").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = batch.column("at").offsets.to_numpy()
            at, ids = batch.column("at").flatten().to_numpy(), batch.column("id").flatten().to_numpy()
            # A place for every word, and an empty one where rare words were or a piece ends.
            gap = np.append(False, np.diff(at) != 1)[: len(ids)]
            gap[begin[(begin > 0) & (begin < len(ids))]] = True
            flat = np.zeros(len(ids) + int(gap.sum()), np.int32)
            flat[np.arange(len(ids)) + np.cumsum(gap)] = ids
            yield _sent(flat, shards)

    return pieces.mapInArrow(run, _SENT_SQL)


def mined(sent: DataFrame, shards: dict[int, int], least: int) -> DataFrame:
    """(w, f): n-grams of 2 to 4 word numbers that occur ``least`` times or more, mined where their pivot's fragments are."""
    schema = pa.schema([("w", pa.list_(pa.int32())), ("f", pa.int64())])
    split = np.array(list(shards), np.int32)

    def grams(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, times = [], []
        for before in range(WORDS):
            for after in range(WORDS - before):
                if before + after:
                    has = np.ones(len(rows), bool)
                    if before:
                        has &= rows[:, before] > 0
                    if after:
                        has &= rows[:, 3 + after] > 0
                    some = rows[has]
                    gram = np.zeros((len(some), WORDS + 1), np.int32)
                    gram[:, WORDS] = some[:, 0]
                    gram[:, : before + after + 1] = some[:, [*range(before, 0, -1), 0, *range(4, 4 + after)]]
                    found.append(gram)
                    times.append(n[has])
        return _summed(np.concatenate(found), np.concatenate(times))

    def out(rows: np.ndarray, n: np.ndarray, whole: bool) -> Iterator[pa.RecordBatch]:
        rows, n = grams(rows, n)
        keep = np.isin(rows[:, WORDS], split) | (n >= least) if whole else np.ones(len(rows), bool)
        rows, n = rows[keep, :WORDS], n[keep]
        for a in range(0, len(rows), 100_000):
            some = rows[a : a + 100_000]
            ends = np.append(0, np.cumsum((some > 0).sum(1))).astype(np.int32)
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array(ends), pa.array(some[some > 0])), pa.array(n[a : a + 100_000])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pivots come one after another; all that have ended are counted, and the last one waits for the rest of it."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size, over = 0, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            words = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.int32).reshape(-1, 6)
            parts.append((np.concatenate((batch.column("pivot").to_numpy()[:, None], words), 1), batch.column("n").to_numpy()))
            size += batch.num_rows
            if size <= LOT // 4:
                continue
            rows, n = (np.concatenate(p) for p in zip(*parts, strict=True))
            last = rows[-1, 0]
            cut = int(np.searchsorted(rows[:, 0], last))
            begun = rows[:cut, 0] == over
            yield from out(rows[:cut][~begun], n[:cut][~begun], True)
            yield from out(rows[:cut][begun], n[:cut][begun], False)
            rows, n = rows[cut:], n[cut:]
            if len(rows) > COUNTED:  # what a task can't hold of one pivot is added up after it
                over = last
                yield from out(rows, n, False)
                rows, n = rows[:0], n[:0]
            parts, size = [(rows, n)], 0 if len(rows) < LOT // 8 else -len(rows)
        if parts:
            rows, n = (np.concatenate(p) for p in zip(*parts, strict=True))
            begun = rows[:, 0] == over
            yield from out(rows[~begun], n[~begun], True)
            yield from out(rows[begun], n[begun], False)

    parts = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = sent.repartition(parts, "pivot", "salt").sortWithinPartitions("pivot").mapInArrow(run, "w array<int>, f bigint")
    # Those of one task are whole already; the few pivots with several shards are added up.
    return found.groupBy("w").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def scored(counts: DataFrame, grams: DataFrame) -> DataFrame:
    """w, f, l, r, score of each phrase in ``grams``, at the cut with the lowest score; ``counts`` has (w, f) of all parts."""
    cuts = grams.select("w", "f", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("w", "f", "k", F.slice("w", 1, F.col("k")).alias("left"), F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    first, rest = counts.select(F.col("w").alias("left"), F.col("f").alias("l")), counts.select(F.col("w").alias("right"), F.col("f").alias("r"))
    cuts = cuts.join(first, "left").join(rest, "right")
    # Exact: 2000000 * f in 26 digits; the quotient is 1000000 at most.
    score = F.expr("(cast(f as decimal(19,0)) * 2000000bd) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    low = cuts.groupBy("w").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "f")).alias("m"))
    return low.select("w", "m.f", "m.l", "m.r", "m.score")


def maximal(phrases: DataFrame, grams: DataFrame, share: int) -> DataFrame:
    """``phrases`` without those that lie in a longer one of ``grams`` with ``share`` per cent of their occurrences or more."""
    inside = grams.filter(F.size("w") > 2).withColumn("n", F.explode(F.sequence(F.lit(2), F.size("w") - 1)))
    inside = inside.withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1))).select(F.slice("w", F.col("at"), F.col("n")).alias("w"), "f")
    longest = inside.groupBy("w").agg(F.max("f").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return phrases.join(longest, "w", "left").filter(F.col("longer").isNull() | (wide("longer") * 100 < wide("f") * share)).drop("longer")


def named(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``phrases`` with lang and phrase, the words with spaces between them."""
    parts = phrases.select("w", F.posexplode("w").alias("at", "id")).join(words.select("id", "lang", F.col("word").cast("string").alias("word")), "id")
    texts = parts.groupBy("w").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return phrases.join(texts, "w")


def first_of_each(rows: DataFrame, by: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each ``by`` with their rank. Groups are cut in shares, fewer each time, so no task sorts a whole one."""
    shares = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        where = [F.col(by)] if shares <= 1 else [F.col(by), F.pmod(F.xxhash64("w"), F.lit(shares))]
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*where).orderBy(*order)).cast("bigint")).filter(F.col("rank") <= most)
        if shares <= 1:
            return rows
        shares //= 8


def collocations(docs: DataFrame, least: int = 30, share: int = 80, most: int = 2000, text_col: str = "text", lang_col: str = "lang", held: int = HELD, split: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to 4 words, after dropping parts of longer ones.

    ``a`` occurrences; ``l`` and ``r`` those of both parts at the lowest-scoring cut; ``n`` words of the
    language; score floor(2000000 * a / (l + r)). ``held`` words at most are kept in a worker; beyond
    it the rarer ones are numbered by a join. A word that occurs ``split`` times or more has several shards.

    Cases: a null language is ``und``, a null text is empty; ties of score and a go by the phrase; texts
    of marks or white space have no words; repeated rows count each; a language without a phrase
    has no row, and an empty table gives none; long texts are cut at marks, where no phrase goes across;
    other columns are not read.
    """
    rows = _own(docs, text_col, lang_col)
    every = stored(word_counts(rows), "counts")
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    words = stored(numbered(every, least), "numbered")
    n, number = (x or 0 for x in words.agg(F.sum("f"), F.count("*")).first())
    split = split or max(4096, n // (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # At most n / split words, four times the partitions.
    shards = {r.id: -(-r.f // split) for r in words.filter(F.col("f") > split).select("id", "f").collect()}
    known = words
    if number > held:  # the most frequent ones of all languages, ``held`` at most
        least_held = words.groupBy("f").agg(F.count("*").alias("n")).withColumn("m", F.sum("n").over(Window.orderBy(F.desc("f")))).filter(F.col("m") <= held).agg(F.min("f")).first()[0]
        known = words.filter(F.col("f") >= (least_held if least_held else 1 << 62))
    table: dict[str, tuple[int, bytes]] = {}
    lists: dict[str, list] = {}
    for r in known.select("lang", "id", "word").orderBy("id").toLocalIterator():
        lists.setdefault(r.lang, [r.id, []])[1].append(bytes(r.word))
    table = {lang: (first, b"\n".join(found)) for lang, (first, found) in lists.items()}
    sent = routed(rows, table, shards) if number <= held else routed_by_join(rows, words.join(known.select("id"), "id", "left_anti"), table, shards)
    grams = mined(sent, shards, least)
    grams = stored(grams, "phrases")
    counts = grams.unionByName(words.select(F.array("id").alias("w"), "f"))
    best = named(maximal(scored(counts, grams), grams, share), words)
    best = first_of_each(best, "lang", [F.desc("score"), F.desc("f"), "phrase"], most)
    return best.join(totals, "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
