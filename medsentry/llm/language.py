"""Language identification by prediction by partial matching.

For each language a byte context tree of order three is counted over all its training texts.
Frozen PPM statistics (escape method C with exclusion) give every byte of a normalised text its
exact code length in each language; the language with the shortest code wins.

Normalising: letters a-z (after lower-casing) and all bytes from 0x80 on keep their identity; all
other ASCII bytes are one symbol, so layout and digits say little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_crc, stored

#: 27 symbols of ASCII, 64 continuation bytes, 51 lead bytes that UTF-8 has.
SYMBOLS, ORDER = 142, 3
#: Code lengths (seen contexts with their symbols, times languages) that a worker holds at once;
#: more languages than fit are scored in further passes.
MAX_CELLS = 1 << 25
#: Symbols after which further evidence no longer raises the score.
CONFIDENT = 64
_LETTER = regex.compile(r"\p{L}")


def _fold() -> np.ndarray:
    to = np.zeros(256, np.uint8)
    to[ord("a") : ord("z") + 1] = range(1, 27)
    to[0x80:0xC0] = range(27, 91)
    to[0xC2:0xF5] = range(91, 142)
    return to


FOLD = _fold()
_LEAD = b" " * ORDER


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded symbols of the texts one after another, three blanks before each, and where each text starts."""
    raw = [_LEAD + t.lower().encode() for t in texts]
    starts = np.cumsum([0] + [len(r) for r in raw])[:-1]
    return FOLD[np.frombuffer(b"".join(raw), np.uint8)], starts


def _grams(s: np.ndarray) -> np.ndarray:
    """Each symbol with the three before it, as one number; those of the first three symbols mean nothing."""
    out = s.astype(np.int32)
    for k in range(1, ORDER + 1):
        out[ORDER:] += s[ORDER - k : len(s) - k].astype(np.int32) * np.int32(SYMBOLS**k)
    return out


def count_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n): occurrences of each context of three symbols and the symbol after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}

        def merge(name: str) -> None:
            grams, counts = (np.concatenate(x) for x in zip(*found[name], strict=True))
            grams, which = np.unique(grams, return_inverse=True)
            found[name] = [(grams, np.bincount(which, counts).astype(np.int64))]

        for batch in batches:
            by: dict[str, list[str]] = {}
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(name, []).append(t)
            for name, texts in by.items():
                for at in range(0, len(texts), 512):
                    s, starts = symbols(texts[at : at + 512])
                    grams = _grams(s)
                    keep = np.ones(len(s), bool)
                    for k in range(ORDER):
                        keep[starts + k] = False
                    found.setdefault(name, []).append(np.unique(grams[keep], return_counts=True))
                    if len(found[name]) > 16:
                        merge(name)
        for name in found:
            merge(name)
            grams, counts = found[name][0]
            yield pa.record_batch({"lang": pa.array([name] * len(grams), pa.string()), "gram": pa.array(grams, pa.int32()), "n": pa.array(counts, pa.int64())})

    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("text is not null and lang is not null")
    return rows.mapInArrow(run, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class _Order:
    """Code lengths under contexts of ``k`` symbols. ``grams``: contexts with a symbol, as seen in any language.

    rows: code lengths of these in every language; escape: what any other symbol costs more than under the
    shorter context, for each of ``contexts`` and each language.
    """

    def __init__(self, k: int, grams: np.ndarray, n: np.ndarray, lower: _Order | None):
        self.k, self.grams, self.lower = k, grams, lower
        self.contexts, at = np.unique(grams // SYMBOLS, return_inverse=True)
        below = np.exp2(-(lower.bits(grams % SYMBOLS**k) if lower else np.full(n.shape, np.log2(SYMBOLS))))
        seen = n > 0
        total, distinct, left = (np.zeros((len(self.contexts), n.shape[1])) for _ in range(3))
        for out, what in ((total, n), (distinct, seen), (left, below * seen)):
            np.add.at(out, at, what)
        left = 1 - left
        escape = np.where((distinct == SYMBOLS) | (left <= 1e-12), 0.0, distinct)
        factor = np.where(total > 0, escape / np.maximum(total + escape, 1) / np.maximum(left, 1e-12), 1.0)
        p = np.where(seen, n / np.maximum(total + escape, 1)[at], below * factor[at])
        self.rows = (-np.log2(np.maximum(p, 1e-30))).astype(np.float32)
        self.escape = (-np.log2(np.maximum(factor, 1e-30))).astype(np.float32)

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code lengths of the last symbol of each gram, in every language."""
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        out = self.rows[at]
        other = np.nonzero(self.grams[at] != grams)[0]
        if len(other):
            out[other] = self.beyond(grams[other])
        return out

    def beyond(self, grams: np.ndarray) -> np.ndarray:
        """The same for grams that no language has."""
        context = grams // SYMBOLS
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        out = self.lower.bits(grams % SYMBOLS**self.k) if self.lower else np.full((len(grams), self.rows.shape[1]), np.log2(SYMBOLS), np.float32)
        return out + np.where((self.contexts[at] == context)[:, None], self.escape[at], 0)


class Model:
    """Code lengths in bits of every symbol after every context, for each language."""

    def __init__(self, languages: list[str], langs: np.ndarray, grams: np.ndarray, n: np.ndarray):
        """``langs``, ``grams``, ``n``: places in ``languages``, contexts of three symbols with the next, and their counts."""
        self.languages, order = languages, None
        for k in range(ORDER + 1):
            own, at = np.unique(grams % SYMBOLS ** (k + 1), return_inverse=True)
            counts = np.zeros((len(own), len(languages)))
            np.add.at(counts, (at, langs), n)
            if len(own):
                order = _Order(k, own, counts, order)
        self.order = order
        if order:  # the longest contexts' rows are found by two look-ups
            self.node = np.full(SYMBOLS**ORDER, -1, np.int32)
            self.node[order.contexts] = np.arange(len(order.contexts))
            self.cell = np.full(len(order.contexts) * SYMBOLS + 1, -1, np.int32)  # the last one: no node
            self.cell[self.node[order.grams // SYMBOLS] * SYMBOLS + order.grams % SYMBOLS] = np.arange(len(order.grams))

    def lengths(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code length of each text in each language, and its number of symbols."""
        s, starts = symbols(texts)
        grams = _grams(s)
        node = self.node[grams // SYMBOLS]
        row = self.cell[np.where(node < 0, -1, node * SYMBOLS + s)]
        each = self.order.rows[row]
        new = np.nonzero(row < 0)[0]
        if len(new):
            each[new] = self.order.beyond(grams[new])
        for k in range(ORDER):
            each[starts + k] = 0
        n = np.diff(np.append(starts, len(s))) - ORDER
        return np.add.reduceat(each, starts, axis=0, dtype=np.float64), n

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text: the language with the shortest code, that length, the sum of all languages' weights relative to it, and their scale."""
        bits, n = self.lengths(texts)
        least = bits.min(1)
        scale = np.minimum(n, CONFIDENT) / np.maximum(n, 1)
        gap = np.minimum((bits - least[:, None]) * scale[:, None], 1000.0)
        return bits.argmin(1), least, np.exp2(-gap).sum(1), scale


def models(docs: DataFrame, text: str = "text", lang: str = "lang", max_cells: int = MAX_CELLS) -> Iterator[Model]:
    """Count all of ``docs`` and freeze the statistics, in blocks of languages that fit ``max_cells``, by name.

    Nothing is left out: a language that doesn't fit with others is a block of its own. Its table is
    bounded by the contexts of three symbols, not by the corpus.
    """
    grams = stored(count_grams(docs, text, lang), "grams")
    sizes = grams.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()  # one row a language
    blocks: list[list[str]] = []
    held = 0
    for r in sizes:
        if not blocks or (held + r.n) * (len(blocks[-1]) + 1) > max_cells:
            blocks.append([])
            held = 0
        blocks[-1].append(r.lang)
        held += r.n
    for names in blocks:
        rows = grams.filter(F.col("lang").isin(names)).toPandas()
        at = {name: i for i, name in enumerate(names)}
        yield Model(names, rows.lang.map(at).to_numpy(np.int64), rows.gram.to_numpy(np.int64), rows.n.to_numpy(float))


def _judged(docs: DataFrame, model: Model, text_col: str) -> Column:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, least double, weight double, scale double, known boolean")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for texts in parts:
            out = []
            for at in range(0, len(texts), 128):
                some = [t or "" for t in texts.iloc[at : at + 128]]
                best, least, weight, scale = own.judge(some)
                out.append(pd.DataFrame({"lang": [own.languages[i] for i in best.tolist()], "least": least, "weight": weight, "scale": scale, "known": [bool(_LETTER.search(t)) for t in some]}))
            yield pd.concat(out) if out else pd.DataFrame({"lang": [], "least": [], "weight": [], "scale": [], "known": []})

    return judge(F.col(text_col))


def with_language(docs: DataFrame, found: Iterator[Model], column: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct (lang_pred, score) in ``column``; ``und`` and 0 without a letter or without a learned language.

    Each block of languages is one pass; between passes the rows are written, and only a text's best
    language and the sum of weights are carried on.
    """
    out = None
    for model in found:
        now = _judged(docs, model, text_col)
        if out is None:
            out = docs.withColumn(column, now)
            continue
        following = f"{column}_next"
        out = stored(out, "judged").withColumn(following, now)
        a, b = F.col(column), F.col(following)
        weight = lambda x, y: x["weight"] + y["weight"] * F.pow(F.lit(2.0), (x["least"] - y["least"]) * x["scale"])
        both = F.when(a["least"] <= b["least"], a.withField("weight", weight(a, b))).otherwise(b.withField("weight", weight(b, a)))
        out = out.withColumn(column, both).drop(following)
    if out is None:
        return docs.withColumn(column, F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score")))
    x = F.col(column)
    known = x["known"]
    return out.withColumn(column, F.struct(F.when(known, x["lang"]).otherwise(F.lit("und")).alias("lang_pred"), F.when(known, 1 / x["weight"]).otherwise(F.lit(0.0)).alias("score")))


def held_out(id_col: str) -> Column:
    return F.pmod(id_crc(id_col), F.lit(3)) == 1


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_cells: int = MAX_CELLS) -> Iterator[Model]:
    return models(docs.filter(~held_out(id_col)), text_col, lang_col, max_cells)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_cells: int = MAX_CELLS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row.

    Cases: null, empty and letterless texts are ``und`` with score 0 (letters are Unicode's, so a
    fraction or a circled digit is none), and so is every text when no training row has a language;
    equal code lengths go to the first language by name; long texts are read whole; repeated
    rows each give a row; a null id counts as empty text for the split; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = with_language(rows, learn(docs, id_col, text_col, lang_col, max_cells), "p")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "p.lang_pred", "p.score")


def accept(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that have an identified language with a score of ``least`` or more; all columns stay.

    Cases: null, empty and letterless texts go, and all rows do when no training row has a language;
    of repeated rows all stay or go; a null id is like any other; columns may have any names.
    """
    column = "found"
    while column in docs.columns:
        column += "_"
    out = with_language(docs, learn(docs, id_col, text_col, lang_col), column, text_col)
    return out.filter((F.col(column)["lang_pred"] != "und") & (F.col(column)["score"] >= least)).drop(column)
