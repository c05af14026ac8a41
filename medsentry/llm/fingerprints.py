"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A sketch is a row of cells in three parts. A paragraph's digest adds 1, itself and its check sum to
one cell of each part. The sketch of one version less that of another keeps only the paragraphs that
differ; a cell with a single one left shows its digest, which is taken out of its other cells, and so
on (peeling). If some can't be reached, sketches of twice as many cells are tried.

A paragraph here is a clause of a line, as texts of one line are common; what has no mark for long is
cut after words that a hash picks, so an insertion moves no cut beyond the next one. The nth copy of a
paragraph in a text has a digest of its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Cells of a fingerprint, a multiple of three, and the paragraphs or characters worked on at once.
CELLS, LOT, LOT_CHARS = 12, 100_000, 4_000_000
_PARAGRAPH = re.compile("[^,;:.!?。！？，；\n]+[,;:.!?。！？，；\n]*|[,;:.!?。！？，；\n]+")
_LONG, _WORD = 160, re.compile(r"\s*\S{1,40}|\s+")
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def paragraphs(text: str) -> list[str]:
    """Pieces that make up the text."""
    out = []
    for piece in _PARAGRAPH.findall(text):
        if len(piece) <= _LONG:
            out.append(piece)
            continue
        words: list[str] = []
        for word in _WORD.findall(piece):
            words.append(word)
            if len(words) == 24 or crc32(word.encode()) & 7 == 0:
                out.append("".join(words))
                words = []
        if words:
            out.append("".join(words))
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's step."""
    x = x + _M1
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def digests(text: str) -> np.ndarray:
    """A 64-bit digest of each paragraph and which copy of it this is; no two of a text are equal."""
    keys = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, paragraphs(text)), np.uint64))
    if len(keys) < 2 or (keys[1:] != keys[:-1]).all():
        return keys
    first = np.append(True, keys[1:] != keys[:-1])
    at = np.arange(len(keys))
    copy = at - np.maximum.accumulate(np.where(first, at, 0))
    return np.where(copy, mix(keys ^ mix(copy.astype(np.uint64))), keys)


class Sketches:
    """The sketches of many texts: counts, digest sums and check sums, a row of ``cells`` each."""

    def __init__(self, rows: int, cells: int):
        self.cells, self.third = cells, cells // 3
        self.count = np.zeros(rows * cells, np.int64)
        self.sum = np.zeros(rows * cells, np.uint64)
        self.check = np.zeros(rows * cells, np.uint32)

    @staticmethod
    def _check(keys: np.ndarray) -> np.ndarray:
        return (mix(keys ^ _M3) >> np.uint64(32)).astype(np.uint32)

    def add(self, row: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Add (or, by ``sign`` -1, take away) a digest in each row's three cells; returns the cells."""
        check, times = self._check(keys), sign.astype(np.uint64)
        places = []
        for part in range(3):
            # The number of cells is part of the hash, so digests that block each other are apart in the next size.
            h = mix(keys ^ mix(np.full(1, 4 * self.cells + part, np.uint64)))
            at = row * self.cells + part * self.third + (h % np.uint64(self.third)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.add.at(self.sum, at, keys * times)
            np.add.at(self.check, at, check * times.astype(np.uint32))
            places.append(at)
        return np.concatenate(places)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, digest, sign) of all that can be recovered, and whether each row is empty then. The cells are used up."""
        look, found = np.arange(len(self.count)), []
        while len(look):
            n = self.count[look]
            look, n = look[np.abs(n) == 1], n[np.abs(n) == 1]
            times = n.astype(np.uint64)
            key = self.sum[look] * times
            pure = self._check(key) == self.check[look] * times.astype(np.uint32)
            row, key, n = look[pure] // self.cells, key[pure], n[pure]
            order = np.lexsort((key, row))
            row, key, n = row[order], key[order], n[order]
            once = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]))[: len(row)]
            row, key, n = row[once], key[once], n[once]
            if not len(row):
                break
            found.append((row, key, n))
            look = np.unique(self.add(row, key, -n))
        clear = ((self.count == 0) & (self.sum == 0) & (self.check == 0)).reshape(-1, self.cells).all(1)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), clear
        row, key, n = (np.concatenate(p) for p in zip(*found, strict=True))
        return row, key, n, clear

    def text(self) -> list[str]:
        """Each row's cells in base64: 4 bytes of count, 8 of sum, 4 of check."""
        cells = np.zeros(len(self.count), np.dtype([("n", "<i4"), ("s", "<u8"), ("c", "<u4")]))
        cells["n"], cells["s"], cells["c"] = self.count, self.sum, self.check
        raw, width = cells.tobytes(), 16 * self.cells
        return [base64.b64encode(raw[a : a + width]).decode() for a in range(0, len(raw), width)]


def _flat(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, keys), np.int64, len(keys))
    return np.repeat(np.arange(len(keys)), n), np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def sketch(keys: list[np.ndarray], cells: int = CELLS) -> Sketches:
    out = Sketches(len(keys), cells)
    row, flat = _flat(keys)
    out.add(row, flat, np.ones(len(row), np.int64))
    return out


def differ(old: list[np.ndarray], new: list[np.ndarray], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(digests only in old, only in new, cells of the sketches that gave them) of each pair, by subtracted sketches.

    A pair starts with as many cells as the numbers of paragraphs are apart, and tries twice as many
    until all is recovered. What is recovered must explain both numbers.
    """
    out: list = [None] * len(old)
    a, b = (np.fromiter(map(len, k), np.int64, len(k)) for k in (old, new))
    size = np.full(len(old), cells, np.int64)
    while (small := size < np.abs(a - b)).any():
        size[small] *= 2
    left = np.arange(len(old))
    while len(left):
        now = size[left].min()
        some = left[size[left] == now]
        both = Sketches(len(some), int(now))
        row, flat = _flat([old[i] for i in some])
        both.add(row, flat, np.ones(len(row), np.int64))
        row, flat = _flat([new[i] for i in some])
        both.add(row, flat, np.full(len(row), -1, np.int64))
        row, key, sign, clear = both.peel()
        order = np.argsort(row, kind="stable")
        row, key, sign = row[order], key[order], sign[order]
        ends = np.searchsorted(row, np.arange(len(some) + 1))
        for i, k in enumerate(some):
            s, e = ends[i], ends[i + 1]
            gone, come = key[s:e][sign[s:e] > 0], key[s:e][sign[s:e] < 0]
            if clear[i] and len(gone) <= a[k] and a[k] - len(gone) + len(come) == b[k]:
                out[k] = (gone, come, int(now))
        size[some] *= 2
        left = np.array([i for i in left if out[i] is None], np.int64)
    return out


def likeness(old: list[np.ndarray], new: list[np.ndarray]) -> list[float]:
    """Common paragraphs as a share of all that either has, from the recovered differences; 1 if both have none."""
    out = []
    for a, (gone, come, _) in zip(old, differ(old, new), strict=True):
        union = len(a) + len(come)
        out.append((len(a) - len(gone)) / union if union else 1.0)
    return out


def lots(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with some LOT_CHARS characters, one text at least."""
    a = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > LOT_CHARS:
            yield a, i
            a, held = i, 0
        held += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def compare(pairs: DataFrame, id_col: str, old_col: str, new_col: str) -> DataFrame:
    """id, only_old, only_new (hex digests of the paragraphs that differ), cells and likeness of two versions of a text.

    Cases: a null text counts as an empty one; two texts without paragraphs have likeness 1, one of
    them 0; repeated rows repeat; an empty table gives no rows; the id is returned as text; other columns aren't read.
    """

    def make():
        def each(batch):
            ids, old, new = (batch.column(i).to_pylist() for i in range(3))
            for a, b in lots([x + y for x, y in zip(old, new, strict=True)]):
                ka, kb = [digests(t) for t in old[a:b]], [digests(t) for t in new[a:b]]
                found = differ(ka, kb)
                union = [len(k) + len(come) for k, (_, come, _) in zip(ka, found, strict=True)]
                yield {
                    "id": ids[a:b],
                    "only_old": [sorted(f"{x:016x}" for x in gone.tolist()) for gone, _, _ in found],
                    "only_new": [sorted(f"{x:016x}" for x in come.tolist()) for _, come, _ in found],
                    "cells": [c for _, _, c in found],
                    "likeness": [(len(k) - len(gone)) / u if u else 1.0 for k, (gone, _, _), u in zip(ka, found, union, strict=True)],
                }

        return each

    schema = pa.schema([("id", pa.string()), ("only_old", pa.list_(pa.string())), ("only_new", pa.list_(pa.string())), ("cells", pa.int64()), ("likeness", pa.float64())])
    rows = pairs.select(F.col(id_col).cast("string").alias("id"), *(F.coalesce(c, F.lit("")).alias(n) for c, n in ((old_col, "old"), (new_col, "new"))))
    return map_batches(rows, make, schema, "id string, only_old array<string>, only_new array<string>, cells bigint, likeness double")


# --- each text against an edited one and the next one ---

_RESULT = [("doc_id", pa.int64(), "bigint"), ("n_chars", pa.int64(), "bigint"), ("edited_sha256", pa.string(), "string"), ("fingerprint", pa.string(), "string"), ("edited_fingerprint", pa.string(), "string"), ("near_edited", pa.float64(), "double"), ("near_next", pa.float64(), "double"), ("n_paragraphs", pa.int64(), "bigint")]


def _judged(ids: list, texts: list[str], keys: list[np.ndarray]) -> dict[str, list]:
    """The rows of all texts but the last one, which is only the last row's next text."""
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, texts[1:], strict=False)]
    own, new = keys[:-1], [digests(t) for t in edited]
    return {
        "doc_id": ids[:-1],
        "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        "fingerprint": sketch(own).text(),
        "edited_fingerprint": sketch(new).text(),
        "near_edited": likeness(own, new),
        "near_next": likeness(own, keys[1:]),
        "n_paragraphs": [len(k) for k in own],
    }


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one run of neighbours after another, each run closed by the row that follows it (``guard``)."""
    schema = pa.schema([(n, t) for n, t, _ in _RESULT])
    ids: list = []
    texts: list[str] = []
    held = 0

    def out(keep: bool):
        nonlocal ids, texts, held
        if len(texts) > 1:
            columns = _judged(ids, texts, [digests(t) for t in texts])
            yield pa.record_batch([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
        ids, texts = (ids[-1:], texts[-1:]) if keep else ([], [])
        held = sum(map(len, texts))

    for batch in batches:
        for id_, text, guard in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("guard").to_pylist(), strict=True):
            ids.append(id_)
            texts.append(text)
            held += len(text)
            if guard or held > LOT_CHARS:
                yield from out(not guard)


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs of every text.

    The edited text has the last quarter (rounded down) of its code points replaced by the first as many
    of the next document's text; after the last document comes the first. Rows are dealt once, in runs
    of neighbours; each run's first text is also sent to the run before. Limits between runs come from a
    sample of 40 ids a run; they only balance the work. ``docs`` is read three times and must give its rows
    in the same order each time, as a stored table does.

    Cases: a null text is empty; null ids come first; rows of equal id follow each other by the XXH64 of
    the text (seed 42), so repeated rows come one after another, and may lie in several runs; a single
    document is its own next one; an empty table gives no rows; other columns aren't read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("m"))
    runs = runs or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = docs.count()
    sample = sorted((r.id is not None, r.id or 0, r.h, r.m) for r in rows.select("id", "h", "m").sample(min(1.0, 40 * runs / max(1, n)), 7).collect())
    limits = [sample[i * len(sample) // runs] for i in range(1, runs)] if sample else []

    @F.pandas_udf("int")
    def run_of(known: pd.Series, id_: pd.Series, h: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(limits, k) for k in zip(*(c.tolist() for c in (known, id_, h, m)), strict=True)], dtype="int32")

    dealt = rows.withColumn("run", run_of(F.col("id").isNotNull(), F.coalesce("id", F.lit(0)), "h", "m"))
    heads = sorted(((r.run, r.id, r.h) for r in dealt.groupBy("run").agg(F.min(F.struct("id", "h", "m")).alias("k")).select("run", "k.id", "k.h").collect()), key=lambda r: r[0])
    before = [heads[i - 1][0] for i in range(len(heads))]  # the first text closes the last run
    wanted = spark.createDataFrame([(id_, h, to) for (_, id_, h), to in zip(heads, before, strict=True)], "id bigint, h bigint, run int")
    same = rows.alias("r").join(F.broadcast(wanted.alias("w")), F.col("r.id").eqNullSafe(F.col("w.id")) & (F.col("r.h") == F.col("w.h")))  # a row a run is broadcast
    guards = same.groupBy("w.run").agg(F.min("text").alias("text")).select(F.lit(None).cast("bigint").alias("id"), "text", F.lit(0).cast("bigint").alias("h"), "run", F.lit(True).alias("guard"))
    every = dealt.select("id", "text", "h", "run", F.lit(False).alias("guard")).unionByName(guards)
    every = every.repartitionById(runs, F.col("run")).sortWithinPartitions("run", "guard", "id", "h")
    return every.select("id", "text", "guard").mapInArrow(_follow, ", ".join(f"{n} {s}" for n, _, s in _RESULT))
