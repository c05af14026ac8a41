"""Packing tokenized documents into fixed-length sequences along a space-filling curve.

Each document's token ids are hashed into a signed count vector, projected to three dimensions
and placed on a Hilbert curve. Documents are range-partitioned and sorted by curve position, so
neighbours in a sequence are alike, and every range is packed in one streaming pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import map_batches, stored
from .subwords import word_ids

DIMS, BITS, BUCKETS = 3, 10, 64
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of integer coordinates below 2**bits.

    Gray-code transposition: inverse undo of the rotations from the highest bit down, then bits
    of all dimensions are interleaved.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curve:
    """Curve keys of token-id arrays. Hashes and projection are fixed, so keys agree between tasks."""

    def __init__(self, vocabulary: int):
        h = (np.arange(vocabulary, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        self.bucket = (h % BUCKETS).astype(np.int64)
        self.sign = np.where((h >> np.uint64(10)) & np.uint64(1), 1.0, -1.0)
        self.project = np.random.default_rng(5).standard_normal((BUCKETS, DIMS)) / np.sqrt(BUCKETS)

    def keys(self, documents: list[np.ndarray]) -> np.ndarray:
        v = np.array([np.bincount(self.bucket[ids], self.sign[ids], BUCKETS) for ids in documents]).reshape(-1, BUCKETS)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        # A unit vector's projection lies mostly within 3/sqrt(BUCKETS) of zero; the tails share the outer cells.
        grid = np.clip((v @ self.project) * np.sqrt(BUCKETS) / 6 + 0.5, 0, 1 - 1e-9) * (1 << BITS)
        return hilbert_keys(grid.astype(np.int64))


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, ids): ids of the whole text and the end id, as 16-bit little-endian binary.

    A null or blank text has the end id alone. The vocabulary must have at most 65,536 ids.
    """

    def make():
        table = word_ids(tokenizer_path, end_id)
        if table.bpe.size > 1 << 16:
            raise ValueError(f"{tokenizer_path} has {table.bpe.size} ids; 16 bits hold 65,536")
        curve = Curve(table.bpe.size)

        def each(batch):
            names, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 256):
                part = []
                for t in texts.slice(at, 256):
                    part.append(table.ids(np.append(table.of((t.as_py() or "").encode().split()), 0))[0])
                    table.trim()
                yield {"doc_id": names.slice(at, 256), "key": curve.keys(part), "ids": [p.astype("<u2").tobytes() for p in part]}

        return each

    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("ids", pa.binary())])
    return map_batches(docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text"), lambda: _columns(make()), schema, "doc_id bigint, key bigint, ids binary")


def _columns(each):
    """Arrow columns pass through as Python lists."""

    def run(batch):
        for out in each(batch):
            yield {k: v.to_pylist() if isinstance(v, pa.Array) else v for k, v in out.items()}

    return run


def pack(ids: DataFrame, length: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents run on from one sequence to the next, so only a range's last sequence could be
    short; it is cut into sequences whose lengths are powers of two, which take no padding.
    Equal documents with equal ids are interchangeable, so their order doesn't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        made, held, fill = 0, [], 0  # held: pieces of the sequence that isn't full yet
        for batch in batches:
            rows: list[tuple] = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, start = np.frombuffer(raw, "<u2"), 0
                while start < len(ids):
                    n = min(length - fill, len(ids) - start)
                    held.append((name, start, ids[start : start + n], len(ids), fill))
                    start, fill = start + n, fill + n
                    if fill == length:
                        rows += [_row(p, first + made) for p in held]
                        made, held, fill = made + 1, [], 0
            yield from _batch(rows)
        rows, at, until = [], 0, 0  # the rest, by powers of two
        for name, start, ids, total, _ in held:
            while len(ids):
                if at == until:
                    until = 1 << ((fill).bit_length() - 1)
                    fill, at, made = fill - until, 0, made + 1
                n = min(until - at, len(ids))
                rows.append(_row((name, start, ids[:n], total, at), first + made - 1))
                ids, start, at = ids[n:], start + n, at + n
        yield from _batch(rows)

    ordered = ids.select("doc_id", "ids", "key").repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "ids").select("doc_id", "ids")
    return ordered.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def _row(piece: tuple, sequence: int) -> tuple:
    name, start, ids, total, offset = piece
    return name, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset


def _batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)


def packed(docs: DataFrame, tokenizer_path: str, length: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize ``docs`` once, into a stored table, and pack it.

    Cases: a null, empty or blank text is one end id; an empty table gives no rows; repeated rows
    are packed as often as they occur; a null id is kept as null; very long texts span sequences;
    other columns are not read.
    """
    return pack(stored(tokenized(docs, tokenizer_path, end_id, id_col, text_col), "tokenized"), length)
