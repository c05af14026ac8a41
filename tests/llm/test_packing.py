import zlib

import numpy as np
from tokenizers import Tokenizer

from medsentry.llm import packing
from medsentry.llm.subwords import WordBpe, public_path

PATH = public_path("word_bpe_49k.json")


def expected(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def check(rows, docs):
    """Pieces cover every document's ids once, sequences have no gaps, and only full or power-of-two lengths."""
    ids = expected([t for _, t in docs])
    want = sorted((i if i is not None else -1, len(x)) for (i, _), x in zip(docs, ids, strict=True))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.doc_tokens) for r in rows if r.start == 0) == want
    by_id = {i: x for (i, _), x in zip(docs, ids, strict=True)}
    for r in rows:
        part = np.array(by_id[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    assert sum(r.length for r in rows) == sum(map(len, ids))
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in sequences.values())


def test_odd_rows(odd):
    check(packing.packed(odd, PATH).collect(), [(r.doc_id, r.text) for r in odd.collect()])


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(packing.packed(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_empty(none):
    assert packing.packed(none, PATH).count() == 0


def test_words_as_the_library():
    bpe, t = WordBpe(PATH), Tokenizer.from_file(PATH)
    words = "don't I'LL naïve ÉCOLE straße Ω <|endoftext|> a1b22 --- x's'd ½ ﬁn éte 日本 \x1c 'Tis".split(" ")
    for w in words:
        assert np.frombuffer(bpe(w.encode()), "<u4").tolist() == t.encode(w, add_special_tokens=False).ids, w


def test_hilbert_neighbours_are_adjacent():
    n = 8
    grid = np.array([(x, y, z) for x in range(n) for y in range(n) for z in range(n)])
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(n**3))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
