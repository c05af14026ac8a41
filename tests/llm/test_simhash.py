import numpy as np
import xxhash

from medsentry.llm import simhash


def plain(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute(rows, radius=4):
    """Component of each row by comparing all with all."""
    fps = [plain(r.text) for r in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                label[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[root(i)] = min(least.get(root(i), r.doc_id), r.doc_id)
    return sorted((str(r.doc_id), f"{fps[i]:016x}", str(least.get(root(i)))) for i, r in enumerate(rows))


def got(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect())


def test_against_brute_force(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for rows in (docs, odd):
        assert got(simhash.near_duplicates(rows)) == brute(rows.collect())


def test_many_shards_and_cells(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(simhash.near_duplicates(docs, shard=16, cell=7, sample=64)) == brute(docs.collect())


def test_native_hash_agrees(spark):
    assert spark.sql("select xxhash64('a b c d') h").first().h % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_links_exact_on_clusters():
    rng = np.random.default_rng(1)
    heads = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = np.unique(np.concatenate([heads, *(heads ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(40))]))
    every = np.arange(len(fps))
    tree = simhash.link(fps, every, every, 4, small=16)
    flat = simhash.link(fps, every, every, 4, small=10**9)
    pairs = {(a, b) for a in every for b in every if tree[a] == tree[b]}
    assert pairs == {(a, b) for a in every for b in every if flat[a] == flat[b]}


def test_keep_one(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == ["1", "3", "6", "7", "8", "9", "None"]


def test_keep_one_of_repeated_ids(spark):
    """Rows that repeat an id, with the same text or others, leave one defined row a component, however they lie in tasks."""
    texts = ["the first text has these seven words", "another text that is quite unlike the other"]
    rows = [(1, texts[0], "b", 1), (1, texts[0], "a", 2), (1, texts[0], "a", 1), (1, texts[1], "c", 3), (2, texts[1], "d", 4), (None, texts[0], "e", 5), (3, None, "f", 6), (3, "", "f", 5), (4, " ", "f", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, mark string, n int")
    want = sorted(map(str, [(1, texts[0], "a", 1), (1, texts[1], "c", 3), (None, texts[0], "e", 5), (3, None, "f", 6)]))
    for k in (1, 4):
        assert sorted(str(tuple(r)) for r in simhash.keep_one(df.repartition(k)).collect()) == want


def test_empty(none):
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
