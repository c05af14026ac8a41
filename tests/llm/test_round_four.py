import hashlib
from collections import Counter

import numpy as np
import pytest

from medsentry.llm import fingerprints, lloyd, phrases

# --- clustering ---


def plain_lloyd(rows, clusters=16, rounds=3):
    """Every vector against every centroid, in Python's integers."""
    kept = [(i, [int(np.floor(64 * np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [q for _, q in order[:clusters]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(cs))

    for _ in range(rounds):
        owned = {}
        for _, q in kept:
            owned.setdefault(nearest(q)[1], []).append(q)
        cs = [[sum(x) // len(owned[j]) for x in zip(*owned[j], strict=True)] if j in owned else c for j, c in enumerate(cs)]
    final = [(i, *nearest(q)) for i, q in kept]
    within = Counter()
    for _, d, j in final:
        within[j] += d
    return sorted((str(i), j, d, within[j], sum(within.values()), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, d, j in final)


def clustered(df, **how):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in lloyd.cluster(df, **how).collect())


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id bigint, embedding array<float>, cluster string, distance double")


def test_clusters_of_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert clustered(df) == plain_lloyd([(r.vec_id, r.embedding) for r in df.collect()])


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    near = [[float(x) for x in np.float32(rng.integers(-2, 3, 64) / 32)] for _ in range(12)]  # many ties
    rows = [(i, near[i % 12]) for i in range(60)] + [(7, near[7]), (None, near[1]), (None, near[2])]
    rows += [(100, None), (101, []), (102, [0.5] * 63), (103, [0.5] * 65), (104, [None] + [0.5] * 63), (105, [float("nan")] + [0.5] * 63), (106, [float("inf")] + [0.5] * 63)]
    rows += [(107, [1e6] * 64), (108, [-1e6] * 64), (109, [1e6 + 1] * 64)]
    for k, rounds in ((16, 3), (100, 1), (3, 0)):
        df = vectors(spark, rows).repartition(3)
        assert clustered(df, clusters=k, rounds=rounds) == plain_lloyd(rows, k, rounds)


def test_clusters_of_nothing(spark):
    assert clustered(vectors(spark, [])) == [] and clustered(vectors(spark, [(1, None)])) == []
    with pytest.raises(Exception, match="a component is beyond"):
        clustered(vectors(spark, [(1, [3e6] * 64)]))


def test_reassign_equals_full_search():
    """However few centroids changed, the delta step finds what a search over all finds."""
    rng = np.random.default_rng(5)
    q = rng.integers(-3, 4, (400, 4))
    old = rng.integers(-3, 4, (9, 4))
    every = lloyd.distances(q, old)
    owner, distance = every.argmin(1), every.min(1)
    for n in range(10):
        new, changed = old.copy(), np.sort(rng.choice(9, n, replace=False))
        new[changed] = rng.integers(-3, 4, (n, 4))
        full = lloyd.distances(q, new)
        at, d = lloyd.reassign(q, owner, distance, new, changed)
        assert (at == full.argmin(1)).all() and (d == full.min(1)).all()


# --- fingerprints ---


def jaccard(a, b):
    """Of paragraphs as multisets, without sketches."""
    a, b = Counter(fingerprints.paragraphs(a)), Counter(fingerprints.paragraphs(b))
    union = (a | b).total()
    return (a & b).total() / union if union else 1.0


def plain_neighbours(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    out = []
    for k, (i, t, _) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        e = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        out.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), *fingerprints.sketch([fingerprints.digests(t), fingerprints.digests(e)]).text(), jaccard(t, e), jaccard(t, n)))
    return sorted(out)


def neighbours(df, **how):
    return sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fingerprints.edited_and_next(df, **how).collect())


def hashed(df):
    return [(r.doc_id, r.t, r.h) for r in df.selectExpr("doc_id", "coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect()]


def test_fingerprints_of_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = neighbours(df)
    assert got == plain_neighbours(hashed(df))
    assert np.median([r[5] for r in got]) > 0.5 > 0.1 > np.median([r[6] for r in got])


def test_fingerprints_of_odd_rows(spark, odd, none):
    for runs in (1, 3, 40):
        assert neighbours(odd, runs=runs) == plain_neighbours(hashed(odd))
    assert neighbours(none) == []
    one = spark.createDataFrame([(5, "Ünïcödé 𝒳𝒴, a single text. It is its own next one.", 3)], "doc_id bigint, text string, fingerprint int")
    assert neighbours(one) == plain_neighbours(hashed(one))
    many = spark.createDataFrame([(1, "same, same. text", 0)] * 200 + [(2, "other text.", 0), (None, None, 0)], one.schema).repartition(3)
    assert neighbours(many, runs=16) == plain_neighbours(hashed(many))


def test_paragraphs_make_up_the_text(odd):
    for text in [r.text or "" for r in odd.collect()] + ["a b " * 5000, "語" * 3000, " \n\n. ,", "x. y\nz"]:
        assert "".join(fingerprints.paragraphs(text)) == text
        assert len(set(fingerprints.digests(text).tolist())) == len(fingerprints.paragraphs(text))


def test_an_insertion_changes_little():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in rng.integers(0, 500, 4000)]
    a, b = " ".join(words), " ".join([*words[:100], "new", *words[100:]])
    assert jaccard(a, b) > 0.98


def test_peeling_recovers_every_difference():
    """Both sides of the difference, of sizes from none to far more than the cells."""
    rng = np.random.default_rng(2)
    old, new, want = [], [], []
    for n in (0, 1, 2, 5, 11, 40, 300, 5000):
        for m in (0, 1, 3, 8, 90, 4000):
            common, a, b = (np.unique(rng.integers(0, 2**63, k).astype(np.uint64)) for k in (50, n, m))
            old.append(np.concatenate((common, a)))
            new.append(np.concatenate((b, common)))
            want.append((set(a.tolist()), set(b.tolist())))
    got = fingerprints.differ(old, new)
    assert [(set(a.tolist()), set(b.tolist())) for a, b, _ in got] == want
    assert {c for _, _, c in got} > {12, 24} and max(c for _, _, c in got) >= 5000


def test_compare(spark):
    rows = [(1, "One. Two. Three.", "One. Four. Three."), (2, None, ""), (3, "a", None), (4, "x. x. x.", "x. x.")]
    got = {r.id: r for r in fingerprints.compare(spark.createDataFrame(rows, "id int, old string, new string"), "id", "old", "new").collect()}
    assert [got[k].likeness for k in "1234"] == [0.5, 1.0, 0.0, jaccard("x. x. x.", "x. x.")]
    assert len(got["1"].only_old) == len(got["1"].only_new) == 1 and got["4"].only_new != got["4"].only_old


# --- phrases ---


def plain_phrases(rows, least, share=80, most=2000):
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            c = f.setdefault(lang, Counter())
            for k in range(1, 5):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        scored = []
        for p, a in cand.items():
            if 100 * longer[p] < share * a or not longer[p]:
                s, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(scored)[:most])]
    return sorted(out)


def mined(df, **how):
    return sorted(tuple(r) for r in phrases.collocations(df, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_phrases_of_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.lang, r.text) for r in df.collect()]
    want = plain_phrases(rows, 30)
    assert want and mined(df) == want
    low = plain_phrases(rows, 4, most=50)
    assert len(low) > 150
    assert mined(df, least=4, most=50) == low
    # A small worker's table, and pivots in several shards.
    assert mined(df, least=4, most=50, held=40, split=50) == low


def test_phrases_of_odd_rows(spark, odd, none, monkeypatch):
    rows = [(r.lang, r.text) for r in odd.collect()]
    rows += [(None, "a b a b a b a A\tB, a b\x0ba b"), ("", "É é É é É é. x" * 9), ("zz", ". , ;"), ("en", "the cat  sat on\x00x the cat sat on")] * 3
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, a int, phrase string").repartition(3)
    monkeypatch.setattr(phrases, "COUNTED", 6)
    monkeypatch.setattr(phrases, "LOT", 40)
    for least in (1, 2, 5):
        for how in ({}, {"held": 3}, {"held": 0, "split": 2}, {"split": 1}):
            assert mined(df, least=least, most=25, **how) == plain_phrases(rows, least, most=25)
    assert mined(none) == [] and mined(spark.createDataFrame([(None, None), ("en", " \t.")], "lang string, text string"), least=1) == []
