"""URL rules, decontamination, top-k search and the pipeline."""

import numpy as np
import pytest

import corpus_pipeline
from medsentry.llm import decontaminate, hamming, urls


# --- urls ---

URLS = [
    ("https://www.example.com/en/1?q=/x", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://a.Example.COM/en/2", "a.example.com", "/en/2", "example.com/en/", "block"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://x.net/es/a#b", "x.net", "/es/a", "net/es/", "block"),
    ("http://m.free-bets.example.org/de/9", "m.free-bets.example.org", "/de/9", None, "block"),
    ("http://alphabets.example.org/de/9", "alphabets.example.org", "/de/9", None, "allow"),
    ("http://my.win-prize.org/x", "my.win-prize.org", "/x", None, "block"),
    ("http://win.prize.org/x", "win.prize.org", "/x", None, "allow"),
    ("http://a.org/blog/wp-login.php?x", "a.org", "/blog/wp-login.php", None, "block"),
    ("http://a.org/wp-login.php5/cgi-bin", "a.org", "/wp-login.php5/cgi-bin", None, "block"),
    ("http://a.org/wp-loginxphp/my-banner", "a.org", "/wp-loginxphp/my-banner", None, "allow"),
    ("http://a.org/" + "long/" * 20000, "a.org", "/" + "long/" * 20000, None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://x.net/es/a#b", "x.net", "/es/a", "net/es/", "block"),
]


@pytest.mark.parametrize("in_memory", [200_000, 0])
def test_urls(spark, in_memory):
    df = spark.createDataFrame([(i, u[0], "clash") for i, u in enumerate(URLS)], "page_id bigint, url string, host string")
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, in_memory=in_memory).collect()}
    assert rows == {i: u[1:] for i, u in enumerate(URLS)}
    assert urls.judge(df.limit(0), in_memory=in_memory).count() == 0


@pytest.mark.parametrize("in_memory", [200_000, 0])
def test_index_agrees_with_all_rules(spark, sf_dir, in_memory):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    bare = urls.Index(tuple(urls.Rule(r.name, r.pattern, (), r.action) for r in urls.LISTED + urls.WORDS), {})
    for r in urls.judge(pages, in_memory=in_memory).join(pages, "page_id").collect():
        assert (r.rule, r.verdict) == bare.judge(*urls.parts(r.url))


def test_many_rules_without_tokens(spark, sf_dir):
    """20,000 rules that no token can find, and others, on both ways and by all rules on all URLs."""
    free = tuple(urls.Rule(f"r{i}" if i % 3 else None, rf"/{i}(?:[.]html)?$", (), "block" if i % 2 else "allow") for i in range(20_000))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = urls.LISTED + urls.WORDS + free
    rows = [sorted(urls.judge(pages, rules, in_memory=m).collect()) for m in (200_000, 0)]
    bare = urls.Index(tuple(urls.Rule(r.name, r.pattern, (), r.action) for r in rules), {})
    assert rows[0] == rows[1] and len(rows[0]) == pages.count()
    for r in rows[0]:
        assert (r.rule, r.verdict) == bare.judge(r.host, r.path)
    none = urls.judge(pages, (), in_memory=0).collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "allow")}


# --- decontamination ---

ITEM = "A farmer named Maria has 12 apples and sells 5 kg of pears to Tom before Maria buys 12 more apples in June"


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        (f"Some words before. {ITEM} and some after.", True),
        (ITEM.lower(), True),
        (ITEM.replace("Maria", "Elena").replace("12", "40").replace("5 kg", "9 lb").replace("Tom", "Ivan"), True),
        (ITEM.replace("Maria", "Elena").replace("12", "40").replace("5 kg", "9 miles").replace("Tom", "Ivan"), True),
        (ITEM.replace("12", "40", 1), True),
        ("A farmer named Maria has 12 apples", False),
        ("Nothing of the kind is found in this ordinary text about apples and pears.", False),
        ("", False),
        (None, False),
    ],
)
def test_templates(text, hit):
    assert bool(decontaminate.Matcher([(1, ITEM)]).match(text)) == hit


def test_inconsistent_slots():
    item = "If Anna pays 3 coins then Anna keeps 3 toys and if Anna pays 3 again then Anna wins"
    bad = "If Maria pays 4 coins then Paula keeps 9 toys and if Clara pays 7 again then Julia wins"
    good = item.replace("Anna", "Maria").replace("3", "4")
    m = decontaminate.Matcher([(1, item)])
    assert m.match(good) and not m.match(bad)


def test_variants_beside_each_other():
    def variant(a, b, c, d):
        return ITEM.replace("Maria", a).replace("12", b).replace("5 kg", c).replace("Tom", d)

    both = f"{variant('Elena', '40', '9 miles', 'Ivan')} {variant('Zoe', '30', '7 grams', 'Adam')}"
    assert decontaminate.Matcher([(1, ITEM)]).match(both) == [(1, 1.0)]


@pytest.mark.parametrize(
    ("item", "text"),
    [
        ("Tom has 5 apples. Tom gives 2 to Ann. How many apples does Tom have now?", "Sam has 7 apples. Sam gives 3 to Eve. How many apples does Sam have now?"),
        (ITEM, ITEM.replace("Maria", "Elena").replace("12", "40").replace("5 kg", "9 oz").replace("Tom", "Ivan")),
        ("a basket holds 3 pears and 5 plums at noon", "a basket holds 4 pears and 4 plums at noon"),
    ],
)
def test_names_units_and_equal_values(item, text):
    assert decontaminate.Matcher([(1, item)]).match(text) == [(1, 1.0)]


def test_rows_of_numbers():
    """Items with rows of numbers: any numbers fit those windows, but only the item's own words find it."""
    import time

    items = [(i, f"the sum of item w{i} is " + " ".join(str(i * 7 + k) for k in range(8)) + f" as told in chapter c{i} of the book") for i in range(200)]
    m = decontaminate.Matcher(items)
    began = time.time()
    assert m.match(" ".join(map(str, range(8000)))) == []
    assert time.time() - began < 1
    other = "the sum of item w5 is " + " ".join(str(900 + k) for k in range(8)) + " as told in chapter c5 of the book"
    assert [i for i, _ in m.match(f"{other} and {' '.join(map(str, range(500)))}")] == [5]


def test_scan_against_substrings(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "benchmark"))
    flat = lambda t: " ".join(t.lower().split())
    items = [flat(r.text) for r in bench.collect()]
    want = {r.doc_id for r in docs.collect() if r.text and any(i in flat(r.text) for i in items)}
    rows = decontaminate.scan(docs, bench).collect()
    assert {r.doc_id for r in rows if r.contaminated} == want and len(rows) == docs.count()
    split = decontaminate.scan(docs, bench, in_memory=300)
    assert {r.doc_id for r in split.filter("contaminated").collect()} == want


def test_scan_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "cat sat"), (None, "x"), (3, "cat sat")], "item_id bigint, text string")
    rows = decontaminate.scan(odd, bench).collect()
    assert len(rows) == 11 and {r.doc_id for r in rows if r.contaminated} == {1, 2}
    assert decontaminate.clean(odd, bench).columns == odd.columns and decontaminate.clean(odd, bench).count() == 9
    assert decontaminate.scan(none, bench).count() == 0 and decontaminate.scan(odd, bench.limit(0)).count() == 11


# --- top-k ---


def brute(codes, queries, k=10):
    out = []
    for q in queries:
        near = sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items())[:k]
        out += [(q, rank, i, d) for rank, (d, i) in enumerate(near, 1)]
    return sorted(out)


def as_code(v):
    return sum(1 << i for i, x in enumerate((v or [])[:64]) if x is not None and x > 0)


@pytest.mark.parametrize("how", [{}, {"segments": 2}, {"shard": 20, "most": 3}, {"segments": 3, "shard": 100}])
def test_top_k(spark, how):
    rng = np.random.default_rng(0)
    same = [1.0] * 64
    near = [[-1.0 if j in (i, i + 7) else 1.0 for j in range(64)] for i in range(40)]  # one hot value in most segments
    rows = [(i, same if i % 3 == 0 else near[i % 40] if i % 3 == 1 else rng.normal(size=64).tolist(), "c") for i in range(400)] + [(1000, None, "c"), (1001, [], "c"), (1050, [float("nan")] * 64, "c")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, code string")
    index = df.select(df.vec_id.alias("id"), hamming.code("embedding").alias("code"))
    found = hamming.search(index, index.filter("id % 50 = 0"), **how)
    codes = {i: as_code(v) for i, v, _ in rows}
    want = {(codes[q], i, d) for q, _, i, d in brute(codes, [i for i in codes if i % 50 == 0])}
    assert {(r.code % 2**64, r.id, r.distance) for r in found.collect()} == want


@pytest.mark.parametrize("lead", [0, 3])
def test_look_up_meets_each_code_once(lead):
    """All shards and radii together give every code for every query, at its distance, one time."""
    rng = np.random.default_rng(1)
    codes = np.unique(np.concatenate([rng.integers(0, 2**63, 60, dtype=np.uint64), np.arange(40, dtype=np.uint64) << np.uint64(30)]))
    cut, asked = hamming.Cut(5, lead), codes[::9]
    met = []
    for j in range(cut.segments):
        prefixes = cut.segment(codes, j) >> np.uint64(cut.low(j))
        for p in np.unique(prefixes):
            mine = codes[prefixes == p]
            q, c, d, _ = hamming.look_up(cut, j, int(p), mine, np.arange(len(mine)), asked, np.full(len(asked), 64), tuple(range(cut.width + 1)), len(codes))
            met += zip(q.tolist(), c.tolist(), d.tolist(), strict=True)
    assert sorted(met) == sorted((i, c, (int(a) ^ c).bit_count()) for i, a in enumerate(asked) for c in codes.tolist())


def test_wide_vectors_raise(spark):
    df = spark.createDataFrame([(0, [1.0] * 65)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="more than 64"):
        hamming.top_k(df, df).collect()


def test_top_k_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, -1.0]), (1, [1.0, 1.0]), (None, [1.0])], "vec_id bigint, embedding array<double>")
    rows = hamming.top_k(df, df.filter("vec_id = 0")).collect()
    assert sorted((r.query_id, r.rank, r.id, r.distance) for r in rows) == [(0, 1, 0, 0), (0, 2, 1, 1)]
    assert hamming.top_k(df.limit(0), df.limit(0)).count() == 0


# --- pipeline ---


def test_pipeline_stages_keep_columns(spark, sf_dir, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == odd.columns
    corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count()


def test_pipeline_against_plain(spark, sf_dir):
    """Every stage but language is redone plainly on the rows that the language stage keeps."""
    from medsentry.llm import pii

    from .test_packing import check
    from .test_simhash import brute as groups

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = corpus_pipeline.identify_language(spark, docs, sf_dir).collect()
    assert len(left) == docs.filter("text rlike '(?U)\\\\p{L}'").count()
    heads = {int(c) for _, _, c in groups(left)}
    flat = lambda t: " ".join(t.lower().split())
    items = [flat(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = [(r.doc_id, pii.masked(r.text)) for r in left if r.doc_id in heads and not any(i in flat(r.text) for i in items)]
    check(corpus_pipeline.run(spark, sf_dir).collect(), kept)
