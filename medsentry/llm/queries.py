"""The queries of this subpackage, by name, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fingerprints, hamming, language, lloyd, packing, phrases, pieces, pii, quality, scoring, simhash, urls
from .subwords import public_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.count(table(spark, sf_dir, "documents"), public_path("piece_bpe_32k.model"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hamming.top_k(rows, rows.filter("vec_id % 50 = 0"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(table(spark, sf_dir, "embeddings"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_and_next(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_lm_scoring, op2_url_filters, op3_quality, op4_pii, op5_packing, op6_token_counts, op7_decontamination, op8_language_id, op9_simhash, op10_topk, op11_clustering, op12_fingerprints, op13_collocations)
}

_URL_PARTS = """
SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
FROM pages"""



def _lloyd_sql(rounds: int) -> str:
    """Plain Lloyd: every vector against every centroid in each round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (SELECT v.id, v.q, c.j, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i]))) AS BIGINT) AS distance FROM v, c{r} AS c),
a{r} AS (SELECT id, q, arg_min(j, struct_pack(d := distance, j := j)) AS j, min(distance) AS distance FROM d{r} GROUP BY id, q)""")
        if r < rounds:
            steps.append(f"""p{r} AS (SELECT j, i, sum(q[i]) AS s, count(*) AS n FROM a{r}, range(1, 65) AS t(i) GROUP BY j, i),
m{r} AS (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM p{r} GROUP BY j),
c{r + 1} AS (SELECT j, coalesce(m{r}.q, c{r}.q) AS q FROM c{r} LEFT JOIN m{r} USING (j))""")
    return ",\n".join(steps)


_WORDS_SQL = """
p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p)"""

ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": f"""
WITH u AS ({_URL_PARTS}),
listed(rhost, rpath, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (SELECT page_id, host, path, (SELECT arg_max(struct_pack(r := rhost || rpath, a := action), length(rhost || rpath)) FROM listed WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS b FROM u)
SELECT page_id, host, path, b.r AS rule, coalesce(b.a, CASE WHEN regexp_matches(host || path, '^([^/]*[.-])?({"|".join((*urls.HOST_WORDS, *("-".join(p) for p in urls.HOST_PAIRS)))})[.-]|^[^/]*/([^/]*/)*({"|".join(p.replace(".", "[.]") for p in urls.PATH_PARTS)})(/|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM best""",
    "op10_topk": """
WITH c AS (SELECT vec_id AS id, list_transform(range(1, 65), lambda i: coalesce(embedding[i] > 0, false)) AS code FROM embeddings),
d AS (SELECT q.id AS query_id, c.id AS id, CAST(list_sum(list_transform(range(1, 65), lambda i: CAST(q.code[i] <> c.code[i] AS INTEGER))) AS INTEGER) AS distance FROM c AS q, c WHERE q.id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank, id, distance FROM d
QUALIFY rank <= 10""",
    "op11_clustering": f"""
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(embedding) = 64),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(id AS VARCHAR), '')), q) - 1 AS INTEGER) AS j, q FROM v QUALIFY j < 16),
{_lloyd_sql(3)},
g AS (SELECT j, CAST(sum(distance) AS BIGINT) AS d FROM a3 GROUP BY j)
SELECT id AS vec_id, j AS cluster, distance, g.d AS cluster_inertia, CAST((SELECT sum(distance) FROM a3) AS BIGINT) AS inertia, sha256(array_to_string(c3.q, ',')) AS centroid_sha256
FROM a3 JOIN g USING (j) JOIN c3 USING (j)""",
    "op13_collocations": f"""
WITH{_WORDS_SQL},
o AS (SELECT lang, len, w[i : i + len - 1] AS ws FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), range(1, 5) AS t(len) WHERE i + len - 1 <= len(w)),
f AS (SELECT lang, array_to_string(ws, ' ') AS phrase, any_value(ws) AS ws, any_value(len) AS len, count(*) AS f FROM o GROUP BY lang, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE len = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE len > 1 AND f >= 30),
e AS (SELECT lang || chr(10) || phrase AS part, f FROM f),
u AS (SELECT lang, phrase, f, k, lang || chr(10) || array_to_string(ws[:k], ' ') AS lpart, lang || chr(10) || array_to_string(ws[k + 1 :], ' ') AS rpart FROM c, range(1, 4) AS t(k) WHERE k < len),
k AS (SELECT lang, phrase, u.f, k, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * u.f // (x.f + y.f) AS BIGINT) AS score FROM u JOIN e AS x ON x.part = lpart JOIN e AS y ON y.part = rpart),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
s AS (SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, max(f) AS longer FROM c, range(2, 4) AS t(m), range(1, 4) AS u(i) WHERE m < len AND i + m - 1 <= len GROUP BY ALL),
z AS (SELECT b.*, n.n FROM b JOIN n USING (lang) LEFT JOIN s USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * b.f)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank, phrase, f AS a, l, r, n, score FROM z QUALIFY rank <= 2000""",
}
