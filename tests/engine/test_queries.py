"""Every registered query against its SQL on the smallest data."""

import duckdb
import pytest

from medsentry.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(df):
    plain = lambda v: None if v is None or str(v) in ("<NA>", "nan", "NaT") else v.item() if hasattr(v, "item") else v
    return sorted(repr(tuple(plain(v) for v in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, sf_dir, name):
    assert rows(queries.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.execute(queries.ORACLE_SQL[name]).df())


def test_without_sql(spark, sf_dir):
    got = queries.QUERIES["mgps_lower_bound"](spark, sf_dir)
    assert got.filter("ebgm05 > ebgm or ebgm05 is null or isnan(ebgm05)").count() == 0
    fit = queries.QUERIES["mgps_fit"](spark, sf_dir).first()
    assert fit.n_pairs > 0 and fit.nll > 0
