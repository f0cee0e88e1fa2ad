"""Every query with SQL against that SQL in DuckDB, and the others for rows."""

import math

import duckdb
import pytest

from trialframe.plans import preprocessing, statistics

SF = "/root/testdata/sf0.001"
QUERIES = preprocessing.QUERIES | statistics.QUERIES
ORACLES = preprocessing.ORACLES | statistics.ORACLES


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("lineitem", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v if isinstance(v, (bool, str)) else float(v)


def same_rows(columns, rows):
    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(names)
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    assert same_rows(sorted(names), [r.asDict() for r in got.collect()]) == same_rows(sorted(names), want)


def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
