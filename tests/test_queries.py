"""Every registered query of the library against its SQL counterpart, on the smallest tables."""

import duckdb
import pytest

from tidemark.plans.catalog import ORACLE_SQL, QUERIES, flagship
from tidemark.sources.fixtures import TABLES


@pytest.fixture(scope="module")
def con(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{tiny}/{t}.parquet')")
    return con


def text(v):
    if v is None:
        return "NULL"
    return ("%.9g" % v if v else "0") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(name, spark, tiny, con):
    df = QUERIES[name](spark, tiny)
    rel = con.sql(ORACLE_SQL[name])
    names = sorted(df.columns)
    assert sorted(rel.columns) == names
    at = [list(rel.columns).index(n) for n in names]
    got = sorted(tuple(text(r[n]) for n in names) for r in df.collect())
    assert got == sorted(tuple(text(r[i]) for i in at) for r in rel.fetchall())


ROWS_ONLY = sorted(set(QUERIES) - set(ORACLE_SQL) - {"calibrated_classifier", "selection_compare"})


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(name, spark, tiny):
    assert QUERIES[name](spark, tiny).columns


def test_flagship(spark, tiny):
    assert flagship(spark, tiny).count() > 0
