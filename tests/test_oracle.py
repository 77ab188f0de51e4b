"""Every library query against its oracle SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from ctxspark.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return [plain(x) for x in v] if isinstance(v, list) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows, cols = df.collect(), sorted(df.columns)
    if name not in ORACLES:
        return
    r = con.execute(ORACLES[name])
    at = {d[0]: i for i, d in enumerate(r.description)}
    assert sorted(at) == cols
    assert sorted(repr([plain(x[c]) for c in cols]) for x in rows) == sorted(repr([plain(x[at[c]]) for c in cols]) for x in r.fetchall())


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "score"]
