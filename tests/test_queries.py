"""Every query of the engine against its SQL in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from pluvia.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(v):
    return "%.8g" % (v + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, db, name):
    got = registry.QUERIES[name](spark, DIR)
    want = db.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_bootstrap_interval_is_ordered(spark):
    for r in registry.QUERIES["bt_bootstrap_csi"](spark, DIR).collect():
        assert r["low"] <= r["high"] and r["n"] == 200


def test_leafwise_boosting_beats_the_base_rate_of_every_lead(spark):
    rows = registry.QUERIES["trn_leafwise"](spark, DIR).collect()
    assert {(r["fold"], r["lead"]) for r in rows} == {(f, m) for f in (0, 1) for m in (10, 20)}
    for r in rows:
        assert 0 < r["events"] < r["n"] and r["brier"] < r["base"]
