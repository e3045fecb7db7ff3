"""Every query with an oracle against DuckDB on the smallest tables; plans without unparted windows."""

import math
import os

import duckdb
import pytest

from sextant.plans import listings, wiring

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = listings.QUERIES | wiring.QUERIES, listings.ORACLES | wiring.ORACLES  # they add to those of queries, jobs and landing
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return str(v)[:10] if hasattr(v, "isoformat") and str(v)[10:] in ("", " 00:00:00") else str(v) if hasattr(v, "isoformat") else v


def ordered(rows, columns):
    at = [columns.index(x) for x in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    other = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(other.columns)
    assert ordered(df.collect(), df.columns) == ordered(other.fetchall(), other.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    QUERIES[name](spark, DIR).collect()


@pytest.mark.parametrize("name", ["bias_backtest", "multi_factor_rating", "top_k_backtest", "rebalance_returns", "asof_quarterly_to_daily"])
def test_windows_are_parted(spark, name):
    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition, ENSURE_REQUIREMENTS" not in "\n".join(x for x in plan.splitlines() if "Window" in x)
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["return_model", "forest_mse"])
def test_a_forest_reads_its_rows_from_a_table(spark, name):
    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "_rows-" in plan and "lineitem" not in plan
