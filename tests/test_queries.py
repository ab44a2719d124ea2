"""Every registered query against its SQL in DuckDB, and the contract functions."""

import datetime
import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as contract  # noqa: E402
from watchloom.plans import ORACLES, QUERIES  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
ROWS_ONLY = {"reconstruct_pca", "reconstruct_lstm", "lotl_classifier", "lotl_comparison"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    rows = frame.collect()
    sql = ORACLES.get(name)
    if sql is None:
        assert name in ROWS_ONLY and rows
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(names)
    assert table(rows, frame.columns) == table(result.fetchall(), names)


def test_no_cross_products_and_no_single_partition_windows(spark, sf_dir):
    for name in ("session_agg", "session_events", "fixed_window_agg", "temporal_correlation", "decision",
                 "threshold_sweep", "analyze_sequence", "weight_grid_sweep", "gap_to_previous"):
        plan = contract.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_contract_has_all_of_them():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
