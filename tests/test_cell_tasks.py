"""Grid cells are dealt over tasks by their number of rows, on rows with null keys, repeats and orphans; results as the SQL."""

import datetime as dt
import os
import random
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from oracle_check import compare  # noqa: E402

from cropframe.plans import catalog  # noqa: E402
from cropframe.sources import bindings as B  # noqa: E402

ROWS = 2400


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("cells"))
    rnd = random.Random(5)
    day = dt.datetime(1995, 1, 1)
    lines = [(rnd.choice([None, *range(330)]), float(rnd.randrange(1, 51)), rnd.randrange(11) / 100,
              day + dt.timedelta(days=rnd.randrange(700))) for _ in range(ROWS - 100)]
    orders = [(i, rnd.randrange(42)) for i in range(300)]
    customers = [(i, rnd.choice([None, *range(25)]), "BUILDING") for i in range(40)]
    made = {
        "lineitem": (lines + lines[:100], "l_orderkey long, l_quantity double, l_discount double, l_shipdate timestamp"),
        "orders": (orders + orders[:5], "o_orderkey long, o_custkey long"),
        "customer": (customers + customers[:3], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "nation": ([(i, i % 5) for i in range(25)], "n_nationkey int, n_regionkey int")}
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return root


def matches_sql_in_tasks_by_rows(spark, tables, monkeypatch, name):
    """In one task per 100 lines, however few tasks the session's settings would make."""
    monkeypatch.setattr(B, "TASK_ROWS", 100, raising=False)
    found = catalog.queries()[name](spark, tables)
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
    cur = con.execute(catalog.oracle_sql()[name])
    rows = [tuple(r) for r in found.collect()]
    ok, msg = compare(rows, found.columns, cur.fetchall(), [d[0] for d in cur.description])
    assert ok and len(rows) > 100, msg
    assert found.rdd.getNumPartitions() == ROWS // 100


def test_season_statistics_of_cells(spark, tables, monkeypatch):
    matches_sql_in_tasks_by_rows(spark, tables, monkeypatch, "season_statistics_cells")


def test_growing_season_months_of_cells(spark, tables, monkeypatch):
    matches_sql_in_tasks_by_rows(spark, tables, monkeypatch, "growing_season_months_cells")


def test_feature_chain_of_cells(spark, tables, monkeypatch):
    matches_sql_in_tasks_by_rows(spark, tables, monkeypatch, "cell_feature_chain")
