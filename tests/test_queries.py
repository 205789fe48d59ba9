"""Named queries against their check SQL: all of them, or a selection with FRAMELENS_FEW_QUERIES=1."""

import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from framelens.plans.views import TABLES

SF_DIR = "/root/testdata/sf0.001"
SELECTION = (
    "scl15_euler_from_matrix", "flt11_check_rules", "win9_diverse_references", "set5_plan_windows", "agg5_quality_report",
    "agg18_tree_hash", "str11_span_tree", "prv5_build_manifests", "jn7_box_instance_overlap", "top3_top_functions",
)
CHECKED = SELECTION if os.environ.get("FRAMELENS_FEW_QUERIES") else sorted(oracle_sql())


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_its_check(spark, duck, name):
    got = queries()[name](spark, SF_DIR)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    checked = duck.sql(oracle_sql()[name])
    at = [checked.columns.index(c) for c in columns]
    assert sorted(checked.columns) == columns
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in checked.fetchall())


def test_entry_and_names(spark):
    assert entry(spark).columns[0] == "video_id"
    assert set(oracle_sql()) <= set(queries())
