"""Every named query against its DuckDB oracle, and the shape of their plans."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry_module
from check_oracles import compare, connect

from corpusql.plans import all_oracles, all_queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = all_queries()
ORACLES = all_oracles()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    shown = plan(df)
    assert "CartesianProduct" not in shown and "BroadcastNestedLoopJoin" not in shown
    problem = compare(df, duck, ORACLES[name])
    assert problem is None, problem


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLES) <= set(entry_module.oracle_sql())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 10


def test_pushdown_and_pruning(spark):
    shown = plan(QUERIES["sql_timestamp_filter"](spark, SF))
    assert "GreaterThanOrEqual(o_orderdate" in shown
    shown = plan(QUERIES["eval_rollup"](spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in shown


def test_split_moves_no_pairs(spark):
    # Above the cached cutoffs there is a scan, a map-side join and a projection.
    shown = plan(QUERIES["split_union"](spark, SF)).split("InMemoryRelation")[0]
    assert "BroadcastHashJoin" in shown and "Exchange hashpartitioning" not in shown


@pytest.mark.parametrize("name", ["stratified_split", "attempt_rollup", "sql_percentile"])
def test_partition_count_does_not_matter(spark, name):
    rows = lambda: sorted(map(str, QUERIES[name](spark, SF).collect()))
    eight = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        spark.catalog.clearCache()
        assert rows() == eight
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
