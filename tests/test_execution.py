import time

import pytest
from pyspark.sql import functions as F

from corpusql.operators import execution
from corpusql.operators.evaluation import evaluate_pairs, execution_outcomes

#: A join without a key over 10^16 pairs, each of them looked at.
NEVER = "SELECT count(*) AS n FROM big a JOIN big b ON a.id * 31 % 1000003 + b.id % 7 < -1"


@pytest.fixture
def big(spark):
    spark.range(10**8).createOrReplaceTempView("big")
    yield
    spark.catalog.dropTempView("big")


def test_a_query_that_never_ends_is_stopped_while_others_finish(spark, big):
    pairs = spark.createDataFrame(
        [("never", "SELECT 1 AS n", NEVER), ("reference", NEVER, "SELECT 1 AS n"), ("null", None, None)]
        + [(f"fine{i}", f"SELECT {i} AS n", f"SELECT {i} AS n") for i in range(6)]
        + [("same", "SELECT 3 AS n", "SELECT 3 AS n")],
        "candidate string, reference_sql string, generated_sql string",
    )
    began = time.time()
    got = {r.candidate: r for r in execution_outcomes(spark, pairs, seconds=4, parallel=4).collect()}
    assert time.time() - began < 90
    assert len(got) == 10
    flags = lambda r: (r.exec_success, r.exec_match, r.reference_failed)
    assert flags(got["never"]) == (False, False, False) and "4 seconds" in got["never"].error
    assert flags(got["reference"]) == (True, True, True)
    assert flags(got["null"]) == (False, False, False)
    assert all(flags(r) == (True, True, False) for k, r in got.items() if k[:4] in ("fine", "same"))
    # Nothing goes on behind it.
    deadline = time.time() + 20
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() < deadline:
        time.sleep(0.2)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    scored = {r.candidate: r.exec_success for r in evaluate_pairs(pairs, execution_outcomes(
        spark, pairs.where("candidate LIKE 'fine%'"), seconds=30)).collect()}
    assert scored["fine1"] and not scored["never"]


def test_distinct_texts_run_once(spark, monkeypatch):
    ran = []
    keep = execution.verdict
    monkeypatch.setattr(execution, "verdict", lambda s, a, b, *rest: ran.append((a, b)) or keep(s, a, b, *rest))
    monkeypatch.setattr(execution, "LOT", 2)
    pairs = spark.range(600).select(
        F.col("id").cast("string").alias("candidate"), F.lit("SELECT 1 AS n").alias("reference_sql"),
        F.concat(F.lit("SELECT "), F.col("id") % 5, F.lit(" AS n")).alias("generated_sql"),
    )
    rows = execution_outcomes(spark, pairs).collect()
    assert len(rows) == 600 and len(ran) == 5
    assert sum(r.exec_match for r in rows) == 120


@pytest.mark.parametrize("sql", [
    "CREATE TABLE t (a INT)", "SET spark.sql.ansi.enabled = false", "DROP TABLE x", "INSERT INTO x VALUES (1)",
    "SELECT 1); DROP TABLE x; SELECT (1", "SHOW TABLES", "CACHE TABLE big", "",
])
def test_only_queries_get_past_the_parser(spark, sql):
    with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR|PARSE_EMPTY|TABLE_OR_VIEW_NOT_FOUND"):
        execution.as_query(spark, sql)


@pytest.mark.parametrize("sql", ["SELECT 1 AS a -- why", "WITH x AS (SELECT 1 AS a) SELECT * FROM x;", "VALUES (1)", "SELECT 1 AS a ORDER BY a LIMIT 5 ; "])
def test_queries_of_any_form_run(spark, sql):
    assert execution.as_query(spark, sql).count() == 1
