from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusql.operators import querylog
from corpusql.sources.tables import append_log, replace_schema, write_registry

T0 = datetime(2024, 1, 1)


def test_log_rows(spark, tmp_path):
    entries = spark.createDataFrame(
        [("a", "x" * 600, None, None), (None, "", "sqlite", 2), ("", None, None, 0)],
        "query_id string, execution_error string, dialect string, correction_attempts int",
    )
    path = str(tmp_path / "log")
    append_log(entries, path)
    append_log(entries.limit(1), path)
    rows = spark.read.parquet(path).collect()
    assert len(rows) == 4
    assert {len(r["execution_error"]) for r in rows if r["execution_error"]} == {500}
    assert len({r["query_id"] for r in rows}) == 3 and all(r["query_id"] for r in rows)
    assert {r["dialect"] for r in rows} == {"postgresql", "sqlite"}
    assert {r["correction_attempts"] for r in rows} == {0, 2}


def log(spark):
    rows = [(i, f"s{i % 2}", [True, False, None][i % 3], T0 + timedelta(hours=i)) for i in range(9)]
    rows.append((9, "s0", False, None))
    return spark.createDataFrame(
        rows, "query_id bigint, schema_name string, execution_success boolean, created_at timestamp"
    )


def ids(df):
    return [r["query_id"] for r in df.collect()]


def test_recent_logs(spark):
    assert ids(querylog.recent_logs(log(spark), 3)) == [9, 8, 7]
    assert ids(querylog.recent_logs(log(spark), 2, "s1")) == [7, 5]
    assert ids(querylog.recent_logs(log(spark), failures_only=True)) == [9, 7, 4, 1]
    assert sorted(ids(querylog.filter_failures(log(spark)))) == [1, 4, 7, 9]


def test_feedback(spark):
    rows = [(1, 1, 1, 5), (2, 1, -1, 9), (3, 1, 1, 7), (4, 2, 0, 1), (5, 3, 5, 1), (6, 99, -1, 1),
            (7, 4, 1, 3), (8, 4, -1, 3), (9, 5, None, 1)]
    feedback = spark.createDataFrame(
        [(i, q, f, T0 + timedelta(minutes=m)) for i, q, f, m in rows],
        "feedback_id bigint, query_id bigint, feedback int, submitted_at timestamp",
    )
    view = {r["query_id"]: r["user_feedback"]
            for r in querylog.feedback_apply(log(spark), feedback).collect()}
    assert view == {0: None, 1: -1, 2: None, 3: None, 4: -1, **{i: None for i in range(5, 10)}}
    assert ids(querylog.feedback_unmatched(feedback, log(spark))) == [99]
    accepted = {r["feedback_id"] for r in querylog.filter_feedback(feedback).where("accepted").collect()}
    assert accepted == {1, 2, 3, 6, 7, 8}


def test_dedupe(spark):
    rows = log(spark)
    late = rows.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 DAY"))
    once = querylog.log_dedupe(rows.unionByName(late))
    assert sorted(ids(once)) == list(range(10))
    assert {r["query_id"]: r["created_at"] for r in once.collect()}[3] == T0 + timedelta(hours=3)


def attempts(spark):
    rows = [
        ("first", 0, True), ("third", 0, False), ("third", 1, False), ("third", 2, True),
        ("late", 0, False), ("late", 1, False), ("late", 2, False), ("late", 3, True),
        ("short", 0, False), ("short", 1, False), ("twice", 0, False), ("twice", 1, True),
        ("twice", 2, True),
    ]
    return spark.createDataFrame(
        [(q, a, f"{q}{a}", ok, None if ok else f"e{a}") for q, a, ok in rows],
        "query_id string, attempt int, sql string, success boolean, error string",
    )


def test_attempt_rollup(spark):
    got = {r["query_id"]: tuple(r)[1:] for r in querylog.attempt_rollup(attempts(spark)).collect()}
    assert got == {
        "first": (True, "first0", "first0", None, 0),
        "third": (True, "third2", "third0", None, 2),
        "late": (False, "late2", "late0", "e2", 2),
        "short": (False, "short1", "short0", "e1", 1),
        "twice": (True, "twice1", "twice0", None, 1),
    }
    assert querylog.attempt_rollup(attempts(spark), 0).where("success").count() == 3
    assert querylog.attempt_rollup(attempts(spark), 3).where("success").count() == 4
    lift = querylog.correction_lift(attempts(spark)).first()
    assert (lift["queries"], lift["first_attempt_rate"], lift["corrected_rate"]) == (5, 0.2, 0.6)


def test_registry_replace(spark, tmp_path):
    registry = spark.createDataFrame(
        [("a", "t1"), ("a", "t2"), ("b", "t1")], "schema_name string, table_name string"
    )
    first, second, third = (str(tmp_path / n) for n in "123")
    write_registry(registry, first)
    fresh = spark.createDataFrame([("n1",)], "table_name string")
    replace_schema(spark, first, second, "a", fresh)
    replace_schema(spark, second, third, "a", fresh.where("false"))
    rows = lambda p: sorted((r["schema_name"], r["table_name"]) for r in spark.read.parquet(p).collect())
    assert rows(second) == [("a", "n1"), ("b", "t1")]
    assert rows(third) == [("b", "t1")]
    assert len(rows(first)) == 3


def test_schema_list(spark):
    assert querylog.schema_list(log(spark).where("false")).collect() == []
    assert [tuple(r) for r in querylog.schema_list(log(spark)).collect()] == [
        ("s0", 6, T0), ("s1", 4, T0 + timedelta(hours=1))]
