import math
from collections import Counter

import pytest
from golden import GOLDEN, GOLDEN_MEANS
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusql.functions.scoring import _scorer, bleu
from corpusql.functions.text import TEMPLATE_SQL
from corpusql.operators import evaluation
from corpusql.operators.evaluation import execution_outcomes


def golden_frame(spark):
    rows = [(s, c, sql, TEMPLATE_SQL[t], score) for s, c, t, score, sql in GOLDEN]
    return spark.createDataFrame(
        rows,
        "schema_name string, complexity string, reference_sql string, generated_sql string, "
        "gold double",
    )


def test_golden_bleu(spark):
    scored = golden_frame(spark).withColumn(
        "bleu", bleu(F.col("reference_sql"), F.col("generated_sql"))
    )
    assert [r["bleu"] for r in scored.collect()] == [g[3] for g in GOLDEN]


def test_golden_rollup(spark):
    rows = golden_frame(spark).select(
        "schema_name", "complexity", F.col("gold").alias("bleu"),
        F.lit(True).alias("exec_success"), F.lit(False).alias("exec_match"),
    )
    got = {(r["level"], r["value"]): r for r in evaluation.eval_rollup(rows).collect()}
    assert set(got) == set(GOLDEN_MEANS)
    for key, (n, mean) in GOLDEN_MEANS.items():
        assert got[key]["total_evaluated"] == n
        assert got[key]["avg_bleu"] == pytest.approx(mean, abs=5e-7)
        assert (got[key]["execution_accuracy"], got[key]["validity_rate"]) == (0.0, 1.0)


def test_rollup_of_nothing(spark):
    rows = golden_frame(spark).where("false").select(
        "schema_name", "complexity", F.col("gold").alias("bleu"),
        F.lit(True).alias("exec_success"), F.lit(False).alias("exec_match"),
    )
    assert evaluation.eval_rollup(rows).collect() == []


def test_null_group_is_not_overall(spark):
    rows = spark.createDataFrame(
        [(None, "simple", 1.0, True, True)],
        "schema_name string, complexity string, bleu double, exec_success boolean, exec_match boolean",
    )
    levels = sorted(r["level"] for r in evaluation.eval_rollup(rows).collect())
    assert levels == ["complexity", "overall", "schema_name"]


def slow_bleu(ref, hyp):
    """The rule written out, without any of the shortcuts."""
    if not hyp:
        return 0.0
    logs = []
    for n in range(1, 5):
        grams = lambda w: Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
        h, r = grams(hyp), grams(ref)
        hit = sum(min(c, r[g]) for g, c in h.items())
        if n == 1 and hit == 0:
            return 0.0
        logs.append(math.log((hit if hit else 0.1) / max(1, sum(h.values()))))
    brevity = 1 if len(hyp) > len(ref) else math.exp(1 - len(ref) / len(hyp))
    return round(brevity * math.exp(math.fsum(0.25 * x for x in logs)), 4)


words = st.lists(st.sampled_from(["a", "b", "c", "(", ")"]), max_size=12)


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(words, words)
def test_bleu_rule(ref, hyp):
    assert _scorer()(" ".join(ref), " ".join(hyp)) == pytest.approx(slow_bleu(ref, hyp), abs=1e-4)


def test_bleu_edges(spark):
    rows = [("SELECT 1;", "select 1"), ("a", ""), ("", "a"), (None, "a"), ("a", None),
            ("héllo wörld x y", "HÉLLO WÖRLD X Y;;"), ("ab", "ab")]
    df = spark.createDataFrame(rows, "r string, h string")
    got = [x[0] for x in df.select(bleu(F.col("r"), F.col("h"))).collect()]
    assert got[5] == 1.0 and got[1:5] == [0.0] * 4
    assert got[6] == pytest.approx(round((1 * 0.1**3) ** 0.25, 4))


def test_running_eval_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "BLOCKS_PER_STRETCH", 3)
    flags = [(i, i % 3 == 0, i % 2 == 0) for i in range(1, 138)]
    df = spark.createDataFrame(flags, "step bigint, exec_match boolean, exec_success boolean")
    got = {
        r["evaluated"]: (r["execution_accuracy"], r["validity_rate"])
        for r in evaluation.running_eval(df).collect()
    }
    assert sorted(got) == list(range(10, 138, 10))
    for n, (match, ok) in got.items():
        assert match == pytest.approx(sum(f[1] for f in flags[:n]) / n)
        assert ok == pytest.approx(sum(f[2] for f in flags[:n]) / n)


def matches(left, right, *args, **kw):
    return evaluation.result_match(left, right, *args, **kw).first()["matches"]


def test_result_match_modes(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "i int, s string")
    shuffled = spark.createDataFrame([(None, 2), ("x", 1), (None, 2)], "s string, i int")
    fewer = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    assert matches(a, shuffled)
    assert not matches(a, fewer)
    assert matches(a, fewer, "set")
    assert not matches(a, a.toDF("i", "t"))
    assert matches(a, a.toDF("i", "t"), by_position=True)
    assert not matches(a, a.select("i"))
    assert matches(a.where("false"), fewer.where("false"))
    with pytest.raises(ValueError):
        matches(a.select("i", "i"), a)
    with pytest.raises(ValueError):
        matches(a, a, "ordered")
    assert matches(a.select("i", "i"), a.select("i", "i"), by_position=True)


def test_result_match_values(spark):
    x = spark.sql("SELECT 0.1D + 0.2D AS d, array(1, 2) AS a, map('k', 1) AS m")
    y = spark.sql("SELECT 0.3D AS d, array(1, 2) AS a, map('k', 1) AS m")
    assert not matches(x, y)
    assert matches(x, y, digits=9)


def test_result_match_ordered(spark):
    a = spark.createDataFrame([(i, i % 4) for i in range(50)], "k int, v int")
    b = a.withColumn("k", F.col("k") + 100)
    c = a.withColumn("k", -F.col("k"))
    assert matches(a, b, "ordered", order_by=["k"], compare=["v"])
    assert not matches(a, c, "ordered", order_by=["k"], compare=["v"])


def test_execution_outcomes(spark):
    spark.range(4).createOrReplaceTempView("four")
    outcomes = evaluation.execution_outcomes(
        spark,
        [
            ("ok", "SELECT id FROM four;", "SELECT id FROM four ORDER BY id DESC"),
            ("run_time", "SELECT 1 AS x", "SELECT 1 / (id - id) AS x FROM four"),
            ("blank", "SELECT 1", " ; "),
            ("empty", "SELECT 1", ";"),
            ("reference", "SELECT nope", "SELECT 1"),
        ],
    )
    got = {r["candidate"]: r for r in outcomes.collect()}
    flags = {k: (r["exec_success"], r["exec_match"], r["reference_failed"]) for k, r in got.items()}
    assert flags == {
        "ok": (True, True, False), "run_time": (False, False, False),
        "blank": (False, False, False), "empty": (False, False, False),
        "reference": (True, True, True),
    }
    assert "DIVIDE_BY_ZERO" in got["run_time"]["error"]
    assert got["empty"]["error"] == "Invalid SQL syntax"
    assert evaluation.execution_outcomes(spark, [("x", "", "")] * 1001).count() == 1001


def test_outcomes_of_odd_candidates(spark):
    spark.range(1).createOrReplaceTempView("kept_view")
    pairs = [
        ("drop", "SELECT 1 AS x", "DROP VIEW kept_view"),
        ("insert", "SELECT 1 AS x", "WITH a AS (SELECT 1) INSERT INTO kept_view SELECT * FROM a"),
        ("kinds", "SELECT 1 AS x", "SELECT 'abc' AS x"),
        ("twice", "SELECT 1 AS x", "SELECT 1 AS x, 2 AS x"),
        ("runtime", "SELECT 1 AS x", "SELECT 1 / 0 AS x"),
        ("reference", "SELECT nothing FROM nowhere", "SELECT 1 AS x"),
        ("same", "SELECT 1 AS x", "SELECT 1L AS x;"),
        ("same again", "SELECT 1 AS x", "SELECT 1L AS x;"),
    ]
    got = {r["candidate"]: r for r in execution_outcomes(spark, pairs).collect()}
    flags = {k: (r["exec_success"], r["exec_match"], r["reference_failed"]) for k, r in got.items()}
    assert flags == {
        "drop": (False, False, False), "insert": (False, False, False), "kinds": (True, False, False),
        "twice": (True, False, False), "runtime": (False, False, False), "reference": (True, True, True),
        "same": (True, True, False), "same again": (True, True, False),
    }
    assert spark.table("kept_view").count() == 1
    assert "DIVIDE_BY_ZERO" in got["runtime"]["error"]
