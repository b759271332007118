import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusql.functions.vectors import cosine_distance, embed_input
from corpusql.operators import pivots, retrieval
from corpusql.operators.retrieval import retrieval_batch
from corpusql.plans.flows import answer_questions


def distance(a, b):
    if a is None or b is None:
        return None
    a, b = np.array(a, float), np.array(b, float)
    norms = np.linalg.norm(a) * np.linalg.norm(b)
    return math.nan if norms == 0 else round(1 - float(a @ b) / norms, 9)


def order(d):
    if d is None:
        return (2, 0.0)
    return (1, 0.0) if math.isnan(d) else (0, d)


def nearest(question, tables, k):
    ranked = [(order(distance(question[2], t[2])), t[1]) for t in tables if t[0] == question[1]]
    return [name for _, name in sorted(ranked)[:k]]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)

    def vec(i):
        if i % 17 == 0:
            return None
        if i % 19 == 0:
            return [0.0] * 4
        return [float(x) for x in rng.integers(-2, 3, 4)]  # few values: many ties

    schema = lambda i: "hot" if i % 3 else f"s{i % 4}"
    tables = [(schema(i), f"t{i:03d}", vec(i)) for i in range(200)]
    questions = [(i, schema(i) if i % 10 else "unknown", vec(i + 1)) for i in range(60)]
    return tables, questions


def frames(spark, data):
    tables, questions = data
    registry = spark.createDataFrame(
        tables, "schema_name string, table_name string, embedding array<double>"
    )
    asked = spark.createDataFrame(
        questions, "question_id int, schema_name string, embedding array<double>"
    )
    return registry, asked


@pytest.mark.parametrize("k,block", [(5, 7), (3, 2048), (0, 50), (None, 1), (500, 16)])
def test_topk_is_exact(spark, data, k, block):
    tables, questions = data
    registry, asked = frames(spark, data)
    got = {}
    rows = retrieval.vector_topk(asked, registry, k, block).orderBy("question_id", "rank").collect()
    for r in rows:
        got.setdefault(r["question_id"], []).append(r["table_name"])
    for q in questions:
        assert got.get(q[0], []) == nearest(q, tables, k or 5), q


@pytest.mark.parametrize("k,block", [(5, 7), (3, 2048), (None, 1), (500, 16)])
def test_large_registries_give_the_same_rows(spark, data, k, block):
    tables, questions = data
    registry, asked = frames(spark, data)
    got = {}
    rows = retrieval.vector_topk(asked, registry, k, block, fit_bytes=0).orderBy("question_id", "rank").collect()
    for r in rows:
        got.setdefault(r["question_id"], []).append(r["table_name"])
    for q in questions:
        assert got.get(q[0], []) == nearest(q, tables, k or 5), q


def test_blocks_of_clusters_are_skipped(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16))
    vec = lambda: [float(x) for x in centres[rng.integers(30)] + 0.05 * rng.normal(size=16)]
    tables = spark.createDataFrame(
        [("one", f"t{i}", i, vec()) for i in range(3000)], "schema_name string, table_name string, row_key bigint, t_vec array<double>"
    )
    asked = spark.createDataFrame([(i, "one", vec()) for i in range(200)], "question_id int, schema_name string, q_vec array<double>")
    report = {}
    found = pivots.ranked(asked, tables, 5, 50, report)
    plain = retrieval._ranked_in_place(asked, tables, 5)
    rows = lambda df: sorted((r.question_id, r.rank, r.table_name) for r in df.collect())
    assert rows(found) == rows(plain) and len(rows(found)) == 1000
    print("visited", report)
    assert report["visited"] < 0.35 * report["pairs"]


def test_a_small_registry_needs_no_exchange(spark, data):
    registry, asked = frames(spark, data)
    ranked = retrieval.vector_topk(asked, registry)
    ranked.collect()
    assert "Exchange" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert retrieval.vector_topk(asked, registry.limit(0)).count() == 0
    assert retrieval.vector_topk(asked, registry.limit(0), fit_bytes=-1).count() == 0


def test_one_question(spark, data):
    registry, _ = frames(spark, data)
    vector = [1.0, -1.0, 0.5, 2.0]
    column = F.array(*[F.lit(x) for x in vector])
    rows = retrieval.retrieve_tables(registry, "hot", column, 9).collect()
    assert [r["table_name"] for r in rows] == nearest((0, "hot", vector), data[0], 9)


def test_unknown_schema(spark, data):
    registry, asked = frames(spark, data)
    missing = retrieval.schema_not_found(asked, registry)
    assert {r["question_id"] for r in missing.collect()} == {0, 10, 20, 30, 40, 50}


def test_distance_column(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0])],
                               "a array<double>, b array<double>")
    got = [r[0] for r in df.select(cosine_distance(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and math.isnan(got[1]) and got[2] is None


def test_embed_input(spark):
    df = spark.createDataFrame([("users who ordered",), ("average salary by team",), ("",)], "t string")
    vectors = [np.array(r["embedding"]) for r in embed_input(df, "t").collect()]
    assert all(v.shape == (384,) and v.min() >= -1 and v.max() <= 1 for v in vectors)
    assert not np.array_equal(vectors[0], vectors[1])
    assert np.linalg.norm(vectors[0]) == pytest.approx(1) and not vectors[2].any()


def test_answers_with_a_user_model(spark, data):
    registry, asked = frames(spark, data)
    registry = registry.withColumns({"ddl": F.lit("CREATE TABLE t ()"), "description": F.lit("")})
    asked = asked.withColumn("question", F.concat(F.lit("Q"), "question_id"))

    def generate(questions, prompts):
        return "Sure\n```sql\nSELECT '" + questions + "';\n```"

    got = answer_questions(asked, registry, generate).collect()
    assert len(got) == 54
    for r in got:
        assert r["sql"] == f"SELECT '{r['question']}'" and r["explanation"] == "Sure"
        assert r["question"] in r["prompt"] and "CREATE TABLE t ()" in r["prompt"]


def test_repeated_table_names_stay_apart(spark):
    registry = spark.createDataFrame(
        [("s", "t", "CREATE TABLE t (a)", [1.0, 0.0]), ("s", "t", "CREATE TABLE t (b)", [0.0, 1.0]),
         ("s", "u", "CREATE TABLE u ()", [-1.0, 0.0]), ("s", "u", "CREATE TABLE u ()", [-1.0, 0.0])],
        "schema_name string, table_name string, ddl string, embedding array<float>",
    )
    asked = spark.createDataFrame(
        [(1, "s", "q", [1.0, 0.1])],
        "question_id int, schema_name string, question string, embedding array<float>",
    )
    rows = sorted(retrieval_batch(asked, registry, 2).collect(), key=lambda r: r["rank"])
    assert [(r["rank"], r["ddl"]) for r in rows] == [(1, "CREATE TABLE t (a)"), (2, "CREATE TABLE t (b)")]
    assert rows[0]["distance"] < rows[1]["distance"]
    every = retrieval_batch(asked, registry, 4).collect()
    assert sorted(r["rank"] for r in every) == [1, 2, 3, 4]


def test_what_moves_grows_with_the_rows(spark, monkeypatch):
    """Rows read by the search of the rest: each question once, each table once for a group at most."""
    monkeypatch.setattr(pivots, "GROUPS", 4)
    rng = np.random.default_rng(5)
    moved = []
    read = pivots._read_groups

    def counted(*args):
        job, seen = read(*args), spark.sparkContext.accumulator(0)
        moved.append(seen)

        def outer(batches):
            def through():
                for batch in batches:
                    seen.add(len(batch))
                    yield batch

            yield from job(through())

        return outer

    monkeypatch.setattr(pivots, "_read_groups", counted)
    groups = max(4, spark.sparkContext.defaultParallelism)
    for n in (600, 1200):
        vec = lambda: [float(x) for x in rng.normal(size=24)]
        tables = spark.createDataFrame(
            [("one", f"t{i}", i, vec()) for i in range(n)], "schema_name string, table_name string, row_key bigint, t_vec array<double>"
        )
        asked = spark.createDataFrame([(i, "one", vec()) for i in range(n)], "question_id int, schema_name string, q_vec array<double>")
        rows = lambda df: sorted((r.question_id, r.rank, r.table_name) for r in df.collect())
        assert rows(pivots.ranked(asked, tables, 5, 20)) == rows(retrieval._ranked_in_place(asked, tables, 5))
        # Visits of single blocks would be about n * n / 20.
        assert n < moved[-1].value <= n + groups * n


def test_questions_near_one_pivot_are_cut_evenly():
    from pyspark.sql import Row

    import pandas as pd

    blocks = {"s": pd.DataFrame({"n": [10, 10]}), "u": pd.DataFrame({"n": [5]})}
    counts = [Row(schema_name="s", near=0, n=90), Row(schema_name="s", near=1, n=10), Row(schema_name="u", near=0, n=100),
              Row(schema_name="none", near=0, n=7)]
    slots = pivots._slots(counts, blocks, 1)
    assert [(r[0], r[1], r[4], r[5], r[6]) for r in slots] == [("s", 0, 0, 90, 100), ("s", 1, 90, 10, 100), ("u", 0, 0, 100, 100)]
    assert slots[0][3] > slots[2][3] >= 1 and slots[2][2] == slots[0][3]
    assert pivots._slots([], blocks, 1) == []
