import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusql.operators import corpus, planning, split, training
from corpusql.plans import flows
from corpusql.sources.corpus import read_corpus, split_ddl, write_corpus


def pairs(spark, n=300):
    schemas = ["ecommerce"] * 6 + ["fintech"] * 3 + ["hr_system"]
    rows = [
        (i, schemas[i % 10], "simple" if i % 7 else "complex", f"question {i}", f"SELECT {i}")
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "pair_id bigint, schema_name string, complexity string, question string, sql string"
    )


@pytest.mark.parametrize("test_size", [1, 7, 30, 100, 1000])
def test_split_sizes(spark, test_size):
    df = pairs(spark)
    got = split.stratified_split(df, test_size).collect()
    assert len(got) == 300 and len({r["pair_id"] for r in got}) == 300
    sizes = Counter((r["schema_name"], r["complexity"]) for r in got)
    asked = {k: max(1, round(n / 300 * test_size)) for k, n in sizes.items()}
    possible = {k: min(asked[k], sizes[k]) for k in sizes}
    test = Counter((r["schema_name"], r["complexity"]) for r in got if r["side"] == "test")
    assert sum(test.values()) == min(test_size, sum(possible.values()))
    if sum(possible.values()) <= test_size:
        assert test == Counter(possible)
    assert all(test[k] <= possible[k] for k in test)


def test_split_repeats_and_seeds(spark):
    df = pairs(spark)
    side = lambda d, **kw: {r["pair_id"] for r in split.stratified_split(d, 40, **kw).collect()
                            if r["side"] == "test"}
    assert side(df) == side(df.repartition(13))
    assert side(df) != side(df, seed=43)


def test_single_row_stratum_goes_to_test(spark):
    df = pairs(spark, 20).withColumn("schema_name", F.col("pair_id").cast("string"))
    sides = Counter(r["side"] for r in split.stratified_split(df, 100).collect())
    assert sides == {"test": 20}


def test_split_of_nothing(spark):
    assert split.stratified_split(pairs(spark).where("false")).collect() == []


def test_generation_plan(spark):
    existing = pairs(spark, 100)  # 60 ecommerce, 30 fintech, 10 hr_system
    plan = planning.generation_plan(existing, 250).collect()
    status = {r["schema_name"]: (r["status"], r["remaining"]) for r in plan}
    assert status == {
        "ecommerce": ("done", 0), "fintech": ("partial", 20), "hr_system": ("partial", 40),
        "healthcare": ("new", 50), "saas_analytics": ("new", 50),
    }
    for schema, (_, remaining) in status.items():
        got = {r["complexity"]: r["planned"] for r in plan if r["schema_name"] == schema}
        assert sum(got.values()) == remaining
        for c, (weight, _, _) in planning.COMPLEXITY_TARGETS.items():
            if c != "moderate":
                assert got[c] == int(remaining * weight)
    assert all(r["attempt_budget"] == 4 * r["remaining"] for r in plan)


def test_generation_prompts(spark):
    plan = planning.generation_plan(pairs(spark, 100), 250)
    schemas = spark.createDataFrame(
        [("fintech", " CREATE TABLE f () ", {"c": ["x", "y"]}), ("hr_system", "CREATE TABLE h ()", {})],
        "schema_name string, schema_ddl string, sample_values map<string,array<string>>",
    )
    got = planning.generation_prompts(plan, schemas, 5).collect()
    planned = {(r["schema_name"], r["complexity"]): r["planned"] for r in plan.collect()}
    for schema in ("fintech", "hr_system"):
        for complexity, (_, description, features) in planning.COMPLEXITY_TARGETS.items():
            batches = [r for r in got if (r["schema_name"], r["complexity"]) == (schema, complexity)]
            n = planned[schema, complexity]
            assert len(batches) == -(-n // 5)
            assert all(r["batch_size"] == min(5, n - 5 * (r["batch"] - 1) + 5) for r in batches)
            for r in batches:
                assert description in r["prompt"] and ", ".join(features) in r["prompt"]
                assert ("  - c: x, y" in r["prompt"]) == (schema == "fintech")
    assert {r["schema_name"] for r in got} == {"fintech", "hr_system"}


def test_funnel_order(spark):
    rows = [
        (1, "", "q", True), (2, "s", " ", True), (3, "SELECT strftime('x')", "q", False),
        (4, "SELECT 1", "q", False), (5, "SELECT 1", "q", None), (6, "SELECT 1", "q", True),
        (7, "SELECT 2", "q", True), (8, "SELECT 3", "q", True), (9, "SELECT 4", "q", False),
    ]
    df = spark.createDataFrame(rows, "pair_id bigint, sql string, question string, ran boolean")
    df = df.withColumn("schema_name", F.lit("ecommerce"))
    quotas = spark.createDataFrame([("ecommerce", 2)], "schema_name string, remaining bigint")
    got = {r["pair_id"]: r["reject_reason"]
           for r in corpus.reject_funnel(df, F.col("ran"), quotas).collect()}
    assert got == {1: "missing", 2: "missing", 3: "dialect", 4: "execution", 5: "execution",
                   6: None, 7: None, 8: "over_quota", 9: "execution"}


def test_profile_edges(spark):
    none = pairs(spark).where("false")
    assert corpus.feature_coverage(none).collect() == []
    assert corpus.distribution(none, "complexity", percent=True).collect() == []
    assert corpus.quality_issues(none).collect() == []
    one = spark.createDataFrame([(1, "", "", "simple")],
                                "pair_id bigint, sql string, question string, complexity string")
    assert [r["issue"] for r in corpus.quality_issues(one).collect()] == [
        "missing SQL", "missing question"]


def test_build_corpus(spark):
    def response(i):
        items = [{"question": f"q{i}", "sql": f"SELECT {i}"}, {"question": "", "sql": "SELECT 0"},
                 {"question": f"r{i}", "sql": f"SELECT {i} + 1"}]
        return (i, "fintech" if i % 2 else "ecommerce", "simple", json.dumps(items))

    responses = spark.createDataFrame(
        [response(i) for i in range(10)],
        "pair_id bigint, schema_name string, complexity string, response string",
    )
    existing = pairs(spark, 12)  # 8 ecommerce, 3 fintech, 1 hr_system
    new = flows.build_corpus(responses, existing, 40, F.lit(True)).collect()
    assert {r["schema_name"] for r in new} == {"fintech"}
    assert [r["question"] for r in sorted(new, key=lambda r: (r["pair_id"], r["item"]))] == [
        "q1", "r1", "q3", "r3", "q5"]


def test_corpus_round_trip(spark, tmp_path):
    path = str(tmp_path / "c")
    write_corpus(spark.sql("SELECT 'é\"\\n' AS question, CAST(NULL AS STRING) AS sql, "
                           "TIMESTAMP '2026-03-17 01:21:09' AS generated_at, 1.50BD AS n"), path)
    line = [x for x in spark.read.text(path).collect()][0]["value"]
    assert json.loads(line) == {"question": "é\"\n", "sql": None,
                                "generated_at": "2026-03-17 01:21:09", "n": "1.50"}
    assert read_corpus(spark, path).first()["question"] == "é\"\n"


def test_malformed_line_fails(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"sql": "a"}\n\n   \n{"sql": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        read_corpus(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "good.jsonl").write_text('{"sql": "a"}\n\n   \n{"sql": "b"}\n')
    assert read_corpus(spark, str(tmp_path / "good.jsonl")).count() == 2


def test_split_ddl(spark):
    df = spark.createDataFrame([(1, " a ;\n; b;"), (2, "")], "id int, ddl string")
    assert [(r["id"], r["statement"]) for r in split_ddl(df).orderBy("id", "position").collect()] == [
        (1, "a"), (1, "b")]


@pytest.mark.parametrize("ddl_words,sql_words", [(5, 4), (480, 60), (600, 3), (0, 0), (503, 1)])
def test_training_closed_form(spark, ddl_words, sql_words):
    df = spark.createDataFrame(
        [(" ".join(["d"] * ddl_words), "q", " ".join(f"s{i}" for i in range(sql_words)))],
        "schema_ddl string, question string, sql string",
    )
    counts = training.training_counts(df).first()
    record = training.training_records(df).first()
    assert len(record["input_ids"]) == len(record["attention_mask"]) == len(record["labels"]) == 512
    trained = [x for x in record["labels"] if x != -100]
    assert (len(trained), 512 - len(trained)) == (counts["n_train"], counts["n_masked"])
    assert sum(record["attention_mask"]) == min(512, counts["full_tokens"])
    assert counts["dead"] == (not trained)
    assert counts["truncated"] == (counts["full_tokens"] > 512)
    for i, label in enumerate(record["labels"]):
        if label != -100:
            assert label == record["input_ids"][i] and record["attention_mask"][i] == 1
    assert counts["prompt_tokens"] == ddl_words + 1 + 3 * 5
