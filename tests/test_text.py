import json

import pytest
from pyspark.sql import functions as F

from corpusql.functions import prompts, text
from corpusql.operators import corpus


def column(spark, rows, expr, schema="s string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r["x"] for r in df.select("i", expr(F.col("s")).alias("x")).orderBy("i").collect()]


def test_syntax(spark):
    cases = [
        "SELECT COUNT(*) FROM users WHERE created_at > NOW() - INTERVAL '1 month'",
        "\n WITH m AS (\n SELECT user_id FROM orders) SELECT * FROM m",
        "", "   ", " \n\t", ";", ";;;", " ; ;", " ;", "a", None,
    ]
    want = [bool(c is not None and c.rstrip(";").strip()) for c in cases]
    assert column(spark, cases, text.is_valid_syntax) == want
    errors = column(spark, ["SELECT 1", "", "  ", ";"], text.executor_syntax_error)
    assert errors == [None, "Empty or unparseable SQL", "Empty or unparseable SQL", None]


def test_white_space_is_pythons(spark):
    import sys

    blanks = "".join(c for c in map(chr, range(sys.maxunicode)) if c.isspace())
    assert set(text.WHITE_SPACE) == set(blanks)
    assert column(spark, [blanks, f"{blanks}x"], text.is_missing) == [True, False]
    assert column(spark, [f"{blanks}a b{blanks}"], text.strip_ws) == ["a b"]


def test_sanitize(spark):
    cases = {
        "  SELECT * FROM users  ": "SELECT * FROM users",
        "SELECT * FROM users;": "SELECT * FROM users",
        "```sql\nSELECT * FROM users\n```": "SELECT * FROM users",
        "```\nSELECT * FROM users\n```": "SELECT * FROM users",
        "```sql\nSELECT 1;;\n  ``` \n": "SELECT 1",
        "```sql SELECT 1```": "",
        "```": "",
        "```\n```": "",
        "```sql\nSELECT 1": "SELECT 1",
        "SELECT 1 ;\n;": "SELECT 1 ;",
    }
    assert column(spark, list(cases), text.sanitize_sql) == list(cases.values())


def test_extract(spark):
    cases = [
        ("Steps.\n```sql\nSELECT 1;\n```\nDone", ("SELECT 1;", "Steps.")),
        ("```SQL a ``` then ```sql b ```", ("a", "")),
        ("x ```sql   ```", ("", "x")),
        ("Here:\nselect a\nfrom t", ("select a\nfrom t", "Here:\nselect a\nfrom t")),
        ("one\nwork with it\nmore", ("work with it\nmore", "one\nwork with it\nmore")),
        ("  selection without  ", ("selection without", "")),
        ("x\nSELECTED\nnothing_with_", ("x\nSELECTED\nnothing_with_", "")),
        ("a\nDELETE", ("DELETE", "a\nDELETE")),
        ("```sql SELECT 1", ("```sql SELECT 1", "```sql SELECT 1")),
    ]
    got = column(spark, [c for c, _ in cases], text.extract_sql)
    assert [(g["sql"], g["explanation"]) for g in got] == [w for _, w in cases]


def test_dialect_and_limit(spark):
    foreign = ["strftime ('%Y')", "x = DATETIME( 'now')", 'date("now")', "julianday(d)",
               "pg_typeof(x)", "jsonb_typeof (y)"]
    fine = ["SELECT date_trunc('day', d)", "datetime(x)", "strftimes", ""]
    assert column(spark, foreign + fine, text.is_target_dialect) == [False] * 6 + [True] * 4
    guarded = {
        "select a from t;": "select a from t LIMIT 7",
        "  SELECT 1": "  SELECT 1 LIMIT 7",
        "SELECT limits FROM t": "SELECT limits FROM t",
        "WITH x AS (SELECT 1) SELECT * FROM x": "WITH x AS (SELECT 1) SELECT * FROM x",
        ";": "",
    }
    assert column(spark, list(guarded), lambda c: text.limit_guard(c, 7)) == list(guarded.values())


def test_features_need_their_blanks(spark):
    cases = {
        "WITH t AS (SELECT 1) SELECT * FROM t": [],
        "SELECT * FROM ( WITH t AS (SELECT 1) SELECT 1) x": ["CTE"],
        "select count(*) filter (where a) from t": ["FILTER"],
        "select a->>'b', coalesce(x, nullif(y, 1)) from t": ["JSONB", "COALESCE", "NULLIF"],
    }
    assert column(spark, list(cases), text.feature_flags) == list(cases.values())


def test_router(spark):
    cases = {"How MANY?": "aggregate", "List accounts": "aggregate", "show it": "list",
             "Get all": "list", "average": "default", "": "default"}
    assert column(spark, list(cases), text.route_question) == list(cases.values())


def test_parse_batch(spark):
    pairs = [{"question": " q ", "sql": "SELECT 1"}, {"chain_of_thought": "c", "sql": None}]
    rows = [
        (1, f"Sure:\n```json\n{json.dumps(pairs)}\n```"),
        (2, "```\n[]\n```"),
        (3, "nothing here"),
        (4, "[{broken"),
        (5, "[{broken}]"),
        (6, json.dumps(pairs)),
    ]
    df = spark.createDataFrame(rows, "id int, response string")
    got = {}
    for r in corpus.parse_batch(df).collect():
        got.setdefault(r["id"], []).append((r["parse_error"], r["question"], r["sql"]))
    assert sorted(got[1]) == [(None, "", ""), (None, "q", "SELECT 1")] == sorted(got[6])
    assert got[3][0][0] == got[4][0][0] == "No JSON array found in response"
    assert got[5][0][0] == "Malformed JSON array in response"


def test_table_text_and_prompt(spark):
    rows = [
        ("orders", "CREATE TABLE orders (id SERIAL PRIMARY KEY)", "Customer orders",
         {"tier": ["a", "b", "c", "d", "e", "f"], "none": []}, 2),
        ("users", "  CREATE TABLE users (id SERIAL PRIMARY KEY)\n", None, None, 1),
        ("empty", "CREATE TABLE empty ()", "", {}, 3),
    ]
    df = spark.createDataFrame(
        rows, "name string, ddl string, description string, s map<string,array<string>>, rank int"
    )
    shown = {
        r["name"]: r
        for r in df.select(
            "name",
            prompts.table_text(F.col("name"), F.col("description"), F.col("ddl")).alias("t"),
            prompts.enrich_ddl(F.col("ddl"), F.col("description"), F.col("s")).alias("d"),
        ).collect()
    }
    assert shown["orders"]["t"] == f"Table: orders\nDescription: Customer orders\n{rows[0][1]}"
    assert shown["users"]["t"] == f"Table: users\n{rows[1][1]}"
    assert shown["orders"]["d"] == (
        f"-- Customer orders\n{rows[0][1]}\n-- tier sample values: a, b, c, d, e\n"
        "-- none sample values: "
    )
    assert shown["users"]["d"] == rows[1][1].strip()
    assert shown["empty"]["d"] == rows[2][1]

    ranked = df.select(
        F.lit(1).alias("question_id"), F.lit("s").alias("schema_name"),
        F.lit("How many {schema} users?").alias("question"), "rank",
        prompts.enrich_ddl(F.col("ddl"), F.col("description"), F.col("s")).alias("table_ddl"),
    )
    prompt = prompts.build_prompts(ranked).first()["prompt"]
    for part in ("POSTGRESQL", "DATE_TRUNC", "ILIKE", "How many {schema} users?"):
        assert part in prompt
    at = [prompt.index(f"CREATE TABLE {n}") for n in ("users", "orders", "empty")]
    assert at == sorted(at)


def test_correction_prompt(spark):
    df = spark.createDataFrame([("p", "SELECT COUN(*)", "no coun")], "p string, s string, e string")
    got = df.select(prompts.correction_prompt(F.col("p"), F.col("s"), F.col("e")).alias("x")).first()
    for part in ("SELECT COUN(*)", "no coun", "POSTGRESQL", "corrected"):
        assert part in got["x"]
    assert "\np\n" in got["x"]


@pytest.mark.parametrize("template", ["{a}", "x{a}y{b}z", "{a}{b}", "none", "{c}"])
def test_fill(spark, template):
    df = spark.createDataFrame([("A{b}", None)], "a string, b string")
    got = df.select(prompts.fill(template, a=F.col("a"), b=F.col("b")).alias("x")).first()["x"]
    want = "".join(
        {"{a}": "A{b}", "{b}": ""}.get(p, p)
        for p in __import__("re").split(r"(\{a\}|\{b\})", template)
    )
    assert got == want
