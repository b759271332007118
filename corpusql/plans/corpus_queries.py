"""Named queries over the question/SQL corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.functions import prompts, text
from corpusql.functions.hooks import batch_embed, batch_generate
from corpusql.functions.vectors import dot, embed_input
from corpusql.operators import corpus, planning, split, training
from corpusql.plans.registry import named
from corpusql.plans.views import Inputs
from corpusql.sources.corpus import publish_evaluation, read_corpus, split_ddl, write_corpus
from corpusql.sources.versions import VersionedTable
from corpusql.sources.workspace import fresh_path

PAIR_COLUMNS = "pair_id, schema_name, complexity, question, chain_of_thought, sql, generated_at"
PAIR_SCHEMA = (
    "pair_id bigint, schema_name string, complexity string, question string, "
    "chain_of_thought string, sql string, generated_at timestamp_ntz"
)

# A synthesis run makes one schema after the other: the first is finished, the
# second was interrupted, the others are still to come.
EXISTING = (
    "schema_name = 'ecommerce' OR "
    "(schema_name = 'saas_analytics' AND generated_at < TIMESTAMP '1998-01-01 00:00:00')"
)
RESUME_TOTAL = 15_000
QUOTA_TOTAL = 10_000

# --- oracle fragments: the column rules again, in DuckDB's words --------------

_STRIP = "trim({}, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(160))"
_SQL_TRIM = _STRIP.format("sql")
_QUESTION_TRIM = _STRIP.format("question")
_MISSING = f"(length({_SQL_TRIM}) = 0 OR length({_QUESTION_TRIM}) = 0)"
_VALID = f"(length({_STRIP.format('rtrim(sql, chr(59))')}) > 0)"
_FOREIGN = (
    r"""regexp_matches(lower(sql), 'strftime\s*\(|datetime\s*\(\s*[''"]now|"""
    r"""date\s*\(\s*[''"]now|julianday\s*\(|typeof\s*\(')"""
)
_ACCEPTED = f"(NOT {_MISSING} AND {_VALID} AND NOT {_FOREIGN})"
_RAN = "(chain_of_thought <> '')"
_FEATURE_ROWS = ", ".join(
    f"('{name}', '{pattern}')" for name, pattern in text.SQL_FEATURES.items()
)
_QUOTAS = f"""
  quotas AS (
    SELECT s.schema_name, greatest({{total}} // 5 - coalesce(h.have, 0), 0) AS remaining,
           coalesce(h.have, 0) AS have
    FROM (SELECT unnest(['ecommerce', 'saas_analytics', 'healthcare', 'fintech', 'hr_system'])
          AS schema_name) s
    LEFT JOIN (SELECT schema_name, count(*) AS have FROM v_pairs WHERE {EXISTING} GROUP BY 1) h
      USING (schema_name))"""


def _existing(t: Inputs) -> DataFrame:
    return t("v_pairs").where(EXISTING)


def _new(t: Inputs) -> DataFrame:
    return t("v_pairs").where(f"NOT ({EXISTING})")


def _accepted():
    sql, question = F.col("sql"), F.col("question")
    return (
        ~text.is_missing(sql)
        & ~text.is_missing(question)
        & text.is_valid_syntax(sql)
        & text.is_target_dialect(sql)
    )


# --- sources and sinks --------------------------------------------------------


@named("write_corpus", f"SELECT {PAIR_COLUMNS} FROM v_pairs")
def _(t: Inputs) -> DataFrame:
    path = fresh_path(t.spark, "corpus")
    write_corpus(t("v_pairs"), path)
    return read_corpus(t.spark, path, PAIR_SCHEMA)


@named(
    "read_corpus",
    "SELECT schema_name, complexity, count(*) AS n, count(*) FILTER (WHERE sql = '') AS empty_sql,"
    " CAST(sum(length(question)) AS BIGINT) AS question_chars FROM v_pairs GROUP BY 1, 2",
)
def _(t: Inputs) -> DataFrame:
    # Lines of a corpus as another tool writes them: blank lines in between.
    lines = t("v_pairs").select(
        F.explode(
            F.array(F.to_json(F.struct("schema_name", "complexity", "question", "sql")), F.lit(""))
        ).alias("value")
    )
    path = fresh_path(t.spark, "lines")
    lines.write.text(path)
    schema = "schema_name string, complexity string, question string, sql string"
    return read_corpus(t.spark, path, schema).groupBy("schema_name", "complexity").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("sql") == "", 1)).alias("empty_sql"),
        F.sum(F.length("question")).alias("question_chars"),
    )


@named(
    "resume_append",
    "WITH " + _QUOTAS.format(total=RESUME_TOTAL) + f"""
    SELECT pair_id, schema_name, 'existing' AS origin FROM v_pairs WHERE {EXISTING}
    UNION ALL
    SELECT p.pair_id, p.schema_name, 'new' AS origin FROM v_pairs p
    JOIN quotas q ON q.schema_name = p.schema_name AND q.have < {RESUME_TOTAL} // 5
    WHERE NOT ({EXISTING.replace('schema_name', 'p.schema_name')})""",
)
def _(t: Inputs) -> DataFrame:
    corpus = VersionedTable(t.spark, fresh_path(t.spark, "resume"))
    columns = ["pair_id", "schema_name", "origin"]
    corpus.append(_existing(t).withColumn("origin", F.lit("existing")).select(*columns), "first run")
    for _ in range(2):  # a run that is repeated adds nothing
        new = planning.resume_append(_existing(t), _new(t), RESUME_TOTAL)
        corpus.append(new.withColumn("origin", F.lit("new")).select(*columns), "second run")
    return corpus.read()


@named(
    "split_ddl",
    r"""SELECT vec_id, position, statement FROM (
      SELECT vec_id, i - 1 AS position, trim(parts[i], ' ' || chr(10) || chr(9)) AS statement
      FROM (SELECT vec_id, string_split(ddl, ';') AS parts FROM v_registry),
           unnest(generate_series(1, len(parts))) AS u(i))
    WHERE statement <> ''""",
)
def _(t: Inputs) -> DataFrame:
    return split_ddl(t("v_registry").select("vec_id", "ddl"))


@named(
    "eval_sink",
    "SELECT 'nightly' AS run_name, schema_name, count(*) AS n, count(error) AS errors, "
    "round(sum(bleu), 3) AS bleu FROM v_eval GROUP BY 2",
)
def _(t: Inputs) -> DataFrame:
    table = VersionedTable(t.spark, fresh_path(t.spark, "evaluations"), "json", ignoreNullFields="false")
    for _ in range(2):  # a run that is repeated adds nothing
        publish_evaluation(table, t("v_eval"), "nightly")
    return (
        table.read()
        .groupBy("run_name", "schema_name")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("error").alias("errors"),
            F.round(F.sum("bleu"), 3).alias("bleu"),
        )
    )


# --- filters ------------------------------------------------------------------


@named("filter_missing", f"SELECT pair_id FROM v_pairs WHERE NOT {_MISSING}")
def _(t: Inputs) -> DataFrame:
    return corpus.filter_missing(t("v_pairs")).select("pair_id")


@named("filter_syntax", f"SELECT pair_id FROM v_pairs WHERE {_VALID}")
def _(t: Inputs) -> DataFrame:
    return corpus.filter_syntax(t("v_pairs")).select("pair_id")


@named(
    "filter_syntax_exec",
    """SELECT pair_id, variant, syntax_error IS NULL AS is_valid, syntax_error FROM (
      SELECT pair_id, variant,
        CASE WHEN trim(q) = '' THEN 'Empty or unparseable SQL' END AS syntax_error
      FROM (SELECT pair_id, 'as_is' AS variant, sql AS q FROM v_pairs
            UNION ALL SELECT pair_id, 'semicolon', sql || ';' FROM v_pairs))""",
)
def _(t: Inputs) -> DataFrame:
    sql = F.col("sql")
    variants = F.array(
        F.struct(F.lit("as_is").alias("variant"), sql.alias("q")),
        F.struct(F.lit("semicolon").alias("variant"), F.concat(sql, F.lit(";")).alias("q")),
    )
    checked = t("v_pairs").select("pair_id", F.inline(variants))
    error = text.executor_syntax_error(F.col("q"))
    return checked.select(
        "pair_id", "variant", error.isNull().alias("is_valid"), error.alias("syntax_error")
    )


@named("filter_dialect", f"SELECT pair_id FROM v_pairs WHERE NOT {_FOREIGN}")
def _(t: Inputs) -> DataFrame:
    return corpus.filter_dialect(t("v_pairs")).select("pair_id")


_JUDGED = f"""
  judged AS (
    SELECT *, CASE WHEN {_MISSING} THEN 'missing' WHEN NOT {_VALID} THEN 'syntax'
      WHEN {_FOREIGN} THEN 'dialect' WHEN NOT {_RAN} THEN 'execution' END AS stage
    FROM v_pairs)"""


def _funnel(t: Inputs) -> DataFrame:
    quotas = planning.schema_status(_existing(t), QUOTA_TOTAL)
    return corpus.reject_funnel(t("v_pairs"), F.col("chain_of_thought") != "", quotas)


_FUNNEL = "WITH " + _QUOTAS.format(total=QUOTA_TOTAL) + "," + _JUDGED + """
  , placed AS (
    SELECT j.*, row_number() OVER (PARTITION BY j.schema_name, stage ORDER BY pair_id) AS rn
    FROM judged j),
  reasons AS (
    SELECT p.pair_id, CASE WHEN stage IS NOT NULL THEN stage
      WHEN rn > q.remaining THEN 'over_quota' END AS reject_reason
    FROM placed p JOIN quotas q USING (schema_name))
"""


@named("reject_funnel", _FUNNEL + "SELECT pair_id, reject_reason FROM reasons")
def _(t: Inputs) -> DataFrame:
    return _funnel(t).select("pair_id", "reject_reason")


@named(
    "reject_funnel_counts",
    _FUNNEL + "SELECT coalesce(reject_reason, 'accepted') AS reject_reason, count(*) AS n "
    "FROM reasons GROUP BY 1",
)
def _(t: Inputs) -> DataFrame:
    return corpus.funnel_counts(_funnel(t))


@named(
    "limit_guard",
    """SELECT pair_id, CASE WHEN starts_with(upper(trim(body)), 'SELECT')
        AND NOT contains(upper(body), 'LIMIT') THEN body || ' LIMIT 100' ELSE body END AS guarded
    FROM (SELECT pair_id, rtrim(sql, ';') AS body FROM v_pairs)""",
)
def _(t: Inputs) -> DataFrame:
    return t("v_pairs").select("pair_id", text.limit_guard(F.col("sql"), 100).alias("guarded"))


# --- profile ------------------------------------------------------------------


@named(
    "dist_complexity",
    """SELECT complexity, count(*) AS n,
      round(count(*) * 100 / (SELECT count(*) FROM v_pairs), 1) AS percent
    FROM v_pairs GROUP BY 1""",
)
def _(t: Inputs) -> DataFrame:
    return corpus.distribution(t("v_pairs"), "complexity", percent=True)


@named("dist_schema", "SELECT schema_name, count(*) AS n FROM v_pairs GROUP BY 1")
def _(t: Inputs) -> DataFrame:
    return corpus.distribution(t("v_pairs"), "schema_name")


@named(
    "feature_coverage",
    f"""SELECT feature, count(*) AS n,
      round(count(*) * 100 / (SELECT count(*) FROM v_pairs), 1) AS percent
    FROM v_pairs JOIN (VALUES {_FEATURE_ROWS}) f(feature, pattern)
      ON contains(upper(sql), pattern)
    GROUP BY 1""",
)
def _(t: Inputs) -> DataFrame:
    return corpus.feature_coverage(t("v_pairs"))


@named(
    "feature_flags",
    "SELECT pair_id, concat_ws(',', "
    + ", ".join(
        f"CASE WHEN contains(upper(sql), '{p}') THEN '{f}' END"
        for f, p in text.SQL_FEATURES.items()
    )
    + ") AS features FROM v_pairs",
)
def _(t: Inputs) -> DataFrame:
    flags = text.feature_flags(F.col("sql"))
    return t("v_pairs").select("pair_id", F.array_join(flags, ",").alias("features"))


@named(
    "sample_per_complexity",
    """SELECT pair_id, complexity, schema_name, question, sql FROM v_pairs
    QUALIFY row_number() OVER (PARTITION BY complexity ORDER BY pair_id) = 1""",
)
def _(t: Inputs) -> DataFrame:
    columns = ["pair_id", "complexity", "schema_name", "question", "sql"]
    return corpus.sample_per_complexity(t("v_pairs").select(*columns))


_ISSUES = """
  WITH issues AS (
    SELECT pair_id, 1 AS k, 'missing SQL' AS issue FROM v_pairs WHERE sql = ''
    UNION ALL SELECT pair_id, 2, 'missing question' FROM v_pairs WHERE question = ''
    UNION ALL SELECT pair_id, 3, 'SQLite syntax detected (strftime)' FROM v_pairs
      WHERE contains(lower(sql), 'strftime'))
"""


@named("quality_issues", _ISSUES + "SELECT pair_id, issue FROM issues")
def _(t: Inputs) -> DataFrame:
    return corpus.quality_issues(t("v_pairs"))


@named(
    "quality_issues_shown",
    _ISSUES + """SELECT pair_id, issue, (SELECT count(*) FROM issues) AS total
    FROM issues ORDER BY pair_id, k LIMIT 10""",
)
def _(t: Inputs) -> DataFrame:
    return corpus.first_issues(corpus.quality_issues(t("v_pairs")))


@named(
    "success_rate",
    f"""SELECT schema_name, count(*) AS attempts, count(*) FILTER (WHERE {_ACCEPTED}) AS validated,
      round(count(*) FILTER (WHERE {_ACCEPTED}) * 100 / greatest(count(*), 1), 1) AS success_rate
    FROM v_pairs GROUP BY 1""",
)
def _(t: Inputs) -> DataFrame:
    return corpus.success_rate(t("v_pairs"), _accepted())


# --- planning and split -------------------------------------------------------


@named(
    "generation_plan",
    "WITH " + _QUOTAS.format(total=RESUME_TOTAL) + f"""
    , weights(complexity, weight) AS (VALUES ('simple', 0.25::DOUBLE), ('moderate', 0.35::DOUBLE),
        ('complex', 0.25::DOUBLE), ('highly_complex', 0.15::DOUBLE)),
    cut AS (SELECT *, CAST(trunc(remaining * weight) AS BIGINT) AS p FROM quotas, weights)
    SELECT schema_name, CASE WHEN have >= {RESUME_TOTAL} // 5 THEN 'done'
        WHEN have > 0 THEN 'partial' ELSE 'new' END AS status, have, remaining,
      remaining * 4 AS attempt_budget, complexity,
      CAST(CASE WHEN complexity = 'moderate'
        THEN p + remaining - sum(p) OVER (PARTITION BY schema_name) ELSE p END AS BIGINT) AS planned
    FROM cut""",
)
def _(t: Inputs) -> DataFrame:
    return planning.generation_plan(_existing(t), RESUME_TOTAL)


@named(
    "quota_take",
    "WITH " + _QUOTAS.format(total=QUOTA_TOTAL) + f""", ok AS (
      SELECT pair_id, schema_name, row_number() OVER (PARTITION BY schema_name ORDER BY pair_id) rn
      FROM v_pairs WHERE {_ACCEPTED})
    SELECT pair_id, schema_name FROM ok JOIN quotas USING (schema_name) WHERE rn <= remaining""",
)
def _(t: Inputs) -> DataFrame:
    valid = t("v_pairs").where(_accepted()).select("pair_id", "schema_name")
    return corpus.quota_take(valid, planning.schema_status(_existing(t), QUOTA_TOTAL))


def _split_oracle(table: str, id_col: str, strata: str, size: int, tail: str) -> str:
    return f"""WITH
    strata AS (SELECT {strata}, count(*) AS n, greatest(1,
        round_even(count(*) / (SELECT count(*) FROM {table}) * {size}, 0)) AS n_test
      FROM {table} GROUP BY {strata}),
    picked AS (SELECT * FROM (
        SELECT {id_col}, {strata}, row_number() OVER (PARTITION BY {strata}
          ORDER BY md5('42|' || {id_col}), {id_col}) AS rn FROM {table})
      JOIN strata USING ({strata}) WHERE rn <= n_test),
    members AS (SELECT {id_col} FROM picked
      ORDER BY md5('42|trim|' || {id_col}), {id_col} LIMIT {size}),
    split AS (SELECT p.{id_col}, {strata},
        CASE WHEN m.{id_col} IS NULL THEN 'train' ELSE 'test' END AS side
      FROM {table} p LEFT JOIN members m USING ({id_col}))
    {tail}"""


def _register_split(suffix: str, table: str, id_col: str, strata: list[str], size: int) -> None:
    oracle = _split_oracle(
        table, id_col, ", ".join(strata), size, f"SELECT {id_col}, side FROM split"
    )

    @named(f"stratified_split{suffix}", oracle)
    def _(t: Inputs) -> DataFrame:
        rows = t(table).select(id_col, *strata)
        return split.stratified_split(rows, size, 42, strata, id_col).select(id_col, "side")


_register_split("", "v_pairs", "pair_id", split.STRATA, 200)
_register_split("_50", "v_pairs", "pair_id", split.STRATA, 50)
_register_split("_190", "v_pairs", "pair_id", split.STRATA, 190)
_register_split("_documents", "documents", "doc_id", ["lang", "source"], 100)


@named(
    "split_report",
    _split_oracle(
        "v_pairs", "pair_id", "schema_name, complexity", 200,
        """SELECT side, 'schema_name' AS grouped_by, schema_name AS value, count(*) AS n
        FROM split GROUP BY ALL
        UNION ALL SELECT side, 'complexity', complexity, count(*) FROM split GROUP BY ALL""",
    ),
)
def _(t: Inputs) -> DataFrame:
    rows = t("v_pairs").select("pair_id", *split.STRATA)
    return split.split_report(split.stratified_split(rows))


@named(
    "split_union",
    _split_oracle(
        "v_pairs", "pair_id", "schema_name, complexity", 190,
        "SELECT pair_id, question, sql FROM split JOIN v_pairs USING (pair_id) "
        "WHERE side = 'train'",
    ),
)
def _(t: Inputs) -> DataFrame:
    pairs = t("v_pairs").select("pair_id", *split.STRATA, "question", "sql")
    train = split.train_side(split.stratified_split(pairs, 190))
    return train.select("pair_id", "question", "sql")


# Per schema the order states seen in the corpus; a schema has a handful of them.
_SCHEMA_DOCS = """SELECT schema_name, ' CREATE TABLE ' || schema_name || ' (id INTEGER); '
    AS schema_ddl, CASE WHEN chain_of_thought = '' THEN 'silent' ELSE 'reasoned' END AS v
  FROM v_pairs"""


def template_oracle(template: str, **values: str) -> str:
    """A prompt template as a DuckDB expression."""
    out = "'" + template.replace("'", "''") + "'"
    for name, value in values.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


_TARGET_ROWS = ", ".join(
    "('{}', '{}', '{}')".format(name, description, ", ".join(features))
    for name, (_, description, features) in planning.COMPLEXITY_TARGETS.items()
)


@named(
    "generation_prompt",
    "WITH " + _QUOTAS.format(total=RESUME_TOTAL) + f"""
    , targets(complexity, weight, description, features) AS (SELECT col0, w, col1, col2 FROM
        (VALUES {_TARGET_ROWS}) t JOIN (VALUES ('simple', 0.25::DOUBLE), ('moderate', 0.35::DOUBLE),
        ('complex', 0.25::DOUBLE), ('highly_complex', 0.15::DOUBLE)) x(n, w) ON n = col0),
    cut AS (SELECT *, CAST(trunc(remaining * weight) AS BIGINT) AS p FROM quotas, targets),
    plan AS (SELECT *, CAST(CASE WHEN complexity = 'moderate' THEN p + remaining
        - sum(p) OVER (PARTITION BY schema_name) ELSE p END AS BIGINT) AS planned FROM cut),
    docs AS (SELECT schema_name, schema_ddl, string_agg(DISTINCT v, ', ' ORDER BY v) AS vs
      FROM ({_SCHEMA_DOCS}) GROUP BY ALL),
    batches AS (SELECT *, unnest(range(1, CAST(ceil(planned / 10) AS INT) + 1)) AS b FROM plan),
    sized AS (SELECT *, CAST(b AS INT) AS batch,
        CAST(least(10, planned - (b - 1) * 10 + 5) AS INT) AS batch_size FROM batches)
    SELECT schema_name, complexity, batch, batch_size, """
    + template_oracle(
        prompts.GENERATION_TEMPLATE, schema="trim(schema_ddl)", samples="'  - style: ' || vs",
        batch_size="batch_size", complexity="complexity", description="description",
        features="features",
    )
    + " AS prompt FROM sized JOIN docs USING (schema_name)",
)
def _(t: Inputs) -> DataFrame:
    t("v_pairs").createOrReplaceTempView("v_pairs")
    styles = F.array_sort(F.collect_set("v"))
    docs = t.spark.sql(_SCHEMA_DOCS).groupBy("schema_name", "schema_ddl").agg(
        F.create_map(F.lit("style"), styles).alias("sample_values")
    )
    plan = planning.generation_plan(_existing(t), RESUME_TOTAL)
    return planning.generation_prompts(plan, docs)


# --- responses and questions --------------------------------------------------


@named(
    "parse_batch",
    r"""WITH texts AS (
      SELECT pair_id, regexp_extract(CASE
        WHEN contains(response, '```json') THEN
          regexp_replace(regexp_replace(response, '```json\s*', '', 'g'), '(?m)```\s*$', '', 'g')
        WHEN contains(response, '```') THEN
          regexp_replace(regexp_replace(response, '```[\p{L}\p{N}_]*\s*', '', 'g'),
                         '(?m)```\s*$', '', 'g')
        ELSE response END, '(?s)\[.*\]', 0) AS j FROM v_responses),
    items AS (
      SELECT pair_id, i AS item, p FROM (
        SELECT pair_id, CASE WHEN json_valid(j) THEN
          from_json(j, '[{"question":"VARCHAR","chain_of_thought":"VARCHAR","sql":"VARCHAR"}]')
          END AS ps FROM texts WHERE j <> '') x,
        LATERAL (SELECT unnest(ps) AS p, unnest(range(len(ps))) AS i) u)
    SELECT t.pair_id, CASE WHEN j = '' THEN 'No JSON array found in response'
        WHEN item IS NULL THEN 'Malformed JSON array in response' END AS parse_error,
      CAST(item AS INT) AS item, coalesce(trim(p.question), '') AS question,
      coalesce(trim(p.chain_of_thought), '') AS chain_of_thought,
      coalesce(trim(p.sql), '') AS sql
    FROM texts t LEFT JOIN items USING (pair_id)""",
)
def _(t: Inputs) -> DataFrame:
    return corpus.parse_batch(t("v_responses"))


_EXTRACTED = r"""
  WITH cut AS (
    SELECT pair_id, response,
      regexp_matches(response, '(?is)```sql\s*(.*?)\s*```') AS fenced,
      regexp_extract(response, '(?is)```sql\s*(.*?)\s*```', 1) AS block,
      regexp_extract(response, '(?is)\A(.*?)```sql', 1) AS lead,
      list_filter(range(1, len(string_split(response, chr(10))) + 1), lambda i: regexp_matches(
        string_split(response, chr(10))[i],
        '(?i)\b(SELECT|INSERT|UPDATE|DELETE|WITH|CREATE)\b'))[1] AS first_line
    FROM v_responses),
  extracted AS (
    SELECT pair_id, response,
      CASE WHEN fenced THEN trim(block, ' ' || chr(10))
        WHEN first_line IS NOT NULL THEN trim(array_to_string(
          string_split(response, chr(10))[first_line:], chr(10)), ' ' || chr(10))
        ELSE trim(response, ' ' || chr(10)) END AS sql,
      CASE WHEN fenced THEN trim(lead, ' ' || chr(10))
        WHEN first_line IS NOT NULL THEN response ELSE '' END AS explanation
    FROM cut)
"""


@named("extract_sql", _EXTRACTED + "SELECT pair_id, sql, explanation FROM extracted")
def _(t: Inputs) -> DataFrame:
    found = t("v_responses").select("pair_id", text.extract_sql(F.col("response")).alias("x"))
    return found.select("pair_id", "x.sql", "x.explanation")


@named(
    "sanitize_sql",
    r"""WITH texts AS (SELECT pair_id, trim(response, ' ' || chr(10)) AS s FROM v_responses),
    lines AS (SELECT *, string_split(s, chr(10)) AS l FROM texts)
    SELECT pair_id, trim(rtrim(CASE WHEN NOT starts_with(s, '```') THEN s
      WHEN trim(l[-1]) = '```' THEN array_to_string(l[2:len(l) - 1], chr(10))
      ELSE array_to_string(l[2:], chr(10)) END, ';'), ' ' || chr(10)) AS sql FROM lines""",
)
def _(t: Inputs) -> DataFrame:
    return t("v_responses").select("pair_id", text.sanitize_sql(F.col("response")).alias("sql"))


_ROUTED = """
  WITH routed AS (
    SELECT pair_id, question, CASE
      WHEN regexp_matches(lower(question), 'how many|count|total number') THEN 'aggregate'
      WHEN regexp_matches(lower(question), 'list|show|get all|find all') THEN 'list'
      ELSE 'default' END AS template FROM v_pairs),
  templates(template, template_sql) AS (VALUES """ + ", ".join(
    "('{}', '{}')".format(name, sql.replace("'", "''")) for name, sql in text.TEMPLATE_SQL.items()
) + ")\n"


@named(
    "route_question",
    _ROUTED + "SELECT pair_id, template, template_sql AS sql FROM routed JOIN templates "
    "USING (template)",
)
def _(t: Inputs) -> DataFrame:
    routed = t("v_pairs").select("pair_id", text.route_question(F.col("question")).alias("template"))
    return routed.withColumn("sql", text.template_sql(F.col("template")))


@named(
    "batch_generate",
    _ROUTED + "SELECT pair_id, '```sql' || chr(10) || template_sql || chr(10) || '```' AS response "
    "FROM routed JOIN templates USING (template)",
)
def _(t: Inputs) -> DataFrame:
    return batch_generate(t("v_pairs").select("pair_id", "question")).select("pair_id", "response")


@named(
    "batch_generate_user",
    "SELECT pair_id, 'SELECT ' || length(question) || ' -- ' || length(sql) AS response "
    "FROM v_pairs",
)
def _(t: Inputs) -> DataFrame:
    prompts_in = t("v_pairs").select("pair_id", "question", F.col("sql").alias("prompt"))

    def answer(questions, texts):
        return "SELECT " + questions.str.len().astype(str) + " -- " + texts.str.len().astype(str)

    return batch_generate(prompts_in, answer).select("pair_id", "response")


@named(
    "embed_input",
    "SELECT pair_id, 384 AS width, CASE WHEN question = '' THEN 0.0::DOUBLE ELSE 1.0 END AS length,"
    " true AS in_range FROM v_pairs",
)
def _(t: Inputs) -> DataFrame:
    # The hash has no counterpart in SQL; width, length and range have.
    vectors = embed_input(t("v_pairs").select("pair_id", "question"), "question")
    v = F.col("embedding")
    return vectors.select(
        "pair_id",
        F.size(v).alias("width"),
        F.round(F.sqrt(dot(v, v)), 6).alias("length"),
        ((F.array_min(v) >= -1) & (F.array_max(v) <= 1)).alias("in_range"),
    )


@named(
    "batch_embed",
    "SELECT pair_id, CAST(length(question) AS FLOAT) AS chars, CAST(length(question) "
    "- length(replace(question, ' ', '')) AS FLOAT) AS blanks FROM v_pairs",
)
def _(t: Inputs) -> DataFrame:
    def embed(texts):
        return texts.map(lambda s: [float(len(s)), float(s.count(" "))])

    vectors = batch_embed(t("v_pairs").select("pair_id", "question"), "question", embed)
    return vectors.select("pair_id", F.col("embedding")[0].alias("chars"),
                          F.col("embedding")[1].alias("blanks"))


# --- prompts and training records ---------------------------------------------


@named(
    "table_text",
    """SELECT vec_id, 'Table: ' || table_name || CASE WHEN description <> ''
      THEN chr(10) || 'Description: ' || description ELSE '' END || chr(10) || ddl AS table_text
    FROM v_registry""",
)
def _(t: Inputs) -> DataFrame:
    shown = prompts.table_text(F.col("table_name"), F.col("description"), F.col("ddl"))
    return t("v_registry").select("vec_id", shown.alias("table_text"))


def with_samples(registry: DataFrame) -> DataFrame:
    """The registry with sample values: none, an empty map, or two columns."""
    first = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: (F.col("vec_id") + i).cast("string"))
    samples = F.map_from_arrays(
        F.array(F.lit("id"), F.lit("status")),
        F.array(first, F.array(F.lit("open"), F.lit("closed"))),
    )
    empty = F.create_map().cast("map<string,array<string>>")
    return registry.withColumn(
        "sample_values",
        F.when(F.length("description") > 0, samples).when(F.col("description") == "", empty),
    )


ENRICHED = """(CASE WHEN description <> '' THEN '-- ' || description || chr(10) ELSE '' END
  || trim(ddl) || CASE WHEN description <> '' THEN chr(10) || '-- id sample values: '
  || array_to_string([vec_id + 1, vec_id + 2, vec_id + 3, vec_id + 4, vec_id + 5], ', ')
  || chr(10) || '-- status sample values: open, closed' ELSE '' END)"""


@named("enrich_ddl", f"SELECT vec_id, {ENRICHED} AS ddl FROM v_registry")
def _(t: Inputs) -> DataFrame:
    rows = with_samples(t("v_registry"))
    shown = prompts.enrich_ddl(F.col("ddl"), F.col("description"), F.col("sample_values"))
    return rows.select("vec_id", shown.alias("ddl"))


@named(
    "build_eval_prompt",
    "SELECT pair_id, "
    + template_oracle(prompts.EVAL_TEMPLATE, dialect="'POSTGRESQL'",
                      schema="chain_of_thought", question="question")
    + " AS prompt FROM v_pairs",
)
def _(t: Inputs) -> DataFrame:
    prompt = prompts.eval_prompt(F.col("chain_of_thought"), F.col("question"))
    return t("v_pairs").select("pair_id", prompt.alias("prompt"))


@named(
    "build_correction_prompt",
    "SELECT query_id, attempt, "
    + template_oracle(prompts.CORRECTION_TEMPLATE, prompt="'Query ' || query_id",
                      sql="sql", error="error", dialect="'POSTGRESQL'")
    + " AS prompt FROM v_attempts WHERE NOT success",
)
def _(t: Inputs) -> DataFrame:
    failed = t("v_attempts").where(~F.col("success"))
    original = F.concat(F.lit("Query "), F.col("query_id").cast("string"))
    prompt = prompts.correction_prompt(original, F.col("sql"), F.col("error"))
    return failed.select("query_id", "attempt", prompt.alias("prompt"))


_TOKENS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]', 0)"
_RECORDS = f"""
  WITH toks AS (
    SELECT conv_id, turn, {_TOKENS.format(template_oracle(
      prompts.TRAINING_TEMPLATE, schema="question", question="question"))} AS p,
      {_TOKENS.format("answer")} AS a FROM v_turns),
  counts AS (
    SELECT conv_id, turn, CAST(len(p) AS INT) AS prompt_tokens,
      CAST(len(p) + len(a) AS INT) AS full_tokens,
      CAST(greatest(0, least(len(p) + len(a), 512) - least(len(p), 512)) AS INT) AS n_train
    FROM toks),
  records AS (
    SELECT *, 512 - n_train AS n_masked, full_tokens > 512 AS truncated, n_train = 0 AS dead
    FROM counts)
"""


def _turns(t: Inputs) -> DataFrame:
    # The question stands in for the DDL as well, so that some windows overflow.
    return t("v_turns").withColumn("schema_ddl", F.col("question"))


def _turn_counts(t: Inputs) -> DataFrame:
    return training.training_counts(_turns(t), answer="answer")


_COUNT_COLUMNS = [
    "conv_id", "turn", "prompt_tokens", "full_tokens", "n_train", "n_masked", "truncated", "dead",
]


@named("training_counts", _RECORDS + f"SELECT {', '.join(_COUNT_COLUMNS)} FROM records")
def _(t: Inputs) -> DataFrame:
    return _turn_counts(t).select(*_COUNT_COLUMNS)


_IDS = "list_transform({}, lambda w: CAST('0x' || substr(md5(w), 1, 7) AS INT) + 1)"


@named(
    "training_records",
    _RECORDS + f""", ids AS (
      SELECT conv_id, turn, least(len(p), 512) AS pl,
        {_IDS.format("list_concat(p, a)[:512]")} AS k FROM toks)
    SELECT conv_id, turn,
      array_to_string(list_resize(k, 512, 0), ' ') AS input_ids,
      array_to_string(list_resize(list_transform(k, lambda x: 1), 512, 0), ' ') AS attention_mask,
      array_to_string(list_resize(list_transform(range(1, len(k) + 1),
        lambda i: CASE WHEN i <= pl THEN -100 ELSE k[i] END), 512, -100), ' ') AS labels
    FROM ids""",
)
def _(t: Inputs) -> DataFrame:
    records = training.training_records(_turns(t), answer="answer")
    return records.select(
        "conv_id", "turn",
        *[F.array_join(c, " ").alias(c) for c in ("input_ids", "attention_mask", "labels")],
    )


_DICTIONARY = _RECORDS + """, dictionary AS (
    SELECT token, n, 1 + row_number() OVER (ORDER BY n DESC, token) AS id
    FROM (SELECT token, count(*) AS n FROM (SELECT unnest(list_concat(p, a)) AS token FROM toks)
      GROUP BY 1 HAVING count(*) >= 2))"""


def _dictionary(t: Inputs) -> DataFrame:
    path = fresh_path(t.spark, "dictionary")
    training.record_dictionary(_turns(t), answer="answer").write.parquet(path)
    return t.spark.read.schema("token string, n long, id long").parquet(path)


@named("token_dictionary", _DICTIONARY + " SELECT token, n, id FROM dictionary")
def _(t: Inputs) -> DataFrame:
    return _dictionary(t)


@named(
    "training_records_dense",
    _DICTIONARY + """, kept AS (
      SELECT row_number() OVER () AS r, conv_id, turn, least(len(p), 512) AS pl,
        list_concat(p, a)[:512] AS w FROM toks),
    placed AS (SELECT r, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS place FROM kept),
    found AS (
      SELECT r, list(coalesce(id, 1) ORDER BY place) AS k
      FROM placed LEFT JOIN dictionary USING (token) GROUP BY r)
    SELECT conv_id, turn, array_to_string(list_resize(k, 512, 0), ' ') AS input_ids,
      array_to_string(list_resize(list_transform(range(1, len(k) + 1),
        lambda i: CASE WHEN i <= pl THEN -100 ELSE k[i] END), 512, -100), ' ') AS labels
    FROM kept JOIN found USING (r)""",
)
def _(t: Inputs) -> DataFrame:
    records = training.training_records(_turns(t), answer="answer", dictionary=_dictionary(t))
    return records.select(
        "conv_id", "turn", *[F.array_join(c, " ").alias(c) for c in ("input_ids", "labels")],
    )


@named(
    "rate_dead_records",
    _RECORDS + """SELECT turn, count(*) AS records,
      round(avg(CAST(truncated AS INT)), 6) AS truncated_rate,
      round(avg(CAST(dead AS INT)), 6) AS dead_rate FROM records GROUP BY 1""",
)
def _(t: Inputs) -> DataFrame:
    rates = training.rate_dead_records(_turn_counts(t), "turn")
    return rates.select(
        "turn", "records",
        *[F.round(c, 6).alias(c) for c in ("truncated_rate", "dead_rate")],
    )
