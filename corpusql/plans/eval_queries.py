"""Named queries over evaluations, retrieval, the query log and its streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.functions import prompts, text
from corpusql.functions.scoring import bleu
from corpusql.operators import evaluation, querylog, retrieval
from corpusql.plans.corpus_queries import ENRICHED, template_oracle, with_samples
from corpusql.plans.flows import answer_questions, register_schema
from corpusql.plans.registry import named
from corpusql.plans.views import Inputs
from corpusql.sources.tables import publish_log
from corpusql.sources.versions import VersionedTable
from corpusql.sources.workspace import fresh_path
from corpusql.streaming import jobs

# --- evaluation ---------------------------------------------------------------

_MEANS = """round(avg(CAST(exec_match AS INT)), 6) AS execution_accuracy,
  round(avg(CAST(exec_success AS INT)), 6) AS validity_rate,
  round(avg(bleu), 6) AS avg_bleu, count(*) AS total_evaluated"""


@named(
    "eval_rollup",
    f"""SELECT 'overall' AS level, NULL AS value, {_MEANS} FROM v_eval
    UNION ALL SELECT 'schema_name', schema_name, {_MEANS} FROM v_eval GROUP BY schema_name
    UNION ALL SELECT 'complexity', complexity, {_MEANS} FROM v_eval GROUP BY complexity""",
)
def _(t: Inputs) -> DataFrame:
    rolled = evaluation.eval_rollup(t("v_eval"))
    means = ("execution_accuracy", "validity_rate", "avg_bleu")
    return rolled.withColumns({c: F.round(c, 6) for c in means})


@named(
    "running_eval",
    """SELECT step AS evaluated, ex AS execution_accuracy, ok AS validity_rate
    FROM (SELECT step, CAST(sum(CAST(exec_match AS INT)) OVER w AS DOUBLE) / step AS ex,
        CAST(sum(CAST(exec_success AS INT)) OVER w AS DOUBLE) / step AS ok FROM v_eval
      WINDOW w AS (ORDER BY step ROWS UNBOUNDED PRECEDING))
    WHERE step % 10 = 0""",
)
def _(t: Inputs) -> DataFrame:
    return evaluation.running_eval(t("v_eval"))


def bleu_oracle(source: str, keys: str) -> str:
    """BLEU of (ref, hyp) of ``source`` by counting n-grams row by row in DuckDB."""
    tok = (
        r"regexp_extract_all(rtrim(trim(lower({}), ' ' || chr(10)), ';'), "
        r"'[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]', 0)"
    )
    key_join = " AND ".join(f"x.{k} = y.{k}" for k in keys.split(", "))

    def grams(side: str) -> str:
        return f"""SELECT {keys}, n, array_to_string(list_slice({side}, i, i + n - 1), chr(1)) AS g,
          count(*) AS c FROM (SELECT {keys}, {side}, n,
            unnest(range(1, len({side}) - n + 2)) AS i
          FROM toks, (SELECT unnest([1, 2, 3, 4]) AS n)) GROUP BY ALL"""

    return f"""toks AS (SELECT {keys}, {tok.format("ref")} AS r, {tok.format("hyp")} AS h
        FROM {source}),
      rg AS ({grams("r")}), hg AS ({grams("h")}),
      hits AS (SELECT {", ".join("x." + k for k in keys.split(", "))}, x.n,
          sum(least(x.c, y.c)) AS hit
        FROM hg x JOIN rg y ON {key_join} AND x.n = y.n AND x.g = y.g GROUP BY ALL),
      levels AS (SELECT t.*, n, coalesce(hit, 0) AS hit FROM
        (SELECT *, unnest([1, 2, 3, 4]) AS n FROM toks) t LEFT JOIN hits USING ({keys}, n)),
      scores AS (SELECT {keys},
        CASE WHEN any_value(len(h)) = 0 OR sum(hit) FILTER (WHERE n = 1) = 0 THEN 0.0::DOUBLE
        ELSE round(exp(least(0, 1 - any_value(len(r)) / any_value(len(h))) +
          sum(ln(CASE WHEN hit = 0 THEN 0.1::DOUBLE ELSE hit END
            / greatest(1, len(h) - n + 1))) / 4), 4) END AS bleu
        FROM levels GROUP BY {keys})"""


@named(
    "bleu",
    "WITH turns AS (SELECT conv_id, turn, question AS ref, answer AS hyp FROM v_turns), "
    + bleu_oracle("turns", "conv_id, turn") + " SELECT conv_id, turn, bleu FROM scores",
)
def _(t: Inputs) -> DataFrame:
    score = bleu(F.col("question"), F.col("answer"))
    return t("v_turns").select("conv_id", "turn", score.alias("bleu"))


# Queries to compare: as written, rewritten, and with a difference.
_BY_STATUS = "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus"
_REWRITES = {
    "same_rows": (
        _BY_STATUS,
        "SELECT s AS o_orderstatus, count(k) AS n FROM (SELECT o_orderstatus AS s, "
        "o_orderkey AS k FROM orders) t GROUP BY s",
    ),
    "other_alias": (
        _BY_STATUS,
        "SELECT o_orderstatus, count(*) AS total FROM orders GROUP BY o_orderstatus",
    ),
    "repeats_only": (
        "SELECT o_custkey FROM orders",
        "SELECT DISTINCT o_custkey FROM orders",
    ),
    "other_filter": (
        "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'",
        "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'",
    ),
    "null_rows": (
        "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey",
        "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey",
    ),
}
_MODES = ("multiset", "set")


def _agreement_oracle(mode: str, case: str) -> str:
    reference, generated = _REWRITES[case]
    if case == "other_alias":
        verdict = "SELECT false AS m"
    else:
        every = "ALL" if mode == "multiset" else ""
        verdict = (
            f"SELECT NOT EXISTS (FROM ({reference}) EXCEPT {every} FROM ({generated})) "
            f"AND NOT EXISTS (FROM ({generated}) EXCEPT {every} FROM ({reference})) AS m"
        )
    return f"SELECT '{case}' AS pair, '{mode}' AS mode, m AS matches FROM ({verdict})"


@named(
    "result_match",
    " UNION ALL ".join(_agreement_oracle(mode, case) for case in _REWRITES for mode in _MODES),
)
def _(t: Inputs) -> DataFrame:
    t.register("orders", "customer")
    verdicts = None
    for case, (reference, generated) in _REWRITES.items():
        left, right = t.spark.sql(reference), t.spark.sql(generated)
        for mode in _MODES:
            row = evaluation.result_match(left, right, mode).select(
                F.lit(case).alias("pair"), F.lit(mode).alias("mode"), "matches"
            )
            verdicts = row if verdicts is None else verdicts.unionByName(row)
    return verdicts


@named(
    "result_match_ordered",
    "SELECT 'same order' AS pair, true AS matches UNION ALL SELECT 'other order', "
    "(SELECT count(*) < 2 FROM orders)",
)
def _(t: Inputs) -> DataFrame:
    t.register("orders")
    sql = "SELECT o_orderkey, o_totalprice, {} AS place FROM orders"
    by_key = t.spark.sql(sql.format("o_orderkey"))
    again = t.spark.sql(sql.format("o_orderkey"))
    backwards = t.spark.sql(sql.format("-o_orderkey"))
    order = ["place"]

    def verdict(name: str, other: DataFrame) -> DataFrame:
        # Where rows stand matters, not the value they were sorted by.
        return evaluation.result_match(
            by_key, other, "ordered", order_by=order, compare=["o_orderkey", "o_totalprice"]
        ).select(F.lit(name).alias("pair"), "matches")

    return verdict("same order", again).unionByName(verdict("other order", backwards))


# One pair of queries per kind of outcome; every verdict reads whole tables.
_RUNS = {
    "match": (_BY_STATUS, _REWRITES["same_rows"][1]),
    "mismatch": _REWRITES["other_filter"],
    "duplicates": _REWRITES["repeats_only"],
    "alias": _REWRITES["other_alias"],
    "empty": (_BY_STATUS, ";"),
    "unknown_table": (_BY_STATUS, "SELECT count(*) AS n FROM no_such_table"),
    "broken_reference": ("SELECT count(*) AS n FROM no_such_table", _BY_STATUS + ";"),
}
_RUN_VERDICTS = {  # exec_success, exec_match where not taken from the tables
    "empty": ("false", "false", "false"),
    "unknown_table": ("false", "false", "false"),
    "broken_reference": ("true", "true", "true"),
    "alias": ("true", "false", "false"),
}


def _run_oracle(name: str) -> str:
    reference, generated = _RUNS[name]
    quoted = [q.replace("'", "''") for q in (reference, generated)]
    if name in _RUN_VERDICTS:
        ran, matched, broken = _RUN_VERDICTS[name]
    else:
        ran, broken = "true", "false"
        matched = (
            f"NOT EXISTS (FROM ({reference}) EXCEPT ALL FROM ({generated})) AND "
            f"NOT EXISTS (FROM ({generated}) EXCEPT ALL FROM ({reference}))"
        )
    return (
        f"SELECT '{name}' AS candidate, '{quoted[0]}' AS ref, '{quoted[1]}' AS hyp, "
        f"{ran} AS exec_success, {matched} AS exec_match, {broken} AS reference_failed"
    )


@named(
    "evaluate_pairs",
    "WITH runs AS (" + " UNION ALL ".join(_run_oracle(n) for n in _RUNS) + "), "
    + bleu_oracle("runs", "candidate")
    + """ SELECT candidate, bleu, length(rtrim(hyp, ';')) > 0 AS valid, exec_success, exec_match,
      reference_failed, NOT exec_success AS has_error FROM runs JOIN scores USING (candidate)""",
)
def _(t: Inputs) -> DataFrame:
    t.register("orders", "customer")
    pairs = t.spark.createDataFrame(
        [(k, *v) for k, v in _RUNS.items()],
        "candidate string, reference_sql string, generated_sql string",
    )
    outcomes = evaluation.execution_outcomes(t.spark, pairs)
    return evaluation.evaluate_pairs(pairs, outcomes).select(
        "candidate", "bleu", "valid", "exec_success", "exec_match", "reference_failed",
        F.col("error").isNotNull().alias("has_error"),
    )


_RUN_NAMES = list(_RUNS)
_EVALUATED = (
    "WITH runs AS (" + " UNION ALL ".join(_run_oracle(n) for n in _RUNS) + "), "
    + bleu_oracle("runs", "candidate")
    + f""", evaluated AS (SELECT p.schema_name, p.complexity, r.exec_success, r.exec_match, s.bleu
      FROM v_pairs p JOIN runs r ON r.candidate = ({_RUN_NAMES!r})[p.pair_id % {len(_RUNS)} + 1]
      JOIN scores s USING (candidate)) """
)


@named(
    "evaluate_run",
    _EVALUATED + f"""SELECT 'overall' AS level, NULL AS value, {_MEANS} FROM evaluated
    UNION ALL SELECT 'schema_name', schema_name, {_MEANS} FROM evaluated GROUP BY schema_name
    UNION ALL SELECT 'complexity', complexity, {_MEANS} FROM evaluated GROUP BY complexity""",
)
def _(t: Inputs) -> DataFrame:
    # Every pair of the corpus is scored; its distinct query texts run once and share the verdict.
    t.register("orders", "customer")
    names = F.array(*[F.lit(n) for n in _RUN_NAMES])
    texts = {side: F.create_map(*[F.lit(x) for n, v in _RUNS.items() for x in (n, v[i])])
             for i, side in enumerate(("reference_sql", "generated_sql"))}
    pairs = t("v_pairs").select(
        "schema_name", "complexity",
        F.get(names, (F.col("pair_id") % len(_RUNS)).cast("int")).alias("candidate"),
    ).withColumns({side: F.element_at(by_name, F.col("candidate")) for side, by_name in texts.items()})
    texts_of = pairs.select("candidate", "reference_sql", "generated_sql").distinct()
    outcomes = evaluation.execution_outcomes(t.spark, texts_of)
    rolled = evaluation.eval_rollup(evaluation.evaluate_pairs(pairs, outcomes))
    means = ("execution_accuracy", "validity_rate", "avg_bleu")
    return rolled.withColumns({c: F.round(c, 6) for c in means})


@named(
    "evaluate_corpus",
    "WITH routed AS (SELECT pair_id, sql AS ref, CASE "
    "WHEN regexp_matches(lower(question), 'how many|count|total number') THEN 'aggregate' "
    "WHEN regexp_matches(lower(question), 'list|show|get all|find all') THEN 'list' "
    "ELSE 'default' END AS template FROM v_pairs), templates(template, hyp) AS (VALUES "
    + ", ".join("('{}', '{}')".format(n, s.replace("'", "''")) for n, s in text.TEMPLATE_SQL.items())
    + "), texts AS (SELECT DISTINCT ref, hyp, dense_rank() OVER (ORDER BY ref, hyp) AS tid "
    "FROM routed JOIN templates USING (template)), "
    + bleu_oracle("texts", "tid")
    + """ SELECT r.pair_id, s.bleu, true AS valid FROM routed r JOIN templates USING (template)
      JOIN texts x ON x.ref = r.ref AND x.hyp = templates.hyp JOIN scores s USING (tid)""",
)
def _(t: Inputs) -> DataFrame:
    answered = t("v_pairs").select(
        "pair_id", F.col("sql").alias("reference_sql"),
        text.template_sql(text.route_question(F.col("question"))).alias("generated_sql"),
    )
    return answered.select(
        "pair_id",
        bleu(F.col("reference_sql"), F.col("generated_sql")).alias("bleu"),
        text.is_valid_syntax(F.col("generated_sql")).alias("valid"),
    )


# --- retrieval ----------------------------------------------------------------

_RANKED = """
  ranked AS (
    SELECT question_id, table_name, distance, CAST(row_number() OVER (PARTITION BY question_id
        ORDER BY distance NULLS LAST, table_name) AS INT) AS rank
    FROM (SELECT q.question_id, r.table_name, round(1 - list_cosine_similarity(
          q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9) + 0.0 AS distance
      FROM v_questions q JOIN v_registry r USING (schema_name)))
"""


@named(
    "vector_topk",
    "WITH " + _RANKED + "SELECT question_id, rank, table_name, round(distance, 6) AS distance "
    "FROM ranked WHERE rank <= 5",
)
def _(t: Inputs) -> DataFrame:
    ranked = retrieval.vector_topk(t("v_questions"), t("v_registry"))
    return ranked.withColumn("distance", F.round("distance", 6))


@named(
    "retrieval_batch",
    "WITH " + _RANKED + """SELECT k.question_id, q.question, k.rank, k.table_name, r.ddl
    FROM ranked k JOIN v_questions q USING (question_id)
    JOIN v_registry r ON r.schema_name = q.schema_name AND r.table_name = k.table_name
    WHERE rank <= 3""",
)
def _(t: Inputs) -> DataFrame:
    ranked = retrieval.retrieval_batch(t("v_questions"), t("v_registry"), 3)
    return ranked.select("question_id", "question", "rank", "table_name", "ddl")


@named(
    "retrieve_tables",
    """SELECT table_name, round(distance, 6) AS distance FROM (
      SELECT table_name, round(1 - list_cosine_similarity((SELECT embedding::DOUBLE[]
        FROM v_questions WHERE question_id = 7), embedding::DOUBLE[]), 9) + 0.0 AS distance
      FROM v_registry WHERE schema_name = 'schema_1')
    ORDER BY distance NULLS LAST, table_name LIMIT 5""",
)
def _(t: Inputs) -> DataFrame:
    # The one question asked stays a table of one row; none gives no rows.
    asked = t("v_questions").where("question_id = 7").select(
        "question_id", F.lit("schema_1").alias("schema_name"), "embedding"
    )
    nearest = retrieval.vector_topk(asked, t("v_registry").where("schema_name = 'schema_1'"))
    return nearest.select("table_name", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


@named(
    "schema_not_found",
    "SELECT question_id, schema_name FROM v_questions "
    "WHERE schema_name NOT IN (SELECT schema_name FROM v_registry)",
)
def _(t: Inputs) -> DataFrame:
    missing = retrieval.schema_not_found(t("v_questions"), t("v_registry"))
    return missing.select("question_id", "schema_name")


_PROMPTS = "WITH " + _RANKED + f"""
  , shown AS (SELECT k.question_id, q.question, string_agg({ENRICHED}, chr(10) || chr(10)
      ORDER BY k.rank) AS schema_text
    FROM ranked k JOIN v_questions q USING (question_id)
    JOIN v_registry r ON r.schema_name = q.schema_name AND r.table_name = k.table_name
    WHERE rank <= 5 GROUP BY ALL)
"""
_PROMPT = template_oracle(
    prompts.PROMPT_TEMPLATE, dialect="'POSTGRESQL'", schema="schema_text", question="question"
)


@named("build_prompt", _PROMPTS + f"SELECT question_id, {_PROMPT} AS prompt FROM shown")
def _(t: Inputs) -> DataFrame:
    ranked = retrieval.retrieval_batch(t("v_questions"), with_samples(t("v_registry")))
    ddl = prompts.enrich_ddl(F.col("ddl"), F.col("description"), F.col("sample_values"))
    built = prompts.build_prompts(ranked.withColumn("table_ddl", ddl))
    return built.select("question_id", "prompt")


_DEFAULT_SQL = text.TEMPLATE_SQL["default"].rstrip(";").replace("'", "''")


@named(
    "answer_questions",
    _PROMPTS + f"SELECT question_id, {_PROMPT} AS prompt, '{_DEFAULT_SQL}' AS sql, "
    "'' AS explanation FROM shown",
)
def _(t: Inputs) -> DataFrame:
    answers = answer_questions(t("v_questions"), with_samples(t("v_registry")))
    return answers.select("question_id", "prompt", "sql", "explanation")


@named(
    "registry_replace",
    """SELECT schema_name, table_name, ddl FROM v_registry WHERE schema_name <> 'schema_1'
    UNION ALL SELECT 'schema_1', 'new_' || table_name, trim(ddl) FROM v_registry
      WHERE schema_name = 'schema_2'""",
)
def _(t: Inputs) -> DataFrame:
    table = VersionedTable(t.spark, fresh_path(t.spark, "registry"))
    registry = t("v_registry").select("schema_name", "table_name", "ddl", "embedding")
    table.create(registry, "schema_name", "first load")
    tables = registry.where(F.col("schema_name") == "schema_2").select(
        F.lit("schema_1").alias("schema_name"),
        F.concat(F.lit("new_"), "table_name").alias("table_name"),
        F.trim("ddl").alias("ddl"),
        "embedding",
    )
    for _ in range(2):  # one schema is written, once
        table.replace("schema_1", tables, "new schema_1")
    return table.read().select("schema_name", "table_name", "ddl")


@named(
    "register_schema",
    """SELECT schema_name, table_name, NULL AS chars FROM v_registry
      WHERE schema_name <> 'schema_1'
    UNION ALL SELECT 'schema_1', table_name, CAST(length('Table: ' || table_name || CASE WHEN
        description <> '' THEN chr(10) || 'Description: ' || description ELSE '' END
        || chr(10) || ddl) AS FLOAT) FROM v_registry WHERE schema_name = 'schema_2'""",
)
def _(t: Inputs) -> DataFrame:
    registry = t("v_registry").drop("vec_id", "embedding")
    tables = registry.where(F.col("schema_name") == "schema_2").drop("schema_name")

    def embed(texts):
        return texts.map(lambda s: [float(len(s))])

    registered = register_schema(registry.withColumn(
        "embedding", F.lit(None).cast("array<float>")), "schema_1", tables, embed)
    return registered.select("schema_name", "table_name", F.col("embedding")[0].alias("chars"))


# --- query log ----------------------------------------------------------------


@named(
    "log_append",
    """SELECT CAST(query_id AS VARCHAR) AS query_id, schema_name, dialect, correction_attempts,
      nullif(substr(execution_error, 1, 500), '') AS execution_error FROM v_query_log""",
)
def _(t: Inputs) -> DataFrame:
    table = VersionedTable(t.spark, fresh_path(t.spark, "log"))
    for _ in range(2):  # a job that runs again adds nothing
        publish_log(table, t("v_query_log"), "nightly")
    return table.read().select(
        "query_id", "schema_name", "dialect", "correction_attempts", "execution_error"
    )


@named(
    "filter_schema",
    "SELECT query_id, question FROM v_query_log WHERE schema_name = 'schema_1'",
)
def _(t: Inputs) -> DataFrame:
    return querylog.filter_schema(t("v_query_log"), "schema_1").select("query_id", "question")


@named(
    "filter_failures",
    "SELECT query_id, created_at FROM v_query_log WHERE execution_success = false",
)
def _(t: Inputs) -> DataFrame:
    return querylog.filter_failures(t("v_query_log")).select("query_id", "created_at")


@named(
    "filter_feedback",
    "SELECT feedback_id, feedback, feedback IN (1, -1) AS accepted FROM v_feedback",
)
def _(t: Inputs) -> DataFrame:
    checked = querylog.filter_feedback(t("v_feedback"))
    return checked.select("feedback_id", "feedback", "accepted")


@named(
    "recent_logs",
    """SELECT query_id, schema_name, created_at FROM v_query_log
    ORDER BY created_at DESC NULLS FIRST, query_id LIMIT 50""",
)
def _(t: Inputs) -> DataFrame:
    return querylog.recent_logs(t("v_query_log")).select("query_id", "schema_name", "created_at")


@named(
    "recent_logs_failures",
    """SELECT query_id, schema_name, created_at FROM v_query_log
    WHERE schema_name = 'schema_2' AND execution_success = false
    ORDER BY created_at DESC NULLS FIRST, query_id LIMIT 20""",
)
def _(t: Inputs) -> DataFrame:
    rows = querylog.recent_logs(t("v_query_log"), 20, "schema_2", failures_only=True)
    return rows.select("query_id", "schema_name", "created_at")


@named(
    "retrain_candidates",
    """SELECT query_id, schema_name, question, dialect, execution_error, created_at
    FROM v_query_log WHERE execution_success = false""",
)
def _(t: Inputs) -> DataFrame:
    return querylog.retrain_candidates(t("v_query_log"))


@named(
    "schema_list",
    """SELECT schema_name, count(*) AS table_count, min(created_at) AS created_at
    FROM v_query_log GROUP BY 1""",
)
def _(t: Inputs) -> DataFrame:
    return querylog.schema_list(t("v_query_log"))


_LATEST = """
  WITH latest AS (SELECT query_id, feedback AS user_feedback FROM v_feedback
    WHERE feedback IN (1, -1)
    QUALIFY row_number() OVER (PARTITION BY query_id
      ORDER BY submitted_at DESC, feedback_id DESC) = 1)
"""


@named(
    "feedback_apply",
    _LATEST + "SELECT query_id, question, user_feedback FROM v_query_log "
    "LEFT JOIN latest USING (query_id)",
)
def _(t: Inputs) -> DataFrame:
    view = querylog.feedback_apply(t("v_query_log"), t("v_feedback"))
    return view.select("query_id", "question", "user_feedback")


@named(
    "feedback_unmatched",
    """SELECT feedback_id, query_id FROM v_feedback WHERE feedback IN (1, -1)
      AND query_id NOT IN (SELECT query_id FROM v_query_log)""",
)
def _(t: Inputs) -> DataFrame:
    unknown = querylog.feedback_unmatched(t("v_feedback"), t("v_query_log"))
    return unknown.select("feedback_id", "query_id")


@named(
    "log_dedupe",
    "SELECT query_id, created_at, question, execution_success, latency_ms FROM v_query_log",
)
def _(t: Inputs) -> DataFrame:
    log = t("v_query_log")
    late = log.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 5 MINUTES"))
    return querylog.log_dedupe(log.unionByName(late)).select(
        "query_id", "created_at", "question", "execution_success", "latency_ms"
    )


_ROLLUP = """
  WITH allowed AS (SELECT * FROM v_attempts WHERE attempt <= 2),
  places AS (SELECT query_id, min(attempt) FILTER (WHERE success) AS won, max(attempt) AS last
    FROM allowed GROUP BY 1),
  rolled AS (
    SELECT p.query_id, won IS NOT NULL AS success, f.sql AS final_sql, o.sql AS original_sql,
      CASE WHEN won IS NULL THEN f.error END AS error, coalesce(won, last) AS correction_attempts
    FROM places p
    JOIN allowed f ON f.query_id = p.query_id AND f.attempt = coalesce(won, last)
    JOIN allowed o ON o.query_id = p.query_id AND o.attempt = 0)
"""


@named("attempt_rollup", _ROLLUP + "SELECT * FROM rolled")
def _(t: Inputs) -> DataFrame:
    return querylog.attempt_rollup(t("v_attempts"))


@named(
    "correction_lift",
    _ROLLUP + """SELECT count(*) AS queries,
      round(avg(CAST(success AND correction_attempts = 0 AS INT)), 6) AS first_attempt_rate,
      round(avg(CAST(success AS INT)), 6) AS corrected_rate,
      round(avg(CAST(success AS INT))
        - avg(CAST(success AND correction_attempts = 0 AS INT)), 6) AS lift FROM rolled""",
)
def _(t: Inputs) -> DataFrame:
    rates = ("first_attempt_rate", "corrected_rate", "lift")
    lift = querylog.correction_lift(t("v_attempts"))
    return lift.withColumns({c: F.round(c, 6) for c in rates})


# --- streams ------------------------------------------------------------------
# Each runs over all data there is and stops; the result table is then read back.

_LOG_SQL = """
  SELECT event_id AS query_id, 'schema_' || CAST(user_id % 5 AS STRING) AS schema_name,
    event_type AS question, ts AS created_at,
    CASE event_type WHEN 'error' THEN FALSE WHEN 'signup' THEN NULL ELSE TRUE END
      AS execution_success,
    CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN repeat('relation missing ', 40)
      WHEN event_type = 'error' THEN '' END AS execution_error
  FROM {log}"""


def _events(t: Inputs) -> DataFrame:
    return jobs.read_stream(t.spark, t.folder, "events")


def _log_stream(t: Inputs) -> DataFrame:
    return t.spark.sql(_LOG_SQL, log=_events(t))


def _finish(t: Inputs, stream: DataFrame, name: str) -> DataFrame:
    path, checkpoint = fresh_path(t.spark, name), fresh_path(t.spark, f"{name}-checkpoint")
    jobs.run_to_table(stream, path, checkpoint, available_now=True).awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(path)


@named(
    "stream_failures",
    """SELECT query_id, schema_name, question, execution_error, created_at FROM v_query_log
    WHERE execution_success = false""",
)
def _(t: Inputs) -> DataFrame:
    return _finish(t, jobs.stream_failures(_log_stream(t)), "failures")


_WINDOWS = """
  SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, count(*) AS n,
    round(avg(value), 6) AS mean_latency FROM events GROUP BY 1"""


@named(
    "stream_metrics_5m",
    f"SELECT * FROM ({_WINDOWS}) WHERE window_start + INTERVAL '5 minutes' "
    "<= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'",
)
def _(t: Inputs) -> DataFrame:
    # The watermark holds back windows that could still get late events.
    closed = _finish(t, jobs.stream_metrics(_events(t)), "metrics")
    return closed.select(
        F.col("start").cast("timestamp_ntz").alias("window_start"), "n",
        F.round("mean_latency", 6).alias("mean_latency"),
    )


@named("metrics_5m", _WINDOWS)
def _(t: Inputs) -> DataFrame:
    return jobs.metrics(t("events"), "ts", "value").select(
        F.col("start").alias("window_start"), "n",
        F.round("mean_latency", 6).alias("mean_latency"),
    )


_BATCHES = """
  SELECT query_id, time_bucket(INTERVAL '60 seconds', created_at) AS window_start,
    CAST(ceil(row_number() OVER (PARTITION BY time_bucket(INTERVAL '60 seconds', created_at)
      ORDER BY created_at, query_id) / 100) AS BIGINT) AS batch
  FROM v_query_log WHERE execution_success = false"""


@named("stream_batches", _BATCHES)
def _(t: Inputs) -> DataFrame:
    path, checkpoint = fresh_path(t.spark, "batches"), fresh_path(t.spark, "batches-checkpoint")

    def handle(batches: DataFrame, epoch: int) -> None:
        batches.select("query_id", "window_start", "batch").write.mode("overwrite").parquet(
            f"{path}/epoch={epoch}"
        )

    # A row of a later day, as any later traffic, lets the last minutes close.
    folder = fresh_path(t.spark, "batches-in")
    failures = querylog.filter_failures(t("v_query_log")).select("query_id", "created_at")
    later = failures.agg((F.max("created_at") + F.expr("INTERVAL 1 DAY")).alias("created_at"))
    tick = later.select(F.lit(None).cast("long").alias("query_id"), "created_at")
    for delivery in (failures, tick):
        delivery.write.mode("append").parquet(f"{folder}/failures.parquet")
        stream = jobs.read_stream(t.spark, folder, "failures")
        jobs.stream_batches(stream, handle, checkpoint, available_now=True).awaitTermination()
    return t.spark.read.parquet(path).select("query_id", "window_start", "batch")


@named("failure_batches", _BATCHES)
def _(t: Inputs) -> DataFrame:
    batches = jobs.failure_batches(querylog.filter_failures(t("v_query_log")))
    return batches.select("query_id", "window_start", "batch")


@named(
    "stream_retention",
    "SELECT event_id, event_type FROM events "
    "WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '86400 seconds'",
)
def _(t: Inputs) -> DataFrame:
    kept = jobs.stream_retention(_events(t), now="2024-01-31 00:00:00")
    return _finish(t, kept, "retention").select("event_id", "event_type")


#: Events come in three deliveries; a tenth of all times comes last.
_DELIVERY = "CASE WHEN event_id % 10 = 0 THEN 2 WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 0 ELSE 1 END"


@named(
    "stream_retention_late",
    f"""WITH dealt AS (SELECT event_id, ts, {_DELIVERY} AS delivery FROM events),
    newest AS (SELECT delivery, max(ts) AS newest FROM dealt GROUP BY 1)
    SELECT event_id, coalesce(ts < (SELECT max(newest) FROM newest n WHERE n.delivery < d.delivery)
      - INTERVAL '86400 seconds', ts IS NULL) AS late FROM dealt d""",
)
def _(t: Inputs) -> DataFrame:
    folder, path, checkpoint = (fresh_path(t.spark, f"retention-{n}") for n in ("in", "out", "checkpoint"))
    events = t("events").select("event_id", "ts", F.expr(_DELIVERY).alias("delivery"))
    for delivery in range(3):
        # What has come by now is one epoch, from however many files.
        events.where(F.col("delivery") == delivery).write.mode("append").parquet(f"{folder}/events.parquet")
        stream = jobs.read_stream(t.spark, folder, "events")
        jobs.stream_retention_split(stream, path, checkpoint, available_now=True).awaitTermination()
    kept, late = (jobs.retained(events, path, late).withColumn("late", F.lit(late)) for late in (False, True))
    return kept.union(late).select("event_id", "late")


@named("stream_dedupe", "SELECT event_id, event_type, value FROM events")
def _(t: Inputs) -> DataFrame:
    # At-least-once delivery: everything arrives twice.
    twice = _events(t).unionByName(_events(t))
    once = _finish(t, jobs.stream_dedupe(twice, "event_id"), "dedupe")
    return once.select("event_id", "event_type", "value")


@named(
    "stream_running_eval",
    """SELECT count(*) AS evaluated, round(avg(CAST(exec_match AS INT)), 6) AS execution_accuracy,
      round(avg(CAST(exec_success AS INT)), 6) AS validity_rate FROM v_eval""",
)
def _(t: Inputs) -> DataFrame:
    orders = jobs.read_stream(t.spark, t.folder, "orders")
    ran = (F.col("o_orderkey") % 11 != 0) & (F.col("o_custkey") % 7 != 0)
    rows = orders.select(
        ran.alias("exec_success"), (ran & (F.col("o_custkey") % 3 == 0)).alias("exec_match")
    )
    path, checkpoint = fresh_path(t.spark, "running"), fresh_path(t.spark, "running-checkpoint")

    def write(totals: DataFrame, epoch: int) -> None:
        totals.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    query = (
        jobs.stream_running_eval(rows)
        .writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    # The last epoch has seen everything.
    last = t.spark.read.parquet(path).groupBy().agg(
        F.max_by(F.struct("evaluated", "execution_accuracy", "validity_rate"), "epoch").alias("r")
    )
    return last.select(
        "r.evaluated",
        F.round("r.execution_accuracy", 6).alias("execution_accuracy"),
        F.round("r.validity_rate", 6).alias("validity_rate"),
    )


@named(
    "stream_feedback",
    _LATEST + "SELECT query_id, question, user_feedback FROM v_query_log "
    "LEFT JOIN latest USING (query_id)",
)
def _(t: Inputs) -> DataFrame:
    given = F.expr(
        "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 1 WHEN 'error' THEN -1 "
        "WHEN 'purchase' THEN 0 ELSE 5 END"
    )
    target = F.expr(
        "CAST(floor(event_id / 3) * 2 AS BIGINT) "
        "+ CASE WHEN event_id % 50 = 0 THEN 100000000 ELSE 0 END"
    )
    feedback = _events(t).select(
        F.col("event_id").alias("feedback_id"), target.alias("query_id"),
        given.alias("feedback"), F.col("ts").alias("submitted_at"),
    )
    path, checkpoint = fresh_path(t.spark, "feedback"), fresh_path(t.spark, "feedback-checkpoint")
    table = VersionedTable(t.spark, path)
    jobs.stream_feedback_table(feedback, table, checkpoint, available_now=True).awaitTermination()
    view = jobs.feedback_view(t("v_query_log"), table.read())
    return view.select("query_id", "question", "user_feedback")
