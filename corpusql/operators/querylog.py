"""The query log: append, feedback, listings and the audit of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.operators.sizing import broadcast_if_small

# Fixed values.
ERROR_LENGTH = 500
DEFAULT_LIMIT = 50
DEFAULT_DIALECT = "postgresql"
FEEDBACK_VALUES = (1, -1)
MAX_CORRECTIONS = 2


def log_rows(entries: DataFrame) -> DataFrame:
    """Entries as they go into the log: errors cut, empty errors null, defaults set."""
    columns = set(entries.columns)
    out = {
        "execution_error": F.when(
            F.length("execution_error") > 0, F.substring("execution_error", 1, ERROR_LENGTH)
        )
    }
    if "query_id" in columns:
        given = F.col("query_id").cast("string")
        out["query_id"] = F.when(F.length(given) > 0, given).otherwise(F.expr("uuid()"))
    else:
        out["query_id"] = F.expr("uuid()")
    for name, default in (("dialect", F.lit(DEFAULT_DIALECT)), ("correction_attempts", F.lit(0))):
        out[name] = F.coalesce(name, default) if name in columns else default
    if "created_at" not in columns:
        out["created_at"] = F.current_timestamp()
    return entries.withColumns(out)


def filter_schema(rows: DataFrame, schema_name: str) -> DataFrame:
    return rows.where(F.col("schema_name") == schema_name)


def filter_failures(log: DataFrame) -> DataFrame:
    """Rows known to have failed; an unknown outcome is no failure."""
    return log.where(~F.col("execution_success"))


def recent_logs(
    log: DataFrame,
    limit: int = DEFAULT_LIMIT,
    schema_name: str | None = None,
    failures_only: bool = False,
) -> DataFrame:
    """Newest rows; filters come before the limit."""
    if schema_name:
        log = filter_schema(log, schema_name)
    if failures_only:
        log = filter_failures(log)
    return log.orderBy(F.col("created_at").desc_nulls_first(), F.col("query_id")).limit(limit)


def retrain_candidates(log: DataFrame) -> DataFrame:
    return filter_failures(log).select(
        "query_id", "schema_name", "question", "dialect", "execution_error", "created_at"
    )


def schema_list(registry: DataFrame) -> DataFrame:
    """Per schema: number of tables and when the first was registered, by name."""
    return (
        registry.groupBy("schema_name")
        .agg(F.count(F.lit(1)).alias("table_count"), F.min("created_at").alias("created_at"))
        .orderBy(F.col("schema_name").asc_nulls_last())
    )


def filter_feedback(feedback: DataFrame) -> DataFrame:
    """Feedback with ``accepted``; only 1 and -1 are."""
    return feedback.withColumn(
        "accepted", F.coalesce(F.col("feedback").isin(*FEEDBACK_VALUES), F.lit(False))
    )


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """The last accepted feedback per query. Folds repeats before the shuffle."""
    return (
        filter_feedback(feedback)
        .where("accepted")
        .groupBy("query_id")
        .agg(F.max_by("feedback", F.struct("submitted_at", "feedback_id")).alias("user_feedback"))
    )


def feedback_apply(log: DataFrame, feedback: DataFrame) -> DataFrame:
    """The log with ``user_feedback``: a view over two append-only tables."""
    return log.join(latest_feedback(feedback), "query_id", "left")


def feedback_unmatched(feedback: DataFrame, log: DataFrame) -> DataFrame:
    """Accepted feedback about queries the log does not know."""
    known = log.select("query_id")
    return filter_feedback(feedback).where("accepted").drop("accepted").join(
        known, "query_id", "left_anti"
    )


def log_dedupe(log: DataFrame) -> DataFrame:
    """One row per query_id: the earliest, ties by the row's other values."""
    rest = [c for c in log.columns if c not in ("query_id", "created_at")]
    row = F.struct("created_at", *rest)
    return log.groupBy("query_id").agg(F.min(row).alias("_row")).select("query_id", "_row.*")


def attempt_rollup(attempts: DataFrame, max_corrections: int | None = None) -> DataFrame:
    """One row per query from its attempts 0..n: first success, else the last allowed.

    Later attempts are ignored; a limit of 0 or None means 2. One aggregate, its
    buffers hold three rows per query at most, so repeats fold before the shuffle.
    """
    allowed = attempts.where(F.col("attempt") <= (max_corrections or MAX_CORRECTIONS))
    won = F.when(F.col("success"), F.col("attempt"))
    merged = allowed.groupBy("query_id").agg(
        F.min_by("sql", "attempt").alias("original_sql"),
        F.min(won).alias("_won"),
        F.min_by("sql", won).alias("_won_sql"),
        F.max("attempt").alias("_last"),
        F.max_by("sql", "attempt").alias("_last_sql"),
        F.max_by("error", "attempt").alias("_last_error"),
    )
    success = F.col("_won").isNotNull()
    return merged.select(
        "query_id",
        success.alias("success"),
        F.when(success, F.col("_won_sql")).otherwise(F.col("_last_sql")).alias("final_sql"),
        "original_sql",
        F.when(~success, F.col("_last_error")).alias("error"),
        F.coalesce("_won", "_last").alias("correction_attempts"),
    )


def correction_lift(attempts: DataFrame, max_corrections: int | None = None) -> DataFrame:
    """Success rate at the first attempt against the rate after corrections."""
    final = attempt_rollup(attempts, max_corrections)
    first = F.avg((F.col("success") & (F.col("correction_attempts") == 0)).cast("double"))
    after = F.avg(F.col("success").cast("double"))
    return final.agg(
        F.count(F.lit(1)).alias("queries"),
        first.alias("first_attempt_rate"),
        after.alias("corrected_rate"),
        (after - first).alias("lift"),
    )


def registry_replace(registry: DataFrame, schema_name: str, tables: DataFrame) -> DataFrame:
    """The registry with one schema's rows replaced; an empty set removes the schema."""
    kept = registry.where(~F.col("schema_name").eqNullSafe(F.lit(schema_name)))
    return kept.unionByName(
        tables.withColumn("schema_name", F.lit(schema_name)), allowMissingColumns=True
    )
