"""Filtering, quotas and profiling of a question/SQL corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.functions import text
from corpusql.operators.ranking import mark_within, quota_cutoffs


def filter_missing(pairs: DataFrame) -> DataFrame:
    return pairs.where(~text.is_missing(F.col("sql")) & ~text.is_missing(F.col("question")))


def filter_syntax(pairs: DataFrame) -> DataFrame:
    return pairs.where(text.is_valid_syntax(F.col("sql")))


def filter_dialect(pairs: DataFrame) -> DataFrame:
    return pairs.where(text.is_target_dialect(F.col("sql")))


def reject_reason(executed: Column) -> Column:
    """First failing stage, null for an accepted pair."""
    sql, question = F.col("sql"), F.col("question")
    return (
        F.when(text.is_missing(sql) | text.is_missing(question), F.lit("missing"))
        .when(~text.is_valid_syntax(sql), F.lit("syntax"))
        .when(~text.is_target_dialect(sql), F.lit("dialect"))
        .when(~F.coalesce(executed, F.lit(False)), F.lit("execution"))
    )


ARRIVAL = ["pair_id"]


def mark_quota(
    valid: DataFrame,
    quotas: DataFrame,
    pairs: DataFrame,
    arrival: list[str] = ARRIVAL,
    take: str = "remaining",
    out: str = "within_quota",
) -> DataFrame:
    """Mark ``pairs`` that arrived no later than the last of the quota's ``valid`` pairs.

    ``arrival`` is a total order whose first column is a number.
    """
    # Judging a pair reads its text; its place is all the two passes below need.
    places = valid.select("schema_name", *arrival).persist()
    ends = quota_cutoffs(places, ["schema_name"], None, arrival, quotas, take)
    marked = mark_within(pairs, ["schema_name"], arrival, ends, out)
    places.unpersist()
    return marked


def quota_take(
    valid: DataFrame,
    quotas: DataFrame,
    arrival: list[str] = ARRIVAL,
    take: str = "remaining",
) -> DataFrame:
    """First ``take`` pairs of each schema in arrival order."""
    return (
        mark_quota(valid, quotas, valid, arrival, take)
        .where("within_quota")
        .drop("within_quota")
    )


def reject_funnel(
    pairs: DataFrame,
    executed: Column,
    quotas: DataFrame,
    arrival: list[str] = ARRIVAL,
    take: str = "remaining",
) -> DataFrame:
    """Every pair with its ``reject_reason``; good pairs past the quota are ``over_quota``."""
    judged = pairs.withColumn("reject_reason", reject_reason(executed))
    good = judged.where(F.col("reject_reason").isNull())
    marked = mark_quota(good, quotas, judged, arrival, take)
    over = F.when(~F.col("within_quota"), F.lit("over_quota"))
    return marked.withColumn("reject_reason", F.coalesce("reject_reason", over)).drop(
        "within_quota"
    )


def funnel_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy(
        F.coalesce("reject_reason", F.lit("accepted")).alias("reject_reason")
    ).agg(F.count(F.lit(1)).alias("n"))


def distribution(pairs: DataFrame, column: str, percent: bool = False) -> DataFrame:
    """Count per value, ordered by value; with ``percent`` also the share of all rows."""
    counts = pairs.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if percent:
        # The total of the same counts: their exchange serves twice, the pairs are read once.
        share = F.col("n") * 100 / counts.select(F.sum("n")).scalar()
        counts = counts.withColumn("percent", F.round(share, 1))
    return counts.orderBy(F.col(column).asc_nulls_last())


def feature_coverage(pairs: DataFrame) -> DataFrame:
    """Pairs per feature and percent of all pairs; unused features have no row."""
    names = list(text.SQL_FEATURES)
    sums = [
        F.count(F.when(F.col("_upper").contains(text.SQL_FEATURES[name]), 1)).alias(f"f{i}")
        for i, name in enumerate(names)
    ]
    wide = pairs.select(F.upper("sql").alias("_upper")).agg(F.count(F.lit(1)).alias("total"), *sums)
    long = wide.select(
        "total",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("feature"), F.col(f"f{i}").alias("n"))
                    for i, name in enumerate(names)
                ]
            )
        ),
    )
    return (
        long.where(F.col("n") > 0)
        .select("feature", "n", F.round(F.col("n") * 100 / F.col("total"), 1).alias("percent"))
        .orderBy(F.col("n").desc(), F.col("feature"))
    )


def sample_per_complexity(pairs: DataFrame, limit: int = 4) -> DataFrame:
    """First pair of each complexity; the ``limit`` that come first in the corpus.

    The first ids are found by a hash aggregate over ids alone, then looked up.
    """
    firsts = pairs.groupBy("complexity").agg(F.min("pair_id").alias("pair_id"))
    wanted = firsts.orderBy("pair_id").limit(limit).select("pair_id")
    return pairs.join(F.broadcast(wanted), "pair_id", "left_semi").orderBy("pair_id")


def quality_issues(pairs: DataFrame) -> DataFrame:
    """One row per pair and kind of issue. Blank text is not missing here."""
    sql, question = F.col("sql"), F.col("question")
    empty = lambda c: F.coalesce(F.length(c) == 0, F.lit(True))
    kinds = F.array_compact(
        F.array(
            F.when(empty(sql), F.lit("missing SQL")),
            F.when(empty(question), F.lit("missing question")),
            F.when(F.lower(sql).contains("strftime"), F.lit("SQLite syntax detected (strftime)")),
        )
    )
    return pairs.select("pair_id", F.explode(kinds).alias("issue"))


def first_issues(issues: DataFrame, shown: int = 10) -> DataFrame:
    """The first issues in corpus order, each with the total found."""
    total = issues.agg(F.count(F.lit(1)).alias("total")).scalar()
    rank = (
        F.when(F.col("issue") == "missing SQL", 0)
        .when(F.col("issue") == "missing question", 1)
        .otherwise(2)
    )
    return issues.orderBy("pair_id", rank).limit(shown).withColumn("total", total)


def success_rate(pairs: DataFrame, accepted: Column) -> DataFrame:
    """Accepted per attempt in percent, one decimal, per schema."""
    return (
        pairs.groupBy("schema_name")
        .agg(
            F.count(F.lit(1)).alias("attempts"),
            F.count(F.when(accepted, 1)).alias("validated"),
        )
        .withColumn(
            "success_rate",
            F.round(F.col("validated") * 100 / F.greatest("attempts", F.lit(1)), 1),
        )
    )


def parse_batch(responses: DataFrame, response: str = "response") -> DataFrame:
    """Model responses to pairs; a response without a JSON array is one error row."""
    schema = "array<struct<question:string,chain_of_thought:string,sql:string>>"
    parsed = responses.withColumn("_json", text.json_array_text(F.col(response))).withColumn(
        "_pairs", F.from_json("_json", schema, {"mode": "PERMISSIVE"})
    )
    keep = [c for c in responses.columns if c != response]
    return parsed.select(
        *keep,
        F.when(F.col("_json") == "", F.lit("No JSON array found in response"))
        .when(F.col("_pairs").isNull(), F.lit("Malformed JSON array in response"))
        .alias("parse_error"),
        F.posexplode_outer("_pairs").alias("item", "_pair"),
    ).select(
        *keep,
        "parse_error",
        "item",
        *[
            text.strip_ws(F.coalesce(F.col(f"_pair.{c}"), F.lit(""))).alias(c)
            for c in ("question", "chain_of_thought", "sql")
        ],
    )
