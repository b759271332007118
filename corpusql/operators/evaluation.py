"""Scoring generated queries: roll-ups, result comparison, evaluation runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, MapType, NumericType

from corpusql.functions.scoring import bleu
from corpusql.functions.text import is_valid_syntax
from corpusql.operators.execution import INVALID_SYNTAX, PARALLEL, SECONDS, run_candidates
from corpusql.operators.ranking import with_positions
from corpusql.operators.sizing import broadcast_if_small

BLOCKS_PER_STRETCH = 1_000_000


METRICS = {
    "execution_accuracy": "exec_match",
    "validity_rate": "exec_success",
    "avg_bleu": "bleu",
}


def eval_rollup(rows: DataFrame) -> DataFrame:
    """Metrics overall, per schema and per complexity.

    ``validity_rate`` is the share of queries that ran, not of those that parse.
    Rows are folded by schema and complexity first; the grouping sets then copy
    that small table and not the rows.
    """
    folded = rows.groupBy("schema_name", "complexity").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(F.col(c).cast("double")).alias(f"_sum_{m}") for m, c in METRICS.items()],
        *[F.count(c).alias(f"_n_{m}") for m, c in METRICS.items()],
    )
    level = (
        F.when(F.grouping("schema_name") == 0, "schema_name")
        .when(F.grouping("complexity") == 0, "complexity")
        .otherwise("overall")
    )
    return (
        folded.groupingSets(
            [[], ["schema_name"], ["complexity"]], "schema_name", "complexity"
        )
        .agg(
            level.alias("level"),
            *[
                (F.sum(f"_sum_{m}") / F.nullif(F.sum(f"_n_{m}"), F.lit(0))).alias(m)
                for m in METRICS
            ],
            F.sum("_rows").alias("total_evaluated"),
        )
        .select(
            "level",
            F.when(F.col("level") == "schema_name", F.col("schema_name"))
            .when(F.col("level") == "complexity", F.col("complexity"))
            .alias("value"),
            *METRICS,
            "total_evaluated",
        )
    )


def running_eval(rows: DataFrame, every: int = 10) -> DataFrame:
    """Accuracy and validity so far, after every ``every``-th row of the run.

    ``step`` numbers the rows from 1. Rows are added up per block of ``every``,
    blocks are accumulated within stretches of a million, and stretches are
    shifted by the totals before them, so no task sees the whole run.
    """
    block = F.floor((F.col("step") - 1) / every)
    blocks = (
        rows.groupBy(block.alias("_block"))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum(F.col("exec_match").cast("bigint")).alias("_match"),
            F.sum(F.col("exec_success").cast("bigint")).alias("_ok"),
            F.max("step").alias("_last"),
        )
        .withColumn("_stretch", F.floor(F.col("_block") / BLOCKS_PER_STRETCH))
    )
    sums = ["_n", "_match", "_ok"]
    upto = Window.partitionBy("_stretch").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, 0
    )
    within = blocks.select(
        "_block", "_stretch", "_last", *[F.sum(c).over(upto).alias(c) for c in sums]
    )
    prior = Window.partitionBy(F.lit(0)).orderBy("_stretch").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # One row per 10 million rows of the run.
    shifts = (
        blocks.groupBy("_stretch")
        .agg(*[F.sum(c).alias(c) for c in sums])
        .select("_stretch", *[F.coalesce(F.sum(c).over(prior), F.lit(0)).alias(f"{c}0")
                              for c in sums])
    )
    joined = within.join(broadcast_if_small(shifts), "_stretch", "left")
    total = F.col("_n") + F.col("_n0")
    return joined.where(F.col("_last") % every == 0).select(
        F.col("_last").alias("evaluated"),
        ((F.col("_match") + F.col("_match0")) / total).alias("execution_accuracy"),
        ((F.col("_ok") + F.col("_ok0")) / total).alias("validity_rate"),
    )


# --- result comparison --------------------------------------------------------


def _canonical(df: DataFrame, by_position: bool, digits: int | None) -> DataFrame:
    if len({c for c in df.columns}) != len(df.columns) and not by_position:
        raise ValueError(f"duplicate column names: {df.columns}")
    if by_position:
        df = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    columns = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if digits is not None and isinstance(field.dataType, DoubleType | FloatType):
            value = F.round(value, digits)
        if isinstance(field.dataType, MapType):
            value = F.array_sort(F.map_entries(value))
        columns.append(value.alias(field.name))
    return df.select(*columns)


def _kind(kind: DataType) -> str:
    """What a value can be compared with: numbers with numbers, else its own type."""
    return "number" if isinstance(kind, NumericType) else kind.simpleString()


def result_match(
    left: DataFrame,
    right: DataFrame,
    mode: str = "multiset",
    by_position: bool = False,
    digits: int | None = None,
    order_by: list[str] | None = None,
    compare: list[str] | None = None,
) -> DataFrame:
    """Do two results agree? One row: ``matches`` and the number of differing rows.

    ``multiset`` ignores order, ``set`` also ignores repeats, ``ordered`` compares
    position by position after sorting both sides by ``order_by``, which must be
    a total order. ``compare`` leaves out columns that only serve to sort. Nothing
    is capped. One shuffle; copies of a row are counted before it.
    """
    if mode not in ("multiset", "set", "ordered"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "ordered":
        if not order_by:
            raise ValueError("ordered comparison needs order_by")
        keys = [F.col(c).asc_nulls_last() for c in order_by]
        left, right = (with_positions(side, keys, "_position") for side in (left, right))
        compare = [*compare, "_position"] if compare else None
    if compare:
        left, right = left.select(*compare), right.select(*compare)
    left = _canonical(left, by_position, digits)
    right = _canonical(right, by_position, digits)
    kinds = [{f.name: _kind(f.dataType) for f in side.schema.fields} for side in (left, right)]
    if sorted(left.columns) != sorted(right.columns) or kinds[0] != kinds[1]:
        return left.sparkSession.range(1).select(
            F.lit(False).alias("matches"), F.lit(None).cast("bigint").alias("differing_rows")
        )
    columns = sorted(left.columns)
    tagged = (
        left.select(*columns).withColumn("_side", F.lit(1))
        .unionByName(right.select(*columns).withColumn("_side", F.lit(-1)))
    )
    per_row = tagged.groupBy(*[f"`{c}`" for c in columns])
    if mode == "set":
        differs = per_row.agg(F.max("_side").alias("_hi"), F.min("_side").alias("_lo")).where(
            F.col("_hi") == F.col("_lo")
        )
    else:
        differs = per_row.agg(F.sum("_side").alias("_net")).where(F.col("_net") != 0)
    return differs.agg(F.count(F.lit(1)).alias("differing_rows")).select(
        (F.col("differing_rows") == 0).alias("matches"), "differing_rows"
    )


def execution_outcomes(
    spark: SparkSession,
    candidates: DataFrame | Iterable[tuple[str, str, str]],
    digits: int | None = 9,
    seconds: float = SECONDS,
    parallel: int = PARALLEL,
) -> DataFrame:
    """Run (candidate, reference_sql, generated_sql) and compare the results.

    Each distinct pair of texts runs once, however many candidates share it, ``parallel`` pairs
    at a time. A generated query that has not ended after ``seconds`` is cancelled and did not
    succeed. Only queries are run: commands and writes are refused. As long as the generated query
    ran, a failing reference counts as a match, and ``reference_failed`` tells so. Results that
    cannot be compared, because columns differ in name or kind or a name occurs twice, do not match.
    """
    if not isinstance(candidates, DataFrame):
        candidates = spark.createDataFrame(
            list(candidates), "candidate string, reference_sql string, generated_sql string"
        )

    def compare(reference: DataFrame, generated: DataFrame) -> DataFrame:
        found = result_match(reference, generated, digits=digits)
        return found.select(F.when(F.col("differing_rows").isNotNull(), F.col("matches")).alias("matches"))

    return run_candidates(candidates, compare, seconds, parallel)


def evaluate_pairs(
    pairs: DataFrame,
    outcomes: DataFrame,
    reference: str = "reference_sql",
    generated: str = "generated_sql",
) -> DataFrame:
    """Score every pair; execution verdicts are joined by ``candidate``.

    A pair that is not valid counts as not executed, whatever its verdict says.
    """
    scored = pairs.withColumns(
        {
            "bleu": bleu(F.col(reference), F.col(generated)),
            "valid": is_valid_syntax(F.col(generated)),
        }
    )
    joined = scored.join(outcomes, "candidate", "left")
    ran = F.col("valid") & F.coalesce("exec_success", F.lit(False))
    return joined.withColumns(
        {
            "exec_success": ran,
            "exec_match": ran & F.coalesce("exec_match", F.lit(False)),
            "reference_failed": ran & F.coalesce("reference_failed", F.lit(False)),
            "error": F.when(~F.col("valid"), F.lit(INVALID_SYNTAX)).otherwise(F.col("error")),
        }
    )
