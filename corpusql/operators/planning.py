"""What is missing from a corpus, and appending to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.functions.prompts import generation_prompt
from corpusql.operators.sizing import broadcast_if_small

# --- fixed values -------------------------------------------------------------

SCHEMAS = ("ecommerce", "saas_analytics", "healthcare", "fintech", "hr_system")

# complexity -> (weight, description, features a query of it should use)
COMPLEXITY_TARGETS = {
    "simple": (
        0.25,
        "Basic SELECT with WHERE, ORDER BY, LIMIT",
        ["ILIKE", "BOOLEAN comparisons", "TIMESTAMP comparisons"],
    ),
    "moderate": (
        0.35,
        "JOINs, GROUP BY, HAVING, basic aggregations",
        ["DATE_TRUNC", "EXTRACT", "COALESCE", "NULLIF"],
    ),
    "complex": (
        0.25,
        "CTEs, window functions, subqueries",
        [
            "WITH ... AS (CTE)",
            "ROW_NUMBER() OVER (PARTITION BY ... ORDER BY ...)",
            "LAG/LEAD window functions",
            "RANK() / DENSE_RANK()",
        ],
    ),
    "highly_complex": (
        0.15,
        "Multiple CTEs, complex window functions, JSONB queries",
        ["Multiple CTEs", "JSONB operators (->, ->>)", "ARRAY_AGG", "STRING_AGG",
         "FILTER clause on aggregates"],
    ),
}
REMAINDER_GOES_TO = "moderate"
ATTEMPTS_PER_PAIR = 4
BATCH_SIZE = 10
SPARE_PAIRS = 5


#: Batches a task numbers at a time.
STRETCH = 10_000


def complexity_targets(spark: SparkSession) -> DataFrame:
    rows = [(name, *spec) for name, spec in COMPLEXITY_TARGETS.items()]
    return spark.createDataFrame(
        rows, "complexity string, weight double, description string, features array<string>"
    )


def schema_status(
    existing: DataFrame, total_pairs: int, schemas: tuple[str, ...] = SCHEMAS
) -> DataFrame:
    """Per schema: target, rows there are, rows missing, and done / partial / new."""
    spark = existing.sparkSession
    wanted = spark.createDataFrame([(s,) for s in schemas], "schema_name string")
    target = total_pairs // len(schemas)
    have = existing.groupBy("schema_name").agg(F.count(F.lit(1)).alias("have"))
    return wanted.join(have, "schema_name", "left").select(
        "schema_name",
        F.lit(target).cast("bigint").alias("target"),
        F.coalesce("have", F.lit(0)).alias("have"),
        F.greatest(F.lit(target) - F.coalesce("have", F.lit(0)), F.lit(0)).alias("remaining"),
        F.when(F.col("have") >= target, "done")
        .when(F.col("have") > 0, "partial")
        .otherwise("new")
        .alias("status"),
    )


def generation_plan(
    existing: DataFrame, total_pairs: int, schemas: tuple[str, ...] = SCHEMAS
) -> DataFrame:
    """Pairs still to make per schema and complexity, with the attempt budget."""
    status = schema_status(existing, total_pairs, schemas)
    planned = {
        name: F.floor(F.col("remaining") * F.lit(weight))
        for name, (weight, _, _) in COMPLEXITY_TARGETS.items()
    }
    rest = F.col("remaining") - sum(planned.values(), F.lit(0))
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("complexity"),
                (n + rest if name == REMAINDER_GOES_TO else n).cast("bigint").alias("planned"),
            )
            for name, n in planned.items()
        ]
    )
    return status.select(
        "schema_name",
        "status",
        "have",
        "remaining",
        (F.col("remaining") * ATTEMPTS_PER_PAIR).alias("attempt_budget"),
        F.inline(rows),
    )


def generation_prompts(
    plan: DataFrame, schemas: DataFrame, batch_size: int = BATCH_SIZE
) -> DataFrame:
    """One request per batch the plan still needs.

    ``schemas`` has ``schema_name``, ``schema_ddl`` and ``sample_values``. A batch asks
    for ``batch_size`` pairs, the last one for what is left and a few to spare.
    """
    batches = F.ceil(F.col("planned") / batch_size).cast("int")
    left = F.col("planned") - (F.col("batch") - 1) * batch_size
    numbered = (
        plan.where(F.col("planned") > 0)
        .select("schema_name", "complexity", "planned", batches.alias("_all"),
                F.explode(F.sequence(F.lit(0), F.floor((batches - 1) / STRETCH))).alias("_stretch"))
        # Stretches of one schema go to many tasks before their batches are made.
        .repartition("schema_name", "complexity", "_stretch")
        .select("schema_name", "complexity", "planned",
                F.explode(F.sequence(F.col("_stretch") * STRETCH + 1,
                                     F.least((F.col("_stretch") + 1) * STRETCH, "_all"))).alias("batch"))
        .withColumn("batch", F.col("batch").cast("int"))
        .withColumn("batch_size", F.least(F.lit(batch_size), left + SPARE_PAIRS).cast("int"))
    )
    # Four constant rows.
    targets = F.broadcast(complexity_targets(plan.sparkSession))
    asked = numbered.join(targets, "complexity").join(broadcast_if_small(schemas), "schema_name")
    return asked.select(
        "schema_name",
        "complexity",
        "batch",
        "batch_size",
        generation_prompt(
            *[F.col(c) for c in ("schema_ddl", "sample_values", "batch_size", "complexity",
                                 "description", "features")]
        ).alias("prompt"),
    )


def resume_append(existing: DataFrame, new: DataFrame, total_pairs: int,
                  schemas: tuple[str, ...] = SCHEMAS) -> DataFrame:
    """New pairs but those of finished schemas; append them to the corpus.

    Schemas beyond ``schemas`` have no target, so their pairs are never finished and stay.

    The corpus already written is not rewritten and not part of the result.
    """
    done = schema_status(existing, total_pairs, schemas).where(F.col("status") == "done")
    # At most one row per schema of the argument.
    return new.join(F.broadcast(done.select("schema_name")), "schema_name", "left_anti")
