"""End-to-end jobs: questions to checked SQL, raw responses to corpus, corpus to metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.functions.hooks import batch_embed, batch_generate
from corpusql.functions.prompts import build_prompts, enrich_ddl, eval_prompt, table_text
from corpusql.functions.text import extract_sql, sanitize_sql
from corpusql.operators.corpus import parse_batch, reject_funnel
from corpusql.operators.evaluation import eval_rollup, evaluate_pairs
from corpusql.operators.planning import resume_append, schema_status
from corpusql.operators.querylog import registry_replace
from corpusql.operators.retrieval import retrieval_batch


def _with_sql(responses: DataFrame) -> DataFrame:
    parsed = responses.withColumn("_x", extract_sql(F.col("response")))
    return parsed.withColumns(
        {"sql": sanitize_sql(F.col("_x.sql")), "explanation": F.col("_x.explanation")}
    ).drop("_x", "response")


def register_schema(
    registry: DataFrame, schema_name: str, tables: DataFrame, embed: Callable | None = None
) -> DataFrame:
    """The registry with a schema's tables replaced, each embedded by its text."""
    described = tables.withColumn(
        "_text", table_text(F.col("table_name"), F.col("description"), F.col("ddl"))
    )
    embedded = batch_embed(described, "_text", embed).drop("_text")
    return registry_replace(registry, schema_name, embedded)


def answer_questions(
    questions: DataFrame,
    registry: DataFrame,
    generate: Callable | None = None,
    dialect: str = "postgresql",
    k: int | None = None,
) -> DataFrame:
    """Retrieve, build prompts, generate and extract SQL for a table of questions."""
    ranked = retrieval_batch(questions, registry, k)
    if "sample_values" not in ranked.columns:
        ranked = ranked.withColumn(
            "sample_values", F.lit(None).cast("map<string,array<string>>")
        )
    ranked = ranked.withColumn(
        "table_ddl", enrich_ddl(F.col("ddl"), F.col("description"), F.col("sample_values"))
    )
    return _with_sql(batch_generate(build_prompts(ranked, dialect), generate))


def build_corpus(
    responses: DataFrame, existing: DataFrame, total_pairs: int, executed: Column
) -> DataFrame:
    """New pairs from raw responses: parsed, filtered, within what each schema lacks.

    ``responses`` carries ``pair_id`` (arrival order), ``schema_name``, ``complexity``.
    """
    pairs = parse_batch(responses).where(F.col("parse_error").isNull()).drop("parse_error")
    quotas = schema_status(existing, total_pairs)
    # A response holds several pairs; they arrive in the order they stand there.
    judged = reject_funnel(pairs, executed, quotas, ["pair_id", "item"])
    accepted = judged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return resume_append(existing, accepted, total_pairs)


def evaluate_run(
    pairs: DataFrame, outcomes: DataFrame, generate: Callable | None = None
) -> tuple[DataFrame, DataFrame]:
    """Prompt, generate, score: the detailed rows and their roll-up."""
    prompted = pairs.withColumn("prompt", eval_prompt(F.col("schema_ddl"), F.col("question")))
    answered = _with_sql(
        batch_generate(prompted.withColumnRenamed("sql", "reference_sql"), generate)
    )
    rows = evaluate_pairs(answered.withColumnRenamed("sql", "generated_sql"), outcomes)
    return rows, eval_rollup(rows)
