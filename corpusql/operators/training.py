"""Training records: prompt and answer tokens cut to a fixed length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.functions.prompts import training_prompt
from corpusql.functions.scoring import tokens
from corpusql.operators.vocabulary import MIN_COUNT, encoded, token_dictionary

# Fixed values.
MAX_LENGTH = 512
MASKED = -100
PAD_ID = 0


def token_ids(words: Column) -> Column:
    """Repeatable ids (1 .. 2^28) for tokens when no vocabulary is given."""
    return F.transform(
        words,
        lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int") + F.lit(1),
    )


def _token_columns(pairs: DataFrame, ddl: str, question: str, answer: str) -> DataFrame:
    # The prompt ends in a line break, so no token spans prompt and answer.
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return pairs.withColumns(
        {
            "_prompt": tokens(training_prompt(text(ddl), text(question))),
            "_answer": tokens(text(answer)),
        }
    )


def training_counts(
    pairs: DataFrame,
    ddl: str = "schema_ddl",
    question: str = "question",
    answer: str = "sql",
    max_length: int = MAX_LENGTH,
) -> DataFrame:
    """Lengths of the record each pair makes, without making it.

    ``dead`` records train nothing: the prompt alone fills the window.
    """
    sized = _token_columns(pairs, ddl, question, answer).withColumns(
        {"prompt_tokens": F.size("_prompt"), "answer_tokens": F.size("_answer")}
    )
    full = F.col("prompt_tokens") + F.col("answer_tokens")
    cut = lambda n: F.least(n, F.lit(max_length))
    return (
        sized.withColumn("full_tokens", full)
        .withColumn(
            "n_train",
            F.greatest(F.lit(0), cut(F.col("full_tokens")) - cut(F.col("prompt_tokens"))),
        )
        .withColumns(
            {
                "n_masked": F.lit(max_length) - F.col("n_train"),
                "truncated": F.col("full_tokens") > max_length,
                "dead": F.col("n_train") == 0,
            }
        )
        .drop("_prompt", "_answer", "answer_tokens")
    )


def record_dictionary(
    pairs: DataFrame,
    ddl: str = "schema_ddl",
    question: str = "question",
    answer: str = "sql",
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """Dense ids by frequency for the tokens of whole prompts and answers."""
    texts = _token_columns(pairs, ddl, question, answer)
    return token_dictionary(texts.select(F.concat("_prompt", "_answer").alias("tokens")), "tokens", min_count)


def training_records(
    pairs: DataFrame,
    ddl: str = "schema_ddl",
    question: str = "question",
    answer: str = "sql",
    max_length: int = MAX_LENGTH,
    dictionary: DataFrame | None = None,
) -> DataFrame:
    """``input_ids``, ``attention_mask`` and ``labels``, each ``max_length`` long.

    With a ``dictionary`` (token, id) no two tokens share an id; without one ids are hashes.
    """
    prompt = F.slice(F.col("_prompt"), 1, max_length)
    kept = F.slice(F.concat("_prompt", "_answer"), 1, max_length)
    cut = _token_columns(pairs, ddl, question, answer).select(
        *pairs.columns,
        F.size(prompt).alias("_p"),
        (token_ids(kept) if dictionary is None else kept).alias("_ids"),
    )
    if dictionary is not None:
        cut = encoded(cut.withColumnRenamed("_ids", "_kept"), "_kept", dictionary, "_ids")
    used = F.size("_ids")
    pad = F.lit(max_length) - used
    return cut.select(
        *pairs.columns,
        F.concat("_ids", F.array_repeat(F.lit(PAD_ID), pad)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), pad)).alias(
            "attention_mask"
        ),
        F.concat(
            F.array_repeat(F.lit(MASKED), F.col("_p")),
            F.slice("_ids", F.col("_p") + 1, F.greatest(used - F.col("_p"), F.lit(0))),
            F.array_repeat(F.lit(MASKED), pad),
        ).alias("labels"),
    )


def rate_dead_records(counts: DataFrame, by: str = "schema_name") -> DataFrame:
    """Share of truncated and of dead records."""
    return counts.groupBy(by).agg(
        F.count(F.lit(1)).alias("records"),
        F.avg(F.col("truncated").cast("double")).alias("truncated_rate"),
        F.avg(F.col("dead").cast("double")).alias("dead_rate"),
    )
