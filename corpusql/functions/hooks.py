"""Where a user plugs in a model: a generator over prompts, an embedder over texts."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from corpusql.functions.text import FENCE, route_question, template_sql
from corpusql.functions.vectors import embed_input

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def batch_generate(
    prompts: DataFrame,
    generate: Callable[[pd.Series, pd.Series], pd.Series] | None = None,
    out: str = "response",
) -> DataFrame:
    """Add a raw response per row of (``question``, ``prompt``, ...).

    ``generate(questions, prompts)`` gets Arrow batches. Without one the keyword
    router answers with a fenced template, in plain Spark expressions.
    """
    if generate is None:
        sql = template_sql(route_question(F.col("question")))
        return prompts.withColumn(
            out, F.concat(F.lit(f"{FENCE}sql\n"), sql, F.lit(f"\n{FENCE}"))
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{out: generate(batch["question"], batch["prompt"])})

    schema = StructType([*prompts.schema.fields, StructField(out, StringType())])
    return prompts.mapInPandas(run, schema)


def batch_embed(
    df: DataFrame,
    text: str,
    embed: Callable[[pd.Series], pd.Series] | None = None,
    out: str = "embedding",
) -> DataFrame:
    """Add a vector per text; without an embedder the hashed stand-in is used."""
    if embed is None:
        return embed_input(df, text, out)
    vectors = F.pandas_udf(embed, ArrayType(FloatType()))
    return df.withColumn(out, vectors(F.col(text)))
