"""Vector columns."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.functions.scoring import tokens

WIDTH = 384


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; null for a null vector, NaN for a zero one."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(float("nan"))).otherwise(
        1 - dot(a, b) / F.nullif(norms, F.lit(0.0))
    )


def embed_input(df: DataFrame, text: str, out: str = "embedding", width: int = WIDTH) -> DataFrame:
    """A repeatable stand-in for a sentence model: hashed token counts at unit length."""
    words = df.withColumn("_words", tokens(F.lower(F.coalesce(F.col(text), F.lit("")))))
    counted = HashingTF(numFeatures=width, inputCol="_words", outputCol="_tf").transform(words)
    unit = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(counted)
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_words", "_tf", "_unit")
