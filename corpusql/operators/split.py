"""Stratified train/test split of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.operators.ranking import mark_within, quota_cutoffs

STRATA = ["schema_name", "complexity"]
# Hash prefixes of three hex digits make 4,096 ranges of about equal size.
PREFIX = 3


def _shuffle_key(seed: int, purpose: str, id_col: str) -> Column:
    """A repeatable pseudo-random order of the rows, one per seed and purpose."""
    return F.md5(F.concat_ws("|", F.lit(f"{seed}{purpose}"), F.col(id_col).cast("string")))


def stratum_sizes(pairs: DataFrame, strata: list[str], test_size: int) -> DataFrame:
    """Rows per stratum and how many of them the test side asks for.

    A stratum asks for its share of ``test_size``, rounded half to even, and for
    one row at least.
    """
    sizes = pairs.groupBy(*strata).agg(F.count(F.lit(1)).alias("size"))
    total = pairs.select(F.count(F.lit(1))).scalar()
    share = F.col("size") / total * F.lit(test_size)
    return sizes.withColumn("n_test", F.greatest(F.lit(1), F.rint(share)).cast("bigint"))


def mark_test_side(
    pairs: DataFrame,
    test_size: int = 200,
    seed: int = 42,
    strata: list[str] = STRATA,
    id_col: str = "pair_id",
) -> DataFrame:
    """Add ``in_test``. Only ids, strata and hashes are looked at, and no row moves.

    A stratum's test rows are those before its cutoff in hash order; a cutoff is
    one row per stratum.
    """
    place = ["_h", id_col]
    prefix = F.substring("_h", 1, PREFIX)

    def hashed(rows: DataFrame, purpose: str) -> DataFrame:
        return rows.withColumn("_h", _shuffle_key(seed, purpose, id_col))

    narrow = hashed(pairs.select(id_col, *strata), "")
    sizes = stratum_sizes(narrow, strata, test_size).persist()
    ends = quota_cutoffs(narrow, strata, prefix, place, sizes, "n_test").persist()
    marked = mark_within(hashed(pairs, ""), strata, place, ends, "in_test")

    # Rounding up and the one-row minimum may ask for too much: random rows of
    # the test side go back until it has test_size. It is never topped up.
    asked = sizes.agg(F.sum(F.least("n_test", "size"))).first()[0] or 0
    if asked > test_size:
        picked = mark_within(narrow, strata, place, ends, "in_test").where("in_test")
        trim = quota_cutoffs(hashed(picked, "|trim"), [], prefix, place, test_size)
        kept = F.struct(*place) <= trim.select("_cutoff").scalar()
        marked = hashed(marked, "|trim").withColumn("in_test", F.col("in_test") & kept)
    return marked.select(*pairs.columns, "in_test")


def stratified_split(
    pairs: DataFrame,
    test_size: int = 200,
    seed: int = 42,
    strata: list[str] = STRATA,
    id_col: str = "pair_id",
) -> DataFrame:
    """Every pair with ``side`` = ``test`` or ``train``; ``id_col`` must be unique."""
    marked = mark_test_side(pairs, test_size, seed, strata, id_col)
    return marked.withColumn("side", F.when(F.col("in_test"), "test").otherwise("train")).drop(
        "in_test"
    )


def train_side(split: DataFrame) -> DataFrame:
    """The rest of every stratum together with what was trimmed from the test side."""
    return split.where(F.col("side") == "train").drop("side")


def split_report(split: DataFrame) -> DataFrame:
    """Rows per side and schema, and per side and complexity."""
    # Folded first, so that the grouping sets copy a small table.
    folded = split.groupBy("side", "schema_name", "complexity").agg(
        F.count(F.lit(1)).alias("_n")
    )
    return (
        folded.groupingSets(
            [["side", "schema_name"], ["side", "complexity"]], "side", "schema_name", "complexity"
        )
        .agg(
            F.sum("_n").alias("n"),
            F.when(F.grouping("schema_name") == 0, "schema_name")
            .otherwise("complexity")
            .alias("grouped_by"),
        )
        .select(
            "side",
            "grouped_by",
            F.when(F.col("grouped_by") == "schema_name", F.col("schema_name"))
            .otherwise(F.col("complexity"))
            .alias("value"),
            "n",
        )
    )
