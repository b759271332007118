"""From documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.llm.common import written
from corpusql.llm.language_id import UNKNOWN, identified, learn, length_class, limits
from corpusql.llm.line_dedup import without_recurring_lines
from corpusql.llm.near_copies import one_of_each
from corpusql.llm.packing import packed
from corpusql.llm.substring_dedup import without_repeats

#: Texts at a wider angle than this to every language are rejected at any length; longer ones
#: have limits learned from the table.
MIN_COSINE = 0.05


def _bare(docs: DataFrame) -> DataFrame:
    """doc_id and text, and the other columns in one struct, whose names no operator can meet."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("doc_id"), *rest).alias("row"))


def _restored(bare: DataFrame, columns: list[str], text=None, **replaced) -> DataFrame:
    """The columns of the documents again, ``text`` in place of theirs, n_chars counted anew."""
    own = {c: F.col("row").getField(c) for c in columns} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if text is not None:
        own["text"] = text
        replaced["n_chars"] = F.length(text).cast("long")
    own |= {c: v for c, v in replaced.items() if c in columns}
    return bare.select(*(own[c].alias(c) for c in columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in a known language, and names it in ``lang``.

    Texts that are null, have no letters or are far from every language go. How far is learned:
    the longer a text in a known language, the nearer it is.
    """
    langs, prototypes = learn(docs)
    least = F.lit(MIN_COSINE)
    for size, cosine in limits(docs, langs, prototypes):
        least = F.when(length_class(F.col("text")) >= size, max(MIN_COSINE, cosine)).otherwise(least)
    found = identified(_bare(docs), langs, prototypes)
    return _restored(
        found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)), docs.columns, lang=F.col("lang_pred")
    )


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines whose template recurs across documents. Every document stays."""
    return _restored(without_recurring_lines(_bare(docs)), docs.columns, F.col("kept_text"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one of smallest id.

    Near copies have a Jaccard index of 0.8 or more over five-word shingles. SimHash fingerprints
    join the nearest, a prefix join finds the rest. Rows without a doc_id stay.
    """
    return one_of_each(docs).select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops words in passages that a document of smaller id has too. Every document stays."""
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return _restored(without_repeats(_bare(docs)), docs.columns, text)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and the sequences they stand in."""
    return packed(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_and_prefix_join", near_copies),
    ("substring_dedup", passages),
    ("packing", packing),
]

#: SQL has neither the language profiles nor the hash and the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is a table before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
