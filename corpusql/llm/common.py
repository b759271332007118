"""Helpers shared by the operators: tables in, columns out, work tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.sources.workspace import fresh_path

#: Words everywhere in this package: runs of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Shuffle files go as soon as the job that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and short to recompute.

    The files live until the application ends.
    """
    return _table(df, name, "snappy")


#: Rows that go to Python, and come back, at a time.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def work_table(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """As ``written``, for large tables between steps: packed harder, and the shuffle files behind
    it are given up at once. It lives until ``discard`` or the end of the application.

    ``batch`` bounds the rows of an Arrow batch while it is made, for rows that may be large.
    """
    conf = df.sparkSession.conf
    wanted = {CLEANUP: "true"} | ({BATCH: str(batch)} if batch else {})
    before = {key: conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        conf.set(key, value)
    try:
        return _table(df, name, "zstd")
    finally:
        for key, value in before.items():
            if value is None:
                conf.unset(key)
            else:
                conf.set(key, value)


#: Rows of a file where a table's rows are known, about.
FILE_ROWS = 100_000


def in_few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows, for a table: in a file for each core, or for ``FILE_ROWS`` rows.

    Else a few rows lie in as many files as shuffles have partitions, and each round over them
    opens all of these. Nothing is shuffled; partitions of the last exchange are read together.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(cores, -(-rows // FILE_ROWS)))


def _table(df: DataFrame, name: str, codec: str) -> DataFrame:
    spark = df.sparkSession
    path = fresh_path(spark, f"llm-{name}")
    df.write.option("compression", codec).parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    table = spark.read.schema(df.schema).parquet(path)
    table.work_folder = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``work_table`` or ``written`` that no later job reads."""
    for df in tables:
        spark = df.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.work_folder)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fold(doc_id: Column) -> Column:
    """crc32 of an id written as text, as the held-out folds use it."""
    return F.crc32(doc_id.cast("string").cast("binary"))
