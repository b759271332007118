"""JSON-lines corpora and evaluation results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    DataType,
    DateType,
    DayTimeIntervalType,
    DecimalType,
    TimestampNTZType,
    TimestampType,
    YearMonthIntervalType,
)

from corpusql.sources.schemas import PAIR
from corpusql.sources.versions import VersionedTable

_AS_TEXT = (
    BinaryType,
    DateType,
    DayTimeIntervalType,
    DecimalType,
    TimestampNTZType,
    TimestampType,
    YearMonthIntervalType,
)


def read_corpus(spark: SparkSession, path: str, schema: str = PAIR) -> DataFrame:
    """One record per line; blank lines are skipped, a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _json_value(name: str, data_type: DataType):
    column = F.col(f"`{name}`")
    return column.cast("string") if isinstance(data_type, _AS_TEXT) else column


def write_corpus(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, nulls written, times and decimals as text."""
    values = [_json_value(f.name, f.dataType).alias(f.name) for f in df.schema.fields]
    df.select(*values).write.mode(mode).option("ignoreNullFields", "false").json(path)


def split_ddl(df: DataFrame, ddl: str = "ddl") -> DataFrame:
    """One row per statement of a DDL script, in order, empty ones dropped."""
    from corpusql.functions.text import strip_ws

    others = [c for c in df.columns if c != ddl]
    parts = df.select(*others, F.posexplode(F.split(F.col(ddl), ";")).alias("_pos", "_part"))
    return parts.select(
        *others, F.col("_pos").alias("position"), strip_ws(F.col("_part")).alias("statement")
    ).where(F.length("statement") > 0)


def write_evaluation(rows: DataFrame, root: str, run_name: str) -> None:
    """Detailed evaluation rows under their run name and time; runs never overwrite."""
    stamped = rows.withColumns(
        {"run_name": F.lit(run_name), "evaluated_at": F.current_timestamp().cast("string")}
    )
    stamped.write.mode("append").partitionBy("run_name").option(
        "ignoreNullFields", "false"
    ).json(root)


def publish_evaluation(table: VersionedTable, rows: DataFrame, run_name: str) -> None:
    """Detailed evaluation rows of a run, all of them or none; a run published before is not again."""
    stamped = rows.withColumns(
        {"run_name": F.lit(run_name), "evaluated_at": F.current_timestamp().cast("string")}
    )
    table.append(stamped, run_name)
