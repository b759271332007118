"""Registry and query log as parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusql.operators.querylog import log_rows, registry_replace
from corpusql.sources.versions import VersionedTable


def write_registry(registry: DataFrame, path: str) -> None:
    """A registry snapshot, partitioned so that one schema's tables are one folder."""
    registry.write.mode("errorifexists").partitionBy("schema_name").parquet(path)


def replace_schema(
    spark: SparkSession, current: str, target: str, schema_name: str, tables: DataFrame
) -> None:
    """Write a new snapshot with one schema replaced; ``current`` stays readable."""
    write_registry(registry_replace(spark.read.parquet(current), schema_name, tables), target)


def append_log(entries: DataFrame, path: str) -> None:
    log_rows(entries).write.mode("append").parquet(path)


def publish_log(table: VersionedTable, entries: DataFrame, job: str) -> None:
    """Log entries of a job, all of them or none; a job published before is not again."""
    table.append(log_rows(entries), job)
