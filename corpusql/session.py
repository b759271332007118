"""Session settings shared by the jobs, the tests and the bench."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app_name: str = "corpusql",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """A UTC session with adaptive execution on.

    ``master`` and ``shuffle_partitions`` stay unset on a cluster, where they
    come from spark-submit; tests pass ``local[8]`` and 8.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Candidates that run side by side share the cluster, whatever one of them asks for.
        .config("spark.scheduler.mode", "FAIR")
        # Streaming state (ids seen, latest feedback) outgrows the heap.
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
