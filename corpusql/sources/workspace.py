"""A folder every executor can reach, for tables a job writes and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local session without the setting, as in tests, gets a temporary folder as
    its checkpoint folder; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    root = (
        spark.conf.get(SETTING, None)
        or context.getConf().get(SETTING, None)
        or context.getCheckpointDir()
    )
    if root:
        return root
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError(f"set {SETTING} to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="corpusql-"))
    return context.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        root = shared_root(spark)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
