"""Structured Streaming jobs over the query log and its events.

Each takes a streaming DataFrame and gives one, so the caller picks source,
sink and trigger; ``stream_batches`` and ``stream_feedback`` bring their sink,
because their result depends on what a micro-batch is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

from corpusql.operators.querylog import filter_failures, filter_feedback
from corpusql.operators.ranking import HOT_ROWS, row_numbers
from corpusql.sources.versions import Conflict, VersionedTable

# Seconds and counts.
METRIC_PERIOD = 300
BATCH_ROWS = 100
BATCH_SECONDS = 60
BATCH_LATENESS = 60
RETENTION = 86_400
REDELIVERY = 300

#: Groups in which a minute of failures waits.
SPREAD = 64

#: Epochs of feedback beside the base before they are folded into it.
FEEDBACK_CHANGES = 20


def read_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A parquet table as a stream, whether it is one file or a folder of files."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    # The glob lets the file source accept a single file too.
    return spark.readStream.schema(schema).parquet(f"{folder}/{table}.parque[t]")


def stream_failures(log: DataFrame) -> DataFrame:
    return filter_failures(log).select(
        "query_id", "schema_name", "question", "execution_error", "created_at"
    )


def metrics(events: DataFrame, time: str, latency: str, period: int = METRIC_PERIOD) -> DataFrame:
    """Invocations and mean latency per period; the same for a table and a stream."""
    return (
        events.groupBy(F.window(time, f"{period} seconds").alias("_w"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(latency).alias("mean_latency"))
        .select("_w.start", "_w.end", "n", "mean_latency")
    )


def stream_metrics(
    events: DataFrame,
    time: str = "ts",
    latency: str = "value",
    period: int = METRIC_PERIOD,
    lateness: str = "10 minutes",
) -> DataFrame:
    """Windows come out once, when the watermark has passed their end.

    The windows still open at the end of the input are withheld.
    """
    # Watermarks need an instant, so wall-clock times are taken as session time.
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    return metrics(timed, time, latency, period)


def stream_retention(
    messages: DataFrame, time: str = "ts", seconds: int = RETENTION, now: str | None = None
) -> DataFrame:
    """Messages not older than ``seconds``, measured at delivery unless ``now`` is given."""
    clock = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    return messages.where(
        F.col(time).cast("timestamp") >= clock - F.make_dt_interval(secs=F.lit(seconds))
    )


def stream_retention_split(
    messages: DataFrame, path: str, checkpoint: str, time: str = "ts", seconds: int = RETENTION,
    available_now: bool = False,
) -> StreamingQuery:
    """Messages by event time: those more than ``seconds`` behind the newest one of earlier epochs
    are late, and kept apart instead of dropped; so are those without a time.

    Each epoch writes its rows once and how far time has come after it, both by epoch number, so
    one that is run again writes the same. ``retained`` reads the result.
    """

    def run(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        before = spark.read.parquet(f"{path}/newest/epoch={epoch - 1}").first().newest if epoch else None
        at = F.col(f"message.`{time}`").cast("timestamp")
        least = F.lit(before).cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds))
        late = F.coalesce(at < least, at.isNull())
        written = f"{path}/rows/epoch={epoch}"
        rows.select(F.struct("*").alias("message")).withColumn("late", late).write.mode("overwrite").partitionBy(
            "late"
        ).parquet(written)
        newest = F.greatest(F.max(at), F.lit(before).cast("timestamp")).alias("newest")
        told = spark.read.schema(StructType([StructField("message", rows.schema)])).parquet(written)
        told.agg(newest).write.mode("overwrite").parquet(f"{path}/newest/epoch={epoch}")

    writer = messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def retained(messages: DataFrame, path: str, late: bool = False) -> DataFrame:
    """What ``stream_retention_split`` has kept of ``messages``, or the late ones."""
    row = StructType([StructField("message", messages.schema), StructField("late", BooleanType())])
    rows = messages.sparkSession.read.schema(row).parquet(f"{path}/rows")
    return rows.where(F.col("late") == late).select("message.*")


def stream_dedupe(
    messages: DataFrame, key: str, time: str = "ts", redelivery: int = REDELIVERY,
    lateness: int = RETENTION,
) -> DataFrame:
    """At-least-once delivery made exactly-once within the redelivery time.

    A message may be up to ``lateness`` seconds behind the newest one, which is as long as
    messages are kept; ids are remembered for that time or the redelivery time, if longer.
    """
    timed = messages.withColumn(time, F.col(time).cast("timestamp"))
    kept = max(redelivery, lateness)
    return timed.withWatermark(time, f"{kept} seconds").dropDuplicatesWithinWatermark([key])


def stream_running_eval(rows: DataFrame) -> DataFrame:
    """Accuracy and validity so far; use update or complete mode."""
    return rows.agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.avg(F.col("exec_match").cast("double")).alias("execution_accuracy"),
        F.avg(F.col("exec_success").cast("double")).alias("validity_rate"),
    )


def failure_batches(
    failures: DataFrame,
    rows: int = BATCH_ROWS,
    seconds: int = BATCH_SECONDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Failures with the batch they are handled in: at most ``rows`` or ``seconds``.

    A minute with very many failures is numbered millisecond by millisecond.
    """
    minute = failures.withColumn("window_start", F.window("created_at", f"{seconds} seconds").start)
    instant = F.date_trunc("millisecond", "created_at")
    order = [F.col("created_at"), F.col("query_id")]
    numbered = row_numbers(minute, ["window_start"], order, instant, "_rn", hot_rows)
    return numbered.withColumn("batch", F.ceil(F.col("_rn") / rows)).drop("_rn")


def closed_minutes(
    failures: DataFrame,
    seconds: int = BATCH_SECONDS,
    lateness: int = BATCH_LATENESS,
    time: str = "created_at",
) -> DataFrame:
    """A stream of failures in which each minute comes whole, once the watermark has passed it.

    Rows wait in the state, a minute spread over ``SPREAD`` groups by a hash, so that a busy one is
    neither one row of state nor one task. A failure more than ``lateness`` seconds behind the
    newest of earlier epochs is too late, and one without a time belongs to no minute; neither
    comes. ``stream_retention_split`` before it keeps such rows apart.
    """
    at = F.col(f"`{time}`").cast("timestamp")
    held = failures.select(at.alias("at"), F.struct("*").alias("message"))
    part = F.pmod(F.xxhash64("message"), F.lit(SPREAD))
    return (
        held.withWatermark("at", f"{lateness} seconds")
        .groupBy(F.window("at", f"{seconds} seconds").alias("minute"), part.alias("part"))
        .agg(F.collect_list("message").alias("messages"))
        .select(F.explode("messages").alias("message"))
        .select("message.*")
    )


def stream_batches(
    failures: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    rows: int = BATCH_ROWS,
    seconds: int = BATCH_SECONDS,
    lateness: int = BATCH_LATENESS,
    available_now: bool = False,
) -> StreamingQuery:
    """Hand batches of failures to ``handle(batches, epoch)``, each minute in one epoch.

    (window_start, batch) names a batch. A minute is handed on when the watermark has passed its
    end, so its batches are the same whatever came in which file, order or epoch, and after a
    restart. The last minutes wait for a later row; one with null in all other columns
    will do (``query_id`` null: it moves the watermark and is in no batch). An epoch may be
    replayed after a failure; write by epoch to stay exactly-once.
    """
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{seconds} seconds"}

    def run(epoch_rows: DataFrame, epoch: int) -> None:
        # Numbering looks at the rows twice; the state is read once.
        epoch_rows = epoch_rows.where(F.col("query_id").isNotNull()).persist()
        try:
            handle(failure_batches(epoch_rows, rows, seconds), epoch)
        finally:
            epoch_rows.unpersist()

    return (
        closed_minutes(failures, seconds, lateness)
        .writeStream.outputMode("append")
        .foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def stream_accepted_feedback(feedback: DataFrame) -> DataFrame:
    """Accepted feedback with its version; which is the last is told on reading, without state."""
    return filter_feedback(feedback).where("accepted").select(
        "query_id",
        F.col("feedback").alias("user_feedback"),
        F.struct("submitted_at", "feedback_id").alias("version"),
    )


def stream_feedback(
    feedback: DataFrame, changes_path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append accepted verdicts; ``feedback_view`` folds them into the log."""
    return run_to_table(stream_accepted_feedback(feedback), changes_path, checkpoint, available_now)


def newest_feedback(changes: DataFrame) -> DataFrame:
    """The last verdict of each query with its version; folding folded rows again changes nothing."""
    last = F.max_by(F.struct("user_feedback", "version"), "version").alias("last")
    return changes.groupBy("query_id").agg(last).select("query_id", "last.*")


def _last_epochs(jobs: list[str]) -> list[str]:
    """Of job ids ``stream/epoch`` the last epoch of each stream."""
    last: dict[str, int] = {}
    for job in jobs:
        name, _, epoch = job.rpartition("/")
        last[name] = max(last.get(name, -1), int(epoch))
    return [f"{name}/{epoch}" for name, epoch in last.items()]


def stream_feedback_table(
    feedback: DataFrame, table: VersionedTable, checkpoint: str, name: str = "feedback",
    changes: int = FEEDBACK_CHANGES, available_now: bool = False,
) -> StreamingQuery:
    """Accepted verdicts into a versioned table: a base and the changes of at most ``changes`` epochs.

    Each epoch adds its newest verdicts; then base and changes are folded into a new base, which one
    commit swaps for them. So ``feedback_view`` over ``table.read()`` folds what is after the base
    and one row for each query before it, however long the stream has run. ``name`` tells the
    streams of a table apart; an epoch that is run again adds nothing.
    """

    def run(epoch_rows: DataFrame, epoch: int) -> None:
        known = [j for j in table.version().jobs if j.rpartition("/")[0] == name]
        if all(int(j.rpartition("/")[2]) < epoch for j in known):
            table.append(newest_feedback(epoch_rows), f"{name}/{epoch}")
        if len(table.version().folders) > changes:
            try:
                table.compact(newest_feedback, _last_epochs)
            except Conflict:
                pass  # another stream's compaction was faster; the next epoch looks again

    writer = stream_accepted_feedback(feedback).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def feedback_view(log: DataFrame, changes: DataFrame) -> DataFrame:
    """The log with the newest verdict of the streamed changes."""
    newest = changes.groupBy("query_id").agg(
        F.max_by("user_feedback", "version").alias("user_feedback")
    )
    return log.join(newest, "query_id", "left")


def run_to_table(
    stream: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Append-mode file sink; exactly-once by the sink's own commit log."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.outputMode("append").start(path)
