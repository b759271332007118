"""Running generated queries side by side, each under a deadline.

The candidates are the distinct pairs of texts of a table. They come to the driver in lots as a
stream, ``parallel`` of a lot run at a time, and a lot's verdicts go to a table, so the driver
holds one lot of texts whatever the table's size. Every candidate's jobs carry a tag of their
own; when its seconds are over, jobs with that tag are cancelled until it gives up. As it may
have waited for its neighbours' tasks only, it then runs once more with no other beside it, and
that decides. Under a fair scheduler each place of the pool has a share of its own.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.sources.workspace import fresh_path

INVALID_SYNTAX = "Invalid SQL syntax"
SECONDS = 60.0
PARALLEL = 4
#: Candidates on the driver at a time, whose verdicts are written together.
LOT = 500
#: A late candidate's jobs are cancelled so often, as a plan may start further ones.
CANCEL_EVERY = 0.2

_TEXTS = "reference_sql string, generated_sql string"
_VERDICT = "exec_success boolean, exec_match boolean, reference_failed boolean, error string"


class TooLate(Exception):
    """The candidate did not end within its seconds."""


def within(spark: SparkSession, seconds: float, work: Callable):
    """What ``work`` returns; ``TooLate`` if its jobs had to be cancelled after ``seconds``."""
    context = spark.sparkContext
    tag = f"candidate-{uuid.uuid4().hex}"
    ended, late = threading.Event(), threading.Event()

    def watch() -> None:
        if not ended.wait(seconds):
            late.set()
            while not ended.wait(CANCEL_EVERY):
                context.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=inheritable_thread_target(spark)(watch), daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        return work()
    except Exception as failure:
        if late.is_set():
            raise TooLate(f"stopped after {seconds:g} seconds") from failure
        raise
    finally:
        ended.set()
        watcher.join()
        context.removeJobTag(tag)


def as_query(spark: SparkSession, sql: str | None) -> DataFrame:
    """The text as a DataFrame, analysed and not run.

    It stands in a subquery, where commands and writes are no SQL, so that nothing but reading
    gets past the parser. The line feed ends a comment the text may close with.
    """
    return spark.sql(f"SELECT * FROM (\n{(sql or '').rstrip('; \t\r\n')}\n) AS candidate")


def _line(failure: Exception) -> str:
    return str(failure).split("\n", 1)[0]


def verdict(
    spark: SparkSession, reference_sql: str, generated_sql: str, compare: Callable, seconds: float, last: bool
) -> tuple[bool, bool, bool, str | None]:
    """exec_success, exec_match, reference_failed and error of one pair of texts.

    ``compare(reference, generated)`` gives a one-row DataFrame with ``matches``, null where the
    two cannot be compared. Both sides run in its one job, within twice the seconds; only if that
    fails does the generated query run alone, within its own, to see which side it was. ``TooLate``
    is raised unless this is the ``last`` go.
    """
    if not (generated_sql or "").strip("; \t\r\n"):
        return False, False, False, INVALID_SYNTAX
    try:
        generated = as_query(spark, generated_sql)
    except PySparkException as failure:
        return False, False, False, _line(failure)
    try:
        reference = as_query(spark, reference_sql)
    except PySparkException:
        reference = None
    incomparable = False
    if reference is not None:
        try:
            matches = within(spark, 2 * seconds, lambda: compare(reference, generated).first()["matches"])
            if matches is not None:
                return True, bool(matches), False, None
            incomparable = True
        except ValueError:
            incomparable = True
        except (PySparkException, TooLate) as failure:
            if isinstance(failure, TooLate) and not last:
                raise  # else which side it was is found below
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    try:
        within(spark, seconds, lambda: run(generated))
    except (PySparkException, TooLate) as failure:
        if isinstance(failure, TooLate) and not last:
            raise
        return False, False, False, _line(failure)
    if not incomparable:
        return True, True, True, None
    try:
        within(spark, seconds, lambda: run(reference))
    except (PySparkException, TooLate) as failure:
        if isinstance(failure, TooLate) and not last:
            raise
        return True, True, True, None
    return True, False, False, None


def _verdicts(spark: SparkSession, lot: list[tuple[str, str]], judge: Callable, parallel: int) -> list[tuple]:
    """Verdicts of a lot: side by side first, then those that were late one by one."""
    def one(pair: tuple[str, str]) -> tuple | None:
        name = threading.current_thread().name
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
        try:
            return judge(*pair, False)
        except TooLate:
            return None

    with ThreadPoolExecutor(parallel, "candidates") as pool:
        found = list(pool.map(inheritable_thread_target(spark)(one), lot))
    return [(*pair, *(first or judge(*pair, True))) for pair, first in zip(lot, found)]


def run_candidates(
    candidates: DataFrame, compare: Callable, seconds: float = SECONDS, parallel: int = PARALLEL
) -> DataFrame:
    """``candidate`` and its verdict, for a table of candidate, reference_sql and generated_sql.

    Equal pairs of texts run once (null: empty). Repeated candidates give a row each.
    """
    spark = candidates.sparkSession
    keyed = candidates.select(
        "candidate", *(F.coalesce(c, F.lit("")).alias(c) for c in ("reference_sql", "generated_sql"))
    )
    texts = keyed.select("reference_sql", "generated_sql").distinct()
    path = fresh_path(spark, "verdicts")
    schema = f"{_TEXTS}, {_VERDICT}"
    spark.createDataFrame([], schema).write.parquet(path)
    pairs = ((r[0], r[1]) for r in texts.toLocalIterator())
    judge = lambda a, b, last: verdict(spark, a, b, compare, seconds, last)
    while lot := list(islice(pairs, LOT)):
        rows = spark.createDataFrame(_verdicts(spark, lot, judge, parallel), schema)
        rows.coalesce(1).write.mode("append").parquet(path)
    verdicts = spark.read.schema(schema).parquet(path)
    return keyed.join(verdicts, ["reference_sql", "generated_sql"]).drop("reference_sql", "generated_sql")
