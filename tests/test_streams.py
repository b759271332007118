from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusql.sources.versions import Conflict, VersionedTable
from corpusql.streaming import jobs

T0 = datetime(2024, 1, 1)
SCHEMA = "query_id bigint, created_at timestamp, value double"


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, stream, tmp_path, name):
    out, check = str(tmp_path / name), str(tmp_path / f"{name}-check")
    jobs.run_to_table(stream, out, check, available_now=True).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@pytest.fixture
def messages(spark, tmp_path):
    folder = str(tmp_path / "messages.parquet")
    write(spark, folder, [(i, T0 + timedelta(seconds=37 * i), float(i)) for i in range(200)])
    return folder


def stream(spark, folder):
    return jobs.read_stream(spark, folder.rsplit("/", 1)[0], "messages")


def test_metrics_match_batch_on_closed_windows(spark, messages, tmp_path):
    got = run(spark, jobs.stream_metrics(stream(spark, messages), "created_at"), tmp_path, "m")
    table = spark.read.parquet(messages)
    closed = T0 + timedelta(seconds=37 * 199) - timedelta(minutes=10)
    want = jobs.metrics(table, "created_at", "value").where(F.col("end") <= F.lit(closed))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 10


def test_metrics_resume_from_checkpoint(spark, messages, tmp_path):
    metrics = lambda: jobs.stream_metrics(stream(spark, messages), "created_at")
    first = run(spark, metrics(), tmp_path, "m").count()
    later = T0 + timedelta(days=1)
    write(spark, messages, [(500, later, 1.0)])
    rows = run(spark, metrics(), tmp_path, "m")
    # Everything before the jump is closed now, each window once.
    assert rows.count() > first and rows.agg(F.sum("n")).first()[0] == 200


def test_dedupe(spark, messages, tmp_path):
    twice = stream(spark, messages).unionByName(stream(spark, messages))
    once = run(spark, jobs.stream_dedupe(twice, "query_id", "created_at"), tmp_path, "d")
    assert sorted(r["query_id"] for r in once.collect()) == list(range(200))


def test_retention(spark, messages, tmp_path):
    kept = jobs.stream_retention(stream(spark, messages), "created_at", 3600, "2024-01-01 01:30:00")
    rows = run(spark, kept, tmp_path, "r").collect()
    assert {r["query_id"] for r in rows} == {i for i in range(200) if 37 * i >= 1800}
    live = run(spark, jobs.stream_retention(stream(spark, messages), "created_at"), tmp_path, "n")
    assert live.count() == 0


def test_late_messages_are_kept_apart(spark, tmp_path):
    folder, path = str(tmp_path / "messages.parquet"), str(tmp_path / "out")
    schema = "query_id bigint, late string, created_at timestamp"
    hours = [[(1, 50), (2, 10)], [(3, 60), (4, 25), (5, 26), (None, 40)], [(6, 35), (7, 36), (8, None)], []]

    def deliver(check):
        messages = stream(spark, folder)
        jobs.stream_retention_split(messages, path, check, "created_at", available_now=True).awaitTermination()
        return [
            sorted((r.query_id or 0, r.late) for r in jobs.retained(messages, path, late).collect()) for late in (False, True)
        ]

    for rows in hours:
        sent = [(i, "own", None if h is None else T0 + timedelta(hours=h)) for i, h in rows]
        spark.createDataFrame(sent, schema).coalesce(2).write.mode("append").parquet(folder)
        kept, late = deliver(str(tmp_path / "check"))
    # One epoch has no earlier one to be late for; the limit itself is in time.
    assert [i for i, _ in kept] == [0, 1, 2, 3, 5, 7] and [i for i, _ in late] == [4, 6, 8]
    assert {own for _, own in kept + late} == {"own"}

    # An epoch that dies after writing and runs again writes the same.
    last = sorted(p.name for p in (tmp_path / "check" / "commits").glob("[0-9]*"))[-1]
    (tmp_path / "check" / "commits" / last).rename(tmp_path / "lost")
    (tmp_path / "check" / "commits" / f".{last}.crc").rename(tmp_path / "lost.crc")
    assert deliver(str(tmp_path / "check")) == [kept, late]


@pytest.mark.parametrize("hot_rows", [50, 10_000])
def test_failure_batches(spark, hot_rows):
    minute = [(i, T0 + timedelta(seconds=(i * 7) % 60), 0.0) for i in range(430)]
    rest = [(1000 + i, T0 + timedelta(minutes=5 + i), 0.0) for i in range(5)]
    df = spark.createDataFrame(minute + rest, SCHEMA)
    got = jobs.failure_batches(df, 100, 60, hot_rows).collect()
    assert len(got) == 435
    want = sorted(minute, key=lambda r: (r[1], r[0]))
    place = {r[0]: n // 100 + 1 for n, r in enumerate(want)}
    assert {r["query_id"]: r["batch"] for r in got if r["query_id"] < 1000} == place
    assert all(r["batch"] == 1 for r in got if r["query_id"] >= 1000)


def batches_of(spark, tmp_path, name, deliveries):
    """What ``stream_batches`` makes of files that come one after another, a run for each."""
    base, out = str(tmp_path / name), tmp_path / f"{name}-out"
    stream_schema = "query_id bigint, created_at timestamp, note string"

    def handle(batches, epoch):
        batches.select("query_id", "window_start", "batch", "note").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    for rows in deliveries:
        spark.createDataFrame(rows, stream_schema).coalesce(1).write.mode("append").parquet(f"{base}/messages.parquet")
        failures = jobs.read_stream(spark, base, "messages")
        jobs.stream_batches(failures, handle, str(tmp_path / f"{name}-check"), available_now=True).awaitTermination()
    found = spark.read.parquet(str(out)).select("query_id", "window_start", "batch", "note").collect()
    return sorted(map(tuple, found))


def test_batches_do_not_depend_on_epochs(spark, tmp_path):
    # Two busy minutes and some quiet ones; rows of a minute are out of order.
    rows = [(i, T0 + timedelta(seconds=(i * 37) % 120), f"n{i}") for i in range(500)]
    rows += [(1000 + i, T0 + timedelta(minutes=3 + i), None) for i in range(4)]
    rows += [(rows[7][0], rows[7][1], "again"), (None, None, None), (2000, None, "no time")]
    tick = [(None, T0 + timedelta(days=1), None)]
    once = batches_of(spark, tmp_path, "once", [rows + tick])
    want = []
    for minute in range(8):
        start = T0 + timedelta(minutes=minute)
        inside = sorted((r[1], r[0], r[2]) for r in rows if r[0] is not None and r[1] and start <= r[1] < start + timedelta(minutes=1))
        want += [(q, start, n // 100 + 1) for n, (_, q, _) in enumerate(inside)]
    assert sorted(r[:3] for r in once) == sorted(want) and len(once) == 505
    assert sorted(r[3] or "" for r in once) == sorted(r[2] or "" for r in rows if r[0] is not None and r[1])

    # Seven files, each with a restart before it, newest rows of the first minutes first.
    early = [r for r in rows if r[1] is None or r[1] < T0 + timedelta(minutes=2)]
    late = [r for r in rows if r[1] is not None and r[1] >= T0 + timedelta(minutes=2)]
    files = [early[i::5][::-1] for i in range(5)] + [late, tick]
    numbers = lambda found: sorted((q, w, b) for q, w, b, _ in found)
    assert numbers(batches_of(spark, tmp_path, "pieces", files)) == numbers(once)
    # Without a later row the last minutes wait.
    waiting = batches_of(spark, tmp_path, "waiting", [early, late])
    assert {r[1] for r in waiting} == {T0, T0 + timedelta(minutes=1), T0 + timedelta(minutes=3), T0 + timedelta(minutes=4)}


def test_an_epoch_of_batches_run_again(spark, tmp_path):
    rows = [(i, T0 + timedelta(seconds=i % 60), None) for i in range(150)] + [(None, T0 + timedelta(days=1), None)]
    first = batches_of(spark, tmp_path, "again", [rows])
    commits = tmp_path / "again-check" / "commits"
    last = sorted(p.name for p in commits.glob("[0-9]*"))[-1]
    (commits / last).rename(tmp_path / "lost")
    (commits / f".{last}.crc").rename(tmp_path / "lost.crc")
    assert len(first) == 150 and batches_of(spark, tmp_path, "again", [[]]) == first


def test_feedback_stream_over_epochs(spark, tmp_path):
    folder = str(tmp_path / "messages.parquet")
    schema = "feedback_id bigint, query_id bigint, feedback int, submitted_at timestamp"
    changes, check = str(tmp_path / "changes"), str(tmp_path / "check")

    def send(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
        jobs.stream_feedback(stream(spark, folder), changes, check, True).awaitTermination()

    send([(1, 1, 1, T0), (2, 2, -1, T0), (3, 3, 9, T0)])
    send([(4, 1, -1, T0 + timedelta(hours=1)), (5, 2, 1, T0 - timedelta(hours=1))])
    log = spark.range(1, 5).withColumnRenamed("id", "query_id")
    view = jobs.feedback_view(log, spark.read.parquet(changes))
    got = {r["query_id"]: r["user_feedback"] for r in view.collect()}
    # The verdict that came late but was given earlier does not win.
    assert got == {1: -1, 2: -1, 3: None, 4: None}


def test_feedback_table_is_a_base_and_the_last_changes(spark, tmp_path):
    folder, path = str(tmp_path / "messages.parquet"), str(tmp_path / "table")
    schema = "feedback_id bigint, query_id bigint, feedback int, submitted_at timestamp"
    table, log = VersionedTable(spark, path), spark.range(8).withColumnRenamed("id", "query_id")
    want, sizes = {}, []
    for epoch in range(7):
        rows = [(10 * epoch + q, q, 1 if (epoch + q) % 2 else -1, T0 + timedelta(hours=epoch * q)) for q in range(6)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        # One stream object a turn: each is a restart from the checkpoint.
        jobs.stream_feedback_table(
            stream(spark, folder), table, str(tmp_path / "check"), changes=3, available_now=True
        ).awaitTermination()
        want |= {q: f for _, q, f, _ in rows}
        now = table.version()
        sizes.append((len(now.folders), table.read().count()))
        got = {r.query_id: r.user_feedback for r in jobs.feedback_view(log, table.read()).collect()}
        assert got == {q: want.get(q) for q in range(8)}
    # After the fourth and the seventh epoch there is one folder, with a row for each query.
    assert sizes == [(1, 6), (2, 12), (3, 18), (1, 6), (2, 12), (3, 18), (1, 6)]
    assert table.version().jobs == ["feedback/6"]

    # All epochs again, as after a lost checkpoint log: they are known and change nothing.
    before = table.version().number
    jobs.stream_feedback_table(
        stream(spark, folder), table, str(tmp_path / "again"), available_now=True
    ).awaitTermination()
    assert table.version().number == before


def test_compaction_keeps_what_is_added_meanwhile(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "table"))
    table.append(spark.range(3), "s/0")

    def slow(rows):
        table.append(spark.range(10, 12), "s/1")
        return rows.where("id > 0")

    table.compact(slow)
    assert sorted(r.id for r in table.read().collect()) == [1, 2, 10, 11]
    assert table.version().jobs == ["s/0", "s/1"]

    def beaten(rows):
        table.compact(lambda r: r)
        return rows

    with pytest.raises(Conflict):
        table.compact(beaten)
    assert table.read().count() == 4


def test_dedupe_keeps_late_rows(spark, tmp_path):
    # One file a batch, the third an hour behind the first two.
    folder = str(tmp_path / "messages.parquet")
    got = set()
    for i, hour in [(1, 12), (2, 13), (3, 11), (1, 12)]:
        write(spark, folder, [(i, T0 + timedelta(hours=hour), 0.0)])
        once = jobs.stream_dedupe(stream(spark, folder), "query_id", "created_at")
        got = sorted(r["query_id"] for r in run(spark, once, tmp_path, "late").collect())
    assert got == [1, 2, 3]
