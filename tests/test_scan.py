import random

import pytest
from pyspark.sql import functions as F

from corpusql.operators.scan import scanned


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    out = {}
    for g in groups.values():
        g.sort(key=lambda r: (r[2], r[0]))
        for n, r in enumerate(g):
            values = [x[2] for x in g]
            out[r[0]] = (
                n + 1, 1 + sum(v < r[2] for v in values), len({v for v in values if v <= r[2]}),
                g[n - 1][3] if n else None, g[n + 1][3] if n + 1 < len(g) else None,
            )
    return out


def got(df):
    return {r.id: (r.row_number, r.rank, r.dense_rank, r.prev, r.next) for r in df.collect()}


@pytest.mark.parametrize("kind", ["mixed", "one group", "one value", "all alone", "few"])
@pytest.mark.parametrize("ranges,batch", [(1, 10_000), (7, 10_000), (16, 13)])
def test_equals_brute_force(spark, kind, ranges, batch):
    rng = random.Random(kind)
    n = 5 if kind == "few" else 500
    key = {"mixed": lambda i: rng.choice(["hot"] * 5 + ["a", "b", None]), "all alone": str}.get(kind, lambda i: "one")
    place = (lambda: 3) if kind == "one value" else (lambda: rng.randrange(40))
    rows = [(i, key(i), place(), rng.choice([None, "x", "y", "z"])) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, k string, v int, row string").repartition(5)
    conf = {"spark.sql.shuffle.partitions": str(ranges), "spark.sql.execution.arrow.maxRecordsPerBatch": str(batch),
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        found = scanned(df, ["k"], [F.col("v"), F.col("id")], F.col("v"), "row")
        assert found.columns == ["id", "k", "v", "row", "row_number", "rank", "dense_rank", "prev", "next"]
        assert got(found) == brute(rows)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_one_group_spreads_evenly(spark):
    df = spark.range(80_000).select("id", F.lit(1).alias("customer"), F.lit("2024-01-01").cast("date").alias("day"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = scanned(df, ["customer"], [F.col("day")], F.col("day"))
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) == 8 and max(sizes) < 3 * min(sizes)
    numbers = found.agg(F.count_distinct("row_number"), F.max("row_number"), F.max("rank"), F.max("dense_rank")).first()
    assert tuple(numbers) == (80_000, 80_000, 1, 1)


def test_no_keys_types_and_empty(spark):
    df = spark.sql("SELECT id, cast(id * 1.5 AS decimal(20, 3)) AS d, timestamp_seconds(id) AS ts, array(id) AS a FROM range(50)")
    for value in ("d", "ts", "a"):
        rows = {r.id: r for r in scanned(df, [], [F.col("id").desc()], value=value).collect()}
        assert all(rows[i].row_number == 50 - i and rows[i].rank == 50 - i for i in range(50))
        assert all(rows[i].prev == rows[i + 1][value] and rows[i + 1].next == rows[i][value] for i in range(49))
    assert scanned(df.limit(0), ["id"], [F.col("d")], value="d").count() == 0
