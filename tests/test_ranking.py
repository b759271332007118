import random

import pytest
from pyspark.sql import functions as F

from corpusql.operators import ranking


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    # One key holds two thirds of all rows; one key is null.
    return [
        (i, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randrange(40), rng.choice([None, 1.5, 2.0]))
        for i in range(600)
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, k string, v int, x double").repartition(5)


def by_key(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    return groups


@pytest.mark.parametrize("hot_rows", [20, 10_000])
def test_row_numbers(spark, rows, hot_rows):
    got = ranking.row_numbers(
        frame(spark, rows), ["k"], [F.col("v"), F.col("id")], F.floor(F.col("v") / 7), "rn", hot_rows
    )
    got = {r["id"]: r["rn"] for r in got.collect()}
    want = {
        r[0]: n
        for g in by_key(rows).values()
        for n, r in enumerate(sorted(g, key=lambda r: (r[2], r[0])), 1)
    }
    assert got == want


@pytest.mark.parametrize("hot_rows", [20, 10_000])
def test_ranks(spark, rows, hot_rows):
    df = ranking.ranks(frame(spark, rows), ["k"], F.col("v").desc(), "v",
                       F.floor(-F.col("v") / 7), hot_rows)
    for r in df.collect():
        group = [x[2] for x in by_key(rows)[r["k"]]]
        above = [v for v in group if v > r["v"]]
        assert (r["rank"], r["dense_rank"]) == (len(above) + 1, len(set(above)) + 1)


@pytest.mark.parametrize("hot_rows", [20, 10_000])
def test_neighbours(spark, rows, hot_rows):
    df = ranking.neighbours(frame(spark, rows), ["k"], ["v", "id"], "x",
                            F.floor(F.col("v") / 7), hot_rows)
    got = {r["id"]: (r["prev"], r["next"]) for r in df.collect()}
    for group in by_key(rows).values():
        ordered = sorted(group, key=lambda r: (r[2], r[0]))
        for i, r in enumerate(ordered):
            prev = ordered[i - 1][3] if i else None
            after = ordered[i + 1][3] if i + 1 < len(ordered) else None
            assert got[r[0]] == (prev, after)


@pytest.mark.parametrize("take", [0, 1, 17, 150, 10_000])
def test_quota_cutoffs(spark, rows, take):
    df = frame(spark, rows)
    quotas = df.select("k").distinct().where("k <> 'b'").withColumn("take", F.lit(take))
    ends = ranking.quota_cutoffs(df, ["k"], ranking.range_of(df, "id", 16), ["id"], quotas, "take")
    kept = ranking.mark_within(df, ["k"], ["id"], ends, "in").where("in")
    got = sorted(r["id"] for r in kept.collect())
    want = sorted(
        r[0] for k, g in by_key(rows).items() if k in ("hot", "a") for r in sorted(g)[:take]
    )
    assert got == want


@pytest.mark.parametrize("sorted_rows", [2, 10_000])
@pytest.mark.parametrize("take", [1, 37, 150, 10_000])
@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_quota_cutoffs_by_sketch(spark, rows, take, sorted_rows, kind):
    # One id is far from all others, some are equal or null: the id behind them parts rows.
    far = [(r[0], r[1], 4 * 10**18 if r[0] == 5 else None if r[0] % 50 == 0 else r[2], r[3]) for r in rows]
    df = spark.createDataFrame(far, "id bigint, k string, v bigint, x double").withColumn("v", F.col("v").cast(kind))
    quotas = df.select("k").distinct().where("k IS NULL OR k <> 'b'").withColumn("take", F.lit(take))
    ends = ranking.quota_cutoffs(df, ["k"], None, ["v", "id"], quotas, "take", sorted_rows)
    got = {r["k"]: (r["_cutoff"]["v"], r["_cutoff"]["id"]) for r in ends.collect()}
    want = {}
    for key, group in by_key(far).items():
        places = sorted(((r[2] is not None, r[2] or 0, r[0]), (r[2], r[0])) for r in group)
        if key != "b":
            want[key] = places[min(take, len(places)) - 1][1]
    assert got == want


def test_an_outlier_does_not_widen_what_is_sorted(spark):
    df = spark.range(200_000).select(
        F.lit("k").alias("k"), F.when(F.col("id") == 7, F.lit(4 * 10**18)).otherwise(F.col("id")).alias("id")
    )
    quotas = spark.createDataFrame([("k", 90_000)], "k string, take bigint")
    ranged = ranking._ranges_at(df, ["k"], "id", quotas, "take")
    last = ranking._range_at(ranged, ["k"], quotas, "take").first()
    assert last["_range"] == 1 and last["_rows"] <= 200_000 * 7 / ranking.SKETCH_STEPS


def test_positions(spark, rows):
    got = ranking.with_positions(frame(spark, rows), [F.col("v").desc(), F.col("id")])
    got = {r["id"]: r["position"] for r in got.collect()}
    want = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])), 1)}
    assert got == want


@pytest.mark.parametrize(
    "values",
    [
        [1.0],
        [3.0, 1.0],
        [5.0] * 1000 + [1.0, 9.0],
        [float(i % 97) for i in range(3000)],
        [2.0 ** (i % 50) for i in range(700)] + [None] * 40,
        [-1.5, None, 0.0, -0.5],
    ],
)
def test_percentiles(spark, values):
    df = spark.createDataFrame([(None, v) for v in values], "k string, v double").repartition(4)
    fractions = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r["name"]: (r["cont"], r["disc"])
           for r in ranking.exact_percentiles(df, ["k"], "v", fractions).collect()}
    for name, p in fractions.items():
        want = df.selectExpr(
            f"percentile_cont({p}) WITHIN GROUP (ORDER BY v)",
            f"percentile_disc({p}) WITHIN GROUP (ORDER BY v)",
        ).first()
        assert got[name] == (pytest.approx(want[0]), want[1]), name


def test_without_any_broadcast(spark, rows, monkeypatch):
    """Tables that outgrow the limit are joined by a shuffle, with the same result."""
    from corpusql.operators import sizing

    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for case in (test_row_numbers, test_ranks, test_neighbours):
            case(spark, rows, 20)
        test_quota_cutoffs(spark, rows, 150)
        test_percentiles(spark, [float(i % 97) for i in range(3000)])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
