import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusql.llm.vptree import Tree, nearest


def brute(ids, points, own, query, k):
    d = np.sqrt(((points - query) ** 2).sum(axis=1))
    return [(float(a), int(i)) for a, i in sorted(zip(d, ids)) if i != own][:k]


@pytest.mark.parametrize("kind", ["clusters", "ties", "equal"])
def test_factor_one_is_exact(kind):
    rng = np.random.default_rng(1)
    points = {
        "clusters": rng.normal(0, 1, (20, 8))[rng.integers(0, 20, 1500)] + rng.normal(0, 0.05, (1500, 8)),
        "ties": rng.integers(0, 2, (1500, 6)).astype(float),
        "equal": np.ones((300, 4)),
    }[kind]
    ids = rng.permutation(len(points))
    best, names = Tree(ids, points, 16).nearest(ids[:40], points[:40], 10, 1.0)
    for i in range(40):
        want = brute(ids, points, ids[i], points[i], 10)
        assert np.allclose(best[i], [d for d, _ in want])
        assert kind == "clusters" or names[i].tolist() == [n for _, n in want]


def test_larger_factors_visit_less():
    rng = np.random.default_rng(2)
    points = rng.normal(0, 1, (4000, 4))
    seen = []
    for factor in (1.0, 3.0):
        tree = Tree(np.arange(4000), points)
        offer, rows = tree._offer, []
        tree._offer = lambda r, w: (rows.append(len(r) * len(w)), offer(r, w))[1]
        tree.nearest(np.arange(20), points[:20], 10, factor)
        seen.append(sum(rows))
    assert seen[1] < seen[0] < 20 * 4000


def table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 1, 6).astype("f4").tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0] * 6) for i in range(120)]
    rows += [(2000, None), (2100, []), (2200, [0.0] * 6), (2300, [float("nan")] * 6), (2400, [None] + [1.0] * 5),
             (2500, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (2600, [1.0, 2.0]), (2601, [1.0, 3.0])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))


def test_equals_brute_force_over_shards_and_blocks(spark):
    rows, df = table(spark)
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and (i < 2000 or i > 2500)]
    got = {}
    for r in nearest(df, every=20, factor=1.0, shard_rows=70, query_rows=9).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for i, v in good:
        if i % 20:
            continue
        others = [(j, w) for j, w in good if len(w) == len(v)]
        want = brute([j for j, _ in others], np.stack([w for _, w in others]), i, v, 10)
        mine = sorted(got[i])
        assert [m[0] for m in mine] == list(range(1, len(want) + 1))
        assert [m[1] for m in mine] == [j for _, j in want]
        assert np.allclose([m[2] for m in mine], [d for d, _ in want], rtol=0, atol=1e-12)
    assert set(got) == {i for i, _ in good if i % 20 == 0}
    assert nearest(df.limit(0)).count() == 0


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids = np.array([r.vec_id for r in rows])
    points = np.array([r.embedding for r in rows], float)
    hits = total = 0
    for r in nearest(df).groupBy("query_id").agg(F.collect_set("vec_id").alias("v")).collect():
        at = int(np.flatnonzero(ids == r.query_id)[0])
        want = {j for _, j in brute(ids, points, r.query_id, points[at], 10)}
        hits += len(want & set(r.v))
        total += len(want)
    assert total == 10 * (ids % 100 == 0).sum() and hits / total >= 0.9


def test_default_misses_nothing_in_few_intrinsic_dimensions(spark):
    rng = np.random.default_rng(4)
    points = rng.normal(0, 1, (3000, 4)) @ rng.normal(0, 1, (4, 64))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for i in range(0, 3000, 100):
        assert got[i] == {n for _, n in brute(range(3000), points, i, points[i], 10)}


def test_repeated_ids_take_no_places(spark):
    rows = [(0, [1.0, 1.0])] * 15 + [(i, [1.0, 1.0]) for i in (1, 1, 2, 3)] + [(i, [float(i), 0.0]) for i in range(4, 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in nearest(df).where("query_id = 0").orderBy("rank").collect()]
    want = brute([i for i, _ in rows], np.array([v for _, v in rows]), 0, np.ones(2), 10)
    assert [i for i, _ in got] == [i for _, i in want] and got[3][1] == 0.0
