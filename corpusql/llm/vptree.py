"""Nearest neighbours with a vantage-point tree for each shard.

Vectors are dealt to shards of about ``SHARD_ROWS`` by a hash of their id. In a shard, a
vantage point splits the rest by the median distance to it, again and again, down to leaves.
A query descends on its own side first; the triangle inequality then says that the other side
can hold something nearer than the k-th best so far (distance t) only if the query's distance
to the vantage point is within t of the median. ``factor`` relaxes this: within t / factor.
Factor one is exact and the default; larger factors visit less and may miss, most of all
where the vectors fill few of their dimensions.

Of equal vectors only the k + 1 smallest ids can be among the k nearest of any query, and of
rows with one id and one vector only k, so a vector that a third of all rows share stays
k (k + 1) rows at most; they are picked before the shuffle, over rows folded with a count.
Queries meet shards in blocks, and a task holds one shard and one block of queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusql.llm.common import written

K = 10
FACTOR = 1.0
SHARD_ROWS = 16_384
QUERY_ROWS = 2_048
LEAF_ROWS = 64
#: Partitions of the search; more groups than that share them.
MAX_PARTITIONS = 20_000
EVERY = 100


def distances(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, a row for each query."""
    out = np.empty((len(queries), len(points)))
    for i, query in enumerate(queries):
        out[i] = np.sqrt(((points - query) ** 2).sum(axis=1))
    return out


class Tree:
    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.points, self.leaf_rows = ids[order], points[order], leaf_rows
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray):
        """A leaf is its rows; a node is (vantage row, median, inner, outer)."""
        if len(rows) <= self.leaf_rows:
            return rows
        # The row farthest from the first one lies at the rim, where shells are thin.
        start = distances(self.points[rows], self.points[rows[:1]])[0]
        top = rows[int(np.argmax(start))]
        rest = rows[rows != top]
        away = distances(self.points[rest], self.points[top : top + 1])[0]
        median = float(np.median(away))
        inner = away <= median
        if inner.all():  # half or more are equally far, at the rim: some of those go outside
            inner[np.argsort(away, kind="stable")[len(rest) // 2 :]] = False
        return top, median, self._build(rest[inner]), self._build(rest[~inner])

    def nearest(self, own: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k nearest of each query but itself; infinite where fewer."""
        self.best = np.full((len(queries), k), np.inf)
        self.names = np.full((len(queries), k), np.iinfo("i8").max)
        self.own, self.queries, self.k, self.factor = own, queries, k, factor
        if len(queries):
            self._visit(self.root, np.arange(len(queries)))
        return self.best, self.names

    def _offer(self, rows: np.ndarray, who: np.ndarray) -> np.ndarray:
        found = distances(self.points[rows], self.queries[who])
        ids = np.broadcast_to(self.ids[rows], found.shape)
        allowed = np.where(ids == self.own[who][:, None], np.inf, found)
        better = who[(allowed <= self.best[who, -1:]).any(axis=1)]
        if len(better):
            at = np.isin(who, better)
            all_d = np.concatenate([self.best[better], allowed[at]], axis=1)
            all_i = np.concatenate([self.names[better], ids[at]], axis=1)
            order = np.lexsort((all_i, all_d), axis=1)[:, : self.k]
            self.best[better] = np.take_along_axis(all_d, order, 1)
            self.names[better] = np.take_along_axis(all_i, order, 1)
        return found

    def _visit(self, node, who: np.ndarray) -> None:
        if isinstance(node, np.ndarray):
            if len(node):
                self._offer(node, who)
            return
        top, median, inner, outer = node
        away = self._offer(np.array([top]), who)[:, 0]
        inside = away <= median
        for side, near, far in ((inside, inner, outer), (~inside, outer, inner)):
            if side.any():
                self._visit(near, who[side])
                reach = self.best[who[side], -1] / self.factor
                other = np.abs(away[side] - median) <= reach
                if other.any():
                    self._visit(far, who[side][other])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of rows that take part.

    Left out are rows without an id, null and empty vectors, vectors with a component that is
    null, infinite or no number, and vectors of zeros.
    """
    x = F.col("embedding")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long"), x.cast("array<double>").alias("embedding"))
        .where("vec_id IS NOT NULL AND embedding IS NOT NULL")
        .where(finite & F.exists(x, lambda v: v != 0.0))
    )


def nearest(
    vectors: DataFrame, k: int = K, every: int = EVERY, factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row whose id divides by ``every``.

    Nearest first, ties to the smaller id; a query is no candidate of its own. Vectors of
    different lengths are not compared. Rows that repeat an id are candidates each, the query
    among them is asked once. Only vec_id and embedding are read.
    """
    rows = written(usable(vectors), "vectors")
    by_value = Window.partitionBy("embedding").orderBy("vec_id")
    folded = rows.groupBy("embedding", "vec_id").agg(F.count("*").alias("copies"))
    # Places are counted by id: all rows of a query's own id fall away together.
    kept = (
        folded.withColumn("n", F.row_number().over(by_value)).where(F.col("n") <= k + 1)
        .select("vec_id", "embedding", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))).alias("n"))
        .drop("n")
    )
    kept = written(kept, "candidates")
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    shards = max(1, -(-kept.count() // shard_rows))
    blocks = max(1, -(-asked.count() // query_rows))
    dealt = kept.select(
        F.size("embedding").alias("size"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "embedding",
    )
    questions = asked.select(
        F.size("embedding").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
        F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "embedding",
    )

    def search(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "i8", "vec_id": "i8", "score": "f8"}
            )
        tree = Tree(points["vec_id"].to_numpy(), np.stack(points["embedding"].to_numpy()))
        own = queries["vec_id"].to_numpy()
        best, names = tree.nearest(own, np.stack(queries["embedding"].to_numpy()), k, factor)
        there = np.isfinite(best)
        return pd.DataFrame({
            "query_id": np.repeat(own, there.sum(axis=1)), "vec_id": names[there], "score": best[there],
        })

    keys = ("size", "shard", "block")
    # Work is a shard times a block, whatever their bytes: groups are not merged by bytes.
    spread = min(4 * shards * blocks, MAX_PARTITIONS)
    dealt, questions = dealt.repartition(spread, *keys), questions.repartition(spread, *keys)
    found = dealt.groupBy(*keys).cogroup(questions.groupBy(*keys)).applyInPandas(
        search, "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
