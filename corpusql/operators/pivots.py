"""Exact nearest tables when the registry is too large for a task: blocks around pivots.

A schema of n tables gets n / ``block_rows`` of them as pivots. Every table goes to its nearest
pivot, and the tables of a pivot are cut into rings by their distance to it, so that a block
holds about ``block_rows`` tables and is known by its pivot and the range of its distances. A
question at distance d from the pivot is at least ``max(d - high, low - d)`` from all of a block.

Each question first visits the nearest blocks that hold k tables, which bounds its k-th distance,
and then only blocks whose lower bound is not beyond that. Distances are those between unit
vectors, sqrt(2 (1 - cosine)), which keep the triangle inequality and the order of the cosine.

On the first visit a block with many questions is copied once for each ``block_rows`` of them, so
copies are as many as visits, one or few for each question. For the rest, questions are dealt to a
fixed number of groups (``GROUPS``), those near one pivot together. A group holds its questions and
reads the blocks that any of them must visit one after the other. So a question moves once more and
a table once for each group at most, however many blocks there are: what is shuffled grows
with questions plus tables. The comparisons do not: where vectors fill all dimensions evenly, all
blocks are visited, as an exact search must.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from corpusql.sources.workspace import fresh_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pivots of one schema, and of all: vectors that are sent to every task.
PIVOTS, ALL_PIVOTS = 256, 8_192
#: Rings of one pivot. Blocks are listed on the driver: at most ``ALL_PIVOTS`` * ``RINGS`` rows.
RINGS = 64
#: Distances are compared after rounding at nine digits; so much is allowed for.
SLACK = 1e-8
#: Groups that questions are dealt to, of all schemas, or as many as tasks run at once if that is more.
GROUPS = 32
#: Questions that a group holds, about; there are more groups if there are more.
GROUP_ROWS = 100_000
#: Found rows that wait to be merged, for each place of the questions of a group.
WAITING = 4

_CELL = ["schema_name", "pivot", "ring"]


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, f"retrieval-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _squares(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))


def _usable(vector: Column) -> Column:
    """Whether a vector has a direction: neither null nor zero, all numbers finite."""
    squares = _squares(vector)
    return F.coalesce((squares > 0) & (squares < float("inf")), F.lit(False))


def _unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def _pivots(tables: DataFrame, block_rows: int) -> dict[str, np.ndarray]:
    """Unit vectors by schema: the tables whose keys hash lowest."""
    counts = tables.groupBy("schema_name").agg(F.count("*").alias("n"))
    wanted = F.least(F.lit(PIVOTS), F.ceil(F.col("n") / block_rows))
    total = counts.agg(F.sum(wanted)).first()[0] or 0
    if total > ALL_PIVOTS:  # small schemas share one block each, without a pivot of their own
        wanted = F.floor(wanted * (ALL_PIVOTS / total))
    first = Window.partitionBy("schema_name").orderBy(F.xxhash64("row_key"), "row_key", "table_name")
    chosen = (
        tables.withColumn("place", F.row_number().over(first)).where(F.col("place") <= PIVOTS)
        .join(counts.select("schema_name", wanted.alias("wanted")), "schema_name")
        .where(F.col("place") <= F.col("wanted")).select("schema_name", "t_vec").toPandas()
    )
    return {name: _unit(own["t_vec"]) for name, own in chosen.groupby("schema_name")}


def _assign(pivots: dict[str, np.ndarray]) -> Callable:
    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, own in batch.groupby("schema_name"):
                if name in pivots:
                    away = _chords(_unit(own["t_vec"]), pivots[name])
                    at = away.argmin(axis=1)
                    yield own.assign(pivot=at.astype("int32"), away=away[np.arange(len(at)), at])
                else:
                    yield own.assign(pivot=np.int32(0), away=0.0)

    return job


def _routes(pivots: dict[str, np.ndarray], blocks: dict[str, pd.DataFrame], k: int) -> Callable:
    """Blocks a question visits: without ``reach`` the nearest that hold k tables, else the rest within it."""

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, own in batch.groupby("schema_name"):
                if name not in blocks:
                    continue
                mine = blocks[name]
                if name in pivots:
                    away = _chords(_unit(own["q_vec"]), pivots[name])[:, mine["pivot"].to_numpy()]
                    least = np.maximum(np.maximum(away - mine["high"].to_numpy(), mine["low"].to_numpy() - away), 0.0)
                else:
                    least = np.zeros((len(own), len(mine)))
                    away = least
                order = np.lexsort((away, least), axis=1)
                sizes = mine["n"].to_numpy()[order]
                # Before the block that completes the k, and that block.
                first = np.zeros(least.shape, bool)
                np.put_along_axis(first, order, np.cumsum(sizes, axis=1) - sizes < k, axis=1)
                go = first if "reach" not in own else ~first & (least <= own["reach"].to_numpy()[:, None] + SLACK)
                row, col = np.nonzero(go)
                yield pd.DataFrame({
                    "question_id": own["question_id"].to_numpy()[row], "q_vec": own["q_vec"].to_numpy()[row],
                    "schema_name": name, "pivot": mine["pivot"].to_numpy()[col], "ring": mine["ring"].to_numpy()[col],
                })

    return job


def _search(k: int) -> Callable:
    from corpusql.operators.retrieval import Tables

    def job(questions: pd.DataFrame, tables: pd.DataFrame) -> pd.DataFrame:
        if questions.empty or tables.empty:
            return pd.DataFrame()
        return Tables(tables).nearest(questions[["question_id", "q_vec"]], k)

    return job


def _near(pivots: dict[str, np.ndarray]) -> Callable:
    """The nearest pivot of each question."""

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, own in batch.groupby("schema_name"):
                at = _chords(_unit(own["q_vec"]), pivots[name]).argmin(axis=1) if name in pivots else 0
                yield own.assign(near=at).astype({"near": "int32"})

    return job


class Group:
    """Questions of a group and the nearest of the tables read so far."""

    def __init__(self, asked: pd.DataFrame, pivots: np.ndarray | None, k: int):
        self.k = k
        self.ids = asked["question_id"].to_numpy()
        self.unit = _unit(asked["vec"])
        self.away = _chords(self.unit, pivots) if pivots is not None else None
        # A distance is 1 - cosine, reach the chord of the k-th one.
        self.reach = asked["reach"].fillna(np.inf).to_numpy(float)
        self.found: list[pd.DataFrame] = []
        self.waiting = 0

    def read(self, tables: pd.DataFrame) -> None:
        """Compares tables of one pivot with the questions they may be near enough to."""
        from corpusql.operators.retrieval import CELLS, RANK_DIGITS

        away = tables["away"].to_numpy()
        if self.away is None:
            who = np.arange(len(self.ids))
        else:
            mine = self.away[:, int(tables["pivot"].iloc[0])]
            least = np.maximum(mine - away.max(), away.min() - mine)
            who = np.flatnonzero(least <= self.reach + SLACK)
        if not len(who):
            return
        tables = tables.sort_values(["table_name", "row_key"], kind="stable")
        names, keys = tables["table_name"].to_numpy(), tables["row_key"].to_numpy()
        unit = _unit(tables["vec"]).T
        step = max(1, CELLS // len(tables))
        for at in range(0, len(who), step):
            some = who[at : at + step]
            cosine = self.unit[some] @ unit
            row, col = np.nonzero(cosine >= (1.0 - (self.reach[some] ** 2 / 2 + SLACK))[:, None])
            distance = np.round(1.0 - cosine[row, col], RANK_DIGITS) + 0.0
            order = np.lexsort((col, distance, row))
            row, col, distance = row[order], col[order], distance[order]
            # Of equal tables the first k are enough.
            best = np.arange(len(row)) - np.searchsorted(row, row) < self.k
            row, col, distance = row[best], col[best], distance[best]
            self.found.append(pd.DataFrame({
                "at": some[row], "distance": distance, "table_name": names[col], "row_key": keys[col],
            }))
            self.waiting += len(row)
        if self.waiting > WAITING * self.k * len(self.ids):
            self.merge()

    def merge(self) -> pd.DataFrame:
        """The ``k`` nearest of each question so far, which are all that is kept."""
        rows = pd.concat(self.found, ignore_index=True) if self.found else pd.DataFrame(
            {"at": [], "distance": [], "table_name": [], "row_key": []}
        )
        rows = rows.sort_values(["at", "distance", "table_name", "row_key"], kind="stable")
        places = rows.groupby("at").cumcount()
        last = rows[places == self.k - 1]
        at = last["at"].to_numpy(dtype="i8")
        self.reach[at] = np.minimum(self.reach[at], np.sqrt(2 * np.maximum(0.0, last["distance"].to_numpy(float)) + SLACK))
        rows = rows[places < self.k]
        self.found, self.waiting = [rows], 0
        return rows

    def rows(self) -> pd.DataFrame:
        rows = self.merge()
        return pd.DataFrame({
            "question_id": self.ids[rows["at"].to_numpy(dtype="i8")], "table_name": rows["table_name"].to_numpy(),
            "row_key": rows["row_key"].to_numpy(dtype="i8"), "distance": rows["distance"].to_numpy(dtype="f8"),
            "kind": np.zeros(len(rows), "i4"),
        })


def _read_groups(pivots: dict[str, np.ndarray], k: int) -> Callable:
    """Rows ordered by slot, questions (pivot -1) before tables, tables by block."""

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot, asked, group = None, [], None

        def close() -> Iterator[pd.DataFrame]:
            if group is not None:
                yield group.rows()

        for batch in batches:
            for (own_slot, pivot, _), own in batch.groupby(["slot", "pivot", "ring"], sort=True):
                if own_slot != slot:
                    yield from close()
                    slot, asked, group = own_slot, [], None
                if pivot < 0:
                    asked.append(own)
                    continue
                if group is None and asked:
                    name = asked[0]["schema_name"].iloc[0]
                    group, asked = Group(pd.concat(asked, ignore_index=True), pivots.get(name), k), []
                if group is not None:
                    group.read(own)
        yield from close()

    return job


def _best(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("question_id").orderBy("kind", "distance", "table_name", "row_key")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def ranked(
    questions: DataFrame, tables: DataFrame, k: int, block_rows: int, report: dict | None = None
) -> DataFrame:
    """question_id, table_name, row_key, distance, kind (0 number, 1 undefined, 2 missing) and rank.

    ``questions`` has question_id, schema_name and q_vec, ``tables`` schema_name, table_name,
    row_key and t_vec. ``report`` gets how many pairs of question and block there are, and were
    visited.
    """
    named = tables.where(F.col("schema_name").isNotNull())
    good = named.where(_usable(F.col("t_vec")))
    asked = questions.where(_usable(F.col("q_vec")))
    pivots = _pivots(good, block_rows)
    id_type = questions.schema["question_id"].dataType.simpleString()
    q_type, t_type = (df.schema[c].dataType.simpleString() for df, c in ((questions, "q_vec"), (tables, "t_vec")))
    assigned = _kept(
        good.mapInPandas(_assign(pivots), "schema_name string, table_name string, row_key bigint, "
                         f"t_vec {t_type}, pivot int, away double"), "assigned",
    )
    steps = [i / RINGS for i in range(1, RINGS)]
    cuts = assigned.groupBy("schema_name", "pivot").agg(
        F.count("*").alias("n"), F.percentile_approx("away", steps, 10 * RINGS).alias("cuts")
    ).withColumn("rings", F.least(F.lit(RINGS), F.ceil(F.col("n") / block_rows)))
    fine = F.size(F.filter("cuts", lambda c: c < F.col("away")))
    # Rings that are still too large are dealt out by their rows' keys.
    parts = F.ceil(F.col("n") / (F.col("rings") * block_rows))
    placed = assigned.join(cuts, ["schema_name", "pivot"]).select(
        *assigned.columns, F.floor(fine * F.col("rings") / RINGS).cast("int").alias("ring"),
        F.pmod(F.xxhash64("row_key"), parts).cast("int").alias("part"), parts.cast("int").alias("parts"),
    )
    placed = _kept(placed, "placed")
    listed = placed.groupBy(*_CELL).agg(
        F.min("away").alias("low"), F.max("away").alias("high"), F.count("*").alias("n"), F.max("parts").alias("parts")
    )
    listed = _kept(listed, "blocks")
    blocks = {name: own.reset_index(drop=True) for name, own in listed.toPandas().groupby("schema_name")}

    def searched(routes: DataFrame) -> DataFrame:
        # Copies of a block, one for each block_rows of its questions.
        load = routes.groupBy(*_CELL).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("copies"))
        load = load.join(listed.select(*_CELL, "parts"), _CELL)
        q = routes.join(load, _CELL).withColumn(
            "copy", F.pmod(F.xxhash64("question_id"), F.col("copies")).cast("int")
        ).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "copies")
        t = placed.drop("parts").join(load.drop("parts"), _CELL).withColumn(
            "copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
        ).drop("copies", "away")
        cell = [*_CELL, "part", "copy"]
        found = q.groupBy(*cell).cogroup(t.groupBy(*cell)).applyInPandas(
            _search(k), f"question_id {id_type}, table_name string, row_key bigint, distance double, kind int, rank int"
        )
        return _kept(found, "found")

    route = f"question_id {id_type}, q_vec {q_type}, schema_name string, pivot int, ring int"
    near = _kept(asked.mapInPandas(_routes(pivots, blocks, k), route), "routes")
    first = _best(searched(near), k)
    # The chord of the k-th distance; infinite while there are fewer than k.
    reach = first.groupBy("question_id").agg(
        F.when(F.count("*") >= k, F.sqrt(2 * F.max("distance") + SLACK)).otherwise(float("inf")).alias("reach")
    )
    reached = _kept(asked.join(reach, "question_id").select("question_id", "schema_name", "q_vec", "reach"), "reached")
    if report is not None:
        per = {name: len(own) for name, own in blocks.items()}
        counts = asked.groupBy("schema_name").count().collect()
        report["pairs"] = sum(r["count"] * per.get(r["schema_name"], 0) for r in counts)
        report["visited"] = near.count() + reached.mapInPandas(_routes(pivots, blocks, k), route).count()
    columns = ["question_id", "table_name", "row_key", "distance", "kind"]
    found = _grouped(reached, placed, listed, pivots, blocks, k, id_type)
    return _best(found.select(columns).union(_odd(questions, named, k).select(columns)), k)


def _slots(counts: list[Row], blocks: dict[str, pd.DataFrame], at_once: int) -> list[tuple]:
    """(schema_name, near, first, groups, before, own, all) for each pivot that questions are near to.

    Schemas get groups by their share of the comparisons, and enough of them to hold the
    questions. The questions of a schema, in the order of their pivots, are cut evenly.
    """
    asked: dict[str, int] = {}
    for r in counts:
        asked[r["schema_name"]] = asked.get(r["schema_name"], 0) + r["n"]
    work = {name: n * int(blocks[name]["n"].sum()) for name, n in asked.items() if name in blocks}
    total, first, out = sum(work.values()), 0, []
    for name, share in work.items():
        groups = max(1, round(max(GROUPS, at_once) * share / total), -(-asked[name] // GROUP_ROWS))
        before = 0
        for r in sorted((r for r in counts if r["schema_name"] == name), key=lambda r: r["near"]):
            out.append((name, r["near"], first, groups, before, r["n"], asked[name]))
            before += r["n"]
        first += groups
    return out


def _grouped(
    reached: DataFrame, placed: DataFrame, listed: DataFrame, pivots: dict[str, np.ndarray],
    blocks: dict[str, pd.DataFrame], k: int, id_type: str,
) -> DataFrame:
    """The k nearest numbers of each question, from all blocks within its reach."""
    spark = reached.sparkSession
    near = _kept(reached.mapInPandas(_near(pivots), StructType([*reached.schema.fields, StructField("near", IntegerType())])), "near")
    counts = near.groupBy("schema_name", "near").agg(F.count("*").alias("n")).collect()
    cuts = _slots(counts, blocks, spark.sparkContext.defaultParallelism)
    slots = max([1, *(first + groups for _, _, first, groups, *_ in cuts)])
    cuts = spark.createDataFrame(
        cuts, "schema_name string, near int, first int, groups int, before long, own long, all long"
    )
    # Questions near one pivot are spread over its part of the order by a hash.
    place = F.col("before") + F.col("own") * (F.pmod(F.xxhash64("question_id"), F.lit(1 << 20)) / (1 << 20))
    slot = F.col("first") + F.least(F.col("groups") - 1, F.floor(place * F.col("groups") / F.col("all"))).cast("int")
    dealt = near.join(F.broadcast(cuts), ["schema_name", "near"]).select(*reached.columns, slot.alias("slot"))
    # Blocks that a group must read: those in reach of any of its questions.
    wanted = dealt.mapInPandas(_group_routes(pivots, blocks), "slot int, schema_name string, pivot int, ring int").distinct()
    none = lambda kind: F.lit(None).cast(kind)
    types = {reached.schema["q_vec"].dataType, placed.schema["t_vec"].dataType}
    wide = types.pop() if len(types) == 1 else ArrayType(DoubleType())
    q = dealt.select(
        "slot", F.lit(-1).alias("pivot"), F.lit(-1).alias("ring"), "schema_name", "question_id", "reach",
        F.col("q_vec").cast(wide).alias("vec"), none("string").alias("table_name"), none("long").alias("row_key"),
        none("double").alias("away"),
    )
    t = placed.join(F.broadcast(wanted), _CELL).select(
        "slot", "pivot", "ring", none("string").alias("schema_name"), none(id_type).alias("question_id"),
        none("double").alias("reach"), F.col("t_vec").cast(wide).alias("vec"), "table_name", "row_key", "away",
    )
    # More partitions than slots, so that few share one.
    rows = q.union(t).repartition(4 * slots, "slot").sortWithinPartitions("slot", "pivot", "ring")
    found = rows.mapInPandas(
        _read_groups(pivots, k), f"question_id {id_type}, table_name string, row_key bigint, distance double, kind int"
    )
    return _kept(found, "found")


def _group_routes(pivots: dict[str, np.ndarray], blocks: dict[str, pd.DataFrame]) -> Callable:
    """(slot, block) pairs in reach of a batch's questions, each once."""

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (name, slot), own in batch.groupby(["schema_name", "slot"]):
                mine = blocks[name]
                if name in pivots:
                    away = _chords(_unit(own["q_vec"]), pivots[name])[:, mine["pivot"].to_numpy()]
                    least = np.maximum(away - mine["high"].to_numpy(), mine["low"].to_numpy() - away)
                    go = (least <= own["reach"].to_numpy()[:, None] + SLACK).any(axis=0)
                else:
                    go = np.ones(len(mine), bool)
                yield pd.DataFrame({
                    "slot": np.int32(slot), "schema_name": name, "pivot": mine["pivot"].to_numpy()[go].astype("i4"),
                    "ring": mine["ring"].to_numpy()[go].astype("i4"),
                })

    return job


def _odd(questions: DataFrame, tables: DataFrame, k: int) -> DataFrame:
    """Pairs without a distance: a zero vector's is undefined, a null's missing. They come by name.

    Each schema's first k tables of either sort are enough, as they follow all numbers.
    """
    sort = lambda v: F.when(F.col(v).isNull(), 2).when(_usable(F.col(v)), 0).otherwise(1)
    by_name = Window.partitionBy("schema_name", "sort").orderBy("table_name", "row_key")
    heads = (
        tables.select("schema_name", "table_name", "row_key", sort("t_vec").alias("sort"))
        .withColumn("place", F.row_number().over(by_name)).where(F.col("place") <= k)
    )
    kind = F.greatest("asked", "sort")
    return (
        questions.select("question_id", "schema_name", sort("q_vec").alias("asked")).join(heads, "schema_name")
        .where(kind > 0).select(
            "question_id", "table_name", "row_key", F.lit(None).cast("double").alias("distance"), kind.alias("kind")
        )
    )
