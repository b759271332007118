"""Sharding by a hierarchical weighted hash tree.

Regions hold racks and racks hold shards. A document descends from the root: at each level every
child draws ``-ln(u) / room`` with u hashed from the document's id, the child's path and the number
of the attempt, and the smallest draw wins, so children win in proportion to their room. At the
shard one more draw accepts the document with probability weight / room; a refused document
starts again at the root with the next attempt.

Room is what a place may come to hold and stays as it is when weights change within it. So a
change of weight changes only which attempts that shard accepts: documents move into a shard
whose weight grew or out of one whose weight fell, and between no other two. Draws of a child
do not depend on its siblings, so a change of room (a new rack, a larger region) moves documents
only into or out of the subtree that changed, at its own level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusql.llm.common import written

SHARDS = 40
RACKS, SHARDS_OF_RACK = 4, 4
#: Rows ranked together, about; and of equal rows as many as one row stands for.
BLOCK_ROWS, LOT = 50_000, 1_000
OVERHEAD = 16
#: Refused so often, a document is given up and the tree's error is reported.
ATTEMPTS = 100_000


@dataclass(frozen=True)
class Shard:
    """A place in the tree. ``room`` is the most ``weight`` may become; 0 <= weight <= room."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0
    room: float = 1.0


class Tree:
    """Regions, racks and shards with their room."""

    def __init__(self, shards: list[Shard]):
        if not any(s.weight > 0 for s in shards) or any(not 0 <= s.weight <= s.room or s.room <= 0 for s in shards):
            raise ValueError("weights lie between 0 and a positive room, and one is positive")
        if len({s.shard for s in shards}) < len(shards):
            raise ValueError("a shard stands in one place")
        self.children: dict[str, dict[str, float]] = {}
        self.shards: dict[str, Shard] = {}
        for s in shards:
            rack, leaf = f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.shard}"
            for parent, child in (("", s.region), (s.region, rack), (rack, leaf)):
                rooms = self.children.setdefault(parent, {})
                rooms[child] = rooms.get(child, 0.0) + s.room
            self.shards[leaf] = s

    def attempts(self, key: str) -> Iterator[tuple[Shard, float]]:
        """The shards that a key's attempts lead to, each with the draw that may accept it."""
        for attempt in range(ATTEMPTS):
            node = ""
            for _ in range(3):
                rooms = self.children[node]
                # Equal draws go to the first name.
                node = min((-math.log(_draw(key, attempt, child)) / rooms[child], child) for child in rooms)[1]
            yield self.shards[node], _draw(key, attempt, f"{node}/take")
        raise ValueError(f"no shard took {key!r} in {ATTEMPTS} attempts")

    def of(self, key: str) -> int:
        for shard, draw in self.attempts(key):
            if draw * shard.room < shard.weight:
                return shard.shard


def _draw(key: str, attempt: int, path: str) -> float:
    """Between 0 and 1, both excluded; the same everywhere."""
    h = int.from_bytes(md5(f"{key}|{attempt}|{path}".encode(), usedforsecurity=False).digest()[:6], "big")
    return (h + 0.5) / (1 << 48)


def regular(shards: int, racks: int = RACKS, of_rack: int = SHARDS_OF_RACK, room_for: int | None = None) -> Tree:
    """A tree of ``shards`` equal shards, numbered from 0, in racks and regions filled in turn.

    ``room_for`` is the number of shards that the tree can grow to, 64 or the next power of two
    of it by default; trees with the same room differ only in the shards that are in use. Growth
    beyond the room needs a tree with more of it, which moves rows into new regions only, as
    long as the old ones are full.
    """
    room_for = room_for or 64
    while room_for < shards:
        room_for *= 2
    per_region = racks * of_rack
    regions = -(-room_for // per_region)
    places = []
    for n in range(regions * per_region):
        # Neighbouring numbers stand in different regions, then in different racks.
        region, at = n % regions, n // regions
        places.append(Shard(f"region{region}", f"rack{at % racks}", n, float(n < shards)))
    return Tree(places)


def crc_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def placed(docs: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and grown_shard (by the tree ``grown``), a row for each row.

    Ids alone decide: rows that share a doc_id share a shard, and so do all rows without one.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now, then = [], []
            for doc in batch.column(0).to_pylist():
                key = "" if doc is None else str(doc)
                now.append(tree.of(key))
                then.append(grown.of(key) if grown else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(now, pa.int32()), pa.array(then, pa.int32())],
                ["doc_id", "size", "text_crc32", "shard", "grown_shard"],
            )

    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(F.coalesce(text, F.lit(""))) + OVERHEAD).cast("long").alias("size"),
        crc_of(text).alias("text_crc32"),
    ).mapInArrow(job, "doc_id long, size long, text_crc32 long, shard int, grown_shard int")


def sharded(docs: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """``placed`` rows with ``slot``, their number within the shard, gapless from 0.

    Slots follow a hash of the row, so they do not depend on how the table is stored. Equal rows
    are counted before they are ranked and take neighbouring slots of as many numbers. Null texts
    count as empty, rows without a doc_id stand in one shard, an empty table gives no rows; only
    doc_id and text are read. No shard, key or group of equal rows is ranked in one task: rows are
    ranked in blocks by their hash, and blocks by their counts.
    """
    columns = ["doc_id", "size", "text_crc32", "shard", "grown_shard"]
    folded = placed(docs, tree, grown).groupBy(*columns).agg(F.count("*").alias("n"))
    # A row for each LOT of equal rows, so that many of them part as well.
    lots = written(
        folded.withColumn("lot", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {LOT}"))))
        .withColumn("n", F.least(F.lit(LOT), F.expr(f"n - lot * {LOT}")))
        .withColumn("order", F.xxhash64("doc_id", "size", "text_crc32", "lot")), "placed",
    )
    total = lots.count()
    bits = max(0, math.ceil(math.log2(max(1, total / BLOCK_ROWS))))
    lots = lots.withColumn("block", F.shiftright("order", 64 - bits) if bits else F.lit(0).cast("long"))
    before = lots.groupBy("shard", "block").agg(F.sum("n").alias("many")).select(
        "shard", "block",
        (F.sum("many").over(Window.partitionBy("shard").orderBy("block")) - F.col("many")).alias("before"),
    )
    inside = F.sum("n").over(
        Window.partitionBy("shard", "block").orderBy("order", "doc_id", "size", "text_crc32", "lot")
        .rowsBetween(Window.unboundedPreceding, 0)
    ) - F.col("n")
    return (
        lots.withColumn("inside", inside).join(before, ["shard", "block"])
        .withColumn("first", F.col("before") + F.col("inside"))
        .withColumn("slot", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)))
        .select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")
    )


def shard_digests(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every row's shard of ``shards``, and of one more; law ``key``: id and number of shards decide.

    One more shard takes rows only into itself. No rows are kept together: an id decides alone,
    equal texts with different ids may part.
    """
    room = max(64, shards + 1)
    return sharded(docs, regular(shards, room_for=room), regular(shards + 1, room_for=room)).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


__all__ = ["Shard", "Tree", "placed", "regular", "shard_digests", "sharded"]
