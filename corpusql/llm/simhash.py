"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits is two segments of 32. If two fingerprints differ in at most three
bits, one of the segments differs in at most one. So each distinct fingerprint stands in the
table of each segment under its own value, and visits the values that differ from it in one
bit: of two values that differ in one bit, the one without the bit visits the other, so every
link is met. Whoever meets in a table entry is compared over all 64 bits.

What is wanted of the links is their components, so an entry gives a spanning forest of its
links, never its pairs: at most one edge for each member. Equal fingerprints are one member
from the start (groups of exact copies, empty texts), and entries in which nobody lives are
dropped as they stream by. Components come from rounds of large-star and small-star steps on
edge tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.llm.common import in_few_files, written

SEED = 42
SHINGLE = 3
DISTANCE = 3
#: Shingles whose bits are counted at a time, which bounds memory for very long texts.
BLOCK = 1 << 14

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all shingles in order, repeats included; a text of fewer words is one shingle."""
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, ">u8")
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), ">u8", max(1, len(words) - size + 1))


def majority(hashes: np.ndarray) -> np.ndarray:
    """For each bit, highest first, whether it is set in over half the hashes (big-endian)."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        counts += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return 2 * counts > len(hashes)


def shingle_bits(text: str | None, size: int = SHINGLE) -> np.ndarray:
    return majority(shingle_hashes(text, size))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id long and bits long (the fingerprint as a signed number), a row for each row."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [shingle_bits(text.as_py()) for text in batch.column(1)]
            packed = np.packbits(np.array(bits, bool).reshape(-1, 64), axis=1).view(">i8")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(packed.reshape(-1).astype("i8"))], ["doc_id", "bits"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(job, "doc_id long, bits long")


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member in the tables of both segments: at home, and where it visits."""
    for batch in batches:
        node = batch.column(0).to_numpy()
        bits = batch.column(1).to_numpy().view("u8")
        parts = []
        for segment in (0, 1):
            value = (bits >> np.uint64(32 * segment)) & np.uint64(0xFFFFFFFF)
            tag = np.uint64(segment) << np.uint64(32)
            parts.append((value | tag, node, bits, np.zeros(len(bits), bool)))
            for b in range(32):
                flip = np.uint64(1 << b)
                goes = (value & flip) == 0
                parts.append(((value[goes] | flip) | tag, node[goes], bits[goes], np.ones(goes.sum(), bool)))
        entry, node, bits, visits = (np.concatenate(x) for x in zip(*parts))
        yield pa.RecordBatch.from_arrays(
            [pa.array(entry.view("i8")), pa.array(node), pa.array(bits.view("i8")), pa.array(visits)],
            ["entry", "node", "bits", "visits"],
        )


def forest(node: np.ndarray, bits: np.ndarray, visits: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that join the members of an entry as all links do that touch one who lives there.

    Breadth first from the residents: each step compares one resident with all who are not
    reached yet, so memory is a few numbers for each member and an edge is given once for
    each member reached. Two visitors need no comparison here: they meet elsewhere.
    """
    edges = []
    left = np.argsort(visits, kind="stable")  # residents first
    queue: list[int] = []
    # Visitors stay reachable until a resident of each component has met them.
    homes = left[: len(left) - int(visits.sum())]
    guests = left[len(homes) :]
    root = {}
    while len(homes):
        queue.append(homes[0])
        homes = homes[1:]
        start = queue[0]
        while queue:
            at = queue.pop()
            if len(homes):
                near = np.bitwise_count(bits[homes] ^ bits[at]) <= distance
                for other in homes[near]:
                    edges.append((node[at], node[other]))
                    queue.append(other)
                homes = homes[~near]
            if len(guests):
                near = np.flatnonzero(np.bitwise_count(bits[guests] ^ bits[at]) <= distance)
                for g in near:
                    if root.get(guests[g]) != start:  # once for each component of residents
                        root[guests[g]] = start
                        edges.append((node[at], node[guests[g]]))
    return edges


def _entry_edges(distance: int):
    """Streams entries in order; a run of equal entries may cross batches."""

    def flush(parts: list) -> list[tuple[int, int]]:
        entry, node, bits, visits = (np.concatenate(x) for x in zip(*parts))
        edges: list[tuple[int, int]] = []
        bounds = np.flatnonzero(np.diff(entry)) + 1
        first = np.concatenate([[0], bounds])
        last = np.concatenate([bounds, [len(entry)]])
        # Runs of one member, and of visitors alone, link nobody.
        lives = np.add.reduceat(~visits, first)
        for a, b in zip(first[(last - first > 1) & (lives > 0)], last[(last - first > 1) & (lives > 0)]):
            edges += forest(node[a:b], bits[a:b], visits[a:b], distance)
        return edges

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            entry, node, bits = (batch.column(i).to_numpy() for i in range(3))
            visits = batch.column(3).to_numpy(zero_copy_only=False)
            rows = (entry, node, bits.view("u8"), visits)
            if entry[0] == entry[-1] and (not held or held[-1][0][-1] == entry[0]):
                held.append(rows)
                continue
            cut = int(np.searchsorted(entry, entry[-1]))
            edges = flush([*held, tuple(x[:cut] for x in rows)])
            held = [tuple(x[cut:] for x in rows)]
            yield _pairs(edges)
        if held:
            yield _pairs(flush(held))

    return job


def _pairs(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    array = np.array(edges, "i8").reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(array[:, 0]), pa.array(array[:, 1])], ["u", "v"])


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node and root (the smallest node of its component) for every node on an edge.

    Large-star and small-star in turn, until the edges are stars around the smallest nodes.
    Each step folds a node's neighbours to their minimum (partial sums first) and joins it
    back, which adaptive execution splits where a node is hot. Rounds grow with the logarithm
    of the longest chain. Every round is a table in the shared folder, in files by its rows;
    ``rows`` says about how many edges there are at first, where this is known.
    """
    both = lambda e: e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = written(now if rows is None else in_few_files(now, rows), "edges")
    if rows is None:
        rows = now.count()
    before = None
    while True:
        # Large star: larger neighbours of u move to the smallest around u.
        around = both(now)
        low = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            around.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        # Small star: u and its smaller neighbours move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")
        )
        moved = moved.select("e.u", F.col("e.m").alias("v")).where("u <> v").distinct()
        after = written(in_few_files(moved, rows), "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now, rows = after, state[0]
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select("v", "v").distinct()
    )


def links(members: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges u and v between nodes, which join what lies within ``distance`` bits.

    ``members`` has node long and bits long, a row for each distinct fingerprint.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError("two segments find differences of up to 3 bits")
    return (
        members.select("node", "bits")
        .mapInArrow(_tables, "entry long, node long, bits long, visits boolean")
        .repartition("entry").sortWithinPartitions("entry")
        .mapInArrow(_entry_edges(distance), "u long, v long")
    )


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, bits and component_id: the smallest doc_id reachable over links.

    Documents link if their fingerprints differ in at most ``distance`` (up to 3) bits. Null
    and blank texts have fingerprint zero and link like any other. Rows without a doc_id keep
    a null component and link nobody. Repeated rows give a row each.
    """
    prints = written(fingerprints(docs), "fingerprints")
    members = written(
        prints.where("doc_id IS NOT NULL").groupBy("bits").agg(F.min("doc_id").alias("node")), "members"
    )
    groups = members.join(components(links(members, distance)), "node", "left").select(
        "bits", F.coalesce("root", "node").alias("component_id")
    )
    return prints.join(groups, "bits", "left").select(
        "doc_id", "bits", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def link_digests(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are their component's document of smallest id.

    A doc_id that occurs in several rows keeps them all; rows without a doc_id stay.
    """
    groups = near_duplicates(docs.select("doc_id", "text"))
    copies = (
        groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_copy")).distinct()
    )
    return docs.join(copies, docs["doc_id"].cast("long") == copies["_copy"], "left_anti")
