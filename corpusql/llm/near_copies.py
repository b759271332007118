"""Near copies: documents whose sets of five-word shingles have a Jaccard index of 0.8 or more.

Candidates come from two sides, and the exact index decides on each.

* SimHash fingerprints of the same shingles, by multi-index hashing (``simhash.links``): what lies
  within three bits is joined first, in linear work, however large the groups of copies are.
* A prefix join, which misses nothing. In one order of all shingles, the first one that two such
  sets share stands among the first n - ceil(8n/9) + 1 of the smaller set and the first
  n - ceil(4n/5) + 1 of the larger. Any order is right; shingles that are common in a sample
  stand last, so that a passage of many documents brings few of them together.

What is wanted are components. So rounds compare each set with one other, the leader of a shingle
it shares most with, which joins what is left of large groups. Then all pairs are compared that
still share such shingles across components, if the number and the places of those they share
leave room for the index. Equal sets are one from the start, and are known by their smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.llm.common import discard, in_few_files, work_table
from corpusql.llm.simhash import components, links, majority, shingle_hashes

SHINGLE = 5
#: The index, in fifths: 4 / 5.
SHARE, PARTS = 4, 5
ROUNDS = 2
#: Shingles are counted by so many bits of their hash, in one of so many documents, and are
#: common above so many times the mean.
BUCKET_BITS, SAMPLE, COMMON = 20, 8, 8
#: Texts or pairs of sets that go to Python at a time.
BATCH = 250
#: Size of the map that says which documents stand in a pair: 1 MB on the driver and in tasks.
BITS = 1 << 23


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; a text of fewer words is one shingle."""
    return np.unique(shingle_hashes(text, SHINGLE).astype("u8").view("i8"))


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view("u8") >> np.uint64(64 - BUCKET_BITS)).astype("i8")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << BUCKET_BITS, "i8")
    for batch in batches:
        if batch.num_rows:
            own = [shingles(text.as_py()) for text in batch.column(0)]
            np.add.at(counts, _buckets(np.concatenate(own)), 1)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(a) for a in arrays)]).astype("i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, "i8"), *arrays])))


def _sets(common: np.ndarray) -> Callable:
    """Sign (equal for equal sets), fingerprint, size and first shingles of each text."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.zeros(1 << BUCKET_BITS, bool)
        late[common] = True
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                bits, own = [], []
                for text in part.column(1):
                    hashes = shingle_hashes(text.as_py(), SHINGLE)
                    bits.append(majority(hashes))
                    own.append(np.unique(hashes.astype("u8").view("i8")))
                signs = [xxhash.xxh3_64_intdigest(a.tobytes()) - (1 << 63) for a in own]
                firsts = [
                    a[np.argsort(late[_buckets(a)], kind="stable")][: len(a) - -(-SHARE * len(a) // PARTS) + 1 if len(a) else 0]
                    for a in own
                ]
                prints = np.packbits(np.array(bits, bool).reshape(-1, 64), axis=1).view(">i8").reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(signs, pa.int64()), pa.array(prints.astype("i8")),
                     pa.array([len(a) for a in own], pa.int64()), _lists(firsts)],
                    ["doc_id", "sign", "bits", "size", "firsts"],
                )

    return job


def _wanted(bitmaps: dict[int, bytes]) -> Callable:
    """Whole sets of the documents whose bit is set: 40 bits of each hash are enough to compare two."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = [], []
            for doc, bucket, bit, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                if bucket in bitmaps and bitmaps[bucket][bit >> 3] >> (bit & 7) & 1:
                    ids.append(doc)
                    own.append(_packed(shingles(text.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own, pa.binary())], ["doc_id", "shingles"])

    return job


def _packed(hashes: np.ndarray) -> bytes:
    """The lower 40 bits of each hash."""
    return np.ascontiguousarray(hashes.astype("<u8").view("u1").reshape(-1, 8)[:, :5]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), "u1")
    wide[:, :5] = np.frombuffer(data, "u1").reshape(-1, 5)
    return wide.view("<u8").reshape(-1)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, known = [], (None, None)
        for a, b in zip(batch.column(2), batch.column(3)):
            a, b = a.as_py(), b.as_py()
            # Pairs of one set come together: it is opened once.
            if known[0] is not a and known[0] != a:
                known = a, _unpacked(a)
            x, y = known[1], _unpacked(b)
            both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            keep.append(PARTS * both >= SHARE * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of sets of different components that share a first shingle: a, b and w, the smaller size.

    The shingle stands early enough in the smaller set, and the places leave room for the index:
    at most what follows it in both, itself, and what precedes it in both.
    """
    x, y = left.alias("x"), right.alias("y")
    early = lambda s: f"{s}.place <= {s}.size - ceil({2 * SHARE} * {s}.size / {PARTS + SHARE})"
    rest = "LEAST(x.size - x.place, y.size - y.place) + LEAST(x.place, y.place)"
    return x.join(y, F.col("x.shingle") == F.col("y.shingle")).where(
        (F.col("x.component") != F.col("y.component"))
        & F.expr(f"IF(x.size <= y.size, {early('x')}, {early('y')}) OR (x.size = y.size AND {early('y')})")
        & F.expr(f"{PARTS + SHARE} * ({rest}) >= {SHARE} * (x.size + y.size)")
    ).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.least("x.size", "y.size").alias("w"))


def _all_met(left: DataFrame) -> DataFrame:
    """Pairs a < b of sets of different components that may be near, by what their first shingles share.

    All first shingles that two sets share are met here. Common shingles beyond the first ones of
    one of them are at most as many as it has there, and none precede the first common one.
    """
    x, y = left.alias("x"), left.alias("y")
    met = x.join(y, F.col("x.shingle") == F.col("y.shingle")).where(
        (F.col("x.component") != F.col("y.component")) & (F.col("x.node") < F.col("y.node"))
        & F.expr(f"{PARTS} * LEAST(x.size, y.size) >= {SHARE} * GREATEST(x.size, y.size)")
    ).groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(
        F.count("*").alias("shared"), F.min("x.place").alias("i"), F.min("y.place").alias("j"),
        F.first("x.size").alias("m"), F.first("y.size").alias("n"),
    )
    rest = lambda n: f"ceil({SHARE} * {n} / {PARTS}) - 1"
    most = f"LEAST(m - i, n - j, shared + GREATEST({rest('m')}, {rest('n')}))"
    return met.where(f"{PARTS + SHARE} * {most} >= {SHARE} * (m + n)").select("a", "b")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over near copies, of rows with a doc_id.

    Texts without words are equal. Rows that share a doc_id are one document, near to whatever one
    of its texts is near to. Only doc_id and text are read; an empty table gives no rows.
    """
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = work_table(
        texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
        .mapInArrow(_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        .transform(in_few_files, 1 << BUCKET_BITS), "counts", BATCH
    )
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / (1 << BUCKET_BITS)
    # Fewer than 2^20 / COMMON numbers, however large the corpus is.
    common = np.array([r.bucket for r in counts.where(F.col("n") > COMMON * max(1, mean)).select("bucket").collect()], "i8")
    sets = work_table(
        texts.mapInArrow(_sets(common), "doc_id long, sign long, bits long, size long, firsts array<long>"), "sets", BATCH
    )
    documents, entries = sets.agg(F.count("*"), F.coalesce(F.sum(F.size("firsts")), F.lit(0))).first()
    owners = work_table(in_few_files(sets.groupBy("sign").agg(F.min("doc_id").alias("node")), documents), "owners")
    own = sets.join(owners.select("sign", F.col("node").alias("doc_id")), ["sign", "doc_id"], "left_semi")
    places = own.select(F.col("doc_id").alias("node"), "size", F.posexplode("firsts").alias("place", "shingle")).distinct()
    places = work_table(in_few_files(places, entries), "places")
    shared = places.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle")
    left = places.join(shared, "shingle", "left_semi").withColumn("component", F.col("node"))
    left = work_table(in_few_files(left, entries), "left")
    firsts = left
    discard(counts, places)

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs u < v those that are near.

        Sets are made again for the documents of some pair, as far as BITS bits tell them from
        others: more documents than that cost time and change nothing.
        """
        bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS)) + 1
        bitmaps = (
            pairs.select(F.explode(F.array("u", "v")).alias("id")).select(bit("id").alias("bit"))
            .groupBy(F.bitmap_bucket_number("bit").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
        )
        at = bit("doc_id")
        lists = texts.select("doc_id", F.bitmap_bucket_number(at), F.bitmap_bit_position(at), "text").mapInArrow(
            _wanted({r.bucket: bytes(r.bits) for r in bitmaps}), "doc_id long, shingles binary"
        )
        return work_table(
            pairs.join(lists.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a")), "u")
            .join(lists.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b")), "v")
            .select("u", "v", "b", "a").mapInArrow(_near, "u long, v long").distinct()
            .transform(in_few_files, pairs.count()), "near", BATCH,
        )

    # A document of several sets links them.
    mine = sets.join(owners, "sign").select("doc_id", "node").distinct()
    several = mine.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u <> v")
    edges = several.join(mine, "doc_id").select("u", F.col("node").alias("v")).where("u <> v")
    edges = work_table(in_few_files(edges, documents), "several")

    # Fingerprints first: of equal ones each set meets the first, and firsts meet by their bits.
    prints = own.select(F.col("doc_id").alias("node"), "bits")
    members = work_table(in_few_files(prints.groupBy("bits").agg(F.min("node").alias("node")), documents), "members")
    alike = prints.join(members.withColumnRenamed("node", "u"), "bits").select("u", F.col("node").alias("v"))
    alike = alike.where("u <> v").union(links(members).select(F.least("u", "v"), F.greatest("u", "v"))).distinct()
    tested = work_table(in_few_files(alike, documents), "pairs")
    edges = edges.union(verified(tested))

    def rooted() -> DataFrame:
        rows = edges.count()
        return work_table(in_few_files(components(edges, rows), 2 * rows), "roots")

    for turn in range(ROUNDS + 1):
        roots = rooted()
        now = firsts.drop("component").join(roots, "node", "left").withColumn("component", F.coalesce("root", "node"))
        now = now.select("shingle", "node", "size", "place", "component")
        mixed = now.groupBy("shingle").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
        now = work_table(in_few_files(now.join(mixed.select("shingle"), "shingle", "left_semi"), entries), "left")
        if left is not firsts:
            discard(left)
        left = now
        if turn < ROUNDS:
            leaders = left.groupBy("shingle").agg(
                F.min_by(F.struct("node", "size", "place", "component"), F.xxhash64("node", F.lit(turn))).alias("b")
            ).select("shingle", "b.*")
            # At least half of what the smaller set could share here; the last round takes the rest.
            most = _met(left, leaders).groupBy("a", "b").agg(
                F.count("*").alias("w"), F.first("w").alias("size")
            ).where(f"{2 * (PARTS + SHARE)} * w >= size")
            pairs = most.groupBy("a").agg(F.max_by("b", F.struct("w", "b")).alias("b"))
        else:
            pairs = _all_met(left)
        pairs = pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        pairs = work_table(in_few_files(pairs.join(tested, ["u", "v"], "left_anti"), entries), "pairs")
        tested = tested.union(pairs)
        edges = edges.union(verified(pairs))
    roots = rooted()
    return mine.join(roots, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "node")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are their component's document of smallest id, with all columns.

    A doc_id that occurs in several rows keeps them all; rows without a doc_id stay.
    """
    copies = near_copies(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("copy_id"))
    return docs.join(copies, docs["doc_id"].cast("long") == copies["copy_id"], "left_anti")
