"""Resampling a corpus towards a target by importance, ranked by a distributed radix sort.

Features are hashed into ``BUCKETS`` buckets. Two sums over all texts, of the corpus and of the
target, give each bucket its gain, an array every task indexes to weigh its documents. With a
noise of extreme-value law, fixed by the document's id, on top of the weight, the highest
scores are a draw without replacement in proportion to the weights.

The ranks come from a radix sort, least significant digit first, in DataFrame passes. The key
is composite: the score, then the id. A pass over a digit is a stable counting sort: rows are
counted by digit and block of ``BLOCK`` places, a running sum over digits and blocks gives each
(digit, block) its first place, and a row's new place is that plus its rank among the block's
rows of the same digit. No pass needs more than a block's rows of one digit together, whatever
the digits are; digits all rows share take no pass. The places after the last pass are the ranks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusql.llm.common import discard, work_table

BUCKETS = 10_000
WORDS_LEAST = 20
PERCENT = 25
SEED = 7
#: Bits of a digit, and rows of a block: counts are fewer than rows / 16 and a few thousand more.
DIGIT, BLOCK = 11, 1 << 15

_SMALL = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Digits, letters and everything beyond ASCII; other bytes part words.
_WORD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TABLE = bytes(_WORD[_SMALL[b]] for b in range(256))


class Features:
    """Buckets of a text's words and word pairs, repeats included.

    Checksums of words are kept, ``CACHE`` at most; then the cache starts anew.
    """

    CACHE = 500_000

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.words: dict[bytes, int] = {}

    def of(self, text: bytes | None) -> tuple[int, np.ndarray]:
        """Number of words, and the bucket of every feature."""
        words = text.translate(_TABLE).split() if text else []
        if not words:
            return 0, np.zeros(0, "i8")
        known = self.words
        if len(known) > self.CACHE:
            known.clear()
        for word in set(words).difference(known):
            known[word] = crc32(word)
        sums = [known[word] for word in words]
        # A pair's checksum goes on from that of its first word.
        sums += [crc32(b" " + right, left) for left, right in zip(sums, words[1:])]
        return len(words), np.array(sums, "i8") % self.buckets


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: ``buckets`` numbers, however large the table is."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, counts = Features(buckets), np.zeros(buckets, "i8")
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                counts += np.bincount(features.of(text.as_py())[1], minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    rows = (
        docs.select(F.col("text").cast("string")).mapInArrow(job, "bucket long, n long")
        .groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    )
    counts = np.zeros(buckets, "i8")
    for row in rows:
        counts[row.bucket] = row.n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to corpus, with one feature added to each bucket."""
    many, few, size = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([
        math.floor(1000 * math.log(float(t + 1) * (many + size) / (float(s + 1) * (few + size))))
        for s, t in zip(corpus.tolist(), target.tolist())
    ], "i8")


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a draw from the extreme-value law, fixed by the id (null: empty)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score, a row for each row."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(len(gain))
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                n, found = features.of(text.as_py())
                weight = int(gain[found].sum()) // len(found) if n else 0
                rows.append((doc, n, len(found), weight, weight + noise(doc, seed)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)],
                ["doc_id", "n_words", "n_features", "weight", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        job, "doc_id long, n_words long, n_features long, weight long, score long"
    )


def key_digits(key: Column) -> list[Column]:
    """A long as unsigned digits, least significant first, in the order of the numbers."""
    unsigned = key.bitwiseXOR(F.lit(-(1 << 63)))
    return [
        F.shiftrightunsigned(unsigned, at).bitwiseAND(F.lit((1 << DIGIT) - 1)) for at in range(0, 64, DIGIT)
    ]


def radix_ranked(df: DataFrame, digits: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the place of each row, from 0 without gaps, in the order of the key ``digits``.

    Digits are longs from 0 to 2^``DIGIT`` - 1, the least significant first. Rows with equal keys
    take neighbouring places. The result is a table in the shared folder; a column called
    ``name`` is replaced. An empty table stays empty.
    """
    # Helper columns stand beside one struct, so that no column of the table can clash.
    rows = work_table(
        df.select(
            F.struct(*(F.col(f"`{c}`") for c in df.columns if c != name)).alias("row"),
            F.array(*(d.cast("int") for d in digits)).alias("digits"),
            F.monotonically_increasing_id().alias("place"),
        ), "radix",
    )
    ranges = rows.select(
        F.posexplode(F.array(*(F.struct(F.min(F.col("digits")[i]), F.max(F.col("digits")[i])) for i in range(len(digits)))))
        .alias("digit", "range")
    ) if digits else None
    wanted = [r["digit"] for r in ranges.collect() if r["range"][0] != r["range"][1]] if digits else []
    # One pass at least: it makes the places dense.
    for digit in wanted or [None]:
        now = _pass(rows, F.col("digits")[digit] if digit is not None else F.lit(0))
        now = work_table(now, "radix")
        discard(rows)
        rows = now
    return rows.select("row.*", F.col("place").alias(name))


def _pass(rows: DataFrame, digit: Column) -> DataFrame:
    """A stable counting sort of rows with unique places by one digit."""
    keyed = rows.withColumn("digit", digit).withColumn("block", F.col("place").bitwiseAND(F.lit(-BLOCK)))
    counts = keyed.groupBy("digit", "block").agg(F.count("*").alias("n"))
    # Prefix sums in two steps: over the blocks of a digit, and over the digits (2^DIGIT rows).
    digits = counts.groupBy("digit").agg(F.sum("n").alias("n")).select(
        "digit", (F.sum("n").over(Window.orderBy("digit")) - F.col("n")).alias("first")
    )
    offsets = counts.withColumn(
        "before", F.sum("n").over(Window.partitionBy("digit").orderBy("block")) - F.col("n")
    ).join(F.broadcast(digits), "digit").select("digit", "block", (F.col("first") + F.col("before")).alias("first"))
    within = F.row_number().over(Window.partitionBy("digit", "block").orderBy("place")) - 1
    return keyed.withColumn("within", within).join(offsets, ["digit", "block"]).select(
        "row", "digits", (F.col("first") + F.col("within")).alias("place")
    )


def resampled(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, least: int = WORDS_LEAST,
    percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """Every row's doc_id, n_features, weight, score and rank (null where it is not drawn).

    ``percent`` of the rows with ``least`` words or more are drawn, rounded down, highest score
    first, then smallest doc_id (null last). Null and blank texts have no features and weight 0.
    Repeated rows count and are drawn each on its own. An empty corpus gives no rows, an empty
    target weighs by the corpus alone. Of docs only doc_id and text are read, of target only text.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    rows = work_table(scored(docs, gain, seed), "scored")
    able = rows.where(F.col("n_words") >= least)
    bounds = able.agg(F.count("*").alias("n"), F.max("score").alias("top")).first()
    order = [
        *key_digits(F.coalesce("doc_id", F.lit(0))), F.col("doc_id").isNull().cast("long"),
        # Scores differ by far less than 2^33.
        *key_digits(F.lit(bounds.top or 0) - F.col("score"))[:3],
    ]
    drawn = bounds.n * percent // 100
    ranked = radix_ranked(able, order, "rank").select(
        "doc_id", "n_features", "weight", "score", F.when(F.col("rank") < drawn, F.col("rank") + 1).alias("rank")
    )
    rest = rows.where(F.col("n_words") < least).select(
        "doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")
    )
    return ranked.union(rest)


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs``, all their columns, in as many copies as they have.

    A doc_id that occurs in several rows is kept in all of them if one is drawn; rows without a
    doc_id are not returned.
    """
    ids = resampled(docs, target, **options).where("rank IS NOT NULL").select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long") == ids["drawn_id"], "left_semi")


__all__ = ["Features", "bucket_counts", "draw", "gains", "key_digits", "noise", "radix_ranked", "resampled", "scored"]
