"""Repeated passages by difference-cover anchors.

A window is ``window`` consecutive words. Anchors are shorter runs of words, taken only where
the position modulo ``period`` lies in a difference cover: a set in which every residue is a
difference of two members. If two windows are equal, some pair of equal positions in them has
both sides on the cover, wherever the windows start, so two texts that share a window share
an anchor inside it (``window = anchor + period - 1``). Then matches are extended: only
windows around an anchor known from two documents are hashed as a whole (96 bits), and a
window is removed if its hash has a smaller document.

Shuffles: anchors once (one row for each document and anchor, about a fifth of the words),
texts once, candidate windows once. Rows of a hot anchor or window stream by in order of
documents, and a task holds the first of them only; documents take part by hash sets of their
own size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: a perfect difference set, every residue modulo 31 is a difference just once.
COVERS = {31: (0, 1, 3, 8, 12, 18)}


def difference_cover(period: int) -> list[int]:
    """Residues whose differences give every residue: a dense start and then wide steps."""
    if period in COVERS:
        return list(COVERS[period])
    step = max(1, int(np.ceil(np.sqrt(period))))
    return sorted({*range(min(step, period)), *range(0, period, step)})


class Windows:
    """Window and anchor hashes of one text at a time."""

    #: Two odd multipliers of a rolling hash over the words' 64-bit hashes.
    BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self, window: int, period: int):
        if not 1 <= period <= window:
            raise ValueError("the period is at least 1 and at most the window")
        self.window, self.period, self.anchor = window, period, window - period + 1
        self.on_cover = np.zeros(period, bool)
        self.on_cover[difference_cover(period)] = True
        self.powers: list[np.ndarray] = [np.ones(1, "u8"), np.ones(1, "u8")]
        self.inverse: list[np.ndarray] = [np.ones(1, "u8"), np.ones(1, "u8")]

    def _powers(self, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers[k]) <= n:
            size = 2 * n + 1024
            for held, base in ((self.powers, self.BASES[k]), (self.inverse, pow(self.BASES[k], -1, 1 << 64))):
                steps = np.full(size, base, "u8")
                steps[0] = 1
                held[k] = np.multiply.accumulate(steps)
        return self.powers[k], self.inverse[k]

    @staticmethod
    def words(text: str | None) -> list[bytes]:
        return text.encode().split() if text else []

    def rolled(self, words: list[bytes]) -> list[np.ndarray]:
        """Prefix sums of both rolling hashes."""
        n = len(words)
        values = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", n)
        out = []
        for k in (0, 1):
            sums = np.zeros(n + 1, "u8")
            np.cumsum(values * self._powers(k, n)[0][:n], out=sums[1:])
            out.append(sums)
        return out

    def runs(self, rolled: list[np.ndarray], k: int, starts: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the runs of ``size`` words at ``starts``."""
        sums = rolled[k]
        value = (sums[starts + size] - sums[starts]) * self._powers(k, len(sums))[1][starts]
        value ^= value >> np.uint64(29)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        return value ^ (value >> np.uint64(32))

    def anchors(self, rolled: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the anchors on the cover."""
        n = len(rolled[0]) - 1
        at = np.arange(max(0, n - self.anchor + 1))
        at = at[self.on_cover[at % self.period]]
        return at, self.runs(rolled, 0, at, self.anchor).view("i8")

    def candidates(self, rolled: list[np.ndarray], known: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an anchor in ``known`` (low halves of hashes)."""
        n = len(rolled[0]) - 1
        if n < self.window:
            return np.zeros(0, int)
        at, hashes = self.anchors(rolled)
        marks = np.zeros(n + 2, int)
        marks[at[np.isin(hashes.astype("i4"), known)] + 1] = 1
        marks = np.cumsum(marks)  # marks[i]: known anchors before position i
        start = np.arange(n - self.window + 1)
        return start[marks[start + self.period] > marks[start]]


def _anchor_rows(window: int, period: int) -> Callable:
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit = Windows(window, period)
        for batch in batches:
            ids, hashes = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = kit.words(text.as_py())
                if len(words) >= window:
                    own = np.unique(kit.anchors(kit.rolled(words))[1])
                    hashes.append(own)
                    ids.append(np.full(len(own), doc, "i8"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hashes)), pa.array(np.concatenate(ids))], ["anchor", "doc"]
            )

    return job


def _shared_rows(keys: int, first_too: bool) -> Callable:
    """Rows of runs of equal keys, sorted by document: those beyond the run's first document.

    The first ``keys`` columns are the key and the last is the document. With ``first_too``
    the row of the first document comes out as well, once another document follows.
    """

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # key of the open run
        first, told = 0, True  # its first document, and whether that one is out
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            doc = columns[-1]
            starts = np.ones(n, bool)
            starts[1:] = np.any([c[1:] != c[:-1] for c in columns[:keys]], axis=0)
            goes_on = last == tuple(c[0] for c in columns[:keys])
            starts[0] = not goes_on
            run = np.cumsum(starts)  # 0: the open run
            heads = np.concatenate([[first], doc[starts]])
            beyond = doc > heads[run]
            out = beyond.copy()
            fresh = []
            if first_too:
                at = np.flatnonzero(starts)
                met = np.zeros(len(heads), bool)
                met[run[beyond]] = True
                out[at[met[1:]]] = True
                if met[0] and not told:
                    fresh = [(last, first)]
                ends = run[-1]
                told = bool(met[ends]) or (ends == 0 and told)
            last, first = tuple(c[-1] for c in columns[:keys]), heads[run[-1]]
            made = [c[out] for c in columns]
            for key, head in fresh:
                made = [np.append(c, v).astype(c.dtype) for c, v in zip(made, (*key, head))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], batch.schema.names)

    return job


def _window_rows(window: int, period: int) -> Callable:
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit = Windows(window, period)
        for batch in batches:
            parts = [(np.zeros(0, "i8"), np.zeros(0, "i4"), np.zeros(0, "i8"))]
            for doc, text, known in zip(*(batch.column(n) for n in ("doc_id", "text", "_known"))):
                if not known.is_valid or not doc.is_valid:
                    continue
                doc = int(doc.as_py())
                rolled = kit.rolled(kit.words(text.as_py()))
                at = kit.candidates(rolled, known.values.to_numpy(zero_copy_only=False))
                first = kit.runs(rolled, 0, at, window).view("i8")
                first, index = np.unique(first, return_index=True)
                second = (kit.runs(rolled, 1, at[index], window) >> np.uint64(32)).astype("u4")
                parts.append((first, second.view("i4"), np.full(len(first), doc, "i8")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in zip(*parts)], ["high", "low", "doc"]
            )

    return job


def _kept_rows(window: int, period: int, names: list[str]) -> Callable:
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit = Windows(window, period)
        for batch in batches:
            kept, total, removed = [], [], []
            for doc, text, gone in zip(*(batch.column(n) for n in ("doc_id", "text", "_gone"))):
                words = kit.words(text.as_py())
                n = len(words)
                left = n
                if gone.is_valid and doc.is_valid and n >= window:
                    starts = np.arange(n - window + 1)
                    hit = np.isin(
                        kit.runs(kit.rolled(words), 0, starts, window).view("i8"),
                        gone.values.to_numpy(zero_copy_only=False),
                    )
                    edge = np.zeros(n + 1, int)
                    np.add.at(edge, starts[hit], 1)
                    np.add.at(edge, starts[hit] + window, -1)
                    stays = np.cumsum(edge[:n]) == 0
                    words = [w for w, ok in zip(words, stays.tolist()) if ok]
                    left = len(words)
                kept.append(b" ".join(words).decode())
                total.append(n)
                removed.append(n - left)
            made = {"kept": pa.array(kept, pa.string()), "n_words": pa.array(total, pa.int64()),
                    "n_removed": pa.array(removed, pa.int64())}
            own = {n: batch.column(n) for n in names if n not in made}
            yield pa.RecordBatch.from_pydict(own | made)

    return job


def without_repeats(docs: DataFrame, window: int = 50, period: int = 31) -> DataFrame:
    """``docs`` with ``kept``, ``n_words`` and ``n_removed``.

    A word is removed if a window over it, read on the input, also starts in a document with
    a smaller doc_id; ``kept`` is the other words joined by blanks. Words are runs of anything
    but ASCII white space. Null and short texts lose nothing, and so do rows without a doc_id,
    which are no source either. Rows that share a doc_id are one document: they take nothing
    from each other, and each gives a row. All columns stay; the three names are replaced.
    """
    needed = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    known = (
        needed.where("doc IS NOT NULL AND text IS NOT NULL")
        .mapInArrow(_anchor_rows(window, period), "anchor long, doc long")
        .repartition("anchor").sortWithinPartitions("anchor", "doc")
        .mapInArrow(_shared_rows(1, first_too=True), "anchor long, doc long")
        # Half a hash is enough to say which anchors of one document are meant; a mix-up
        # makes windows candidates that are then compared as a whole.
        .groupBy("doc").agg(F.collect_list(F.shiftright(F.shiftleft("anchor", 32), 32).cast("int")).alias("_known"))
    )
    names = docs.columns
    # One exchange of the texts serves both joins, so both read the same columns of it.
    # Rows without an id are spread by their text and recognised in the tasks.
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    by_doc = docs.withColumn("_doc", key).repartition("_doc")
    gone = (
        by_doc.join(known.withColumnRenamed("doc", "_doc").hint("shuffle_hash"), "_doc", "left")
        .select(*names, "_doc", "_known")
        .mapInArrow(_window_rows(window, period), "high long, low int, doc long")
        .repartition("high", "low").sortWithinPartitions("high", "low", "doc")
        .mapInArrow(_shared_rows(2, first_too=False), "high long, low int, doc long")
        .groupBy("doc").agg(F.collect_list("high").alias("_gone"))
    )
    fields = [f for f in docs.schema.fields if f.name not in ("kept", "n_words", "n_removed")]
    schema = T.StructType(fields).add("kept", "string").add("n_words", "long").add("n_removed", "long")
    return (
        by_doc.join(gone.withColumnRenamed("doc", "_doc").hint("shuffle_hash"), "_doc", "left")
        .select(*names, "_doc", "_gone")
        .mapInArrow(_kept_rows(window, period, names), schema)
    )


def repeat_digests(docs: DataFrame) -> DataFrame:
    """Per document: words, removed words and the digest of what is kept."""
    return without_repeats(docs.select("doc_id", "text")).select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_removed",
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )


#: DuckDB: all windows, without anchors.
REPEATS_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 49], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50)
), firsts AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i
  FROM win JOIN firsts USING (s) WHERE m < doc_id
), word AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w
), kept AS (
  SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.i) AS t, count(*) AS n
  FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i GROUP BY 1
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
