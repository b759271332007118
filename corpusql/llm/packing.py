"""Packing token sequences by shortest-pack-first over the histogram of lengths.

A document's ids are cut into pieces of the full length and one remainder. The histogram of
piece lengths (at most ``size`` numbers, however many documents) is packed on the driver:
lengths longest first, each into the packs that hold least so far and still have room, whole
counts at a time. What stays open at the end is closed by cutting: items of the emptiest
packs fill the gaps of the fullest, so that all packs but one are full. The plan says for
each length and range of ranks which sequences take the pieces; it is as large as the
histogram, not as the corpus, and is sent to the tasks.

Pieces get their rank within a length from counts by hash block, a block holding about
``BLOCK_ROWS`` rows, so no length is ranked in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusql.llm.bpe import PATTERN, Encoder, Vocabulary, default_vocabulary
from corpusql.llm.common import written

SIZE = 1024
END_ID = 0
BLOCK_ROWS = 50_000


@dataclass
class Item:
    """Pieces of one length with ranks from ``rank`` on, one in each pack of a group.

    ``start`` and ``size`` say which part of the piece; it stands at ``offset``.
    """

    length: int
    rank: int
    start: int
    size: int
    offset: int


@dataclass
class Group:
    """``count`` packs alike, with sequence ids from ``first`` on."""

    first: int
    count: int
    fill: int
    items: list[Item] = field(default_factory=list)

    def split(self, n: int) -> Group:
        """Cuts off all but the first ``n`` packs and returns them."""
        rest = Group(
            self.first + n, self.count - n, self.fill,
            [Item(i.length, i.rank + n, i.start, i.size, i.offset) for i in self.items],
        )
        self.count = n
        return rest


def pack_histogram(counts: dict[int, int], size: int = SIZE) -> list[Group]:
    """Groups of packs for ``counts`` pieces by length; sequence ids are gapless from 0."""
    by_fill: dict[int, list[Group]] = defaultdict(list)
    made = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            # The shortest pack; every open pack has at least as little as the longest fill.
            fill = min((f for f, groups in by_fill.items() if groups and f + length <= size), default=None)
            if fill is None:
                group = Group(made, left, 0)
                made += left
            else:
                group = by_fill[fill].pop()
                if group.count > left:
                    by_fill[fill].append(group.split(left))
            group.items.append(Item(length, rank, 0, length, group.fill))
            group.fill += length
            rank += group.count
            left -= group.count
            by_fill[group.fill].append(group)
    return _closed([g for groups in by_fill.values() for g in groups], size)


def _closed(groups: list[Group], size: int) -> list[Group]:
    """Fills the gaps of the fullest packs from the emptiest; at most one pack keeps a gap."""
    done = [g for g in groups if g.fill == size]
    open_: dict[int, list[Group]] = defaultdict(list)
    for g in groups:
        if g.fill < size:
            open_[g.fill].append(g)
    while open_:
        low, high = min(open_), max(open_)
        giver = open_[low].pop()
        if not open_[low]:
            del open_[low]
        if high in open_:
            taker = open_[high].pop()
            if not open_[high]:
                del open_[high]
        elif giver.count == 1:
            done.append(giver)
            break
        else:
            taker = giver.split(giver.count // 2)
        if giver.count > taker.count:
            open_[giver.fill].append(giver.split(taker.count))
        elif taker.count > giver.count:
            open_[taker.fill].append(taker.split(giver.count))
        item = giver.items.pop()
        part = min(size - taker.fill, item.size)
        taker.items.append(Item(item.length, item.rank, item.start + item.size - part, part, taker.fill))
        taker.fill += part
        giver.fill -= part
        if part < item.size:
            giver.items.append(Item(item.length, item.rank, item.start, item.size - part, item.offset))
        if giver.items:
            open_[giver.fill].append(giver)
        (done if taker.fill == size else open_[taker.fill]).append(taker)
    # Emptied packs leave holes in the numbers.
    at = 0
    for group in sorted(done, key=lambda g: g.first):
        group.first = at
        at += group.count
    return done


class Plan:
    """For each length, ranges of ranks and where their parts go."""

    def __init__(self, groups: list[Group]):
        found: dict[int, list] = defaultdict(list)
        for g in groups:
            for i in g.items:
                found[i.length].append((i.rank, i.rank + g.count, i.start, i.size, g.first - i.rank, i.offset))
        self.bounds: dict[int, list[int]] = {}
        self.parts: dict[int, list[list[tuple[int, int, int, int]]]] = {}
        self.cut: set[int] = set()
        for length, ranges in found.items():
            bounds = sorted({edge for low, high, *_ in ranges for edge in (low, high)})
            parts: list[list] = [[] for _ in bounds]
            for low, high, start, size, shift, offset in ranges:
                for k in range(bisect_right(bounds, low) - 1, bisect_right(bounds, high - 1)):
                    parts[k].append((start, size, shift, offset))
                if size < length:
                    self.cut.add(length)
            self.bounds[length], self.parts[length] = bounds, [sorted(p) for p in parts]

    def of(self, length: int, rank: int) -> Iterator[tuple[int, int, int, int]]:
        """start, length, sequence and offset of each part of a piece."""
        for start, size, shift, offset in self.parts[length][bisect_right(self.bounds[length], rank) - 1]:
            yield start, size, rank + shift, offset


def _tokenizer(path: str):
    """ids of a text, as the vocabulary file defines them.

    tiktoken works on ranks; they say the same where every merge makes the next id, which is
    checked. Any other vocabulary goes through the tokenizers library. Texts that tiktoken gives
    up on (its pattern runs out of stack on a million blanks) go through this package's encoder.
    """
    vocabulary = Vocabulary(path)
    made = [i for _, i in vocabulary.ranks.values()]
    if made != list(range(256, 256 + len(made))) or sorted(vocabulary.byte_ids) != list(range(256)):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        return lambda text: np.array(library.encode(text, add_special_tokens=False).ids, "<u4")
    import tiktoken

    encoding = tiktoken.Encoding(
        "vocabulary", pat_str=PATTERN, mergeable_ranks=vocabulary.ids, special_tokens=vocabulary.special
    )
    slow: list[Encoder] = []

    def encode(text: str) -> np.ndarray:
        try:
            return encoding.encode_to_numpy(text, allowed_special="all").astype("<u4")
        except ValueError:
            if not slow:
                slow.append(Encoder(path))
            return np.frombuffer(b"".join(slow[0].ids([text])), "<u4")

    return encode


_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, rest binary"
)


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """Each document's ids and the end id, cut at multiples of ``size``.

    ``rest`` keeps the ids of pieces shorter than ``size``, which may be cut again.
    """
    path = path or default_vocabulary()

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(path)
        schema = pa.schema([
            ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
            ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("rest", pa.binary()),
        ])
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                for at in range(0, len(ids), size):
                    part = ids[at : at + size]
                    raw = part.tobytes()
                    rows.append((doc, at, len(part), zlib.crc32(raw), len(ids), raw if len(part) < size else None))
            columns = zip(*rows) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(job, _PIECES)


def packed(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids and one end id (null texts: the end id alone). Every id is in
    one piece, a sequence holds at most ``size`` ids without gaps, and all sequences but one
    are full. Repeated rows are packed each on its own; rows without a doc_id too. An empty
    table gives no rows. Only doc_id and text are read.
    """
    cut = written(pieces(docs, path, size), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # <= size rows
    plan = Plan(pack_histogram(histogram, size))
    total = sum(histogram.values())
    blocks = max(1, total // BLOCK_ROWS)
    placed = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks)))
    before = placed.groupBy("length", "block").count().select(
        "length", "block",
        F.coalesce(
            F.sum("count").over(
                Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
            ), F.lit(0),
        ).alias("before"),
    )
    # Ids travel only where a piece of this length is cut again.
    keep = F.col("length").isin(sorted(plan.cut)) if plan.cut else F.lit(False)
    ranked = (
        placed.withColumn("rest", F.when(keep, F.col("rest")))
        .withColumn(
            "within",
            F.row_number().over(
                Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
            ),
        )
        .join(before, ["length", "block"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rest",
                (F.col("before") + F.col("within") - 1).alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, start, length, crc, tokens, rest, rank in zip(*(c.to_pylist() for c in batch.columns)):
                for at, part, sequence, offset in plan.of(length, rank):
                    if part < length:
                        crc = zlib.crc32(rest[4 * at : 4 * (at + part)])
                    rows.append((doc, start + at, part, crc, tokens, sequence, offset))
            columns = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        place,
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
