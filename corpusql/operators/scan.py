"""Row numbers, ranks and neighbours within groups by one segmented scan.

A window sorts a group in one task, whatever its size. Here all rows are ordered once by group
and order, in ranges of about equal size that cut through groups, and equal rows, as they
must. A first look at each range gives one row: its first and last group, and how far the last
group has come. From those the carry into each range is worked out, and the second look adds
it. No group is special, so none is looked for first.

The ordered rows are cut off by a reliable checkpoint, as range bounds are sampled.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corpusql.sources.workspace import ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NUMBERS = {"row_number": "long", "rank": "long", "dense_rank": "long"}


@dataclass
class State:
    """How far a group has come: its last row's marks and value, and what was counted so far."""

    key: tuple[int, int] | None = None
    tie: tuple[int, int] | None = None
    rows: int = 0  # of the group
    start: int = 0  # row number at which the last run of ties began
    ties: int = 0  # runs of ties in the group
    value: Any = None


def _counted(state: State, key: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """New groups, row numbers, ranks and dense ranks of a batch that follows ``state``, which moves on."""
    n = len(key)
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]).any(axis=1)
    new[0] = state.key != tuple(key[0])
    run = new.copy()
    run[1:] |= (tie[1:] != tie[:-1]).any(axis=1)
    run[0] |= state.tie != tuple(tie[0])
    at = np.arange(n)
    group = np.maximum.accumulate(np.where(new, at, -1))  # -1: the group began before
    number = at - group + np.where(group < 0, state.rows, 1)
    begun = np.maximum.accumulate(np.where(run, at, -1))
    rank = np.where(begun < 0, state.start, number[begun])
    total = np.cumsum(run)
    # Runs since the group began, less those of the batch before it.
    dense = np.where(group < 0, state.ties + total, total - np.where(group > 0, total[np.maximum(group - 1, 0)], 0))
    state.key, state.tie = tuple(key[-1]), tuple(tie[-1])
    state.rows, state.start, state.ties = int(number[-1]), int(rank[-1]), int(dense[-1])
    return new, number, rank, dense


def _marks(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray]:
    pairs = [batch.column(first + i).to_numpy() for i in range(4)]
    return np.stack(pairs[:2], axis=1), np.stack(pairs[2:], axis=1)


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a range that has rows: where it begins, and its state at the end."""
    state, first, whole, kind, part = State(), None, True, pa.null(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, tie = _marks(batch, 1)
        value, kind = batch.column(5), batch.column(5).type
        if first is None:
            part = batch.column(0)[0].as_py() >> 33
            first = (tuple(key[0]), tuple(tie[0]), value[0].as_py())
        new, *_ = _counted(state, key, tie)
        whole = whole and not new[1:].any() and tuple(key[0]) == first[0]
        state.value = value[batch.num_rows - 1].as_py()
    if first is not None:
        numbers = [part, *first[0], *first[1], *state.key, *state.tie, state.rows, state.start, state.ties]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([int(x)], pa.int64()) for x in numbers), pa.array([whole]),
             pa.array([first[2]], kind), pa.array([state.value], kind)],
            [*_FIELDS, "whole", "first_value", "last_value"],
        )


_FIELDS = ["part", "k1", "k2", "t1", "t2", "last_k1", "last_k2", "last_t1", "last_t2", "rows", "start", "ties"]


def _carries(found: list) -> dict[int, tuple[State, tuple | None]]:
    """For each range the state before it, and the key and value of the row after it."""
    found = sorted(found, key=lambda r: r.part)
    out, state = {}, State()
    for r, after in zip(found, [*found[1:], None]):
        out[r.part] = state, None if after is None else ((after.k1, after.k2), after.first_value)
        now = State((r.last_k1, r.last_k2), (r.last_t1, r.last_t2), r.rows, r.start, r.ties, r.last_value)
        if r.whole and state.key == now.key:
            # The range is inside a group that began before: its counts go on from there.
            joined = state.tie == (r.t1, r.t2)
            only_tie = r.ties == 1
            now.start = state.start if joined and only_tie else state.rows + r.start
            now.ties = state.ties + r.ties - joined
            now.rows = state.rows + r.rows
        state = now
    return out


def _results(carries: dict[int, tuple[State, tuple | None]]) -> Callable:
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, after, held = None, None, None

        def finished(held: tuple, next_key: tuple | None, next_value: pa.Array) -> pa.RecordBatch:
            row, new, last, columns, value, previous = held
            same = np.append(~new[1:], next_key == last)
            following = pa.concat_arrays([value[1:], next_value])
            following = pc.if_else(pa.array(same), following, pa.scalar(None, value.type))
            return pa.RecordBatch.from_arrays([row, *columns, previous, following], _NAMES)

        for batch in batches:
            if not batch.num_rows:
                continue
            if state is None:
                before, after = carries[batch.column(0)[0].as_py() >> 33]
                state = State(**vars(before))
            key, tie = _marks(batch, 1)
            value, row = batch.column(5), batch.column(6)
            if held is not None:
                yield finished(held, tuple(key[0]), value[:1])
            last_value = pa.array([state.value], value.type)
            new, number, rank, dense = _counted(state, key, tie)
            previous = pc.if_else(
                pa.array(new), pa.scalar(None, value.type), pa.concat_arrays([last_value, value[:-1]])
            )
            state.value = value[batch.num_rows - 1].as_py()
            held = row, new, tuple(key[-1]), [pa.array(x) for x in (number, rank, dense)], value, previous
        if held is not None:
            next_key, next_value = after if after is not None else (None, None)
            yield finished(held, next_key, pa.array([next_value], held[4].type))

    return job


_NAMES = ["row", *NUMBERS, "prev", "next"]


def scanned(
    df: DataFrame, keys: list[str], order: list[Column], tie: Column | None = None, value: str | None = None
) -> DataFrame:
    """``df`` with row_number, rank, dense_rank, prev and next within the groups of ``keys``.

    Rows stand in the order of ``order``. Ranks treat rows as equal if ``tie`` is (by default: no
    two rows are). prev and next are ``value`` one row before and after, null where there is none.
    Null keys are a group. A row number is repeatable if ``order`` is total. Columns of ``df`` with
    these five names are replaced; the others may have any name.
    """
    ensure_checkpoint_dir(df.sparkSession)
    columns = [c for c in df.columns if c not in _NAMES[1:]]
    serial = F.monotonically_increasing_id()  # parts rows that are equal in everything else
    tie = serial if tie is None else tie
    mark = lambda seed, *c: F.xxhash64(F.lit(seed), *c)
    held = F.col(f"`{value}`") if value else F.lit(None).cast("int")
    fixed = (
        df.orderBy(*(F.col(f"`{k}`") for k in keys), *order, serial)
        .select(
            F.monotonically_increasing_id().alias("id"),
            *(mark(s, *(F.col(f"`{k}`") for k in keys)).alias(f"k{s}") for s in (1, 2)),
            *(mark(s, tie).alias(f"t{s}") for s in (1, 2)),
            held.alias("value"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"),
        ).checkpoint()
    )
    kind = fixed.schema["value"].dataType
    long = StructType.fromDDL(", ".join(f"{f} long" for f in _FIELDS) + ", whole boolean")
    found = fixed.drop("row").mapInArrow(
        _summary, StructType([*long.fields, StructField("first_value", kind), StructField("last_value", kind)])
    ).collect()  # a row for each range
    numbers = StructType.fromDDL(", ".join(f"{n} {t}" for n, t in NUMBERS.items()))
    out = StructType([
        StructField("row", fixed.schema["row"].dataType), *numbers.fields,
        StructField("prev", kind), StructField("next", kind),
    ])
    return fixed.mapInArrow(_results(_carries(found)), out).select("row.*", *_NAMES[1:])
