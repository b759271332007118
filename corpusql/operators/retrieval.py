"""Exact vector top-k of registered tables for questions."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from corpusql.functions.vectors import cosine_distance
from corpusql.operators import pivots
from corpusql.operators.sizing import broadcast_if_small

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP_K = 5
BLOCK_ROWS = 2048
#: A registry up to this size is sent to the tasks as a whole.
FIT_BYTES = 64 << 20
#: Distances that are worked out at a time.
CELLS = 8_000_000
# Distances are ranked at this precision, so that equal vectors tie.
RANK_DIGITS = 9
# Distances that are numbers come first, then those of zero vectors, then unknown ones.
NUMBER, UNDEFINED, MISSING = 0, 1, 2


def retrieve_tables(
    registry: DataFrame, schema_name: str, question_vector: Column, k: int | None = None
) -> DataFrame:
    """Tables of one schema nearest to one vector; ``k`` of 0 or None means 5."""
    distance = F.round(cosine_distance(F.col("embedding"), question_vector), RANK_DIGITS)
    return (
        registry.where(F.col("schema_name") == schema_name)
        .withColumn("distance", distance)
        .orderBy(F.col("distance").asc_nulls_last(), F.col("table_name"))
        .limit(k or TOP_K)
    )


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    """Rows at unit length; NaN where the vector is zero."""
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return matrix / norms


class Tables:
    """Tables of one schema or block, ready to be searched; ties go to the first name, then row."""

    def __init__(self, tables: pd.DataFrame):
        tables = tables.sort_values(["table_name", "row_key"], kind="stable")
        self.names = tables["table_name"].to_numpy()
        self.keys = tables["row_key"].to_numpy()
        self.known = tables["t_vec"].notna().to_numpy()
        self.unit = _unit_rows(tables["t_vec"][self.known]) if self.known.any() else None

    def nearest(self, questions: pd.DataFrame, k: int) -> pd.DataFrame:
        """The ``k`` nearest of each question, nearest first; memory for ``CELLS`` distances."""
        step = max(1, CELLS // max(1, len(self.names)))
        parts = [self._nearest(questions.iloc[at : at + step], k) for at in range(0, len(questions), step)]
        return pd.concat(parts, ignore_index=True)

    def _nearest(self, questions: pd.DataFrame, k: int) -> pd.DataFrame:
        q_ok = questions["q_vec"].notna().to_numpy()
        dist = np.full((len(questions), len(self.names)), np.nan)
        if q_ok.any() and self.unit is not None:
            cos = _unit_rows(questions["q_vec"][q_ok]) @ self.unit.T
            dist[np.ix_(q_ok, self.known)] = np.round(1.0 - cos, RANK_DIGITS) + 0.0  # no negative zero
        known = q_ok[:, None] & self.known[None, :]
        kind = np.where(~known, MISSING, np.where(np.isnan(dist), UNDEFINED, NUMBER))
        # Candidates are all tables no farther than the k-th number, ties included;
        # only they are ordered: kind, distance, then name and row.
        key = np.where(kind == NUMBER, dist, np.inf)
        bound = np.partition(key, k - 1, axis=1)[:, [k - 1]] if k < key.shape[1] else np.inf
        row, col = np.nonzero(key <= bound)
        order = np.lexsort((col, dist[row, col], kind[row, col], row))
        row, col = row[order], col[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col, place = row[place < k], col[place < k], place[place < k]
        found = questions.drop(columns=["q_vec"]).iloc[row].reset_index(drop=True)
        return found.assign(
            table_name=self.names[col], row_key=self.keys[col], distance=dist[row, col],
            kind=kind[row, col].astype("int32"), rank=(place + 1).astype("int32"),
        )


def with_row_key(registry: DataFrame) -> DataFrame:
    """``registry`` with ``row_key``, a hash of the whole row: nothing else names a row for sure."""
    columns = [
        F.to_json(c) if isinstance(registry.schema[c].dataType, MapType) else F.col(c)
        for c in registry.columns
    ]
    return registry.withColumn("row_key", F.xxhash64(*columns))


def vector_topk(
    questions: DataFrame,
    registry: DataFrame,
    k: int | None = None,
    block_rows: int = BLOCK_ROWS,
    fit_bytes: int = FIT_BYTES,
) -> DataFrame:
    """question_id, rank, table_name and distance; see ``ranked_rows``."""
    ranked = ranked_rows(questions.select("question_id", "schema_name", "embedding"),
                         with_row_key(registry), k, block_rows, fit_bytes)
    return ranked.select("question_id", "rank", "table_name", "distance")


def fits(registry: DataFrame, most: int = FIT_BYTES) -> bool:
    """Whether what retrieval needs of the registry takes at most ``most`` bytes in a task."""
    size = 8 * F.coalesce(F.size("embedding"), F.lit(0)) + F.coalesce(F.octet_length("table_name"), F.lit(0)) + 64
    return (registry.agg(F.sum(size)).first()[0] or 0) <= most


def _numbers(df: DataFrame) -> Column:
    """``embedding`` as it moves: single precision stays so, all else is double. Tasks work in double."""
    single = df.schema["embedding"].dataType.simpleString() == "array<float>"
    return F.col("embedding") if single else F.col("embedding").cast("array<double>")


def ranked_rows(
    questions: DataFrame,
    registry: DataFrame,
    k: int | None = None,
    block_rows: int = BLOCK_ROWS,
    fit_bytes: int = FIT_BYTES,
) -> DataFrame:
    """The ``k`` nearest tables of its own schema for every question, and all its other columns.

    Both ways are exact. A registry of at most ``fit_bytes`` goes to every task, and the
    questions are searched where they are: no exchange. A larger one is cut into blocks
    around pivots, see ``operators/pivots.py``. Rows are told apart by ``row_key``, as a table
    name may repeat; question_id must not.
    """
    k = k or TOP_K
    asked = questions.withColumn("q_vec", _numbers(questions)).drop("embedding")
    tables = registry.select("schema_name", "table_name", "row_key", _numbers(registry).alias("t_vec"))
    if fits(registry, fit_bytes):
        ranked = _ranked_in_place(asked, tables, k)
    else:
        ranked = pivots.ranked(asked.select("question_id", "schema_name", "q_vec"), tables, k, block_rows)
        ranked = asked.drop("q_vec").join(ranked, "question_id")
    return ranked.withColumn(
        "distance",  # Arrow hands NaN over as null, so it is set again here.
        F.when(F.col("kind") == NUMBER, F.col("distance"))
        .when(F.col("kind") == UNDEFINED, F.lit(float("nan"))),
    ).drop("kind")


RANKED = "table_name string, row_key bigint, distance double, kind int, rank int"


def _ranked_in_place(questions: DataFrame, tables: DataFrame, k: int) -> DataFrame:
    held = {name: Tables(own) for name, own in tables.toPandas().groupby("schema_name")}

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The function carries the tables, by value; Spark broadcasts functions beyond 1 MB.
        for batch in batches:
            for name, own in batch.groupby("schema_name"):
                if name in held:
                    yield held[name].nearest(own, k)

    kept = questions.drop("q_vec").schema
    return questions.mapInPandas(search, StructType([*kept.fields, *StructType.fromDDL(RANKED).fields]))


def schema_not_found(questions: DataFrame, registry: DataFrame) -> DataFrame:
    """Questions about a schema that has no tables."""
    known = registry.select("schema_name").distinct()
    return questions.join(broadcast_if_small(known), "schema_name", "left_anti")


def retrieval_batch(
    questions: DataFrame, registry: DataFrame, k: int | None = None, fit_bytes: int = FIT_BYTES
) -> DataFrame:
    """Ranked registry rows per question, ready for prompt building."""
    keyed = with_row_key(registry)
    asked = questions.select("question_id", "schema_name", "question", "embedding")
    ranked = ranked_rows(asked, keyed, k, fit_bytes=fit_bytes)
    # Rows equal in every column have one key and, ranked each, the same content.
    tables = keyed.drop("embedding").dropDuplicates(["row_key"])
    return ranked.join(tables, ["schema_name", "table_name", "row_key"]).drop("row_key")
