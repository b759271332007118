"""Positions inside groups, when one group may hold a third of all rows.

A window over a hot key sorts that key's rows in one task. Here a hot key is
cut into ranges of its order (``bucket``: a coarse column that ascends as the
order goes on, and never differs for equal rows), ranked per range, and shifted
by the size of the ranges before it. Groups of ordinary size keep the plain
window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

from corpusql.operators.sizing import broadcast_if_small
from corpusql.sources.workspace import ensure_checkpoint_dir

HOT_ROWS = 1_000_000
RANGES = 4096
#: Sketches of this size miss a place by 0.07 % of the rows in one case of a hundred.
SKETCH_SIZE = 4096
SKETCH_STEPS = 1024
SKETCH_SLACK = 2
SORTED_ROWS = 1_000_000


def _before(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _join_on(big: DataFrame, small: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Null-safe join with a table that is small unless proven otherwise."""
    renamed = small.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in small.columns if c not in keys],
    )
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    joined = big.join(broadcast_if_small(renamed), cond, how)
    return joined.drop(*[f"_r_{k}" for k in keys])


def split_hot_groups(
    df: DataFrame, keys: list[str], bucket: Column, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, bool]:
    """Add ``_range``: the bucket for rows of hot groups, null for all others.

    There are at most rows / ``hot_rows`` hot groups. The flag tells whether any exist.
    """
    hot = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_rows)
        .select(*keys, F.lit(True).alias("_hot"))
    )
    hot = hot.persist()
    if hot.isEmpty():
        return df.withColumn("_range", F.lit(None).cast("int")), False
    flagged = _join_on(df, hot, keys, "left")
    return flagged.withColumn("_range", F.when(F.col("_hot"), bucket)).drop("_hot"), True


def row_numbers(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    bucket: Column,
    out: str = "rn",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """ROW_NUMBER per group; ``order`` must be total for a repeatable result."""
    split, any_hot = split_hot_groups(df, keys, bucket, hot_rows)
    local = Window.partitionBy(*keys, "_range").orderBy(*order)
    numbered = split.withColumn(out, F.row_number().over(local))
    if not any_hot:
        return numbered.withColumn(out, F.col(out).cast("bigint")).drop("_range")
    shift = (
        split.where(F.col("_range").isNotNull())
        .groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(_before(keys, "_range")), F.lit(0)))
        .drop("_n")
    )
    return (
        _join_on(numbered, shift, [*keys, "_range"], "left")
        .withColumn(out, (F.col(out) + F.coalesce("_shift", F.lit(0))).cast("bigint"))
        .drop("_shift", "_range")
    )


def ranks(
    df: DataFrame,
    keys: list[str],
    order: Column,
    value: str,
    bucket: Column,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """RANK and DENSE_RANK by one column; equal values must share a bucket."""
    split, any_hot = split_hot_groups(df, keys, bucket, hot_rows)
    local = Window.partitionBy(*keys, "_range").orderBy(order)
    ranked = split.withColumns(
        {"rank": F.rank().over(local), "dense_rank": F.dense_rank().over(local)}
    )
    if not any_hot:
        big = {c: F.col(c).cast("bigint") for c in ("rank", "dense_rank")}
        return ranked.withColumns(big).drop("_range")
    # Distinct values are counted before they are added up, so a value that
    # repeats a billion times is one row here.
    values = (
        split.where(F.col("_range").isNotNull())
        .groupBy(*keys, "_range", value)
        .agg(F.count(F.lit(1)).alias("_n"))
        .groupBy(*keys, "_range")
        .agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_d"))
    )
    prior = _before(keys, "_range")
    shift = values.select(
        *keys,
        "_range",
        F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_n"),
        F.coalesce(F.sum("_d").over(prior), F.lit(0)).alias("_d"),
    )
    joined = _join_on(ranked, shift, [*keys, "_range"], "left")
    return joined.withColumns(
        {
            "rank": (F.col("rank") + F.coalesce("_n", F.lit(0))).cast("bigint"),
            "dense_rank": (F.col("dense_rank") + F.coalesce("_d", F.lit(0))).cast("bigint"),
        }
    ).drop("_n", "_d", "_range")


def neighbours(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    bucket: Column,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """LAG and LEAD of ``value`` by one row, as ``prev`` and ``next``."""
    split, any_hot = split_hot_groups(df, keys, bucket, hot_rows)
    local = Window.partitionBy(*keys, "_range").orderBy(*order)
    # Wrapped, so that a null value differs from no row.
    boxed = F.struct(F.col(value).alias("v"))
    linked = split.withColumns(
        {"_prev": F.lag(boxed).over(local), "_next": F.lead(boxed).over(local)}
    )
    if not any_hot:
        return linked.withColumns({"prev": F.col("_prev.v"), "next": F.col("_next.v")}).drop(
            "_prev", "_next", "_range"
        )
    place = F.struct(*order)
    edges = (
        split.where(F.col("_range").isNotNull())
        .groupBy(*keys, "_range")
        .agg(F.min_by(boxed, place).alias("_first"), F.max_by(boxed, place).alias("_last"))
    )
    across = Window.partitionBy(*keys).orderBy("_range")
    edges = edges.select(
        *keys,
        "_range",
        F.lag("_last").over(across).alias("_before"),
        F.lead("_first").over(across).alias("_after"),
    )
    joined = _join_on(linked, edges, [*keys, "_range"], "left")
    return joined.withColumns(
        {
            "prev": F.coalesce("_prev", "_before")["v"],
            "next": F.coalesce("_next", "_after")["v"],
        }
    ).drop("_prev", "_next", "_before", "_after", "_range")


def range_counts(df: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """Rows per group and range; folded map-side, so a hot group costs no more."""
    return df.groupBy(*keys, bucket.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))


def _ranges_at(
    df: DataFrame, keys: list[str], column: str, limits: DataFrame | int, take: str
) -> DataFrame:
    """``df`` with ``_range``: 0, 1 or 2 for before, around and after the place of the group's quota.

    A mergeable sketch of each group's order says which values stand around that place. It may be
    wrong, and then the place is in range 0 or 2; rows are counted afterwards, so only the size
    of what is sorted depends on it. Groups without a quota fall away.
    """
    kind = "double" if isinstance(df.schema[column].dataType, FractionalType) else "bigint"
    of_rows = getattr(F, f"kll_sketch_agg_{kind}")
    at = getattr(F, f"kll_sketch_get_quantile_{kind}")
    value = F.col(column).cast(kind)
    sketched = df.groupBy(*keys).agg(
        of_rows(value, F.lit(SKETCH_SIZE)).alias("_sketch"),
        F.count(value).alias("_n"),
        F.count_if(value.isNull()).alias("_nulls"),
    )
    if isinstance(limits, int):
        limited = sketched.withColumn(take, F.lit(limits))
    else:
        limited = _join_on(sketched, limits.select(*keys, take), keys, "inner")
    # Nulls come first. The fractions a sketch is asked for have to be constants.
    step = (F.col(take) - F.col("_nulls")) / F.col("_n") * SKETCH_STEPS
    steps = F.array(*[F.lit(i / SKETCH_STEPS) for i in range(SKETCH_STEPS + 1)])

    def edge(place: Column) -> Column:
        place = F.least(F.greatest(place, F.lit(0)), F.lit(SKETCH_STEPS)).cast("int")
        return F.when(F.col("_n") > 0, F.get(at("_sketch", steps), place))

    edges = limited.where(F.col(take) > 0).select(
        *keys,
        edge(F.floor(step) - SKETCH_SLACK).alias("_low"),
        edge(F.ceil(step) + SKETCH_SLACK).alias("_high"),
    )
    place = (
        F.when(value.isNull() | (value < F.col("_low")), 0).when(value > F.col("_high"), 2).otherwise(1)
    )
    return _join_on(df, edges, keys, "inner").withColumn("_range", place).drop("_low", "_high")


def _range_at(ranged: DataFrame, keys: list[str], limits: DataFrame | int, take: str) -> DataFrame:
    """Per group the ``_range`` in which its quota ends, how many rows of it are within
    (``_room``), and how many it has (``_rows``)."""
    running = range_counts(ranged, keys, F.col("_range")).withColumn(
        "_prior", F.coalesce(F.sum("_n").over(_before(keys, "_range")), F.lit(0))
    )
    # A few rows per group on one side, one row on the other.
    if isinstance(limits, int):
        limited = running.withColumn(take, F.lit(limits))
    else:
        limited = _join_on(running, limits.select(*keys, take), keys, "inner")
    room = F.least(F.col(take) - F.col("_prior"), F.col("_n"))
    return (
        limited.where(F.col("_prior") < F.col(take))
        .groupBy(*keys)
        .agg(
            F.max("_range").alias("_range"),
            F.max_by(room, "_range").alias("_room"),
            F.max_by("_n", "_range").alias("_rows"),
        )
    )


def quota_cutoffs(
    df: DataFrame,
    keys: list[str],
    bucket: Column | None,
    order: list[str],
    quotas: DataFrame | int,
    take: str = "take",
    sorted_rows: int = SORTED_ROWS,
) -> DataFrame:
    """Per group the place (``_cutoff``, a struct of ``order``) where its quota ends.

    Running counts over ranges of the order find the one range in which ``take``
    rows are reached; only that range is sorted. Groups that get nothing, or have
    no quota, have no row. ``quotas`` is a table of ``take`` per group, or one number
    for every group; ``order`` must be total, its last column a unique id. Null keys are a group.

    ``bucket`` makes the ranges. Without one the first column of the order must be a number, and
    sketches of it cut the ranges, whatever its distribution: about five of ``SKETCH_STEPS`` parts
    of a group are sorted, and if those are still over ``sorted_rows`` they are cut once more.
    """
    rows = df.select(*keys, *[c for c in order if c not in keys])
    if bucket is not None:
        ranged = rows.withColumn("_range", bucket)
        last = _range_at(ranged, keys, quotas, take)
    else:
        ranged = _ranges_at(rows, keys, order[0], quotas, take)
        last = _range_at(ranged, keys, quotas, take).persist()
        if (last.agg(F.max("_rows")).first()[0] or 0) > sorted_rows:
            rows = _join_on(ranged, last.select(*keys, "_range"), [*keys, "_range"], "inner").drop("_range")
            left = last.select(*keys, "_room")
            ranged = _ranges_at(rows, keys, order[0], left, "_room")
            last = _range_at(ranged, keys, left, "_room")
    inside = _join_on(ranged, last.drop("_rows"), [*keys, "_range"], "inner")
    place = Window.partitionBy(*keys).orderBy(*order)
    return (
        inside.withColumn("_rn", F.row_number().over(place))
        .where(F.col("_rn") == F.col("_room"))
        .select(*keys, F.struct(*order).alias("_cutoff"))
    )


def mark_within(
    df: DataFrame, keys: list[str], order: list[str], cutoffs: DataFrame, out: str
) -> DataFrame:
    """Add a boolean: is the row within its group's cutoff? A map-side join, no shuffle."""
    joined = _join_on(df, cutoffs, keys, "left")
    reached = F.coalesce(F.struct(*order) <= F.col("_cutoff"), F.lit(False))
    return joined.withColumn(out, reached).drop("_cutoff")


def range_of(df: DataFrame, column: str, ranges: int = RANGES) -> Column:
    """An order-preserving bucket of a numeric column of ``df``."""
    ends = df.agg(
        F.struct(
            F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")
        ).alias("ends")
    ).scalar()
    width = (ends["hi"] - ends["lo"]) / ranges
    return F.when(
        width > 0, F.floor((F.col(column) - ends["lo"]) / width).cast("int")
    ).otherwise(F.lit(0))


def with_positions(df: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """1-based position in a total order over all rows.

    Rows are range-partitioned and sorted, then cut off by a reliable checkpoint:
    range bounds are sampled, so a second evaluation could place rows otherwise.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ordered = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    fixed = ordered.checkpoint().withColumns(
        {
            "_part": F.shiftright("_id", 33),
            "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    # One row per partition, however many rows there are.
    starts = (
        fixed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(_before([], "_part")), F.lit(0)))
        .drop("_n")
    )
    return (
        _join_on(fixed, starts, ["_part"], "left")
        .withColumn(out, F.col("_start") + F.col("_at") + 1)
        .drop("_id", "_part", "_at", "_start")
    )


def exact_percentiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    fractions: dict[str, float],
) -> DataFrame:
    """PERCENTILE_CONT and PERCENTILE_DISC per group, exact, nulls ignored.

    Equal values are counted first. A mergeable sketch cuts each group into
    ranges of about equal weight; running counts tell which ranges hold the
    wanted positions, and only those ranges are ordered.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    # 255 splits make 16 x 16 ranges, found by looking at 15 coarse and 15 fine splits.
    side = 16
    ranges = side * side
    steps = [i / ranges for i in range(1, ranges)]
    # The sketch reads the uncounted rows, so its splits weigh rows, not values.
    sketch = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.percentile_approx(value, steps, 10 * ranges).alias("_splits"),
        F.count(F.lit(1)).alias("_total"),
    )
    sketch = sketch.withColumn(
        "_coarse", F.array(*[F.col("_splits")[i * side - 1] for i in range(1, side)])
    )

    def splits_below(splits: Column) -> Column:
        return F.size(F.filter(splits, lambda s: s < F.col("_v")))

    ranged = (
        _join_on(counted, sketch, keys, "inner")
        .withColumn("_block", splits_below(F.col("_coarse")))
        .withColumn(
            "_range",
            F.col("_block") * side
            + splits_below(F.slice("_splits", F.col("_block") * side + 1, side - 1)),
        )
        .drop("_splits", "_coarse", "_block")
    )
    # Positions (1-based) each fraction needs: two for CONT, one for DISC.
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(p).alias("p"),
                (F.floor(F.lit(p) * (F.col("_total") - 1)) + 1).alias("lo"),
                (F.ceil(F.lit(p) * (F.col("_total") - 1)) + 1).alias("hi"),
                F.greatest(F.ceil(F.lit(p) * F.col("_total")), F.lit(1)).alias("disc"),
            )
            for name, p in fractions.items()
        ]
    )
    running = (
        ranged.groupBy(*keys, "_range", "_total")
        .agg(F.sum("_w").alias("_n"))
        .withColumn("_prior", F.coalesce(F.sum("_n").over(_before(keys, "_range")), F.lit(0)))
    )
    needed = (
        running.withColumn("_want", F.explode(wanted))
        .where(
            (F.col("_prior") < F.col("_want.hi"))
            & (F.col("_prior") + F.col("_n") >= F.col("_want.lo"))
            | (F.col("_prior") < F.col("_want.disc"))
            & (F.col("_prior") + F.col("_n") >= F.col("_want.disc"))
        )
        .groupBy(*keys, "_range")
        .agg(F.first("_prior").alias("_prior"), F.collect_set("_want").alias("_wants"))
    )
    inside = Window.partitionBy(*keys, "_range").orderBy("_v")
    reach = _join_on(ranged.select(*keys, "_range", "_v", "_w", "_total"), needed,
                     [*keys, "_range"], "inner").withColumn(
        "_upto", F.col("_prior") + F.sum("_w").over(inside)
    )
    hits = reach.withColumn("_from", F.col("_upto") - F.col("_w") + 1).select(
        *keys, "_v", "_from", "_upto", "_total", F.explode("_wants").alias("w")
    )

    def at(position: str) -> Column:
        return F.max(F.when(F.col(position).between(F.col("_from"), F.col("_upto")), F.col("_v")))

    weight = F.col("p") * (F.col("_total") - 1) - F.floor(F.col("p") * (F.col("_total") - 1))
    return (
        hits.groupBy(*keys, F.col("w.name").alias("name"), F.col("w.p").alias("p"), "_total")
        .agg(at("w.lo").alias("_lo"), at("w.hi").alias("_hi"), at("w.disc").alias("disc"))
        .select(
            *keys,
            "name",
            (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * weight).alias("cont"),
            "disc",
        )
    )
