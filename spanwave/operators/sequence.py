"""Ordered operators over groups of any length.

A plain window sorts a whole group inside one task, so one long group (a sensor, a file, an
event) would decide the run time. Here every group is cut into tiles (usually fixed time spans);
the row-level window runs per (group, tile), and only one summary row per tile is ordered per
group. Tile results then meet the rows again on the same (group, tile) keys, which keeps the
row-level side on the partitioning it already has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(keys: Sequence[str], tile: str):
    return Window.partitionBy(*keys).orderBy(tile).rowsBetween(Window.unboundedPreceding, -1)


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    tile: str,
    name: str = "ordinal",
    *,
    size: str | None = None,
    in_place: bool = False,
) -> DataFrame:
    """Add the 0-based position of each row in its group, and the group's row count as ``size``.

    ``tile`` must not decrease along ``order``. With ``in_place`` the tile counts are merged with the rows
    where these were sorted; else rows that take few bytes may all be sent to the few tasks of the counts.
    """
    sizes = (
        df.groupBy(*keys, tile)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(_before(keys, tile)), F.lit(0)))
    )
    if size is not None:
        sizes = sizes.withColumn(size, F.sum("_n").over(Window.partitionBy(*keys)))
    sizes = sizes.drop("_n").hint("merge") if in_place else sizes.drop("_n")
    local = Window.partitionBy(*keys, tile).orderBy(*order)
    return (
        df.withColumn("_local", F.row_number().over(local) - 1)
        .join(sizes, [*keys, tile])
        .withColumn(name, (F.col("_base") + F.col("_local")).cast("bigint"))
        .drop("_base", "_local")
    )


def fill_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    tile: str,
    values: dict[str, Column],
    *,
    backward: bool = False,
    presence: bool = False,
) -> DataFrame:
    """Add, per row, the latest non-NULL of each value at or before it in its group.

    With ``backward`` the nearest non-NULL at or after the row. With ``presence`` also
    ``<name>_present``, whether the group holds the value at all. ``order`` must be unique per group
    for a fixed result.
    """
    sorting = [F.col(c) if isinstance(c, str) else c for c in order]
    place = F.struct(*sorting)
    directed = [c.desc() if backward else c.asc() for c in sorting]
    within = (
        Window.partitionBy(*keys, tile)
        .orderBy(*directed)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    tile_order = F.col(tile).desc() if backward else F.col(tile).asc()
    across = (
        Window.partitionBy(*keys).orderBy(tile_order).rowsBetween(Window.unboundedPreceding, -1)
    )
    pick = F.min_by if backward else F.max_by
    edges = df.groupBy(*keys, tile).agg(
        *[
            pick(value, F.when(value.isNotNull(), place)).alias(f"_edge_{name}")
            for name, value in values.items()
        ]
    )
    carries = edges.select(
        *keys,
        tile,
        *[F.last(f"_edge_{n}", ignorenulls=True).over(across).alias(f"_carry_{n}") for n in values],
        *[
            F.max(F.col(f"_edge_{n}").isNotNull()).over(Window.partitionBy(*keys)).alias(f"{n}_present")
            for n in values
            if presence
        ],
    )
    filled = df.withColumns(
        {f"_seen_{n}": F.last(v, ignorenulls=True).over(within) for n, v in values.items()}
    )
    joined = filled.join(carries, [*keys, tile])
    return joined.withColumns(
        {n: F.coalesce(F.col(f"_seen_{n}"), F.col(f"_carry_{n}")) for n in values}
    ).drop(*[f"_seen_{n}" for n in values], *[f"_carry_{n}" for n in values])


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    size: int,
    aggregates: dict[str, Column],
    *,
    span: int = 4096,
) -> DataFrame:
    """Aggregate the ``size`` rows before each row; NULL until that many exist.

    ``position`` is the 0-based ordinal in the group. Groups are cut into spans of rows, and each
    span also gets the ``size`` rows that precede it, so a span never needs its neighbours.
    """
    span = max(span, size)
    block = F.floor(F.col(position) / F.lit(span))
    feeds_next = F.pmod(F.col(position), F.lit(span)) >= span - size
    copies = df.withColumn(
        "_span", F.explode(F.when(feeds_next, F.array(block, block + 1)).otherwise(F.array(block)))
    )
    window = Window.partitionBy(*keys, "_span").orderBy(position).rowsBetween(-size, -1)
    full = F.count(F.lit(1)).over(window) == size
    return (
        copies.withColumns({n: F.when(full, a.over(window)) for n, a in aggregates.items()})
        .filter(F.col("_span") == block)
        .drop("_span")
    )


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    *,
    bins: int = 10_000,
) -> DataFrame:
    """Exact linear-interpolation quantiles per group, without holding a group in one task.

    Two scans of ``df``. The first keeps a mergeable summary of every group, whose ranks are off by at
    most ``1 / bins`` of the rows; it gives two pivots around each wanted rank. The second counts
    equal values once; what lies below the pivots is only counted, what lies above is dropped, and the
    values between them, some ``4 / bins`` of the group, are ordered. NULL is no value, NaN
    the largest. Columns: ``keys``, ``probability``, ``quantile``.
    """
    if not keys:
        # A NULL group from no rows at all falls out.
        whole = quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probabilities, bins=bins)
        return whole.drop("_all")
    keys, wanted = list(keys), sorted({float(p) for p in probabilities})
    known = df.select(*keys, value).filter(F.col(value).isNotNull())
    margin = 2 / bins
    around = [max(0.0, p - margin) for p in wanted] + [min(1.0, p + margin) for p in wanted]
    summary = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(value).alias("_least"),
        F.max(value).alias("_most"),
        F.percentile_approx(value, around, bins).alias("_around"),
    )
    # With few rows a pivot may be off by more than the margin; then the whole group lies between.
    sure = F.col("_n") >= 4 * bins
    at = lambda i: F.get("_around", F.lit(i))
    pivots = [
        F.struct(
            F.lit(p).alias("probability"),
            (F.when(sure, at(i)) if p > margin else F.lit(None)).alias("low"),
            (F.when(sure, at(len(wanted) + i)) if p < 1 - margin else F.lit(None)).alias("high"),
        )
        for i, p in enumerate(wanted)
    ]
    limits = summary.select(*keys, "_n", F.array(*pivots).alias("_p"))
    counted = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_same"))
    low, high = F.col("_pivot.low"), F.col("_pivot.high")
    bracket = (
        counted.join(limits, keys)
        .withColumn("_pivot", F.explode("_p"))
        .filter(high.isNull() | (F.col(value) <= high))
        .groupBy(*keys, "_n", "_pivot.probability", F.when(low.isNull() | (F.col(value) >= low), F.col(value)).alias("_v"))
        .agg(F.sum("_same").alias("_same"))
    )
    # What lies below the low pivot is one row without a value, before all others.
    before = Window.partitionBy(*keys, "probability").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("probability") * (F.col("_n") - 1)
    first = F.coalesce(F.sum("_same").over(before), F.lit(0))
    ranked = bracket.withColumns({"_first": first, "_at": place}).withColumn("_end", F.col("_first") + F.col("_same"))
    holds = lambda rank: F.when((rank >= F.col("_first")) & (rank < F.col("_end")), F.col("_v"))
    return (
        ranked.groupBy(*keys, "probability")
        .agg(
            F.max(holds(F.floor("_at"))).alias("_low"),
            F.max(holds(F.ceil("_at"))).alias("_high"),
            F.first(F.col("_at") - F.floor("_at")).alias("_part"),
        )
        .select(*keys, "probability", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("quantile"))
    )
