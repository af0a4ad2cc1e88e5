"""Lag, gaps and row numbers over long ordered sequences without a single-task sort.

Two facts keep every task bounded however the rows are spread over groups:

* An ordering key that is unique inside a group can be cut into slices. Lag runs inside a
  slice; the one row per slice that needs the slice before it is served from a table with one
  row per slice. Dense keys (row numbers) are cut at fixed widths. Sparse or hashed keys are cut
  by counts: a group's range is divided so that a slice would hold the wanted number of rows,
  and slices that turn out to hold many more are divided again, level by level.
* Two rows in one time slot of width ``g`` are never more than ``g`` seconds apart, so gaps
  longer than ``g`` are visible from the first and last row of each slot alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugelake.functions import wallclock
from gaugelake.session import stage

SLICE_ROWS = 1_000_000


def _slice(order: str, width: int) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("bigint")


DENSE_FACTOR = 4
_EDGES_TOGETHER = 4_096


def counted_slices(df: DataFrame, groups: Sequence[str], order: str, rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` plus ``slice_no``, an array that orders slices of about ``rows`` rows each.

    Every level counts the rows of what is too full to be one slice and divides its range
    evenly; its table has at most one row per ``DENSE_FACTOR * rows`` rows. Keys are unique in a
    group, so ranges end up small enough. Null groups and keys are values of their own.
    """
    wide = F.col(order).cast("decimal(20,0)")
    cut = df.withColumn("slice_no", F.array().cast("array<bigint>"))
    keys, most = [*groups, "slice_no"], rows
    while True:
        found = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi"))
        span = F.col("hi").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)") + 1
        width = F.ceil(span / F.ceil(F.col("n") / rows)).cast("decimal(20,0)")
        full = stage(found.where((F.col("n") > most) & (F.col("lo") < F.col("hi"))).select(*keys, "lo", width.alias("width")), "slices")
        if full.isEmpty():
            return cut
        number = F.floor((wide - F.col("lo").cast("decimal(20,0)")) / F.col("width")).cast("bigint")
        joined = _null_safe(cut, full, keys, "left")
        cut = joined.withColumn(
            "slice_no", F.when(F.col("width").isNull(), F.col("slice_no")).otherwise(F.concat("slice_no", F.array(number)))
        ).drop("lo", "width")
        most = DENSE_FACTOR * rows


def _edge_before(edges: DataFrame, groups: list[str]) -> DataFrame:
    """``slice_before``: last values of the slice before each, in two levels of windows.

    No window holds more than ``_EDGES_TOGETHER`` first-level slices and what they were divided
    into, or one row for each of those.
    """
    many = F.floor(F.coalesce(F.get("slice_no", F.lit(0)), F.lit(0)) / _EDGES_TOGETHER).alias("run_no")
    edges = edges.select(*groups, "slice_no", "last_values", many)
    inner = W.partitionBy(*groups, "run_no").orderBy("slice_no")
    inside = edges.withColumn("near", F.lag(F.struct("last_values")).over(inner))
    runs = edges.groupBy(*groups, "run_no").agg(F.max(F.struct("slice_no", "last_values")).alias("last"))
    outer = W.partitionBy(*groups).orderBy("run_no")
    runs = runs.select(*groups, "run_no", F.lag("last").over(outer).alias("far"))
    joined = _null_safe(inside, runs, [*groups, "run_no"], "left")
    before = F.when(F.col("near").isNotNull(), F.col("near.last_values")).otherwise(F.col("far.last_values"))
    return joined.select(*groups, "slice_no", before.alias("slice_before"))


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join by name in which null matches null; key columns come from the left."""
    renamed = right.withColumnsRenamed({k: f"right_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys]
    return left.join(renamed, match, how).drop(*(f"right_{k}" for k in keys))


def sliced_lag(
    df: DataFrame, groups: Sequence[str], order: str, values: Sequence[str],
    width: int | None = SLICE_ROWS, rows: int = SLICE_ROWS,
) -> DataFrame:
    """``df`` plus ``previous_<value>`` from the row before it in its group.

    ``order`` must be unique inside a group: a slice then holds at most ``width`` rows. Without
    a width, for sparse keys, slices are cut by counts and hold about ``rows`` rows. Null is a
    group of its own.
    """
    groups, values = list(groups), list(values)
    if width is None:
        sliced = stage(counted_slices(df, groups, order, rows), "sliced")
    else:
        sliced = df.withColumn("slice_no", _slice(order, width))
    inner = W.partitionBy(*groups, "slice_no").orderBy(order)
    lagged = sliced.select(
        "*",
        *[F.lag(v).over(inner).alias(f"previous_{v}") for v in values],
        F.lag(order).over(inner).isNull().alias("opens_slice"),
    )
    # One fixed-width aggregate per value keeps this a hash aggregation.
    edges = sliced.groupBy(*groups, "slice_no").agg(
        *[F.max_by(v, order).alias(v) for v in values]
    ).select(*groups, "slice_no", F.struct(*values).alias("last_values"))
    if width is None:
        before = _edge_before(edges, groups)
    else:
        by_slice = W.partitionBy(*groups).orderBy("slice_no")
        before = edges.select(
            *groups, "slice_no", F.lag("last_values").over(by_slice).alias("slice_before")
        )
    # Same keys as the window above, so the rows stay where they are.
    joined = _null_safe(lagged, before, [*groups, "slice_no"], "left")
    filled = [
        F.when(F.col("opens_slice"), F.col(f"slice_before.{v}"))
        .otherwise(F.col(f"previous_{v}"))
        .alias(f"previous_{v}")
        for v in values
    ]
    return joined.select(*df.columns, *filled)


def deltas(
    df: DataFrame, groups: Sequence[str], order: str, ts: str, width: int = SLICE_ROWS
) -> DataFrame:
    """Seconds between neighbours in source order: ``groups``, ``seconds``, one row per pair.

    Slice interiors and slice borders are two small unions, so no row-level join is needed.
    """
    groups = list(groups)
    sliced = df.where(F.col(ts).isNotNull()).select(
        *groups, order, ts, _slice(order, width).alias("slice_no")
    )
    inner = W.partitionBy(*groups, "slice_no").orderBy(order)
    interior = sliced.select(*groups, F.lag(ts).over(inner).alias("before"), F.col(ts).alias("after"))
    edges = sliced.groupBy(*groups, "slice_no").agg(
        F.min_by(ts, order).alias("after"), F.max_by(ts, order).alias("last_ts")
    )
    by_slice = W.partitionBy(*groups).orderBy("slice_no")
    borders = edges.select(*groups, F.lag("last_ts").over(by_slice).alias("before"), "after")
    return (
        interior.unionByName(borders)
        .where(F.col("before").isNotNull())
        .select(*groups, wallclock.seconds_between(F.col("before"), F.col("after")).alias("seconds"))
    )


def order_violations(
    df: DataFrame, groups: Sequence[str], order: str, values: Sequence[str],
    width: int = SLICE_ROWS,
) -> DataFrame:
    """Per group, how many rows sort before the row above them: ``groups``, ``violations``."""
    groups = list(groups)
    sliced = df.select(*groups, order, *values, _slice(order, width).alias("slice_no"))
    inner = W.partitionBy(*groups, "slice_no").orderBy(order)
    here = F.struct(*values)
    interior = sliced.select(*groups, F.lag(here).over(inner).alias("before"), here.alias("after"))
    edges = sliced.groupBy(*groups, "slice_no").agg(
        *[F.min_by(v, order).alias(f"first_{v}") for v in values],
        *[F.max_by(v, order).alias(f"last_{v}") for v in values],
    ).select(
        *groups, "slice_no",
        F.struct(*[F.col(f"first_{v}").alias(v) for v in values]).alias("after"),
        F.struct(*[F.col(f"last_{v}").alias(v) for v in values]).alias("last_values"),
    )
    by_slice = W.partitionBy(*groups).orderBy("slice_no")
    borders = edges.select(*groups, F.lag("last_values").over(by_slice).alias("before"), "after")
    return interior.unionByName(borders).groupBy(*groups).agg(
        F.count_if(F.col("after") < F.col("before")).alias("violations")
    )


# First rows are compared as one number: microseconds, then the order value shifted to be
# non-negative. Decimals aggregate in place, so slots need no sort of their rows.
_ORDER_RANGE = "100000000000000000000"
_ORDER_SHIFT = "9223372036854775808"


def slot_table(
    df: DataFrame, groups: Sequence[str], ts: str, order: str, width_seconds: int
) -> DataFrame:
    """First row (its ``ts`` and ``order``) and last timestamp of every time slot.

    One scan, combined map-side. ``order`` is an integer column.
    """
    rank = (
        wallclock.ordinal_micros(F.col(ts)) * F.expr(_ORDER_RANGE)
        + (F.col(order).cast("decimal(20,0)") + F.expr(_ORDER_SHIFT))
    ).cast("decimal(38,0)")
    return (
        df.where(F.col(ts).isNotNull())
        .select(
            *groups, F.col(ts).alias("slot_ts"), rank.alias("row_rank"),
            F.to_date(ts).alias("slot_day"), wallclock.slot(F.col(ts), width_seconds).alias("slot_no"),
        )
        .groupBy(*groups, "slot_day", "slot_no")
        .agg(
            F.min("slot_ts").alias("first_ts"), F.max("slot_ts").alias("last_ts"),
            F.min("row_rank").alias("first_rank"),
        )
        .select(
            *groups, "slot_day", "slot_no", "first_ts", "last_ts",
            (F.col("first_rank") % F.expr(_ORDER_RANGE) - F.expr(_ORDER_SHIFT)).cast("bigint").alias(
                "first_order"
            ),
        )
    )


def sampling_gaps(
    df: DataFrame, groups: Sequence[str], ts: str, order: str, gap_seconds: int
) -> DataFrame:
    """Rows that follow a gap of more than ``gap_seconds`` in (ts, order) order.

    Columns: ``groups``, ``order``, ``previous_<ts>``, ``<ts>``, ``interval_seconds``. The slot
    table is staged, so the rows are scanned once. A slot never spans two days, a day has at
    most 86400 / slot width slots, and the day table has one row per calendar day.
    """
    groups = list(groups)
    slots = stage(slot_table(df, groups, ts, order, _day_divisor(gap_seconds)), "slots")
    in_day = W.partitionBy(*groups, "slot_day").orderBy("slot_no")
    lagged = slots.withColumn("in_day_before", F.lag("last_ts").over(in_day))
    days = slots.groupBy(*groups, "slot_day").agg(F.max("last_ts").alias("day_last"))
    by_day = W.partitionBy(*groups).orderBy("slot_day")
    days = days.select(*groups, "slot_day", F.lag("day_last").over(by_day).alias("day_before"))
    before = F.coalesce("in_day_before", "day_before")
    return (
        _null_safe(lagged, days, [*groups, "slot_day"], "inner")
        .select(
            *groups, F.col("first_order").alias(order), before.alias(f"previous_{ts}"),
            F.col("first_ts").alias(ts),
            wallclock.seconds_between(before, F.col("first_ts")).alias("interval_seconds"),
        )
        .where(F.col("interval_seconds") > gap_seconds)
    )


def _day_divisor(seconds: int) -> int:
    """Largest slot width up to ``seconds`` that divides a day, so slots never cross midnight."""
    return max(w for w in range(1, min(seconds, 86_400) + 1) if 86_400 % w == 0)
