"""Dataset profiling: observations about a table, never a change to it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake.functions import wallclock
from gaugelake.operators import metrics, ordered


def column_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count and percentage per column from one scan."""
    counted = df.agg(
        F.count(F.lit(1)).alias("total_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    long = counted.unpivot(["total_rows"], list(columns), "column_name", "null_count")
    return long.select(
        "column_name", "null_count",
        (F.col("null_count") * 100 / F.col("total_rows")).alias("null_percentage"),
    )


def unreadable_values(df: DataFrame, readers: Mapping[str, Column]) -> DataFrame:
    """Present texts that do not convert, per column; ``readers`` maps column to conversion."""
    counted = df.agg(
        *[
            F.count_if(F.col(name).isNotNull() & value.isNull()).alias(name)
            for name, value in readers.items()
        ]
    )
    return counted.unpivot([], list(readers), "column_name", "unreadable_count")


def numeric_review(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-finite and negative counts; review items, not violations."""
    infinite = float("inf")
    parts = []
    for name in columns:
        value = F.col(name).cast("double")
        parts += [
            F.count_if(F.isnan(value) | (F.abs(value) == infinite)).alias(f"{name}|non_finite"),
            F.count_if((value < 0) & ~F.isnan(value)).alias(f"{name}|negative"),
        ]
    wide = df.agg(*parts)
    long = wide.unpivot([], wide.columns, "item", "n")
    return (
        long.select(
            F.substring_index("item", "|", 1).alias("column_name"),
            F.substring_index("item", "|", -1).alias("kind"), "n",
        )
        .groupBy("column_name")
        .agg(
            F.max(F.when(F.col("kind") == "non_finite", F.col("n"))).alias("non_finite_count"),
            F.max(F.when(F.col("kind") == "negative", F.col("n"))).alias("negative_count"),
        )
    )


def numeric_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    typed = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return (
        typed.unpivot([], list(columns), "column_name", "value")
        .groupBy("column_name")
        .agg(
            F.min("value").alias("min_value"), F.max("value").alias("max_value"),
            F.avg("value").alias("mean_value"),
        )
    )


def cardinality(counts: DataFrame) -> DataFrame:
    """Distinct values and dominance from value counts; a null group can be dominant."""
    share = F.col("dominant_rows") / F.col("total_rows")
    return (
        counts.groupBy("column_name")
        .agg(
            F.count("value").alias("distinct_values"),
            F.max("row_count").alias("dominant_rows"),
            F.sum("row_count").alias("total_rows"),
        )
        .select(
            "column_name", "distinct_values",
            (F.col("dominant_rows") * 100 / F.col("total_rows")).alias("dominant_percentage"),
            (F.col("distinct_values") <= 1).alias("is_constant"),
            (share >= 0.99).alias("is_near_constant"),
        )
    )


def recommended_types(counts: DataFrame) -> DataFrame:
    """BOOLEAN when every value, nulls included, is 0 or 1; DOUBLE otherwise."""
    binary = F.coalesce(F.col("value").isin(0.0, 1.0), F.lit(False))
    return counts.groupBy("column_name").agg(
        F.when(F.bool_and(binary), "BOOLEAN").otherwise("DOUBLE").alias("recommended_type")
    )


def transitions(df: DataFrame, order: str, ts: str) -> DataFrame:
    """Range of timestamps and backward or equal steps in file order."""
    lagged = ordered.sliced_lag(df.select(order, ts), [], order, [ts])
    before = F.col(f"previous_{ts}")
    return lagged.agg(
        F.min(ts).alias("min_timestamp"),
        F.max(ts).alias("max_timestamp"),
        F.count_if(F.col(ts) < before).alias("out_of_order_transitions"),
        F.count_if(F.col(ts) == before).alias("adjacent_duplicate_transitions"),
    )


def file_order_deltas(df: DataFrame, order: str, ts: str) -> DataFrame:
    """Each timestamp with the seconds since the row above it in file order."""
    lagged = ordered.sliced_lag(df.select(order, ts), [], order, [ts])
    seconds = wallclock.seconds_between(F.col(f"previous_{ts}"), F.col(ts))
    return lagged.select(order, ts, seconds.alias("delta_seconds"))


def modal_interval(counts: DataFrame) -> DataFrame:
    """Most frequent interval; the shorter one wins a tie."""
    return counts.orderBy(F.desc("interval_count"), "seconds").limit(1)


def gap_limit(counts: DataFrame, floor_seconds: int = 60) -> int:
    """Gap definition of the profile: the larger of a floor and twice the mode."""
    mode = modal_interval(counts).first()
    return max(floor_seconds, 2 * mode["seconds"]) if mode else floor_seconds


def gap_summary(counts: DataFrame, limit: int, median: DataFrame) -> DataFrame:
    """Count, extremes, exact median and total of intervals above ``limit``."""
    gaps = counts.where(F.col("seconds") > limit).agg(
        F.coalesce(F.sum("interval_count"), F.lit(0)).alias("gap_count"),
        F.min("seconds").alias("min_seconds"),
        F.max("seconds").alias("max_seconds"),
        F.sum(F.col("seconds") * F.col("interval_count")).alias("total_seconds"),
    )
    row = F.lit(1).alias("row")
    return gaps.select("*", row).join(
        median.select(F.col("quantile").alias("median_seconds"), row), "row", "left"
    ).drop("row")


def largest_gaps(deltas: DataFrame, ts: str, limit: int, top: int = 20) -> DataFrame:
    return deltas.where(F.col("delta_seconds") > limit).orderBy(F.desc("delta_seconds"), ts).limit(top)


def daily_counts(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("day_rows"))


def daily_statistics(days: DataFrame) -> DataFrame:
    """Over the day table, one row per calendar day; the latest of the largest days wins."""
    return days.agg(
        F.count(F.lit(1)).alias("partition_count"),
        F.min("day_rows").alias("minimum_rows"),
        F.median("day_rows").cast("bigint").alias("median_rows"),
        F.max("day_rows").alias("maximum_rows"),
        F.max(F.struct("day_rows", "day"))["day"].alias("largest_day"),
    )


def representative_days(days: DataFrame) -> DataFrame:
    """Smallest, median-ranked and largest day, all distinct; empty under three days.

    The median target is the upper-middle count; the nearest other day wins, then the earlier.
    """
    entry = F.struct("day_rows", "day")
    summary = days.agg(
        F.min(entry).alias("small"), F.max(entry).alias("large"),
        F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("day_rows")).alias("sizes"),
    ).where("n >= 3").select(
        "small", "large", F.get("sizes", F.floor(F.col("n") / 2).cast("int")).alias("target"),
        F.lit(1).alias("row"),
    )
    # ``summary`` is one row beside one row per calendar day.
    beside = days.withColumn("row", F.lit(1)).join(F.broadcast(summary), "row")
    between = (F.col("day") != F.col("small.day")) & (F.col("day") != F.col("large.day"))
    distance = F.struct(F.abs(F.col("day_rows") - F.col("target")).alias("off"), "day", "day_rows")
    chosen = beside.groupBy("small", "large").agg(
        F.min(F.when(between, distance)).alias("middle")
    )
    return chosen.select(
        F.explode(
            F.array(
                F.struct(F.lit("small").alias("label"), F.col("small.day").alias("day"),
                         F.col("small.day_rows").alias("day_rows")),
                F.struct(F.lit("median").alias("label"), F.col("middle.day").alias("day"),
                         F.col("middle.day_rows").alias("day_rows")),
                F.struct(F.lit("largest").alias("label"), F.col("large.day").alias("day"),
                         F.col("large.day_rows").alias("day_rows")),
            )
        ).alias("r")
    ).select("r.*")


def estimated_bytes(total_bytes: Column, total_rows: Column, rows: Column) -> Column:
    """Proportional size share, rounded half to even."""
    return F.bround(total_bytes * rows / total_rows, 0).cast("bigint")


def interval_distribution(df: DataFrame, order: str, ts: str) -> DataFrame:
    return metrics.interval_counts(ordered.deltas(df, [], order, ts), [])
