"""The standing reports over the curated table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake.operators import ordered


def month_partition(curated: DataFrame, year: str, month: str) -> DataFrame:
    """One month; both partition columns are compared as text so the scan is pruned."""
    return curated.where((F.col("year") == year) & (F.col("month") == month))


def row_counts_by_date(df: DataFrame, day: Column, index: str) -> DataFrame:
    return (
        df.groupBy(day.alias("source_date"))
        .agg(F.count(index).alias("observation_count"))
        .orderBy("source_date")
    )


def analogue_aggregates(
    df: DataFrame, day: Column, averaged: Mapping[str, Column], ranged: Sequence[str] = (),
) -> DataFrame:
    """Daily average of every analogue signal, with the range of those in ``ranged``."""
    aggregates = [F.avg(column).alias(f"avg_{name}") for name, column in averaged.items()]
    for name in ranged:
        aggregates += [
            F.min(averaged[name]).alias(f"min_{name}"), F.max(averaged[name]).alias(f"max_{name}")
        ]
    return df.groupBy(day.alias("source_date")).agg(*aggregates).orderBy("source_date")


def digital_state_rates(df: DataFrame, day: Column, states: Mapping[str, Column]) -> DataFrame:
    """Daily share of rows in the active state; a null state counts as inactive."""
    rates = [
        F.avg(F.when(state, 1.0).otherwise(0.0).cast("double")).alias(f"{name}_active_rate")
        for name, state in states.items()
    ]
    return df.groupBy(day.alias("source_date")).agg(*rates).orderBy("source_date")


def sampling_gap_report(df: DataFrame, ts: str, index: str, gap_seconds: int = 60) -> DataFrame:
    """Gaps over the complete history, so those across month borders show too.

    A valid row's source date is the date of its timestamp.
    """
    gaps = ordered.sampling_gaps(df, [], ts, index, gap_seconds)
    return gaps.withColumn("source_date", F.to_date(ts)).orderBy(ts, index)
