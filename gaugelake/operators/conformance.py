"""Does a written curated run hold what its contract promises?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugelake import contract as C
from gaugelake.operators import ordered

TS, INDEX = "event_timestamp_local", "record_index"


def curated_evidence(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Per run: rows, nulls, endpoints, order violations and repeated keys.

    ``rows`` carries ``_metadata``; order is judged in file order, inside files by row position
    and between files by their first and last rows. Only two columns are scanned for it.
    """
    groups = list(groups)
    contracted = [f.name for f in C.NORMALIZED_SCHEMA]
    any_null = F.lit(False)
    for name in contracted:
        any_null = any_null | F.col(name).isNull()
    totals = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(any_null).alias("null_row_count"),
        F.count_if(F.to_date(TS) != F.col("source_date")).alias("date_conflict_count"),
        F.min(TS).alias("first_timestamp"),
        F.max(TS).alias("last_timestamp"),
    )
    placed = rows.select(
        *groups, TS, INDEX,
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.row_index").alias("row_index"),
    )
    inside = (
        ordered.order_violations(placed, [*groups, "file_path"], "row_index", [TS, INDEX])
        .groupBy(*groups)
        .agg(F.sum("violations").alias("inside_violations"))
    )
    files = placed.groupBy(*groups, "file_path").agg(
        *[F.min_by(c, "row_index").alias(f"first_{c}") for c in (TS, INDEX)],
        *[F.max_by(c, "row_index").alias(f"last_{c}") for c in (TS, INDEX)],
    ).select(
        *groups, "file_path", F.struct(f"first_{TS}", f"first_{INDEX}").alias("first_pair"),
        F.struct(f"last_{TS}", f"last_{INDEX}").alias("last_pair"),
    )
    by_file = W.partitionBy(*groups).orderBy(F.length("file_path"), "file_path")
    between = (
        files.select(*groups, _before(F.col("first_pair"), F.lag("last_pair").over(by_file)).alias("wrong"))
        .groupBy(*groups)
        .agg(F.count_if("wrong").alias("between_violations"))
    )

    def repeated(key: str, name: str) -> DataFrame:
        counts = placed.groupBy(*groups, key).agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy(*groups).agg(F.count_if(F.col("n") > 1).alias(name))

    joined = totals
    for part in (
        inside, between, repeated(TS, "duplicate_timestamp_count"),
        repeated(INDEX, "duplicate_index_count"),
    ):
        joined = joined.join(part, groups, "left")
    return joined.withColumn(
        "order_violation_count", F.col("inside_violations") + F.col("between_violations")
    ).drop("inside_violations", "between_violations")


def _before(first: Column, last: Column) -> Column:
    """Does a file's first (time, index) pair sort before the last pair of the file above it?"""
    same_time = first[f"first_{TS}"] == last[f"last_{TS}"]
    return (first[f"first_{TS}"] < last[f"last_{TS}"]) | (
        same_time & (first[f"first_{INDEX}"] < last[f"last_{INDEX}"])
    )


def month_gap_counts(
    rows: DataFrame, groups: Sequence[str], gap_seconds: int = 60
) -> DataFrame:
    """Gaps inside each group; groups without one are absent."""
    gaps = ordered.sampling_gaps(rows, groups, TS, INDEX, gap_seconds)
    return gaps.groupBy(*groups).agg(F.count(F.lit(1)).alias("significant_gap_count"))
