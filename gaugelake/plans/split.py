"""Route a monolithic ordered source into raw daily objects."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugelake import contract
from gaugelake.functions import parsing
from gaugelake.operators import ordered
from gaugelake.session import partitions_for, stage
from gaugelake.sources import raw

HEADER_LINE = ",".join(contract.SOURCE_HEADER) + "\r"


class SourceError(ValueError):
    """The source cannot be split into trustworthy daily objects."""


def read_source(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of one monolithic source: ``source_row_number``, ``line``, ``route_date``.

    ``folder`` holds the source as one file or as ordered part files. Raises when the header
    differs or a row cannot be routed; both checks read at most one offending row.
    """
    def routed(lines: DataFrame) -> DataFrame:
        fields = parsing.csv_fields(F.col("line"))
        day = F.to_date(parsing.strict_timestamp(F.get(fields, F.lit(1))))
        return raw.checked_lines(lines).withColumn("route_date", day)

    staged = raw.with_joined_records(spark, stage(routed(raw.read_lines(spark, folder)), "source"), routed)
    blocks = stage(raw.block_table(staged), "blocks")
    state = raw.object_table(blocks).first()
    if state is None:
        raise SourceError("SOURCE_EMPTY")
    if state["schema_drift"]:
        raise SourceError("SOURCE_HEADER")
    if not (state["is_utf8"] and state["is_well_formed"]):
        raise SourceError("SOURCE_TEXT")
    if state["empty_input"]:
        raise SourceError("SOURCE_ROWS")
    rows = raw.with_row_numbers(staged, blocks).where(F.col("source_row_number") > 0)
    bad = rows.where(F.col("route_date").isNull()).select("source_row_number").first()
    if bad is not None:
        raise SourceError(f"SOURCE_ROUTE row {bad[0]}")
    return rows.select("source_row_number", "line", "route_date")


def out_of_order_rows(rows: DataFrame) -> DataFrame:
    """Rows whose date falls before the date of the row above: a closed day reappears."""
    return ordered.sliced_lag(rows, [], "source_row_number", ["route_date"]).where(
        F.col("route_date") < F.col("previous_route_date")
    )


def write_daily_objects(
    rows: DataFrame, folder: str, start: date | None = None, end: date | None = None,
    header: DataFrame | str = HEADER_LINE,
) -> None:
    """Write ``source_date=…`` directories in source order, the header line first.

    Rows are dealt in slices by (date, place between the date's first and last row), so a very
    large day becomes several part files in order instead of one task, and the lines are made
    once, for the write. ``header`` is one line, or a frame of (route_date, line) when headers
    differ by date.
    """
    kept = rows
    if start is not None:
        kept = kept.where(F.col("route_date") >= F.lit(start))
    if end is not None:
        kept = kept.where(F.col("route_date") <= F.lit(end))
    # One row a day, from one pass that makes no lines.
    number = F.col("source_row_number").cast("bigint")
    days = stage(kept.groupBy(F.col("route_date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min(number).alias("first"), F.max(number).alias("last")), "days")
    if isinstance(header, str):
        header = days.select(F.col("day").alias("route_date"), F.lit(header).alias("line"))
    # How many slices there are changes no result, so some lines say how long lines are.
    length = kept.select(F.length("line").alias("length")).limit(1000).agg(F.avg("length")).first()[0]
    total = days.agg(F.sum("n")).first()[0] or 1
    parts = partitions_for(rows.sparkSession, int(total * (length or 0)))
    dealt = days.withColumn("before", F.sum("n").over(W.partitionBy(F.lit(1)).orderBy("day")) - F.col("n"))
    # A header is dealt like the first row of its date.
    place = F.greatest(number - F.col("first"), F.lit(0)) * (F.col("n") / (F.col("last") - F.col("first") + 1))
    slice_of = F.floor((F.col("before") + place) * F.lit(parts / total)).cast("int")
    headers = header.select(F.lit(0).cast("bigint").alias("source_row_number"), "line", "route_date")
    (
        kept.select("source_row_number", "line", "route_date")
        .unionByName(headers)
        .join(dealt, F.col("route_date").eqNullSafe(F.col("day")), "left")
        .select("source_row_number", "line", F.col("route_date").alias("source_date"),
                F.least(F.coalesce(slice_of, F.lit(0)), F.lit(parts - 1)).alias("slice"))
        .repartitionById(parts, F.col("slice"))
        .sortWithinPartitions("source_date", "source_row_number")
        .select(F.col("line").alias("value"), "source_date")
        .write.mode("overwrite")
        # Days outside the window stay whatever the session's setting is.
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("source_date")
        .text(folder)
    )


def split_source(
    spark: SparkSession, source: str, folder: str, start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """Check order, write the daily objects and return the routed rows."""
    rows = read_source(spark, source)
    reversed_row = out_of_order_rows(rows).select("source_row_number", "route_date").first()
    if reversed_row is not None:
        raise SourceError(f"SOURCE_ORDER date {reversed_row['route_date']}")
    write_daily_objects(rows, folder, start, end)
    return rows
