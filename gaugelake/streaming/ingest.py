"""File-arrival stream: raw objects are validated and published as they land.

The stream carries arrivals, not bodies: paths, sizes and times from versions of a listing, so
a file that was replaced under its own name arrives again. Each micro-batch names the days it
touched and runs the batch plan over exactly those objects. Keys that are not canonical are
refused, empty objects and objects over the size limit fail by their listed size. Delivery may repeat and come in any order: an unchanged object is skipped by its identity, a
changed one is rebuilt, and continuity is computed anew from the ordered ledger after every
batch, never from arrival order.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gaugelake import contract as C
from gaugelake.plans import history, publish
from gaugelake.plans import lake as L
from gaugelake.plans.lake import Lake
from gaugelake.plans.publish import Run
from gaugelake.session import stage
from gaugelake.sources import raw
from gaugelake.streaming.arrivals import read_arrivals

OUTCOME_SCHEMA = (
    "batch_id long, source_date date, raw_key string, outcome string, error string, "
    "input_row_count long, valid_row_count long, quarantine_row_count long"
)


def listing(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    """source_date, path, size and time of the files below a folder, without empty ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = raw.plain_path(F.col("path"))
    return files.select(
        raw.source_date_of(path).alias("source_date"), path.alias("file_path"),
        F.col("length").alias("byte_size"), F.col("modificationTime").alias("modified"),
    )


def arrivals(spark: SparkSession, lake: Lake, checkpoint: str, max_files: int | None = None) -> DataFrame:
    """Stream of file_path, byte_size and source_date (null where the key is not canonical)."""
    found = read_arrivals(spark, lake.raw, f"{checkpoint.rstrip('/')}/listing", max_files)
    path = raw.plain_path(F.col("path"))
    return found.select(path.alias("file_path"), "byte_size", L.raw_key_date(lake, path).alias("source_date"))


def process_batch(lake: Lake, run: Run, batch: DataFrame, batch_id: int) -> None:
    """Publish the days of one micro-batch (file_path, byte_size, source_date) and record an
    outcome per object.

    One bad object fails alone. Re-running a batch replaces its own outcome rows.
    """
    spark = batch.sparkSession
    touched = stage(batch.distinct(), "arrivals")
    folder = F.regexp_replace("file_path", "/[^/]*$", "")
    # The folders of one micro-batch, whose size ``max_files`` sets.
    folders = [
        r[0] for r in touched.where(F.col("source_date").isNotNull()).select(folder).distinct().collect()
    ]
    nothing = F.lit(None)
    refused = touched.where(F.col("source_date").isNull()).select(
        nothing.cast("date").alias("source_date"),
        L.relative(lake, F.col("file_path")).alias("raw_key"),
        F.lit("rejected_key").alias("outcome"),
        F.lit("object path does not match the canonical layout").alias("error"),
        *[
            nothing.cast("long").alias(n)
            for n in ("input_row_count", "valid_row_count", "quarantine_row_count")
        ],
    )
    outcomes = refused
    began = time.monotonic()
    if folders:
        status = F.col("status")
        published = publish.publish_days(spark, lake, run, folders=folders)
        # Listings leave out empty files: a day without any other file is empty.
        emptied = touched.where((F.col("byte_size") == 0) & F.col("source_date").isNotNull())
        emptied = emptied.join(listing(spark, folders).select("source_date"), "source_date", "left_anti")
        outcomes = refused.unionByName(
            emptied.select(
                "source_date", L.relative(lake, folder).alias("raw_key"), F.lit("failed").alias("outcome"),
                F.lit(C.EMPTY_INPUT).alias("error"), F.lit(0).cast("long").alias("input_row_count"),
                *[F.lit(0).cast("long").alias(n) for n in ("valid_row_count", "quarantine_row_count")],
            ).distinct()
        ).unionByName(
            published.select(
                "source_date", "raw_key",
                F.when(status == "skipped", "duplicate_skipped").otherwise(status).alias("outcome"),
                "error", "input_row_count", "valid_row_count", "quarantine_row_count",
            )
        )
    L.write_ledger(
        outcomes.withColumn("batch_id", F.lit(batch_id).cast("long")),
        lake.control("stream_outcome"), "batch_id",
    )
    if folders:
        L.write_ledger(
            history.ledger_boundaries(spark, lake, run.limits).withColumn("scope", F.lit("days")),
            lake.control("day_boundary"), "scope",
        )
        summary = L.read_ledger(spark, lake.control("stream_outcome"), spark.createDataFrame([], OUTCOME_SCHEMA).schema)
        L.write_ledger(
            batch_metrics(summary.where(F.col("batch_id") == batch_id), time.monotonic() - began),
            lake.control("run_metrics"), "batch_id",
        )


def batch_metrics(outcome: DataFrame, seconds: float) -> DataFrame:
    """(batch_id, metric, value) of one batch."""
    done = F.col("outcome")
    values = {
        "RowsIn": F.sum("input_row_count"), "RowsValid": F.sum("valid_row_count"),
        "RowsQuarantined": F.sum("quarantine_row_count"),
        "ObjectsSkippedDuplicate": F.count_if(done == "duplicate_skipped"),
        "ObjectsFailed": F.count_if(done == "failed"), "DurationSeconds": F.lit(float(seconds)),
    }
    wide = outcome.groupBy("batch_id").agg(
        *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in values.items()]
    )
    return wide.unpivot("batch_id", list(values), "metric", "value")


def start(
    spark: SparkSession, lake: Lake, run: Run, checkpoint: str, max_files: int | None = None
) -> StreamingQuery:
    """Process what has arrived or was replaced, and stop; schedule it again for what comes next.

    ``max_files`` bounds the files of one run; what is left over is for the next one.
    """
    return (
        arrivals(spark, lake, checkpoint, max_files)
        .writeStream.foreachBatch(lambda batch, i: process_batch(lake, run, batch, i))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_available(
    spark: SparkSession, lake: Lake, run: Run, checkpoint: str, max_files: int | None = None
) -> None:
    """Run the stream until a run finds nothing more."""
    while True:
        query = start(spark, lake, run, checkpoint, max_files)
        query.awaitTermination()
        if not (query.lastProgress and query.lastProgress.numInputRows):
            return


def outcomes(spark: SparkSession, lake: Lake) -> DataFrame:
    return spark.read.schema(OUTCOME_SCHEMA).parquet(lake.control("stream_outcome"))
