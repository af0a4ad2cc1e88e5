"""Folder layout of a lake and its ledger tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugelake.functions import wallclock


@dataclass(frozen=True)
class Lake:
    """Zones of one source. Outputs live in a directory per input identity or run, so a
    re-run rewrites equal content and a changed input never touches older outputs."""

    root: str
    source: str = "telemetry"

    @property
    def raw(self) -> str:
        return f"{self.root}/raw/source={self.source}"

    @property
    def staging(self) -> str:
        return f"{self.root}/staging/source={self.source}"

    @property
    def quarantine(self) -> str:
        return f"{self.root}/quarantine/source={self.source}"

    @property
    def curated(self) -> str:
        return f"{self.root}/curated/{self.source}"

    def control(self, table: str) -> str:
        return f"{self.root}/control/source={self.source}/{table}"


def staging_key(lake: Lake, day: Column, input_id: Column) -> Column:
    return F.concat(
        F.lit(f"staging/source={lake.source}/year="), wallclock.year_text(day),
        F.lit("/month="), wallclock.month_text(day), F.lit("/day="), F.date_format(day, "dd"),
        F.lit("/input_id="), input_id,
    )


def quarantine_key(lake: Lake, day: Column, input_id: Column) -> Column:
    return F.concat(
        F.lit(f"quarantine/source={lake.source}/source_date="), F.date_format(day, "yyyy-MM-dd"),
        F.lit("/input_id="), input_id,
    )


def curated_key(lake: Lake, year: Column, month: Column, run_id: Column) -> Column:
    return F.concat(
        F.lit(f"curated/{lake.source}/year="), year, F.lit("/month="), month,
        F.lit("/run_id="), run_id,
    )


def relative(lake: Lake, path: Column) -> Column:
    """Path below the lake root, whose scheme and host readers may spell differently."""
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", lake.root.rstrip("/")) + "/"
    at = F.instr(path, root)
    return F.when(at > 0, F.substring(path, at + len(root), F.length(path))).otherwise(path)


def raw_key_date(lake: Lake, path: Column) -> Column:
    """Date of a canonical raw file of this lake; null for any other prefix, source, folder or name."""
    source = re.escape(lake.source)
    shape = rf"^raw/source={source}/source_date=(\d{{4}}-\d{{2}}-\d{{2}})/(?:data\.csv|part[^/]*)$"
    return F.nullif(F.regexp_extract(relative(lake, path), shape, 1), F.lit("")).try_cast("date")


_RULES = T.ArrayType(
    T.StructType([T.StructField("rule_id", T.StringType()), T.StructField("count", T.LongType())])
)
_WARNINGS = T.ArrayType(
    T.StructType(
        [
            T.StructField("rule_id", T.StringType()),
            T.StructField("message", T.StringType()),
            T.StructField("observed_count", T.LongType()),
        ]
    )
)


def _typed(kind: T.DataType, *names: str) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names]


MANIFEST_SCHEMA = T.StructType(
    [
        *_typed(T.DateType(), "source_date"),
        *_typed(T.StringType(), "input_id", "raw_key", "raw_sha256"),
        *_typed(
            T.LongType(), "raw_byte_size", "input_row_count", "valid_row_count",
            "quarantine_row_count", "valid_timestamp_count", "parseable_timestamp_count",
            "out_of_order_transition_count", "abnormal_sampling_interval_count",
            "significant_gap_count", "maximum_gap_seconds",
        ),
        *_typed(
            T.TimestampNTZType(), "first_valid_event_timestamp_local",
            "last_valid_event_timestamp_local",
        ),
        *_typed(T.BooleanType(), "unexpectedly_low_daily_row_count", "reconciliation_matches",
                "reconciliation_applicable"),
        T.StructField("quarantine_rule_counts", _RULES),
        T.StructField("batch_warnings", _WARNINGS),
        *_typed(T.StringType(), "staging_key", "staging_sha256"),
        *_typed(T.LongType(), "staging_byte_size"),
        *_typed(T.StringType(), "quarantine_status", "quarantine_key", "quarantine_sha256"),
        *_typed(T.LongType(), "quarantine_byte_size"),
        *_typed(T.StringType(), "manifest_version", "schema_version", "pipeline_version",
                "processing_timestamp"),
        T.StructField("source_identity", T.MapType(T.StringType(), T.StringType())),
    ]
)

INTERVAL_SCHEMA = T.StructType(
    [*_typed(T.DateType(), "source_date"), *_typed(T.LongType(), "seconds", "interval_count")]
)


def exists(spark: SparkSession, path: str) -> bool:
    return bool(existing(spark, [path]))


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of some paths of one file system that exist; what is the same for all is asked once."""
    if not paths:
        return []
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    system = as_path(paths[0]).getFileSystem(spark._jsc.hadoopConfiguration())
    return [path for path in paths if system.exists(as_path(path))]


def read_ledger(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A ledger table, empty before its first write."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def write_ledger(rows: DataFrame, path: str, *partitions: str) -> None:
    """Replace the partitions present in ``rows``; others stay. This is the commit point.

    The partition count is given, because the rows are few and the files many.
    """
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    (
        rows.repartition(tasks, *partitions)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def manifests(spark: SparkSession, lake: Lake) -> DataFrame:
    return read_ledger(spark, lake.control("daily_manifest"), MANIFEST_SCHEMA)


def intervals(spark: SparkSession, lake: Lake) -> DataFrame:
    return read_ledger(spark, lake.control("daily_interval"), INTERVAL_SCHEMA)


def read_months(spark: SparkSession, path: str) -> DataFrame:
    """A ledger partitioned by month, with year and month as the text they were written as."""
    rows = spark.read.parquet(path)
    return rows.withColumn("year", F.lpad(F.col("year").cast("string"), 4, "0")).withColumn(
        "month", F.lpad(F.col("month").cast("string"), 2, "0")
    )
