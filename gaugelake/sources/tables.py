"""Typed readers for the tables of the lake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugelake import contract

# Digits may be missing their leading zero here; the cast rejects impossible dates.
LOOSE_TIMESTAMP = r"^\d{1,4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"

QUARANTINE_SCHEMA = T.StructType(
    [
        T.StructField("original_record", T.StringType()),
        T.StructField("original_field_values", T.ArrayType(T.StringType())),
        T.StructField("source_row_number", T.LongType()),
        T.StructField("rule_ids", T.ArrayType(T.StringType())),
        T.StructField("rejection_reasons", T.ArrayType(T.StringType())),
        *[
            T.StructField(name, T.StringType())
            for name in (
                "source_bucket", "source_object_key", "source_object_version_id",
                "source_object_etag", "source_object_checksum",
            )
        ],
        T.StructField("processing_timestamp", T.TimestampType()),
        T.StructField("pipeline_version", T.StringType()),
        T.StructField("expected_source_date", T.DateType()),
    ]
)


def read_normalized(
    spark: SparkSession, folder: str, *partitions: str, below: list[str] | None = None,
    tolerate_damage: bool = False,
) -> DataFrame:
    """Staging or curated rows with their directory columns as text, and file positions.

    ``below`` limits the read to some folders inside ``folder``. Evidence scans tolerate a
    damaged file, whose rows then count as absent; scans that feed outputs must not.
    """
    schema = T.StructType(
        [*contract.NORMALIZED_SCHEMA.fields, *[T.StructField(p, T.StringType()) for p in partitions]]
    )
    reader = spark.read.schema(schema).option("basePath", folder).option(
        "ignoreCorruptFiles", str(tolerate_damage).lower()
    )
    return reader.parquet(*(below or [folder])).select("*", "_metadata")


def read_quarantine(spark: SparkSession, folder: str, tolerate_damage: bool = False) -> DataFrame:
    """Quarantine JSON lines; a malformed line fails the read, or is kept as ``damaged_line``."""
    schema = T.StructType(
        [*QUARANTINE_SCHEMA.fields, T.StructField("source_date", T.DateType()),
         T.StructField("input_id", T.StringType())]
    )
    if not tolerate_damage:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(folder)
    schema = T.StructType([*schema.fields, T.StructField("damaged_line", T.StringType())])
    reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", "damaged_line")
    return reader.option("ignoreCorruptFiles", "true").json(folder)


def read_varchar_csv(spark: SparkSession, path: str) -> DataFrame:
    """All-text scan of a delimited source; the blank header becomes ``record_index``."""
    texts = spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    return texts.withColumnRenamed(texts.columns[0], contract.normalized_name(""))


def tolerant_types(texts: DataFrame) -> DataFrame:
    """Typed view of a varchar scan; what does not convert becomes null."""
    def source(name: str):
        return F.col(contract.normalized_name("") if name == "" else name)

    signals = (*contract.ANALOGUE_FIELDS, *contract.DIGITAL_FIELDS)
    return texts.select(
        source("").try_cast("bigint").alias("record_index"),
        F.when(source("timestamp").rlike(LOOSE_TIMESTAMP), source("timestamp").try_cast("timestamp_ntz"))
        .alias("timestamp"),
        *[source(n).try_cast("double").alias(n) for n in signals],
    )
