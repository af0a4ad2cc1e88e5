"""Publish validated days: staging Parquet, quarantine JSON lines, then the ledger row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugelake import contract as C
from gaugelake.contract import Thresholds
from gaugelake.functions import identity
from gaugelake.operators import resume, rules
from gaugelake.plans import lake as L
from gaugelake.plans import transform
from gaugelake.plans.lake import Lake
from gaugelake.session import partitions_for, share_listings, stage, together
from gaugelake.sources import objects, raw, tables


@dataclass(frozen=True)
class Run:
    """What a run pins: versions, an operator-supplied UTC time and the source's identity."""

    pipeline_version: str
    processing_timestamp: str
    source_identity: dict[str, str] = field(default_factory=dict)
    limits: Thresholds = field(default_factory=Thresholds)
    size_limit: int | None = None

    def __post_init__(self) -> None:
        if not self.pipeline_version.strip():
            raise ValueError("pipeline_version must not be empty")
        if not self.processing_timestamp.endswith("Z"):
            raise ValueError("processing_timestamp must be UTC and end in Z")

    def pinned(self) -> dict[str, str]:
        return {
            "pipeline_version": self.pipeline_version,
            "processing_timestamp": self.processing_timestamp,
            "schema_version": C.SCHEMA_VERSION,
        }


def raw_evidence(
    spark: SparkSession, lake: Lake, run: Run, folders: list[str] | None = None,
    without: DataFrame | None = None,
) -> DataFrame:
    """Current raw objects with checksum and the identity of their processing.

    Objects named in ``without`` (object_key) are not read.
    """
    found = objects.object_checksums(spark, folders or lake.raw, "*", without=without)
    dated = found.select(
        "object_key",
        L.raw_key_date(lake, F.concat("object_key", F.lit("/part"))).alias("source_date"),
        L.relative(lake, F.col("object_key")).alias("raw_key"),
        F.col("sha256").alias("raw_sha256"),
        F.col("byte_size").alias("raw_byte_size"),
    ).where(F.col("source_date").isNotNull())
    nothing = F.lit(None).cast("string")
    return dated.withColumn(
        "input_id",
        identity.processing_identity(
            nothing, F.col("raw_key"), nothing, F.col("raw_sha256"),
            F.col("raw_byte_size").cast("string"), F.lit(run.pipeline_version),
            F.lit(C.SCHEMA_VERSION), F.lit(C.MANIFEST_VERSION),
        ),
    )


def _day_of(folder: Column) -> Column:
    part = [F.regexp_extract(folder, f"/{name}=([0-9]+)", 1) for name in ("year", "month", "day")]
    return F.concat_ws("-", *part).try_cast("date")


def staged_evidence(
    spark: SparkSession, lake: Lake, below: list[str] | None = None
) -> DataFrame:
    """Per staged folder: rows, positional endpoints, footer verdict, size and digest.

    ``below`` limits the work to some folders of the staging zone.
    """
    if below == [] or not L.exists(spark, lake.staging):
        return spark.createDataFrame(
            [], "staging_key string, source_date date, staged_row_count long, staged_first timestamp_ntz,"
            " staged_last timestamp_ntz, staged_byte_size long, staged_sha256 string,"
            " staged_is_conformant boolean, staged_has_path boolean",
        )
    folder = F.regexp_replace("file_path", "/[^/]*$", "")
    expected = F.array(*[F.lit(c) for c in objects.NORMALIZED_FOOTER])
    footers = (
        objects.parquet_footers(spark, below or lake.staging)
        .groupBy(folder.alias("object_key"))
        .agg(
            F.sum("row_count").alias("staged_row_count"),
            F.bool_or("metadata_has_path").alias("staged_has_path"),
            F.bool_and(
                F.col("is_readable") & (F.col("columns") == expected) & ~F.col("timestamp_zoned")
                & ((F.col("row_count") == 0) | (F.array_join("codecs", ",") == "SNAPPY"))
            ).alias("staged_is_conformant"),
        )
    )
    sums = objects.object_checksums(spark, below or lake.staging, "*.parquet")
    rows = tables.read_normalized(
        spark, lake.staging, "year", "month", "day", "input_id", below=below, tolerate_damage=True
    )
    ts, at = F.col("event_timestamp_local"), F.col("_metadata.row_index")
    folders = ["year", "month", "day", "input_id"]
    # First and last row per file, then per day over its few files.
    files = rows.groupBy(*folders, F.col("_metadata.file_path").alias("path")).agg(
        F.min_by(ts, at).alias("first_ts"), F.max_by(ts, at).alias("last_ts")
    )
    place = F.struct(F.length("path"), "path")
    ends = files.groupBy(*folders).agg(
        F.min_by("first_ts", place).alias("staged_first"),
        F.max_by("last_ts", place).alias("staged_last"),
    )
    keyed = ends.select(
        "staged_first", "staged_last",
        F.concat(
            F.lit(f"staging/source={lake.source}/year="), "year", F.lit("/month="), "month",
            F.lit("/day="), "day", F.lit("/input_id="), "input_id",
        ).alias("staging_key"),
    )
    return (
        footers.join(sums, "object_key")
        .select(
            L.relative(lake, F.col("object_key")).alias("staging_key"),
            _day_of(F.col("object_key")).alias("source_date"),
            "staged_row_count", "staged_is_conformant", "staged_has_path",
            F.col("byte_size").alias("staged_byte_size"), F.col("sha256").alias("staged_sha256"),
        )
        .join(keyed, "staging_key", "left")
    )


def quarantine_evidence(
    spark: SparkSession, lake: Lake, below: list[str] | None = None
) -> DataFrame:
    if below == [] or not L.exists(spark, lake.quarantine):
        return spark.createDataFrame(
            [], "quarantine_key string, source_date date, rejected_byte_size long, rejected_sha256 string"
        )
    return objects.object_checksums(spark, below or lake.quarantine, "*.json").select(
        L.relative(lake, F.col("object_key")).alias("quarantine_key"),
        F.regexp_extract("object_key", "/source_date=([0-9-]+)", 1).try_cast("date").alias("source_date"),
        F.col("byte_size").alias("rejected_byte_size"),
        F.col("sha256").alias("rejected_sha256"),
    )


def output_folders(
    spark: SparkSession, lake: Lake, days: DataFrame
) -> tuple[list[str], list[str]]:
    """Existing staging and quarantine folders of some days, one of each per day at most."""
    day, input_id = F.col("source_date"), F.col("input_id")
    keys = days.select(
        L.staging_key(lake, day, input_id).alias("s"), L.quarantine_key(lake, day, input_id).alias("q")
    ).collect()
    root = lake.root.rstrip("/")
    return tuple(L.existing(spark, [f"{root}/{row[i]}" for row in keys]) for i in (0, 1))


def decide(
    spark: SparkSession, lake: Lake, run: Run, force: bool = False,
    folders: list[str] | None = None, without: DataFrame | None = None,
) -> DataFrame:
    """Raw objects with their resume status, judged on the evidence of their current identity.

    With ``folders`` only those objects and their own outputs are looked at; objects named in
    ``without`` have no row.
    """
    current = stage(raw_evidence(spark, lake, run, folders, without), "current")
    below = output_folders(spark, lake, current) if folders is not None else (None, None)
    staged = staged_evidence(spark, lake, below[0])
    rejected = quarantine_evidence(spark, lake, below[1])
    day, input_id = F.col("source_date"), F.col("input_id")
    return resume.decisions(
        current,
        L.manifests(spark, lake),
        staged.join(current.select(L.staging_key(lake, day, input_id).alias("staging_key")),
                    "staging_key", "left_semi"),
        rejected.join(current.select(L.quarantine_key(lake, day, input_id).alias("quarantine_key")),
                      "quarantine_key", "left_semi"),
        run.pinned(),
        force,
    )


def too_large(
    spark: SparkSession, lake: Lake, run: Run, folders: list[str] | None = None
) -> DataFrame | None:
    """Raw objects over the size limit of the run, from the listing; None without a limit."""
    if run.size_limit is None:
        return None
    sizes = objects.object_sizes(spark, folders or lake.raw).where(F.col("byte_size") > run.size_limit)
    found = sizes.select(
        "object_key", L.raw_key_date(lake, F.concat("object_key", F.lit("/part"))).alias("source_date"),
        L.relative(lake, F.col("object_key")).alias("raw_key"), F.col("byte_size").alias("raw_byte_size"),
    )
    return stage(found.where(F.col("source_date").isNotNull()), "too-large")


def publish_days(
    spark: SparkSession, lake: Lake, run: Run, force: bool = False,
    folders: list[str] | None = None,
) -> DataFrame:
    """Bring raw days up to date; returns one outcome row per day.

    ``folders`` limits the run to some raw objects. Data is written first and the ledger last,
    so a reader that goes through the ledger never sees a day half done. Objects over the
    run's size limit are refused by their listed size; their bodies are not read.
    """
    share_listings(spark)
    large = too_large(spark, lake, run, folders)
    decided = stage(decide(spark, lake, run, force, folders, large), "decisions")
    legacy = decided.where(F.col("status") == "manifest_upgraded")
    if not legacy.isEmpty():
        upgrade_manifests(spark, lake, legacy)
    todo = decided.where(F.col("status").isin("processed", "rebuilt"))
    failed = spark.createDataFrame([], "source_date date, error string")
    if large is not None:
        decided = decided.unionByName(large.withColumn("status", F.lit("processed")), allowMissingColumns=True)
        failed = large.select("source_date", F.lit("INPUT_TOO_LARGE").alias("error"))
    # One folder per calendar day.
    pending = [r["object_key"] for r in todo.select("object_key").collect()]
    if pending:
        failed = failed.unionByName(
            build_days(spark, lake, run, todo, raw.read_lines(spark, pending))
        )
    book = L.manifests(spark, lake).drop("raw_key", "raw_sha256", "raw_byte_size", "input_id")
    return (
        decided.join(book, "source_date", "left")
        .join(failed, "source_date", "left")
        .withColumn("status", F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("status")))
    )


def build_days(
    spark: SparkSession, lake: Lake, run: Run, todo: DataFrame, lines: DataFrame
) -> DataFrame:
    """Validate and write the given days; returns (source_date, error) of days not published."""
    result = transform.validate(lines, run.limits)
    batch = stage(result.batch(), "batch")
    judged = todo.join(batch.drop("source_date"), "object_key")
    problems = F.concat(
        F.col("batch_errors.rule_id"),
        F.array_compact(
            F.array(
                F.when(~F.col("is_utf8"), F.lit("INVALID_UTF8")),
                F.when(~F.col("is_well_formed"), F.lit("MALFORMED_CSV")),
            )
        ),
    )
    judged = judged.withColumn("problems", problems)
    # One row a day, written so that Spark knows how small it is beside the rows.
    accepted = stage(judged.where(F.size("problems") == 0), "accepted")
    write_outputs(lake, run, result, accepted.select(
        "object_key", "input_id", "raw_sha256", "source_date", "input_row_count", "valid_row_count", "quarantine_row_count"))
    commit(spark, lake, run, result, accepted)
    return judged.where(F.size("problems") > 0).select(
        "source_date", F.array_join("problems", ", ").alias("error")
    )


def write_outputs(lake: Lake, run: Run, result: transform.Validated, accepted: DataFrame) -> None:
    """Staging and quarantine files of accepted objects, each in source order.

    The rows of all days are numbered on, day after day, and dealt in equal slices: a very large
    day becomes several ordered files. What is the same in every row of a day, or follows from
    its text, is added after the rows have moved. ``accepted`` has one row per day.
    """
    spark = accepted.sparkSession
    # Rows take about this much in the shuffle and the files.
    size = accepted.agg(F.sum(F.col("valid_row_count") * 200 + F.col("quarantine_row_count") * 800)).first()[0]
    parts = partitions_for(spark, size)
    order = W.partitionBy(F.lit(1)).orderBy("source_date", "input_id")
    # One row per calendar day, so its broadcast stays small for any history.
    days = F.broadcast(accepted.select("source_date", "object_key", "input_id", "raw_sha256"))
    dealt = stage(accepted.select(
        "object_key",
        (F.sum("input_row_count").over(order) - F.col("input_row_count")).alias("rows_before"),
        F.sum("input_row_count").over(W.partitionBy(F.lit(1))).alias("all_rows"),
    ), "dealt")
    at = F.expr(f"(rows_before + source_row_number - 1) * {parts} div all_rows")
    rows = result.staged.join(dealt, "object_key").withColumn(
        "slice", F.greatest(F.lit(0), F.least(at, F.lit(parts - 1))).cast("int")
    ).drop("rows_before", "all_rows")
    folders = ["year", "month", "day", "input_id"]
    valid = rows.where(rules.is_valid()).select(
        "record_index", "event_timestamp_local", *C.ANALOGUE, *C.DIGITAL, "source_date", "source_row_number", "slice"
    )
    names = [f.name for f in C.NORMALIZED_SCHEMA]

    def write_staging() -> None:
        day = F.col("source_date")
        moved = valid.repartitionById(parts, F.col("slice")).join(days, "source_date").select(
            "*", F.array().cast(C.ISSUE_TYPE).alias("issues"), F.date_format(day, "yyyy").alias("year"),
            F.date_format(day, "MM").alias("month"), F.date_format(day, "dd").alias("day"),
        ).sortWithinPartitions(*folders, "source_row_number")
        (
            rules.valid_rows(moved, keep=folders)
            .select(*names, *folders)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("compression", "snappy")
            .option("parquet.enable.dictionary", "false")
            .partitionBy(*folders)
            .parquet(lake.staging)
        )

    dates = ["source_date", "input_id"]
    rejected = rows.where(~rules.is_valid()).select(
        "source_date", "source_row_number", "original_record", "issues", "slice"
    )

    def write_quarantine() -> None:
        moved = rejected.repartitionById(parts, F.col("slice")).join(days, "source_date").sortWithinPartitions(
            *dates, "source_row_number")
        (
            rules.quarantine_rows(
                transform.with_fields(moved), run.pipeline_version, F.lit(run.processing_timestamp).cast("timestamp"),
                {
                    "source_object_key": L.relative(lake, F.col("object_key")),
                    "source_object_checksum": F.concat(F.lit("sha256:"), F.col("raw_sha256")),
                },
                keep=dates,
            )
            .select(*sorted(C.QUARANTINE_COLUMNS), *dates)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("ignoreNullFields", "false")
            .option("timeZone", "UTC")
            .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ssXXX")
            .partitionBy(*dates)
            .json(lake.quarantine)
        )

    together(spark, write_staging, write_quarantine)


def commit(
    spark: SparkSession, lake: Lake, run: Run, result: transform.Validated, accepted: DataFrame
) -> None:
    """Write interval rows, then the manifest rows that make the days visible."""
    within = result.intervals.join(accepted.select("object_key", "source_date"), "object_key").select(
        "source_date", "seconds", "interval_count"
    )
    # The files are digested meanwhile.
    manifest, _ = together(
        spark,
        lambda: stage(manifest_rows(spark, lake, run, accepted), "manifest"),
        lambda: L.write_ledger(within, lake.control("daily_interval"), "source_date"),
    )
    # The last write is the commit.
    L.write_ledger(manifest, lake.control("daily_manifest"), "source_date")


def manifest_rows(spark: SparkSession, lake: Lake, run: Run, accepted: DataFrame) -> DataFrame:
    """Ledger rows of accepted days from their metrics and the files written for them."""
    keyed = accepted.withColumn(
        "staging_key", L.staging_key(lake, F.col("source_date"), F.col("input_id"))
    ).withColumn("quarantine_folder", L.quarantine_key(lake, F.col("source_date"), F.col("input_id")))
    staged = objects_by_key(
        spark, lake, lake.staging, "*.parquet", "staging", keyed.select("staging_key"))
    rejected = objects_by_key(
        spark, lake, lake.quarantine, "*.json", "quarantine",
        keyed.select(F.col("quarantine_folder").alias("quarantine_key")))
    joined = keyed.join(staged, "staging_key", "left").join(
        rejected.withColumnRenamed("quarantine_key", "quarantine_folder"), "quarantine_folder", "left"
    )
    present = F.col("quarantine_row_count") > 0
    identity_map = F.create_map(
        *[F.lit(x) for pair in sorted(run.source_identity.items()) for x in pair]
    ).cast("map<string,string>")
    manifest = joined.select(
        "*",
        F.col("valid_row_count").alias("valid_timestamp_count"),
        F.when(present, "present").otherwise("absent_zero_rows").alias("quarantine_status"),
        F.when(present, F.col("quarantine_folder")).alias("quarantine_key"),
        F.lit(C.MANIFEST_VERSION).alias("manifest_version"),
        F.lit(C.SCHEMA_VERSION).alias("schema_version"),
        F.lit(run.pipeline_version).alias("pipeline_version"),
        F.lit(run.processing_timestamp).alias("processing_timestamp"),
        identity_map.alias("source_identity"),
    ).withColumn("quarantine_byte_size", F.coalesce("quarantine_byte_size", F.lit(0))).withColumn(
        "staging_byte_size", F.coalesce("staging_byte_size", F.lit(0))
    )
    return manifest.select(*[f.name for f in L.MANIFEST_SCHEMA])


def objects_by_key(
    spark: SparkSession, lake: Lake, folder: objects.Folders, glob: str, prefix: str,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """(<prefix>_key, size, digest) per directory below ``folder``; with ``wanted`` (<prefix>_key)
    only files of those directories are read."""
    if not folder or (isinstance(folder, str) and not L.exists(spark, folder)):
        return spark.createDataFrame(
            [], f"{prefix}_key string, {prefix}_byte_size long, {prefix}_sha256 string"
        )
    key = L.relative(lake, F.regexp_replace("file_path", "/[^/]*$", ""))
    keep = None if wanted is None else (
        lambda paths: paths.join(wanted, key == F.col(f"{prefix}_key"), "left_semi"))
    return objects.object_checksums(spark, folder, glob, keep=keep).select(
        L.relative(lake, F.col("object_key")).alias(f"{prefix}_key"),
        F.col("byte_size").alias(f"{prefix}_byte_size"), F.col("sha256").alias(f"{prefix}_sha256"),
    )


def upgrade_manifests(spark: SparkSession, lake: Lake, days: DataFrame) -> None:
    """Give legacy manifest rows the boundary facts, read from their staged rows."""
    old = L.manifests(spark, lake).join(days.select("source_date"), "source_date", "left_semi")
    staged = staged_evidence(spark, lake, output_folders(spark, lake, days)[0]).select(
        "staging_key", "staged_row_count", "staged_first", "staged_last"
    )
    upgraded = old.join(staged, "staging_key", "left").select(
        *[
            {
                "first_valid_event_timestamp_local": F.col("staged_first"),
                "last_valid_event_timestamp_local": F.col("staged_last"),
                "valid_timestamp_count": F.coalesce("staged_row_count", F.lit(0).cast("bigint")),
                "manifest_version": F.lit(C.MANIFEST_VERSION),
            }.get(name, F.col(name)).alias(name)
            for name in L.MANIFEST_SCHEMA.names
        ]
    )
    L.write_ledger(stage(upgraded, "upgrades"), lake.control("daily_manifest"), "source_date")
