"""Audits: the daily lake against its ledger, and published months against an inventory."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake import contract as C
from gaugelake.contract import AuditBounds, Thresholds
from gaugelake.functions import identity
from gaugelake.operators import conformance, continuity, resume
from gaugelake.operators.selection import MONTH, month_table, tagged, within
from gaugelake.plans import catalog, compact, publish
from gaugelake.plans import lake as L
from gaugelake.plans.lake import Lake
from gaugelake.plans.split import HEADER_LINE
from gaugelake.sources import objects, raw, tables

COVERAGE = ("complete", "known_missing_dates", "terminal_partial")


def raw_counts(spark: SparkSession, lake: Lake) -> DataFrame:
    """Per raw day: data rows, exact header and drive-letter paths, from one text scan."""
    lines = raw.read_lines(spark, lake.raw)
    blocks = lines.groupBy("file_path", "block_start").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.min_by(F.col("line") == HEADER_LINE, "scan_id").alias("first_matches"),
        F.count_if(F.col("line").rlike(C.ABSOLUTE_PATH_ANYWHERE)).alias("path_count"),
    )
    key = L.relative(lake, F.regexp_replace(raw.plain_path(F.col("file_path")), "/[^/]*$", ""))
    place = F.struct(F.length("file_path"), "file_path", "block_start")
    return blocks.groupBy(key.alias("raw_key")).agg(
        (F.sum("line_count") - 1).alias("raw_row_count"),
        F.min_by("first_matches", place).alias("raw_header_matches"),
        F.sum("path_count").alias("raw_path_count"),
    )


def quarantine_counts(spark: SparkSession, lake: Lake) -> DataFrame:
    if not L.exists(spark, lake.quarantine):
        return spark.createDataFrame(
            [], "quarantine_key string, rejected_row_count long, rejected_path_count long,"
            " damaged_line_count long"
        )
    rows = tables.read_quarantine(spark, lake.quarantine, tolerate_damage=True)
    text = F.to_json(F.struct("original_record", "original_field_values", "source_object_key"))
    return rows.groupBy(
        L.quarantine_key(lake, F.col("source_date"), F.col("input_id")).alias("quarantine_key")
    ).agg(
        F.count(F.lit(1)).alias("rejected_row_count"),
        F.count_if(text.rlike(C.ABSOLUTE_PATH_ANYWHERE)).alias("rejected_path_count"),
        F.count("damaged_line").alias("damaged_line_count"),
    )


def lake_evidence(spark: SparkSession, lake: Lake) -> DataFrame:
    """Ledger beside independent evidence from every zone, one row per day and input.

    Zones are joined on the folder that the day's identity names, also where the ledger has no
    quarantine. The full outer joins keep raw, staged and quarantine folders of days that the
    ledger does not know.
    """
    day, input_id = F.col("source_date"), F.col("input_id")
    book = L.manifests(spark, lake).withColumn("quarantine_folder", L.quarantine_key(lake, day, input_id))
    has_path = resume.has_absolute_path(
        "raw_key", "staging_key", "quarantine_key", "processing_timestamp", "pipeline_version",
        F.array_join(F.map_values("source_identity"), "\n"),
    )
    book = book.withColumn("manifest_has_path", has_path)
    sums = objects.object_checksums(spark, lake.raw, "*").select(
        L.relative(lake, F.col("object_key")).alias("raw_key"), F.col("sha256").alias("seen_raw_sha256")
    )
    staged = publish.staged_evidence(spark, lake).withColumnRenamed("source_date", "staged_date")
    rejected = publish.quarantine_evidence(spark, lake).withColumnRenamed("source_date", "rejected_date")
    rejected = rejected.join(quarantine_counts(spark, lake), "quarantine_key", "left").withColumnRenamed(
        "quarantine_key", "quarantine_folder"
    )

    def current(found: DataFrame, key: str, date: str) -> DataFrame:
        """Without outputs of earlier inputs of a day, which stay where they are."""
        known = book.select(F.col("source_date").alias(date), F.col(key).alias("known_key"), F.lit(True).alias("known_day"))
        joined = found.join(known, date, "left")
        return joined.where(F.col("known_day").isNull() | (F.col(key) == F.col("known_key"))).drop("known_key", "known_day")

    staged = current(staged, "staging_key", "staged_date")
    rejected = current(rejected, "quarantine_folder", "rejected_date")
    joined = (
        book.join(raw_counts(spark, lake).join(sums, "raw_key"), "raw_key", "full_outer")
        .join(staged, "staging_key", "full_outer")
        .join(rejected, "quarantine_folder", "full_outer")
    )
    return joined.withColumn("source_date", F.coalesce("source_date", "staged_date", "rejected_date"))


def lake_failures(evidence: DataFrame) -> DataFrame:
    """(raw_key, source_date, failure): one row per disagreement."""
    none = F.col("valid_row_count") == 0
    rejected = F.col("quarantine_row_count") > 0
    known = F.col("manifest_version").isNotNull()

    def same(left: str, right: str) -> Column:
        return F.col(left).eqNullSafe(F.col(right))

    checks = tagged(
        (known | F.col("raw_row_count").isNull(), "RAW_WITHOUT_MANIFEST"),
        (known | F.col("staged_byte_size").isNull(), "STAGED_WITHOUT_MANIFEST"),
        (known | F.col("rejected_byte_size").isNull(), "QUARANTINE_WITHOUT_MANIFEST"),
        (~known | same("raw_row_count", "input_row_count"), "RAW_ROWS"),
        (~known | same("seen_raw_sha256", "raw_sha256"), "RAW_DIGEST"),
        (F.col("raw_row_count").isNull() | F.col("raw_header_matches"), "RAW_HEADER"),
        (~known | same("staged_row_count", "valid_row_count") | none, "STAGED_ROWS"),
        (~known | none | F.col("staged_is_conformant"), "STAGED_FORMAT"),
        (~known | none | same("staged_sha256", "staging_sha256"), "STAGED_DIGEST"),
        (
            ~known | ~rejected | same("rejected_row_count", "quarantine_row_count"),
            "QUARANTINE_ROWS",
        ),
        (
            ~known | ~rejected | same("rejected_sha256", "quarantine_sha256"),
            "QUARANTINE_DIGEST",
        ),
        (
            ~known | rejected | F.col("rejected_byte_size").isNull(),
            "QUARANTINE_UNEXPECTED",
        ),
        (F.coalesce("damaged_line_count", F.lit(0)) == 0, "QUARANTINE_DAMAGED"),
        (
            ~known | same("input_row_count", "accounted_rows"),
            "ROWS_UNBALANCED",
        ),
        (
            (F.coalesce("raw_path_count", F.lit(0)) == 0)
            & (F.coalesce("rejected_path_count", F.lit(0)) == 0)
            & ~F.coalesce("staged_has_path", F.lit(False)) & ~F.coalesce("manifest_has_path", F.lit(False)),
            "ABSOLUTE_PATH",
        ),
    )
    accounted = evidence.withColumn(
        "accounted_rows", F.col("valid_row_count") + F.col("quarantine_row_count")
    )
    return accounted.select("raw_key", "source_date", F.explode(checks).alias("failure"))


def lake_summary(evidence: DataFrame) -> DataFrame:
    """One-row report over the same evidence."""
    failed = lake_failures(evidence).agg(F.count(F.lit(1)).alias("failure_count"), F.lit(1).alias("row"))
    totals = evidence.agg(
        F.count("manifest_version").alias("manifest_count"),
        F.count("raw_row_count").alias("raw_object_count"),
        F.count("staged_row_count").alias("staged_object_count"),
        F.count_if(F.col("valid_row_count") > 0).alias("expected_staged_count"),
        F.count("rejected_byte_size").alias("quarantine_object_count"),
        F.count_if(F.col("quarantine_row_count") > 0).alias("expected_quarantine_count"),
        F.min("source_date").alias("start_date"), F.max("source_date").alias("end_date"),
        F.sum("input_row_count").alias("manifest_input_row_count"),
        F.sum("valid_row_count").alias("manifest_valid_row_count"),
        F.sum("quarantine_row_count").alias("manifest_quarantine_row_count"),
        F.sum("raw_row_count").alias("raw_row_count"),
        F.sum("staged_row_count").alias("parquet_row_count"),
        F.sum("rejected_row_count").alias("quarantine_row_count"),
        F.sum("significant_gap_count").alias("significant_gap_count"),
        F.lit(1).alias("row"),
    )
    none = F.lit(0)
    sums_match = (
        (F.coalesce("raw_row_count", none) == F.coalesce("manifest_input_row_count", none))
        & (F.coalesce("parquet_row_count", none) == F.coalesce("manifest_valid_row_count", none))
        & (F.coalesce("quarantine_row_count", none) == F.coalesce("manifest_quarantine_row_count", none))
        & (F.coalesce("raw_row_count", none)
           == F.coalesce("parquet_row_count", none) + F.coalesce("quarantine_row_count", none))
    )
    counts_match = (
        (F.col("manifest_count") == F.col("raw_object_count"))
        & (F.col("staged_object_count") == F.col("expected_staged_count"))
        & (F.col("quarantine_object_count") == F.col("expected_quarantine_count"))
    )
    helpers = ("staged_object_count", "expected_staged_count", "quarantine_object_count", "expected_quarantine_count")
    return totals.join(failed, "row").withColumn(
        "aggregate_reconciliation_matches", sums_match & counts_match
    ).drop("row", *helpers).withColumn(
        "verified", (F.col("failure_count") == 0) & F.col("aggregate_reconciliation_matches")
    )


def inventory_from_runs(runs: DataFrame, lake: Lake) -> DataFrame:
    """The approved state per month, from completion rows."""
    return runs.select(
        "year", "month", "run_id", "curated_key", "curated_sha256", "curated_byte_size",
        F.concat(F.lit(f"{lake.root.rstrip('/')}/"), "curated_key", F.lit("/")).alias("location"),
        "selected_row_count", "curated_row_count", "quarantine_row_count",
        F.col("significant_gap_count").alias("within_month_gap_count"),
        F.col("first_valid_event_timestamp_local").alias("first_timestamp"),
        F.col("last_valid_event_timestamp_local").alias("last_timestamp"),
        F.when(F.col("terminal_partial_month"), "terminal_partial")
        .when(F.size("missing_dates") > 0, "known_missing_dates")
        .otherwise("complete").alias("coverage_status"),
        F.col("missing_dates").alias("known_missing_dates"),
        "terminal_partial_month",
    )


def inventory_identity(inventory: DataFrame) -> DataFrame:
    """Digest of the canonical inventory; one short item per month of history."""
    item = F.to_json(F.struct(*sorted(inventory.columns)), {"ignoreNullFields": "false"})
    return inventory.agg(
        F.sha2(
            F.concat_ws(",", F.transform(
                F.sort_array(F.collect_list(F.struct("year", "month", item.alias("item")))),
                lambda e: e["item"],
            )), 256,
        ).alias("inventory_id")
    )


def inventory_findings(
    spark: SparkSession, inventory: DataFrame, known_start: date, known_end: date,
    expected_total_rows: int,
) -> DataFrame:
    """Contract violations of an inventory: month label (null for the whole) and finding."""
    label = F.concat_ws("-", "year", "month")
    path = F.concat(F.lit("/year="), "year", F.lit("/month="), "month", F.lit("/run_id="), "run_id", F.lit("/"))
    first, last = F.col("first_timestamp"), F.col("last_timestamp")
    outside = F.exists(
        "known_missing_dates", lambda d: F.date_format(d, "yyyy-MM") != F.concat_ws("-", F.col("year"), F.col("month"))
    )
    checks = tagged(
        (F.col("month").rlike("^(0[1-9]|1[0-2])$") & F.col("run_id").rlike(identity.HEX64), "RUN_LABEL"),
        (F.col("curated_sha256").rlike(identity.HEX64), "CURATED_DIGEST_INVALID"),
        ((F.col("curated_byte_size") > 0) & (F.col("curated_row_count") >= 0), "CURATED_SIZE_INVALID"),
        (F.col("selected_row_count") == F.col("curated_row_count"), "SELECTED_ROWS_DIFFER"),
        ((F.col("quarantine_row_count") >= 0) & (F.col("within_month_gap_count") >= 0), "COUNT_NEGATIVE"),
        (F.col("location").endswith(path), "LOCATION_RUN"),
        (F.concat(F.lit("/"), "curated_key", F.lit("/")).endswith(path), "KEY_RUN"),
        (first.isNull() | last.isNull() | (first <= last), "BOUNDS_REVERSED"),
        (F.col("coverage_status").isin(*COVERAGE), "COVERAGE_UNKNOWN"),
        (~outside, "MISSING_DATE_OFF_MONTH"),
    )
    per_month = inventory.select(label.alias("month_label"), F.explode(checks).alias("finding"))
    repeated = inventory.groupBy(label.alias("month_label")).count().where("count > 1").select(
        "month_label", F.lit("MONTH_REPEATED").alias("finding")
    )
    expected = month_table(spark, known_start, known_end).select(label.alias("month_label"))
    present = inventory.select(label.alias("month_label"))
    uncovered = expected.join(present, "month_label", "left_anti").unionByName(
        present.join(expected, "month_label", "left_anti")
    ).select("month_label", F.lit("MONTHS_DIFFER").alias("finding"))
    total = inventory.agg(F.coalesce(F.sum("curated_row_count"), F.lit(0)).alias("total")).where(
        F.col("total") != expected_total_rows
    ).select(
        F.lit(None).cast("string").alias("month_label"),
        F.lit("TOTAL_ROWS_DIFFER").alias("finding"),
    )
    return per_month.unionByName(repeated).unionByName(uncovered).unionByName(total)


def audit_months(
    spark: SparkSession, lake: Lake, inventory: DataFrame, published: DataFrame,
    bounds: AuditBounds | None = None,
) -> DataFrame:
    """Full findings of an inventory: severity, month_label, finding.

    Curated rows, checksums, completion rows and catalog partitions are re-read and joined on
    the month. A month with a fatal finding gives no endpoint to the boundary checks.
    """
    limits = bounds or AuditBounds()
    label = F.concat_ws("-", "year", "month")
    seen = curated_state(spark, lake, inventory)
    checks = tagged(
        (within("curated_byte_size", limits.max_object_bytes), "OVER_OBJECT_LIMIT"),
        (
            (F.col("seen_byte_size") == F.col("curated_byte_size"))
            & (F.col("seen_sha256") == F.col("curated_sha256")),
            "CURATED_BYTES_DIFFER",
        ),
        (F.col("row_count") == F.col("curated_row_count"), "CURATED_ROWS_DIFFER"),
        (F.col("order_violation_count") == 0, "CURATED_ORDER"),
        (F.col("duplicate_timestamp_count") == 0, "CURATED_TIMESTAMP_REPEATED"),
        (F.col("duplicate_index_count") == 0, "CURATED_INDEX_REPEATED"),
        (F.col("null_row_count") == 0, "CURATED_NULL"),
        (
            F.col("seen_first").eqNullSafe(F.col("first_timestamp"))
            & F.col("seen_last").eqNullSafe(F.col("last_timestamp")),
            "CURATED_BOUNDS_DIFFER",
        ),
        (F.col("completion_matches"), "COMPLETION_DIFFERS"),
    )

    def graded(df: DataFrame, severity: str, finding: Column) -> DataFrame:
        return df.select(F.lit(severity).alias("severity"), "month_label", finding.alias("finding"))

    fatal = graded(seen.withColumn("month_label", label), "fatal", F.explode(checks))
    differs = seen.select(label.alias("month_label"), F.explode(tagged(
        (F.col("selected_row_count") == F.col("row_count"), "SELECTED_ROWS_DIFFER"),
        (F.col("completion_reconciles"), "COMPLETION_UNBALANCED"),
    )).alias("finding"))
    reconciliation = graded(differs, "reconciliation", F.col("finding"))
    drift = graded(
        catalog.publication_drift(inventory, published).withColumn("month_label", label), "drift",
        F.col("finding"),
    )
    quality = graded(
        inventory.select(
            label.alias("month_label"),
            F.explode(F.array_compact(F.array(
                F.when(F.size("known_missing_dates") > 0, F.lit("known_missing_dates")),
                F.when(F.col("terminal_partial_month"), F.lit("terminal_partial_month")),
            ))).alias("finding"),
        ),
        "quality", F.col("finding"),
    )
    whole = inventory.agg(
        F.count(F.lit(1)).alias("months"), F.sum("curated_byte_size").alias("bytes"),
        F.sum("curated_row_count").alias("rows"),
    ).select(
        F.lit(None).cast("string").alias("month_label"),
        F.explode(tagged(
            (within("months", limits.max_months), "OVER_MONTH_LIMIT"),
            (within("bytes", limits.max_total_bytes), "OVER_BYTE_LIMIT"),
            (within("rows", limits.max_total_rows), "OVER_ROW_LIMIT"),
        )).alias("finding"),
    )
    return (
        fatal.unionByName(reconciliation).unionByName(drift).unionByName(quality)
        .unionByName(graded(whole, "fatal", F.col("finding")))
    )


def curated_state(spark: SparkSession, lake: Lake, inventory: DataFrame) -> DataFrame:
    """Inventory months beside re-read rows, checksums and completion rows."""
    folders = compact.run_folders(spark, lake, inventory)
    empty = tables.read_normalized(spark, lake.curated, *compact.RUN).limit(0)
    curated = compact.read_curated(spark, lake, folders, True) if folders else empty
    evidence = conformance.curated_evidence(curated, MONTH).withColumnsRenamed(
        {"first_timestamp": "seen_first", "last_timestamp": "seen_last"}
    )
    sums = publish.objects_by_key(spark, lake, folders, "*.parquet", "curated").select(
        "curated_key", F.col("curated_byte_size").alias("seen_byte_size"),
        F.col("curated_sha256").alias("seen_sha256"),
    )
    book = L.read_months(spark, lake.control("compaction_run")).select(
        "run_id", "curated_key",
        F.struct(
            "curated_sha256", "curated_byte_size", "curated_row_count",
            F.col("first_valid_event_timestamp_local").alias("first_timestamp"),
            F.col("last_valid_event_timestamp_local").alias("last_timestamp"),
            F.col("significant_gap_count").alias("within_month_gap_count"),
            "terminal_partial_month", F.col("missing_dates").alias("known_missing_dates"),
        ).alias("booked"),
        F.struct("selected_row_count", "quarantine_row_count").alias("booked_counts"),
        (F.col("curated_equals_selected_valid") & F.col("input_equals_valid_plus_quarantine")).alias(
            "booked_reconciles"
        ),
    )
    pinned = (
        "curated_sha256", "curated_byte_size", "curated_row_count", "first_timestamp",
        "last_timestamp", "within_month_gap_count", "terminal_partial_month", "known_missing_dates",
    )
    matches = F.col("booked").isNotNull()
    for name in pinned:
        matches = matches & F.col(f"booked.{name}").eqNullSafe(F.col(name))
    reconciles = F.col("booked_reconciles")
    for name in ("selected_row_count", "quarantine_row_count"):
        reconciles = reconciles & F.col(f"booked_counts.{name}").eqNullSafe(F.col(name))
    return (
        inventory.join(evidence, MONTH, "left")
        .join(sums, "curated_key", "left")
        .join(book, ["run_id", "curated_key"], "left")
        .withColumn("completion_matches", matches)
        .withColumn("completion_reconciles", reconciles)
    )


def month_endpoints(inventory: DataFrame, findings: DataFrame) -> DataFrame:
    """Continuity endpoints of months without a fatal finding, dated to day one."""
    label = F.concat_ws("-", "year", "month").alias("label")
    failed = findings.where(F.col("severity") == "fatal").select(F.col("month_label").alias("label"))
    return inventory.select(
        label, F.concat_ws("-", "year", "month", F.lit("01")).cast("date").alias("partition_date"),
        "first_timestamp", "last_timestamp",
        F.col("within_month_gap_count").alias("significant_gap_count"), "curated_row_count",
    ).join(failed, "label", "left_anti")


def audit_summary(
    inventory: DataFrame, findings: DataFrame, limits: Thresholds | None = None
) -> DataFrame:
    """One-row audit result: counts per severity, gap composition and status."""
    cadence = limits or Thresholds()
    endpoints = month_endpoints(inventory, findings)
    boundaries = continuity.boundaries(endpoints, cadence)
    composed = continuity.gap_composition(endpoints, boundaries, cadence)
    row = F.lit(1).alias("row")
    totals = inventory.agg(F.count(F.lit(1)).alias("months_inspected"), row)
    rows = endpoints.agg(F.coalesce(F.sum("curated_row_count"), F.lit(0)).alias("total_curated_rows"), row)
    counts = findings.agg(
        *[
            F.count_if(F.col("severity") == s).alias(f"{s}_count")
            for s in ("fatal", "reconciliation", "drift", "quality")
        ],
        row,
    )
    failed = (F.col("fatal_count") + F.col("reconciliation_count") + F.col("drift_count")) > 0
    return (
        totals.join(rows, "row").join(counts, "row").join(composed.select("*", row), "row").drop("row")
        .withColumn("status", F.when(failed, "failed").otherwise("passed"))
    )
