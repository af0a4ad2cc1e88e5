"""Compact the days of each month into one sorted, verified, immutable run."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake import contract as C
from gaugelake.contract import CompactionBounds
from gaugelake.functions import identity
from gaugelake.operators import conformance, continuity, repeats
from gaugelake.operators import selection as S
from gaugelake.plans import lake as L
from gaugelake.plans import publish
from gaugelake.plans.lake import Lake
from gaugelake.session import partitions_for, share_listings, stage, together
from gaugelake.sources import objects, tables

RUN = ["year", "month", "run_id"]
COMPLETION_SCHEMA = (
    "year string, month string, run_id string, curated_key string, curated_byte_size long,"
    " curated_sha256 string, row_group_count long, curated_row_count long,"
    " selected_input_count long, input_row_count long, selected_row_count long,"
    " quarantine_row_count long, first_valid_event_timestamp_local timestamp_ntz,"
    " last_valid_event_timestamp_local timestamp_ntz, significant_gap_count long,"
    " missing_dates array<date>, terminal_partial_month boolean,"
    " curated_equals_selected_valid boolean, input_equals_valid_plus_quarantine boolean,"
    " is_conformant boolean, manifest_version string, write_outcome string"
)


def read_curated(
    spark: SparkSession, lake: Lake, below: list[str] | None = None, tolerate_damage: bool = False
) -> DataFrame:
    return tables.read_normalized(
        spark, lake.curated, *RUN, below=below, tolerate_damage=tolerate_damage
    )


def run_folders(spark: SparkSession, lake: Lake, runs: DataFrame) -> list[str]:
    """Folders of runs that hold files, one per month of history."""
    key = L.curated_key(lake, F.col("year"), F.col("month"), F.col("run_id"))
    found = [f"{lake.root.rstrip('/')}/{r[0]}" for r in runs.select(key).collect()]
    return L.existing(spark, found)


def month_folders(spark: SparkSession, lake: Lake, inputs: DataFrame) -> list[str]:
    """Staging folders of the selected months that hold files."""
    months = inputs.select(*S.MONTH).distinct().collect()
    found = [f"{lake.staging}/year={r['year']}/month={r['month']}" for r in months]
    return L.existing(spark, found)


def staged_rows(spark: SparkSession, lake: Lake, inputs: DataFrame) -> DataFrame:
    """Staged rows of exactly the selected inputs; the join prunes staging folders."""
    picked = inputs.select(
        *S.MONTH, F.date_format("source_date", "dd").alias("day"),
        F.col("processing_identity").alias("input_id"),
    )
    rows = tables.read_normalized(spark, lake.staging, "year", "month", "day", "input_id")
    return rows.drop("_metadata").join(picked, ["year", "month", "day", "input_id"], "left_semi")


def rejections(
    spark: SparkSession, lake: Lake, inputs: DataFrame, months: DataFrame, rows: DataFrame,
    bounds: CompactionBounds,
) -> DataFrame:
    """Everything that keeps a month from being compacted: year, month, source_date, finding.

    ``inputs`` is what was reviewed; the ledger as it is now must still say the same.
    """
    found = (
        S.selection_findings(inputs, months)
        .unionByName(S.bound_findings(inputs, bounds))
        .unionByName(S.marker_findings(inputs, L.manifests(spark, lake)))
        .unionByName(
            S.evidence_findings(
                inputs, publish.staged_evidence(spark, lake, month_folders(spark, lake, inputs))
            )
        )
    )
    # A timestamp can only be on two days if it is on a day other than its own.
    off_day = rows.where(F.to_date("event_timestamp_local") != F.col("source_date"))
    across = repeats.keys_across(rows, S.MONTH, "record_index", "source_date")
    return found.unionByName(
        off_day.groupBy(*S.MONTH, "source_date").agg(F.lit("TIMESTAMP_ON_TWO_DAYS").alias("finding"))
    ).unionByName(
        across.groupBy(*S.MONTH, F.col("last_part").alias("source_date")).agg(F.lit("INDEX_ON_TWO_DAYS").alias("finding"))
    )


def write_runs(rows: DataFrame, lake: Lake, parts: int) -> None:
    """Sorted curated files: one range-partitioned pass over all months.

    A month larger than a partition becomes several files whose name order is the sort order.
    """
    names = [f.name for f in C.NORMALIZED_SCHEMA]
    keys = [*RUN, "event_timestamp_local", "record_index"]
    (
        rows.select(*names, *RUN)
        .repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .write.mode("append")
        .option("compression", "snappy")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.block.row.count.limit", str(C.ROW_GROUP_ROWS))
        .partitionBy(*RUN)
        .parquet(lake.curated)
    )


def existing_runs(spark: SparkSession, lake: Lake, wanted: DataFrame) -> DataFrame:
    """Fingerprints of wanted runs that are already written."""
    folders = run_folders(spark, lake, wanted)
    if not folders:
        return spark.createDataFrame(
            [], "year string, month string, run_id string, row_count long, row_hash_sum string"
        )
    rows = read_curated(spark, lake, folders)
    return identity.content_fingerprint(rows, RUN, [f.name for f in C.NORMALIZED_SCHEMA])


def compact_months(
    spark: SparkSession, lake: Lake, known_start: date, known_end: date,
    bounds: CompactionBounds | None = None, selection: DataFrame | None = None,
) -> DataFrame:
    """Compact every month of the range that may be compacted.

    ``selection`` is a reviewed selection in the columns of ``selected_inputs``; without one the
    ledger is taken as it stands. Days of a month outside the known range are findings. Returns
    one row per month with inputs; a month that is rejected, or whose run or output conflicts,
    carries its findings and holds up no other. Running again with the same inputs writes
    nothing.
    """
    share_listings(spark)
    limits = bounds or CompactionBounds()
    months = S.month_table(spark, known_start, known_end)
    chosen = S.selected_inputs(L.manifests(spark, lake)) if selection is None else selection
    inputs = stage(chosen.join(months.select(*S.MONTH), S.MONTH, "left_semi"), "inputs")
    rows = staged_rows(spark, lake, inputs)
    rejected = stage(rejections(spark, lake, inputs, months, rows, limits), "rejections")
    runs = stage(
        S.run_identities(inputs, lake.source).join(rejected, S.MONTH, "left_anti"), "runs"
    )
    # One row per month, so a broadcast of the run list stays tiny for any history.
    with_run = rows.join(F.broadcast(runs), S.MONTH)
    old = stage(existing_runs(spark, lake, runs), "old-runs")
    if not old.isEmpty():
        again = with_run.join(F.broadcast(old.select(*RUN)), RUN, "left_semi")
        fresh = identity.content_fingerprint(again, RUN, [f.name for f in C.NORMALIZED_SCHEMA])
        # The run directory holds rows other than those of its identity: leave it alone.
        differs = stage(
            old.exceptAll(fresh.select(*old.columns)).select(
                *S.MONTH, F.lit(None).cast("date").alias("source_date"), F.lit("RUN_CONFLICT").alias("finding")
            ), "conflicts",
        )
        rejected = rejected.unionByName(differs)
        runs = runs.join(differs, S.MONTH, "left_anti")
    size = inputs.agg(F.sum("staging_byte_size")).first()[0]
    write_runs(
        with_run.join(F.broadcast(old.select(*RUN)), RUN, "left_anti"), lake, partitions_for(spark, size)
    )
    completion = stage(completions(spark, lake, inputs, runs, months, old), "completion")
    bad = completion.select(
        *S.MONTH, F.lit(None).cast("date").alias("source_date"),
        F.explode(S.tagged(
            (F.col("curated_equals_selected_valid") & F.col("input_equals_valid_plus_quarantine"), "ROWS_UNBALANCED"),
            (F.col("is_conformant"), "CURATED_FORMAT"),
            (F.col("curated_byte_size").isNull() | S.within("curated_byte_size", limits.max_output_bytes), "OVER_OUTPUT_LIMIT"),
        )).alias("finding"),
    )
    rejected = rejected.unionByName(bad)
    completion = completion.join(bad, S.MONTH, "left_anti")
    runs = runs.join(bad, S.MONTH, "left_anti")
    if not completion.isEmpty():
        boundaries = continuity.selection_boundaries(inputs.join(runs, S.MONTH, "left_semi"), S.MONTH)
        selected = inputs.join(runs, S.MONTH)
        together(
            spark,
            lambda: L.write_ledger(boundaries, lake.control("selection_boundary"), *S.MONTH),
            lambda: L.write_ledger(selected, lake.control("compaction_selection"), *S.MONTH),
        )
        L.write_ledger(completion, lake.control("compaction_run"), *S.MONTH)
    refused = rejected.groupBy(*S.MONTH).agg(
        F.array_sort(F.collect_set("finding")).alias("findings")
    )
    return completion.join(refused, S.MONTH, "full_outer")


def completions(
    spark: SparkSession, lake: Lake, inputs: DataFrame, runs: DataFrame, months: DataFrame,
    old: DataFrame,
) -> DataFrame:
    """Completion evidence from the re-read output of each run."""
    folders = run_folders(spark, lake, runs)
    if not folders:
        return spark.createDataFrame([], COMPLETION_SCHEMA)
    curated = read_curated(spark, lake, folders)
    # A month has one run here, so the short month keys group the rows.
    evidence = conformance.curated_evidence(curated, S.MONTH)
    gaps = conformance.month_gap_counts(curated, S.MONTH)
    folder = F.regexp_replace("file_path", "/[^/]*$", "")
    expected = F.array(*[F.lit(c) for c in objects.NORMALIZED_FOOTER])
    footers = (
        objects.parquet_footers(spark, folders)
        .groupBy(L.relative(lake, folder).alias("curated_key"))
        .agg(
            F.sum("row_group_count").alias("row_group_count"),
            F.max("largest_row_group").alias("largest_row_group"),
            F.bool_and((F.array_join("codecs", ",") == "SNAPPY") & (F.col("columns") == expected)).alias(
                "footer_matches"
            ),
        )
    )
    sums = publish.objects_by_key(spark, lake, folders, "*.parquet", "curated")
    missing = (
        S.missing_dates(S.expected_dates(months), inputs)
        .groupBy(*S.MONTH)
        .agg(F.array_sort(F.collect_list("source_date")).alias("missing_dates"))
    )
    clean = F.lit(True)
    for name in (
        "null_row_count", "date_conflict_count", "order_violation_count",
        "duplicate_timestamp_count", "duplicate_index_count",
    ):
        clean = clean & (F.col(name) == 0)
    keyed = (
        runs.join(evidence, S.MONTH, "left")
        .join(gaps, S.MONTH, "left")
        .withColumn("curated_key", L.curated_key(lake, F.col("year"), F.col("month"), F.col("run_id")))
        .join(footers, "curated_key", "left")
        .join(sums, "curated_key", "left")
        .withColumn("curated_row_count", F.coalesce("row_count", F.lit(0)))
        .withColumn(
            "is_conformant",
            F.coalesce(
                clean & F.col("footer_matches") & (F.col("largest_row_group") <= C.ROW_GROUP_ROWS),
                F.col("row_count").isNull(),
            ),
        )
    )
    reconciled = S.month_reconciliation(inputs, keyed.select(*S.MONTH, "curated_row_count"))
    return (
        keyed.drop("curated_row_count")
        .join(reconciled, S.MONTH)
        .join(missing, S.MONTH, "left")
        .join(months.select(*S.MONTH, "terminal_partial_month"), S.MONTH)
        .join(old.select(*RUN, F.lit("existing").alias("write_outcome")), RUN, "left")
        .select(
            *RUN, "curated_key", "curated_byte_size", "curated_sha256", "row_group_count",
            "curated_row_count", "selected_input_count", "input_row_count", "selected_row_count",
            "quarantine_row_count",
            F.col("first_timestamp").alias("first_valid_event_timestamp_local"),
            F.col("last_timestamp").alias("last_valid_event_timestamp_local"),
            F.coalesce("significant_gap_count", F.lit(0)).alias("significant_gap_count"),
            F.coalesce("missing_dates", F.array().cast("array<date>")).alias("missing_dates"),
            "terminal_partial_month", "curated_equals_selected_valid",
            "input_equals_valid_plus_quarantine", "is_conformant",
            F.lit(C.COMPACTION_MANIFEST_VERSION).alias("manifest_version"),
            F.coalesce("write_outcome", F.lit("created")).alias("write_outcome"),
        )
    )
