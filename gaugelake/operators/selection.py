"""Monthly selections: which days belong to a month, whether they may be compacted."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake import contract as C
from gaugelake.contract import CompactionBounds
from gaugelake.functions import identity, wallclock

MONTH = ["year", "month"]


def month_table(spark: SparkSession, known_start: date, known_end: date) -> DataFrame:
    """Every month of the known range with its terminal-partial flag."""
    if known_start > known_end:
        raise ValueError("KNOWN_RANGE")
    return months_of(
        spark.range(1).select(
            F.lit(known_start).alias("known_source_start"), F.lit(known_end).alias("known_source_end")
        )
    )


def months_of(bounds: DataFrame) -> DataFrame:
    """``month_table`` for a one-row frame of ``known_source_start`` and ``known_source_end``."""
    first = F.explode(
        F.sequence(
            F.trunc("known_source_start", "MM"), F.trunc("known_source_end", "MM"),
            F.expr("interval 1 month"),
        )
    )
    end, last_day = F.col("known_source_end"), F.last_day("month_start")
    return bounds.select("*", first.alias("month_start")).select(
        wallclock.year_text(F.col("month_start")).alias("year"),
        wallclock.month_text(F.col("month_start")).alias("month"),
        "month_start", "known_source_start", "known_source_end",
        (end < last_day).alias("terminal_partial_month"),
    )


def expected_dates(months: DataFrame) -> DataFrame:
    """Every calendar day of the known range: year, month, source_date."""
    first = F.greatest("month_start", "known_source_start")
    last = F.least(F.last_day("month_start"), F.col("known_source_end"))
    return months.select(*MONTH, F.explode(F.sequence(first, last)).alias("source_date"))


def selected_inputs(manifests: DataFrame) -> DataFrame:
    """One pinned daily input per manifest row; the marker pins the row's own content."""
    names = sorted(manifests.columns)
    marker = identity.sha256(
        F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    )
    return manifests.select(
        wallclock.year_text(F.col("source_date")).alias("year"),
        wallclock.month_text(F.col("source_date")).alias("month"),
        "source_date",
        F.col("input_id").alias("processing_identity"),
        F.lit("sha256").alias("completion_marker_identity_kind"),
        marker.alias("completion_marker_identity_value"),
        "staging_key", "staging_sha256", "staging_byte_size",
        "input_row_count", "valid_row_count", "quarantine_row_count",
        F.col("first_valid_event_timestamp_local").alias("first_valid_timestamp"),
        F.col("last_valid_event_timestamp_local").alias("last_valid_timestamp"),
        "pipeline_version", "schema_version", "manifest_version",
    )


def missing_dates(expected: DataFrame, inputs: DataFrame) -> DataFrame:
    return expected.join(inputs.select("source_date"), "source_date", "left_anti")


def unexpected_dates(expected: DataFrame, inputs: DataFrame) -> DataFrame:
    return inputs.join(expected.select("source_date"), "source_date", "left_anti")


def tagged(*checks: tuple[Column, str]) -> Column:
    """Texts of the checks that fail; a check that is null fails too."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for ok, text in checks])
    )


def within(column: str, limit: int | None) -> Column:
    """The quantity keeps its limit; without one it always does."""
    return F.lit(True) if limit is None else F.col(column) <= limit


def input_findings(inputs: DataFrame) -> DataFrame:
    """Contract violations of single inputs: year, month, source_date, finding."""
    first, last = F.col("first_valid_timestamp"), F.col("last_valid_timestamp")
    valid = F.col("valid_row_count")
    kind, value = F.col("completion_marker_identity_kind"), F.col("completion_marker_identity_value")
    filled = F.lit(True)
    for name in (
        "processing_identity", "staging_key", "pipeline_version", "schema_version", "manifest_version"
    ):
        filled = filled & (F.col(name) != "")
    in_month = (wallclock.year_text(F.col("source_date")) == F.col("year")) & (
        wallclock.month_text(F.col("source_date")) == F.col("month")
    )
    no_rows = valid == 0
    on_day = (F.to_date(first) == F.col("source_date")) & (F.to_date(last) == F.col("source_date"))
    bare = first.isNull() & last.isNull()
    checks = tagged(
        (in_month, "MONTH_DIFFERS"),
        (kind.isin("version_id", "sha256", "etag"), "MARKER_KIND"),
        (value != "", "MARKER_EMPTY"),
        ((kind != "sha256") | F.lower(value).rlike(identity.HEX64), "MARKER_DIGEST"),
        (filled, "IDENTITY_EMPTY"),
        (
            F.col("input_row_count") == valid + F.col("quarantine_row_count"),
            "COUNTS_DIFFER",
        ),
        ((valid >= 0) & (F.col("quarantine_row_count") >= 0), "COUNT_NEGATIVE"),
        (~no_rows | bare, "EMPTY_DAY_HAS_BOUNDS"),
        (no_rows | (first.isNotNull() & last.isNotNull()), "BOUNDS_MISSING"),
        (bare | on_day, "BOUNDS_OFF_DAY"),
        (bare | (first <= last), "BOUNDS_REVERSED"),
        (
            (F.col("schema_version") == C.SCHEMA_VERSION)
            & (F.col("manifest_version") == C.MANIFEST_VERSION),
            "VERSION_UNKNOWN",
        ),
        (F.lower("staging_sha256").rlike(identity.HEX64), "STAGING_DIGEST_INVALID"),
        (F.col("staging_byte_size") > 0, "STAGING_SIZE"),
    )
    return inputs.select(*MONTH, "source_date", F.explode(checks).alias("finding"))


def selection_findings(inputs: DataFrame, months: DataFrame) -> DataFrame:
    """Violations of whole selections added to those of single inputs."""
    expected = expected_dates(months)
    repeated = inputs.groupBy(*MONTH, "source_date").count().where("count > 1").select(
        *MONTH, "source_date", F.lit("DATE_REPEATED").alias("finding")
    )
    outside = unexpected_dates(expected, inputs).select(
        *MONTH, "source_date",
        F.lit("DATE_UNEXPECTED").alias("finding"),
    )
    return input_findings(inputs).unionByName(repeated).unionByName(outside)


def bound_findings(inputs: DataFrame, bounds: CompactionBounds) -> DataFrame:
    totals = inputs.groupBy(*MONTH).agg(
        F.count(F.lit(1)).alias("objects"), F.sum("staging_byte_size").alias("bytes"),
        F.sum("input_row_count").alias("rows"),
    )
    checks = tagged(
        (within("objects", bounds.max_selected_objects), "OVER_OBJECT_LIMIT"),
        (within("bytes", bounds.max_compressed_input_bytes), "OVER_BYTE_LIMIT"),
        (within("rows", bounds.max_input_rows), "OVER_ROW_LIMIT"),
    )
    return totals.select(
        *MONTH, F.lit(None).cast("date").alias("source_date"), F.explode(checks).alias("finding")
    )


def marker_findings(inputs: DataFrame, manifests: DataFrame) -> DataFrame:
    """Inputs whose pinned evidence no longer equals the ledger row of their day."""
    current = selected_inputs(manifests)
    pinned = [c for c in inputs.columns if c not in (*MONTH, "source_date")]
    joined = inputs.alias("a").join(current.alias("b"), "source_date", "left")
    differs = F.lit(False)
    for name in pinned:
        differs = differs | ~F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    gone = F.col("b.processing_identity").isNull()
    return joined.where(gone | differs).select(
        F.col("a.year").alias("year"), F.col("a.month").alias("month"), "source_date",
        F.when(gone, "MARKER_GONE")
        .otherwise("MARKER_CONFLICT").alias("finding"),
    )


def evidence_findings(inputs: DataFrame, staged: DataFrame) -> DataFrame:
    """Selected days against what is staged now: digest, size, rows, endpoints, dates."""
    joined = inputs.join(staged.drop("source_date"), "staging_key", "left")
    empty = (F.col("valid_row_count") == 0) & F.col("staged_row_count").isNull()
    checks = tagged(
        (
            empty | ((F.col("staged_byte_size") == F.col("staging_byte_size"))
                     & (F.col("staged_sha256") == F.lower("staging_sha256"))),
            "STAGING_BYTES_DIFFER",
        ),
        (empty | F.col("staged_is_conformant"), "STAGING_FORMAT"),
        (
            empty | (F.col("staged_row_count") == F.col("valid_row_count")),
            "STAGING_ROWS_DIFFER",
        ),
        (
            F.col("staged_first").eqNullSafe(F.col("first_valid_timestamp"))
            & F.col("staged_last").eqNullSafe(F.col("last_valid_timestamp")),
            "STAGING_BOUNDS_DIFFER",
        ),
    )
    return joined.select(*MONTH, "source_date", F.explode(checks).alias("finding"))


# Fixed values that are part of a run's identity.
WRITER = {
    "compression": "snappy", "row_group_size": str(C.ROW_GROUP_ROWS), "use_dictionary": "false",
    "write_statistics": "true",
}


def run_identities(
    inputs: DataFrame, source: str, compactor_version: str = "1.0.0",
    output_contract_version: str = "1.0.0",
) -> DataFrame:
    """(year, month, run_id): digest of the selected content, independent of its order.

    A month of one source selects at most 31 days, so its list stays short.
    """
    columns = sorted(c for c in inputs.columns if c not in MONTH)
    canonical = inputs.select(
        *MONTH,
        "source_date",
        F.struct(
            *[
                (wallclock.iso_text(F.col(c)) if c.endswith("_timestamp")
                 else F.lower(c) if c.endswith("_sha256") or c == "completion_marker_identity_value"
                 else F.date_format(c, "yyyy-MM-dd") if c == "source_date"
                 else F.col(c)).alias(c)
                for c in columns
            ]
        ).alias("item"),
    )

    def versions(name: str) -> Column:
        return F.array_sort(F.collect_set(F.col(f"item.{name}")))

    grouped = canonical.groupBy(*MONTH).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("source_date", "item"))), lambda e: e["item"]
        ).alias("inputs"),
        versions("manifest_version").alias("manifest_versions"),
        versions("pipeline_version").alias("pipeline_versions"),
        versions("schema_version").alias("schema_versions"),
    )
    text = identity.canonical_json(
        compactor_version=F.lit(compactor_version),
        inputs=F.col("inputs"),
        manifest_versions=F.col("manifest_versions"),
        month=F.col("month"),
        output_contract_version=F.lit(output_contract_version),
        pipeline_versions=F.col("pipeline_versions"),
        schema_versions=F.col("schema_versions"),
        source_name=F.lit(source.lower()),
        writer_contract=F.struct(*[F.lit(v).alias(k) for k, v in sorted(WRITER.items())]),
        year=F.col("year"),
    )
    return grouped.select(*MONTH, identity.sha256(text).alias("run_id"))


def month_reconciliation(inputs: DataFrame, curated: DataFrame) -> DataFrame:
    """Selected against curated rows per month. ``curated``: year, month, curated_row_count."""
    totals = inputs.groupBy(*MONTH).agg(
        F.count(F.lit(1)).alias("selected_input_count"),
        F.sum("input_row_count").alias("input_row_count"),
        F.sum("valid_row_count").alias("selected_row_count"),
        F.sum("quarantine_row_count").alias("quarantine_row_count"),
    )
    counted = totals.join(curated, MONTH, "left").withColumn(
        "curated_row_count", F.coalesce("curated_row_count", F.lit(0))
    )
    return counted.select(
        "*",
        (F.col("curated_row_count") == F.col("selected_row_count")).alias(
            "curated_equals_selected_valid"
        ),
        (
            F.col("input_row_count")
            == F.col("selected_row_count") + F.col("quarantine_row_count")
        ).alias("input_equals_valid_plus_quarantine"),
    )
