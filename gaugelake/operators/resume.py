"""Which raw objects still need work, judged from checksums and the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake import contract as C


def ledger_is_consistent() -> Column:
    """Facts a manifest row must satisfy on its own."""
    counts = F.col("input_row_count") == F.col("valid_row_count") + F.col("quarantine_row_count")
    present = F.col("quarantine_status") == "present"
    quarantine = F.when(
        F.col("quarantine_row_count") > 0, present & F.col("quarantine_key").isNotNull()
    ).otherwise(
        (F.col("quarantine_status") == "absent_zero_rows")
        & F.col("quarantine_key").isNull()
        & F.col("quarantine_sha256").isNull()
        & (F.col("quarantine_byte_size") == 0)
    )
    return (
        counts & quarantine & F.col("reconciliation_matches") & F.col("reconciliation_applicable")
        & ~has_absolute_path(
            "raw_key", "staging_key", "quarantine_key", "processing_timestamp", "pipeline_version",
            F.array_join(F.map_values("source_identity"), "\n"),
        )
    )


def has_absolute_path(*values: Column | str) -> Column:
    """True when any text holds a drive-letter path."""
    found = F.lit(False)
    for value in values:
        text = (F.col(value) if isinstance(value, str) else value).cast("string")
        found = found | F.coalesce(text.rlike(C.ABSOLUTE_PATH_ANYWHERE), F.lit(False))
    return found


def boundary_is_consistent() -> Column:
    first = F.col("first_valid_event_timestamp_local")
    last = F.col("last_valid_event_timestamp_local")
    return F.col("valid_timestamp_count").eqNullSafe(F.col("valid_row_count")) & F.when(
        F.col("valid_timestamp_count") == 0, first.isNull() & last.isNull()
    ).otherwise(first.isNotNull() & last.isNotNull())


def decisions(
    current: DataFrame, ledger: DataFrame, staging: DataFrame, quarantine: DataFrame,
    expected: dict[str, str], force: bool = False,
) -> DataFrame:
    """``current`` plus ``status``: skipped, manifest_upgraded, rebuilt or processed.

    ``current``: source_date, raw_key, raw_sha256, raw_byte_size.
    ``staging``: source_date, evidence of the staged rows (row count, first and last timestamp by
    position, size, digest, codec and schema verdict). ``quarantine``: source_date, size,
    digest. ``expected`` pins versions and processing time. A day is reused only when every
    piece agrees. All sides have one row per day.
    """
    versions = F.lit(True)
    for name, value in expected.items():
        versions = versions & F.col(f"m.{name}").eqNullSafe(F.lit(value))
    book = ledger.withColumn("is_consistent", ledger_is_consistent()).withColumn(
        "has_boundary", boundary_is_consistent()
    )
    joined = (
        current.alias("c")
        .join(book.alias("m"), "source_date", "left")
        .join(staging.alias("s"), "source_date", "left")
        .join(quarantine.alias("q"), "source_date", "left")
    )
    raw_same = (
        F.col("m.raw_key").eqNullSafe(F.col("c.raw_key"))
        & (F.col("m.raw_sha256") == F.col("c.raw_sha256"))
        & (F.col("m.raw_byte_size") == F.col("c.raw_byte_size"))
    )
    no_rows = F.col("m.valid_row_count") == 0
    staged_same = (no_rows & F.col("s.staged_row_count").isNull()) | (
        (F.col("s.staged_row_count") == F.col("m.valid_row_count"))
        & F.col("s.staged_sha256").eqNullSafe(F.col("m.staging_sha256"))
        & (F.col("s.staged_byte_size") == F.col("m.staging_byte_size"))
        & F.col("s.staged_is_conformant")
    )
    quarantine_same = F.when(
        F.col("m.quarantine_row_count") > 0,
        F.col("q.rejected_sha256").eqNullSafe(F.col("m.quarantine_sha256"))
        & (F.col("q.rejected_byte_size") == F.col("m.quarantine_byte_size")),
    ).otherwise(F.col("q.rejected_byte_size").isNull())
    endpoints_same = F.col("s.staged_first").eqNullSafe(
        F.col("m.first_valid_event_timestamp_local")
    ) & F.col("s.staged_last").eqNullSafe(F.col("m.last_valid_event_timestamp_local"))

    reusable = F.col("m.is_consistent") & versions & raw_same & staged_same & quarantine_same
    complete = (
        reusable & (F.col("m.manifest_version") == C.MANIFEST_VERSION)
        & F.col("m.has_boundary") & endpoints_same
    )
    legacy = reusable & (F.col("m.manifest_version") == C.LEGACY_MANIFEST_VERSION)
    has_outputs = (
        F.col("m.manifest_version").isNotNull() | F.col("s.staged_row_count").isNotNull()
        | F.col("q.rejected_byte_size").isNotNull()
    )
    status = F.when(has_outputs, "rebuilt").otherwise("processed")
    if not force:
        status = (
            F.when(F.coalesce(complete, F.lit(False)), "skipped")
            .when(F.coalesce(legacy, F.lit(False)), "manifest_upgraded")
            .otherwise(status)
        )
    return joined.select("source_date", "c.*", status.alias("status")).select(
        *current.columns, "status"
    )
