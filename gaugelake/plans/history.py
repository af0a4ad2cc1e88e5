"""Continuity of the whole history, from the ledger as it stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake.contract import Thresholds
from gaugelake.operators import continuity
from gaugelake.plans import lake as L
from gaugelake.plans.lake import Lake
from gaugelake.session import stage


class LedgerError(ValueError):
    """The ledger can't be audited as one history."""


def endpoints(manifests: DataFrame) -> DataFrame:
    """First and last valid timestamp of every day, labelled by its date."""
    return manifests.select(
        F.date_format("source_date", "yyyy-MM-dd").alias("label"),
        F.col("source_date").alias("partition_date"),
        F.col("first_valid_event_timestamp_local").alias("first_timestamp"),
        F.col("last_valid_event_timestamp_local").alias("last_timestamp"),
    )


def ledger_boundaries(spark: SparkSession, lake: Lake, limits: Thresholds | None = None) -> DataFrame:
    """Neighbouring days in date order; the order in which they arrived plays no part."""
    return continuity.boundaries(endpoints(L.manifests(spark, lake)), limits or Thresholds())


def ledger_continuity(
    spark: SparkSession, lake: Lake, limits: Thresholds | None = None, expected_gap_count: int | None = None
) -> DataFrame:
    """One-row continuity audit over manifests and daily interval rows.

    A date with two manifest rows has no defined history and is refused.
    """
    cadence = limits or Thresholds()
    book = stage(L.manifests(spark, lake), "ledger")
    doubled = continuity.duplicate_manifest_dates(book).first()
    if doubled is not None:
        raise LedgerError(f"two manifests for {doubled['source_date']}")
    within = L.intervals(spark, lake).join(book.select("source_date"), "source_date", "left_semi")
    findings = stage(continuity.boundaries(endpoints(book), cadence), "boundaries")
    counts = stage(
        continuity.scoped_distributions(within, continuity.boundary_counts(findings)), "scoped"
    )
    summaries = continuity.interval_summaries(counts, "scope", cadence)
    return continuity.continuity_report(book, within, summaries, findings, expected_gap_count)
