"""Validate raw objects: lines to valid rows, quarantine and per-object evidence."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake import contract as C
from gaugelake.contract import Thresholds
from gaugelake.functions import parsing
from gaugelake.operators import metrics, ordered, repeats, rules
from gaugelake.session import stage
from gaugelake.sources import raw


@dataclass
class Validated:
    """Result of one validation run; every frame covers all objects of the run."""

    objects: DataFrame
    staged: DataFrame
    limits: Thresholds

    @property
    def rows(self) -> DataFrame:
        """Every row; ``fields`` of rejected rows are split anew where they are asked for."""
        return with_fields(self.staged)

    def valid(self) -> DataFrame:
        return rules.valid_rows(self.rows)

    def quarantine(
        self, pipeline_version: str, processing_timestamp: Column,
        lineage: dict[str, Column] | None = None,
    ) -> DataFrame:
        return rules.quarantine_rows(self.rows, pipeline_version, processing_timestamp, lineage)

    @cached_property
    def intervals(self) -> DataFrame:
        """Interval distribution over all parseable timestamps, in source order, staged once."""
        pairs = ordered.deltas(
            self.rows, ["object_key"], "source_row_number", "event_timestamp_local"
        )
        return stage(metrics.interval_counts(pairs, ["object_key"]), "intervals")

    def rule_counts(self) -> DataFrame:
        return metrics.quarantine_rule_counts(self.rows, ["object_key"])

    def batch(self) -> DataFrame:
        """Metrics, warnings, reconciliation and errors: one row per object."""
        made = metrics.batch_metrics(self.objects, self.rows, self.intervals, self.limits)
        return metrics.with_errors(metrics.reconciliation(metrics.with_warnings(made)))


def with_fields(rows: DataFrame) -> DataFrame:
    """Add ``fields`` from the text of the row; null without a text."""
    return rows.withColumn("fields", parsing.csv_fields(parsing.without_newline(F.col("original_record"))))


def parsed_lines(lines: DataFrame) -> DataFrame:
    """Typed values and single-row issues of every line, header lines included."""
    judged = rules.with_row_issues(rules.parse_values(raw.checked_lines(lines)))
    return rules.with_named_numbers(judged)


def validate(lines: DataFrame, limits: Thresholds | None = None) -> Validated:
    """Validate whole objects.

    The parsed lines are written once, which freezes the scan positions that row numbers come
    from. Row numbers need only the block table. Objects whose header drifts, that are empty,
    not UTF-8 or malformed contribute no rows; they keep their row in ``objects``.
    """
    parsed = raw.with_joined_records(lines.sparkSession, stage(parsed_lines(lines), "parsed", "zstd"), parsed_lines)
    blocks = stage(raw.block_table(parsed), "blocks")
    objects = raw.object_table(blocks)
    # One row an object: written, so that Spark knows its size and no row moves for the join.
    passed = stage(objects.where(
        ~F.col("schema_drift") & ~F.col("empty_input") & F.col("is_utf8")
        & F.col("is_well_formed") & F.col("source_date").isNotNull()
    ).select("object_key"), "passed")

    numbered = (
        raw.with_row_numbers(parsed.drop("is_utf8", "is_well_formed", "is_header", "file_size"), blocks)
        .where(F.col("source_row_number") > 0)
        .join(passed, "object_key", "left_semi")
    )
    flagged = repeats.flag_repeats(
        numbered, ["object_key"],
        {"repeats_index": "record_index", "repeats_timestamp": "event_timestamp_local"},
        ["object_key", "source_row_number"],
    )
    judged = rules.with_object_issues(
        flagged, "source_date", "repeats_index", "repeats_timestamp"
    )
    # Only rejected rows need their text again, so valid rows drop it before the write; typed
    # signals are asked of valid rows only.
    rejected = ~rules.is_valid()
    signals = (*C.ANALOGUE, *C.DIGITAL)
    rows = judged.select(
        *[c for c in judged.columns if c not in (
            "line", "original_record", "file_path", "block_start", "scan_id", *signals)],
        *[F.when(~rejected, F.col(name)).alias(name) for name in signals],
        F.when(rejected, F.col("original_record")).alias("original_record"),
    )
    return Validated(objects, stage(rows, "judged", "zstd"), limits or Thresholds())
