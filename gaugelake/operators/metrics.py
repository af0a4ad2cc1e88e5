"""Per-object batch metrics, warnings, errors and reconciliation.

Every aggregate here is algebraic, so one huge object still combines map-side. The interval
distribution stays in long form: one row per (object, seconds).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake import contract as C
from gaugelake.contract import Thresholds


def is_abnormal(seconds: Column, limits: Thresholds) -> Column:
    return (seconds > 0) & ~seconds.between(limits.interval_min, limits.interval_max)


def is_significant(seconds: Column, limits: Thresholds) -> Column:
    return seconds > limits.gap_seconds


def interval_counts(deltas: DataFrame, groups: Sequence[str]) -> DataFrame:
    return deltas.groupBy(*groups, "seconds").agg(F.count(F.lit(1)).alias("interval_count"))


def _count_where(condition: Column, weight: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0)).cast("bigint")


def interval_metrics(counts: DataFrame, groups: Sequence[str], limits: Thresholds) -> DataFrame:
    s = F.col("seconds")
    return counts.groupBy(*groups).agg(
        _count_where(s < 0, "interval_count").alias("out_of_order_transition_count"),
        _count_where(is_abnormal(s, limits), "interval_count").alias(
            "abnormal_sampling_interval_count"
        ),
        _count_where(is_significant(s, limits), "interval_count").alias("significant_gap_count"),
        F.max(F.when(is_significant(s, limits), s)).alias("maximum_gap_seconds"),
    )


def row_metrics(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Counts and positional first/last valid timestamps of validated rows."""
    valid = F.size("issues") == 0
    ts, position = F.col("event_timestamp_local"), F.col("source_row_number")
    valid_position = F.when(valid, position)
    return rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("input_row_count"),
        F.count_if(valid).alias("valid_row_count"),
        F.count_if(~valid).alias("quarantine_row_count"),
        F.count(ts).alias("parseable_timestamp_count"),
        F.min_by(ts, valid_position).alias("first_valid_event_timestamp_local"),
        F.max_by(ts, valid_position).alias("last_valid_event_timestamp_local"),
    )


def quarantine_rule_counts(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    return (
        rows.select(*groups, F.explode("issues.rule_id").alias("rule_id"))
        .groupBy(*groups, "rule_id")
        .agg(F.count(F.lit(1)).alias("rule_count"))
    )


def batch_metrics(
    objects: DataFrame, rows: DataFrame, intervals: DataFrame, limits: Thresholds,
    key: str = "object_key",
) -> DataFrame:
    """One row per object, published or not; unpublished objects have no valid rows.

    ``objects`` has ``key``, ``input_row_count``, ``schema_drift`` and ``empty_input``;
    ``rows`` are validated rows of objects that passed the gate. A row carries at most one
    entry per rule, so the rule list has at most nine entries.
    """
    rules = quarantine_rule_counts(rows, [key]).groupBy(key).agg(
        F.sort_array(
            F.collect_list(F.struct("rule_id", F.col("rule_count").alias("count")))
        ).alias("quarantine_rule_counts")
    )
    zero = F.lit(0).cast("bigint")
    counted = [
        "valid_row_count", "quarantine_row_count", "parseable_timestamp_count",
        "out_of_order_transition_count", "abnormal_sampling_interval_count",
        "significant_gap_count",
    ]
    empty_rules = F.array().cast("array<struct<rule_id:string,count:bigint>>")
    joined = (
        objects.join(row_metrics(rows, [key]).drop("input_row_count"), key, "left")
        .join(interval_metrics(intervals, [key], limits), key, "left")
        .join(rules, key, "left")
    )
    return joined.select(
        *objects.columns,
        *[F.coalesce(c, zero).alias(c) for c in counted],
        "maximum_gap_seconds",
        (F.col("input_row_count") < limits.low_row_count).alias(
            "unexpectedly_low_daily_row_count"
        ),
        F.coalesce("quarantine_rule_counts", empty_rules).alias("quarantine_rule_counts"),
        "first_valid_event_timestamp_local",
        "last_valid_event_timestamp_local",
    )


def reconciliation(metrics: DataFrame) -> DataFrame:
    applicable = ~(F.col("schema_drift") | F.col("empty_input"))
    accounted = F.col("valid_row_count") + F.col("quarantine_row_count")
    return metrics.select(
        "*",
        accounted.alias("accounted_row_count"),
        (F.col("input_row_count") == accounted).alias("reconciliation_matches"),
        applicable.alias("reconciliation_applicable"),
    )


def _warning(rule_id: str, present: Column, observed: Column) -> Column:
    return F.when(
        present,
        F.struct(
            F.lit(rule_id).alias("rule_id"),
            F.lit(C.WARNING_TEXT[rule_id]).alias("message"),
            observed.cast("bigint").alias("observed_count"),
        ),
    )


def with_warnings(metrics: DataFrame) -> DataFrame:
    order = F.col("out_of_order_transition_count")
    abnormal = F.col("abnormal_sampling_interval_count")
    gaps = F.col("significant_gap_count")
    found = F.array(
        _warning(C.TIMESTAMP_ORDER, order > 0, order),
        _warning(C.SAMPLING_INTERVAL, abnormal > 0, abnormal),
        _warning(C.SIGNIFICANT_GAP, gaps > 0, gaps),
        _warning(
            C.LOW_ROW_COUNT, F.col("unexpectedly_low_daily_row_count"), F.col("input_row_count")
        ),
    )
    return metrics.withColumn("batch_warnings", F.array_compact(found))


def with_errors(reconciled: DataFrame) -> DataFrame:
    """Conditions that block publication; they gate every write of the object."""
    mismatch = F.col("reconciliation_applicable") & ~F.col("reconciliation_matches")

    def error(rule_id: str, present: Column) -> Column:
        return F.when(
            present,
            F.struct(F.lit(rule_id).alias("rule_id"), F.lit(C.ERROR_TEXT[rule_id]).alias("message")),
        )

    found = F.array(
        error(C.SCHEMA_DRIFT, F.col("schema_drift")),
        error(C.EMPTY_INPUT, F.col("empty_input")),
        error(C.RECONCILIATION_MISMATCH, mismatch),
    )
    return reconciled.withColumn("batch_errors", F.array_compact(found))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Totals of one run over per-day outcomes (``status`` plus manifest columns)."""
    done = F.col("status") != "failed"

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(done, F.col(name))), F.lit(0)).cast("bigint").alias(name)

    statuses = ("processed", "rebuilt", "skipped", "manifest_upgraded", "failed")
    summary = outcomes.agg(
        F.count(F.lit(1)).alias("date_count"),
        F.min("source_date").alias("start_date"),
        F.max("source_date").alias("end_date"),
        F.count_if(done).alias("completed_day_count"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_day_count") for s in statuses],
        *[total(n) for n in ("input_row_count", "valid_row_count", "quarantine_row_count")],
    )
    return summary.withColumn(
        "reconciliation_matches",
        (F.col("failed_day_count") == 0)
        & (F.col("input_row_count") == F.col("valid_row_count") + F.col("quarantine_row_count")),
    )


def warning_totals(outcomes: DataFrame) -> DataFrame:
    """Days and observations per warning rule over completed days."""
    return (
        outcomes.where(F.col("status") != "failed")
        .select(F.explode("batch_warnings").alias("w"))
        .groupBy(F.col("w.rule_id").alias("rule_id"))
        .agg(
            F.count(F.lit(1)).alias("warning_day_count"),
            F.sum("w.observed_count").alias("warning_observation_count"),
        )
    )


# Operational metric names and the alarm rule of each.
ALARM_RULES = {
    "ReconciliationFailures": ("sum", 1.0),
    "CompactionReconciliationFailures": ("sum", 1.0),
    "ImmutableOutputConflicts": ("sum", 1.0),
    "PublicationConflicts": ("sum", 1.0),
    "AuditRowReconciliationFailures": ("sum", 1.0),
    "MissingPublications": ("sum", 1.0),
    "PublicationDrift": ("sum", 1.0),
    "QuarantineRate": ("max", 5.0),
}


def run_metric_rows(metrics: DataFrame, at: str) -> DataFrame:
    """Long operational metrics: ``at``, ``metric_name``, ``metric_value``."""
    rows_in = F.col("input_row_count")
    rate = F.when(rows_in == 0, 0.0).otherwise(F.col("quarantine_row_count") / rows_in * 100)
    failed = F.size("batch_errors") > 0
    wide = metrics.select(
        at,
        rows_in.cast("double").alias("InputRows"),
        F.col("valid_row_count").cast("double").alias("ValidRows"),
        F.col("quarantine_row_count").cast("double").alias("QuarantineRows"),
        rate.alias("QuarantineRate"),
        (~failed).cast("double").alias("ObjectsProcessed"),
        failed.cast("double").alias("ObjectsFailed"),
        (F.col("reconciliation_applicable") & ~F.col("reconciliation_matches"))
        .cast("double").alias("ReconciliationFailures"),
    )
    names = [c for c in wide.columns if c != at]
    return wide.unpivot([at], names, "metric_name", "metric_value")


def alarms(metric_rows: DataFrame, at: str, period: str = "5 minutes") -> DataFrame:
    """Breached periods: counts sum to the limit or more, rates exceed it."""
    per_period = metric_rows.groupBy(
        F.window(at, period)["start"].alias("period_start"), "metric_name"
    ).agg(F.sum("metric_value").alias("sum_value"), F.max("metric_value").alias("max_value"))
    breached, observed = F.lit(False), F.lit(None).cast("double")
    for name, (statistic, limit) in ALARM_RULES.items():
        value = F.col(f"{statistic}_value")
        over = value >= limit if statistic == "sum" else value > limit
        breached = breached | ((F.col("metric_name") == name) & over)
        observed = F.when(F.col("metric_name") == name, value).otherwise(observed)
    return per_period.where(breached).select(
        "period_start", "metric_name", observed.alias("observed_value")
    )
