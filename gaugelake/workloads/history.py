"""Registered queries: continuity over ordered partitions and monthly selections."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake import contract as C
from gaugelake.contract import CompactionBounds, Thresholds
from gaugelake.functions import identity, wallclock
from gaugelake.operators import conformance, continuity, metrics, ordered, repeats, reports, selection
from gaugelake.session import stage
from gaugelake.workloads.common import Registry, sql_seconds, table

REGISTRY = Registry()
query = REGISTRY.add

LIMITS = Thresholds()


# --- Continuity over days of events ---------------------------------------------------------


def _day_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One endpoint per day; positional first and last, as a manifest states them."""
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("partition_date")).agg(
        F.min_by("ts", "event_id").alias("first_timestamp"),
        F.max_by("ts", "event_id").alias("last_timestamp"),
    ).withColumn("label", F.date_format("partition_date", "yyyy-MM-dd"))


_ENDPOINTS_SQL = """
endpoints as (
  select cast(ts as date) as partition_date, strftime(cast(ts as date), '%Y-%m-%d') as label,
         arg_min(ts, event_id) as first_timestamp, arg_max(ts, event_id) as last_timestamp
  from events group by 1, 2)"""
_STATUS_SQL = """case when delta_seconds is null then 'unassessable_empty_or_fully_quarantined_partition'
    when delta_seconds < 0 then 'reversed_overlap' when delta_seconds = 0 then 'overlap'
    when delta_seconds > 60 then 'significant_gap'
    when delta_seconds not between 9 and 13 then 'abnormal_positive_interval' else 'normal' end"""
_BOUNDARIES_SQL = f"""
pairs as (
  select lag(label) over w as previous_label, label as current_label,
         greatest(date_diff('day', lag(partition_date) over w, partition_date) - 1, 0) as missing_calendar_date_count,
         {sql_seconds("lag(last_timestamp) over w", "first_timestamp")} as delta_seconds
  from endpoints window w as (order by label)),
boundaries as (select *, {_STATUS_SQL} as status from pairs where previous_label is not null)"""


@query(f"with {_ENDPOINTS_SQL}, {_BOUNDARIES_SQL} select * from boundaries")
def boundary_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continuity.boundaries(_day_endpoints(spark, sf_dir), LIMITS)


_ORDER_DAYS_SQL = """
endpoints as (
  select cast(o_orderdate as date) as partition_date, strftime(cast(o_orderdate as date), '%Y-%m-%d') as label,
         case when min(o_orderkey) % 7 <> 0 then min(o_orderdate) end as first_timestamp,
         case when min(o_orderkey) % 7 <> 0 then max(o_orderdate) + to_seconds(86400 + (count(*) % 3 - 1) * 45) end
           as last_timestamp
  from orders group by 1, 2)"""


def _order_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day endpoints with overlaps, gaps and days whose rows were all rejected."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("partition_date")).agg(
        F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"),
        F.min("o_orderkey").alias("k"), F.count(F.lit(1)).alias("n"),
    )
    shift = F.make_dt_interval(secs=(F.lit(86400) + (F.col("n") % 3 - 1) * 45).cast("decimal(18,6)"))
    present = F.col("k") % 7 != 0
    return days.select(
        "partition_date", F.date_format("partition_date", "yyyy-MM-dd").alias("label"),
        F.when(present, F.col("first")).alias("first_timestamp"),
        F.when(present, F.col("last") + shift).alias("last_timestamp"),
    )


@query(f"""with {_ORDER_DAYS_SQL}, {_BOUNDARIES_SQL}
select rule_id, previous_label, current_label, missing_calendar_date_count, delta_seconds, status from (
  select *, unnest(list_filter([
      case when missing_calendar_date_count > 0 then 'AUDIT_MISSING_CALENDAR_DATE' end,
      case when delta_seconds is null then 'AUDIT_BOUNDARY_UNASSESSABLE' end,
      case when delta_seconds <= 0 then 'AUDIT_BOUNDARY_OVERLAP' end,
      case when delta_seconds > 60 then 'AUDIT_BOUNDARY_SIGNIFICANT_GAP' end], lambda x: x is not null)) as rule_id
  from boundaries)""")
def boundary_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = continuity.boundaries(_order_endpoints(spark, sf_dir), LIMITS)
    return continuity.boundary_warnings(findings, LIMITS)


_SCOPES_SQL = f"""
day_deltas as (
  select {sql_seconds("lag(ts) over (partition by cast(ts as date) order by event_id)", "ts")} as seconds
  from events),
parts as (
  select 'within' as scope, seconds from day_deltas where seconds is not null
  union all select 'boundary', delta_seconds from boundaries where delta_seconds is not null),
scoped as (select scope, seconds from parts union all select 'global', seconds from parts)"""


def _within_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").withColumn("source_date", F.to_date("ts"))
    return metrics.interval_counts(
        ordered.deltas(days, ["source_date"], "event_id", "ts"), ["source_date"]
    )


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = continuity.boundaries(_day_endpoints(spark, sf_dir), LIMITS)
    return continuity.scoped_distributions(
        _within_days(spark, sf_dir), continuity.boundary_counts(findings)
    )


@query(f"""with {_ENDPOINTS_SQL}, {_BOUNDARIES_SQL}, {_SCOPES_SQL}
select scope, seconds, count(*) as interval_count from scoped group by 1, 2""")
def global_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scoped(spark, sf_dir)


@query(f"""with {_ENDPOINTS_SQL}, {_BOUNDARIES_SQL}, {_SCOPES_SQL}
select scope, count(*) filter (seconds > 0 and seconds not between 9 and 13) as abnormal_positive_interval_count,
       max(seconds) filter (seconds > 60) as maximum_significant_gap_seconds,
       min(seconds) filter (seconds > 60) as minimum_significant_gap_seconds,
       count(*) filter (seconds > 60) as significant_gap_count, count(*) as total_delta_count,
       median(seconds) filter (seconds > 60)::double as median_significant_gap_seconds
from scoped group by 1""")
def interval_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stage(_scoped(spark, sf_dir), "scoped")
    return continuity.interval_summaries(counts, "scope", LIMITS)


@query(f"""
select source_date, median(seconds)::double as median from (
  select cast(ts as date) as source_date,
         {sql_seconds("lag(ts) over (partition by cast(ts as date) order by event_id)", "ts")} as seconds from events)
where seconds is not null group by 1""")
def daily_interval_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugelake.operators.quantiles import weighted_medians

    return weighted_medians(_within_days(spark, sf_dir), ["source_date"], "seconds", "interval_count")


@query(f"""with {_ENDPOINTS_SQL}, {_BOUNDARIES_SQL}, {_SCOPES_SQL}
select (select count(*) from scoped where scope = 'within' and seconds > 60) as within_gap_count,
       (select count(*) from boundaries where delta_seconds > 60) as cross_gap_count,
       (select count(*) from boundaries where status = 'overlap') as overlap_count,
       (select count(*) from boundaries where status = 'reversed_overlap') as reversed_boundary_count,
       (select count(*) from scoped where scope = 'global' and seconds > 60) as global_gap_count""")
def gap_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    within = metrics.interval_metrics(_within_days(spark, sf_dir), ["source_date"], LIMITS)
    findings = continuity.boundaries(_day_endpoints(spark, sf_dir), LIMITS)
    return continuity.gap_composition(within, findings, LIMITS)


@query(f"""with {_ENDPOINTS_SQL}, {_BOUNDARIES_SQL}, {_SCOPES_SQL}
select 'passed' as status, (select count(*) from endpoints) as partition_count,
       (select min(partition_date) from endpoints) as start_date,
       (select max(partition_date) from endpoints) as end_date,
       (select count(*) from events) as source_row_count, (select count(*) from events) as valid_timestamp_count,
       (select count(*) from scoped where scope = 'global') as global_total_delta_count,
       (select count(*) from scoped where scope = 'global' and seconds > 60) as global_significant_gap_count,
       0::bigint as unassessable_boundary_count, 0::bigint as consistency_finding_count,
       (select count(*) from boundaries where delta_seconds <= 0) as overlap_finding_count""")
def continuity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    manifests = events.groupBy(F.to_date("ts").alias("source_date")).agg(
        F.count(F.lit(1)).alias("input_row_count"), F.count("ts").alias("valid_row_count"),
        F.count("ts").alias("valid_timestamp_count"), F.count("ts").alias("parseable_timestamp_count"),
    ).select("*", F.lit("1").alias("pipeline_version"), F.lit("1").alias("schema_version"))
    within = stage(_within_days(spark, sf_dir), "within")
    findings = stage(continuity.boundaries(_day_endpoints(spark, sf_dir), LIMITS), "findings")
    counts = stage(
        continuity.scoped_distributions(within, continuity.boundary_counts(findings)), "scoped"
    )
    report = continuity.continuity_report(
        manifests, within, continuity.interval_summaries(counts, "scope", LIMITS), findings
    )
    return report.select(
        "status", "partition_count", "start_date", "end_date", "source_row_count",
        "valid_timestamp_count", "global_total_delta_count", "global_significant_gap_count",
        "unassessable_boundary_count", "consistency_finding_count", "overlap_finding_count",
    )


# --- Months ---------------------------------------------------------------------------------

_MONTH_SQL = "strftime(l_shipdate, '%Y') as year, strftime(l_shipdate, '%m') as month"


def _ship_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a feed: ship date as time, order and line number as index."""
    return table(spark, sf_dir, "lineitem").select(
        wallclock.year_text(F.col("l_shipdate")).alias("year"),
        wallclock.month_text(F.col("l_shipdate")).alias("month"),
        F.col("l_shipdate").alias("event_timestamp_local"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_index"),
        "l_quantity",
    )


@query(f"""
select year, month, count(*) as significant_gap_count from (
  select {_MONTH_SQL}, {sql_seconds("lag(l_shipdate) over w", "l_shipdate")} as seconds
  from lineitem window w as (partition by strftime(l_shipdate, '%Y'), strftime(l_shipdate, '%m') order by l_shipdate))
where seconds > 60 group by 1, 2""")
def month_gap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformance.month_gap_counts(_ship_rows(spark, sf_dir), ["year", "month"])


@query(f"""with m as (
  select {_MONTH_SQL}, min(l_shipdate) as lo, max(l_shipdate) as hi from lineitem group by 1, 2),
endpoints as (
  select year || '-' || month as label, cast(year || '-' || month || '-01' as date) as partition_date,
         lo as first_timestamp, hi as last_timestamp from m),
{_BOUNDARIES_SQL} select * from boundaries""")
def month_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = _ship_rows(spark, sf_dir).groupBy("year", "month").agg(
        F.min("event_timestamp_local").alias("first_timestamp"),
        F.max("event_timestamp_local").alias("last_timestamp"),
    )
    endpoints = months.select(
        F.concat_ws("-", "year", "month").alias("label"),
        F.concat_ws("-", "year", "month", F.lit("01")).cast("date").alias("partition_date"),
        "first_timestamp", "last_timestamp",
    )
    return continuity.boundaries(endpoints, LIMITS)


@query("""
select cast(l_shipdate as date) as source_date, count(*) as observation_count from lineitem
where strftime(l_shipdate, '%Y') = '1997' and strftime(l_shipdate, '%m') = '02' group by 1""")
def month_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily count report over a table partitioned by month, pruned to one month."""
    from gaugelake.session import new_folder

    folder = new_folder(spark, "partitioned")
    (
        _ship_rows(spark, sf_dir).repartitionByRange("year", "month", "event_timestamp_local", "record_index")
        .write.partitionBy("year", "month").parquet(folder)
    )
    schema = "event_timestamp_local timestamp_ntz, record_index long, l_quantity double, year string, month string"
    curated = spark.read.schema(schema).parquet(folder)
    return reports.row_counts_by_date(
        reports.month_partition(curated, "1997", "02"), F.to_date("event_timestamp_local"), "record_index"
    )


@query("""
select strftime(m, '%Y') as year, strftime(m, '%m') as month, hi < last_day(m) as terminal_partial_month
from (select unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), interval 1 month))::date as m, hi
      from (select min(o_orderdate)::date as lo, max(o_orderdate)::date as hi from orders))""")
def month_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    known = table(spark, sf_dir, "orders").agg(
        F.min(day).alias("known_source_start"), F.max(day).alias("known_source_end")
    )
    return selection.months_of(known).select("year", "month", "terminal_partial_month")


def _order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("source_date")).distinct()


@query("""
select d as source_date, strftime(d, '%Y') as year, strftime(d, '%m') as month from (
  select unnest(generate_series(date '1994-12-15', date '2001-11-20', interval 1 day))::date as d)
where d not in (select cast(o_orderdate as date) from orders)""")
def missing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = selection.expected_dates(
        selection.month_table(spark, date(1994, 12, 15), date(2001, 11, 20))
    )
    return selection.missing_dates(expected, _order_days(spark, sf_dir))


@query("""
select distinct cast(o_orderdate as date) as source_date from orders
where cast(o_orderdate as date) not between date '1995-03-10' and date '2001-02-11'""")
def unexpected_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = selection.month_table(spark, date(1995, 3, 10), date(2001, 2, 11))
    return selection.unexpected_dates(selection.expected_dates(months), _order_days(spark, sf_dir))


def _selection_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One selected input per order day, some of them breaking the selection contract."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("source_date")).agg(
        F.count(F.lit(1)).alias("input_row_count"),
        F.count_if(F.col("o_orderstatus") != "P").alias("valid_row_count"),
        F.min("o_orderkey").alias("k"), F.min("o_orderdate").alias("first"),
    )
    text = F.date_format("source_date", "yyyy-MM-dd")
    none = F.col("valid_row_count") == 0
    k = F.col("k")
    ts = F.when(~none, F.col("first"))
    return days.select(
        wallclock.year_text(F.col("source_date")).alias("year"),
        wallclock.month_text(F.col("source_date")).alias("month"),
        "source_date",
        text.alias("processing_identity"),
        F.lit("sha256").alias("completion_marker_identity_kind"),
        F.when(k % 11 == 3, "short").otherwise(F.sha2(text, 256)).alias("completion_marker_identity_value"),
        F.concat(F.lit("staging/"), text).alias("staging_key"),
        F.sha2(F.concat(text, F.lit("s")), 256).alias("staging_sha256"),
        F.when(k % 13 == 4, 0).otherwise(F.col("input_row_count") * 100).cast("long").alias("staging_byte_size"),
        "input_row_count", "valid_row_count",
        (F.col("input_row_count") - F.col("valid_row_count") + F.when(k % 17 == 5, 1).otherwise(0)).alias(
            "quarantine_row_count"
        ),
        ts.alias("first_valid_timestamp"),
        (ts + F.when(k % 19 == 6, F.expr("interval 1 day")).otherwise(F.expr("interval 10 hours"))).alias(
            "last_valid_timestamp"
        ),
        F.lit("1.0.0").alias("pipeline_version"), F.lit(C.SCHEMA_VERSION).alias("schema_version"),
        F.when(k % 23 == 7, "0.9").otherwise(C.MANIFEST_VERSION).alias("manifest_version"),
    )


_INPUTS_SQL = """
inputs as (
  select *, strftime(source_date, '%Y') as year, strftime(source_date, '%m') as month,
         strftime(source_date, '%Y-%m-%d') as text,
         input_row_count - valid_row_count + (case when k % 17 = 5 then 1 else 0 end) as quarantine_row_count,
         case when k % 13 = 4 then 0 else input_row_count * 100 end as staging_byte_size
  from (select cast(o_orderdate as date) as source_date, count(*) as input_row_count,
               count(*) filter (o_orderstatus <> 'P') as valid_row_count, min(o_orderkey) as k
        from orders group by 1))"""


@query(f"with {_INPUTS_SQL} " + " union all ".join(
    f"select year, month, source_date, '{finding}' as finding from inputs where {cond}"
    for finding, cond in (
        ("MARKER_DIGEST", "k % 11 = 3"),
        ("STAGING_SIZE", "k % 13 = 4"),
        ("COUNTS_DIFFER", "k % 17 = 5"),
        ("BOUNDS_OFF_DAY", "k % 19 = 6 and valid_row_count > 0"),
        ("VERSION_UNKNOWN", "k % 23 = 7"),
        ("DATE_UNEXPECTED",
         "source_date not between date '1995-03-10' and date '2001-02-11'"))))
def selection_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = selection.month_table(spark, date(1995, 3, 10), date(2001, 2, 11))
    return selection.selection_findings(_selection_inputs(spark, sf_dir), months)


@query(f"with {_INPUTS_SQL}, t as (select year, month, count(*) as n, sum(staging_byte_size) as b,"
       " sum(input_row_count) as r from inputs group by 1, 2) "
       + " union all ".join(
           f"select year, month, null::date as source_date, '{text}' as finding from t where {cond}"
           for text, cond in (
               ("OVER_OBJECT_LIMIT", "n > 30"),
               ("OVER_BYTE_LIMIT", "b > 19000"),
               ("OVER_ROW_LIMIT", "r > 195"))))
def compaction_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = CompactionBounds(30, 19_000, 195)
    return selection.bound_findings(_selection_inputs(spark, sf_dir), limits)


@query(f"""with {_INPUTS_SQL}, spans as (
  select year, month, source_date, case when valid_row_count > 0 then cast(source_date as timestamp) end as lo,
         case when valid_row_count > 0 then cast(source_date as timestamp)
              + (case when k % 19 = 6 then interval 1 day else interval 10 hours end) end as hi from inputs),
pairs as (
  select year, month, lag(source_date) over w as previous_date, source_date as current_date,
         epoch(lo - lag(hi) over w)::double as seconds
  from spans window w as (partition by year, month order by source_date))
select *, case when seconds is null then 'unassessable_empty_boundary' when seconds < 0 then 'reversed_boundary'
       when seconds = 0 then 'overlapping_boundary' when seconds > 60 then 'gap_over_60_seconds'
       else 'observed_boundary' end as classification
from pairs where previous_date is not null""")
def selection_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continuity.selection_boundaries(_selection_inputs(spark, sf_dir), ["year", "month"])


@query(f"""with {_INPUTS_SQL}, curated as (
  select strftime(o_orderdate, '%Y') as year, strftime(o_orderdate, '%m') as month,
         count(*) filter (o_orderstatus <> 'P') as curated_row_count from orders group by 1, 2)
select year, month, count(*) as selected_input_count, sum(input_row_count)::bigint as input_row_count,
       sum(valid_row_count)::bigint as selected_row_count, sum(quarantine_row_count)::bigint as quarantine_row_count,
       min(curated_row_count) as curated_row_count,
       min(curated_row_count) = sum(valid_row_count) as curated_equals_selected_valid,
       sum(input_row_count) = sum(valid_row_count) + sum(quarantine_row_count) as input_equals_valid_plus_quarantine
from inputs join curated using (year, month) group by 1, 2""")
def month_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    curated = orders.where(F.col("o_orderstatus") != "P").groupBy(
        wallclock.year_text(F.col("o_orderdate")).alias("year"),
        wallclock.month_text(F.col("o_orderdate")).alias("month"),
    ).agg(F.count(F.lit(1)).alias("curated_row_count"))
    return selection.month_reconciliation(_selection_inputs(spark, sf_dir), curated)


_IDENTITY_SQL_ITEM = (
    "'{\"completion_marker_identity_kind\":\"sha256\",\"completion_marker_identity_value\":\"'"
    " || case when k % 11 = 3 then 'short' else sha256(text) end || '\",\"first_valid_timestamp\":'"
    " || case when valid_row_count > 0 then '\"' || text || 'T00:00:00\"' else 'null' end"
    " || ',\"input_row_count\":' || input_row_count || ',\"last_valid_timestamp\":'"
    " || case when valid_row_count = 0 then 'null' when k % 19 = 6 then"
    " '\"' || strftime(source_date + interval 1 day, '%Y-%m-%d') || 'T00:00:00\"'"
    " else '\"' || text || 'T10:00:00\"' end"
    " || ',\"manifest_version\":\"' || case when k % 23 = 7 then '0.9' else '1.1.0' end"
    " || '\",\"pipeline_version\":\"1.0.0\",\"processing_identity\":\"' || text"
    " || '\",\"quarantine_row_count\":' || quarantine_row_count || ',\"schema_version\":\"1.0.0\",\"source_date\":\"'"
    " || text || '\",\"staging_byte_size\":' || staging_byte_size || ',\"staging_key\":\"staging/' || text"
    " || '\",\"staging_sha256\":\"' || sha256(text || 's') || '\",\"valid_row_count\":' || valid_row_count || '}'"
)


@query(f"""with {_INPUTS_SQL}, items as (
  select year, month, source_date, case when k % 23 = 7 then '0.9' else '1.1.0' end as mv,
         {_IDENTITY_SQL_ITEM} as item from inputs),
months as (
  select year, month, string_agg(item, ',' order by source_date) as items,
         string_agg(distinct '"' || mv || '"', ',' order by '"' || mv || '"') as mvs from items group by 1, 2)
select year, month, sha256(
  '{{"compactor_version":"1.0.0","inputs":[' || items || '],"manifest_versions":[' || mvs || '],"month":"' || month
  || '","output_contract_version":"1.0.0","pipeline_versions":["1.0.0"],"schema_versions":["1.0.0"],'
  || '"source_name":"telemetry","writer_contract":{{"compression":"snappy","row_group_size":"65536",'
  || '"use_dictionary":"false","write_statistics":"true"}},"year":"' || year || '"}}') as run_id
from months""")
def run_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.run_identities(_selection_inputs(spark, sf_dir), "telemetry")


@query("""
select event_type, user_id, min(cast(ts as date)) as first_part, max(cast(ts as date)) as last_part,
       count(*) as row_count from events group by 1, 2
having count(distinct cast(ts as date)) > 1""")
def cross_day_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return repeats.keys_across(days, ["event_type"], "user_id", "day")


@query("""
select o_orderkey, sha256('{"manifest_version":"1.1.0","object_identity_kind":"' || kind
  || '","object_identity_value":"' || val || '","pipeline_version":"1.0.0","schema_version":"1.0.0","source_bucket":"b",'
  || '"source_key":"k/' || o_orderkey || '"}') as identity
from (select o_orderkey,
        case when o_orderkey % 3 = 0 then 'version_id' when o_orderkey % 3 = 1 then 'sha256' else 'etag' end as kind,
        case when o_orderkey % 3 = 0 then 'v' when o_orderkey % 3 = 1 then 'c' else 'e' end || o_orderkey as val
      from orders)""")
def processing_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    third = F.col("o_orderkey") % 3

    def token(prefix: str, present):
        return F.when(present, F.concat(F.lit(prefix), key)).otherwise("")

    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        identity.processing_identity(
            F.lit("b"), F.concat(F.lit("k/"), key), token("v", third == 0), token("c", third <= 1),
            token("e", F.lit(True)), F.lit("1.0.0"), F.lit(C.SCHEMA_VERSION), F.lit(C.MANIFEST_VERSION),
        ).alias("identity"),
    )
