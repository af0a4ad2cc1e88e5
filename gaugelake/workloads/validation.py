"""Registered queries: raw scan, row rules, batch metrics and daily splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake import contract as C
from gaugelake.functions import parsing
from gaugelake.operators import metrics, ordered, profile, resume
from gaugelake.plans import split, transform
from gaugelake.session import new_folder, stage
from gaugelake.sources import raw, tables
from gaugelake.workloads import feed
from gaugelake.workloads.common import Registry, sql_seconds, table

REGISTRY = Registry()
query = REGISTRY.add

_VERSION = "1.0.0"
_AT = "2024-02-01T00:00:00Z"


# --- Raw scan and routing ------------------------------------------------------------------


@query(feed.FEED_SQL + """
select object_date, row_no as source_row_number, original_record, n_fields as field_count from lines""")
def raw_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = stage(raw.checked_lines(feed.raw_objects(spark, sf_dir)), "scan")
    rows = raw.with_row_numbers(lines, stage(raw.block_table(lines), "blocks"))
    return rows.where(F.col("source_row_number") > 0).select(
        F.col("source_date").alias("object_date"), "source_row_number", "original_record",
        F.size(parsing.csv_fields(F.col("line"))).alias("field_count"),
    )


_BROKEN = ("case when event_id % 41 = 5 then '\"' || f7 || chr(13) || chr(10) || '\"' "
           "when event_id % 43 = 7 then '\"a \"\"b\"\",' || chr(10) || chr(10) || f7 || '\"' else f7 end")
_BROKEN_LINE = " || ',' || ".join(_BROKEN if i == 7 else f"f{i}" for i in range(C.FIELD_COUNT))
_CLEAN_SQL = ", ".join(f"{text} as f{i}" for i, text in enumerate(feed.CLEAN_FIELDS))


@query(f"""
with feed as (
  select event_id, cast(ts as date) as object_date, {_CLEAN_SQL},
         row_number() over (partition by cast(ts as date) order by event_id) as source_row_number from events),
told as (
  select *, event_id % 43 = 7 and event_id % 41 <> 5 as unread, {_BROKEN_LINE} || chr(13) || chr(10) as record,
         count(*) over (partition by object_date, f1) > 1 as same_time from feed)
select object_date, source_row_number, event_id as record_index,
       case when unread then 'a "b",' || chr(10) || chr(10) || f7
            when same_time then f7 || case when event_id % 41 = 5 then chr(13) || chr(10) else '' end end as rejected_value,
       case when unread or same_time then record end as original_record
from told""")
def quoted_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of objects in which quoted fields hold line ends: numbered, judged and kept as written."""
    folder = new_folder(spark, "raw")
    named = table(spark, sf_dir, "events").selectExpr(
        "event_id", "to_date(ts) as route_date", *[f"{text} as f{i}" for i, text in enumerate(feed.CLEAN_FIELDS)])
    written = named.selectExpr("event_id + 1 as source_row_number", f"{_BROKEN_LINE} || '\\r' as line", "route_date")
    split.write_daily_objects(written, folder)
    return transform.validate(raw.read_lines(spark, folder)).rows.select(
        F.col("source_date").alias("object_date"), "source_row_number", "record_index",
        F.get("fields", F.lit(7)).alias("rejected_value"), "original_record",
    )


def _drifting_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One header per event day; every seventh day renames a column."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("route_date")).distinct()
    renamed = split.HEADER_LINE.replace("Motor_current", "Motor_amps")
    return days.withColumn(
        "line", F.when(F.dayofmonth("route_date") % 7 == 3, renamed).otherwise(split.HEADER_LINE)
    )


@query("""
select cast(ts as date) as object_date, count(*) as input_row_count,
       day(cast(ts as date)) % 7 = 3 as schema_drift, false as empty_input,
       true as is_utf8, true as is_well_formed
from events group by 1""")
def object_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = _drifting_headers(spark, sf_dir)
    lines = stage(raw.checked_lines(feed.raw_objects(spark, sf_dir, headers)), "scan")
    return raw.object_table(raw.block_table(lines)).select(
        F.col("source_date").alias("object_date"), "input_row_count", "schema_drift",
        "empty_input", "is_utf8", "is_well_formed",
    )


@query("""
select cast(ts as date) as object_date, count(*) as input_row_count,
       case when day(cast(ts as date)) % 7 = 3 then 'BATCH_SCHEMA_DRIFT' else '' end as error_rule_ids,
       day(cast(ts as date)) % 7 <> 3 as reconciliation_applicable
from events group by 1""")
def batch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = _drifting_headers(spark, sf_dir)
    batch = transform.validate(feed.raw_objects(spark, sf_dir, headers)).batch()
    return batch.select(
        F.col("source_date").alias("object_date"), "input_row_count",
        F.array_join("batch_errors.rule_id", "|").alias("error_rule_ids"),
        "reconciliation_applicable",
    )


@query("""
select cast(ts as date) as object_date, count(*) as row_count,
       sum(length(cast(event_id as string)))::bigint as index_digits
from events where cast(ts as date) between date '2024-01-05' and date '2024-01-25' group by 1""")
def daily_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A monolithic source split into daily objects inside an inclusive window, read back."""
    from datetime import date

    source, folder = new_folder(spark, "source"), new_folder(spark, "raw")
    clean = feed.feed_lines(spark, sf_dir, feed.CLEAN_FIELDS)
    header = spark.range(1).select(
        F.lit(0).cast("long").alias("source_row_number"), F.lit(split.HEADER_LINE).alias("line")
    )
    (
        clean.select("source_row_number", "line").unionByName(header)
        .repartitionByRange("source_row_number").sortWithinPartitions("source_row_number")
        .select("line").write.text(source)
    )
    split.split_source(spark, source, folder, date(2024, 1, 5), date(2024, 1, 25))
    lines = stage(raw.checked_lines(raw.read_lines(spark, folder)), "scan")
    rows = raw.with_row_numbers(lines, stage(raw.block_table(lines), "blocks"))
    fields = parsing.csv_fields(F.col("line"))
    return rows.where(F.col("source_row_number") > 0).groupBy(
        F.col("source_date").alias("object_date")
    ).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(F.length(F.get(fields, F.lit(0)))).alias("index_digits"),
    )


@query("""
select source_row_number, route_date, previous_route_date from (
  select o_orderkey as source_row_number, cast(o_orderdate as date) as route_date,
         lag(cast(o_orderdate as date)) over (order by o_orderkey) as previous_route_date from orders)
where route_date < previous_route_date""")
def out_of_order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("source_row_number"), F.to_date("o_orderdate").alias("route_date")
    )
    return split.out_of_order_rows(rows)


# Few dense stretches of keys, spread over most of the 64-bit range.
_SPREAD = "event_id % 97 * 47000000000000000 + event_id * 1009"


@query(f"""
with k as (select *, {_SPREAD} as k from events),
p as (select event_type, lag(event_type) over (order by k) as before, k - lag(k) over (order by k) as step from k)
select before as previous_type, event_type, count(*) as transitions, max(step) as longest_step from p group by all""")
def sparse_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows what, in the order of a sparse key, without groups."""
    rows = table(spark, sf_dir, "events").selectExpr("event_type", f"{_SPREAD} as k")
    lagged = ordered.sliced_lag(rows, [], "k", ["event_type", "k"], width=None, rows=500)
    step = F.col("k") - F.col("previous_k")
    return lagged.groupBy(F.col("previous_event_type").alias("previous_type"), "event_type").agg(
        F.count(F.lit(1)).alias("transitions"), F.max(step).alias("longest_step"))


_KEYS = ("case when event_id % 5 = 0 then 'raw/source=t/source_date=' || substring(cast(ts as string), 1, 10)"
         " || '/data.csv' when event_id % 5 = 1 then 'raw/source=t/source_date=2024-02-31/data.csv'"
         " when event_id % 5 = 2 then 'staging/source=t/day=01/data.parquet'"
         " when event_id % 5 = 3 then 'raw/source=t/source_date=2024-1-5/data.csv'"
         " else 'raw/source=t/source_date=' || substring(cast(ts as string), 1, 10) || '/x/data.csv' end")


@query(f"""
select source_date, count(*) as object_count from (
  select try_cast(nullif(regexp_extract(k, '/source_date=([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})/[^/]+$', 1), '') as date)
         as source_date from (select {_KEYS} as k from events)) group by 1""")
def object_key_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "events").select(F.expr(_KEYS).alias("k"))
    return keys.groupBy(raw.source_date_of(F.col("k")).alias("source_date")).agg(
        F.count(F.lit(1)).alias("object_count")
    )


@query("""
select lang, count(*) as document_count,
       count(*) filter (regexp_matches(text, '(^|["''\\s])[A-Za-z]:[\\\\/]')) as path_document_count
from documents group by 1""")
def path_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("document_count"),
        F.count_if(resume.has_absolute_path(F.col("text"))).alias("path_document_count"),
    )


_VARCHAR_SQL = {
    "record_index": "try_cast(regexp_replace(trim(f0), '^[+]', '') as bigint)",
    "timestamp": "case when length(f1) = 19 and substring(f1, 11, 1) = ' ' and substring(f1, 12, 2) < '24'"
                 " then try_cast(f1 as timestamp) end",
    "TP2": "try_cast(trim(f2) as double)",
    "Motor_current": "try_cast(trim(f8) as double)",
    "DV_eletric": "try_cast(trim(f10) as double)",
}


@query(feed.FEED_SQL + " " + " union all ".join(
    f"select '{n}' as column_name, count(*) filter (({e}) is null) as null_count,"
    f" round(count(*) filter (({e}) is null) * 100.0 / count(*), 6) as null_percentage from feed"
    for n, e in _VARCHAR_SQL.items()))
def varchar_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tolerant all-text scan of the whole feed with every field present, profiled for nulls."""
    folder = new_folder(spark, "varchar")
    fields = table(spark, sf_dir, "events").selectExpr(
        *[f"{text} as f{i}" for i, text in enumerate(feed.DIRTY_FIELDS)]
    )
    named = fields.toDF("_c0", *C.SOURCE_HEADER[1:])
    named.write.option("header", "true").option("emptyValue", "").csv(folder)
    texts = tables.read_varchar_csv(spark, folder)
    nulls = profile.column_nulls(tables.tolerant_types(texts), list(_VARCHAR_SQL))
    return nulls.withColumn("null_percentage", F.round("null_percentage", 6))


# --- Row rules -----------------------------------------------------------------------------


@query(feed.JUDGED_SQL + """
select object_date, row_no as source_row_number, rule_ids, reasons from judged where rule_ids <> ''""")
def row_rule_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed.by_date(feed.validated(spark, sf_dir).rows)
    return rows.where(F.size("issues") > 0).select(
        "object_date", "source_row_number",
        F.array_join("issues.rule_id", "|").alias("rule_ids"),
        F.array_join("issues.reason", "|").alias("reasons"),
    )


@query(feed.JUDGED_SQL + " select record_index, event_ts as event_timestamp_local, "
       + ", ".join(f"n{i + 2} as {n}" for i, n in enumerate(C.ANALOGUE)) + ", "
       + ", ".join(f"n{i + 9} = 1 as {n}" for i, n in enumerate(C.DIGITAL))
       + ", cast(event_ts as date) as source_date, 'unknown' as event_timestamp_timezone_status"
       + " from judged where rule_ids = ''")
def valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.validated(spark, sf_dir).valid()


_FIELD_LIST = "[" + ", ".join(f"f{i}" for i in range(16)) + "]"


@query(feed.JUDGED_SQL + f"""
select original_record, row_no as source_row_number, rule_ids, object_date as expected_source_date,
       case when n_fields = 0 then '' when n_fields = 16 then array_to_string({_FIELD_LIST}, '|')
            when n_fields = 18 then array_to_string({_FIELD_LIST}, '|') || '|' || f16 || '|9'
            else array_to_string({_FIELD_LIST}, '|') || '|' || f16 end as field_values,
       '{_VERSION}' as pipeline_version
from judged where rule_ids <> ''""")
def quarantine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = feed.validated(spark, sf_dir).quarantine(_VERSION, F.lit(_AT).cast("timestamp"))
    return rejected.select(
        "original_record", "source_row_number", F.array_join("rule_ids", "|").alias("rule_ids"),
        "expected_source_date", F.array_join("original_field_values", "|").alias("field_values"),
        "pipeline_version",
    )


@query(feed.JUDGED_SQL + """
select object_date, rule_id, count(*) as rule_count
from (select object_date, unnest(string_split(rule_ids, '|')) as rule_id from judged where rule_ids <> '')
group by 1, 2""")
def quarantine_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.by_date(feed.validated(spark, sf_dir).rule_counts())


# --- Batch metrics -------------------------------------------------------------------------

_DELTAS_SQL = f"""
deltas as (
  select object_date, {sql_seconds("lag(event_ts) over w", "event_ts")} as seconds
  from judged where event_ts is not null window w as (partition by object_date order by row_no)),
steps as (
  select object_date, count(*) filter (seconds < 0) as out_of_order_transition_count,
         count(*) filter (seconds > 0 and seconds not between 9 and 13) as abnormal_sampling_interval_count,
         count(*) filter (seconds > 60) as significant_gap_count,
         max(seconds) filter (seconds > 60) as maximum_gap_seconds
  from deltas group by 1),
counts as (
  select object_date, count(*) as input_row_count, count(*) filter (rule_ids = '') as valid_row_count,
         count(*) filter (rule_ids <> '') as quarantine_row_count, count(event_ts) as parseable_timestamp_count,
         arg_min(event_ts, row_no) filter (rule_ids = '') as first_valid_event_timestamp_local,
         arg_max(event_ts, row_no) filter (rule_ids = '') as last_valid_event_timestamp_local
  from judged group by 1),
batch as (select * from counts join steps using (object_date))"""
BATCH_SQL = feed.JUDGED_SQL + "," + _DELTAS_SQL


@query(BATCH_SQL + """
select object_date, seconds, count(*) as interval_count from deltas where seconds is not null group by 1, 2""")
def interval_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.by_date(feed.validated(spark, sf_dir).intervals)


@query(BATCH_SQL + """
select *, input_row_count < 3718 as unexpectedly_low_daily_row_count, false as schema_drift,
       false as empty_input from batch""")
def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = feed.by_date(feed.validated(spark, sf_dir).batch())
    return batch.select(
        "object_date", "input_row_count", "valid_row_count", "quarantine_row_count",
        "parseable_timestamp_count", "out_of_order_transition_count",
        "abnormal_sampling_interval_count", "significant_gap_count", "maximum_gap_seconds",
        "unexpectedly_low_daily_row_count", "schema_drift", "empty_input",
        "first_valid_event_timestamp_local", "last_valid_event_timestamp_local",
    )


@query(BATCH_SQL + " " + " union all ".join(
    f"select object_date, '{rule}' as rule_id, '{C.WARNING_TEXT[rule]}' as message, {n} as observed_count"
    f" from batch where {cond}"
    for rule, n, cond in (
        (C.TIMESTAMP_ORDER, "out_of_order_transition_count", "out_of_order_transition_count > 0"),
        (C.SAMPLING_INTERVAL, "abnormal_sampling_interval_count", "abnormal_sampling_interval_count > 0"),
        (C.SIGNIFICANT_GAP, "significant_gap_count", "significant_gap_count > 0"),
        (C.LOW_ROW_COUNT, "input_row_count", "input_row_count < 3718"))))
def batch_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = feed.by_date(feed.validated(spark, sf_dir).batch())
    return batch.select("object_date", F.explode("batch_warnings").alias("w")).select(
        "object_date", "w.*"
    )


@query(BATCH_SQL + """
select object_date, input_row_count, valid_row_count, quarantine_row_count,
       valid_row_count + quarantine_row_count as accounted_row_count,
       input_row_count = valid_row_count + quarantine_row_count as reconciliation_matches,
       true as reconciliation_applicable from batch""")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = feed.by_date(feed.validated(spark, sf_dir).batch())
    return batch.select(
        "object_date", "input_row_count", "valid_row_count", "quarantine_row_count",
        "accounted_row_count", "reconciliation_matches", "reconciliation_applicable",
    )


def _metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = feed.by_date(feed.validated(spark, sf_dir).batch())
    return metrics.run_metric_rows(
        batch.withColumn("processed_at", F.col("object_date").cast("timestamp_ntz")), "processed_at"
    )


@query(BATCH_SQL + " " + " union all ".join(
    f"select cast(object_date as timestamp) as processed_at, '{n}' as metric_name,"
    f" round(({e})::double, 6) as metric_value from batch"
    for n, e in (
        ("InputRows", "input_row_count"), ("ValidRows", "valid_row_count"),
        ("QuarantineRows", "quarantine_row_count"),
        ("QuarantineRate", "quarantine_row_count / input_row_count * 100"),
        ("ObjectsProcessed", "1"), ("ObjectsFailed", "0"), ("ReconciliationFailures", "0"))))
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric_rows(spark, sf_dir).withColumn("metric_value", F.round("metric_value", 6))


@query(BATCH_SQL + """
select cast(object_date as timestamp) as period_start, 'QuarantineRate' as metric_name,
       round(quarantine_row_count / input_row_count * 100, 6)::double as observed_value
from batch where quarantine_row_count / input_row_count * 100 > 5""")
def metric_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.alarms(_metric_rows(spark, sf_dir), "processed_at").withColumn(
        "observed_value", F.round("observed_value", 6)
    )
