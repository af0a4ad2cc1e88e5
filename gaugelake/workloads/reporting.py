"""Registered queries: standing reports and dataset profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake import contract as C
from gaugelake.operators import ordered, profile, quantiles, repeats, reports
from gaugelake.session import stage
from gaugelake.workloads.common import Registry, sql_seconds, table

REGISTRY = Registry()
query = REGISTRY.add

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
LINE_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _rounded(df: DataFrame, prefix: str = "") -> DataFrame:
    return df.select(
        *[
            F.round(c, 6).alias(c) if kind == "double" and c.startswith(prefix) else F.col(c)
            for c, kind in df.dtypes
        ]
    )


# --- Standing reports ----------------------------------------------------------------------


@query("""
select cast(ts as date) as source_date, count(event_id) as observation_count
from events group by 1""")
def row_counts_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.row_counts_by_date(table(spark, sf_dir, "events"), F.to_date("ts"), "event_id")


@query("select cast(l_shipdate as date) as source_date, "
       + ", ".join(f"round(avg({c}), 6) as avg_{c}" for c in LINE_MEASURES)
       + ", round(min(l_quantity), 6) as min_l_quantity, round(max(l_quantity), 6) as max_l_quantity"
       + " from lineitem group by 1")
def analogue_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        reports.analogue_aggregates(
            table(spark, sf_dir, "lineitem"), F.to_date("l_shipdate"),
            {c: F.col(c) for c in LINE_MEASURES}, ["l_quantity"],
        )
    )


@query("select cast(ts as date) as source_date, "
       + ", ".join(
           f"round(avg(case when event_type = '{t}' then 1.0 else 0.0 end), 6) as {t}_active_rate"
           for t in EVENT_TYPES)
       + " from events group by 1")
def digital_state_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = {t: F.col("event_type") == t for t in EVENT_TYPES}
    return _rounded(
        reports.digital_state_rates(table(spark, sf_dir, "events"), F.to_date("ts"), states)
    )


_GAPS_SQL = f"""
select * from (
  select event_id, cast(ts as date) as source_date, lag(ts) over (order by ts, event_id) as previous_ts, ts,
         {sql_seconds("lag(ts) over (order by ts, event_id)", "ts")} as interval_seconds
  from events)
where interval_seconds > 60"""


@query(_GAPS_SQL)
def sampling_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sampling_gap_report(table(spark, sf_dir, "events"), "ts", "event_id")


@query(f"""
select * from (
  select user_id, event_id, lag(ts) over w as previous_ts, ts,
         {sql_seconds("lag(ts) over w", "ts")} as interval_seconds
  from events window w as (partition by user_id order by ts, event_id))
where interval_seconds > 3600""")
def sampling_gaps_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.sampling_gaps(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 3600)


# --- Profile -------------------------------------------------------------------------------

_LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


def _per_column(template: str, columns: tuple[str, ...], source: str) -> str:
    return " union all ".join(
        "select '" + c + "' as column_name, " + template.replace("{c}", c) + " from " + source
        for c in columns
    )


@query(_per_column(
    "count(*) filter ({c} is null) as null_count,"
    " round(count(*) filter ({c} is null) * 100.0 / count(*), 6) as null_percentage",
    _LINE_COLUMNS, "lineitem"))
def profile_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.column_nulls(table(spark, sf_dir, "lineitem"), _LINE_COLUMNS))


@query(_per_column(
    "count(*) filter ({c} is not null and try_cast({c} as double) is null) as unreadable_count",
    ("l_returnflag", "l_quantity", "l_linestatus"),
    "(select l_returnflag, l_linestatus, cast(l_quantity as string) as l_quantity from lineitem)"))
def profile_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["l_returnflag", "l_quantity", "l_linestatus"]
    texts = table(spark, sf_dir, "lineitem").select(*[F.col(n).cast("string").alias(n) for n in names])
    return profile.unreadable_values(texts, {n: F.col(n).try_cast("double") for n in names})


@query("select"
       " (select coalesce(sum(c - 1), 0) from (select count(*) c from lineitem group by "
       + ", ".join(_LINE_COLUMNS) + " having count(*) > 1))::bigint as excess_rows, 'full_row' as key_name"
       " union all select (select coalesce(sum(c - 1), 0) from (select count(*) c from lineitem"
       " group by l_orderkey, l_linenumber having count(*) > 1))::bigint, 'index'"
       " union all select (select coalesce(sum(c - 1), 0) from (select count(*) c from lineitem"
       " group by l_shipdate having count(*) > 1))::bigint, 'timestamp'")
def profile_duplicate_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    keys = {"full_row": _LINE_COLUMNS, "index": ("l_orderkey", "l_linenumber"), "timestamp": ("l_shipdate",)}
    parts = [
        repeats.excess_rows(items, k, "excess_rows").withColumn("key_name", F.lit(name))
        for name, k in keys.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(" union all ".join(
    f"select '{c}' as column_name, {q} as prob, round(quantile_cont({c}, {q}), 6) as quantile from lineitem"
    for c in LINE_MEASURES for q in C.PROFILE_QUANTILES))
def profile_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quantiles.column_quantiles(table(spark, sf_dir, "lineitem"), LINE_MEASURES, C.PROFILE_QUANTILES))


@query(_per_column(
    "round(min({c}), 6) as min_value, round(max({c}), 6) as max_value, round(avg({c}), 6) as mean_value",
    LINE_MEASURES, "lineitem"))
def profile_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.numeric_statistics(table(spark, sf_dir, "lineitem"), LINE_MEASURES))


_FLAGS_SQL = ("(select " + ", ".join(
    f"case when event_type = '{t}' then 1.0::double else 0.0::double end as {t}" for t in EVENT_TYPES)
    + ", (user_id % 3)::double as user_mod from events)")
_FLAG_COLUMNS = (*EVENT_TYPES, "user_mod")


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        *[F.when(F.col("event_type") == t, 1.0).otherwise(0.0).alias(t) for t in EVENT_TYPES],
        (F.col("user_id") % 3).cast("double").alias("user_mod"),
    )


@query(" union all ".join(
    f"select '{c}' as column_name, {c} as value, count(*) as row_count from {_FLAGS_SQL} group by {c}"
    for c in _FLAG_COLUMNS))
def profile_digital_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.value_counts(_flags(spark, sf_dir), _FLAG_COLUMNS)


@query(" union all ".join(
    f"select '{c}' as column_name, case when bool_and(coalesce({c} in (0, 1), false)) then 'BOOLEAN'"
    f" else 'DOUBLE' end as recommended_type from {_FLAGS_SQL}" for c in _FLAG_COLUMNS))
def profile_recommended_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.recommended_types(quantiles.value_counts(_flags(spark, sf_dir), _FLAG_COLUMNS))


_CARDINALITY_COLUMNS = (
    "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
)


@query(" union all ".join(
    f"select '{c}' as column_name, count(v) as distinct_values,"
    " round(max(n) * 100.0 / sum(n), 6) as dominant_percentage, count(v) <= 1 as is_constant,"
    " max(n) / sum(n) >= 0.99 as is_near_constant"
    f" from (select {c} as v, count(*) as n from lineitem group by {c})"
    for c in _CARDINALITY_COLUMNS))
def profile_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = quantiles.value_counts(table(spark, sf_dir, "lineitem"), _CARDINALITY_COLUMNS, "string")
    return _rounded(profile.cardinality(counts))


@query(" union all ".join(
    f"select '{c}' as column_name, count(*) filter (not isfinite({c})) as non_finite_count,"
    f" count(*) filter ({c} < 0) as negative_count from {t}"
    for c, t in (("c_acctbal", "customer"),)))
def profile_validity_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.numeric_review(table(spark, sf_dir, "customer"), ["c_acctbal"])


@query("""
select min(ts) as min_timestamp, max(ts) as max_timestamp,
       count(*) filter (ts < previous) as out_of_order_transitions,
       count(*) filter (ts = previous) as adjacent_duplicate_transitions
from (select o_orderdate as ts, lag(o_orderdate) over (order by o_orderkey) as previous from orders)""")
def profile_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.transitions(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate")


_EVENT_DELTAS_SQL = f"""
deltas as (
  select event_id, ts, {sql_seconds("lag(ts) over (order by event_id)", "ts")} as delta_seconds from events)"""
_LIMIT_SQL = """
limits as (
  select greatest(60, 2 * delta_seconds) as gap_limit from deltas where delta_seconds is not null
  group by delta_seconds order by count(*) desc, delta_seconds limit 1)"""


@query(f"""with {_EVENT_DELTAS_SQL}
select delta_seconds as seconds, count(*) as interval_count from deltas
where delta_seconds is not null group by 1""")
def profile_interval_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.interval_distribution(table(spark, sf_dir, "events"), "event_id", "ts")


@query(f"""with {_EVENT_DELTAS_SQL}
select delta_seconds as seconds, count(*) as interval_count from deltas where delta_seconds is not null
group by 1 order by count(*) desc, delta_seconds limit 1""")
def profile_modal_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.modal_interval(
        profile.interval_distribution(table(spark, sf_dir, "events"), "event_id", "ts")
    )


@query(f"""with {_EVENT_DELTAS_SQL}, {_LIMIT_SQL}
select count(*) as gap_count, min(delta_seconds) as min_seconds, max(delta_seconds) as max_seconds,
       sum(delta_seconds)::bigint as total_seconds, median(delta_seconds)::double as median_seconds
from deltas, limits where delta_seconds > gap_limit""")
def profile_gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stage(
        profile.interval_distribution(table(spark, sf_dir, "events"), "event_id", "ts"), "intervals"
    )
    limit = profile.gap_limit(counts)
    gaps = counts.where(F.col("seconds") > limit).withColumn("scope", F.lit("all"))
    median = quantiles.weighted_quantiles(gaps, "scope", "seconds", "interval_count", [0.5])
    return profile.gap_summary(counts, limit, median)


@query(f"""with {_EVENT_DELTAS_SQL}, {_LIMIT_SQL}
select event_id, ts, delta_seconds from deltas, limits where delta_seconds > gap_limit
order by delta_seconds desc, ts limit 20""")
def profile_largest_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    limit = profile.gap_limit(profile.interval_distribution(events, "event_id", "ts"))
    return profile.largest_gaps(profile.file_order_deltas(events, "event_id", "ts"), "ts", limit)


_DAYS_SQL = "days as (select cast(ts as date) as day, count(*) as day_rows from events group by 1)"


@query(f"""with {_DAYS_SQL}
select count(*) as partition_count, min(day_rows) as minimum_rows, floor(median(day_rows))::bigint as median_rows,
       max(day_rows) as maximum_rows, arg_max(day, (day_rows, day)) as largest_day from days""")
def profile_daily_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.daily_statistics(profile.daily_counts(table(spark, sf_dir, "events"), "ts"))


@query(f"""with {_DAYS_SQL},
ranked as (select *, row_number() over (order by day_rows, day) as rk, count(*) over () as n from days),
ends as (select min(day) filter (rk = 1) as small_day, min(day) filter (rk = n) as large_day,
                min(day_rows) filter (rk = n // 2 + 1) as target from ranked)
select 'small' as label, day, day_rows from ranked where rk = 1
union all select 'largest', day, day_rows from ranked where rk = n
union all select * from (
  select 'median', day, day_rows from ranked, ends where day <> small_day and day <> large_day
  order by abs(day_rows - target), day limit 1)""")
def profile_representative_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.representative_days(profile.daily_counts(table(spark, sf_dir, "events"), "ts"))


@query("""
select cast(o_orderdate as date) as day, count(*) as day_rows,
       cast(round_even(218300507::double * count(*) / (select count(*) from orders), 0) as bigint) as estimated_bytes
from orders group by 1""")
def profile_partition_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    total = orders.agg(F.count(F.lit(1)).alias("total_rows"), F.lit(1).alias("row"))
    days = profile.daily_counts(orders, "o_orderdate").withColumn("row", F.lit(1))
    # The total is a single row.
    return days.join(F.broadcast(total), "row").select(
        "day", "day_rows",
        profile.estimated_bytes(F.lit(218300507.0), F.col("total_rows"), F.col("day_rows")).alias(
            "estimated_bytes"
        ),
    )
