"""A raw telemetry feed derived from every row of ``events``, with realistic defects.

The field expressions use the SQL that Spark and the oracle engine share, so the very same
text defines the feed on both sides. Defects depend on ``event_id`` and leave no row out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake import contract as C
from gaugelake.plans import split, transform
from gaugelake.session import new_folder
from gaugelake.sources import raw
from gaugelake.workloads.common import table

_ID = "cast(event_id as string)"
_TS = "substring(cast(ts as string), 1, 19)"
_DAY = "substring(cast(ts as string), 1, 10)"
_VALUE = "cast(value as string)"


def _cases(default: str, *cases: tuple[int, int, str]) -> str:
    whens = " ".join(f"when event_id % {m} = {r} then {text}" for m, r, text in cases)
    return f"case {whens} else {default} end" if cases else default


def _flag(condition: str) -> str:
    return f"case when {condition} then '1.0' else '0.0' end"


CLEAN_FIELDS = [
    _ID,
    _TS,
    _VALUE,
    "cast(user_id as string) || '.5'",
    _VALUE,
    f"'-' || {_VALUE}",
    _VALUE,
    "'1e' || cast(user_id % 5 as string)",
    _VALUE,
    *[_flag(f"event_type = '{t}'") for t in ("click", "error", "purchase", "signup", "view")],
    _flag("user_id % 2 = 1"),
    "'1.0'",
    "'0.0'",
]

_DEFECTS: dict[int, list[tuple[int, int, str]]] = {
    0: [
        (67, 13, "cast(event_id - 1 as string)"),
        (131, 17, f"'x' || {_ID}"),
        (137, 19, f"' +' || {_ID} || ' '"),
    ],
    1: [
        (83, 11, f"replace({_TS}, ' ', 'T') || 'Z'"),
        (61, 17, "substring(cast(ts + interval '1' day as string), 1, 19)"),
        (59, 19, f"{_DAY} || ' 00:00:00'"),
        (151, 21, f"{_DAY} || ' 24:00:00'"),
        (157, 23, "''"),
    ],
    2: [(79, 3, "'NaN'"), (163, 5, "'-Infinity'"), (167, 7, "'inf'")],
    4: [(89, 7, "''")],
    8: [(73, 9, "'bad'"), (47, 29, "'1,5'")],
    10: [(71, 2, "'2.0'")],
    11: [(173, 4, "'NaN'")],
    15: [(43, 31, "' 1.0 '")],
    16: [(179, 6, "'   '")],
}

DIRTY_FIELDS = [_cases(text, *_DEFECTS.get(i, [])) for i, text in enumerate(CLEAN_FIELDS)]

# What is written for each parsed value: one field is quoted because it holds a comma.
_QUOTED = "case when event_id % 47 = 29 and event_id % 73 <> 9 then '\"' || f8 || '\"' else f8 end"
_RAW = [f"f{i}" if i != 8 else _QUOTED for i in range(C.FIELD_COUNT)]
_WHOLE_LINE = " || ',' || ".join(_RAW)
_SHORT_LINE = " || ',' || ".join(_RAW[:-1])
LINE = (
    f"case when event_id % 53 = 23 then '' when event_id % 97 = 5 then {_SHORT_LINE} "
    f"when event_id % 181 = 8 then {_WHOLE_LINE} || ',9' else {_WHOLE_LINE} end"
)
FIELD_TOTAL = (
    "case when event_id % 53 = 23 then 0 when event_id % 97 = 5 then 16 "
    "when event_id % 181 = 8 then 18 else 17 end"
)


def _columns(fields: list[str]) -> list[str]:
    return [f"{text} as f{i}" for i, text in enumerate(fields)]


def feed_lines(spark: SparkSession, sf_dir: str, fields: list[str] = DIRTY_FIELDS) -> DataFrame:
    """(source_row_number, line, route_date) for every event, in ``event_id`` order."""
    named = table(spark, sf_dir, "events").selectExpr(
        "event_id", "to_date(ts) as route_date", *_columns(fields)
    )
    line = LINE if fields is DIRTY_FIELDS else _WHOLE_LINE.replace(_QUOTED, "f8")
    return named.selectExpr(
        "event_id + 1 as source_row_number", f"{line} || '\\r' as line", "route_date"
    )


def raw_objects(spark: SparkSession, sf_dir: str, header: DataFrame | str | None = None) -> DataFrame:
    """The dirty feed written as raw daily objects and scanned back."""
    folder = new_folder(spark, "raw")
    split.write_daily_objects(
        feed_lines(spark, sf_dir), folder, header=header if header is not None else split.HEADER_LINE
    )
    return raw.read_lines(spark, folder)


def validated(spark: SparkSession, sf_dir: str) -> transform.Validated:
    return transform.validate(raw_objects(spark, sf_dir))


def by_date(frame: DataFrame) -> DataFrame:
    """Replace the object path, which differs per run, by the date it names."""
    dated = frame.withColumn(
        "object_date", raw.source_date_of(F.concat("object_key", F.lit("/part")))
    )
    return dated.drop("object_key")


# --- The same feed and its rules as SQL for the oracle engine. -----------------------------

_NAMES = C.SOURCE_HEADER
_N_ANALOGUE = range(2, 9)
_N_DIGITAL = range(9, 17)


def _shown(i: int) -> str:
    return C.BLANK_HEADER_LABEL if _NAMES[i] == "" else _NAMES[i]


def _list_sql(conditions: list[tuple[int, str]]) -> str:
    parts = ", ".join(f"case when {cond} then '{_shown(i)}' end" for i, cond in conditions)
    return f"concat_ws(', ', {parts})"


def _feed_sql() -> str:
    fields = ", ".join(_columns(DIRTY_FIELDS))
    return f"""
feed as (
  select event_id, cast(ts as date) as object_date, {fields},
         row_number() over (partition by cast(ts as date) order by event_id) as row_no,
         {FIELD_TOTAL} as n_fields
  from events),
lines as (select *, {LINE} || chr(13) || chr(10) as original_record from feed)"""


def _parsed_sql() -> str:
    number = {i: f"try_cast(trim(f{i}) as double)" for i in range(2, 17)}
    doubles = ", ".join(f"{number[i]} as n{i}" for i in number)
    blanks = ", ".join(f"trim(f{i}) = '' as b{i}" for i in range(17))
    return f"""
typed as (
  select *, n_fields = 17 as whole, {blanks}, {doubles},
    try_cast(regexp_replace(trim(f0), '^[+]', '') as bigint) as ix,
    case when regexp_full_match(f1, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}')
         and substring(f1, 12, 2) < '24' then try_cast(f1 as timestamp) end as ets
  from lines),
parsed as (
  select *, case when whole then ix end as record_index,
         case when whole then ets end as event_ts from typed),
counted as (
  select *,
    case when record_index is not null
         then count(*) over (partition by object_date, record_index) else 0 end as ix_count,
    case when event_ts is not null
         then count(*) over (partition by object_date, event_ts) else 0 end as ts_count
  from parsed)"""


def _judged_sql() -> str:
    missing = _list_sql([(i, f"b{i}") for i in range(17)])
    unparsed = _list_sql(
        [(0, "not b0 and ix is null")] + [(i, f"not b{i} and n{i} is null") for i in range(2, 17)]
    )
    nonfinite = _list_sql([(i, f"not isfinite(n{i})") for i in _N_ANALOGUE])
    domain = _list_sql([(i, f"(not isfinite(n{i}) or n{i} not in (0, 1))") for i in _N_DIGITAL])
    rules = [
        (C.COLUMN_COUNT, "not whole",
         "'Expected 17 columns but found ' || n_fields || '.'"),
        (C.TIMESTAMP_PARSE, "whole and not b1 and ets is null",
         "'timestamp is not parseable as YYYY-MM-DD HH:MM:SS.'"),
        (C.NUMERIC_PARSE, f"whole and {unparsed} <> ''",
         f"'Unparseable numeric value(s): ' || {unparsed} || '.'"),
        (C.REQUIRED_MISSING, f"whole and {missing} <> ''",
         f"'Missing required value(s): ' || {missing} || '.'"),
        (C.ANALOG_NONFINITE, f"whole and {nonfinite} <> ''",
         f"'NaN or infinity in analog field(s): ' || {nonfinite} || '.'"),
        (C.DIGITAL_DOMAIN, f"whole and {domain} <> ''",
         f"'Digital value outside numeric 0/1 domain: ' || {domain} || '.'"),
        (C.SOURCE_DATE_MISMATCH, "cast(event_ts as date) <> object_date",
         "'Timestamp date ' || cast(event_ts as date) || ' does not match expected source_date '"
         " || object_date || '.'"),
        (C.DUPLICATE_RECORD_INDEX, "ix_count > 1",
         "'record_index ' || record_index || ' occurs more than once in the input object.'"),
        (C.DUPLICATE_TIMESTAMP, "ts_count > 1",
         "'timestamp ' || strftime(event_ts, '%Y-%m-%d %H:%M:%S')"
         " || ' occurs more than once in the input object.'"),
    ]
    ids = ", ".join(f"case when {cond} then '{rule}' end" for rule, cond, _ in rules)
    reasons = ", ".join(f"case when {cond} then {reason} end" for _, cond, reason in rules)
    return f"""
judged as (
  select *, concat_ws('|', {ids}) as rule_ids, concat_ws('|', {reasons}) as reasons from counted)"""


FEED_SQL = "with " + _feed_sql()
JUDGED_SQL = ",".join(["with " + _feed_sql(), _parsed_sql(), _judged_sql()])
