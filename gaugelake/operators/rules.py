"""Row rules as Column expressions: one pass over the fields, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugelake import contract as C
from gaugelake.functions import parsing


# A line of this shape has every field present and numeric, finite analogue values and digital
# values in the domain. Most lines do, and skip the rule-by-rule work.
PLAIN_LINE = (
    r"^[+-]?\d{1,18},\d{4}-\d\d-\d\d \d\d:\d\d:\d\d"
    rf"(?:,-?\d{{1,15}}(?:\.\d{{1,15}})?(?:[eE][+-]?\d\d?)?){{{len(C.ANALOGUE_FIELDS)}}}"
    rf"(?:,[01](?:\.0{{1,15}})?){{{len(C.DIGITAL_FIELDS)}}}\r?$"
)
_NUMBERS = C.ANALOGUE + C.DIGITAL


def _names(names: tuple[str, ...]) -> Column:
    shown = [C.BLANK_HEADER_LABEL if name == C.INDEX_FIELD else name for name in names]
    return F.array(*[F.lit(name) for name in shown])


def _listed(names: tuple[str, ...], failed: Column) -> Column:
    """Names whose flag is set, comma-separated."""
    picked = F.zip_with(_names(names), failed, lambda name, bad: F.when(bad, name))
    return F.array_join(F.array_compact(picked), ", ")


def _issue(rule_id: str, failed: Column, reason: Column) -> Column:
    return F.when(failed, F.struct(F.lit(rule_id).alias("rule_id"), reason.alias("reason")))


def _issues(*candidates: Column) -> Column:
    return F.array_compact(F.array(*candidates)).cast(C.ISSUE_TYPE)


def parse_values(df: DataFrame) -> DataFrame:
    """Typed values from ``line``: index, timestamp and ``numbers``, null where unparseable.

    Nothing is typed when the field count is wrong, so later rules see only nulls there.
    """
    texts = F.slice("fields", 3, len(_NUMBERS))
    whole = F.size("fields") == C.FIELD_COUNT
    index_text, time_text = F.get("fields", F.lit(0)), F.get("fields", F.lit(1))
    fielded = df.select(
        "*",
        parsing.csv_fields(F.col("line")).alias("fields"),
        F.col("line").rlike(PLAIN_LINE).alias("is_plain"),
    )
    return fielded.select(
        "*",
        F.when(F.col("is_plain"), index_text.try_cast("bigint"))
        .when(whole, parsing.record_index(index_text)).alias("record_index"),
        F.when(whole, parsing.strict_timestamp(time_text)).alias("event_timestamp_local"),
        F.when(F.col("is_plain"), texts.try_cast("array<double>"))
        .when(whole, F.transform(texts, parsing.numeric)).alias("numbers"),
    )


def with_row_issues(df: DataFrame) -> DataFrame:
    """Add ``issues``: failed single-row rules in contract order, each with its reason.

    Rules that need the object's date or its other rows come later in the contract order;
    ``with_object_issues`` appends them.
    """
    whole = F.size("fields") == C.FIELD_COUNT
    ts, numbers, blank = F.col("event_timestamp_local"), F.col("numbers"), F.col("blank")
    n_analogue = len(C.ANALOGUE_FIELDS)
    judged = whole & ~(F.col("is_plain") & ts.isNotNull())

    def unread(is_blank: Column, value: Column) -> Column:
        return ~is_blank & value.isNull()

    unread_flags = F.concat(
        F.array(unread(F.get(blank, F.lit(0)), F.col("record_index"))),
        F.zip_with(F.slice(blank, 3, len(_NUMBERS)), numbers, unread),
    )
    missing = _listed(C.SOURCE_HEADER, blank)
    unparsed = _listed((C.INDEX_FIELD, *C.ANALOGUE_FIELDS, *C.DIGITAL_FIELDS), unread_flags)
    nonfinite = _listed(
        C.ANALOGUE_FIELDS,
        F.transform(F.slice(numbers, 1, n_analogue), lambda x: ~parsing.is_finite(x)),
    )
    off_domain = _listed(
        C.DIGITAL_FIELDS,
        F.transform(
            F.slice(numbers, n_analogue + 1, len(C.DIGITAL_FIELDS)), lambda x: ~x.isin(0.0, 1.0)
        ),
    )

    # Every list of names is made once a row, and only for rows that are not plain.
    lists = {"missing": missing, "unparsed": unparsed, "nonfinite": nonfinite, "off_domain": off_domain}
    listed = (
        df.withColumn("blank", F.when(judged, F.transform("fields", parsing.is_blank)))
        .select("*", *[F.when(judged, names).alias(f"{name}_names") for name, names in lists.items()])
    )
    missing, unparsed, nonfinite, off_domain = (F.col(f"{name}_names") for name in lists)

    # Reasons are fixed texts of the contract.
    checked = _issues(
        _issue(
            C.TIMESTAMP_PARSE, ~F.get(blank, F.lit(1)) & ts.isNull(),
            F.lit("timestamp is not parseable as YYYY-MM-DD HH:MM:SS."),
        ),
        _issue(
            C.NUMERIC_PARSE, unparsed != "",
            F.concat(F.lit("Unparseable numeric value(s): "), unparsed, F.lit(".")),
        ),
        _issue(
            C.REQUIRED_MISSING, missing != "",
            F.concat(F.lit("Missing required value(s): "), missing, F.lit(".")),
        ),
        _issue(
            C.ANALOG_NONFINITE, nonfinite != "",
            F.concat(F.lit("NaN or infinity in analog field(s): "), nonfinite, F.lit(".")),
        ),
        _issue(
            C.DIGITAL_DOMAIN, off_domain != "",
            F.concat(F.lit("Digital value outside numeric 0/1 domain: "), off_domain, F.lit(".")),
        ),
    )
    miscounted = _issues(
        _issue(
            C.COLUMN_COUNT, F.lit(True),
            F.concat(F.lit(f"Expected {C.FIELD_COUNT} columns but found "), F.size("fields").cast("string"), F.lit(".")),
        )
    )
    none = F.array().cast(C.ISSUE_TYPE)
    issues = F.when(judged, checked).when(whole, none).otherwise(miscounted)
    return listed.withColumn("issues", issues).drop("blank", *(f"{name}_names" for name in lists))


def with_named_numbers(df: DataFrame) -> DataFrame:
    """Replace the ``numbers`` array by one column per signal."""
    kept = [c for c in df.columns if c not in ("numbers", "fields", "is_plain")]
    return df.select(
        *kept, *[F.get("numbers", F.lit(i)).alias(name) for i, name in enumerate(_NUMBERS)]
    )


def with_object_issues(df: DataFrame, expected_date: str, index_flag: str, ts_flag: str) -> DataFrame:
    """Append the rules that look beyond the row: partition date and repeated keys."""
    ts = F.col("event_timestamp_local")
    row_date, expected = F.to_date(ts), F.col(expected_date)
    found = _issues(
        _issue(
            C.SOURCE_DATE_MISMATCH, row_date != expected,
            F.concat(
                F.lit("Timestamp date "), row_date.cast("string"),
                F.lit(" does not match expected source_date "), expected.cast("string"), F.lit("."),
            ),
        ),
        _issue(
            C.DUPLICATE_RECORD_INDEX, F.col(index_flag),
            F.concat(
                F.lit("record_index "), F.col("record_index").cast("string"),
                F.lit(" occurs more than once in the input object."),
            ),
        ),
        _issue(
            C.DUPLICATE_TIMESTAMP, F.col(ts_flag),
            F.concat(
                F.lit("timestamp "), ts.cast("string"), F.lit(" occurs more than once in the input object."),
            ),
        ),
    )
    # Most rows have no such issue: they keep the list they have.
    wrong = (row_date != expected) | F.col(index_flag) | F.col(ts_flag)
    issues = F.when(wrong, F.concat("issues", found)).otherwise(F.col("issues"))
    return df.withColumn("issues", issues).drop(index_flag, ts_flag)


def is_valid() -> Column:
    return F.size("issues") == 0


def valid_rows(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows without issues, in the normalised schema, followed by the ``keep`` columns."""
    return df.where(is_valid()).select(
        "record_index",
        "event_timestamp_local",
        *C.ANALOGUE,
        *[(F.col(n) == 1.0).alias(n) for n in C.DIGITAL],
        F.to_date("event_timestamp_local").alias("source_date"),
        F.lit(C.TIMEZONE_STATUS).alias("event_timestamp_timezone_status"),
        *keep,
    )


def quarantine_rows(
    df: DataFrame, pipeline_version: str, processing_timestamp: Column,
    lineage: dict[str, Column] | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rejected rows with their text, fields, every failed rule and the caller's context."""
    lineage = lineage or {}
    absent = F.lit(None).cast("string")
    columns = {
        "original_record": F.col("original_record"),
        "original_field_values": F.col("fields"),
        "source_row_number": F.col("source_row_number"),
        "rule_ids": F.transform("issues", lambda i: i["rule_id"]),
        "rejection_reasons": F.transform("issues", lambda i: i["reason"]),
        "source_object_key": F.col("object_key"),
        "processing_timestamp": processing_timestamp,
        "pipeline_version": F.lit(pipeline_version),
        "expected_source_date": F.col("source_date"),
        **lineage,
    }
    return df.where(~is_valid()).select(
        *[columns.get(name, absent).alias(name) for name in C.QUARANTINE_COLUMNS], *keep
    )
