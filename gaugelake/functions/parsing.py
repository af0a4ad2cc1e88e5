"""Strict text-to-value conversions as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: the accepted spellings of each value kind.
TIMESTAMP_TEXT = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"
SPACE = r"[\s\x1c-\x1f\x85\xa0  -     　]"
INTEGER_TEXT = rf"^{SPACE}*[+-]?\d(_?\d)*{SPACE}*$"
FLOAT_TEXT = (
    rf"^{SPACE}*[+-]?((\d(_?\d)*\.?(\d(_?\d)*)?|\.\d(_?\d)*)([eE][+-]?\d(_?\d)*)?"
    rf"|(?i:inf|infinity|nan)){SPACE}*$"
)
SIMPLE_NUMBER = r"^-?\d{1,15}(?:\.\d{1,15})?$"
NAN_TEXT = r"(?i)^[+-]?nan$"
CSV_FIELD = r'"(?:[^"]++|"")*+"|[^",\r\n][^,\r\n]*+|'
CSV_LINE = rf"^(?:{CSV_FIELD})(?:,(?:{CSV_FIELD}))*\z"
CSV_OPEN_LINE = rf'^(?:(?:{CSV_FIELD}),)*"(?:[^"]++|"")*+\z'


def _compact(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}|_", "")


def is_blank(text: Column) -> Column:
    return text.rlike(rf"^{SPACE}*$")


def strict_timestamp(text: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` only; anything else, or an impossible date, is null."""
    shaped = text.rlike(TIMESTAMP_TEXT) & ~text.startswith("0000")
    return F.when(shaped, text.try_cast("timestamp_ntz"))


def record_index(text: Column) -> Column:
    return F.when(text.rlike(INTEGER_TEXT), _compact(text).try_cast("bigint"))


def numeric(text: Column) -> Column:
    """Decimal, exponent, infinite and NaN spellings; most texts end at the first test."""
    compact = _compact(text)
    return F.when(text.rlike(SIMPLE_NUMBER), text.try_cast("double")).when(
        text.rlike(FLOAT_TEXT),
        F.when(compact.rlike(NAN_TEXT), F.lit(float("nan"))).otherwise(compact.try_cast("double")),
    )


def is_finite(value: Column) -> Column:
    return ~(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))))


def without_carriage_return(line: Column) -> Column:
    return F.when(line.endswith("\r"), F.left(line, F.char_length(line) - 1)).otherwise(line)


def without_newline(record: Column) -> Column:
    """A record as it was read: one line end less. A record never ends in two."""
    return F.when(record.endswith("\n"), F.left(record, F.char_length(record) - 1)).otherwise(record)


def csv_is_well_formed(record: Column) -> Column:
    """False for bad quoting, a quote left open, or a line end outside quotes."""
    body = without_carriage_return(record)
    plain = ~body.contains("\r") & ~body.contains("\n")
    return F.when(body.contains('"'), body.rlike(CSV_LINE)).otherwise(plain)


def csv_leaves_open(line: Column) -> Column:
    """True where a line, read from the start of a record, ends inside a quoted field."""
    return line.contains('"') & line.rlike(CSV_OPEN_LINE)


def csv_fields(line: Column) -> Column:
    """Field values of one record; a blank line has none. Quotes are stripped and undoubled."""
    body = without_carriage_return(line)
    quoted = F.transform(
        F.regexp_extract_all(F.concat(F.lit(","), body), F.lit(f",({CSV_FIELD})"), F.lit(1)),
        lambda f: F.when(
            f.startswith('"'),
            F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"')),
        ).otherwise(f),
    )
    return (
        F.when(body == "", F.array().cast("array<string>"))
        .when(body.contains('"'), quoted)
        .otherwise(F.split(body, ",", -1))
    )
