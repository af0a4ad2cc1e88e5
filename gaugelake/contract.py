"""The telemetry contract: schemas, rule identifiers, messages and thresholds.

Everything here is data. Operators take the pieces they need as arguments, so the same
operators run on any table once its column roles are named.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- Fixed values: these must equal the published contract for results to match. ---------

SCHEMA_VERSION = "1.0.0"
MANIFEST_VERSION = "1.1.0"
LEGACY_MANIFEST_VERSION = "1.0.0"
COMPACTION_MANIFEST_VERSION = "1.0.0"
TIMEZONE_STATUS = "unknown"
BLANK_HEADER_LABEL = "<blank index header>"

INDEX_FIELD = ""
TIME_FIELD = "timestamp"
ANALOGUE_FIELDS = (
    "TP2", "TP3", "H1", "DV_pressure", "Reservoirs", "Oil_temperature", "Motor_current",
)
DIGITAL_FIELDS = (
    "COMP", "DV_eletric", "Towers", "MPG", "LPS", "Pressure_switch", "Oil_level",
    "Caudal_impulses",
)
SOURCE_HEADER = (INDEX_FIELD, TIME_FIELD, *ANALOGUE_FIELDS, *DIGITAL_FIELDS)
FIELD_COUNT = len(SOURCE_HEADER)

# Normalised names are the lower-cased source names except for these three.
RENAMED_FIELDS = {
    "": "record_index",
    "timestamp": "event_timestamp_local",
    "DV_eletric": "dv_electric",
}

COLUMN_COUNT = "ROW_COLUMN_COUNT"
TIMESTAMP_PARSE = "ROW_TIMESTAMP_PARSE"
NUMERIC_PARSE = "ROW_NUMERIC_PARSE"
REQUIRED_MISSING = "ROW_REQUIRED_MISSING"
ANALOG_NONFINITE = "ROW_ANALOG_NONFINITE"
DIGITAL_DOMAIN = "ROW_DIGITAL_DOMAIN"
SOURCE_DATE_MISMATCH = "ROW_SOURCE_DATE_MISMATCH"
DUPLICATE_RECORD_INDEX = "ROW_DUPLICATE_RECORD_INDEX"
DUPLICATE_TIMESTAMP = "ROW_DUPLICATE_TIMESTAMP"
ROW_RULES = (
    COLUMN_COUNT, TIMESTAMP_PARSE, NUMERIC_PARSE, REQUIRED_MISSING, ANALOG_NONFINITE,
    DIGITAL_DOMAIN, SOURCE_DATE_MISMATCH, DUPLICATE_RECORD_INDEX, DUPLICATE_TIMESTAMP,
)

TIMESTAMP_ORDER = "BATCH_TIMESTAMP_ORDER"
SAMPLING_INTERVAL = "BATCH_SAMPLING_INTERVAL"
SIGNIFICANT_GAP = "BATCH_SIGNIFICANT_GAP"
LOW_ROW_COUNT = "BATCH_LOW_ROW_COUNT"
SCHEMA_DRIFT = "BATCH_SCHEMA_DRIFT"
EMPTY_INPUT = "BATCH_EMPTY_INPUT"
RECONCILIATION_MISMATCH = "BATCH_RECONCILIATION_MISMATCH"

WARNING_TEXT = {
    TIMESTAMP_ORDER: "Parsed timestamps decrease in source order.",
    SAMPLING_INTERVAL: (
        "Positive timestamp intervals outside the expected 9-13 second band were observed."
    ),
    SIGNIFICANT_GAP: (
        "Timestamp gaps greater than 60 seconds were observed; rows were not imputed."
    ),
    LOW_ROW_COUNT: "Daily input has fewer than 3718 rows.",
}
ERROR_TEXT = {
    SCHEMA_DRIFT: "Source header does not match the exact schema.",
    EMPTY_INPUT: "Input contains no data records.",
    RECONCILIATION_MISMATCH: "Input rows do not equal valid rows plus quarantine rows.",
}

ROW_GROUP_ROWS = 65_536
PROFILE_QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
ABSOLUTE_PATH_ANYWHERE = r"(?:^|[\"'\s])[A-Za-z]:[\\/]"

# --- End of fixed values. ----------------------------------------------------------------


@dataclass(frozen=True)
class Thresholds:
    """Cadence limits in seconds and the low-volume limit in rows."""

    interval_min: int = 9
    interval_max: int = 13
    gap_seconds: int = 60
    low_row_count: int = 3_718


@dataclass(frozen=True)
class CompactionBounds:
    """Limits of one month; None leaves a quantity unbounded."""

    max_selected_objects: int | None = None
    max_compressed_input_bytes: int | None = None
    max_input_rows: int | None = None
    max_output_bytes: int | None = None


@dataclass(frozen=True)
class AuditBounds:
    """Limits of one audit; None leaves a quantity unbounded."""

    max_months: int | None = None
    max_object_bytes: int | None = None
    max_total_bytes: int | None = None
    max_total_rows: int | None = None


def normalized_name(source_name: str) -> str:
    return RENAMED_FIELDS.get(source_name, source_name.lower())


ANALOGUE = tuple(normalized_name(name) for name in ANALOGUE_FIELDS)
DIGITAL = tuple(normalized_name(name) for name in DIGITAL_FIELDS)


def _field(name: str, kind: T.DataType, category: str, source: str | None) -> T.StructField:
    return T.StructField(name, kind, False, {"source_name": source, "category": category})


NORMALIZED_SCHEMA = T.StructType(
    [_field("record_index", T.LongType(), "identity", INDEX_FIELD)]
    + [_field("event_timestamp_local", T.TimestampNTZType(), "time", TIME_FIELD)]
    + [_field(normalized_name(n), T.DoubleType(), "analog", n) for n in ANALOGUE_FIELDS]
    + [_field(normalized_name(n), T.BooleanType(), "digital", n) for n in DIGITAL_FIELDS]
    + [
        _field("source_date", T.DateType(), "derived", None),
        _field("event_timestamp_timezone_status", T.StringType(), "derived", None),
    ]
)

ISSUE_TYPE = "array<struct<rule_id:string,reason:string>>"

QUARANTINE_COLUMNS = (
    "original_record", "original_field_values", "source_row_number", "rule_ids",
    "rejection_reasons", "source_bucket", "source_object_key", "source_object_version_id",
    "source_object_etag", "source_object_checksum", "processing_timestamp",
    "pipeline_version", "expected_source_date",
)
