"""Row rules, one defect at a time, and strict value parsing."""

import pytest
from conftest import day_lines, line, write_object
from pyspark.sql import functions as F

from gaugelake import contract as C
from gaugelake.functions import parsing
from gaugelake.plans import transform
from gaugelake.sources import raw

DAY = "2020-02-01"
T0 = "2020-02-01 00:00:00"
GOOD = line(1, T0)


def replaced(position, text):
    fields = GOOD.split(",")
    fields[position] = text
    return ",".join(fields)


CASES = {
    "valid": (GOOD, ""),
    "negative": (replaced(2, "-999.5"), ""),
    "spaces": (replaced(9, " 1.0 "), ""),
    "blank": (replaced(5, ""), "ROW_REQUIRED_MISSING"),
    "blank index": (replaced(0, " \t"), "ROW_REQUIRED_MISSING"),
    "iso": (replaced(1, "2020-02-01T00:00:00Z"), "ROW_TIMESTAMP_PARSE"),
    "no such day": (replaced(1, "2020-02-30 00:00:00"), "ROW_TIMESTAMP_PARSE"),
    "text": (replaced(8, "bad"), "ROW_NUMERIC_PARSE"),
    "fractional index": (replaced(0, "1.0"), "ROW_NUMERIC_PARSE"),
    "nan": (replaced(2, "NaN"), "ROW_ANALOG_NONFINITE"),
    "infinity": (replaced(3, "-Infinity"), "ROW_ANALOG_NONFINITE"),
    "digital two": (replaced(10, "2.0"), "ROW_DIGITAL_DOMAIN"),
    "digital nan": (replaced(10, "nan"), "ROW_DIGITAL_DOMAIN"),
    "short": (GOOD.rsplit(",", 1)[0], "ROW_COLUMN_COUNT"),
    "long": (GOOD + ",1", "ROW_COLUMN_COUNT"),
    "empty line": ("", "ROW_COLUMN_COUNT"),
    "other date": (replaced(1, "2020-02-02 00:00:00"), "ROW_SOURCE_DATE_MISMATCH"),
    "several": (
        replaced(1, "x").replace("1.5", "").replace("2.5", "bad"),
        "ROW_TIMESTAMP_PARSE|ROW_NUMERIC_PARSE|ROW_REQUIRED_MISSING",
    ),
}


def judged(spark, root, lines):
    write_object(root, DAY, lines)
    rows = transform.validate(raw.read_lines(spark, str(root))).rows
    return {
        r["source_row_number"]: r
        for r in rows.select(
            "source_row_number", "original_record", "fields",
            F.array_join("issues.rule_id", "|").alias("ids"),
            F.array_join("issues.reason", "|").alias("reasons"),
        ).collect()
    }


def test_each_defect_alone(spark, tmp_path):
    """Every case gets its own object, so none is a duplicate of another."""
    for i, (text, _) in enumerate(CASES.values()):
        write_object(tmp_path / f"case={i}", DAY, [text])
    folders = [str(tmp_path / f"case={i}") for i in range(len(CASES))]
    rows = transform.validate(raw.read_lines(spark, folders)).rows
    found = {
        int(r["object_key"].split("case=")[1].split("/")[0]): r["ids"]
        for r in rows.select("object_key", F.array_join("issues.rule_id", "|").alias("ids")).collect()
    }
    assert found == {i: expected for i, (_, expected) in enumerate(CASES.values())}


def test_duplicates_reject_every_member_in_rule_order(spark, tmp_path):
    rows = judged(spark, tmp_path, [
        line(1, "2020-02-01 00:00:00"), line(1, "2020-02-01 00:00:10"),
        line(2, "2020-02-01 00:00:20"), line(3, "2020-02-01 00:00:20"),
        line(4, "2020-02-01 00:00:30"), line(4, "2020-02-01 00:00:30"),
        line(5, "2020-02-01 00:00:40", ["bad"] + ["1"] * 6), line(5, "2020-02-01 00:00:50"),
    ])
    index, ts = "ROW_DUPLICATE_RECORD_INDEX", "ROW_DUPLICATE_TIMESTAMP"
    assert [rows[i]["ids"] for i in range(1, 9)] == [
        index, index, ts, ts, f"{index}|{ts}", f"{index}|{ts}", f"ROW_NUMERIC_PARSE|{index}", index,
    ]
    assert "record_index 4 occurs more than once" in rows[5]["reasons"]
    assert "timestamp 2020-02-01 00:00:30 occurs more than once" in rows[5]["reasons"]


def test_reasons_and_text_are_kept(spark, tmp_path):
    rows = judged(spark, tmp_path, [
        replaced(0, "").replace("3.5", ""), GOOD.rsplit(",", 1)[0], *day_lines(DAY, 2, 50, first="01:00:00"),
    ])
    assert rows[1]["reasons"] == "Missing required value(s): <blank index header>, H1."
    assert rows[2]["reasons"] == "Expected 17 columns but found 16."
    assert rows[2]["original_record"] == GOOD.rsplit(",", 1)[0] + "\r\n"
    assert len(rows[2]["fields"]) == 16
    assert rows[3]["ids"] == "" and rows[3]["fields"] is None


# text, float accepted by the contract, integer accepted by the contract
NUMBERS = [
    ("1", 1.0, 1), (" 1 ", 1.0, 1), ("+5", 5.0, 5), ("-0", 0.0, 0), ("1_000", 1000.0, 1000),
    ("1__0", None, None), ("_1", None, None), ("1.", 1.0, None), (".5", 0.5, None), (".", None, None),
    ("1e3", 1000.0, None), ("1e", None, None), ("1d", None, None), ("1.0f", None, None),
    ("0x1p3", None, None), ("1 0", None, None), ("", None, None), ("abc", None, None),
    ("1e400", float("inf"), None), ("Infinity", float("inf"), None), ("-inf", float("-inf"), None),
    ("9223372036854775807", 9.223372036854775807e18, 9223372036854775807),
    ("9223372036854775808", 9.223372036854775808e18, None), ("--1", None, None), ("1,5", None, None),
]


def test_numbers(spark):
    frame = spark.createDataFrame([(t,) for t, _, _ in NUMBERS], "t string")
    seen = frame.select(
        parsing.numeric(F.col("t")).alias("f"), parsing.record_index(F.col("t")).alias("i")
    ).collect()
    assert [(r["f"], r["i"]) for r in seen] == [(f, i) for _, f, i in NUMBERS]


def test_nan_spellings(spark):
    frame = spark.createDataFrame([(t,) for t in ("nan", "NaN", "+nan", "-NAN")], "t string")
    assert all(r[0] for r in frame.select(F.isnan(parsing.numeric(F.col("t")))).collect())


@pytest.mark.parametrize("text,ok", [
    ("2020-02-01 00:00:00", True), ("2024-03-10 02:30:00", True), ("2020-2-1 00:00:00", False),
    ("2020-02-01T00:00:00", False), ("2020-02-01 00:00:00.5", False), ("2020-02-01 24:00:00", False),
    ("2020-02-01 00:00:60", False), ("0000-02-01 00:00:00", False), (" 2020-02-01 00:00:00", False),
])
def test_timestamps_without_zone_leak(spark, text, ok):
    value = spark.createDataFrame([(text,)], "t string").select(
        parsing.strict_timestamp(F.col("t")).cast("string")
    ).first()[0]
    assert value == (text if ok else None)


def test_csv_fields(spark):
    texts = {
        ",a,b": ["", "a", "b"], "1,2,": ["1", "2", ""], '"a,b",c': ["a,b", "c"],
        '"say ""hi""",x': ['say "hi"', "x"], 'a"b,c': ['a"b', "c"], "": [], "\r": [], "x\r": ["x"],
    }
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select("t", parsing.csv_fields(F.col("t")).alias("f")).collect()
    assert {r["t"]: r["f"] for r in rows} == texts
    broken = ['"open', '"a"b,c', "a\rb"]
    flags = spark.createDataFrame([(t,) for t in [*texts, *broken]], "t string").select(
        parsing.csv_is_well_formed(F.col("t")).alias("ok")
    ).collect()
    assert [r["ok"] for r in flags] == [True] * len(texts) + [False] * len(broken)


def test_normalized_schema(spark, tmp_path):
    write_object(tmp_path, DAY, [GOOD])
    valid = transform.validate(raw.read_lines(spark, str(tmp_path))).valid()
    assert valid.columns == [f.name for f in C.NORMALIZED_SCHEMA]
    assert [t for _, t in valid.dtypes] == [f.dataType.simpleString() for f in C.NORMALIZED_SCHEMA]
    row = valid.first()
    assert (row["record_index"], row["comp"], row["dv_electric"], row["tp2"]) == (1, True, False, 1.5)
    assert str(row["event_timestamp_local"]) == T0
    assert row["event_timestamp_timezone_status"] == "unknown"
