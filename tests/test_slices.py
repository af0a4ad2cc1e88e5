from conftest import day_lines, write_object
from pyspark.sql import functions as F

from gaugelake.functions import parsing
from gaugelake.plans import publish, transform
from gaugelake.plans import lake as L
from gaugelake.plans.lake import Lake
from gaugelake.sources import raw, tables

RUN = publish.Run("1.0.0", "2024-02-01T00:00:00Z")


def test_written_rows_hold_no_fields_and_fields_follow_from_the_text(spark):
    rows = spark.createDataFrame(
        [(1, 'a,"b,""c""",\r\n'), (2, 'a,"x\ny"'), (3, "\r\n"), (4, None)], "n int, original_record string")
    found = {r.n: r.fields for r in transform.with_fields(rows).collect()}
    assert found == {1: ["a", 'b,"c"', ""], 2: ["a", "x\ny"], 3: [], 4: None}


def test_days_are_dealt_in_equal_ordered_slices(spark, tmp_path):
    """One day of 600 rows and one of 30 over the session's partitions, in source order."""
    lake = Lake(str(tmp_path))
    lines = day_lines("2020-02-01", 600, 0)
    bad = {i for i in range(600) if i % 3 == 0}
    write_object(lake.raw, "2020-02-01",
                 [x.replace(",", ",x", 1) if i in bad else x for i, x in enumerate(lines)])
    write_object(lake.raw, "2020-02-02", day_lines("2020-02-02", 30, 700))
    result = transform.validate(raw.read_lines(spark, lake.raw))
    assert "fields" not in result.staged.columns
    publish.publish_days(spark, lake, RUN)
    staged = tables.read_normalized(spark, lake.staging, "year", "month", "day", "input_id")
    files = staged.groupBy("day", F.col("_metadata.file_path").alias("path")).agg(
        F.count("*").alias("n"), F.min("record_index").alias("lo"), F.max("record_index").alias("hi")).collect()
    assert sum(f.n for f in files) == 430
    first = sorted((f for f in files if f.day == "01"), key=lambda f: (len(f.path), f.path))
    assert all(a.hi < b.lo for a, b in zip(first, first[1:], strict=False))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert max(f.n for f in files) <= -(-630 // parts)
    rejected = tables.read_quarantine(spark, lake.quarantine).orderBy("source_row_number").collect()
    assert [r.source_row_number - 1 for r in rejected] == sorted(bad)
    assert all(r.original_field_values == parsing_fields(r.original_record) for r in rejected)


def parsing_fields(record):
    return record.rstrip("\r\n").split(",")


def test_one_line_end_is_taken(spark):
    frame = spark.createDataFrame([("a\r\n",), ("a",), ("",)], "t string")
    assert [r[0] for r in frame.select(parsing.without_newline(F.col("t"))).collect()] == ["a\r", "a", ""]


def test_rejected_rows_stage_no_signals_and_only_wanted_folders_are_digested(spark, tmp_path):
    lake = Lake(str(tmp_path))
    lines = day_lines("2020-02-01", 20, 0)
    write_object(lake.raw, "2020-02-01", [*lines[:19], lines[18]])
    result = transform.validate(raw.read_lines(spark, lake.raw))
    kept = result.staged.select(F.size("issues").alias("n"), "tp2", "comp", "original_record").collect()
    assert sorted(r.n > 0 for r in kept) == [False] * 18 + [True] * 2
    assert all((r.tp2 is None and r.comp is None) == (r.n > 0) == (r.original_record is not None) for r in kept)
    publish.publish_days(spark, lake, RUN)
    stray = tmp_path / "quarantine/source=telemetry/source_date=2020-02-01/input_id=other"
    stray.mkdir()
    (stray / "part-0.json").write_text("{}\n")
    every = publish.objects_by_key(spark, lake, lake.quarantine, "*.json", "quarantine")
    assert every.count() == 2
    key = every.where(~F.col("quarantine_key").endswith("=other")).select("quarantine_key")
    found = publish.objects_by_key(spark, lake, lake.quarantine, "*.json", "quarantine", key).collect()
    assert [(r.quarantine_key, len(r.quarantine_sha256)) for r in found] == [(key.first()[0], 64)]
    assert L.existing(spark, [f"{tmp_path}/none", str(stray), lake.raw]) == [str(stray), lake.raw]


def test_many_rejected_rows_get_more_slices(spark, tmp_path, monkeypatch):
    """Slices follow what rows take as text, not the size of their compressed table."""
    asked = []
    monkeypatch.setattr(publish, "partitions_for", lambda spark, size: asked.append(size) or 2)
    lake = Lake(str(tmp_path))
    lines = day_lines("2020-02-01", 20, 0)
    write_object(lake.raw, "2020-02-01", [*lines, *lines[:5]])
    publish.publish_days(spark, lake, RUN)
    assert asked == [15 * 200 + 10 * 800]
