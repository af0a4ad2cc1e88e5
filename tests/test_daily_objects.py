"""Daily objects: lines made once and in order; many months published at once."""

import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gaugelake.plans import catalog, split
from gaugelake.streaming import ingest
from gaugelake.workloads import lakes


def test_lines_are_not_made_again_to_count_or_to_sample_them(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def line(n):
        made.add(1)
        return f"{n},x\r"

    n = 3_000
    rows = spark.range(0, n, 1, 4).select(
        (F.col("id") + 1).alias("source_row_number"), F.udf(line)("id").alias("line"),
        F.when(F.col("id") < 2_900, F.lit("2024-01-01")).otherwise("2024-01-02").cast("date").alias("route_date"),
    )
    split.write_daily_objects(rows, str(tmp_path / "raw"))
    # Once to see how long lines are, at most a thousand a partition, and once for the write.
    assert n <= made.value <= 2 * n
    lines = []
    for day in ("2024-01-01", "2024-01-02"):
        parts = sorted((tmp_path / "raw" / f"source_date={day}").glob("part*"))
        text = "".join(Path(p).read_text(newline="") for p in parts).split("\n")
        assert text[0] == split.HEADER_LINE and (day != "2024-01-01" or len(parts) > 1)
        lines += text[1:-1]
    assert lines == [f"{i},x\r" for i in range(n)]


def test_rows_without_a_date_and_other_headers(spark, tmp_path):
    rows = spark.createDataFrame(
        [(5, "e", None), (2**40, "z", "2024-01-01"), (-3, "a", "2024-01-01"), (7, "g", "2024-01-02")],
        "source_row_number long, line string, route_date string",
    ).withColumn("route_date", F.col("route_date").cast("date"))
    headers = spark.createDataFrame([("2024-01-01", "h1"), ("2024-01-05", "h5")], "route_date string, line string")
    headers = headers.withColumn("route_date", F.col("route_date").cast("date"))
    split.write_daily_objects(rows.where("source_row_number > 0"), str(tmp_path / "raw"), header=headers)
    found = {p.name: "".join(f.read_text() for f in sorted(p.glob("part*"))) for p in (tmp_path / "raw").glob("source_date=*")}
    assert found == {
        "source_date=__HIVE_DEFAULT_PARTITION__": "e\n", "source_date=2024-01-01": "h1\nz\n",
        "source_date=2024-01-02": "g\n", "source_date=2024-01-05": "h5\n",
    }


def test_months_published_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "MONTHS_AT_ONCE", 3)
    name = f"t_{uuid.uuid4().hex[:8]}"
    catalog.create_table(spark, name, f"{tmp_path}/catalog")
    months = [("2020", f"{m:02}", f"{tmp_path}/year=2020/month={m:02}/run_id=a") for m in range(1, 9)]
    try:
        catalog.publish_new(spark, name, months)
        assert sorted(map(tuple, catalog.partitions(spark, name).collect())) == months
        catalog.publish_new(spark, name, [])
        with pytest.raises(Exception, match="ALREADY_EXIST"):
            catalog.publish_new(spark, name, months[:1])
        with pytest.raises(catalog.PublicationConflict):
            catalog.publish_new(spark, name, [("2021", "01", "/somewhere")])
    finally:
        spark.sql(f"drop table {name}")


def test_changed_objects_are_written_by_several_tasks(spark, tmp_path):
    """One new file a changed day, its lines in order and one more; other days are not read."""
    for day in range(1, 13):
        folder = tmp_path / "raw" / f"source_date=2024-01-{day:02}"
        folder.mkdir(parents=True)
        (folder / "part-0").write_text("".join(f"{day},{n}\r\n" for n in range(50)))
    files = ingest.listing(spark, str(tmp_path / "raw")).where(F.dayofmonth("source_date") <= 9)
    written = lakes._lengthened(spark, files.select("source_date", "file_path")).collect()
    assert sorted(r.source_date.day for r in written) == list(range(1, 10))
    for row in written:
        body = Path(row.new_path.removeprefix("file:")).read_bytes().decode()
        assert body == "".join(f"{row.source_date.day},{n}\r\n" for n in range(50)) + "1,2,3\r\n"
        assert row.file_path.endswith(f"source_date={row.source_date}/part-0")
    assert len({Path(r.new_path).name.split("-")[1] for r in written}) > 1
