"""Line scan, source positions, object gate and daily splitting."""

import csv
import random
from datetime import date

import pytest
from conftest import day_lines, line, write_object
from pyspark.sql import functions as F

from gaugelake.plans import split, transform
from gaugelake.session import stage
from gaugelake.sources import raw

DAY = "2020-02-01"


def scanned(spark, folder):
    lines = stage(raw.checked_lines(raw.read_lines(spark, str(folder))), "scan")
    blocks = stage(raw.block_table(lines), "blocks")
    rows = raw.with_row_numbers(lines, blocks).orderBy("object_key", "source_row_number")
    return rows.collect(), raw.object_table(blocks)


def test_row_numbers_over_many_blocks_and_files(spark, tmp_path):
    """Three ordered part files cut into many small blocks are numbered as one sequence."""
    first = day_lines(DAY, 400)
    folder = write_object(tmp_path, DAY, first, name="part-00000.csv")
    for n in (1, 2):
        more = day_lines(DAY, 300, 400 + 300 * (n - 1), first=f"0{n + 1}:00:00")
        (folder / f"part-0000{n}.csv").write_bytes(("\r\n".join(more) + "\r\n").encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows, _ = scanned(spark, tmp_path)
        blocks = len({(r["file_path"], r["block_start"]) for r in rows})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert blocks > 10
    assert [r["source_row_number"] for r in rows] == list(range(1001))
    assert [int(r["line"].split(",")[0]) for r in rows[1:]] == list(range(1000))


@pytest.mark.parametrize("prefix", [b"", b"\xef\xbb\xbf"])
@pytest.mark.parametrize("tail", ["\r\n", "\n", ""])
def test_original_text_keeps_its_terminator(spark, tmp_path, prefix, tail):
    folder = write_object(tmp_path, DAY, day_lines(DAY, 2), tail=tail)
    path = folder / "data.csv"
    path.write_bytes(prefix + path.read_bytes())
    rows, objects = scanned(spark, tmp_path)
    expected = day_lines(DAY, 2)
    assert [r["original_record"] for r in rows[1:]] == [expected[0] + "\r\n", expected[1] + tail]
    assert objects.first()["schema_drift"] is False


def test_object_gate(spark, tmp_path):
    write_object(tmp_path, "2020-02-01", day_lines("2020-02-01", 3))
    write_object(tmp_path, "2020-02-02", [])
    write_object(tmp_path, "2020-02-03", day_lines("2020-02-03", 3), header="a,b,c")
    write_object(tmp_path, "2020-02-04", ['1,"open'])
    folder = write_object(tmp_path, "2020-02-05", day_lines("2020-02-05", 1))
    with (folder / "data.csv").open("ab") as stream:
        stream.write(b"\xff\xfe,1\r\n")
    write_object(tmp_path, "2020-02-06", [], header="x")
    batch = transform.validate(raw.read_lines(spark, str(tmp_path))).batch().orderBy("source_date").collect()
    assert [(b["valid_row_count"], "|".join(e["rule_id"] for e in b["batch_errors"])) for b in batch] == [
        (3, ""), (0, "BATCH_EMPTY_INPUT"), (0, "BATCH_SCHEMA_DRIFT"), (0, "BATCH_RECONCILIATION_MISMATCH"),
        (0, "BATCH_RECONCILIATION_MISMATCH"), (0, "BATCH_SCHEMA_DRIFT|BATCH_EMPTY_INPUT"),
    ]
    assert [b["is_well_formed"] for b in batch][3] is False
    assert [b["is_utf8"] for b in batch][4] is False
    assert [b["reconciliation_applicable"] for b in batch] == [True, False, False, True, True, False]


def test_object_paths(spark):
    keys = {
        "s3://b/raw/source=x/source_date=2020-02-01/data.csv": date(2020, 2, 1),
        "raw/source=x/source_date=2020-02-30/data.csv": None,
        "raw/source=x/source_date=2020-2-1/data.csv": None,
        "raw/source=x/source_date=2020-02-01/deep/data.csv": None,
        "staging/source=x/data.parquet": None,
    }
    frame = spark.createDataFrame([(k,) for k in keys], "k string")
    rows = frame.select("k", raw.source_date_of(F.col("k")).alias("d")).collect()
    assert {r["k"]: r["d"] for r in rows} == keys


def source_file(folder, lines, header=split.HEADER_LINE.rstrip("\r")):
    folder.mkdir()
    (folder / "source.csv").write_bytes(("\r\n".join([header, *lines]) + "\r\n").encode())
    return str(folder)


def test_split_keeps_text_order_and_window(spark, tmp_path):
    days = ["2020-02-01", "2020-02-02", "2020-02-04"]
    lines = [text for i, d in enumerate(days) for text in day_lines(d, 50, 50 * i)]
    source = source_file(tmp_path / "in", lines)
    split.split_source(spark, source, str(tmp_path / "out"), date(2020, 2, 2), date(2020, 2, 4))
    rows, objects = scanned(spark, tmp_path / "out")
    assert [r["original_record"] for r in rows if r["source_row_number"] > 0] == [
        text + "\r\n" for text in lines[50:]
    ]
    assert sorted(o["source_date"] for o in objects.collect()) == [date(2020, 2, 2), date(2020, 2, 4)]
    assert not any(o["schema_drift"] for o in objects.collect())


@pytest.mark.parametrize("lines,header,message", [
    (day_lines("2020-02-01", 2) + day_lines("2020-02-02", 2, 2) + day_lines("2020-02-01", 2, 4), None, "SOURCE_ORDER date 2020-02-01"),
    (day_lines("2020-02-01", 2) + ["5,not a time,1"], None, "SOURCE_ROUTE row 3"),
    (day_lines("2020-02-01", 2) + [""], None, "SOURCE_ROUTE row 3"),
    (day_lines("2020-02-01", 2), "a,b", "SOURCE_HEADER"),
    ([], None, "SOURCE_ROWS"),
])
def test_split_refuses_untrustworthy_sources(spark, tmp_path, lines, header, message):
    source = source_file(tmp_path / "in", lines, header or split.HEADER_LINE.rstrip("\r"))
    with pytest.raises(split.SourceError, match=message):
        split.split_source(spark, source, str(tmp_path / "out"))


def test_order_of_rows_does_not_change_verdicts(spark, tmp_path):
    lines = day_lines(DAY, 20) + [line(3, "2020-02-01 05:00:00"), line(99, "bad"), line(98, "2020-02-01 00:00:10")]
    verdicts = []
    for n, ordering in enumerate((lines, lines[::-1])):
        write_object(tmp_path / str(n), DAY, ordering)
        rows = transform.validate(raw.read_lines(spark, str(tmp_path / str(n)))).rows
        verdicts.append(sorted(
            (r["record_index"], r["ids"])
            for r in rows.select("record_index", F.array_join("issues.rule_id", "|").alias("ids")).collect()
        ))
    assert verdicts[0] == verdicts[1]


def quoted_texts(seed, count):
    """Fields for CSV records, some with quotes, commas and line ends inside."""
    rng = random.Random(seed)
    for n in range(count):
        texts = [f"v{n}", 'say ""hi""', "a,b", "x\ny", "\n", "\r\n", '""\n""', "long\n" * rng.randint(1, 60), "é\n,"]
        fields = [rng.choice(texts) if rng.random() < 0.3 else str(rng.random()) for _ in range(3)]
        yield ",".join([str(n), *(f'"{x}"' if set(x) & set('",\r\n') or rng.random() < 0.2 else x for x in fields)])


def with_blocks(spark, size, action):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        return action()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("size", [600, 1 << 20])
def test_quoted_newlines_over_blocks(spark, tmp_path, size):
    """Records that cross lines and blocks equal those of a sequential reader."""
    wanted = {}
    for day in range(1, 4):
        records = [",".join(raw.contract.SOURCE_HEADER), *quoted_texts(day, 40)]
        folder = write_object(tmp_path, f"2020-02-0{day}", records[1:], end=("\n", "\r\n")[day % 2])
        with (folder / "data.csv").open(encoding="utf-8", newline="") as stream:
            wanted[f"2020-02-0{day}"] = list(csv.reader(stream, strict=True))
    # A file that ends inside quotes, and one without any.
    write_object(tmp_path, "2020-02-08", ['1,"open', "2,b", "3,c"])
    write_object(tmp_path, "2020-02-09", ["1,a", "2,b"])

    def scan():
        checked = stage(raw.checked_lines(raw.read_lines(spark, str(tmp_path))), "scan")
        joined = stage(raw.with_joined_records(spark, checked, raw.checked_lines), "joined")
        blocks = stage(raw.block_table(joined), "blocks")
        fields = raw.parsing.csv_fields(F.col("line"))
        rows = raw.with_row_numbers(joined, blocks).select("source_date", "source_row_number", fields.alias("f"), "original_record")
        return rows.orderBy("source_date", "source_row_number").collect(), raw.object_table(blocks).collect(), joined.count()

    rows, objects, count = with_blocks(spark, size, scan)
    assert count == len(rows)
    for day, records in wanted.items():
        mine = [r for r in rows if str(r.source_date) == day]
        assert [r.source_row_number for r in mine] == list(range(len(records)))
        assert [r.f for r in mine] == records
        assert "".join(r.original_record for r in mine).encode() == (tmp_path / f"source_date={day}" / "data.csv").read_bytes()
    state = {str(o.source_date): (o.is_well_formed, o.input_row_count) for o in objects}
    assert all(state[day] == (True, 40) for day in wanted)
    assert state["2020-02-08"] == (False, 3) and state["2020-02-09"] == (True, 2)


def test_real_parse_errors_still_fail(spark, tmp_path):
    good = day_lines(DAY, 3)
    broken = {
        "2020-02-01": ['1,"a"b,2'], "2020-02-02": ['1,"a', 'b"c,2'], "2020-02-03": ["1,a\rb,2"], "2020-02-04": ['1,"a"', '2,"b'],
        "2020-02-05": [good[0].replace("60.0", '"60.0\n"'), *[x.replace("1.5", '"1.5"') for x in good[1:]]], "2020-02-06": ['1,b"c', '2,"x', 'y",3'],
    }
    for day, lines in broken.items():
        write_object(tmp_path, day, [x.replace(DAY, day) for x in lines])
    batch = transform.validate(raw.read_lines(spark, str(tmp_path))).batch().collect()
    state = {str(b.source_date): (b.is_well_formed, b.valid_row_count) for b in batch}
    assert state == {
        "2020-02-01": (False, 0), "2020-02-02": (False, 0), "2020-02-03": (False, 0), "2020-02-04": (False, 0),
        "2020-02-05": (True, 3), "2020-02-06": (True, 0),
    }


def test_split_keeps_quoted_newlines_together(spark, tmp_path):
    lines = [x for i, d in enumerate(("2020-02-01", "2020-02-02")) for x in day_lines(d, 40, 40 * i)]
    lines[7] = lines[7].replace("60.0", '"60.0\n\n"')
    lines[55] = lines[55].replace("60.0", '"a ""b"",\r\nc"')
    source = source_file(tmp_path / "in", lines)
    with_blocks(spark, 700, lambda: split.split_source(spark, source, str(tmp_path / "out")))
    rows = transform.validate(raw.read_lines(spark, str(tmp_path / "out")))
    assert rows.valid().count() == 79
    bad = rows.rows.where(F.size("issues") > 0).collect()
    assert [(r.source_row_number, r.original_record, r.fields[7]) for r in bad] == [(16, lines[55] + "\r\n", 'a "b",\r\nc')]
