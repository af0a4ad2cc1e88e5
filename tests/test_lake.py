"""Daily publication, resume, compaction, catalog, audits and the arrival stream."""

import hashlib
import json
import uuid
from datetime import date
from pathlib import Path

import pytest
from conftest import day_lines, line, write_object
from pyspark.sql import functions as F

from gaugelake import contract as C
from gaugelake.contract import AuditBounds, CompactionBounds
from gaugelake.operators import conformance, selection
from gaugelake.plans import audit, catalog, compact, publish
from gaugelake.plans import lake as L
from gaugelake.plans.lake import Lake
from gaugelake.sources import objects, tables
from gaugelake.streaming import ingest

RUN = publish.Run("1.0.0", "2020-10-01T00:00:00Z", {"name": "feed"})
FEB = (date(2020, 2, 1), date(2020, 2, 29))


def build(root, days=("2020-02-01", "2020-02-02"), bad_on="2020-02-02"):
    lake = Lake(str(root))
    for i, day in enumerate(days):
        lines = day_lines(day, 30, 100 * i, first="23:54:00" if i == 0 else "00:00:00")
        if day == bad_on:
            lines.append(line(9000, f"{day} 10:00:00", ["bad"] + ["1"] * 6))
        write_object(lake.raw, day, lines)
    return lake


def statuses(outcomes):
    return {str(r["source_date"]): r["status"] for r in outcomes.select("source_date", "status").collect()}


def files(folder, suffix):
    return sorted(p for p in Path(folder).rglob(f"*{suffix}") if not p.name.startswith((".", "_")))


def test_publish_then_skip_then_rebuild(spark, tmp_path):
    lake = build(tmp_path / "lake")
    first = publish.publish_days(spark, lake, RUN)
    assert statuses(first) == {"2020-02-01": "processed", "2020-02-02": "processed"}
    rows = {str(r["source_date"]): r for r in L.manifests(spark, lake).collect()}
    one, two = rows["2020-02-01"], rows["2020-02-02"]
    assert (one["valid_row_count"], one["quarantine_row_count"], one["quarantine_status"]) == (30, 0, "absent_zero_rows")
    assert (one["quarantine_key"], one["quarantine_byte_size"]) == (None, 0)
    assert (two["valid_row_count"], two["quarantine_row_count"]) == (30, 1)
    assert str(two["first_valid_event_timestamp_local"]) == "2020-02-02 00:00:00"
    assert one["source_identity"] == {"name": "feed"}

    rejected = files(lake.quarantine, ".json")
    assert len(rejected) == 1
    record = json.loads(rejected[0].read_text())
    assert list(record) == sorted(C.QUARANTINE_COLUMNS)
    assert record["rule_ids"] == ["ROW_NUMERIC_PARSE"] and record["source_bucket"] is None
    assert record["original_record"].endswith("\r\n") and record["source_row_number"] == 31
    assert record["processing_timestamp"] == "2020-10-01T00:00:00Z"

    assert set(statuses(publish.publish_days(spark, lake, RUN)).values()) == {"skipped"}

    staged = files(f"{lake.staging}/year=2020/month=02/day=01", ".parquet")[0]
    staged.write_bytes(staged.read_bytes()[:-1] + b"X")
    staged.with_name(f".{staged.name}.crc").unlink(missing_ok=True)
    again = statuses(publish.publish_days(spark, lake, RUN))
    assert again == {"2020-02-01": "rebuilt", "2020-02-02": "skipped"}

    write_object(lake.raw, "2020-02-02", day_lines("2020-02-02", 5, 100))
    changed = statuses(publish.publish_days(spark, lake, RUN))
    assert changed == {"2020-02-01": "skipped", "2020-02-02": "rebuilt"}
    forced = statuses(publish.publish_days(spark, lake, RUN, force=True))
    assert set(forced.values()) == {"rebuilt"}
    assert audit.lake_summary(audit.lake_evidence(spark, lake)).first()["verified"]


def test_bad_day_fails_alone(spark, tmp_path):
    lake = build(tmp_path / "lake")
    write_object(lake.raw, "2020-02-03", day_lines("2020-02-03", 3), header="a,b")
    write_object(lake.raw, "2020-02-04", [])
    outcomes = {str(r["source_date"]): r for r in publish.publish_days(spark, lake, RUN).collect()}
    assert outcomes["2020-02-01"]["status"] == "processed"
    assert (outcomes["2020-02-03"]["status"], outcomes["2020-02-03"]["error"]) == ("failed", "BATCH_SCHEMA_DRIFT")
    assert outcomes["2020-02-04"]["error"] == "BATCH_EMPTY_INPUT"
    assert L.manifests(spark, lake).count() == 2


def test_fully_rejected_day_is_published_without_staging(spark, tmp_path):
    lake = build(tmp_path / "lake", days=("2020-02-01",), bad_on=None)
    write_object(lake.raw, "2020-02-05", day_lines("2020-02-06", 4, 500))
    publish.publish_days(spark, lake, RUN)
    row = L.manifests(spark, lake).where("source_date = date'2020-02-05'").first()
    assert (row["valid_row_count"], row["quarantine_row_count"]) == (0, 4)
    assert row["first_valid_event_timestamp_local"] is None
    assert set(statuses(publish.publish_days(spark, lake, RUN)).values()) == {"skipped"}
    assert audit.lake_failures(audit.lake_evidence(spark, lake)).count() == 0


def test_lake_failures_name_the_disagreement(spark, tmp_path):
    lake = build(tmp_path / "lake")
    publish.publish_days(spark, lake, RUN)
    write_object(lake.raw, "2020-02-01", day_lines("2020-02-01", 31), end="\n")
    write_object(lake.raw, "2020-02-09", day_lines("2020-02-09", 1))
    found = audit.lake_failures(audit.lake_evidence(spark, lake)).collect()
    seen = {(r["raw_key"][-10:], r["failure"]) for r in found}
    assert seen == {
        ("2020-02-01", "RAW_ROWS"), ("2020-02-01", "RAW_DIGEST"),
        ("2020-02-01", "RAW_HEADER"), ("2020-02-09", "RAW_WITHOUT_MANIFEST"),
    }


@pytest.fixture(scope="module")
def months(spark, tmp_path_factory):
    lake = build(tmp_path_factory.mktemp("months"), days=("2020-02-01", "2020-02-02", "2020-03-01"))
    publish.publish_days(spark, lake, RUN)
    done = compact.compact_months(spark, lake, date(2020, 2, 1), date(2020, 3, 10))
    return lake, {r["month"]: r for r in done.collect()}


def test_compaction_evidence(spark, months):
    lake, done = months
    feb, mar = done["02"], done["03"]
    assert (feb["curated_row_count"], feb["quarantine_row_count"], feb["selected_input_count"]) == (60, 1, 2)
    assert len(feb["missing_dates"]) == 27 and feb["terminal_partial_month"] is False
    assert mar["terminal_partial_month"] is True and len(mar["missing_dates"]) == 9
    assert feb["significant_gap_count"] == 1
    assert feb["curated_key"].endswith(f"year=2020/month=02/run_id={feb['run_id']}")
    boundaries = L.read_months(spark, lake.control("selection_boundary")).collect()
    assert [(r["seconds"], r["classification"]) for r in boundaries] == [(70.0, "gap_over_60_seconds")]


def test_compaction_again_writes_nothing(spark, months):
    lake, done = months
    before = {p: p.stat().st_mtime for p in files(lake.curated, ".parquet")}
    again = compact.compact_months(spark, lake, date(2020, 2, 1), date(2020, 3, 10)).collect()
    assert {r["write_outcome"] for r in again} == {"existing"}
    assert {r["run_id"] for r in again} == {r["run_id"] for r in done.values()}
    assert {p: p.stat().st_mtime for p in files(lake.curated, ".parquet")} == before


def test_conformance_sees_disorder(spark, months, tmp_path):
    lake, _ = months
    rows = compact.read_curated(spark, lake).drop("_metadata").where("month = '02'")
    backwards = rows.unionByName(rows.limit(1)).coalesce(1).sortWithinPartitions(
        *compact.RUN, F.desc("record_index")
    )
    backwards.write.partitionBy(*compact.RUN).parquet(str(tmp_path / "x"))
    evidence = conformance.curated_evidence(
        tables.read_normalized(spark, str(tmp_path / "x"), *compact.RUN), compact.RUN
    ).first()
    assert evidence["order_violation_count"] == 59
    assert (evidence["duplicate_timestamp_count"], evidence["duplicate_index_count"]) == (1, 1)


def test_altered_run_is_a_conflict(spark, tmp_path):
    lake = build(tmp_path / "lake")
    publish.publish_days(spark, lake, RUN)
    run = compact.compact_months(spark, lake, *FEB).first()
    target = f"{lake.root}/{run['curated_key']}"
    rows = spark.read.parquet(target).limit(10).collect()
    spark.createDataFrame(rows, C.NORMALIZED_SCHEMA).write.mode("overwrite").parquet(target)
    again = compact.compact_months(spark, lake, *FEB).collect()
    assert [(r["month"], r["run_id"], r["findings"]) for r in again if r["findings"]] == [("02", None, ["RUN_CONFLICT"])]


def test_duplicates_across_days_and_bounds_reject_the_month(spark, tmp_path):
    lake = Lake(str(tmp_path / "lake"))
    write_object(lake.raw, "2020-02-01", day_lines("2020-02-01", 5, 0))
    write_object(lake.raw, "2020-02-02", day_lines("2020-02-02", 5, 4))
    write_object(lake.raw, "2020-03-01", day_lines("2020-03-01", 5, 50))
    publish.publish_days(spark, lake, RUN)
    rows = {r["month"]: r for r in compact.compact_months(spark, lake, date(2020, 2, 1), date(2020, 3, 31)).collect()}
    assert rows["02"]["run_id"] is None
    assert rows["02"]["findings"] == ["INDEX_ON_TWO_DAYS"]
    assert rows["03"]["curated_row_count"] == 5
    tight = compact.compact_months(spark, lake, date(2020, 3, 1), date(2020, 3, 31), CompactionBounds(0, 1, 1, 1))
    assert len(tight.first()["findings"]) == 3


def test_run_identity_ignores_order_and_sees_content(spark, months):
    lake, done = months
    inputs = selection.selected_inputs(L.manifests(spark, lake))
    base = selection.run_identities(inputs, "telemetry").where("month = '02'").first()["run_id"]
    flipped = inputs.orderBy(F.desc("source_date"))
    assert base == done["02"]["run_id"]
    assert selection.run_identities(flipped, "TELEMETRY").where("month = '02'").first()["run_id"] == base
    for name in ("valid_row_count", "staging_sha256", "pipeline_version"):
        other = inputs.withColumn(name, F.concat(F.col(name).cast("string"), F.lit("1")).cast(dict(inputs.dtypes)[name]))
        assert selection.run_identities(other, "telemetry").where("month = '02'").first()["run_id"] != base
    assert selection.run_identities(inputs, "telemetry", "2.0.0").where("month = '02'").first()["run_id"] != base


def test_selection_contract(spark, months):
    lake, _ = months
    inputs = selection.selected_inputs(L.manifests(spark, lake)).where("month = '02'")
    assert selection.input_findings(inputs).count() == 0
    altered = {
        "COUNTS_DIFFER": ("input_row_count", F.col("input_row_count") + 1),
        "STAGING_DIGEST_INVALID": ("staging_sha256", F.lit("xyz")),
        "BOUNDS_REVERSED": ("last_valid_timestamp", F.to_timestamp_ntz(F.concat("source_date", F.lit(" 00:00:00")))),
        "MONTH_DIFFERS": ("month", F.lit("05")),
        "STAGING_SIZE": ("staging_byte_size", F.lit(0)),
        "MARKER_KIND": ("completion_marker_identity_kind", F.lit("md5")),
        "BOUNDS_MISSING": ("first_valid_timestamp", F.lit(None).cast("timestamp_ntz")),
    }
    for text, (name, value) in altered.items():
        found = {r["finding"] for r in selection.input_findings(inputs.withColumn(name, value)).collect()}
        assert text in found, text
    moved = inputs.withColumn("staging_sha256", F.sha2("staging_sha256", 256))
    texts = {r["finding"] for r in selection.marker_findings(moved, L.manifests(spark, lake)).collect()}
    assert texts == {"MARKER_CONFLICT"}
    gone = selection.marker_findings(inputs, L.manifests(spark, lake).limit(0)).collect()
    assert {r["finding"] for r in gone} == {"MARKER_GONE"}


def test_publication_and_audit(spark, months):
    lake, _ = months
    name = f"t_{uuid.uuid4().hex[:8]}"
    catalog.create_table(spark, name, f"{lake.root}/catalog")
    runs = L.read_months(spark, lake.control("compaction_run"))
    inventory = audit.inventory_from_runs(runs, lake)
    rows = inventory.orderBy("month").collect()
    publish_one = lambda r, e=None: catalog.publish_partition(spark, name, r["year"], r["month"], r["location"], e)
    assert [publish_one(rows[0]), publish_one(rows[0])] == ["created", "no_op"]
    with pytest.raises(catalog.PublicationConflict):
        publish_one(rows[1], "/elsewhere")
    drift = catalog.publication_drift(inventory, catalog.partitions(spark, name)).collect()
    assert [(r["month"], r["finding"]) for r in drift] == [("03", "PARTITION_MISSING")]

    findings = audit.audit_months(spark, lake, inventory, catalog.partitions(spark, name))
    summary = audit.audit_summary(inventory, findings).first()
    assert (summary["status"], summary["drift_count"], summary["fatal_count"]) == ("failed", 1, 0)
    publish_one(rows[1])
    published = catalog.partitions(spark, name)
    assert spark.table(name).count() == 90
    findings = audit.audit_months(spark, lake, inventory, published)
    summary = audit.audit_summary(inventory, findings).first()
    assert (summary["status"], summary["total_curated_rows"], summary["cross_gap_count"]) == ("passed", 90, 1)
    assert summary["global_gap_count"] == summary["within_gap_count"] + 1

    tight = audit.audit_months(spark, lake, inventory, published, AuditBounds(1, 1, 1, 1)).collect()
    assert sum(r["severity"] == "fatal" for r in tight) == 5
    wrong = inventory.withColumn("first_timestamp", F.col("first_timestamp") - F.expr("interval 1 second"))
    fatal = {r["finding"] for r in audit.audit_months(spark, lake, wrong, published).where("severity = 'fatal'").collect()}
    assert fatal == {
        "CURATED_BOUNDS_DIFFER", "COMPLETION_DIFFERS",
    }
    assert audit.inventory_findings(spark, inventory, date(2020, 2, 1), date(2020, 3, 10), 90).count() == 0
    texts = {
        r["finding"] for r in audit.inventory_findings(spark, inventory.where("month = '02'"), date(2020, 2, 1), date(2020, 3, 10), 90).collect()
    }
    assert texts == {
        "MONTHS_DIFFER", "TOTAL_ROWS_DIFFER",
    }
    one = audit.inventory_identity(inventory).first()[0]
    assert one == audit.inventory_identity(inventory.orderBy(F.desc("month"))).first()[0] and len(one) == 64


def test_catalog_schema_is_checked(spark):
    name = f"t_{uuid.uuid4().hex[:8]}"
    spark.sql(f"create table {name} (record_index bigint, year string, month string) using parquet partitioned by (year, month)")
    with pytest.raises(catalog.PublicationConflict, match="TABLE_SCHEMA"):
        catalog.check_schema(spark, name)
    with pytest.raises(catalog.PublicationConflict, match="LOCATION_SHAPE"):
        catalog.publish_partition(spark, name, "2020", "02", "/somewhere/")


def test_stream_is_idempotent_and_isolates_failures(spark, tmp_path):
    lake = build(tmp_path / "lake")
    write_object(lake.raw, "2020-02-03", day_lines("2020-02-03", 3), header="a,b")
    (Path(lake.raw) / "stray.txt").write_text("x\n")
    checkpoint = str(tmp_path / "checkpoint")

    def drain():
        ingest.start(spark, lake, RUN, checkpoint).awaitTermination()
        return {(r["batch_id"], r["raw_key"].rsplit("/", 1)[-1], r["outcome"]) for r in ingest.outcomes(spark, lake).collect()}

    first = drain()
    assert first == {
        (0, "source_date=2020-02-01", "processed"), (0, "source_date=2020-02-02", "processed"),
        (0, "source_date=2020-02-03", "failed"), (0, "stray.txt", "rejected_key"),
    }
    assert drain() == first
    folder = write_object(lake.raw, "2020-02-01", day_lines("2020-02-01", 7), name="part-1.csv")
    (folder / "data.csv").unlink()
    assert drain() - first == {(1, "source_date=2020-02-01", "rebuilt")}


def test_stream_sees_replaced_and_empty_objects_by_itself(spark, tmp_path):
    lake = build(tmp_path / "lake", bad_on=None)
    folder = Path(lake.raw) / "source_date=2020-02-09"
    folder.mkdir()
    (folder / "data.csv").write_bytes(b"")
    for near in ("source_date=2020-02-08/data.csv.gz", "source_date=2020-02-08/deep/data.csv", "x/source_date=2020-02-08/data.csv"):
        path = Path(lake.raw) / near
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x\n")
    checkpoint = str(tmp_path / "checkpoint")

    def drain():
        ingest.run_available(spark, lake, RUN, checkpoint, 3)
        return sorted((r["batch_id"], r["raw_key"].split("source_date=")[-1], r["outcome"], r["error"]) for r in ingest.outcomes(spark, lake).collect())

    first = drain()
    assert {r[1:3] for r in first} == {
        ("2020-02-01", "processed"), ("2020-02-02", "processed"), ("2020-02-09", "failed"), ("2020-02-08/data.csv.gz", "rejected_key"),
        ("2020-02-08/deep/data.csv", "rejected_key"), ("2020-02-08/data.csv", "rejected_key"),
    }
    assert len(first) == 6 and {r[0] for r in first} == {0, 1} and [r[3] for r in first if r[2] == "failed"] == ["BATCH_EMPTY_INPUT"]
    assert drain() == first
    write_object(lake.raw, "2020-02-02", day_lines("2020-02-02", 9))
    write_object(lake.raw, "2020-02-09", day_lines("2020-02-09", 4))
    second = drain()
    assert [r[:3] for r in second if r not in first] == [(2, "2020-02-02", "rebuilt"), (2, "2020-02-09", "processed")]
    assert drain() == second


def test_stream_refuses_oversized_objects(spark, tmp_path):
    lake = build(tmp_path / "lake", days=("2020-02-01",), bad_on=None)
    small = publish.Run("1.0.0", "2020-10-01T00:00:00Z", size_limit=100)
    ingest.start(spark, lake, small, str(tmp_path / "checkpoint")).awaitTermination()
    row = ingest.outcomes(spark, lake).first()
    assert (row["outcome"], row["error"]) == ("failed", "INPUT_TOO_LARGE")
    large = publish.too_large(spark, lake, small)
    assert [r["raw_byte_size"] > 100 for r in large.collect()] == [True]
    assert publish.raw_evidence(spark, lake, small, without=large).count() == 0


@pytest.mark.parametrize("version,at", [(" ", "2020-10-01T00:00:00Z"), ("1", "2020-10-01T00:00:00+02:00")])
def test_run_context_is_checked(version, at):
    with pytest.raises(ValueError):
        publish.Run(version, at)


def test_digest_reads_in_chunks(spark, tmp_path):
    (tmp_path / "d").mkdir()
    body = bytes(range(256)) * 50
    (tmp_path / "d" / "a.bin").write_bytes(body)
    (tmp_path / "d" / "b.bin").write_bytes(b"x")
    sums = {r["file_path"].rsplit("/", 1)[-1]: (r["byte_size"], r["sha256"]) for r in objects.file_checksums(spark, str(tmp_path / "d"), "*", 7).collect()}
    assert sums == {
        "a.bin": (len(body), hashlib.sha256(body).hexdigest()), "b.bin": (1, hashlib.sha256(b"x").hexdigest()),
    }


def test_audit_sees_stray_and_damaged_quarantine(spark, tmp_path):
    lake = build(tmp_path / "staging")
    publish.publish_days(spark, lake, RUN)
    assert audit.lake_failures(audit.lake_evidence(spark, lake)).count() == 0
    clean = L.manifests(spark, lake).where("source_date = date'2020-02-01'").first()
    stray = Path(lake.root) / f"quarantine/source={lake.source}/source_date=2020-02-01/input_id={clean['input_id']}"
    stray.mkdir(parents=True)
    (stray / "part-0.json").write_text("{}\n")
    unknown = Path(lake.root) / f"quarantine/source={lake.source}/source_date=2020-02-20/input_id=x"
    unknown.mkdir(parents=True)
    (unknown / "part-0.json").write_text("not json\n")
    found = {(str(r["source_date"]), r["failure"]) for r in audit.lake_failures(audit.lake_evidence(spark, lake)).collect()}
    assert found == {
        ("2020-02-01", "QUARANTINE_UNEXPECTED"),
        ("2020-02-20", "QUARANTINE_WITHOUT_MANIFEST"), ("2020-02-20", "QUARANTINE_DAMAGED"),
    }
    assert not audit.lake_summary(audit.lake_evidence(spark, lake)).first()["verified"]
