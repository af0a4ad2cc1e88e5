"""Ordered, repeat and quantile operators against brute force, with hot groups."""

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugelake.contract import Thresholds
from gaugelake.functions import wallclock
from gaugelake.operators import continuity, metrics, ordered, profile, quantiles, repeats

BASE = datetime(2024, 3, 9, 22, 0, 0)


def series(spark, n=2000, seed=1):
    """One object holds most rows, crosses a DST change and runs backwards at times."""
    rng = random.Random(seed)
    clocks, rows = Counter(), []
    for i in range(n):
        name = "hot" if rng.random() < 0.7 else f"g{rng.randrange(5)}"
        clocks[name] += rng.choice([0, 1, 10, 12, 59, 60, 61, 61.5, 200, 5000, -30])
        ts = None if rng.random() < 0.05 else BASE + timedelta(seconds=clocks[name])
        rows.append((name, i, ts))
    return rows, spark.createDataFrame(rows, "g string, n long, ts timestamp_ntz")


def truncated(a, b):
    return int((b - a).total_seconds())


def test_deltas_match_brute_force(spark):
    rows, frame = series(spark)
    expected, last = Counter(), {}
    for g, _, ts in rows:
        if ts is None:
            continue
        if g in last:
            expected[g, truncated(last[g], ts)] += 1
        last[g] = ts
    for width in (7, 100, 10**6):
        found = metrics.interval_counts(ordered.deltas(frame, ["g"], "n", "ts", width), ["g"]).collect()
        assert {(r["g"], r["seconds"]): r["interval_count"] for r in found} == expected


def test_sliced_lag_matches_brute_force(spark):
    rows, frame = series(spark)
    expected, last = {}, {}
    for g, n, ts in rows:
        expected[n] = last.get(g)
        last[g] = ts
    found = ordered.sliced_lag(frame, ["g"], "n", ["ts"], 13).collect()
    assert {r["n"]: r["previous_ts"] for r in found} == expected


def test_gaps_match_sorted_history(spark):
    rows, frame = series(spark)
    for limit in (60, 45, 100):
        present = sorted((ts, n) for _, n, ts in rows if ts is not None)
        expected = {
            n: (a, b) for (a, _), (b, n) in zip(present, present[1:]) if truncated(a, b) > limit
        }
        found = ordered.sampling_gaps(frame, [], "ts", "n", limit).collect()
        assert {r["n"]: (r["previous_ts"], r["ts"]) for r in found} == expected


def test_splitting_days_keeps_total_gaps(spark):
    _, frame = series(spark)
    ordered_rows = frame.where("ts is not null").withColumn("day", F.to_date("ts"))
    whole = ordered.sampling_gaps(ordered_rows, [], "ts", "n", 60).count()
    inside = ordered.sampling_gaps(ordered_rows, ["day"], "ts", "n", 60).count()
    ends = ordered_rows.groupBy("day").agg(F.min("ts").alias("first_timestamp"), F.max("ts").alias("last_timestamp"))
    ends = ends.select(F.col("day").cast("string").alias("label"), F.col("day").alias("partition_date"),
                       "first_timestamp", "last_timestamp")
    between = continuity.boundaries(ends, Thresholds()).where("status = 'significant_gap'").count()
    assert whole == inside + between


def test_order_violations(spark):
    frame = spark.createDataFrame([(1, i, v) for i, v in enumerate([1, 2, 2, 1, 5, 4, 4, 9])], "g int, n long, v int")
    for width in (1, 3, 100):
        assert ordered.order_violations(frame, ["g"], "n", ["v"], width).first()["violations"] == 2


def test_wallclock_ignores_session_zone(spark):
    frame = spark.sql(
        "select timestamp_ntz'2024-03-10 01:59:50' a, timestamp_ntz'2024-03-10 02:00:50.9' b"
    )
    assert frame.select(wallclock.seconds_between(F.col("a"), F.col("b"))).first()[0] == 60
    assert frame.select(wallclock.seconds_between(F.col("b"), F.col("a"))).first()[0] == -60


def test_repeat_flags_with_heavy_and_null_keys(spark):
    rng = random.Random(3)
    rows = [
        (i, "a" if rng.random() < 0.8 else "b",
         rng.choice([7] * 30 + [None] * 10 + list(range(100, 160))), rng.choice([None, 1, 2]) if i % 9 else i + 1000)
        for i in range(900)
    ]
    frame = spark.createDataFrame(rows, "n long, g string, k long, m long")
    ks, ms = Counter((r[1], r[2]) for r in rows), Counter((r[1], r[3]) for r in rows)
    found = repeats.flag_repeats(frame, ["g"], {"rk": "k", "rm": "m"}, ["n"]).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["rk"] == (r["k"] is not None and ks[r["g"], r["k"]] > 1)
        assert r["rm"] == (r["m"] is not None and ms[r["g"], r["m"]] > 1)


def test_null_groups_have_gaps_too(spark):
    rows = [(None, 1, "2020-01-01 00:00:00"), (None, 2, "2020-01-01 05:00:00"), (1, 3, "2020-01-01 00:00:00"), (1, 4, "2020-01-02 01:00:00")]
    frame = spark.createDataFrame(rows, "g long, n long, t string").selectExpr("g", "n", "cast(t as timestamp_ntz) as ts")
    gaps = ordered.sampling_gaps(frame, ["g"], "ts", "n", 3600).collect()
    assert {(r["g"], r["n"], r["interval_seconds"]) for r in gaps} == {(None, 2, 18_000), (1, 4, 90_000)}
    lagged = ordered.sliced_lag(frame, ["g"], "n", ["n"], 1).collect()
    assert {(r["n"], r["previous_n"]) for r in lagged} == {(1, None), (2, 1), (3, None), (4, 3)}


@pytest.mark.parametrize("accuracy", [3, 40, 20_000])
def test_column_quantiles_by_brackets(spark, accuracy):
    """A coarse sketch misses and is widened; answers stay exact."""
    rng = np.random.default_rng(6)
    values = np.concatenate([np.full(4000, 3.25), rng.lognormal(2, 3, 5000), [-1e12, 1e12, np.inf]])
    rows = [(float(v), None if i % 3 else i, None, 7) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "a double, b int, none double, same long").repartition(6)
    probs = [0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    found = quantiles.column_quantiles(frame, ["a", "b", "none", "same"], probs, accuracy).collect()
    seen = {(r["column_name"], r["prob"]): r["quantile"] for r in found}
    assert len(seen) == len(found) == 3 * len(probs)
    b = [float(i) for i in range(len(values)) if i % 3 == 0]
    for p in probs:
        assert np.isclose(seen["a", p], np.quantile(values, p), rtol=1e-12)
        assert np.isclose(seen["b", p], np.quantile(b, p), rtol=1e-12)
        assert seen["same", p] == 7
    assert quantiles.column_quantiles(frame.limit(0), ["a"], probs).count() == 0


def test_column_quantiles_shuffle_no_values(spark):
    """What is grouped are gaps between brackets and the few values inside them."""
    frame = spark.range(50_000).select((F.xxhash64("id") / 1e6).alias("a"))
    low, high = frame.agg(F.percentile_approx("a", F.array(F.lit(0.4999), F.lit(0.5001)), 20_000)).first()[0]
    counts = quantiles._bracket_counts(frame, {"a": [(low, high)]})
    assert counts.count() < 60 and counts.agg(F.sum("n")).first()[0] == 50_000


def test_excess_counts_null_groups(spark):
    frame = spark.createDataFrame([(1,), (1,), (1,), (None,), (None,), (2,)], "k long")
    assert repeats.excess_rows(frame, ["k"], "n").first()["n"] == 3


def test_quantiles_are_exact_with_hot_values_and_nulls(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([np.full(4000, 3.25), rng.lognormal(2, 3, 5000), [-1e12, 1e12]])
    frame = spark.createDataFrame([(float(v), None if i % 3 else float(i)) for i, v in enumerate(values)], "a double, b double")
    probs = [0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1]
    counts = quantiles.value_counts(frame, ["a", "b"])
    for branch in (2, 32):
        found = quantiles.weighted_quantiles(counts, "column_name", "value", "row_count", probs, branch).collect()
        seen = {(r["column_name"], r["prob"]): r["quantile"] for r in found}
        b = [float(i) for i in range(len(values)) if i % 3 == 0]
        for p in probs:
            assert np.isclose(seen["a", p], np.quantile(values, p), rtol=1e-12)
            assert np.isclose(seen["b", p], np.quantile(b, p), rtol=1e-12)


def test_weighted_medians(spark):
    frame = spark.createDataFrame([("x", 1, 2), ("x", 5, 1), ("x", 9, 1), ("y", 4, 3)], "g string, v long, w long")
    found = quantiles.weighted_medians(frame, ["g"], "v", "w").collect()
    assert {r["g"]: r["median"] for r in found} == {"x": 3.0, "y": 4.0}


def test_representative_days(spark):
    days = [("2020-01-01", 5), ("2020-01-02", 10), ("2020-01-03", 20), ("2020-01-04", 100)]
    frame = spark.createDataFrame(days, "d string, day_rows long").select(F.to_date("d").alias("day"), "day_rows")
    found = {r["label"]: str(r["day"]) for r in profile.representative_days(frame).collect()}
    assert found == {"small": "2020-01-01", "median": "2020-01-03", "largest": "2020-01-04"}
    assert profile.representative_days(frame.limit(2)).count() == 0


def test_size_estimate_rounds_half_to_even(spark):
    frame = spark.createDataFrame([(5, 2, 1), (15, 2, 1), (10, 3, 1)], "b long, t long, r long")
    found = frame.select(profile.estimated_bytes(F.col("b"), F.col("t"), F.col("r"))).collect()
    assert [r[0] for r in found] == [2, 8, 3]


def test_boundary_statuses(spark):
    t = lambda text: datetime.fromisoformat(text)
    points = [
        ("1", "2020-02-01", t("2020-02-01 00:00:00"), t("2020-02-01 23:59:50")),
        ("2", "2020-02-02", t("2020-02-02 00:00:00"), t("2020-02-02 23:00:00")),
        ("3", "2020-02-04", t("2020-02-04 00:00:00"), t("2020-02-05 00:00:10")),
        ("4", "2020-02-05", t("2020-02-05 00:00:10"), t("2020-02-06 00:00:10")),
        ("5", "2020-02-06", t("2020-02-06 00:00:00"), t("2020-02-06 23:59:30")),
        ("6", "2020-02-07", None, None),
        ("7", "2020-02-08", t("2020-02-08 00:00:00"), t("2020-02-08 23:59:30")),
        ("8", "2020-02-09", t("2020-02-09 00:00:00"), t("2020-02-09 00:00:00")),
    ]
    frame = spark.createDataFrame(points, "label string, d string, first_timestamp timestamp_ntz, last_timestamp timestamp_ntz")
    found = continuity.boundaries(frame.withColumn("partition_date", F.to_date("d")), Thresholds()).orderBy("current_label").collect()
    assert [(r["status"], r["delta_seconds"], r["missing_calendar_date_count"]) for r in found] == [
        ("normal", 10, 0), ("significant_gap", 90000, 1), ("overlap", 0, 0), ("reversed_overlap", -10, 0),
        (continuity.UNASSESSABLE, None, 0), (continuity.UNASSESSABLE, None, 0), ("abnormal_positive_interval", 30, 0),
    ]


def manifests_and_parts(spark, gap=10, valid=(3, 3), parseable=3, observed=2):
    start = datetime(2020, 2, 1, 23, 59, 30)
    manifests = spark.createDataFrame(
        [("2020-02-01", 3, valid[0], 3, parseable, "1", "1"), ("2020-02-02", 3, valid[1], 3, 3, "1", "1")],
        "d string, input_row_count long, valid_timestamp_count long, valid_row_count long,"
        " parseable_timestamp_count long, pipeline_version string, schema_version string",
    ).withColumn("source_date", F.to_date("d"))
    within = spark.createDataFrame([("2020-02-01", 10, observed), ("2020-02-02", 10, 2)], "d string, seconds long, interval_count long")
    within = within.withColumn("source_date", F.to_date("d"))
    last = start + timedelta(seconds=20)
    first = last + timedelta(seconds=gap)
    points = spark.createDataFrame(
        [("2020-02-01", start, last), ("2020-02-02", first if valid[1] else None, first)],
        "label string, first_timestamp timestamp_ntz, last_timestamp timestamp_ntz",
    ).withColumn("partition_date", F.to_date("label"))
    findings = continuity.boundaries(points, Thresholds())
    counts = continuity.scoped_distributions(within, continuity.boundary_counts(findings))
    return manifests, within, continuity.interval_summaries(counts, "scope", Thresholds()), findings


def test_continuity_report_statuses(spark):
    ok = continuity.continuity_report(*manifests_and_parts(spark)).first()
    assert (ok["status"], ok["global_total_delta_count"], ok["one_schema_version"]) == ("passed", 5, True)
    gap = continuity.continuity_report(*manifests_and_parts(spark, gap=100), expected_gap_count=1).first()
    assert (gap["status"], gap["boundary_significant_gap_count"]) == ("passed", 1)
    assert continuity.continuity_report(*manifests_and_parts(spark, gap=100), expected_gap_count=0).first()["status"] == "failed"
    assert continuity.continuity_report(*manifests_and_parts(spark, observed=1)).first()["status"] == "failed"
    manifests, within, summaries, findings = manifests_and_parts(spark, valid=(3, 0))
    manifests = manifests.withColumn("valid_row_count", F.col("valid_timestamp_count"))
    assert continuity.continuity_report(manifests, within, summaries, findings).first()["status"] == "incomplete"


def test_alarms(spark):
    rows = spark.createDataFrame(
        [("2024-01-01 00:01:00", "QuarantineRate", 5.0), ("2024-01-01 00:06:00", "QuarantineRate", 5.1),
         ("2024-01-01 00:01:00", "PublicationDrift", 1.0), ("2024-01-01 00:11:00", "PublicationDrift", 0.0),
         ("2024-01-01 00:01:00", "InputRows", 99.0)],
        "t string, metric_name string, metric_value double",
    ).withColumn("at", F.col("t").cast("timestamp_ntz"))
    found = {(str(r["period_start"]), r["metric_name"], r["observed_value"]) for r in metrics.alarms(rows, "at").collect()}
    assert found == {
        ("2024-01-01 00:05:00", "QuarantineRate", 5.1), ("2024-01-01 00:00:00", "PublicationDrift", 1.0),
    }


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_lag_over_sparse_keys(spark, groups):
    """Keys in clusters over the whole 64-bit range: equal to one window, with few edges."""
    rng = random.Random(12)
    keys = {rng.randrange(-(2**63), 2**63) for _ in range(300)} | {2**62 + i for i in range(700)} | {-(2**63), 2**63 - 1, -5, 0}
    keys |= {7 * 10**17 + 1_000 * i for i in range(400)}
    rows = [(k, k % 1_001, rng.choice(["a", "b", "b", "b", None])) for k in keys]
    df = spark.createDataFrame(rows, "k long, v long, g string").repartition(5)
    window = W.partitionBy(*groups).orderBy("k")
    want = df.withColumn("previous_v", F.lag("v").over(window)).withColumn("previous_k", F.lag("k").over(window))
    got = ordered.sliced_lag(df, groups, "k", ["v", "k"], width=None, rows=20)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    slices = ordered.counted_slices(df, groups, "k", 20).groupBy(*groups, "slice_no").count()
    sizes = [r["count"] for r in slices.collect()]
    assert max(sizes) <= 80 and len(sizes) < len(rows) / 3
    assert ordered.sliced_lag(df.limit(0), groups, "k", ["v"], width=None).count() == 0
