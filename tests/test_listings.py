"""Listings of a lake with very many folders."""

from __future__ import annotations

from gaugelake.session import share_listings

KEY = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def listing_tasks(spark, folder, group):
    spark.sparkContext.setJobGroup(group, "listing")
    try:
        assert spark.read.schema("id long, day int").parquet(folder).columns == ["id", "day"]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds]
    return sum(tracker.getStageInfo(s).numTasks for s in stages)


def test_days_share_listing_tasks(spark, tmp_path):
    folder, before = str(tmp_path / "days"), spark.conf.get(KEY, None)
    spark.range(300).selectExpr("id", "cast(id as int) as day").repartition(4).write.partitionBy("day").parquet(folder)
    try:
        spark.conf.unset(KEY)
        assert listing_tasks(spark, folder, "a-task-a-folder") == 300
        share_listings(spark)
        assert 1 < listing_tasks(spark, folder, "shared") <= 4 * spark.sparkContext.defaultParallelism
        assert spark.read.parquet(folder).count() == 300
        spark.conf.set(KEY, 3)
        share_listings(spark)
        assert listing_tasks(spark, folder, "as-set") == 3
    finally:
        spark.conf.unset(KEY) if before is None else spark.conf.set(KEY, before)


def test_publication_shares_listings(spark, tmp_path):
    from gaugelake.plans import publish
    from gaugelake.plans.lake import Lake

    before = spark.conf.get(KEY, None)
    lake = Lake(str(tmp_path / "lake"))
    spark.range(1).selectExpr("'x' as value").write.text(f"{lake.raw}/source_date=2024-01-01")
    try:
        spark.conf.unset(KEY)
        publish.publish_days(spark, lake, publish.Run("1.0.0", "2024-02-01T00:00:00Z"))
        assert int(spark.conf.get(KEY)) == 4 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset(KEY) if before is None else spark.conf.set(KEY, before)
