"""Session settings and the shared staging area.

``stage`` cuts lineage by writing a table and reading it back. Staged tables live under the
folder the cluster names in ``spark.checkpoint.dir``, so losing an executor loses nothing,
and because the files have known sizes Spark's own size check decides whether a later join
broadcasts them or shuffles.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_STAGING_KEY = "spark.checkpoint.dir"
_LISTING_KEY = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def session(app_name: str = "gaugelake", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a local master without a setting."""
    folder = spark.conf.get(_STAGING_KEY, None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {_STAGING_KEY} to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-gaugelake-")
        spark.conf.set(_STAGING_KEY, folder)
    return f"{folder.rstrip('/')}/gaugelake/{spark.sparkContext.applicationId}"


def share_listings(spark: SparkSession) -> None:
    """List folders by a few tasks a core, unless the session says how many.

    By default every folder of a lake, so every calendar day, is a task of each listing.
    """
    if spark.conf.get(_LISTING_KEY, None) is None:
        spark.conf.set(_LISTING_KEY, 4 * spark.sparkContext.defaultParallelism)


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """``df`` written and read back. Tables of all rows, which are never broadcast, take a dense
    ``codec``; others keep one whose file size says how large they are in memory."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, size: int | None, bytes_each: int = 128 << 20) -> int:
    """Partitions for a write of ``size`` bytes: the session's number, or more for large data."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, (size or 0) // bytes_each + 1)


def together(spark: SparkSession, *actions: Callable[[], object]) -> list:
    """Run independent Spark actions at the same time and return their results in order."""
    with ThreadPoolExecutor(max_workers=len(actions)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(action)) for action in actions]
        return [job.result() for job in started]


def clear_stage(spark: SparkSession) -> None:
    """Delete everything this application staged."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
