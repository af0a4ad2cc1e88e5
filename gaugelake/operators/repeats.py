"""Repeated keys: find them with partial counts, mark their rows without a hot task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.session import stage

def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with ``occurrences``. Null keys never repeat."""
    present = df
    for key in keys:
        present = present.where(F.col(key).isNotNull())
    return (
        present.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .where(F.col("occurrences") > 1)
    )


def flag_repeats(
    df: DataFrame, groups: Sequence[str], keys: Mapping[str, str], spread: Sequence[str],
) -> DataFrame:
    """``df`` plus one boolean per entry of ``keys`` (flag name to key column): does another
    row of the same group hold this row's key? Null keys never do.

    All keys are counted in one pass with partial counts. The staged table of repeated keys has
    one row a key, so Spark broadcasts it while it is small and else joins by key, splitting
    partitions that a frequent key makes large. Rows with a null key match nothing and are
    spread by ``spread``, columns that identify a row.
    """
    groups = list(groups)
    entries = F.array(
        *[
            F.struct(F.lit(flag).alias("flag"), F.col(key).cast("string").alias("key_text"))
            for flag, key in keys.items()
        ]
    )
    long = df.select(*groups, F.inline(entries))
    counts = stage(repeated_keys(long, [*groups, "flag", "key_text"]), "repeats")
    flagged = df
    for flag, key in keys.items():
        flagged = _flag(flagged, counts.where(F.col("flag") == flag), groups, flag, key, spread)
    return flagged


def _flag(
    df: DataFrame, counts: DataFrame, groups: list[str], flag: str, key: str, spread: Sequence[str],
) -> DataFrame:
    on = [*groups, "key_text", "salt"]
    known = counts.select(
        *groups, "key_text", F.lit(0).cast("bigint").alias("salt"), F.lit(True).alias("is_repeated")
    )
    salt = F.when(F.col("key_text").isNull(), F.pmod(F.xxhash64(*spread), F.lit(1 << 20)) + 1)
    keyed = df.withColumn("key_text", F.col(key).cast("string"))
    salted = keyed.withColumn("salt", F.coalesce(salt, F.lit(0).cast("bigint")))
    return salted.join(known, on, "left").select(*df.columns, F.col("is_repeated").isNotNull().alias(flag))


def excess_rows(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """How many rows would go if one row per key were kept. A null key is a key here."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return counts.agg(
        F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c") - 1)), F.lit(0)).alias(name)
    )


def keys_across(df: DataFrame, groups: Sequence[str], key: str, part: str) -> DataFrame:
    """Key values of a group present in more than one part, with first and last part."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(*groups, key)
        .agg(F.min(part).alias("first_part"), F.max(part).alias("last_part"),
             F.count(F.lit(1)).alias("row_count"))
        .where(F.col("first_part") < F.col("last_part"))
    )
