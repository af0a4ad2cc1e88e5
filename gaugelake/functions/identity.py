"""Canonical JSON text and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEX64 = r"^[0-9a-f]{64}$"


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys and nulls kept."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def pinned_kind(version_id: Column, checksum: Column, etag: Column) -> Column:
    """The strongest identity an object carries; an empty token counts as none."""
    present = [F.nullif(c, F.lit("")) for c in (version_id, checksum, etag)]
    return (
        F.when(present[0].isNotNull(), "version_id")
        .when(present[1].isNotNull(), "sha256")
        .when(present[2].isNotNull(), "etag")
    )


def pinned_value(version_id: Column, checksum: Column, etag: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (version_id, checksum, etag)])


def processing_identity(
    bucket: Column,
    key: Column,
    version_id: Column,
    checksum: Column,
    etag: Column,
    pipeline_version: Column,
    schema_version: Column,
    manifest_version: Column,
) -> Column:
    """Identity of one object under one set of versions; null when nothing pins the object."""
    kind = pinned_kind(version_id, checksum, etag)
    text = canonical_json(
        manifest_version=manifest_version,
        object_identity_kind=kind,
        object_identity_value=pinned_value(version_id, checksum, etag),
        pipeline_version=pipeline_version,
        schema_version=schema_version,
        source_bucket=bucket,
        source_key=key,
    )
    return F.when(kind.isNotNull(), sha256(text))


def content_fingerprint(df: DataFrame, groups: list[str], columns: list[str]) -> DataFrame:
    """Order-independent content hash per group: row count and sum of row hashes."""
    row_hash = F.xxhash64(*columns).cast("decimal(38,0)")
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum(row_hash).cast("string").alias("row_hash_sum"),
    )
