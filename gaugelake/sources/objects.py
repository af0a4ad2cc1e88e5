"""Evidence about stored objects: sizes, checksums and Parquet footers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake import contract
from gaugelake.sources.raw import plain_path

# A digest reads this much at a time.
CHUNK_BYTES = 4 << 20
_PARENT = "/[^/]*$"


Folders = str | list[str]
Filter = Callable[[DataFrame], DataFrame]


def _files(spark: SparkSession, folder: Folders, glob: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(folder)
    )


def _digest_reader(chunk: int):
    """The per-task function: every file is read in chunks, whatever its size."""

    def read(batches):
        import hashlib
        import re

        import pandas as pd
        from pyarrow import fs

        for batch in batches:
            sums = []
            for path in batch["file_path"]:
                system, inner = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                digest = hashlib.sha256()
                with system.open_input_stream(inner) as stream:
                    while part := stream.read(chunk):
                        digest.update(part)
                sums.append(digest.hexdigest())
            yield pd.DataFrame({"file_path": batch["file_path"], "byte_size": batch["byte_size"], "sha256": sums})

    return read


def object_sizes(spark: SparkSession, folder: Folders, glob: str = "*") -> DataFrame:
    """(object_key, byte_size) per directory, from the listing alone."""
    path = plain_path(F.col("path"))
    files = _files(spark, folder, glob).select(F.regexp_replace(path, _PARENT, "").alias("object_key"), "length")
    return files.groupBy("object_key").agg(F.sum("length").alias("byte_size"))


def file_checksums(
    spark: SparkSession, folder: Folders, glob: str, chunk: int = CHUNK_BYTES, without: DataFrame | None = None,
    keep: Filter | None = None,
) -> DataFrame:
    """(file_path, byte_size, sha256) of every file below ``folder``.

    Only paths travel to the tasks; a file that can't be read fails its task. Spark's file
    listing leaves out empty files, so they have no row here. Objects named in ``without``
    (object_key) are left unread, as are files that ``keep`` drops from the listing.
    """
    tasks = 4 * spark.sparkContext.defaultParallelism
    paths = _files(spark, folder, glob).select(
        plain_path(F.col("path")).alias("file_path"), F.col("length").alias("byte_size")
    )
    if without is not None:
        left_out = without.select(F.col("object_key").alias("left_out"))
        paths = paths.join(left_out, F.regexp_replace("file_path", _PARENT, "") == F.col("left_out"), "left_anti")
    if keep is not None:
        paths = keep(paths)
    return paths.repartition(tasks, "file_path").mapInPandas(
        _digest_reader(chunk), "file_path string, byte_size long, sha256 string"
    )


def object_checksums(
    spark: SparkSession, folder: Folders, glob: str, chunk: int = CHUNK_BYTES, without: DataFrame | None = None,
    keep: Filter | None = None,
) -> DataFrame:
    """(object_key, byte_size, sha256, file_count) per directory.

    One file: its own digest. Several part files: digest of the ordered list of digests, a few
    dozen bytes per file.
    """
    digests = F.transform(
        F.sort_array(F.collect_list(F.struct(F.length("file_path"), "file_path", "sha256"))),
        lambda e: e["sha256"],
    )
    return (
        file_checksums(spark, folder, glob, chunk, without, keep)
        .groupBy(F.regexp_replace("file_path", _PARENT, "").alias("object_key"))
        .agg(
            F.sum("byte_size").alias("byte_size"),
            F.count(F.lit(1)).alias("file_count"),
            digests.alias("digests"),
        )
        .select(
            "object_key", "byte_size", "file_count",
            F.when(F.col("file_count") == 1, F.get("digests", F.lit(0)))
            .otherwise(F.sha2(F.array_join("digests", ","), 256)).alias("sha256"),
        )
    )


_FOOTER_SCHEMA = (
    "file_path string, row_count long, row_group_count long, largest_row_group long, "
    "codecs array<string>, columns array<string>, timestamp_zoned boolean, "
    "metadata_has_path boolean, is_readable boolean"
)


def _footer_reader(path_text: str, names: list[str]):
    """The per-task function, free of package imports so that any worker can load it."""

    def read(batches):
        import re

        import pandas as pd
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        path_pattern = re.compile(path_text)
        for batch in batches:
            found = []
            for path in batch["file_path"]:
                # Local paths need the three-slash form here.
                uri = re.sub("^file:/+", "file:///", path)
                try:
                    system, inner = fs.FileSystem.from_uri(uri)
                    with system.open_input_file(inner) as stream:
                        parquet = pq.ParquetFile(stream)
                        footer, schema = parquet.metadata, parquet.schema_arrow
                except (PermissionError, FileNotFoundError, ConnectionError, TimeoutError):
                    raise
                except (pa.ArrowInvalid, OSError):
                    # A damaged file is a finding of the caller, not a failed task.
                    found.append((path, None, None, None, [], [], False, False, False))
                    continue
                groups = [footer.row_group(g) for g in range(footer.num_row_groups)]
                codecs = {g.column(c).compression for g in groups for c in range(g.num_columns)}
                notes = [v.decode(errors="replace") for v in (schema.metadata or {}).values()]
                found.append((
                    path, footer.num_rows, len(groups),
                    max((g.num_rows for g in groups), default=0), sorted(codecs),
                    [f"{f.name}:{f.type}" for f in schema],
                    any(getattr(f.type, "tz", None) is not None for f in schema),
                    any(path_pattern.search(n) for n in notes), True,
                ))
            yield pd.DataFrame(found, columns=names)

    return read


def parquet_footers(spark: SparkSession, folder: Folders) -> DataFrame:
    """One row per Parquet file from its footer alone; data pages are not read.

    Only paths travel to the tasks. The partition count is given, because paths are so small
    that they would otherwise all be handed to one task.
    """
    tasks = 4 * spark.sparkContext.defaultParallelism
    paths = _files(spark, folder, "*.parquet").select(plain_path(F.col("path")).alias("file_path"))
    names = [column.split()[0] for column in _FOOTER_SCHEMA.split(", ")]
    reader = _footer_reader(contract.ABSOLUTE_PATH_ANYWHERE, names)
    return paths.repartition(tasks, "file_path").mapInPandas(reader, _FOOTER_SCHEMA)


# Physical types of the normalised schema as the footer reader names them. Spark stores
# zone-free timestamps in microseconds.
_FOOTER_TYPES = {
    "bigint": "int64", "timestamp_ntz": "timestamp[us]", "double": "double",
    "boolean": "bool", "date": "date32[day]", "string": "string",
}
NORMALIZED_FOOTER = tuple(
    f"{f.name}:{_FOOTER_TYPES[f.dataType.simpleString()]}" for f in contract.NORMALIZED_SCHEMA
)
