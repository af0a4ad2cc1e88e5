"""A streaming source whose offsets are versions of a folder listing.

A file source remembers names, so a file replaced in place is never seen again. Here an offset
names a listing: every file with its size, its time and the version in which it last changed.
A trigger lists the folder, and what is new or differs in size or time becomes the next version,
written beside the checkpoint before the offset is logged. A batch is what changed after one
version up to another, so replaying an offset after a failure gives the same files, and a
restart from a checkpoint repeats nothing. Files that were deleted leave the listing.

``max_files`` bounds a version; what is left over becomes the next ones. Listings travel as
paths, never as contents; they are read on the driver like any file source's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "listed_arrivals"
SCHEMA = "path string, byte_size long, modified timestamp"
_FILES_IN_TASK = 1_000


def listing_source() -> type[DataSource]:
    """The source class; it needs nothing of this package where it runs."""
    chunk, name_of, columns = _FILES_IN_TASK, NAME, SCHEMA

    class Files(InputPartition):
        def __init__(self, rows):
            self.rows = rows

    class Reader(DataSourceStreamReader):
        def __init__(self, options):
            from pyarrow import fs

            self.most = int(options.get("maxfiles", "0"))
            self.system, self.root = fs.FileSystem.from_uri(options["path"])
            given = options["path"].rstrip("/")
            head = given[: len(given) - len(self.root.rstrip("/"))] if given.endswith(self.root.rstrip("/")) else ""
            self.prefix = head or ("file:" if self.root.startswith("/") else "")
            self.books, self.book = fs.FileSystem.from_uri(options["book"])
            self.books.create_dir(self.book, recursive=True)

        def _versions(self):
            from pyarrow import fs

            found = self.books.get_file_info(fs.FileSelector(self.book, allow_not_found=True))
            return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit())

        def _load(self, version):
            """path: [size, time, version of the last change]"""
            import json

            if not version:
                return {}
            with self.books.open_input_stream(f"{self.book}/{version}.json") as stream:
                return json.loads(stream.read())

        def _now(self):
            from pyarrow import fs

            found = {}
            for f in self.system.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True)):
                below = f.path[len(self.root.rstrip("/")) + 1 :].split("/")
                if f.type == fs.FileType.File and not any(part[:1] in "._" for part in below):
                    found[self.prefix + f.path] = [f.size, f.mtime_ns // 1_000]
            return found

        def initialOffset(self):
            return {"version": 0}

        def latestOffset(self):
            import json

            last = max(self._versions(), default=0)
            known, now = self._load(last), self._now()
            changed = [p for p, state in now.items() if known.get(p, ())[:2] != state]
            if not changed:
                return {"version": last}
            changed.sort(key=lambda p: (now[p][1], p))
            version = last + 1
            kept = {p: state for p, state in known.items() if p in now}
            kept |= {p: [*now[p], version] for p in (changed[: self.most] if self.most else changed)}
            # A complete file under its final name, or none.
            with self.books.open_output_stream(f"{self.book}/{version}.part") as stream:
                stream.write(json.dumps(kept).encode())
            self.books.move(f"{self.book}/{version}.part", f"{self.book}/{version}.json")
            return {"version": version}

        def partitions(self, start, end):
            rows = sorted(
                (p, size, time) for p, (size, time, changed) in self._load(end["version"]).items()
                if start["version"] < changed <= end["version"])
            return [Files(rows[i : i + chunk]) for i in range(0, len(rows), chunk)]

        def read(self, partition):
            from datetime import datetime, timezone

            for path, size, time in partition.rows:
                yield path, size, datetime.fromtimestamp(time / 1e6, timezone.utc)

        def commit(self, end):
            for version in self._versions():
                if version < end["version"]:
                    self.books.delete_file(f"{self.book}/{version}.json")

    class Listed(DataSource):
        @classmethod
        def name(cls):
            return name_of

        def schema(self):
            return columns

        def streamReader(self, schema):
            return Reader(self.options)

    return Listed


def read_arrivals(spark: SparkSession, folder: str, book: str, max_files: int | None = None) -> DataFrame:
    """Stream of (path, byte_size, modified): files that are new below ``folder`` or were replaced.

    ``book`` holds the listings; one stream owns it.
    """
    spark.dataSource.register(listing_source())
    reader = spark.readStream.format(NAME).option("path", folder).option("book", book)
    if max_files is not None:
        reader = reader.option("maxfiles", max_files)
    return reader.load()
