"""Raw line sources that keep original text and source positions.

An *object* is a directory: the canonical layout holds one file in it, a large day holds an
ordered sequence of part files. Line order inside an object is (file, byte block, line).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugelake import contract
from gaugelake.functions import parsing
from gaugelake.session import stage

SOURCE_DATE_KEY = r"/source_date=(\d{4}-\d{2}-\d{2})/[^/]+$"


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Every line with its file and scan position; nothing is parsed or dropped.

    ``scan_id`` rises with line order inside a file block. Positions belong to one scan, so
    stage what is derived from this frame before deriving row numbers from it.
    """
    meta = F.col("_metadata")
    return (
        spark.read.option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
        .text([paths] if isinstance(paths, str) else list(paths))
        .select(
            F.col("value").alias("line"),
            meta["file_path"].alias("file_path"),
            meta["file_size"].alias("file_size"),
            meta["file_block_start"].alias("block_start"),
            F.monotonically_increasing_id().alias("scan_id"),
        )
    )


SCANNED = ("line", "file_path", "file_size", "block_start", "scan_id")


def _state_at(entry: Column, fixed: Column, turned: Column) -> Column:
    """State after lines whose last fixed one left ``fixed`` (null: none), with ``turned`` turns since."""
    return F.pmod(F.coalesce(fixed["state"], entry) + turned - F.coalesce(fixed["turns"], F.lit(0)), F.lit(2))


def _steps(frame: DataFrame, keys: list[str], order: str, at_end: bool) -> DataFrame:
    """Add ``fixed`` and ``turned``: what the lines up to a row do to the quoting state.

    Every line (or block) maps the two states, outside and inside a quoted field, to themselves
    (no ``from_0``), both to one, or each to the other. Such maps compose associatively: what
    counts is the last one that fixes the state and the parity of turns since, which running
    windows give for any number of lines. ``at_end`` includes the row itself.
    """
    turn = (F.col("from_0") == 1) & (F.col("from_1") == 0)
    fixes = F.col("from_0") == F.col("from_1")
    so_far = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    window = so_far if at_end else so_far.rowsBetween(W.unboundedPreceding, -1)
    counted = frame.withColumn("turns", F.coalesce(F.sum(turn.cast("int")).over(so_far), F.lit(0)))
    fixed = F.when(fixes, F.struct(F.col("from_0").alias("state"), "turns"))
    return counted.select(
        "*", F.last(fixed, True).over(window).alias("fixed"),
        F.coalesce(F.sum(turn.cast("int")).over(window), F.lit(0)).alias("turned"),
    ).drop("turns")


def joined_records(lines: DataFrame) -> DataFrame:
    """Records from the physical lines of a scan: a newline inside quotes does not end one.

    ``lines`` is a staged scan (``SCANNED`` columns). Whether a line starts inside quotes depends
    on all lines before it, so every block is reduced to its effect on the quoting state, the
    effects of a file's blocks are composed by a running window over one row a block, and then
    each block finds its record starts by itself. Blocks without a quoted newline keep their
    lines as they are; in others ``scan_id`` becomes the record's number in the block where it
    starts, and only lines of longer records are grouped, by record. A file that ends inside
    quotes keeps its lines, one of which is malformed.
    """
    block = ["file_path", "block_start"]
    line = F.col("line")
    quoted = line.contains('"')
    # A line read from inside quotes is one read from outside with a quote before it.
    effects = lines.select(
        *SCANNED,
        F.when(quoted, parsing.csv_leaves_open(line).cast("int")).alias("from_0"),
        F.when(quoted, parsing.csv_leaves_open(F.concat(F.lit('"'), line)).cast("int")).alias("from_1"),
    )
    marks = stage(effects.where(F.col("from_0").isNotNull()).select(*block, "scan_id", "from_0", "from_1"), "quotes")
    ends = _steps(marks, block, "scan_id", True).groupBy(*block).agg(
        F.max_by(F.struct("fixed", "turned"), "scan_id").alias("end"), F.max("from_0").alias("opens"))
    ends = lines.select(*block).distinct().join(ends, block, "left")
    of = lambda entry: _state_at(F.lit(entry), F.col("end.fixed"), F.coalesce("end.turned", F.lit(0)))
    # A block without quotes leaves both states as they are.
    ends = ends.select(*block, "opens", of(0).cast("int").alias("from_0"), of(1).cast("int").alias("from_1"))
    entries = _steps(ends, ["file_path"], "block_start", False)
    entries = entries.withColumn("entry", _state_at(F.lit(0), F.col("fixed"), F.col("turned")).cast("int"))
    leaves = F.when(F.col("entry") == 0, F.col("from_0")).otherwise(F.col("from_1"))
    # One row a block, and one a file.
    entries = entries.select(*block, "entry", "opens", leaves.alias("leaves"))
    last = entries.groupBy("file_path").agg(F.max_by("leaves", "block_start").alias("open"))
    dirty = stage(
        entries.join(last.where("open = 0"), "file_path", "left_semi")
        .where((F.col("entry") == 1) | (F.col("opens") == 1)).select(*block, "entry"), "quoted-blocks")
    clean = lines.select(*SCANNED).join(dirty, block, "left_anti")

    found = _steps(effects.join(dirty, block), block, "scan_id", True)
    after = _state_at(F.col("entry"), F.col("fixed"), F.col("turned")).cast("int")
    in_block = W.partitionBy(*block).orderBy("scan_id")
    found = found.select(*SCANNED, "entry", after.alias("after"))
    found = found.withColumn("inside", F.coalesce(F.lag("after").over(in_block), F.col("entry")))
    # Records are numbered by their starts; number 0 continues a record of an earlier block.
    found = found.withColumn("record", F.sum(1 - F.col("inside")).over(in_block))
    found = stage(found.select(*SCANNED, "record", ((F.col("inside") == 1) | (F.col("after") == 1)).alias("shared")), "quoted-lines")
    counts = found.groupBy(*block).agg(F.max("record").alias("starts"))
    before = W.partitionBy("file_path").orderBy("block_start").rowsBetween(W.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("starts") > 0, F.struct(F.col("block_start").alias("block"), F.col("starts").alias("record"))), True)
    owners = counts.select(*block, owner.over(before).alias("owner"))
    carried = F.col("record") == 0
    parts = found.where("shared").join(owners, block).select(
        "file_path", "file_size", F.struct("block_start", "scan_id", "line").alias("part"),
        F.when(carried, F.col("owner.block")).otherwise(F.col("block_start")).alias("block_start"),
        F.when(carried, F.col("owner.record")).otherwise(F.col("record")).alias("scan_id"),
    )
    joined = parts.groupBy("file_path", "file_size", "block_start", "scan_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["line"]), "\n").alias("line"))
    single = found.where("not shared").select("line", "file_path", "file_size", "block_start", F.col("record").alias("scan_id"))
    return clean.unionByName(single).unionByName(joined.select(*SCANNED))


def with_joined_records(spark: SparkSession, checked: DataFrame, check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``checked`` with the files read again, record by record, whose lines are not records.

    ``checked`` is ``check`` of a scan, staged. A newline inside quotes shows as a malformed
    line, so only files that have one are looked at again.
    """
    files = stage(checked.where(~F.col("is_well_formed")).select("file_path").distinct(), "malformed")
    if files.isEmpty():
        return checked
    again = check(joined_records(checked.select(*SCANNED).join(files, "file_path", "left_semi")))
    return checked.join(files, "file_path", "left_anti").unionByName(stage(again, "records"))


def source_date_of(file_path: Column) -> Column:
    """Partition date named by an object path, null when the path is not canonical."""
    return F.nullif(F.regexp_extract(file_path, SOURCE_DATE_KEY, 1), F.lit("")).try_cast("date")


def plain_path(path: Column) -> Column:
    """One spelling for local paths, which some readers give with extra slashes."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def block_table(lines: DataFrame) -> DataFrame:
    """One row per file block: counts, first-line verdict and how many lines of the object
    precede it.

    The first line of an object is its header, so the first data row gets number 1. Only
    fixed-width values are aggregated, which keeps the pass over the lines free of sorting.
    """
    blocks = lines.groupBy("file_path", "block_start").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.min("scan_id").alias("first_scan_id"),
        F.max("scan_id").alias("last_scan_id"),
        F.min_by("is_header", "scan_id").alias("first_is_header"),
        F.sum(F.octet_length("line") + 1).alias("text_bytes"),
        F.max("file_size").alias("file_size"),
        F.bool_and("is_utf8").alias("is_utf8"),
        F.bool_and("is_well_formed").alias("is_well_formed"),
    )
    # File URLs arrive percent-encoded; paths are decoded here, once per block.
    decoded = plain_path(F.url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B"))))
    blocks = blocks.select(
        "*",
        F.regexp_replace(decoded, "/[^/]*$", "").alias("object_key"),
        source_date_of(decoded).alias("source_date"),
    )
    # Part files sort by name; a longer name means a higher part number.
    in_object = W.partitionBy("object_key").orderBy(
        F.length("file_path"), "file_path", "block_start"
    )
    in_file = W.partitionBy("object_key", "file_path")
    surplus = F.sum("text_bytes").over(in_file) - F.col("file_size")
    return blocks.select(
        "*",
        (
            F.sum("line_count").over(in_object) - F.col("line_count")
        ).alias("lines_before"),
        # A byte-order mark is three bytes the reader drops; a missing final newline is one
        # byte counted but not stored.
        (
            surplus.isin(1, -2)
            & (F.col("block_start") == F.max("block_start").over(in_file))
        ).alias("ends_without_newline"),
    )


def object_table(blocks: DataFrame) -> DataFrame:
    """One row per object: header gate, row count and encoding state."""
    return (
        blocks.groupBy("object_key")
        .agg(
            F.min_by("first_is_header", "lines_before").alias("has_header"),
            (F.sum("line_count") - 1).alias("input_row_count"),
            F.bool_and("is_utf8").alias("is_utf8"),
            F.bool_and("is_well_formed").alias("is_well_formed"),
            F.min("source_date").alias("source_date"),
        )
        .select(
            "object_key",
            "source_date",
            "input_row_count",
            "is_utf8",
            "is_well_formed",
            (~F.col("has_header")).alias("schema_drift"),
            (F.col("input_row_count") == 0).alias("empty_input"),
        )
    )


def with_row_numbers(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """``lines`` plus ``source_row_number`` (0 is the header) and the exact original text.

    The block table is staged by the caller; its file size decides how Spark joins it. Even
    shuffled, a key holds one block of rows.
    """
    keys = ["file_path", "block_start"]
    position = blocks.select(
        *keys, "object_key", "source_date", "first_scan_id", "last_scan_id", "lines_before", "ends_without_newline"
    )
    last_line = F.col("ends_without_newline") & (F.col("scan_id") == F.col("last_scan_id"))
    return lines.join(position, keys).select(
        *lines.columns,
        "object_key",
        "source_date",
        (F.col("scan_id") - F.col("first_scan_id") + F.col("lines_before")).alias(
            "source_row_number"
        ),
        F.concat("line", F.when(last_line, "").otherwise("\n")).alias("original_record"),
    )


def checked_lines(lines: DataFrame) -> DataFrame:
    """Add per-line verdicts: strict UTF-8, well-formed CSV, equal to the contract header."""
    line = F.col("line")
    plain = ",".join(contract.SOURCE_HEADER)
    names = F.array(*[F.lit(name) for name in contract.SOURCE_HEADER])
    quoted = line.contains('"') & line.contains(contract.SOURCE_HEADER[-1])
    return lines.select(
        "*",
        F.is_valid_utf8("line").alias("is_utf8"),
        parsing.csv_is_well_formed(line).alias("is_well_formed"),
        F.when(quoted, parsing.csv_fields(line) == names)
        .otherwise(parsing.without_carriage_return(line) == plain)
        .alias("is_header"),
    )
