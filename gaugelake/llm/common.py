"""What the operators of this package share: text buffers, rolling hashes, sizes, components.

Text reaches Python as Arrow record batches and is worked on as one byte array per block of
about one megabyte, so the cost per word is a few vector operations.

Hashes are Rabin-Karp polynomials modulo 2^64 with a final mixing step. Two different
strings share a hash with a probability of about 2^-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugelake.session import stage

BLOCK_BYTES = 1 << 20
PIECE = 1 << 20
NO_ID = -(1 << 63)
_MASK = (1 << 64) - 1
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions_for(df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """Shuffle partitions for ``df``: the session's number, or more when the input is large.

    The size is Spark's own estimate for the plan, that of the files for a table.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(1_000_000, size // bytes_each if size < 1 << 60 else 0))


def keyed(docs: DataFrame) -> DataFrame:
    """Documents as place, text_key, text and ``rest``, a struct of all other columns.

    ``place`` is doc_id, with the smallest long for null; ``text_key`` tells rows that share a
    doc_id apart. Rows equal in both are one document. Other columns can have any name.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    text = F.col("text").cast("string")
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("place"),
        F.xxhash64(text).alias("text_key"),
        text.alias("text"),
        (F.struct("doc_id", *others)).alias("rest"),
    )


def unkeyed(docs: DataFrame) -> list:
    """The columns of ``docs``, in order, from a frame that carries ``text`` and ``rest``."""
    return [
        (F.col("text") if c == "text" else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns
    ]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ np.uint64((salt * 0xA24BAED4963EE407 + 0x2545F4914F6CDD1D) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, size: int) -> np.ndarray:
    """The first powers of ``base`` modulo 2^64; one table a base, as long as was ever needed."""
    table = _POWERS.get(base)
    if table is None or len(table) < size:
        table = np.full(max(size, 1 << 12), base, np.uint64)
        table[0] = 1
        np.cumprod(table, out=table)
        _POWERS[base] = table
    return table[:size]


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hash of values[start:end] for many spans of one array.

    Works through pieces of ``PIECE`` values and the spans that start in each, so what it needs
    besides follows the piece and not the array, however long one text is.
    """
    out = np.empty(len(starts), np.uint64)
    if len(values) <= PIECE:
        _piece_hash(values, starts, ends, base, out, slice(None))
        return out
    if (starts[1:] >= starts[:-1]).all():
        cuts = np.searchsorted(starts, np.arange(0, len(values) + PIECE, PIECE))
        parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    else:
        order = np.argsort(starts, kind="stable")
        cuts = np.searchsorted(starts[order], np.arange(0, len(values) + PIECE, PIECE))
        parts = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for i, part in enumerate(parts):
        if len(starts[part]):
            low = i * PIECE
            high = int(ends[part].max())
            _piece_hash(values[low:high], starts[part] - low, ends[part] - low, base, out, part)
    return out


def _piece_hash(values, starts, ends, base, out, part) -> None:
    total = np.zeros(len(values) + 1, np.uint64)
    np.multiply(values, powers(base, len(values)), out=total[1:], casting="unsafe")
    np.cumsum(total, out=total)
    hashes = total[ends]
    hashes -= total[starts]
    # Powers of the inverse bring every span to the same place.
    hashes *= powers(pow(base, -1, 1 << 64), len(values) + 1)[starts]
    out[part] = hashes


def text_blocks(
    batch: pa.RecordBatch, column: str = "text", block_bytes: int = BLOCK_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of blocks of whole texts; null is empty."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + block_bytes, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words_of(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE):
    """Start and end of every word in a block, and for each text its first word (n + 1 numbers)."""
    gap = separator[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = gap[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(~gap & edge[:-1])
    edge[1:-1] = gap[1:]
    edge[offsets] = True
    ends = np.flatnonzero(~gap & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(span_hash(data, starts, ends, _BYTE_BASE))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbouring words, text borders not regarded."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    at = np.arange(len(words) - width + 1)
    return mix(span_hash(words, at, at + width, _WORD_BASE))


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of each whole window's first word in the block, and the text it belongs to."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    before = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.arange(counts.sum()) - before[text] + first[:-1][text], text


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    done, out = 1, values
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def planes(values: np.ndarray) -> bytes:
    """Bytes ordered by significance, so that block compression removes the zero ones."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of each run of consecutive numbers in a sorted array."""
    if not len(places):
        return places, places
    breaks = np.flatnonzero(np.diff(places) > 1)
    return places[np.concatenate([[0], breaks + 1])], places[np.concatenate([breaks, [len(places) - 1]])] + 1


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal separate spans, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new], reach[np.concatenate([new[1:], [True]])]


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node it reaches.

    Every node takes the least label among its neighbours, then the label of its label, until
    nothing changes. Minima combine before the shuffle and labels are joined by key, so a node
    with very many neighbours is no hot task; every round is written to the shared folder.
    """
    links = edges.where("a <> b").select("a", "b")
    links = stage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), label)
    now = stage(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), label)
    while True:
        least = links.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("least"))
        step = now.join(least, "node").select("node", F.least("root", "least").alias("new"), F.col("root").alias("old"))
        jump = now.select(F.col("node").alias("new"), F.col("root").alias("next"))
        after = stage(step.join(jump, "new").select("node", F.least("new", "next").alias("root"), "old"), label)
        if after.where("root <> old").isEmpty():
            return after.select("node", "root")
        now = after.select("node", "root")


def deal(df: DataFrame, parts: int) -> DataFrame:
    """Rows to the partition that their column ``bucket`` (0 to parts - 1) names."""
    return df.repartitionById(parts, F.col("bucket"))


def ordered(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch by (place, text_key), with the two columns first."""
    place, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    if len(place) < 2 or (place[1:] > place[:-1]).all():
        return batch
    return batch.take(pa.array(np.lexsort((key, place))))


def buckets_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((mix(hashes, 7) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def schema_of(ddl: str) -> pa.Schema:
    """Arrow schema of a Spark schema in words, for the batches a task yields."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(),
             "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])
