"""Benchmark decontamination: one Aho-Corasick automaton scans every text once.

Texts are normalised byte for byte: A-Z become a-z and every other ASCII byte that is no letter
or digit becomes a space, so a place in the normalised text is the same place in the original.
Words are then joined by single spaces. A window is 13 neighbouring words of a benchmark item
(all words of a shorter one), written with a space on either side, so one automaton over all
windows finds every occurrence, overlapping ones included, at word borders only. Hits come back
as word ranges and, from the original's word borders, as byte ranges of the original text.

The benchmark is reference data: its windows go to every executor once their number is found to
be at most ``MAX_WINDOWS``. A larger benchmark is cut by item into several automatons of that
size, each built and scanned in turn; hits are merged per text, so results are the same.

Results: null or empty text has no words and no hits. An item without text has no window; one
without an id hits like any other but is not named among the items. Equal windows of several
items count for each. Every row gives one row; repeated rows give the same result.
An empty benchmark finds nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.llm import common

WINDOW_WORDS = 13
MAX_WINDOWS = 500_000

_WORD_BYTES = bytes((*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)))
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b in _WORD_BYTES else 32 for b in range(256)
)
_GAP = np.array([_NORMAL[b] == 32 for b in range(256)])


def item_windows(text: str | None, width: int) -> set[bytes]:
    words = (text or "").encode().translate(_NORMAL).split()
    last = max(1, len(words) - width + 1) if words else 0
    return {b" ".join(words[i : i + width]) for i in range(last)}


def benchmark_shards(benchmark: DataFrame, width: int, most: int) -> list[dict[bytes, list[str]]]:
    """Windows with the items they come from, in shards of at most about ``most`` windows."""
    shards: list[dict[bytes, list[str]]] = [defaultdict(list)]
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).distinct()
    for item, text in rows.orderBy("item_id", "text").toLocalIterator():
        windows = item_windows(text, width)
        if shards[-1] and len(shards[-1]) + len(windows) > most:
            shards.append(defaultdict(list))
        for window in windows:
            holders = shards[-1][window]
            if item is not None and item not in holders:
                holders.append(item)
    return [dict(s) for s in shards]


def _automaton(windows: dict[bytes, list[str]]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for window, items in windows.items():
        # One character for each byte.
        machine.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, tuple(items)))
    machine.make_automaton()
    return machine


def scan(machines: list, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(words, maximal hit word ranges, items) of one text."""
    words = text.translate(_NORMAL).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    starts, ends, items = [], [], set()
    for machine in machines:
        at = before = 0
        for place, (n, found) in machine.iter(line):
            # Words that end at or before this place; places ascend.
            before += line.count(" ", at, place)
            at = place
            starts.append(before - n)
            ends.append(before)
            items.update(found)
    if not starts:
        return len(words), [], items
    merged = common.merge_spans(np.array(starts), np.array(ends))
    return len(words), list(zip(*(x.tolist() for x in merged), strict=True)), items


def byte_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Word ranges as byte ranges of the original text."""
    if not ranges:
        return []
    starts, ends, _ = common.words_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]), _GAP)
    return [{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in ranges]


_FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>"
_ARROW = pa.schema([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW_WORDS, most: int = MAX_WINDOWS) -> DataFrame:
    """``text`` and ``rest`` of every row with n_words, n_hit, items (sorted) and byte spans."""
    shards = benchmark_shards(benchmark, width, most)

    def task(batches):
        machines = [_automaton(s) for s in shards if s]
        for batch in batches:
            rows = []
            for text in batch.column(0):
                raw = text.as_py()
                raw = raw.encode() if raw is not None else b""
                n, ranges, items = scan(machines, raw)
                rows.append({"n_words": n, "n_hit": sum(b - a for a, b in ranges),
                             "items": sorted(items), "spans": byte_spans(raw, ranges)})
            found = pa.RecordBatch.from_pylist(rows, _ARROW)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *found.columns], names=["text", "rest", *_ARROW.names]
            )

    texts = common.keyed(docs).select("text", "rest")
    rest = texts.schema["rest"].dataType.simpleString()
    return texts.mapInArrow(task, f"text string, rest {rest}, {_FOUND}").withColumn(
        "contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without those of whose words a twentieth or more lies in benchmark windows."""
    return find_hits(docs, benchmark).where("not contaminated").select(*common.unkeyed(docs))


def op5_benchmark_decontamination(spark, sf_dir) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_hits(docs, common.read_table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("rest.doc_id").alias("doc_id"), "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated", "spans",
    )
