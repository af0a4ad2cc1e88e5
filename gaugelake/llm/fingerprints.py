"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a run of words that ends with its line or after a word whose hash says so (one
in ``CUT_EVERY``), so an edit moves only the paragraphs it touches and long lines count by
their length. The k-th copy of a paragraph within a text is told apart from the others. A
sketch adds every digest to one cell in each of three tables: a count, a sum of digests and a
sum of check values. Two sketches subtract cell by cell; cells that hold one digest are peeled
until nothing is left, which recovers the digests that differ. If peeling gets stuck, both
sketches are built again four times as large. Likeness is common over all digests.

The next document comes from a neighbour in range partitions: bounds are quantiles of doc_id
(one number a partition), and the first document of each partition is also sent to the one
before it. Sketches of a block of documents are built, subtracted and peeled together.

Results: null text is empty and has an empty sketch; two empty sketches have likeness 1. Rows
are ordered by doc_id, then by a hash of the text; a null doc_id is the smallest. Repeated rows
follow each other. A single document is its own next. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.llm import common

CUT_EVERY = 5
CELLS = 12
_TABLES = 3


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Paragraph digests of many texts: text number, ascending, and digest."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    begins, ends, first = common.words_of(data, offsets)
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = common.word_hashes(data, begins, ends)
    lines = np.cumsum(np.concatenate([[0], data == 10]))
    last = (words % np.uint64(CUT_EVERY)) == 0
    last[:-1] |= lines[begins[1:]] > lines[ends[:-1]]
    last[first[1:][first[1:] > 0] - 1] = True
    stop = np.flatnonzero(last) + 1
    start = np.concatenate([[0], stop[:-1]])
    found = common.mix(common.span_hash(words, start, stop, 0xC2B2AE3D27D4EB4F) + (stop - start).astype(np.uint64), 17)
    text = np.searchsorted(first, start, "right") - 1
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    new = np.ones(len(found), bool)
    new[1:] = (text[1:] != text[:-1]) | (found[1:] != found[:-1])
    heads = np.flatnonzero(new)
    copy = np.arange(len(found)) - np.repeat(heads, np.diff(heads, append=len(found)))
    return text, np.where(copy > 0, common.mix(found + copy.astype(np.uint64), 19), found)


class Sketches:
    """One sketch of ``cells`` cells for each of ``count`` documents."""

    def __init__(self, count: int, cells: int):
        self.cells = cells
        self.counts = np.zeros(count * cells, np.int64)
        self.sums, self.checks = np.zeros((2, count * cells), np.uint64)

    def places(self, docs: np.ndarray, keys: np.ndarray):
        width = self.cells // _TABLES
        for j in range(_TABLES):
            yield docs * self.cells + j * width + (common.mix(keys, 21 + j) % np.uint64(width)).astype(np.int64)

    def add(self, docs: np.ndarray, keys: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """Add digests ``signs`` times (1 or -1); the cells that changed."""
        weight = signs.astype(np.uint64)  # -1 is 2^64 - 1
        value, check = keys * weight, common.mix(keys, 29) * weight
        touched = []
        for at in self.places(docs, keys):
            np.add.at(self.counts, at, signs)
            np.add.at(self.sums, at, value)
            np.add.at(self.checks, at, check)
            touched.append(at)
        return np.concatenate(touched)

    def peel(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        """How many digests were recovered for each document, and whether none is left."""
        recovered = np.zeros(count, np.int64)
        at = np.flatnonzero(np.abs(self.counts) == 1)
        while len(at):
            signs = self.counts[at]
            keys = self.sums[at] * signs.astype(np.uint64)
            pure = common.mix(keys, 29) * signs.astype(np.uint64) == self.checks[at]
            docs, keys, signs = at[pure] // self.cells, keys[pure], signs[pure]
            order = np.lexsort((keys, docs))
            docs, keys, signs = docs[order], keys[order], signs[order]
            new = np.ones(len(docs), bool)
            new[1:] = (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])
            docs, keys, signs = docs[new], keys[new], signs[new]
            if not len(docs):
                break
            recovered += np.bincount(docs, minlength=count)
            touched = np.unique(self.add(docs, keys, -signs))
            at = touched[np.abs(self.counts[touched]) == 1]
        left = (self.counts != 0) | (self.sums != 0) | (self.checks != 0)
        return recovered, ~left.reshape(count, self.cells).any(axis=1)

    def strings(self, count: int) -> list[str]:
        rows = np.zeros((count * self.cells), np.dtype([("n", "<u4"), ("sum", "<u8"), ("check", "<u4")]))
        rows["n"], rows["sum"], rows["check"] = self.counts, self.sums, self.checks & np.uint64(0xFFFFFFFF)
        return [base64.b64encode(r.tobytes()).decode() for r in rows.reshape(count, self.cells)]


def likeness(count: int, text_a: np.ndarray, keys_a: np.ndarray, text_b: np.ndarray, keys_b: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Likeness of document i of one set to document i of the other, for all of them at once."""
    size_a, size_b = np.bincount(text_a, minlength=count), np.bincount(text_b, minlength=count)
    total, differ = size_a + size_b, np.zeros(count, np.int64)
    open_docs = np.flatnonzero(total)
    docs = np.concatenate([text_a, text_b])
    keys = np.concatenate([keys_a, keys_b])
    signs = np.concatenate([np.ones(len(text_a), np.int64), np.full(len(text_b), -1)])
    while len(open_docs):
        number = np.full(count, -1)
        number[open_docs] = np.arange(len(open_docs))
        mine = number[docs] >= 0
        docs, keys, signs = docs[mine], keys[mine], signs[mine]
        sketch = Sketches(len(open_docs), cells)
        sketch.add(number[docs], keys, signs)
        recovered, done = sketch.peel(len(open_docs))
        differ[open_docs[done]] = recovered[done]
        open_docs = open_docs[~done]
        cells *= 4
    return np.where(total > 0, (total - differ) / np.maximum(total + differ, 1), 1.0)


def edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _block(texts: list[str], following: str) -> dict:
    """Results of consecutive texts; ``following`` comes after the last."""
    n = len(texts)
    nexts = [*texts[1:], following]
    changed = [edited(a, b).encode() for a, b in zip(texts, nexts, strict=True)]
    text, keys = digests([*(t.encode() for t in texts), following.encode()])
    of_edit, edit_keys = digests(changed)
    own, later = text < n, text > 0
    prints = []
    for docs, values in ((text[own], keys[own]), (of_edit, edit_keys)):
        sketch = Sketches(n, CELLS)
        sketch.add(docs, values, np.ones(len(docs), np.int64))
        prints.append(sketch.strings(n))
    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t).hexdigest() for t in changed],
        "fingerprint": prints[0],
        "edited_fingerprint": prints[1],
        "near_edited": likeness(n, text[own], keys[own], of_edit, edit_keys),
        "near_next": likeness(n, text[own], keys[own], text[later] - 1, keys[later]),
    }


def _compare(batches):
    """Batches (place, text, context) in order; the last rows may only be context."""
    schema = common.schema_of(_OUT)
    places, texts, size = [], [], 0

    def flush(following):
        columns = _block(texts, following)
        return pa.RecordBatch.from_arrays(
            [pa.array(places, pa.int64()), *(pa.array(columns[f.name], f.type) for f in schema)], names=["place", *schema.names])

    for batch in batches:
        for place, text, context in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            if size > common.BLOCK_BYTES or (context and texts):
                yield flush(text)
                places, texts, size = [], [], 0
            if context:
                return
            places.append(place)
            texts.append(text)
            size += len(text) + 64


def _bounds(docs: DataFrame, parts: int) -> np.ndarray:
    steps = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx("place", steps, 20 * parts).alias("q")).first()["q"] if steps else None
    return np.unique(np.array(found or [], np.int64))


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """place and the fingerprint columns of every row."""
    texts = common.keyed(docs).select("place", "text_key", "text")
    parts = parts or common.partitions_for(docs)
    bounds = _bounds(texts, parts)
    parts = len(bounds) + 1

    def bucket_of(places: np.ndarray) -> np.ndarray:
        """0 holds the largest."""
        return len(bounds) - np.searchsorted(bounds, places, "right")

    def only_ids(batches):
        for batch in batches:
            buckets = bucket_of(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(buckets), *batch.columns], names=["bucket", "place", "text_key"])

    tops = texts.select("place", "text_key").mapInArrow(only_ids, "bucket int, place long, text_key long")
    # One row a partition.
    tops = {r.bucket: (r.top.place, r.top.text_key) for r in tops.groupBy("bucket").agg(F.max(F.struct("place", "text_key")).alias("top")).collect()}
    filled = sorted(tops)
    before = {tops[b]: filled[i - 1] for i, b in enumerate(filled)}

    def deal(batches):
        for batch in batches:
            places, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            buckets = bucket_of(places).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets), *batch.columns, pa.array(np.zeros(len(places), bool))], names=["bucket", "place", "text_key", "text", "context"])
            also = [(i, before[x]) for i, x in enumerate(zip(places.tolist(), keys.tolist(), strict=True)) if x in before]
            if also:
                rows = batch.take(pa.array([i for i, _ in also]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for _, b in also], pa.int32()), *rows.columns, pa.array(np.ones(len(also), bool))], names=["bucket", "place", "text_key", "text", "context"])

    dealt = common.deal(texts.mapInArrow(deal, "bucket int, place long, text_key long, text string, context boolean"), parts)
    ordered = dealt.sortWithinPartitions("context", F.desc("place"), F.desc("text_key")).select("place", "text", "context")
    return ordered.mapInArrow(_compare, f"place long, {_OUT}")


def op2_fingerprints(spark, sf_dir) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    own_id = F.when(F.col("place") != common.NO_ID, F.col("place")).alias("doc_id")
    return fingerprints(docs).select(own_id, *(f.split()[0] for f in _OUT.split(", ")))
