"""Substring deduplication: Rabin-Karp hashes of every fixed-length word window.

Every map task hashes all windows of its texts and keeps the first of each hash in a block, so
a passage that a third of all documents share costs one entry per block. Entries travel packed
(place, start, hash), grouped by a content-defined bucket: the least five-word hash of a window
chooses it, so neighbouring windows mostly stay together. A bucket counts its hashes; all but
the first place of each are repeated. Starts return as runs, and runs merge per document into
maximal removal intervals.

Results: null or empty text has no words. Texts shorter than a window are never cut. Rows equal
in doc_id and text are one document, wherever they lie, and get the same result; a null doc_id
sorts first; rows that share only the doc_id are separate documents. An empty table gives no rows. Windows are
told apart by 64-bit hashes: among n windows about n^2 / 2^65 pairs would be mistaken.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.llm import common

WINDOW_WORDS = 20
_BUCKET_WORDS = 5

PACKED = "bucket int, places binary, keys binary, counts binary, starts binary, hashes binary"
RUNS = "place long, text_key long, runs binary"


def pack_places(bucket, places, keys, text, starts, hashes) -> dict:
    """One row for the windows of one bucket; ``text`` ascends."""
    heads = np.flatnonzero(np.diff(text, prepend=-1))
    return {
        "bucket": int(bucket),
        "places": places[text[heads]].tobytes(),
        "keys": keys[text[heads]].tobytes(),
        "counts": np.diff(heads, append=len(text)).astype(np.uint32).tobytes(),
        "starts": common.planes(np.diff(starts, prepend=0).astype(np.int32)),
        "hashes": hashes.tobytes() if hashes is not None else b"",
    }


def _hash_windows(parts: int, width: int):
    schema = common.schema_of(PACKED)
    inner = min(_BUCKET_WORDS, width)

    def rows(batch):
        batch = common.ordered(batch)
        all_places, all_keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for first_row, last_row, data, offsets in common.text_blocks(batch):
            places, keys = all_places[first_row:last_row], all_keys[first_row:last_row]
            begins, ends, first = common.words_of(data, offsets)
            at, text = common.window_starts(first, width)
            if not len(at):
                continue
            words = common.word_hashes(data, begins, ends)
            hashes = common.window_hashes(words, width)[at]
            least = common.sliding_min(common.window_hashes(words, inner), width - inner + 1)[at]
            starts = at - first[text]
            # Rows equal in doc_id and text are one document; those of other blocks meet in _repeated.
            same = np.flatnonzero((np.diff(places) == 0) & (np.diff(keys) == 0)) + 1
            if len(same):
                keep = ~np.isin(text, same)
                text, starts, hashes, least = text[keep], starts[keep], hashes[keep], least[keep]
            order = np.argsort(hashes, kind="stable")
            again = order[1:][hashes[order][1:] == hashes[order][:-1]]
            new = np.ones(len(hashes), bool)
            new[again] = False
            if len(again):
                again.sort()
                yield pack_places(keys[text[again[0]]] % parts, places, keys, text[again], starts[again], None)
            buckets = common.buckets_of(least, parts)
            order = np.flatnonzero(new)
            order = order[np.argsort(buckets[order], kind="stable")]
            cuts = np.flatnonzero(np.diff(buckets[order])) + 1
            for part in np.split(order, cuts):
                yield pack_places(buckets[part[0]], places, keys, text[part], starts[part], hashes[part])

    def task(batches):
        for batch in batches:
            for row in rows(batch):
                yield pa.RecordBatch.from_pylist([row], schema)

    return task


def unpack_places(row: dict, at: np.ndarray | slice = slice(None)):
    """Place, key and start of the windows ``at`` of a row."""
    counts = np.frombuffer(row["counts"], np.uint32)
    text = np.repeat(np.arange(len(counts)), counts)[at]
    starts = np.cumsum(common.from_planes(row["starts"], np.int32), dtype=np.int64)[at]
    return np.frombuffer(row["places"], np.int64)[text], np.frombuffer(row["keys"], np.int64)[text], starts


def as_runs(places, keys, starts) -> pa.RecordBatch:
    """Window starts, sorted by document and start, as one row of runs per document."""
    new = np.concatenate([[True], (np.diff(places) != 0) | (np.diff(keys) != 0)])
    heads = np.flatnonzero(new)
    breaks = np.flatnonzero(new | np.concatenate([[True], np.diff(starts) != 1]))
    spans = np.stack([starts[breaks], starts[np.append(breaks[1:], len(starts)) - 1]], 1).astype(np.int32)
    bounds = np.append(np.searchsorted(breaks, heads), len(breaks))
    return pa.RecordBatch.from_arrays(
        [pa.array(places[heads]), pa.array(keys[heads]),
         pa.array([spans[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())],
        schema=common.schema_of(RUNS),
    )


def first_of_equals(*columns: np.ndarray) -> np.ndarray:
    """Marks rows of sorted columns that differ from the row before them."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def repeated_members(hashes: np.ndarray) -> np.ndarray:
    """Marks values that occur more than once."""
    order = np.argsort(hashes)
    equal = hashes[order][1:] == hashes[order][:-1]
    member = np.zeros(len(hashes), bool)
    member[order[1:][equal]] = True
    member[order[:-1][equal]] = True
    return member


def _repeated(batches):
    """All but the first place of every hash of this partition.

    Rows stay packed; places are taken out for the hashes that occur twice.
    """
    packed = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["hashes"]:
                packed.append(row)
            else:
                yield as_runs(*unpack_places(row))
    if not packed:
        return
    hashes = np.concatenate([np.frombuffer(row["hashes"], np.uint64) for row in packed])
    member = repeated_members(hashes)
    hashes = hashes[member]
    if not len(hashes):
        return
    first, found = 0, []
    for i, row in enumerate(packed):
        last = first + len(row["hashes"]) // 8
        at = np.flatnonzero(member[first:last])
        if len(at):
            found.append(unpack_places(row, at))
        packed[i], first = None, last
    places, keys, starts = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((starts, keys, places, hashes))
    order = order[first_of_equals(hashes[order], places[order], keys[order], starts[order])]
    later = order[1:][hashes[order][1:] == hashes[order][:-1]]
    later = later[np.lexsort((starts[later], keys[later], places[later]))]
    if len(later):
        yield as_runs(places[later], keys[later], starts[later])


def removal_runs(docs: DataFrame, width: int = WINDOW_WORDS) -> DataFrame:
    """(place, text_key, runs): packed runs of removed window starts, several per document."""
    texts = common.keyed(docs).select("place", "text_key", "text")
    parts = common.partitions_for(docs)
    packed = texts.mapInArrow(_hash_windows(parts, width), PACKED)
    found = common.deal(packed, parts).mapInArrow(_repeated, RUNS)
    return found.groupBy("place", "text_key").agg(F.collect_list("runs").alias("runs"))


def _cut(width: int):
    schema = pa.schema([("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("kept", pa.string())])

    def one(text: bytes, packed):
        words = text.split()
        if not packed:
            return text, len(words), 0, b" ".join(words)
        spans = np.concatenate([np.frombuffer(p, np.int32) for p in packed]).reshape(-1, 2)
        starts, ends = common.merge_spans(spans[:, 0], spans[:, 1] + width)
        gone = np.zeros(len(words) + 1, np.int32)
        np.add.at(gone, starts, 1)
        np.add.at(gone, ends, -1)
        kept = np.cumsum(gone[:-1]) == 0
        left = b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k])
        return left, len(words), len(words) - int(kept.sum()), left

    def task(batches):
        for batch in batches:
            texts, found = batch.column(1), batch.column(2)
            out = {name: [] for name in schema.names}
            for text, packed in zip(texts, found, strict=True):
                raw = text.as_py()
                cut, n, removed, kept = one(raw.encode() if raw is not None else b"", packed.as_py())
                out["text"].append(raw if not removed else cut)
                out["n_words"].append(n)
                out["n_removed"].append(removed)
                out["kept"].append(hashlib.sha256(kept).hexdigest())
            arrays = [pa.array(out[f.name], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["rest", *schema.names])

    return task


def remove_repeats(docs: DataFrame, width: int = WINDOW_WORDS) -> DataFrame:
    """All columns of ``docs`` with repeated windows cut out of ``text``.

    A text that loses nothing stays as it is; of others the kept words are joined by one space.
    Added are n_words, n_removed and kept_sha256, the digest of the kept words joined by one
    space; columns of these names in ``docs`` are replaced.
    """
    runs = removal_runs(docs, width)
    texts = common.keyed(docs)
    found = texts.join(runs, ["place", "text_key"], "left").select("rest", "text", "runs")
    rest = texts.schema["rest"].dataType.simpleString()
    cut = found.mapInArrow(
        _cut(width), f"rest {rest}, text string, n_words long, n_removed long, kept string"
    )
    added = ("n_words", "n_removed", "kept_sha256")
    own = [c for c, name in zip(common.unkeyed(docs), docs.columns, strict=True) if name not in added]
    return cut.select(*own, "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


OP10_SQL = r"""
with docs as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
windows as (
  select doc_id, s, row_number() over (partition by array_to_string(words[s + 1 : s + 20], ' ') order by doc_id, s) as copy
  from (select doc_id, words, unnest(range(0, greatest(len(words) - 19, 0))) as s from docs)),
gone as (
  select distinct doc_id, i from (select doc_id, unnest(range(s, s + 20)) as i from windows where copy > 1)),
kept as (
  select w.doc_id, string_agg(w.word, ' ' order by w.i) as text
  from (select doc_id, unnest(words) as word, unnest(range(0, len(words))) as i from docs) w
  anti join gone g on g.doc_id = w.doc_id and g.i = w.i group by 1),
lost as (select doc_id, count(*) as n from gone group by 1)
select d.doc_id, len(d.words) as n_words, coalesce(l.n, 0) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from docs d left join lost l on l.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id"""


def op10_substring_dedup(spark, sf_dir) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return remove_repeats(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")
