"""Suffix-array dedup: repeated byte strings by interval expansion on a Burrows-Wheeler transform.

Every string of ``LENGTH`` bytes holds one anchor: its 64-byte gram of least hash, the leftmost
of equals. Equal strings have equal anchors at equal places, so repeated strings are found among
occurrences of one anchor, whose context is all bytes of the strings it anchors.

1. Anchors (one in about 170 bytes) are counted by hash. Those that occur once are done. Where
   a context occurs twice as a whole, all its strings are repeated. Anchors with differing
   contexts go on.
2. The contexts of each such anchor meet in one partition. There they are written as symbols,
   16-byte blocks counted from the anchor, and a suffix array and its Burrows-Wheeler transform
   are built over groups of anchors. Breadth-first backward extension of intervals gives the
   common prefixes by increasing length and stops at 24 blocks, which any common string of 400
   bytes covers; what is not reached by then is common for at least that long. Within those,
   strings are compared by byte, as hashes at equal places of the anchor.
3. Starts return as runs, and the bytes they cover are removed.

An anchor that more than a share of all anchors repeat (``HOT_SHARE``, at least
``HOT_LEAST`` times) would make a large group. There are at most 1 / ``HOT_SHARE`` of them, so
their list goes to all tasks, and their strings are counted by hash instead, first within a
block and then by bucket.

Results: null text is empty; texts shorter than ``LENGTH`` bytes lose nothing. Equal rows are
separate documents that repeat each other only if their doc_id differs or is null on one side:
rows equal in doc_id and text are one document, wherever they lie. An empty table gives no rows. A removal may
split a character; the kept bytes are bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.llm import common
from gaugelake.llm.substring_dedup import RUNS, as_runs, first_of_equals
from gaugelake.session import stage

LENGTH = 400
GRAM = 64
BLOCK = 16
HOT_LEAST = 2_000
HOT_SHARE = 1e-6
_BATCH_BYTES = 1 << 20
_GRAM_BASE, _BODY_BASE = 0x9FB21C651E98DF25, 0xE7037ED1A0B428DB

_ANCHORS = "bucket int, kind int, places binary, keys binary, starts binary, widths binary, hashes binary, bodies binary"
_OPEN, _DONE, _TALLY = range(3)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Per anchor of a block of texts: text, first and last string start, place, gram hash."""
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    if not counts.sum():
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    at = np.arange(len(data) - gram + 1)
    hashes = common.mix(common.span_hash(data, at, at + gram, _GRAM_BASE))
    bits = np.uint64(len(data).bit_length())
    tagged = common.mix(hashes, 31) >> bits << bits | at.astype(np.uint64)
    least = common.sliding_min(tagged, length - gram + 1)
    text = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[text]
    place = (least[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(start)) - 1
    return text[heads], start[heads], start[tails], place[heads], hashes[place[heads]]


def _row(bucket, kind, places, keys, starts, widths=None, hashes=None, bodies=None) -> dict:
    pack = lambda x: b"" if x is None else x.tobytes()
    return {"bucket": int(bucket), "kind": kind, "places": pack(places), "keys": pack(keys), "starts": pack(starts.astype(np.int64)),
            "widths": pack(widths if widths is None else widths.astype(np.int64)), "hashes": pack(hashes), "bodies": pack(bodies)}


def _rows(batches, schema, block):
    """Run ``block`` over blocks of texts in document order, without rows of a batch that repeat one document."""
    for batch in batches:
        batch = common.ordered(batch)
        places, keys = (np.ascontiguousarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in (0, 1))
        seen = None
        for first, last, data, offsets in common.text_blocks(batch):
            ids = list(zip(places[first:last].tolist(), keys[first:last].tolist(), strict=True))
            again = np.array([x == (ids[i - 1] if i else seen) for i, x in enumerate(ids)])
            seen = ids[-1]
            for packed in block(batch.slice(first, last - first), places[first:last], keys[first:last], data, offsets, again):
                yield pa.RecordBatch.from_pylist([packed], schema)


def _find_anchors(parts: int, length: int, gram: int):
    def block(batch, places, keys, data, offsets, again):
        text, low, high, _, hashes = anchors(data, offsets, length, gram)
        keep = ~again[text]
        text, low, high, hashes = text[keep], low[keep], high[keep], hashes[keep]
        if not len(text):
            return
        bodies = common.mix(common.span_hash(data, low, high + length, _BODY_BASE) + (high - low).astype(np.uint64))
        low, width = low - offsets[text], high - low + 1
        # Of equal contexts in a block one goes on; it knows that it is repeated.
        order = np.lexsort((bodies, hashes))
        h, b = hashes[order], bodies[order]
        head = np.concatenate([[True], (h[1:] != h[:-1]) | (b[1:] != b[:-1])])
        size = np.diff(np.flatnonzero(head), append=len(order))
        copies = order[np.repeat(size > 1, size)]
        if len(copies):
            yield _row(keys[text[copies[0]]] % parts, _DONE, places[text[copies]], keys[text[copies]], low[copies], width[copies])
        lead, size = order[head], size
        buckets = common.buckets_of(hashes[lead], parts)
        to = np.argsort(buckets, kind="stable")
        for part in np.split(to, np.flatnonzero(np.diff(buckets[to])) + 1):
            i = lead[part]
            yield _row(buckets[part[0]], _OPEN, places[text[i]], keys[text[i]], low[i], width[i] << 32 | np.minimum(size[part], 2**31), hashes[i], bodies[i])

    return lambda batches: _rows(batches, common.schema_of(_ANCHORS), block)


_MARKED = f"kind int, {RUNS}, hash long"


def _marked(kind, places, keys, starts, widths=None, hashes=None):
    """Runs of string starts per document, or anchors that need their contexts."""
    if hashes is not None:
        n = len(hashes)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(hashes.view(np.int64))], schema=common.schema_of(_MARKED))
    if widths is not None:
        steps = np.arange(widths.sum()) - np.repeat(np.cumsum(widths) - widths, widths)
        places, keys, starts = np.repeat(places, widths), np.repeat(keys, widths), np.repeat(starts, widths) + steps
    order = np.lexsort((starts, keys, places))
    runs = as_runs(places[order], keys[order], starts[order])
    n = runs.num_rows
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *runs.columns, pa.nulls(n, pa.int64())], schema=common.schema_of(_MARKED))


def _arrays(row: dict):
    of = lambda c, t: np.frombuffer(row[c], t)
    return of("places", np.int64), of("keys", np.int64), of("starts", np.int64), of("widths", np.int64), of("hashes", np.uint64), of("bodies", np.uint64)


def _count_anchors(hot_least: int):
    def task(batches):
        found = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == _DONE:
                    yield _marked(_DONE, *_arrays(row)[:4])
                else:
                    found.append(_arrays(row))
        if not found:
            return
        places, keys, starts, widths, hashes, bodies = (np.concatenate(x) for x in zip(*found, strict=True))
        found.clear()
        copies, widths = widths & 0xFFFFFFFF, widths >> 32
        order = np.lexsort((starts, keys, places, bodies, hashes))
        h = hashes[order]
        occurrences = np.bincount(np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1, copies[order])
        # Rows of one document can come from several batches.
        order = order[first_of_equals(h, bodies[order], places[order], keys[order], starts[order])]
        h, b = hashes[order], bodies[order]
        head = np.concatenate([[True], (h[1:] != h[:-1]) | (b[1:] != b[:-1])])
        size = np.diff(np.flatnonzero(head), append=len(order))
        whole = order[np.repeat(size > 1, size)]
        if len(whole):
            yield _marked(_DONE, places[whole], keys[whole], starts[whole], widths[whole])
        top = np.concatenate([[True], h[1:] != h[:-1]])
        group = np.cumsum(top) - 1
        kinds = np.bincount(group, head)
        differing = order[kinds[group] > 1]
        if len(differing):
            yield _marked(_OPEN, places[differing], keys[differing], starts[differing])
        hot = occurrences > hot_least
        if hot.any():
            tally = h[top][hot]
            out = _marked(_TALLY, None, None, None, None, tally)
            counts = pa.array(occurrences[hot].astype(np.int64))
            yield pa.RecordBatch.from_arrays([out.column(0), counts, *out.columns[2:]], schema=out.schema)

    return task


def _gather(parts: int, length: int, gram: int, hot: np.ndarray):
    """Contexts of open anchors by anchor, strings of hot ones by hash."""

    def block(batch, places, keys, data, offsets, again):
        text, low, high, place, hashes = anchors(data, offsets, length, gram)
        wanted = np.zeros(len(data) + 1, bool)
        for i, packed in enumerate(batch.column(3).to_pylist()):
            for spans in packed or ():
                for a, b in np.frombuffer(spans, np.int32).reshape(-1, 2):
                    wanted[offsets[i] + a : offsets[i] + b + 1] = True
        keep = wanted[low] & ~again[text]
        text, low, high, place, hashes = text[keep], low[keep], high[keep], place[keep], hashes[keep]
        is_hot = np.isin(hashes, hot)
        cold = np.flatnonzero(~is_hot)
        if len(cold):
            bodies = common.mix(common.span_hash(data, low[cold], high[cold] + length, _BODY_BASE) + (high - low)[cold].astype(np.uint64))
            _, lead = np.unique(np.stack([hashes[cold], bodies], 1), axis=0, return_index=True)
            buckets = common.buckets_of(hashes, parts)
            for i in cold[lead]:
                at = np.array([low[i] - offsets[text[i]], place[i] - low[i]])
                yield _row(buckets[i], _OPEN, places[text[i : i + 1]], keys[text[i : i + 1]], at[:1], at[1:], hashes[i : i + 1], data[low[i] : high[i] + length])
        many = np.flatnonzero(is_hot)
        if len(many):
            widths = (high - low + 1)[many]
            owner = np.repeat(many, widths)
            start = np.arange(len(owner)) - np.repeat(np.cumsum(widths) - widths, widths) + low[owner]
            strings = common.mix(common.span_hash(data, start, start + length, _BODY_BASE))
            order = np.argsort(strings, kind="stable")
            head = np.concatenate([[True], strings[order][1:] != strings[order][:-1]])
            size = np.diff(np.flatnonzero(head), append=len(order))
            owners = text[owner]
            local = start - offsets[owners]
            double = order[np.repeat(size > 1, size)]
            if len(double):
                yield _row(keys[owners[double[0]]] % parts, _DONE, places[owners[double]], keys[owners[double]], local[double])
            lead = order[head]
            buckets = common.buckets_of(strings[lead], parts)
            to = np.argsort(buckets, kind="stable")
            for part in np.split(to, np.flatnonzero(np.diff(buckets[to])) + 1):
                i = lead[part]
                yield _row(buckets[part[0]], _TALLY, places[owners[i]], keys[owners[i]], local[i], None, strings[i])

    return lambda batches: _rows(batches, common.schema_of(_ANCHORS), block)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; every suffix must be different."""
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    n, step = len(rank), 1
    while True:
        following = np.zeros(n, np.int64)
        following[:-step or None] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 1) + following
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


def long_prefixes(symbols: np.ndarray, separators: int, least: int) -> np.ndarray:
    """Positions whose suffix shares ``least`` symbols or more with another's.

    Symbols below ``separators`` each occur once. Breadth-first: intervals of suffixes that
    start with one string are extended by the symbols before them; an interval's end that is
    met first at length l parts suffixes that share l symbols. Ends still open after
    ``least`` rounds part suffixes that share at least that many.
    """
    n = len(symbols)
    suffixes = suffix_array(symbols)
    before = symbols[suffixes - 1]
    order = np.argsort(before, kind="stable")
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    shared = np.full(n + 1, -1)
    shared[0] = shared[n] = 0
    first = np.sort(symbols)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(first)) + 1, [n]])
    shared[edges] = 0
    low, high = edges[:-1], edges[1:]
    for length in range(1, least):
        if not len(low):
            break
        sizes = high - low
        rows = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        of = np.repeat(np.arange(len(low)), sizes)
        real = before[rows] >= separators
        rows, of = rows[real], of[real]
        at = np.argsort(back[rows])
        target, of, symbol = back[rows][at], of[at], before[rows][at]
        new = np.ones(len(target), bool)
        new[1:] = (of[1:] != of[:-1]) | (symbol[1:] != symbol[:-1])
        heads = np.flatnonzero(new)
        low = target[heads]
        high = target[np.append(heads[1:], len(target)) - 1] + 1 if len(target) else low
        fresh = shared[high] < 0
        low, high = low[fresh], high[fresh]
        shared[high] = length
    open_ends = shared[:n] < 0
    return suffixes[open_ends | np.append(open_ends[1:], False)]


def repeated_strings(group: np.ndarray, before: np.ndarray, bodies: list[bytes], length: int):
    """(context, start) of every string of ``length`` bytes that two contexts of a group share.

    ``group`` is ascending, ``before`` the anchor's place in each body.
    """
    n = len(bodies)
    lengths = np.array([len(b) for b in bodies])
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(b"".join(bodies), np.uint8)
    lead = before % BLOCK
    blocks = (lengths - lead) // BLOCK
    owner = np.repeat(np.arange(n), blocks)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = offsets[owner] + lead[owner] + index * BLOCK
    hashes = common.mix(common.span_hash(data, start, start + BLOCK, _BODY_BASE))
    names = np.unique(hashes, return_inverse=True)[1] + n
    # A separator of its own after every context.
    place = np.arange(len(owner)) + owner
    symbols = np.empty(len(owner) + n, np.int64)
    symbols[place] = names
    symbols[np.cumsum(blocks) + np.arange(n)] = np.arange(n)
    least = (length - BLOCK + 1) // BLOCK
    found = long_prefixes(symbols, n, least)
    position = np.full(len(symbols), -1)
    position[place] = np.arange(len(owner))
    found = position[found]
    found = found[found >= 0]
    # Strings whose first whole block is the found one start in the 16 bytes up to it.
    context = np.repeat(owner[found], BLOCK)
    local = np.repeat(lead[owner[found]] + index[found] * BLOCK, BLOCK) - np.tile(np.arange(BLOCK), len(found))
    fits = (local >= 0) & (local + length <= lengths[context])
    context, local = context[fits], local[fits]
    strings = common.span_hash(data, offsets[context] + local, offsets[context] + local + length, _BODY_BASE)
    shift = local - before[context]
    order = np.lexsort((context, strings, shift, group[context]))
    context, local, shift, strings = context[order], local[order], shift[order], strings[order]
    same = (group[context][1:] == group[context][:-1]) & (shift[1:] == shift[:-1]) & (strings[1:] == strings[:-1])
    member = np.zeros(len(context), bool)
    member[1:] |= same
    member[:-1] |= same
    return context[member], local[member]


def _expand(length: int):
    def task(batches):
        contexts, tallies = [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == _DONE:
                    yield _marked(_DONE, *_arrays(row)[:3])
                elif row["kind"] == _OPEN:
                    contexts.append(tuple(np.frombuffer(row[c], np.int64)[0] for c in ("hashes", "places", "keys", "starts", "widths")) + (row["bodies"],))
                else:
                    a = _arrays(row)
                    tallies.append((a[0], a[1], a[2], a[4]))
        # Rows of one document can come from several batches.
        contexts.sort(key=lambda c: c[:4])
        contexts = [c for i, c in enumerate(contexts) if not i or c[:4] != contexts[i - 1][:4]]
        first, size = 0, 0
        for i, c in enumerate(contexts):
            size += len(c[5])
            if i + 1 < len(contexts) and (size < _BATCH_BYTES or contexts[i + 1][0] == c[0]):
                continue
            hashes, places, keys, starts, before, bodies = zip(*contexts[first : i + 1], strict=True)
            context, local = repeated_strings(np.array(hashes), np.array(before), list(bodies), length)
            if len(context):
                yield _marked(_DONE, np.array(places)[context], np.array(keys)[context], np.array(starts)[context] + local)
            first, size = i + 1, 0
        if tallies:
            places, keys, starts, hashes = (np.concatenate(x) for x in zip(*tallies, strict=True))
            order = np.lexsort((starts, keys, places, hashes))
            order = order[first_of_equals(hashes[order], places[order], keys[order], starts[order])]
            same = hashes[order][1:] == hashes[order][:-1]
            member = np.zeros(len(order), bool)
            member[1:] |= same
            member[:-1] |= same
            order = order[member]
            if len(order):
                yield _marked(_DONE, places[order], keys[order], starts[order])

    return task


def repeated_runs(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_least: int = HOT_LEAST) -> DataFrame:
    """(place, text_key, runs): packed runs of starts of repeated strings, several per document."""
    texts = common.keyed(docs).select("place", "text_key", "text")
    parts = common.partitions_for(docs)
    found = common.deal(texts.mapInArrow(_find_anchors(parts, length, gram), _ANCHORS), parts)
    marked = stage(found.mapInArrow(_count_anchors(hot_least), _MARKED), "anchors")
    tallies = marked.where(f"kind = {_TALLY}").select("hash", F.col("place").alias("n"))
    # Anchors number at most one for each string; the share bounds the list.
    total = tallies.agg(F.sum("n")).first()[0] or 0
    hot = tallies.where(F.col("n") > max(hot_least, int(total * HOT_SHARE))).select("hash").collect()
    hot = np.sort(np.array([r["hash"] for r in hot], np.int64).view(np.uint64))
    wanted = marked.where(f"kind = {_OPEN}").groupBy("place", "text_key").agg(F.collect_list("runs").alias("wanted"))
    open_texts = texts.join(wanted, ["place", "text_key"]).select("place", "text_key", "text", "wanted")
    gathered = common.deal(open_texts.mapInArrow(_gather(parts, length, gram, hot), _ANCHORS), parts)
    runs = gathered.mapInArrow(_expand(length), _MARKED).unionByName(marked.where(f"kind = {_DONE}"))
    return runs.groupBy("place", "text_key").agg(F.collect_list("runs").alias("runs"))


def remove_repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_least: int = HOT_LEAST) -> DataFrame:
    """rest, kept (bytes) and the removed byte spans of every row, with n_bytes and n_removed."""
    texts = common.keyed(docs)
    rest = texts.schema["rest"].dataType.simpleString()
    found = texts.join(repeated_runs(docs, length, gram, hot_least), ["place", "text_key"], "left").select("rest", "text", "runs")

    def task(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            kept, spans, sizes, gone = [], [], [], []
            for text, packed in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                cut: list[tuple[int, int]] = []
                if packed:
                    pairs = np.concatenate([np.frombuffer(p, np.int32) for p in packed]).reshape(-1, 2).astype(np.int64)
                    # A run names its first and last start.
                    cut = list(zip(*(x.tolist() for x in common.merge_spans(pairs[:, 0], pairs[:, 1] + length)), strict=True))
                edges = [0, *(e for s in cut for e in s), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"start": a, "end": b} for a, b in cut])
                sizes.append(len(raw))
                gone.append(len(raw) - len(kept[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), pa.array(spans, span), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())],
                names=["rest", "kept", "spans", "n_bytes", "n_removed"])

    return found.mapInArrow(task, f"rest {rest}, kept binary, spans array<struct<start: long, end: long>>, n_bytes long, n_removed long")


def op6_suffix_dedup(spark, sf_dir) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated(docs).select(
        F.col("rest.doc_id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
