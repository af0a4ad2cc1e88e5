"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of words with smallest period q and length >= max(12, 2 q) that no neighbour
extends. Every run holds a block of dyadic length b, placed at a multiple of its stride, that
occurs again q words later inside the run: b is 4 (stride 3) for periods to 14, and otherwise
periods 2 b - 1 to 4 b - 2 belong to the blocks of length and stride b. So each block asks for
its own occurrences in the window of those distances:

* prefix doubling over the four-word grams of a document gives the suffix array, and on the way
  the interval of every block that occurs twice;
* a wavelet matrix over the suffix array answers "the next occurrence from here on" (range
  successor: count what is smaller, then select), for all blocks of a level at once;
* occurrences at most b / 2 apart form an arithmetic progression, which is taken as a whole.
  Members in one stretch of the block's own period repeat that period and are passed over.

Every occurrence gives a candidate period. The ranks of the doubling levels extend it to both
sides; equal stretches keep their smallest period. Documents of a block of about two megabytes
are worked on together, apart by a word of their own between them, without any shuffle.

Results: null or empty text has no words and no runs. Repeated rows each give their row; a null
doc_id is kept. Words are told apart by 64-bit hashes. A text is worked on as a whole, whatever
its length, with some 150 bytes of memory for each of its words. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.llm import common

LEAST_WORDS = 12
BLOCK_BYTES = 2 << 20
_GRAM = 4
_GRAM_STRIDE = 3
_GRAM_PERIODS = 14


class Occurrences:
    """Range successor over an array of positions: a wavelet matrix, asked for many ranges at once."""

    def __init__(self, values: np.ndarray):
        self.size = len(values)
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1 == 1
            zeros = np.concatenate([[0], np.cumsum(~one)])
            self.levels.append((bit, zeros, int(zeros[-1])))
            values = np.concatenate([values[~one], values[one]])

    def _smaller(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values in [lo, hi) lie below ``bound``."""
        count = np.where(bound >> self.bits > 0, hi - lo, 0)
        bound = np.where(bound >> self.bits > 0, 0, bound)
        for bit, zeros, split in self.levels:
            zero_lo, zero_hi = zeros[lo], zeros[hi]
            right = (bound >> bit) & 1 == 1
            count += np.where(right, zero_hi - zero_lo, 0)
            lo = np.where(right, split + lo - zero_lo, zero_lo)
            hi = np.where(right, split + hi - zero_hi, zero_hi)
        return count

    def following(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray, none: int) -> np.ndarray:
        """Least value >= ``bound`` in [lo, hi), or ``none``."""
        rank = self._smaller(lo, hi, bound)
        found = rank < hi - lo
        out = np.full(len(lo), none, np.int64)
        lo, hi, rank = lo[found], hi[found], rank[found]
        value = np.zeros(len(lo), np.int64)
        for bit, zeros, split in self.levels:
            zero_lo, zero_hi = zeros[lo], zeros[hi]
            right = rank >= zero_hi - zero_lo
            rank = np.where(right, rank - (zero_hi - zero_lo), rank)
            lo = np.where(right, split + lo - zero_lo, zero_lo)
            hi = np.where(right, split + hi - zero_hi, zero_hi)
            value |= right.astype(np.int64) << bit
        out[found] = value
        return out


class Suffixes:
    """Suffix array of words by prefix doubling, refined only where grams of one text repeat.

    ``ranks[i]`` names, for every place, the stretch of ``4 << i`` words that starts there;
    ``blocks[i]`` are the places of that level's blocks which occur again, with their intervals.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray):
        self.words = words
        places = max(0, len(words) - _GRAM + 1)
        grams = common.window_hashes(words, _GRAM)
        grams = common.mix(grams + common.mix(text[:places].astype(np.uint64), 41), 43)
        order = np.argsort(grams, kind="stable")
        head = np.ones(places, bool)
        head[1:] = grams[order][1:] != grams[order][:-1]
        # The last places have no gram; their ranks are their own.
        rank = np.arange(len(words), dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(places), 0))
        size = np.diff(np.flatnonzero(head), append=places)
        sizes = np.ones(len(words), np.int64)
        sizes[order] = np.repeat(size, size)
        array = order
        active = order[sizes[order] > 1]
        self.repeats = np.zeros(places + 1, np.int64)
        self.repeats[1:] = np.cumsum(sizes[order] > 1)
        self.ranks, self.blocks = [], []
        width = _GRAM
        while len(active):
            self.ranks.append(rank.copy())
            at = active[active % (_GRAM_STRIDE if width == _GRAM else width) == 0]
            self.blocks.append((at, self.repeats[rank[at]], self.repeats[rank[at] + sizes[at]]))
            # A stretch that occurs twice ends before the word between texts, so this stays inside.
            key = (rank[active].astype(np.uint64) << np.uint64(32)) | rank[active + width].astype(np.uint64)
            order = np.argsort(key, kind="stable")
            active, key = active[order], key[order]
            group = rank[active]
            new_group = np.ones(len(active), bool)
            new_group[1:] = group[1:] != group[:-1]
            inside = np.arange(len(active)) - np.maximum.accumulate(np.where(new_group, np.arange(len(active)), 0))
            slot = group + inside
            array[slot] = active
            head = np.ones(len(active), bool)
            head[1:] = key[1:] != key[:-1]
            rank[active] = np.maximum.accumulate(np.where(head, slot, 0))
            size = np.diff(np.flatnonzero(head), append=len(active))
            sizes[active] = np.repeat(size, size)
            active = active[sizes[active] > 1]
            width *= 2
        self.occurrences = Occurrences(array[np.diff(self.repeats) > 0]) if self.ranks else None

    def common_after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that starts at a and at b, a < b."""
        length = np.zeros(len(a), np.int64)
        steps = [(_GRAM << i, self.ranks[i]) for i in range(len(self.ranks) - 1, -1, -1)]
        for width, rank in [*steps, *[(1, self.words)] * (_GRAM - 1)]:
            at_a, at_b = a + length, b + length
            inside = at_b < len(self.words)
            equal = rank[at_a] == rank[np.where(inside, at_b, 0)]
            length += width * (inside & equal)
        return length

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that ends before a and before b, a < b."""
        length = np.zeros(len(a), np.int64)
        steps = [(_GRAM << i, self.ranks[i]) for i in range(len(self.ranks) - 1, -1, -1)]
        for width, rank in [*steps, *[(1, self.words)] * (_GRAM - 1)]:
            at = a - length - width
            inside = at >= 0
            equal = rank[np.where(inside, at, 0)] == rank[np.where(inside, b - length - width, 1)]
            length += width * (inside & equal)
        return length


def _candidates(suffixes: Suffixes, width: int, blocks: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of occurrences of each block within the distances of its level."""
    least, most = (1, _GRAM_PERIODS) if width == _GRAM else (2 * width - 1, 4 * width - 2)
    block, lo, hi = blocks
    find, none = suffixes.occurrences.following, len(suffixes.words)
    places, distances = [], []
    # The first occurrence looked at is the block itself.
    now, first = block, True
    while len(block):
        after = find(lo, hi, now + 1, none)
        step = after - now
        near = step <= width // 2
        last = now.copy()
        if near.any():
            stretch = step[near] + suffixes.common_after(now[near], after[near])
            last[near] += (stretch - width) // step[near] * step[near]
        if first:
            # The block's own period, where its level has to tell it.
            own = near & (step >= least)
            places.append(block[own])
            distances.append(step[own])
        else:
            step = np.where(near, step, 1)
            count = (np.minimum(last, block + most) - now) // step + 1
            member = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            places.append(np.repeat(block, count))
            distances.append(np.repeat(now - block, count) + member * np.repeat(step, count))
        first = False
        now = find(lo, hi, np.maximum(last + 1, block + least), none)
        keep = now <= np.minimum(block + most, none - 1)
        block, lo, hi, now = block[keep], lo[keep], hi[keep], now[keep]
    if not places:
        return block, block
    return np.concatenate(places), np.concatenate(distances)


def find(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs by start and period; ``text`` names each word's text.

    The last word of every text is a word between texts, which occurs nowhere else.
    """
    suffixes = Suffixes(words, text)
    found = [np.zeros((0, 3), np.int64)]
    for level, blocks in enumerate(suffixes.blocks):
        at, period = _candidates(suffixes, _GRAM << level, blocks)
        start = at - suffixes.common_before(at, at + period)
        end = at + period + suffixes.common_after(at, at + period)
        long = end - start >= np.maximum(LEAST_WORDS, 2 * period)
        found.append(np.stack([start, end, period], 1)[long])
    start, end, period = np.concatenate(found).T
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _block_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[list, list[bytes | None]]:
    """Runs of every text of a block, and what is left of it (None: all words are)."""
    begins, ends, first = common.words_of(data, offsets)
    counts = np.diff(first)
    # One word of its own after each text.
    bounds = first + np.arange(len(first))
    words = np.empty(len(begins) + len(counts), np.uint64)
    between = np.zeros(len(words), bool)
    between[bounds[1:] - 1] = True
    words[~between] = common.word_hashes(data, begins, ends)
    words[between] = common.mix(np.arange(len(counts), dtype=np.uint64), 47)
    text = np.repeat(np.arange(len(counts)), counts + 1)
    start, end, period = find(words, text)
    of = np.searchsorted(start, bounds)
    change = np.zeros(len(words) + 1, np.int32)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    kept = np.cumsum(change[:-1]) == 0
    raw = data.tobytes()
    runs, left = [], []
    for i, (a, b) in enumerate(zip(of[:-1].tolist(), of[1:].tolist(), strict=True)):
        base = int(bounds[i])
        runs.append([
            {"start": s - base, "length": e - s, "period": p}
            for s, e, p in zip(start[a:b].tolist(), end[a:b].tolist(), period[a:b].tolist(), strict=True)
        ])
        own = raw[offsets[i] : offsets[i + 1]].split()
        if a < b:
            own = [w for w, k in zip(own, kept[base : base + len(own)].tolist(), strict=True) if k]
        left.append(b" ".join(own))
    return runs, left


def find_runs(docs: DataFrame) -> DataFrame:
    """``text`` and ``rest`` of every row with its runs, by start and period, and the collapsed
    text: the words that no run holds after its first period, joined by one space."""

    def task(batches):
        for batch in batches:
            runs, left = [], []
            for _, _, data, offsets in common.text_blocks(batch, block_bytes=BLOCK_BYTES):
                more, kept = _block_runs(data, offsets)
                runs += more
                left += kept
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(runs, pa.list_(_RUN)), pa.array([x.decode() for x in left], pa.string())],
                names=["text", "rest", "runs", "collapsed"],
            )

    texts = common.keyed(docs).select("text", "rest")
    rest = texts.schema["rest"].dataType.simpleString()
    return texts.mapInArrow(
        task, f"text string, rest {rest}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    )


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where one document in ten repeats a stretch of itself to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    return (
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .withColumn("h", h)
        .withColumn("words", F.when(F.col("h") % 10 == 0, words))
        .withColumn("n", F.size("words"))
        .withColumn("a", F.expr("if(n > 0, cast((h div 10) % n as int), 0)"))
        .withColumn("p", F.expr("1 + cast((n - a) div (3 + (h div 10) % 8) as int)"))
        .withColumn("again", F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), cast((n - a) div p + 1 as int))), 1, n - a)"))
        .select("doc_id", F.expr("if(n > 0, array_join(concat(slice(words, 1, a), again), ' '), text)").alias("text"))
    )


OP11_SQL = r"""
with split as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
    xor(4294967295::bigint, list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda x: ascii(x)::bigint),
      lambda c, x: list_reduce(range(8), lambda d, k: xor(d >> 1, (d & 1) * 3988292384::bigint), xor(c, x)),
      4294967295::bigint)) as h
  from documents),
places as (
  select doc_id, words, len(words) as n, h % 10 = 0 and len(words) > 0 as planted, (h // 10) % greatest(len(words), 1) as a, h // 10 as g
  from split),
word as (
  select doc_id, i, case when planted and i >= a then words[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] else words[i + 1] end as w
  from (select *, unnest(range(0, n)) as i from places)),
equal as (
  select l.doc_id, r.i - l.i as q, l.i as i from word l join word r on l.doc_id = r.doc_id and l.w = r.w and l.i < r.i),
stretch as (
  select doc_id, q, min(i) as s, max(i) + 1 + q as e
  from (select *, i - row_number() over (partition by doc_id, q order by i) as island from equal) group by doc_id, q, island),
run as (
  select doc_id, s, e - s as n, min(q) as q from stretch where e - s >= greatest(12, 2 * q) group by doc_id, s, e),
told as (
  select doc_id, count(*) as n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' order by s, q) as lines,
    min_by({'s': s, 'n': n, 'q': q}, {'a': -n, 'b': s, 'c': q}) as top
  from run group by 1),
gone as (select distinct doc_id, i from (select doc_id, unnest(range(s + q, s + n)) as i from run)),
kept as (
  select word.doc_id, string_agg(w, ' ' order by word.i) as text
  from word anti join gone on gone.doc_id = word.doc_id and gone.i = word.i group by 1)
select p.doc_id, coalesce(t.n_runs, 0) as n_runs, t.top.s as start, t.top.n as length, t.top.q as period,
  1000 * t.top.n // t.top.q as exponent_milli, sha256(coalesce(t.lines, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
from places p left join told t on t.doc_id = p.doc_id left join kept k on k.doc_id = p.doc_id"""


def op11_periodic_runs(spark, sf_dir) -> DataFrame:
    docs = planted(common.read_table(spark, sf_dir, "documents"))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start as start, -r.period as period)))")
    lines = F.expr("concat_ws('', transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'))")
    found = find_runs(docs).select(
        F.col("rest.doc_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), longest.alias("top"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    return found.select(
        "doc_id", "n_runs", F.expr("-top.start").alias("start"), F.col("top.length").alias("length"),
        F.expr("-top.period").alias("period"), F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )
