"""Lexical retrieval packing: windows filled from a sharded BM25 inverted index.

Every text is encoded once and written. Document frequencies of token ids are counted over all
documents; there are at most as many as the vocabulary has ids, so they go to every task. Rows
are then ranged by their rarest ids, ties by document, which brings lexically close texts into
one partition and splits groups of copies of any size evenly. A partition is worked through in
shards of about a million tokens. Texts longer than a window give whole windows first; what is
left of each is indexed. The next unused text seeds a window: its strongest terms query the
shard's index, and unused texts fill the window by falling BM25 score; when those it offers are
used up it is asked again by all terms of the seed, until no unused text shares one. The text that does not fit is cut, and its remainder seeds the next window. What is left over at the end of a shard
goes on to the next; at the end of a partition it is cut into sequences whose lengths are
powers of two, so nothing is padded.

Results: null or empty text is its end id alone. Every row gives pieces, repeated rows their
own; a null doc_id stays null. Each id of a document lies in exactly one piece, and equal input
in equal partitions gives equal sequences. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.llm import common
from gaugelake.llm.tokens import encoded, forget, width_of
from gaugelake.session import stage

WINDOW = 2048
SHARD_TOKENS = 1_000_000
PARTITION_TOKENS = 4_000_000
# Terms of the first question; the second asks by all.
QUERY_TERMS = 16
_K1, _B = 1.2, 0.75


def document_frequencies(tokens: DataFrame, dtype: np.dtype) -> np.ndarray:
    """Documents that hold each id; as long as the largest id, so bounded by the vocabulary."""

    def task(batches):
        forget()
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                ids = np.unique(np.frombuffer(packed.as_py(), dtype))
                if len(ids) and ids[-1] >= len(counts):
                    counts = np.append(counts, np.zeros(ids[-1] + 1 - len(counts), np.int64))
                counts[ids] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(task, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = rows.toPandas()
    out = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    out[found["id"]] = found["n"]
    return out


class Shard:
    """A BM25 inverted index over token arrays."""

    def __init__(self, texts: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, docs, weights, self.queries = [], [], [], []
        for i, ids in enumerate(texts):
            found, tf = np.unique(ids, return_counts=True)
            weight = idf[found] * tf * (_K1 + 1) / (tf + _K1 * (1 - _B + _B * len(ids) / mean))
            terms.append(found)
            docs.append(np.full(len(found), i, np.int32))
            weights.append(weight)
            best = np.argpartition(-weight, QUERY_TERMS)[:QUERY_TERMS] if len(found) > QUERY_TERMS else slice(None)
            self.queries.append(found[best])
        self.terms = terms
        terms, docs, weights = np.concatenate(terms), np.concatenate(docs), np.concatenate(weights)
        order = np.argsort(terms, kind="stable")
        self.docs, self.weights = docs[order], weights[order]
        self.bounds = np.searchsorted(terms[order], np.arange(len(idf) + 1))
        self.unused = np.ones(len(texts), bool)

    def offers(self, seed: int) -> Iterator[int]:
        """Texts that share a term with a seed, unused when asked for: by its strongest terms, then by all."""
        for query in (self.queries[seed], self.terms[seed]):
            yield from self.neighbours(query).tolist()

    def neighbours(self, query: np.ndarray) -> np.ndarray:
        """Unused texts with the highest scores, best first, ties by position."""
        spans = [slice(self.bounds[t], self.bounds[t + 1]) for t in query]
        docs = np.concatenate([self.docs[s] for s in spans])
        scores = np.bincount(docs, np.concatenate([self.weights[s] for s in spans]), len(self.unused))
        scores[~self.unused] = 0
        found = np.flatnonzero(scores)
        return found[np.argsort(-scores[found], kind="stable")]


def fill(texts: list[np.ndarray], idf: np.ndarray, mean: float, open_pieces: list, window: int):
    """Yield full windows as lists of (text, start, length); leave the rest in ``open_pieces``.

    ``open_pieces`` enters with pieces of earlier shards, their text numbers below zero.
    """
    shard = Shard(texts, idf, mean)
    room = window - sum(n for _, _, n in open_pieces)
    seed, after = None, 0
    while True:
        pending = shard.offers(seed) if seed is not None else iter(())
        seed = None
        while room:
            i = next(pending, None)
            if i is None:
                while after < len(texts) and not shard.unused[after]:
                    after += 1
                if after == len(texts):
                    return
                i = after
                pending = shard.offers(i)
            if not shard.unused[i]:
                continue
            shard.unused[i] = False
            take = min(room, len(texts[i]))
            open_pieces.append((int(i), 0, take))
            room -= take
        yield list(open_pieces)
        open_pieces.clear()
        room = window
        if take < len(texts[i]):
            # A remainder is shorter than a window: it was cut from a text of at most one.
            open_pieces.append((int(i), take, len(texts[i]) - take))
            room -= len(texts[i]) - take
            seed = i


def powers_of_two(pieces: list, total: int):
    """Cut (text, start, length) pieces into sequences whose lengths are powers of two."""
    queue, size = list(pieces)[::-1], 1 << max(total, 1).bit_length()
    while total:
        size >>= 1
        if size > total:
            continue
        total -= size
        sequence, room = [], size
        while room:
            text, start, n = queue.pop()
            take = min(n, room)
            sequence.append((text, start, take))
            room -= take
            if take < n:
                queue.append((text, start + take, n - take))
        yield sequence


def _pack(dtype, idf: np.ndarray, mean: float, window: int, shard_tokens: int):
    def task(batches):
        from pyspark import TaskContext

        forget()
        next_id = TaskContext.get().partitionId() << 40
        open_pieces: list = []
        kept: dict[int, tuple] = {}  # texts that open pieces of earlier shards come from

        def out(sequences, of):
            nonlocal next_id
            rows = {k: [] for k in ("rest", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            for sequence in sequences:
                offset = 0
                for text, start, n in sequence:
                    rest, ids, base, total = of(text)
                    rows["rest"].append(rest)
                    rows["start"].append(base + start)
                    rows["length"].append(n)
                    rows["ids"].append(ids[start : start + n].astype("<u4").tobytes())
                    rows["doc_tokens"].append(total)
                    rows["sequence_id"].append(next_id)
                    rows["offset"].append(offset)
                    offset += n
                next_id += 1
            kinds = {"ids": pa.binary(), "rest": rest_type}
            return pa.RecordBatch.from_arrays(
                [pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()], names=list(rows)
            )

        def shard(rows):
            """rows: (rest, ids)"""
            nonlocal kept
            whole, tails = [], []
            for rest, ids in rows:
                cut = len(ids) // window * window
                whole += [(rest, ids, at, len(ids)) for at in range(0, cut, window)]
                if cut < len(ids):
                    tails.append((rest, ids[cut:], cut, len(ids)))
            if whole:
                cuts = [(r, ids[at : at + window], at, n) for r, ids, at, n in whole]
                yield out([[(i, 0, window)] for i in range(len(cuts))], lambda i: cuts[i])
            if tails:
                of = lambda i: tails[i] if i >= 0 else kept[i]
                found = list(fill([t[1] for t in tails], idf, mean, open_pieces, window))
                if found:
                    yield out(found, of)
                # Open pieces outlive the shard under new numbers below zero.
                kept = {-1 - k: of(i) for k, (i, _, _) in enumerate(open_pieces)}
                open_pieces[:] = [(-1 - k, s, n) for k, (_, s, n) in enumerate(open_pieces)]

        rows, size, rest_type = [], 0, None
        for batch in batches:
            rest_type = batch.column(0).type
            for rest, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(packed.as_py(), dtype)
                rows.append((rest, ids))
                size += len(ids)
                if size >= shard_tokens:
                    yield from shard(rows)
                    rows, size = [], 0
        if rows:
            yield from shard(rows)
        if open_pieces:
            total = sum(n for _, _, n in open_pieces)
            yield out(powers_of_two(open_pieces, total), kept.__getitem__)

    return task


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW,
    shard_tokens: int = SHARD_TOKENS, partition_tokens: int = PARTITION_TOKENS,
) -> DataFrame:
    """One row per piece: rest (doc_id and other columns), start, length, ids (32-bit, packed),
    doc_tokens, sequence_id and offset in the sequence."""
    tokens = stage(encoded(docs, tokenizer, end_id), "tokens")
    count, total = tokens.agg(F.count("*"), F.sum("n")).first()
    dtype = width_of(tokenizer)
    seen = document_frequencies(tokens, dtype)
    idf = np.log1p((count - seen + 0.5) / (seen + 0.5)).astype(np.float32)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, (total or 0) // partition_tokens + 1)
    order = ("rare_1", "rare_2", "place", "text_key")
    ranged = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("rest", "ids")
    rest = tokens.schema["rest"].dataType.simpleString()
    return ranged.mapInArrow(
        _pack(dtype, idf, (total or 0) / max(count, 1), window, shard_tokens),
        f"rest {rest}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )


def op1_packing(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        F.col("rest.doc_id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )
