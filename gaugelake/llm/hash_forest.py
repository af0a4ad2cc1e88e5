"""Approximate nearest neighbours by a hash-prefix forest.

A tree is a sorted array of 64-bit hash strings, each bit the side of a random hyperplane that a
vector lies on, so vectors at an angle a agree in a bit with chance 1 - a / pi. A query descends
in every tree to the longest prefix it shares with anything and then ascends in all trees
together, one bit at a time; whatever shares the shorter prefix in a tree is a candidate and is
measured, first in single precision with a bound of its error, then in double. It stops when a vector as near as the k-th best found so
far would have been missed by all trees with a chance of at most ``MISS``: (1 - p^x)^trees for
prefix length x. So queries with close neighbours stop deep down, and others go on, up to the
root (all rows) if need be: the answer does not depend on a limit of candidates.

Rows are dealt by a hash of id and vector into shards of about ``SHARD_ROWS`` or ``SHARD_VALUES`` numbers at most, so groups
of equal vectors are split evenly and repeated rows meet. Every shard builds its own forest; the
queries (a fiftieth of the rows) go to each of them, and the k best of every shard are merged by
sums with partial aggregation. Nothing is fitted and nothing goes through the driver but counts.
The traffic of queries grows with rows x shards; shards are as large as a task's memory allows.

Results: a vector that is null, zero, or holds a null, a NaN or an infinity takes no part.
Vectors of different lengths are never compared. Rows equal in id and vector are one; a query
does not find rows of its own id, and a candidate's null id sorts first among ties. Equal
vectors have equal scores. Fewer than k candidates give as many rows. Empty tables give none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.llm import common

NEIGHBOURS = 5
QUERY_EVERY = 50
TREES = 24
MISS = 0.2
BITS = 64
SHARD_ROWS, SHARD_VALUES = 1 << 18, 1 << 24
_FEW_ROWS, _FEW_SHARDS = 1 << 13, 48
_FIRST = 32
_QUERY_BLOCK = 2_048


def planes(trees: int, width: int) -> np.ndarray:
    """Normals of the hyperplanes, the same in every task."""
    return np.random.default_rng(20_077 + width).standard_normal((width, trees * BITS)).astype(np.float32)


def hash_strings(vectors: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """One row of 64-bit strings per tree, most significant bit first."""
    trees = normals.shape[1] // BITS
    out = np.empty((trees, len(vectors)), np.uint64)
    for first in range(0, len(vectors), 8_192):
        sides = vectors[first : first + 8_192].astype(np.float32) @ normals > 0
        packed = np.packbits(sides.reshape(len(sides), trees, BITS), axis=2)
        out[:, first : first + len(sides)] = packed.view(">u8")[:, :, 0].T
    return out


class Forest:
    """Sorted hash strings of one shard, and its vectors in double precision."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors**2).sum(axis=1))
        self.units = (vectors / self.norms[:, None]).astype(np.float32)
        # More than single precision can be wrong by in a product of unit vectors.
        self.slack = 1e-6 + 2.4e-7 * vectors.shape[1]
        self.normals = planes(trees, vectors.shape[1])
        strings = hash_strings(vectors, self.normals)
        self.order = np.argsort(strings, axis=1).astype(np.int32)
        self.sorted = np.take_along_axis(strings, self.order, axis=1)
        self.seen = np.zeros(len(ids), bool)
        self.mark = np.zeros(len(ids), np.int32)

    def ranges(self, strings: np.ndarray, length: int) -> np.ndarray:
        """First and last + 1, per tree and query, of the strings that share its first ``length`` bits."""
        if not length:
            return np.stack([np.zeros(strings.shape, np.int64), np.full(strings.shape, len(self.ids))])
        low = strings >> np.uint64(BITS - length) << np.uint64(BITS - length)
        high = low | np.uint64((1 << (BITS - length)) - 1)
        pairs = list(zip(self.sorted, low, high, strict=True))
        return np.stack([
            [np.searchsorted(s, a, "left") for s, a, _ in pairs], [np.searchsorted(s, b, "right") for s, _, b in pairs],
        ])

    def deepest(self, strings: np.ndarray) -> np.ndarray:
        """Longest prefix of each query that anything shares in any tree."""
        longest = np.zeros(strings.shape[1], np.int64)
        for tree, mine in zip(self.sorted, strings, strict=True):
            at = np.searchsorted(tree, mine)
            for near in (np.minimum(at, len(tree) - 1), np.maximum(at - 1, 0)):
                differ = tree[near] ^ mine
                # Rounding can make it one bit too long: that range is empty and the ascent goes on.
                bits = np.ceil(np.log2(differ.astype(np.float64) + 1)).astype(np.int64)
                longest = np.maximum(longest, BITS - np.minimum(bits, BITS))
        return longest

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, k: int, miss: float):
        """(query, id, score) arrays: the k best found for each query."""
        strings = hash_strings(queries, self.normals)
        levels = self.deepest(strings)
        at = {}  # ranges by level, for all queries of the block
        out_query, out_row, out_score = [], [], []
        for i in range(len(queries)):
            rows, scores = self._ascend(i, int(levels[i]), strings, at, query_ids[i], queries[i].astype(np.float64), k, miss)
            out_query.append(np.full(len(rows), i))
            out_row.append(rows)
            out_score.append(scores)
        row = np.concatenate(out_row)
        return np.concatenate(out_query), self.ids[row], np.concatenate(out_score)

    def _ascend(self, i, level, strings, at, query_id, query, k, miss):
        """Rows and scores of the best found, from the deepest level up for all trees at once."""
        norm = np.sqrt((query * query).sum())
        unit = (query / norm).astype(np.float32)
        seen, touched = self.seen, []
        best_row, best_score = np.zeros(0, np.int64), np.zeros(0)
        below = np.zeros((2, len(self.sorted)), np.int64)
        while True:
            if level not in at:
                at[level] = self.ranges(strings, level)
            now = at[level][:, :, i]
            more = np.flatnonzero(now[1] - now[0] > below[1] - below[0])
            if level and (not len(more) or (now[1] - now[0]).sum() < _FIRST * k):
                # Too little to tell how far the ascent must go.
                level -= 1
                continue
            if level == 0:
                found = np.arange(len(self.ids))
            else:
                parts = [self.order[0][:0]]
                for t, lo, hi, a, b in zip(more.tolist(), *now[:, more].tolist(), *below[:, more].tolist(), strict=True):
                    parts += [self.order[t][lo:a], self.order[t][b:hi]] if a < b else [self.order[t][lo:hi]]
                found = np.concatenate(parts)
            found = found[~seen[found]]
            if level and len(found):
                # A row can turn up in several trees at once; the last place of each stays.
                places = np.arange(len(found), dtype=np.int32)
                self.mark[found] = places
                found = found[self.mark[found] == places]
            if len(found):
                seen[found] = True
                touched.append(found)
                found = found[self.ids[found] != query_id]
                near = self.units.take(found, axis=0) @ unit
                bar = best_score[-1] if len(best_score) == k else -2.0
                if len(near) > k:
                    bar = max(bar, np.partition(near, -k)[-k])
                # What is returned is summed in double precision, the same way for equal vectors.
                rows = found[near >= bar - 2 * self.slack]
                exact = (self.vectors[rows] * query).sum(axis=1) / (self.norms[rows] * norm)
                rows, scores = np.concatenate([best_row, rows]), np.concatenate([best_score, exact])
                order = np.lexsort((self.ids[rows], -scores))[:k]
                best_row, best_score = rows[order], scores[order]
            if level == 0:
                break
            if len(best_row) == k:
                agree = 1 - np.arccos(np.clip(best_score[-1], -1, 1)) / np.pi
                if (1 - agree**level) ** len(self.sorted) <= miss:
                    break
            below = now
            level -= 1
        for rows in touched:
            seen[rows] = False
        return best_row, best_score


def usable(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and vector (double) of the rows that take part, repeated rows once more."""
    vector = F.col(f"`{vector_column}`").cast("array<double>")
    rows = table.select(F.col(f"`{id_column}`").cast("long").alias("id"), vector.alias("vector"))
    return rows.where(
        "vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) "
        "and exists(vector, x -> x <> 0)"
    )


def _search(k: int, trees: int, miss: float):
    schema = common.schema_of("query_id long, query_key long, id long, score double")

    def matrices(batch):
        """(rows of the batch, matrix) for each length of vector."""
        lists = batch.column(batch.schema.get_field_index("vector"))
        lengths = lists.value_lengths().to_numpy()
        flat = lists.flatten().to_numpy()
        starts = np.cumsum(lengths) - lengths
        for width in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == width)
            yield width, rows, flat[starts[rows][:, None] + np.arange(width)]

    def task(batches):
        forests: dict[int, Forest] | None = None
        ids, marks, vectors = {}, {}, {}
        waiting: dict[int, list] = {}

        def built():
            made = {}
            for width in list(ids):
                some_ids, keys, some = (np.concatenate(x.pop(width)) for x in (ids, marks, vectors))
                # Repeated rows lie in one shard.
                order = np.lexsort((keys, some_ids))
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(some_ids[order]) != 0) | (np.diff(keys[order]) != 0)
                made[width] = Forest(some_ids[order[new]], some[order[new]], trees)
            return made

        def answers(width):
            parts = waiting.pop(width)
            query_ids, keys, queries = (np.concatenate(x) for x in zip(*parts, strict=True))
            if width not in forests:
                return
            for first in range(0, len(queries), _QUERY_BLOCK):
                part = slice(first, first + _QUERY_BLOCK)
                query, found, score = forests[width].nearest(query_ids[part], queries[part], k, miss)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_ids[part][query]), pa.array(keys[part][query]), pa.array(found), pa.array(score)], schema=schema)

        for batch in batches:
            is_query = batch.column(0).to_numpy(zero_copy_only=False)
            own = batch.column(1).fill_null(common.NO_ID).to_numpy()
            keys = batch.column(2).to_numpy()
            for width, rows, matrix in matrices(batch):
                asks = is_query[rows]
                if not asks.all():
                    ids.setdefault(width, []).append(own[rows[~asks]])
                    marks.setdefault(width, []).append(keys[rows[~asks]])
                    vectors.setdefault(width, []).append(matrix[~asks])
                if asks.any():
                    # Queries come after all rows of their shard.
                    forests = forests if forests is not None else built()
                    waiting.setdefault(width, []).append((own[rows[asks]], keys[rows[asks]], matrix[asks]))
                    if sum(len(w[0]) for w in waiting[width]) >= _QUERY_BLOCK:
                        yield from answers(width)
        for width in list(waiting):
            yield from answers(width)

    return task


def nearest(
    table: DataFrame, queries: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
    k: int = NEIGHBOURS, trees: int = TREES, miss: float = MISS, shard_rows: int = SHARD_ROWS, shard_values: int = SHARD_VALUES,
) -> DataFrame:
    """query_id, rank, id and score of the k nearest rows of ``table`` found for each row of ``queries``."""
    key = F.xxhash64("id", "vector").alias("key")
    rows = usable(table, id_column, vector_column).select("id", key, "vector")
    count, values = rows.agg(F.count("*"), F.sum(F.size("vector"))).first()
    shards = max(-(-count // shard_rows), -(-(values or 0) // shard_values), min(_FEW_SHARDS, -(-count // _FEW_ROWS)), 1)
    points = rows.select(F.pmod("key", F.lit(shards)).cast("int").alias("bucket"), F.lit(False).alias("asks"), "id", "key", "vector")
    asked = usable(queries, id_column, vector_column).select("id", key, "vector").dropDuplicates(["id", "key"])
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("bucket")
    sent = asked.select(everywhere, F.lit(True).alias("asks"), "id", "key", "vector")
    dealt = common.deal(points.unionByName(sent), shards).sortWithinPartitions("asks").select("asks", "id", "key", "vector")
    found = dealt.mapInArrow(_search(k, trees, miss), "query_id long, query_key long, id long, score double")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "id"))), 1, k)
    ranked = found.groupBy("query_id", "query_key").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("place", "one"))
    return ranked.select(
        "query_id", (F.col("place") + 1).alias("rank"), F.when(F.col("one.id") != common.NO_ID, F.col("one.id")).alias("id"),
        (-F.col("one.far")).alias("score"),
    )


def op13_nearest_neighbours(spark, sf_dir) -> DataFrame:
    table = common.read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = nearest(table, table.where(F.col("vec_id") % QUERY_EVERY == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
