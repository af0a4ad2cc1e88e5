"""N-gram Jaccard join: near-duplicate documents by prefixes under several global orders.

A document's set holds its distinct five-word shingles. One scan hashes the sets; documents
with equal sets form a class and go on as one. Shingles travel packed to buckets by hash, which
count the classes that hold each of them. A shingle that many classes of one block share goes
to its bucket as a number only; the classes of the block join that count later by key, so no
bucket gathers the holders of a hot shingle. Only shared shingles come back, so a class of
which less than the threshold is shared, and with it most documents, is done.

Global orders put rare shingles first and break ties by different hashes. Two sets that reach
the threshold share a shingle of their prefixes under every order. Pairs come from the first
order's prefixes, are dropped where the prefixes under the other orders share nothing (first by
64-bit summaries, then exactly), and only then verified. Groups are not expanded into all
pairs: each prefix shingle first pairs its members with one hub, the one with the fewest
shingles of its own; pairs are enumerated only between members that verified links have not yet
connected, and at the first of the shingles they share, not at each of them. So every pair that could link is either verified or already connected.

Results: null or empty text has an empty set and is alone; component_id is its own doc_id.
Fewer than five words make one shingle of all. Repeated rows link with each other; a null
doc_id is the smallest. An empty table gives no rows. Sets are compared by 48-bit shingle
hashes and classes told apart by 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugelake.llm import common
from gaugelake.session import stage

SHINGLE_WORDS = 5
PERCENT = 80
ORDERS = 3
# A shingle is hot that so many classes of a block of texts share.
HOT_CLASSES, BLOCK_BYTES = 32, 2 << 20
HUB_ROUNDS = 6
# Hub rounds end when enumerating what is left costs no more than this.
PAIRS_PER_HOLDER = 20
LEAD = 32
# Words of the bitmaps that bound what two sets can share.
MAP_WORDS = 16
SALTS = 16

_DOC, _COLD, _HOT, _LIST = range(4)
_PACKED = "bucket int, kind int, classes binary, sizes binary, counts binary, items binary"
_FOUND = "kind int, cls long, n int, place long, text_key long, items binary, counts binary"


def sets_of(data: np.ndarray, offsets: np.ndarray, width: int):
    """(text, item) of all distinct shingles of a block of texts, by text, then item."""
    data = common.LOWER[data]
    begins, ends, first = common.words_of(data, offsets)
    words = common.word_hashes(data, begins, ends)
    at, text = common.window_starts(first, width)
    items = common.window_hashes(words, width)[at] if len(at) else np.zeros(0, np.uint64)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < width))
    whole = common.span_hash(words, first[short], first[short + 1], 0x8CB92BA72F3D8DD7)
    whole = common.mix(whole ^ counts[short].astype(np.uint64), 3)
    text, items = np.concatenate([text, short]), np.concatenate([items, whole]) >> np.uint64(16)
    order = np.lexsort((items, text))
    text, items = text[order], items[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (items[1:] != items[:-1])
    return text[new], items[new]


def _hash_sets(parts: int, width: int):
    schema = common.schema_of(_PACKED)

    def row(bucket, kind, classes, sizes, counts, items):
        return {"bucket": int(bucket), "kind": kind, "classes": classes.tobytes(), "sizes": sizes.astype(np.int32).tobytes(),
                "counts": counts.astype(np.int32).tobytes(), "items": common.planes(items)}

    def block(places, keys, data, offsets):
        text, items = sets_of(data, offsets, width)
        sizes = np.bincount(text, minlength=len(places))
        total = np.zeros((2, len(places)), np.uint64)
        heads = np.flatnonzero(np.diff(text, prepend=-1))
        for k in (0, 1):
            if len(heads):
                total[k, text[heads]] = np.add.reduceat(common.mix(items, k + 11), heads)
        classes = common.mix(total[0] ^ common.mix(total[1] + sizes.astype(np.uint64))).view(np.int64)
        yield row(classes[0] % parts, _DOC, classes, sizes, np.zeros(0), np.concatenate([places, keys]).view(np.uint64))
        # Of equal sets one goes on.
        lead = np.zeros(len(places), bool)
        lead[np.unique(classes, return_index=True)[1]] = True
        keep = lead[text]
        text, items = text[keep], items[keep]
        if not len(text):
            return
        order = np.argsort(items, kind="stable")
        starts = np.flatnonzero(np.diff(items[order], prepend=items[order[0]] ^ np.uint64(1)))
        lengths = np.diff(starts, append=len(order))
        hot = lengths >= HOT_CLASSES
        cold = np.sort(order[np.repeat(~hot, lengths)])
        buckets = common.buckets_of(items, parts)
        order_cold = cold[np.argsort(buckets[cold], kind="stable")]
        for part in np.split(order_cold, np.flatnonzero(np.diff(buckets[order_cold])) + 1):
            if len(part):
                top = np.flatnonzero(np.diff(text[part], prepend=-1))
                owners = text[part[top]]
                yield row(buckets[part[0]], _COLD, classes[owners], sizes[owners], np.diff(top, append=len(part)), items[part])
        if hot.any():
            heads = order[starts[hot]]
            to = np.argsort(buckets[heads], kind="stable")
            for part in np.split(to, np.flatnonzero(np.diff(buckets[heads[to]])) + 1):
                yield row(buckets[heads[part[0]]], _HOT, np.zeros(0), np.zeros(0), lengths[hot][part], items[heads[part]])
            for start, length in zip(starts[hot], lengths[hot], strict=True):
                owners = text[order[start : start + length]]
                yield row(classes[owners[0]] % parts, _LIST, classes[owners], sizes[owners], np.zeros(0), items[order[start : start + 1]])

    def task(batches):
        for batch in batches:
            places, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, last, data, offsets in common.text_blocks(batch, block_bytes=BLOCK_BYTES):
                for packed in block(places[first:last], keys[first:last], data, offsets):
                    yield pa.RecordBatch.from_pylist([packed], schema)

    return task


def _count_bucket(batches):
    """Pass documents and lists of hot shingles on; return shared shingles and hot counts."""
    schema = common.schema_of(_FOUND)

    def out(kind, rows, **columns):
        arrays = {"kind": np.full(rows, kind, np.int32), "cls": np.zeros(rows, np.int64), "n": np.zeros(rows, np.int32), "place": np.zeros(rows, np.int64), "text_key": np.zeros(rows, np.int64)}
        arrays |= columns
        return pa.RecordBatch.from_arrays([
            pa.array(arrays[f.name], f.type) if f.name in arrays else pa.nulls(rows, f.type) for f in schema
        ], schema=schema)

    cold, hot = [], []
    for batch in batches:
        for r in batch.to_pylist():
            classes, sizes = np.frombuffer(r["classes"], np.int64), np.frombuffer(r["sizes"], np.int32)
            counts, items = np.frombuffer(r["counts"], np.int32), common.from_planes(r["items"], np.uint64)
            if r["kind"] == _DOC:
                places, keys = np.split(items.view(np.int64), 2)
                yield out(_DOC, len(classes), cls=classes, n=sizes, place=places, text_key=keys)
            elif r["kind"] == _LIST:
                yield out(_LIST, 1, cls=items.view(np.int64), items=[r["classes"]], counts=[r["sizes"]])
            elif r["kind"] == _HOT:
                hot.append((items, counts))
            else:
                cold.append((np.repeat(classes, counts), np.repeat(sizes, counts), items))
    hot_items, hot_counts = (np.concatenate(x) for x in zip(*hot, strict=True)) if hot else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    hot_items, where = np.unique(hot_items, return_inverse=True)
    df_hot = np.bincount(where, hot_counts, len(hot_items)).astype(np.int64)
    if cold:
        classes, sizes, items = (np.concatenate(x) for x in zip(*cold, strict=True))
        cold.clear()
        order = np.argsort(items, kind="stable")
        same = items[order][1:] == items[order][:-1]
        member = np.zeros(len(order), bool)
        member[1:] |= same
        member[:-1] |= same
        if len(hot_items):
            member |= np.isin(items[order], hot_items)
        order = order[member]
        classes, sizes, items = classes[order], sizes[order], items[order]
        order = np.lexsort((classes, items))
        classes, sizes, items = classes[order], sizes[order], items[order]
        new = np.ones(len(items), bool)
        new[1:] = (items[1:] != items[:-1]) | (classes[1:] != classes[:-1])
        classes, sizes, items = classes[new], sizes[new], items[new]
        found, where, df = np.unique(items, return_inverse=True, return_counts=True)
        if len(hot_items) and len(found):
            at = np.minimum(np.searchsorted(hot_items, found), len(hot_items) - 1)
            df = df + np.where(hot_items[at] == found, df_hot[at], 0)
            # A bucket's own holders of a hot shingle count for the lists of other blocks.
            at = np.minimum(np.searchsorted(found, hot_items), len(found) - 1)
            df_hot = np.where(found[at] == hot_items, df[at], df_hot)
        df = df[where]
        shared = df > 1
        classes, sizes, items, df = classes[shared], sizes[shared], items[shared], df[shared]
        if len(classes):
            order = np.argsort(classes, kind="stable")
            classes, sizes, items, df = classes[order], sizes[order], items[order], df[order].astype(np.int32)
            heads = np.flatnonzero(np.diff(classes, prepend=~classes[0]))
            bounds = list(zip(heads.tolist(), [*heads[1:].tolist(), len(classes)], strict=True))
            yield out(_COLD, len(heads), cls=classes[heads], n=sizes[heads],
                      items=[items[a:b].tobytes() for a, b in bounds], counts=[df[a:b].tobytes() for a, b in bounds])
    if len(hot_items):
        yield out(_HOT, len(hot_items), cls=hot_items.view(np.int64), n=np.minimum(df_hot, 2**31 - 1).astype(np.int32))


def _spread(batches):
    """Lists of hot shingles with their counts as shingles of each class."""
    for batch in batches:
        packed: dict[int, list] = {}
        for item, df, classes, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pair = np.array([item], np.int64).tobytes(), np.array([df], np.int32).tobytes()
            for c, n in zip(np.frombuffer(classes, np.int64).tolist(), np.frombuffer(sizes, np.int32).tolist(), strict=True):
                of = packed.setdefault(c, [n, [], []])
                of[1].append(pair[0])
                of[2].append(pair[1])
        if packed:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(packed), pa.int64()), pa.array([v[0] for v in packed.values()], pa.int32()),
                 pa.array([b"".join(v[1]) for v in packed.values()], pa.binary()), pa.array([b"".join(v[2]) for v in packed.values()], pa.binary())],
                names=["cls", "n", "items", "counts"],
            )


def least_overlap(n, percent: int):
    """Fewest common members of a set of ``n`` with any set that reaches the threshold."""
    return -(-percent * n // 100)


def prefix(items: np.ndarray, df: np.ndarray, n: int, order: int, percent: int) -> np.ndarray:
    """Shared members among the first n - overlap + 1 of a set under a global order.

    Rare shingles come first, by powers of two of their count; the order's hash breaks ties.
    Those that no other class holds precede all others and match nothing.
    """
    rank = np.lexsort((common.mix(items, 100 + order), np.frexp(df.astype(np.float64))[1]))
    return items[rank[: len(items) - least_overlap(n, percent) + 1]]


def _summary(items: np.ndarray) -> int:
    bits = np.bitwise_or.reduce(np.uint64(1) << (common.mix(items, 5) >> np.uint64(58)))
    return int(bits.astype(np.uint64).view(np.int64))


def _bitmap(items: np.ndarray) -> np.ndarray:
    """A bit for each member, by hash: a bit of one set that another lacks is a member it lacks."""
    at = (common.mix(items, 6) >> np.uint64(32)) % np.uint64(64 * MAP_WORDS)
    bits = np.zeros(64 * MAP_WORDS, np.uint8)
    bits[at.astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _candidates(percent: int):
    """Sets of which enough is shared, with their prefix and summaries of the other prefixes."""

    def task(batches):
        for batch in batches:
            rows = []
            for cls, n, packed, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                items, first = np.unique(np.frombuffer(b"".join(packed), np.uint64), return_index=True)
                if len(items) < least_overlap(n, percent):
                    continue
                df = np.frombuffer(b"".join(counts), np.int32)[first]
                sums = [_summary(prefix(items, df, n, k, percent)) for k in range(1, ORDERS)]
                rows.append((cls, n, n - len(items), items.tobytes(), df.tobytes(), sums,
                             prefix(items, df, n, 0, percent).view(np.int64), _bitmap(items)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                        pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3), strict=True)],
                    names=["cls", "n", "own", "items", "df", "sums", "prefix", "bits"],
                )

    return task


def _verify(percent: int):
    def linked(n_a, items_a, df_a, n_b, items_b, df_b) -> bool:
        a, b = np.frombuffer(items_a, np.uint64), np.frombuffer(items_b, np.uint64)
        df = [np.frombuffer(x, np.int32) for x in (df_a, df_b)]
        for k in range(1, ORDERS):
            if not len(np.intersect1d(prefix(a, df[0], n_a, k, percent), prefix(b, df[1], n_b, k, percent), assume_unique=True)):
                return False
        common_items = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * common_items >= percent * (n_a + n_b - common_items)

    def task(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            links = [(a, b) for a, b, *pair in zip(*columns, strict=True) if linked(*pair)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"]
            )

    return task


def _checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold."""
    for side in ("a", "b"):
        of = sets.select(F.col("cls").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "items", "df")))
        pairs = pairs.join(of, side)
    return pairs.select("a", "b", "n_a", "items_a", "df_a", "n_b", "items_b", "df_b").mapInArrow(_verify(percent), "a long, b long")


def _may_link(percent: int, a: str, b: str):
    """Sizes, shared members and the summaries of the other orders' prefixes allow a link.

    What no other class holds can't be common, so the rest of the smaller set bounds the
    overlap. ``a`` and ``b`` are prefixes of column names.
    """
    most = F.least(F.col(f"{a}n") - F.col(f"{a}own"), F.col(f"{b}n") - F.col(f"{b}own"))
    out = most * 100 >= (F.col(f"{a}n") + F.col(f"{b}n") - most) * percent
    for k in range(ORDERS - 1):
        out &= F.col(f"{a}sums")[k].bitwiseAND(F.col(f"{b}sums")[k]) != 0
    return out


def _enough_common(percent: int, a: str, b: str):
    """The members that one bitmap has and the other lacks leave enough to share."""

    def lacking(x: str, y: str):
        out = F.lit(0)
        for k in range(MAP_WORDS):
            out += F.bit_count(F.col(f"{x}bits")[k].bitwiseAND(F.bitwise_not(F.col(f"{y}bits")[k])))
        return out

    # 100 * shared >= percent * (sum - shared), for either side's bound on what is shared.
    needed = (F.col(f"{a}n") + F.col(f"{b}n")) * percent
    sides = [((F.col(f"{x}n") - F.col(f"{x}own") - lacking(x, y)) * (100 + percent) >= needed) for x, y in ((a, b), (b, a))]
    return sides[0] & sides[1]


def _pair(left: str, right: str) -> list:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _with_lead(holders: DataFrame, sets: DataFrame) -> DataFrame:
    """Add ``bits`` and ``lead``: up to ``LEAD`` members that come before a holder's item in its prefix.

    Prefixes follow one global order, so two sets that share several prefix members meet first at
    the same one, and the leads of all later meetings overlap. What lies beyond a lead can only
    let a pair meet twice.
    """
    placed = sets.join(holders.select("cls").distinct(), "cls", "left_semi").select("cls", "prefix", "bits", F.posexplode("prefix").alias("at", "item"))
    leads = placed.select("cls", "item", "bits", F.slice("prefix", F.lit(1), F.least("at", F.lit(LEAD))).alias("lead"))
    return holders.join(leads, ["cls", "item"])


def linked_classes(shared: DataFrame, percent: int) -> DataFrame | None:
    """(node, root) of classes that links connect, from (cls, n, items, counts) rows."""
    grouped = shared.groupBy("cls").agg(F.max("n").alias("n"), F.collect_list("items").alias("items"), F.collect_list("counts").alias("counts"))
    sets = stage(grouped.mapInArrow(
        _candidates(percent), "cls long, n int, own int, items binary, df binary, sums array<long>, prefix array<long>, bits array<long>"), "sets")
    holders = sets.select(F.explode("prefix").alias("item"), "cls", "n", "own", "sums")
    groups = holders.groupBy("item").count().where("count > 1").select("item")
    holders = stage(holders.join(groups, "item"), "holders")
    size = holders.count()
    if not size:
        return None
    links = tested = None
    before = float("inf")
    now = holders.withColumn("root", F.col("cls"))
    for turn in range(HUB_ROUNDS):
        first = F.lit(0.0) if turn else F.col("own") / F.col("n")
        rank = F.struct(first.alias("first"), F.xxhash64("cls", F.lit(turn)).alias("tie"), "cls", "n", "own", "sums", "root")
        hubs = now.groupBy("item").agg(F.min(rank).alias("hub"))
        pairs = now.alias("m").join(hubs.alias("h"), "item").select(*(F.col(f"m.{c}").alias(c) for c in ("cls", "n", "own", "sums", "root")), "hub")
        pairs = pairs.where("root <> hub.root").where(_may_link(percent, "", "hub."))
        pairs = pairs.select(*_pair("cls", "hub.cls")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stage(pairs, "pairs")
        found = stage(_checked(pairs, sets, percent), "links")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        roots = common.components(links, "components")
        now = holders.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        parts = now.groupBy("item", "root").count().groupBy("item").agg(
            F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("squares"), F.count("*").alias("roots"))
        left = stage(parts.where("roots > 1"), "open")
        apart = left.agg(F.sum((F.col("n") * F.col("n") - F.col("squares")) / 2)).first()[0] or 0
        if not apart:
            return roots
        now = stage(now.join(left.select("item"), "item", "left_semi"), "apart")
        # A round that no longer connects much costs more than it saves.
        if apart <= PAIRS_PER_HOLDER * size or apart > before / 2:
            break
        before = apart
    now = stage(_with_lead(now, sets), "leads")
    a, b = now.alias("a"), now.alias("b")
    pairs = a.join(b, F.col("a.item") == F.col("b.item")).where("a.cls < b.cls and a.root <> b.root").where(_may_link(percent, "a.", "b."))
    # Whoever shares an earlier member has met there: holders of an open member apart are apart in all they share.
    pairs = pairs.where(_enough_common(percent, "a.", "b.")).where(~F.arrays_overlap("a.lead", "b.lead"))
    pairs = pairs.select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    found = stage(_checked(stage(pairs, "pairs"), sets, percent), "links")
    return common.components(links.unionByName(found), "components")


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(place, text_key, cls, n_shingles, component, first_key): one row per row of ``docs``.

    ``component`` and ``first_key`` are place and text_key of the first document of the group;
    text_key orders documents that share a place.
    """
    texts = common.keyed(docs).select("place", "text_key", "text")
    parts = max(8, common.partitions_for(docs, 32 << 20))
    packed = texts.mapInArrow(_hash_sets(parts, width), _PACKED)
    found = stage(common.deal(packed, parts).mapInArrow(_count_bucket, _FOUND), "shingles")
    cold = found.where(f"kind = {_COLD}").select("cls", "n", "items", "counts")
    lists = found.where(f"kind = {_LIST}").select(F.col("cls").alias("item"), F.col("items").alias("classes"), F.col("counts").alias("sizes"))
    counts = found.where(f"kind = {_HOT} and n > 1").select(F.col("cls").alias("item"), F.col("n").alias("df"))
    hot = lists.join(counts, "item").select("item", "df", "classes", "sizes")
    hot = hot.mapInArrow(_spread, "cls long, n int, items binary, counts binary")
    roots = linked_classes(cold.unionByName(hot), percent)
    rows = found.where(f"kind = {_DOC}").select("place", "text_key", "cls", "n")
    if roots is None:
        rows = rows.withColumn("root", F.col("cls"))
    else:
        rows = rows.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rows = stage(rows, "classes")
    least = rows.where("n > 0").groupBy("root").agg(F.min(F.struct("place", "text_key")).alias("least"))
    first = F.when(F.col("n") > 0, F.col("least")).otherwise(F.struct("place", "text_key"))
    return rows.join(least, "root", "left").select(
        "place", "text_key", "cls", F.col("n").cast("long").alias("n_shingles"),
        first["place"].alias("component"), first["text_key"].alias("first_key"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One row, all columns, of every group that links connect: the first by doc_id, then text_key.

    A null doc_id is the smallest. Of rows equal in doc_id and text one stays, with the least
    other columns as JSON; rows without words are linked with nothing and all stay.
    """
    # Documents to drop, and those of which several rows are there to keep one of.
    first = (F.col("place") == F.col("component")) & (F.col("text_key") == F.col("first_key"))
    found = near_duplicates(docs).where("n_shingles > 0").select("place", "text_key", first.alias("first"))
    found = found.groupBy("place", "text_key", "first").count().where("not first or count > 1")
    found = stage(found.select("place", "text_key", "first"), "linked")
    repeated = stage(found.where("first").select("place", "text_key"), "repeated")
    texts, key = common.keyed(docs), ["place", "text_key"]
    single = texts.join(found, key, "left_anti")
    # Salted, so rows of one key combine in many tasks before they meet.
    salts = repeated.select(*key, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = texts.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    one = salted.join(salts, [*key, "salt"], "left_semi").groupBy(*key).agg(
        F.first("text").alias("text"), F.min_by("rest", F.to_json("rest")).alias("rest"))
    return single.select(*common.unkeyed(docs)).unionByName(one.select(*common.unkeyed(docs)))


def op4_ngram_jaccard_join(spark, sf_dir) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    id_of = lambda c: F.when(F.col(c) != common.NO_ID, F.col(c))
    return near_duplicates(docs).select(
        id_of("place").alias("doc_id"), "n_shingles", id_of("component").alias("component_id"), F.col("cls").alias("class_id")
    )
