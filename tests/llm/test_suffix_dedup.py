import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import awkward, frame

from gaugelake.llm import common
from gaugelake.llm import suffix_dedup as op


def brute(rows, length):
    rows = {(i, t): (t or "").encode() for i, t in rows}
    count = Counter(b[s:s + length] for b in rows.values() for s in range(len(b) - length + 1))
    out = {}
    for k, b in rows.items():
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if count[b[s:s + length]] > 1:
                gone[s:s + length] = True
        out[k] = len(b), bytes(np.frombuffer(b, np.uint8)[~gone]), int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
    return out


def check(spark, rows, length, gram, hot_least=op.HOT_LEAST):
    out = op.remove_repeated(frame(spark, rows, True), length, gram, hot_least).collect()
    want = defaultdict(list)
    for (i, _), v in brute(rows, length).items():
        want[i].append(v)
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_bytes, bytes(r.kept), len(r.spans)) in want[r.rest.doc_id]
        assert r.n_removed == r.n_bytes - len(r.kept) == sum(s.end - s.start for s in r.spans)


def passages(seed, edits=True):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [text(rng.randint(60, 260)) for _ in range(6)]
    rows = []
    for i in range(80):
        t = ""
        for _ in range(rng.randint(0, 4)):
            s = rng.choice(shared)
            if edits and rng.random() < 0.5:
                at = rng.randrange(len(s))
                s = s[:at] + "X" + s[at + 1:]
            a = rng.randint(0, 30)
            t += text(rng.randint(0, 80)) + s[a:len(s) - rng.randint(0, 30)]
        rows.append((i * 2, t))
    return rows + [(501, "ab" * 200), (503, "ab" * 130 + "c"), (505, "x" * 300), (507, rows[3][1]), (509, rows[3][1])]


@pytest.mark.parametrize(("seed", "length", "gram"), [(1, 100, 16), (2, 64, 8)])
def test_shared_passages(spark, seed, length, gram):
    check(spark, passages(seed), length, gram)


def test_hot_anchors(spark):
    rows = passages(3)
    check(spark, rows, 100, 16, hot_least=3)
    packed = [x.as_py() for b in op._count_anchors(3)(iter([pa.RecordBatch.from_pylist(anchor_rows(rows, 100, 16), common.schema_of(op._ANCHORS))])) for x in b.column(0)]
    assert packed.count(op._TALLY) > 2


def anchor_rows(rows, length, gram):
    texts = pa.RecordBatch.from_pydict({"place": [i for i, _ in rows], "text_key": [0] * len(rows), "text": [t for _, t in rows]})
    return [r for b in op._find_anchors(1, length, gram)(iter([texts])) for r in b.to_pylist()]


def test_awkward_rows(spark):
    rows = [(i, t[:1500] if t else t) for i, t in awkward()]
    check(spark, rows, 40, 8)
    assert op.remove_repeated(frame(spark, [])).collect() == []


def test_interval_expansion_against_sorting():
    rng = np.random.default_rng(5)
    for sigma, n, least in ((2, 300, 6), (5, 400, 4), (1, 40, 7)):
        symbols = rng.integers(3, 3 + sigma, n)
        symbols[[n // 3, n // 2, n - 1]] = [0, 1, 2]
        heads = Counter(tuple(symbols[i:i + least]) for i in range(n - least + 1) if (symbols[i:i + least] > 2).all())
        want = {i for i in range(n - least + 1) if heads[tuple(symbols[i:i + least])] > 1}
        assert set(op.long_prefixes(symbols, 3, least).tolist()) == want


@pytest.mark.parametrize("hot", [2_000, 3])
def test_repeated_rows_in_two_partitions(spark, hot):
    rng = random.Random(9)
    alone = [(i, "".join(rng.choice("abcdé ") for _ in range(300))) for i in (1001, None)]
    rows = passages(4) + alone
    # Rows of both halves meet after the shuffle only.
    docs = frame(spark, rows).unionByName(frame(spark, rows[::-1]))
    out = op.remove_repeated(docs, 100, 16, hot).collect()
    want = brute(rows, 100)
    assert sorted((str(r.rest.doc_id), r.n_bytes, bytes(r.kept), len(r.spans)) for r in out) == sorted(
        (str(i), *want[i, t]) for i, t in rows * 2)
    assert all(r.n_removed == 0 for r in out if r.rest.doc_id in (1001, None))
