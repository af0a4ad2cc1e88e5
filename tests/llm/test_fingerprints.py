import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm_cases import awkward, frame

from gaugelake.llm import fingerprints as op


def sets(texts):
    text, keys = op.digests([t.encode() for t in texts])
    out = [set() for _ in texts]
    for i, k in zip(text.tolist(), keys.tolist(), strict=True):
        assert k not in out[i]
        out[i].add(k)
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(spark, rows, parts):
    out = op.fingerprints(frame(spark, rows, True), parts).collect()
    place = lambda i: -(1 << 63) if i is None else i
    got = Counter((r.place, r.n_chars, r.edited_sha256, round(r.near_edited, 12), round(r.near_next, 12)) for r in out)
    by_place = {}
    for i, t in rows:
        by_place.setdefault(place(i), []).append(t or "")
    texts = [(p, t) for p in sorted(by_place, reverse=True) for t in by_place[p]]
    if all(len(set(x)) == 1 for x in by_place.values()):
        want = Counter()
        for k, (p, t) in enumerate(texts):
            following = texts[(k + 1) % len(texts)][1]
            cut = len(t) // 3
            changed = t[:len(t) - cut] + following[:cut]
            a, b, c = sets([t, changed, following])
            want[p, len(t), hashlib.sha256(changed.encode()).hexdigest(), round(jaccard(a, b), 12), round(jaccard(a, c), 12)] += 1
        assert got == want
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_neighbours_and_edits(spark, parts):
    rng = random.Random(9)
    word = lambda: rng.choice(["a", "bb", "ç", "dd.", "\n", "𝄞x"]) + str(rng.randrange(50))
    rows = [(rng.randrange(-50, 10**12), " ".join(word() for _ in range(rng.randint(0, 300)))) for _ in range(60)]
    check(spark, rows + [(7, "same text"), (7, "same text"), (None, "last"), (8, None)], parts)


def test_awkward_rows(spark):
    out = check(spark, awkward(), 4)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    check(spark, [(5, "only one here")], 4)
    assert op.fingerprints(frame(spark, [])).collect() == []


def test_equal_texts_have_equal_fingerprints(spark):
    rows = [(i, ["one two three\nfour five six", "seven"][i % 2]) for i in range(10)]
    prints = {(r.place % 2, r.fingerprint) for r in op.fingerprints(frame(spark, rows)).collect()}
    assert len(prints) == 2


def test_peeling_recovers_the_difference_at_any_size():
    rng = np.random.default_rng(3)
    for size, change in ((0, 0), (5, 1), (400, 3), (400, 400), (5000, 2500)):
        a = rng.integers(0, 1 << 63, size).astype(np.uint64)
        b = a.copy()
        b[:change] = rng.integers(0, 1 << 63, change).astype(np.uint64)
        found = op.likeness(1, np.zeros(size, np.int64), a, np.zeros(size, np.int64), b)
        assert found[0] == pytest.approx(jaccard(set(a.tolist()), set(b.tolist())))
