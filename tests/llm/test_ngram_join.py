import random
import re

import pytest
from llm_cases import awkward, frame

from gaugelake.llm import common
from gaugelake.llm import ngram_join as op


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    key = [-(1 << 63) if i is None else i for i, _ in rows]
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i in range(len(rows)):
        least[top(i)] = min(least.get(top(i), key[i]), key[i])
    return sorted((key[i], len(sets[i]), least[top(i)]) for i in range(len(rows)))


def check(spark, rows):
    out = op.near_duplicates(frame(spark, rows, True)).collect()
    assert sorted((r.place, r.n_shingles, r.component) for r in out) == brute(rows)


def families(seed, count, copies, words=60):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    rows = []
    for _ in range(count):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, words))]
        for _ in range(rng.randint(1, copies)):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocab).upper()
            rows.append((rng.randrange(10**9), " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_families(spark, seed):
    check(spark, families(seed, 40, 9))


def test_one_large_group_and_a_hot_passage(spark, monkeypatch):
    monkeypatch.setattr(op, "HOT_CLASSES", 5)
    rows = families(3, 1, 1, 60) * 1
    rng = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(100)] = f"e{rng.randrange(1000)}"
        rows.append((5000 + i, " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(9000 + i, passage + " " + " ".join(f"q{rng.randrange(999)}" for _ in range(rng.randint(0, 30)))) for i in range(80)]
    rows += [(20000 + i, passage) for i in range(20)]
    check(spark, rows)


def test_awkward_rows(spark):
    check(spark, awkward())
    assert op.near_duplicates(frame(spark, [])).collect() == []


def test_first_of_each_group_stays(spark):
    docs = frame(spark, [(4, "a b c d e f"), (2, "A b c d e f"), (9, "other"), (8, None), (None, "")], True)
    kept = op.keep_first(docs)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "8", "9", "None"] and kept.columns == docs.columns
    assert common.NO_ID == -(1 << 63)


def kept_texts(spark, rows, parts):
    kept = op.keep_first(frame(spark, rows, True).repartition(parts))
    return sorted((str(r.doc_id), r.text or "") for r in kept.collect())


def test_one_row_of_each_group_stays_whatever_its_doc_id(spark):
    words = lambda name: " ".join(f"{name}{i}" for i in range(30))
    near = words("a") + " end"
    for parts in (1, 5):
        # A text of its own stays though its doc_id is that of a copy.
        assert kept_texts(spark, [(1, words("a")), (2, near), (2, words("b"))], parts) == [("1", words("a")), ("2", words("b"))]
        # Copies that share a doc_id, null included: one row of each group stays.
        for shared in (7, None):
            rows = [(shared, words("a"))] * 3 + [(shared, near)] * 2 + [(shared, words("b")), (shared, words("c")), (9, words("c").upper())]
            kept = kept_texts(spark, rows, parts)
            assert {i for i, _ in kept} == {str(shared)} and len(kept) == 3
            assert {t for _, t in kept} >= {words("b"), words("c")} and len({words("a"), near} & {t for _, t in kept}) == 1
        # Rows without words are linked with nothing.
        assert kept_texts(spark, [(4, ""), (4, ""), (None, None), (None, None)], parts) == [("4", "")] * 2 + [("None", "")] * 2
