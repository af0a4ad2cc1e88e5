import hashlib
import random
import re
from collections import defaultdict

from llm_cases import awkward, frame

from gaugelake.llm import substring_dedup as op


def brute(rows, width):
    rows = sorted({(i, t) for i, t in rows}, key=lambda r: (-(1 << 63) if r[0] is None else r[0]))
    seen, words, hit = set(), {}, defaultdict(set)
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        words[i, t] = w
        for s in range(len(w) - width + 1):
            key = tuple(w[s:s + width])
            if key in seen:
                hit[i, t] |= set(range(s, s + width))
            seen.add(key)
    return {
        k: (len(w), len(hit[k]), hashlib.sha256(b" ".join(x for n, x in enumerate(w) if n not in hit[k])).hexdigest())
        for k, w in words.items()
    }


def check(spark, rows, width, extra=False):
    out = op.remove_repeats(frame(spark, rows, extra), width).collect()
    assert len(out) == len(rows)
    want = brute(rows, width)
    wanted = defaultdict(list)
    for (i, _), v in want.items():
        wanted[i].append(v)
    for r in out:
        assert (r.n_words, r.n_removed, r.kept_sha256) in wanted[r.doc_id]
    return out


def test_random_texts_with_shared_passages(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(60)] + ["é", "x y", "a\x85b"]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(4, 30))] for _ in range(6)]
    rows = []
    for i in range(200):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randint(1, 20))]
        rows.append((i * 3 - 50, rng.choice([" ", "\n", "\t\t", " \r\n"]).join(w)))
    check(spark, rows, 5)
    check(spark, rows, 20)


def test_awkward_rows(spark):
    check(spark, awkward(), 5, extra=True)


def test_empty_table(spark):
    assert op.remove_repeats(frame(spark, [])).collect() == []


def test_other_columns_stay(spark):
    rows = [(1, "a b c d e f"), (2, "z a b c d e f y")]
    out = {r.doc_id: r for r in op.remove_repeats(frame(spark, rows, True), 5).collect()}
    assert out[2].text == "z y" and out[2].place == "x" and out[2].runs == 5
    assert out[1].text == "a b c d e f" and out[2].n_words == 8


def test_repeated_rows_in_two_partitions(spark):
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [(7, words(0, 60)), (None, words(100, 160)), (8, words(200, 230)), (9, words(200, 230) + " x " + words(300, 330))]
    # Rows of both halves meet after the shuffle only.
    out = op.remove_repeats(frame(spark, rows).unionByName(frame(spark, rows[::-1])), 20).collect()
    want = brute(rows, 20)
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in out) == sorted(
        (str(i), *want[i, t]) for i, t in rows * 2)
    assert {r.doc_id: r.n_removed for r in out} == {7: 0, None: 0, 8: 0, 9: 30}


def test_null_doc_id_at_the_end_of_a_batch_comes_first(spark):
    text = " ".join(f"w{i}" for i in range(40))
    out = op.remove_repeats(frame(spark, [(5, text), (None, text)]).coalesce(1), 20).collect()
    assert {r.doc_id: r.n_removed for r in out} == {None: 0, 5: 40}
