import hashlib
import random
import re
import zlib

import numpy as np
from llm_cases import awkward, frame

from gaugelake.llm import common
from gaugelake.llm import periodic_runs as op


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def brute_runs(words):
    """Stretches by their period, smallest period first."""
    seen = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                seen.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in seen.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


def row_of(doc_id, text):
    words = words_of(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (
        doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest(),
    )


def check_texts(texts):
    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    runs, left = op._block_runs(np.frombuffer(data, np.uint8), offsets)
    for text, found, kept in zip(texts, runs, left, strict=True):
        words = words_of(text)
        want = brute_runs(words)
        assert [(r["start"], r["length"], r["period"]) for r in found] == want, text[:200]
        assert kept == collapsed(words, want)


def periodic_texts(rng, count):
    for _ in range(count):
        out = []
        for _ in range(rng.randint(0, 6)):
            alphabet = rng.choice(["a", "ab", "abc", "abcdefghijklmnop"])
            root = [rng.choice(alphabet) for _ in range(rng.randint(1, 40))]
            times = rng.choice([1, 1, 2, 3, 7])
            out += (root * times)[: len(root) * times - rng.randint(0, len(root) - 1)]
        yield " ".join(out)


def test_random_texts_against_brute_force():
    rng = random.Random(5)
    check_texts(list(periodic_texts(rng, 400)))


def test_words_of_two_letters():
    rng = random.Random(6)
    check_texts([" ".join(rng.choice("ab") for _ in range(rng.randint(0, 150))) for _ in range(300)])


def test_fibonacci_and_thue_morse_words():
    a, b = "a", "ab"
    while len(b) < 600:
        a, b = b, b + a
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(512))
    check_texts([" ".join(b), " ".join(morse), " ".join(morse * 2), " ".join("ab" * 300 + "a" + "ab" * 200)])


def test_every_period_at_its_shortest_length():
    texts = []
    for q in range(1, 70):
        for shift in (0, 1, 2, 5, 11):
            root = [f"r{i}" for i in range(q)]
            length = max(12, 2 * q)
            texts += [" ".join([f"x{i}" for i in range(shift)] + (root * 12)[:n] + ["y", "z"]) for n in (length - 1, length)]
    check_texts(texts)


def test_one_word_many_times():
    check_texts(["w " * 3_000, "u v " * 1_500 + "w " * 900])


def test_range_successor():
    rng = np.random.default_rng(1)
    values = rng.permutation(700)[:500].astype(np.int64)
    tree = op.Occurrences(values)
    lo = rng.integers(0, 500, 300)
    hi = np.minimum(500, lo + rng.integers(0, 200, 300))
    bound = rng.integers(0, 1_100, 300)
    got = tree.following(lo, hi, bound, 9_999)
    for a, b, x, y in zip(lo, hi, bound, got, strict=True):
        assert y == min((v for v in values[a:b] if v >= x), default=9_999)


def test_query_rows(spark, tmp_path):
    rng = random.Random(7)
    rows = awkward() + [(100 + i, t) for i, t in enumerate(periodic_texts(rng, 150))]
    rows = [(i, t) for i, t in rows if t is None or len(t) < 20_000]
    frame(spark, rows, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, op.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((row_of(i, t) for i, t in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)


def test_general_interface(spark):
    docs = frame(spark, [(1, "x " + "a b " * 8 + "y"), (2, "no runs")], extra=True)
    out = {r.rest.doc_id: r for r in op.find_runs(docs).collect()}
    assert [tuple(r) for r in out[1].runs] == [(1, 16, 2)] and out[1].collapsed == "x a b y"
    assert out[2].runs == [] and out[2].collapsed == "no runs" and out[2].rest.place == "x"
    assert op.find_runs(frame(spark, [])).collect() == []


def test_block_borders():
    # A run must not reach over the border of two texts.
    check_texts(["a b c d " * 2, "a b c d " * 2, "", "a b c d"])
    assert common.BLOCK_BYTES
