import random
import re

from llm_cases import awkward, frame

from gaugelake.llm import decontaminate as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, bench, width):
    w, hit, items = words(text), set(), set()
    for item, t in bench:
        b = words(t)
        if not b:
            continue
        n = min(width, len(b))
        for i in range(len(b) - n + 1):
            for s in range(len(w) - n + 1):
                if w[s:s + n] == b[i:i + n]:
                    hit |= set(range(s, s + n))
                    items.add(item)
    return len(w), hit, sorted(items - {None})


def check(spark, rows, bench, width=4, most=op.MAX_WINDOWS):
    b = spark.createDataFrame(bench, "item_id string, text string")
    out = op.find_hits(frame(spark, rows, True), b, width, most).collect()
    assert len(out) == len(rows)
    for r in out:
        n, hit, items = brute(r.text, bench, width)
        assert (r.n_words, r.n_hit, r["items"]) == (n, len(hit), items), r
        raw = (r.text or "").encode()
        cut = [x for s in r.spans for x in words(raw[s.start:s.end].decode())]
        assert cut == [x for i, x in enumerate(words(r.text)) if i in hit]
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= n)


def test_random(spark):
    rng = random.Random(2)
    vocab = ["a", "B", "cc", "é", "É", "x1", "9"]
    line = lambda n: rng.choice([" ", "-", ", ", "\n\n"]).join(rng.choice(vocab) for _ in range(n))
    bench = [(str(i), line(rng.randint(1, 9))) for i in range(12)] + [(None, "a b"), ("n", None), ("e", "?!"), ("0", "cc cc")]
    rows = [(i, line(rng.randint(0, 60))) for i in range(150)] + awkward()[:5]
    check(spark, rows, bench)
    check(spark, rows, bench, most=5)


def test_awkward_and_empty(spark):
    check(spark, awkward(), [("1", "two three four five six"), ("2", "t5 t6 t7 t8 t9")])
    check(spark, awkward(), [])
    assert op.find_hits(frame(spark, []), spark.createDataFrame([("1", "a")], "item_id string, text string")).collect() == []


def test_clean_documents_stay(spark):
    bench = spark.createDataFrame([("1", " ".join(f"q{i}" for i in range(15)))], "item_id string, text string")
    filler = " ".join(f"f{i}" for i in range(300))
    rows = [(1, filler), (2, " ".join(f"Q{i}," for i in range(13))), (3, filler + " " + " ".join(f"q{i}" for i in range(13)))]
    out = op.drop_contaminated(frame(spark, rows, True), bench)
    assert {r.doc_id for r in out.collect()} == {1, 3} and out.columns == frame(spark, rows, True).columns
