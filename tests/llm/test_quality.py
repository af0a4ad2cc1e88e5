import random
import zlib

import pytest
from llm_cases import awkward, frame

from gaugelake.llm import quality as op


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("na", "so", "vi", "du")]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(vocab) for _ in range(rng.randint(15, 80))]
        bad = i % 4 == 0
        text = " ".join(w).capitalize() + "."
        if bad:
            text = rng.choice([" | ".join(w), " ".join(x.upper() + "!!" for x in w), " ".join(w[:2] * 30)])
        rows.append((i, text))
        labels.append((i, int(not bad)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_order_and_threshold(spark, corpus):
    rows, labels = corpus
    model = op.train(frame(spark, rows), labels)
    found = model.score(op.fx.plain(frame(spark, rows, True)), "rest").collect()
    held = [r for r in found if zlib.crc32(str(r.rest.doc_id).encode()) % 5 == 0]
    right = sum((r.score >= op.THRESHOLD) == (r.rest.doc_id % 4 != 0) for r in held)
    assert len(held) > 80 and right >= 0.95 * len(held)
    out = model.score(op.fx.plain(frame(spark, awkward(), True)), "text").collect()
    assert len(out) == len(awkward()) and all(0 <= r.score <= 1 for r in out)
    by_text = {}
    for r in out:
        assert by_text.setdefault(r.text, r.score) == r.score


def test_nothing_to_learn_from(spark):
    docs = frame(spark, awkward())
    one = spark.createDataFrame([(7, 1), (8, None), (None, 0)], "doc_id long, quality int")
    assert {r.score for r in op.train(docs, one).score(op.fx.plain(docs), "rest").collect()} == {1.0}
    assert op.train(docs, one.limit(0)).score(op.fx.plain(frame(spark, [])), "rest").collect() == []


def test_pairs_are_differences(spark):
    rows = spark.createDataFrame([(i, i, float(i % 2), [float(i % 2), 1.0]) for i in range(20)], "doc_id long, text_key long, label double, features array<double>")
    pairs = op.pairs_of(rows, 10, 10, 50).collect()
    assert len(pairs) == 50 and all(p.features.toArray().tolist() == [2 * p.label - 1, 0.0] for p in pairs)
    assert {p.label for p in pairs} == {0.0, 1.0}
