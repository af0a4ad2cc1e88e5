import random
import zlib

import pytest
from llm_cases import awkward, frame

from gaugelake.llm import toxicity as op


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("na", "so", "vi", "du")]
    rows, labels = [], []
    for i in range(700):
        w = [rng.choice(vocab) for _ in range(rng.randint(10, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = "zzgrub" + rng.choice(["a", "eb", "ic"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_clean_documents_stay(spark, corpus):
    rows, labels = corpus
    docs = frame(spark, rows, True)
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    kept = op.drop_toxic(docs, labels)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns
    wrong = sum((i in ids) == (i % 5 == 0) for i in held)
    assert len(held) > 150 and wrong <= 0.05 * len(held)
    out = op.train(docs, labels).score(op.fx.plain(frame(spark, awkward(), True)), "text", "rest").collect()
    assert len(out) == len(awkward()) and all(0 <= r.score <= 1 for r in out)
    by_text = {}
    for r in out:
        assert by_text.setdefault(r.text, r.score) == r.score


def test_nothing_to_learn_from(spark):
    docs = frame(spark, awkward())
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in op.train(docs, none).score(op.fx.plain(docs), "rest").collect()} == {0.0}
    odd = spark.createDataFrame([(7, None), (None, 1), (8, 0), (8, 0)], "doc_id long, toxic int")
    assert op.drop_toxic(docs, odd).count() == len(awkward())
    assert op.drop_toxic(frame(spark, []), odd).collect() == []


def test_lexicon_ignores_held_out_labels(spark, corpus):
    rows, labels = corpus
    sample = op.fx.labelled_sample(labels, "toxic", 3, 1, 100).collect()
    assert len(sample) == 100 and all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in sample)


def test_counts_that_leave_in_parts_give_the_same_lexicon(spark, corpus, monkeypatch):
    rows, _ = corpus
    sample = spark.createDataFrame([(t, float(i % 5 == 0), i % 5 * 3 % 5) for i, t in rows], "text string, label double, fold int").repartition(2)
    whole = op.lexicon(sample)
    monkeypatch.setattr(op, "COUNTS_KEPT", 50)
    assert whole[-1] and op.lexicon(sample) == whole


def test_words_are_described_as_letter_by_letter():
    weights = {"zzgrub": 2.0, "zzg*": 3.0, "ab": 1.5, "idio*": 4.0}
    of = op.Describer([weights])
    heads = frozenset(["zzg", "idi"])
    words = ["zzgrub", "Zzgrub!", "zzg", "xx-zzgrub", "z z", "1d10tic", "idiotic", "YOU", "aaab", "²²²", "é½", "...", "ab", "AB'ab", "Ⅷab"]
    for word in words:
        found = op._LETTERS.findall(word.lower())
        got = of.describe(word, weights, heads)
        assert got[0] == max((weights.get(t, 0.0) for w in found for t in op.terms_of(w)), default=0.0), word
        assert got[1] == any(w in op.INSULTS for w in found) and got[2] == any(w in op.ADDRESS for w in found)
        assert got[6] == any(a == b == c and a.isalpha() for a, b, c in zip(word.lower(), word.lower()[1:], word.lower()[2:], strict=False))
    assert of.describe("1d10tic", weights, heads)[3:5] == (True, True) and of.describe("idiotic.", weights, heads)[3] is False
