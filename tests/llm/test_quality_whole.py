import zlib

from llm_cases import frame

from gaugelake.llm import quality as op


def test_every_row_is_numbered_and_paired(spark):
    rows = spark.createDataFrame(
        [(i, i, float(i % 7 != 0), [float(i)]) for i in range(700)], "doc_id long, text_key long, label double, features array<double>")
    placed = op.numbered(rows).collect()
    for label, n in ((0.0, 100), (1.0, 600)):
        assert sorted(r["at"] for r in placed if r.label == label) == list(range(n))
    pairs = [(2 * p.label - 1) * p.features[0] for p in op.pairs_of(rows, 100, 600, 1_400).collect()]
    assert len(pairs) == 1_400
    # Good rows are met twice, the first 200 of them a third time, and every bad row fourteen times.
    good = sum((2 + (r["at"] < 200)) * r.features[0] for r in placed if r.label == 1)
    assert round(sum(pairs)) == good - 14 * sum(range(0, 700, 7))


def test_learns_from_all_rows(spark, monkeypatch):
    """More labelled rows than a bounded sample held."""
    seen = []
    kept = op.pairs_of
    monkeypatch.setattr(op, "pairs_of", lambda rows, *a: seen.append(rows.count()) or kept(rows, *a))
    docs = frame(spark, [(i, "word " * (i % 9 + 1) + ("!!! |" if i % 4 == 0 else "end.")) for i in range(22_000)])
    labels = docs.selectExpr("doc_id", "cast(doc_id % 4 != 0 as int) as quality")
    model = op.train(docs, labels)
    assert seen == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(22_000))]
    assert model.weights is not None
