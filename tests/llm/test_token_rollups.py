import random
from collections import Counter

import duckdb
import pytest

from gaugelake.llm import token_rollups as op
from gaugelake.session import new_folder

ROWS = "source string, lang string, tokenizer_version string, tokens long"


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer_version): (r.documents, r.tokens) for r in rollup.totals().collect()}


def test_signed_batches_count_once(spark):
    rng = random.Random(8)
    rollup = op.Rollup(spark, new_folder(spark, "rollup"))
    assert totals(rollup) == {}
    documents, tokens, alive = Counter(), Counter(), []

    def change(rows, sign):
        for s, g, v, n in rows:
            documents[s, g, v] += sign
            tokens[s, g, v] += sign * (n or 0)

    for turn in range(3):
        new = [(rng.choice(["a", "b", None]), rng.choice(["en", None]), "v1", rng.choice([None, 0, 5, 10**10])) for _ in range(40)]
        alive += new
        change(new, 1)
        frame = spark.createDataFrame(new, ROWS).selectExpr("*", "1 as sign", "2 as documents")
        assert rollup.apply(f"in-{turn}", op.signed(frame, 1))
        gone = [alive.pop(rng.randrange(len(alive))) for _ in range(5)]
        change(gone, -1)
        old = [alive.pop(rng.randrange(len(alive))) for _ in range(5)]
        fresh = [(s, g, "v2", 7) for s, g, _, _ in old]
        change(old, -1)
        change(fresh, 1)
        frames = [spark.createDataFrame(x, ROWS) for x in (gone, old, fresh)]
        changes = op.signed(frames[0], -1).unionByName(op.revised(*frames[1:]))
        assert rollup.apply(f"out-{turn}", changes)
        assert not rollup.apply(f"out-{turn}", changes) and not rollup.apply("in-0", changes)
        if turn == 1:
            rollup.compact()
            rollup.compact()
        assert totals(rollup) == {k: (documents[k], tokens[k]) for k in documents if documents[k] or tokens[k]}
    assert rollup.apply("none", op.signed(spark.createDataFrame([], ROWS), 1)) and "none" in rollup.committed()


def test_attempt_without_its_mark_is_overwritten(spark):
    rollup = op.Rollup(spark, new_folder(spark, "rollup"))
    rows = spark.createDataFrame([("a", "en", "v1", 3)], ROWS)
    rollup.apply("one", op.signed(rows, 1))
    rollup._fs.delete(rollup._at("batch", "one", "_SUCCESS"), False)
    assert totals(rollup) == {} and rollup.apply("one", op.signed(rows, 1))
    assert totals(rollup) == {("a", "en", "v1"): (1, 3)}
    with pytest.raises(ValueError):
        rollup.apply("../x", op.signed(rows, 1))


def test_query_agrees_with_sql(spark):
    d = "/root/testdata/sf0.001"
    documents = duckdb.read_parquet(f"{d}/documents.parquet")  # noqa: F841
    want = sorted(duckdb.sql(op.OP8_SQL).fetchall())
    assert sorted(tuple(r) for r in op.op8_token_rollups(spark, d).collect()) == want
