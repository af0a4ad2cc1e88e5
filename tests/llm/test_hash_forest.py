import numpy as np
import pytest

from gaugelake.llm import hash_forest as op

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, queries, k):
    """(rank, id, score) of every candidate row, by query."""
    good = [(i, np.array(v, np.float64)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if usable(v))]
    out = {}
    for q, v in good:
        if q in queries:
            found = [
                (-(v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum())), -(1 << 63) if i is None else i)
                for i, w in good if i != q and len(w) == len(v)
            ]
            out[q] = [(n + 1, None if i == -(1 << 63) else i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return out


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def answers(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r[2], r.score))
    return out


def random_rows(seed, count, width, start=0):
    rng = np.random.default_rng(seed)
    return [(start + i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.standard_normal((count, width)))]


def test_recall_against_brute_force(spark):
    rows = random_rows(1, 6_000, 32)
    table = spark.createDataFrame(rows, SCHEMA)
    got = answers(op.nearest(table, table.where("vec_id % 50 = 0"), shard_rows=1_500))
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows])
    units = vectors / np.sqrt((vectors**2).sum(axis=1))[:, None]
    hit = 0
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    for q, found in got.items():
        score = units @ units[q]
        score[q] = -2
        best = ids[np.lexsort((ids, -score))[:5]]
        hit += len(set(best.tolist()) & {i for _, i, _ in found})
        assert [n for n, _, _ in found] == [1, 2, 3, 4, 5] and q not in [i for _, i, _ in found]
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        for _, i, s in found:
            assert s == pytest.approx(score[i], abs=1e-14)
    assert hit / (5 * len(got)) >= 0.9


def test_close_neighbours_stop_deep():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((300, 24))
    vectors = np.repeat(centres, 10, axis=0) + 0.02 * rng.standard_normal((3_000, 24))
    forest = op.Forest(np.arange(3_000), vectors, op.TREES)
    measured = []
    take = forest.units
    forest.units = type("Counted", (), {"take": lambda self, at, axis: (measured.append(len(at)), take.take(at, axis=axis))[1]})()
    query, found, _ = forest.nearest(np.arange(3_000)[::50], vectors[::50], 5, op.MISS)
    assert all(f // 10 == (q * 50) // 10 for q, f in zip(query.tolist(), found.tolist(), strict=True))
    assert sum(measured) < 0.15 * 60 * 3_000


def test_awkward_vectors(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]),
        (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, []), (None, [3.0, 0.0]), (50, [0.0, 1.0]), (100, [1.0, 2.0, 3.0]),
        (150, None), (200, [-1.0, 0.0]), (50, [0.0, 1.0]), (250, [5.0, 5.0, 5.0, 5.0]),
    ]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as key", "'x' as bucket", "3 as asks").repartition(3)
    got = answers(op.nearest(table, table.where("vec_id % 50 = 0")))
    want = brute(rows, {0, 50, 100, 200, 250}, 5)
    assert {q: f for q, f in want.items() if f} == got
    assert [i for _, i, _ in got[0]] == [None, 1, 2, 50, 200]
    empty = spark.createDataFrame([], SCHEMA)
    assert op.nearest(empty, empty).collect() == [] and op.nearest(table, empty).collect() == []


def test_a_third_of_all_rows_is_one_vector(spark):
    rows = random_rows(3, 600, 8) + [(1_000 + i, [0.5] * 8) for i in range(400)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = answers(op.nearest(table, table.where("vec_id % 50 = 0"), shard_rows=300))
    assert [i for _, i, _ in got[1_200]] == [1_000, 1_001, 1_002, 1_003, 1_004]
    assert [i for _, i, _ in got[1_000]] == [1_001, 1_002, 1_003, 1_004, 1_005]
    assert len({s for q in (1_000, 1_200) for _, _, s in got[q]}) == 1


def test_query_columns(spark, tmp_path):
    spark.createDataFrame(random_rows(4, 120, 16), SCHEMA).selectExpr("*", "1 as label").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = op.op13_nearest_neighbours(spark, str(tmp_path))
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and dict(out.dtypes)["rank"] == "int"
    assert out.count() == 15
