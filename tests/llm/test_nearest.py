"""Nearest neighbours by graphs, against brute force."""

import numpy as np
import pytest

from quillspark.llm import nearest, vamana


def brute(rows, k, every):
    """Each query's nearest by inner product of rows (id, vector)."""
    rows = sorted({(i, tuple(map(float, v))) for i, v in rows})
    out = {}
    for q, v in rows:
        if q % every == 0:
            scores = [(-float(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v)]
            out.setdefault(q, []).extend(sorted(scores)[:k])
    return out


def test_hard_rows(spark):
    rng = np.random.default_rng(1)
    same = rng.normal(size=4).tolist()
    rows = [(i, same) for i in range(1000, 1400)] + [(i, same) for i in range(1000, 1050)]  # copies and repeated rows
    rows += [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(70 + i, rng.normal(size=3).tolist()) for i in range(12)]
    rows += [(2000, [1e9, 0.0, 0.0, 1e9]), (2020, [1e-9, 0.0, -1e-9, 0.0])]
    bad = [(100, None), (120, [0.0] * 4), (140, [1.0, float("nan"), 0.0, 0.0]), (160, [1.0, float("inf"), 0.0, 0.0]), (180, []), (None, same), (200, [1.0, None, 1.0, 1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS vec", "3 AS shard").repartition(3)
    got = {}
    for r in nearest.nearest_neighbours(df, every=20, k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    expected = brute(rows, 20, 20)
    assert set(got) == set(expected)
    for q, hits in expected.items():
        mine = sorted(got[q])
        assert [x[0] for x in mine] == list(range(1, len(hits) + 1)), q
        assert [x[2] for x in mine] == [i for _, i in hits] and np.allclose([x[1] for x in mine], [s for s, _ in hits], rtol=1e-12)
    assert nearest.nearest_neighbours(df.where("false")).count() == 0


@pytest.mark.parametrize("lengths", [False, True])
def test_recall(spark, lengths):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 6000)] + 0.6 * rng.normal(size=(6000, 24))
    if lengths:
        x *= rng.lognormal(0, 1, (6000, 1))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {}
    for r in nearest.nearest_neighbours(df, every=50).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    y = x.astype(np.float64)
    hits = 0
    for q, mine in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        hits += len(mine & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 120 and hits >= 0.95 * 120 * 20


def test_pruning_keeps_diverse_edges():
    """Of many points in one direction one edge stays, the other direction keeps its own."""
    v = np.array([[0, 0], [1, 0], [1.1, 0], [1.2, 0.01], [-3, 0]], np.float64)
    x = vamana.lifted(v)
    like = x @ x[:1].T
    kept = vamana.pruned(x, like[1:].T.copy(), np.array([[1, 2, 3, 4]]), 4, 1.2)
    assert kept[0].tolist() == [1, 4, -1, -1]


@pytest.mark.parametrize("n", [1, 2, 19, 40, 64])
def test_a_small_graph_misses_nothing(n):
    rng = np.random.default_rng(n)
    v = np.repeat(rng.normal(size=(1, 8)), n, 0) * np.arange(1, n + 1)[:, None]  # all in one direction
    x, edges, seeds = vamana.build(v)
    found, _ = vamana.walk(x, edges, seeds, np.concatenate([-v[:3], np.zeros((min(n, 3), 1))], 1).astype(np.float32), 64)
    assert all(sorted(r[r >= 0].tolist()) == list(range(n)) for r in found)


def test_one_graph_alone():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 16))
    x, edges, seeds = vamana.build(v)
    q = np.concatenate([v[::30], np.zeros((100, 1))], axis=1).astype(np.float32)
    found, likes = vamana.walk(x, edges, seeds, q, 64)
    truth = np.argsort(-(v[::30] @ v.T), axis=1)[:, :20]
    assert np.mean([len(set(a[:20]) & set(b)) / 20 for a, b in zip(found.tolist(), truth.tolist(), strict=True)]) > 0.9
    assert all(len(set(a)) == 64 for a in found.tolist()) and (np.diff(likes, axis=1) <= 0).all()
    assert ((edges >= 0).sum(1) > 0).all() and not (edges == np.arange(3000)[:, None]).any()
