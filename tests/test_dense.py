"""Exact and inverted-file search over vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import dense


def hits(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.pos, r.chunk_id))
    return {q: [c for _, c in sorted(x)] for q, x in out.items()}


@pytest.mark.parametrize("block", [4096, 1])
def test_vectors_without_direction_and_string_ids(spark, monkeypatch, block):
    monkeypatch.setattr(dense, "BLOCK", block)
    v = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 0.0]), ("c", None), ("d", [1.0, None]), ("e", [0.5, 0.5]), ("f", [float("nan"), 1.0]), ("bb", [2.0, 0.0])], "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 0.0]), ("z", [0.0, 3.0])], "query_id string, embedding array<double>")
    got = dense.search(v, q, 3)
    assert hits(got) == {"x": ["b", "bb", "e"], "z": ["e", "b", "bb"]} and got.where(F.isnan("score")).count() == 0
    assert dense.search(v.where("false"), q).count() == 0 == dense.search(v, q.where("false")).count()


@pytest.mark.parametrize("slots", [50_000, 7])
def test_inverted_file(spark, monkeypatch, slots):
    monkeypatch.setattr(dense, "SLOT_ROWS", slots)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 32)) + 2 * rng.normal(size=(30, 32))[rng.integers(0, 30, 900)]
    rows = [(f"c{i}", v) for i, v in enumerate(x.tolist())] + [("zero", [0.0] * 32), ("none", None)]
    v = spark.createDataFrame(rows, "chunk_id string, embedding array<double>")
    q = v.where("chunk_id in ('zero', 'none') or crc32(chunk_id) % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    model = dense.fitted(v, sample=400)
    index = dense.ivf_index(v, model)
    assert index.count() == 900 and len(model.cells) == 30
    true, found = hits(dense.search(v, q, 10)), hits(dense.ivf_search(index, model, q, 10, probes=8))
    assert set(found) == set(true) and all(len(h) == 10 and h[0] == k for k, h in found.items())
    assert sum(len(set(found[k]) & set(true[k])) for k in true) >= 0.9 * 10 * len(true)


def test_nearest_holds_few_scores():
    """Whatever the steps, the best of all rows, equal scores by id."""
    rng = np.random.default_rng(7)
    v = rng.integers(-2, 3, size=(400, 6)) + 0.5
    v, ids = v / np.linalg.norm(v, axis=1, keepdims=True), rng.permutation(400)
    s = v[:30] @ v.T
    order = np.lexsort((np.broadcast_to(ids, s.shape), -np.round(s, 9)), axis=1)[:, :5]
    for cells in (1, 900, 1 << 20):
        found = dense.Nearest(30, 5)
        for at in range(0, 400, 150):
            found.add(v[:30], v[at : at + 150], ids[at : at + 150], cells)
            assert len(found.who) <= 150
        assert (found.ids.reshape(30, 5) == ids[order]).all() and (found.who == np.repeat(np.arange(30), 5)).all()


def test_lsh_of_all_buckets_is_the_exact_search(spark, monkeypatch):
    monkeypatch.setattr(dense, "SLOT_ROWS", 7)
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(120, 8)).tolist())] + [(200 + i, [1.0] * 8) for i in range(20)] + [(300, [0.0] * 8), (301, None)]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    q = v.where("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    found = dense.lsh_search(v, q, 5, tables=2, planes=2, flips=2)
    assert hits(found) == hits(dense.search(v, q, 5)) and 300 not in hits(found)
    assert "Distinct" not in found._jdf.queryExecution().logical().toString()  # no pair is shuffled for each table
