"""Near-duplicate join: sketches' bounds, forests of tasks and pairs of parts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import jaccard_join

from test_pipeline import components, prose, table


@pytest.mark.parametrize("measure", [jaccard_join.OP10, jaccard_join.PIPELINE])
def test_a_sketch_may_differ_by_what_its_set_may(measure):
    """Not by what the largest set of its band may: that brought ever more sets together."""
    noise = np.random.default_rng(1)
    for size in (5, 20, 41, 42, 64, 100, 107, 300, 700):
        g = np.unique(noise.integers(0, 1 << 64, size, dtype=np.uint64))
        _, _, sketch = jaccard_join.signatures(g, np.array([size]), measure)
        assert (sketch >> np.uint64(60) <= size * (measure.denominator - measure.numerator) // measure.numerator).all()


def test_sets_that_differ_most_share_a_near_sketch():
    """Supersets at the very threshold, where a set's own bound is reached."""
    noise = np.random.default_rng(2)
    for trial in range(300):
        m = int(noise.integers(4, 400))
        g = np.unique(noise.integers(0, 1 << 64, m + m // 4, dtype=np.uint64))
        sub = np.sort(noise.choice(g, m, replace=False))
        row, sig, sketch = jaccard_join.signatures(np.concatenate([sub, g]), np.array([m, len(g)]), jaccard_join.PIPELINE)
        if m == len(g):
            continue
        a, b = ({}, {})
        for r, s, k in zip(row.tolist(), sig.tolist(), sketch, strict=True):
            (a, b)[r][s] = k
        assert any(jaccard_join.near(a[s], b[s]) for s in a.keys() & b.keys()), (trial, m)


def test_spanning_keeps_components():
    noise = np.random.default_rng(3)
    for _ in range(30):
        u, v = noise.integers(0, 40, (2, int(noise.integers(1, 60))))
        u, v = np.minimum(u, v)[u != v], np.maximum(u, v)[u != v]

        def parts(edges):
            root = {x: x for x in range(40)}
            for a, b in edges:
                root = {x: root[a] if r == root[b] else r for x, r in root.items()} if root[a] != root[b] else root
            return {frozenset(x for x in root if root[x] == r) for r in root.values()}

        keep = jaccard_join.spanning(u, v)
        assert parts(zip(u[keep], v[keep], strict=True)) == parts(zip(u, v, strict=True))
        assert keep.sum() == 40 - len(parts(zip(u, v, strict=True)))


@pytest.mark.parametrize("held", [2_000_000, 3])
def test_parts_met_are_those_of_near_sketches(held, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SIGNATURES", held)
    noise = np.random.default_rng(4)
    sig, part = noise.integers(0, 12, 200), noise.integers(0, 25, 200)
    sketch = noise.integers(0, 1 << 6, 200, dtype=np.uint64) | noise.integers(1, 3, 200, dtype=np.uint64) << np.uint64(60)
    want = {(min(part[i], part[j]), max(part[i], part[j])) for i in range(200) for j in range(i) if sig[i] == sig[j] and part[i] != part[j] and jaccard_join.near(sketch[i], sketch[j])}
    assert set(zip(*map(np.ndarray.tolist, jaccard_join.parts_met(sig, part, sketch)), strict=True)) == want


def test_a_long_chain_is_not_compared_by_all_its_pairs(spark, monkeypatch):
    """Each text is a little less than similar enough to the next one; two pairs are linked."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(1500)]
    rows = [(i, " ".join(words[11 * i : 11 * i + 98])) for i in range(100)]
    rows += [(100, rows[7][1] + " end"), (101, rows[60][1] + " end"), (102, prose(70))]
    seen, real = [], jaccard_join.grouped_links

    def counted(df, by, measure):
        seen.append(df.count())
        return real(df, by, measure)

    monkeypatch.setattr(jaccard_join, "grouped_links", counted)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 2)
    kept = sorted(r.doc_id for r in jaccard_join.one_of_each(table(spark, rows), measure=jaccard_join.PIPELINE).collect())
    parts = components(rows, 5, 80)
    assert kept == sorted(min(i for (i, _), p in zip(rows, parts, strict=True) if p == q) for q in set(parts))
    assert max(seen) < 8 * len(rows)


@pytest.mark.parametrize("measure", [jaccard_join.OP10, jaccard_join.PIPELINE])
def test_linked_sets_share_a_signature_with_alike_wide_sketches(measure):
    """At the very threshold, some differences on either side, and with more partitions than a wide sketch takes in."""
    noise = np.random.default_rng(6)
    for trial in range(200):
        m = int(noise.integers(8, 1500 if trial % 4 else 60))
        g = np.unique(noise.integers(0, 1 << 64, 2 * m, dtype=np.uint64))
        both = -(-2 * m * measure.numerator // (measure.numerator + measure.denominator))
        own = noise.permutation(g)
        a, b = np.sort(own[:m]), np.sort(np.concatenate([own[:both], own[m : 2 * m - both]]))
        row, sig, sketch, wide = jaccard_join.wide_signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), measure)
        first = {s: i for i, (r, s) in enumerate(zip(row.tolist(), sig.tolist(), strict=True)) if r == 0}
        x = np.array([(first[s], i) for i, (r, s) in enumerate(zip(row.tolist(), sig.tolist(), strict=True)) if r and s in first])
        assert (jaccard_join.near(sketch[x[:, 0]], sketch[x[:, 1]]) & jaccard_join.alike(wide[x[:, 0]], wide[x[:, 1]], measure)).any(), (trial, m)


def test_a_common_passage_makes_no_pairs_of_parts(spark):
    """Texts of which five sixths are one passage are 0.7 similar; all their pairs were compared."""
    rng = random.Random(7)
    passage, own = prose(100), lambda: " ".join(f"v{rng.randrange(10**6)}" for _ in range(20))
    texts = [f"{passage} {own()}" for _ in range(120)]
    texts.append(f"{texts[5]} end")
    df = spark.createDataFrame(list(enumerate(texts)), "part long, text string")
    pairs = {(r.a, r.b) for r in jaccard_join.part_pairs(df, 4, jaccard_join.PIPELINE).collect()}
    assert (5, 120) in pairs and len(pairs) < 2 * len(texts)
    # as many as there were without wide sketches
    g, n = jaccard_join.shingle_sets(pa.array(texts), 5)
    row, sig, sketch = jaccard_join.signatures(g, n, jaccard_join.PIPELINE)
    assert len(jaccard_join.parts_met(sig, row, sketch)[0]) > 10 * len(texts)
