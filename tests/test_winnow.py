"""Containment by winnowed fingerprints, against plain search."""

import random

import pytest

from quillspark.operators import evaluation, winnow

rng = random.Random(3)
TEXTS = ["".join(rng.choice("abcdé 中\U0001f600") for _ in range(rng.choice([0, 10, 31, 32, 33, 200, 5000]))) for _ in range(60)] + [None, "x" * 400, "x" * 400]
NEEDLES = [t[a : a + n] for t in TEXTS if t for n in (1, 5, 31, 32, 33, 150) for a in [rng.randrange(len(t))]] + ["nowhere to be found in any of the texts at all", "x" * 32, "x" * 401, ""]


def test_fingerprints_of_a_part_are_of_the_whole():
    for t in TEXTS:
        for _ in range(5):
            if t and len(t) >= winnow.LEAST:
                a = rng.randrange(len(t) - winnow.LEAST + 1)
                part = t[a : rng.randrange(a + winnow.LEAST, len(t) + 1)]
                mine = set(winnow.fingerprints(part).tolist())
                assert mine and mine <= set(winnow.fingerprints(t).tolist())
    assert len(winnow.fingerprints("a" * (winnow.LEAST - 1))) == len(winnow.fingerprints(None)) == 0
    assert len(winnow.fingerprints("".join(rng.choice("abcdef") for _ in range(9000)))) < 9000 / 7


@pytest.mark.parametrize("most", [4_000_000, 100])
def test_containing(spark, monkeypatch, most):
    monkeypatch.setattr(evaluation, "NEEDLES", most)
    chunks = spark.createDataFrame([(f"c{i}", i % 7, t) for i, t in enumerate(TEXTS)], "new_id string, new_page int, new_flat string")
    needles = spark.createDataFrame([(n,) for n in NEEDLES + [None]], "needle string")
    got = sorted((r.needle, r.new_id, r.new_page) for r in evaluation.containing(needles, chunks).collect())
    assert got == sorted((n, f"c{i}", i % 7) for n in set(NEEDLES) if n for i, t in enumerate(TEXTS) if t and n in t)
    assert evaluation.containing(needles.where("false"), chunks).count() == 0 == evaluation.containing(needles, chunks.where("false")).count()
