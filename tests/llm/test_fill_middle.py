"""Ropes and the fill-in-the-middle transformation."""

import hashlib
import random

import pytest

from quillspark.llm import fill_middle, rope


def depth(t):
    if t.text is not None:
        return 0
    a, b = depth(t.left), depth(t.right)
    assert abs(a - b) <= 2 and t.height == 1 + max(a, b)
    return t.height


@pytest.mark.parametrize("unit", [None, r"\w+", r"\S+\s*"])
@pytest.mark.parametrize("leaf", [1, 3, 1024])
def test_split_and_join(monkeypatch, unit, leaf):
    monkeypatch.setattr(rope, "LEAF", leaf)
    rng = random.Random(leaf)
    for _ in range(60):
        text = "".join(rng.choice("ab <SPM>\u00e9\U0001f600\n") for _ in range(rng.randrange(0, 200)))
        tree = rope.rope(text, unit)
        depth(tree)
        k, c = rng.randrange(tree.units + 1), rng.randrange(len(text) + 1)
        a, b = rope.split(tree, k)
        depth(a), depth(b)
        assert str(a) + str(b) == text and (a.units, b.units) == (k, tree.units - k)
        a, b = rope.split(tree, c, "chars")
        assert str(a) == text[:c] and str(b) == text[c:]
        h = tuple(rng.randrange(1 << 32) for _ in range(4))
        n, form, p, m, out = fill_middle.forward(text, h, fill_middle.Plan(unit=unit))
        assert fill_middle.inverse(out, form) == text
        if unit is None and form != "plain":
            x, y = sorted((h[0] % (n + 1), h[1] % (n + 1)))
            pre, mid, suf = text[:x], text[x:y], text[y:]
            assert (p, m) == (x, y - x) and out == (f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}")


def test_hard_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "has <S> in it"), (None, "no key"), (4, "x" * 300_000), (4, "x" * 300_000), *((i, f"text <M {i} \u00e9") for i in range(5, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'c' AS output", "'d' AS form", "0 AS __h0")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = fill_middle.query(spark, str(tmp_path)).collect()
    made = {(r.doc_id, r.n): r for r in got}
    assert len(got) == len(rows) and made[1, 0].form == made[2, 0].form == made[3, 13].form == "plain"
    for i, t in rows:
        t = t or ""
        r = made[i, len(t)]
        assert r.restored_sha256 == hashlib.sha256(t.encode()).hexdigest()
        h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h = [int(h[8 * j : 8 * j + 8], 16) for j in range(4)]
        assert r.output_sha256 == hashlib.sha256(fill_middle.forward(t, h)[4].encode()).hexdigest()
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.restored(fill_middle.transformed(df.where("false"))).count() == 0


def test_words_as_units(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i))) for i in range(40)], "id int, body string")
    plan = fill_middle.Plan(seed=7, unit=r"\S+", transformed=100)
    for r in fill_middle.restored(fill_middle.transformed(df, plan, "id", "body"), plan).collect():
        assert r.n == r.id and r.restored == " ".join(f"w{j}" for j in range(r.id)) and (r.form == "plain") == (r.id == 0)
