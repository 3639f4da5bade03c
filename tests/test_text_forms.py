"""Text expressions against the patterns that they stand for."""

import random

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.lexicon import LATIN_GENERIC, ZH_MANUAL
from quillspark.operators import structure

ITEM = r"(?U)(^|\n)\s*(?:■|-|•|\d+\.|（\d+）|[①②③④⑤⑥⑦⑧⑨⑩])"
STEP = r"(?U)(^|\n)\s*(?:\d+\.?|\d+\s|（\d+）|[①②③④⑤⑥⑦⑧⑨⑩])"


def test_a_text_is_looked_through_once(spark):
    df = spark.createDataFrame([("a\nb",)], "t string")
    plan = df.select(T.lines(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    plan = df.select(structure.content_type(F.col("t"), ZH_MANUAL).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and plan.count("substring_index(") == len(T.BREAKS)


def test_strip_and_lists_of_lines(spark):
    rng = random.Random(5)
    parts = ["1", "23.", "（4）", "（4", "⑤", "-", "■", "•", "x", " ", "  ", "\n", "\n\n", "\t", "\r\n", "　", "\x1c", "\x85", " ", "٣", "The ", "In", "Of！"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(3000)]
    texts += [chr(c) + "a" + chr(c) for c in range(1, 0x3100)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    first = F.coalesce(F.get(F.filter(T.lines(t), lambda x: x != ""), F.lit(0)), F.lit(""))
    pairs = {
        "strip": (T.strip(t), F.regexp_replace(t, r"(?U)^\s+|\s+$", "")),
        "item": (structure.list_item(t), t.rlike(ITEM)),
        "steps": (structure.steps(t), F.regexp_count(t, F.lit(STEP))),
        "first": (F.coalesce(T.first_line(t), F.lit("")), first),
        "lines": (F.split(t, T.LINE_BREAK, -1), F.split(t, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", -1)),
    }
    for name, (a, b) in pairs.items():
        assert df.where(~a.eqNullSafe(b)).select("t").take(3) == [], name


def test_noise_by_length(spark):
    given = {"Copyright": True, "copyright!": False, "ALL RIGHTS RESERVED": True, "1234": True, "12345": False, "": False, "a ..... 12": True, "İ": False}
    df = spark.createDataFrame(list(given.items()), "c string, noise boolean")
    assert df.where(structure.noise_line(F.col("c"), LATIN_GENERIC) != F.col("noise")).collect() == []
