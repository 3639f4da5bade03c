"""Fill-in-the-middle transformation on ropes.

A text is cut into n units (code points, or what a pattern matches) and
becomes a rope. Numbers h1 to h4, taken from the sha256 of seed and key,
decide all: the prefix ends after the smaller of h1 % (n+1) and h2 % (n+1)
units, the middle after the larger. Two splits of the tree give prefix, middle
and suffix; the rearranged subtrees are concatenated with sentinels between
them: psm is prefix, suffix, middle and spm is suffix, prefix, middle. A text
stays plain if it is empty, holds a sentinel, or by its share of numbers h3.
The inverse finds the sentinels, splits the tree of the output at their code
points and joins the parts in their first order, so text and output are told
apart by nothing but the form.

It is a map over the rows: no row meets another, nothing is shuffled, and a
task holds one batch of texts.

Defined cases: null texts are empty; an empty text is plain with n = 0; a null
key counts as the empty word in the hash; rows with equal keys are treated
alike, each for itself; a text of any length is taken whole; a unit pattern
that matches nowhere gives n = 0 and leaves the whole text as suffix; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .rope import joined, rope, split


class Plan(NamedTuple):
    """Shares are in percent; `unit` is a pattern (None: code points); the
    sentinels must not begin with what another one or itself ends with."""

    seed: int = 1
    unit: str | None = None
    transformed: int = 90
    suffix_first: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def forward(text: str, h: tuple[int, int, int, int], plan: Plan = Plan()) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    tree = rope(text, plan.unit)
    n = tree.units
    if not text or any(s in text for s in plan[-3:]) or h[2] % 100 >= plan.transformed:
        return n, "plain", None, None, text
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    rest, suffix = split(tree, last)
    prefix, middle = split(rest, first)
    p, s, m = (rope(x) for x in plan[-3:])
    if h[3] % 100 < plan.suffix_first:
        return n, "spm", prefix.chars, middle.chars, str(joined(s, suffix, p, prefix, m, middle))
    return n, "psm", prefix.chars, middle.chars, str(joined(p, prefix, s, suffix, m, middle))


def inverse(output: str, form: str, plan: Plan = Plan()) -> str:
    """The text that `forward` was given."""
    if form == "plain":
        return output
    order = (plan.suffix, plan.prefix, plan.middle) if form == "spm" else (plan.prefix, plan.suffix, plan.middle)
    rest, parts, at = rope(output), {}, len(output)
    for sentinel in reversed(order):
        at = output.rindex(sentinel, 0, at)
        rest, part = split(rest, at, "chars")
        parts[sentinel] = split(part, len(sentinel), "chars")[1]
    return str(joined(parts[plan.prefix], parts[plan.middle], parts[plan.suffix]))


def numbers(key: Column, seed: int) -> list[Column]:
    """h1 to h4: the first four groups of eight hex digits of the hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, plan: Plan = Plan(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of every row."""
    common.bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)
            found = [forward(t or "", x, plan) for t, x in zip(b.column(1).to_pylist(), h, strict=True)]
            yield common.from_columns(names, [b.column(0), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [()] * 5, kinds, strict=True))])

    given = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), *(c.alias(f"__h{i}") for i, c in enumerate(numbers(F.col(key), plan.seed))))
    return given.mapInArrow(rows, f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(made: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows of `transformed` with `restored`, the text rebuilt from output
    and form alone."""
    common.bounded_batches(made.sparkSession)
    kept, at = made.columns, (made.columns.index("output"), made.columns.index("form"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [inverse(o, f, plan) for o, f in zip(b.column(at[0]).to_pylist(), b.column(at[1]).to_pylist(), strict=True)]
            yield common.from_columns([*kept, "restored"], [*b.columns, pa.array(texts, pa.string())])

    return made.mapInArrow(rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema) + ", restored string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restored(transformed(common.table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def oracle() -> str:
    h = ", ".join(f"CAST(CAST('0x' || substr(s, {8 * i + 1}, 8) AS UBIGINT) AS BIGINT) AS h{i + 1}" for i in range(4))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, {h} FROM d),
c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (SELECT doc_id, t, n, form, a, b, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""
