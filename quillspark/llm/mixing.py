"""Mixing sources to target weights: hierarchical token budgeting.

The tree is domain > language > source. A total token budget is handed down
from the root. At each node the children share the node's budget in
proportion to their weights; a child that can't fill its share (it offers at
most `max_epochs` passes over its tokens) is given all it can take, and what
it leaves is shared among its siblings by the same rule. As a node's own
capacity is the sum of its children's, a shortage leaves a subtree only when
all siblings in it are full, and is then shared one level higher. All
budgets are whole numbers; the remainder of a division goes, a token each,
to the first children by name.

A leaf with budget b and t tokens gives every document b div t whole epochs;
the next epoch has an order of its own, drawn from the seed, and its longest
prefix with at most b mod t tokens is added.

Only DataFrame operations are used. No task sorts a leaf: the epoch's order
is cut into 4,096 ranges of its hash, the range in which the budget ends is
found from range sums, and only that range's rows are put in order. The
documents then meet one row for each leaf, which holds the last key taken.

Defined cases: a null language or source is the empty name; a null or empty
text has no tokens (copies as its place in the order gives, 0 in a leaf
without tokens); rows with equal keys (repeated rows) are taken or left
together; weights are whole numbers, 1 where not named; a weight of 0 gives
a subtree nothing; a budget above the capacity of the tree is cut to it; an
empty table gives an empty result; other columns pass through, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
#: Leaves up to which their plan is broadcast; beyond, a shuffled join.
BROADCAST_LEAVES = 50_000
BUCKET_BITS = 12
KEY_BITS = 60


@dataclass(frozen=True)
class MixPlan:
    """Weights by name for each level; budget as a share of all tokens."""

    domain_weights: Mapping[str, int] = field(default_factory=lambda: {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
    lang_weights: Mapping[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 1})
    source_weights: Mapping[str, int] = field(default_factory=dict)
    budget_percent: int = 60
    max_epochs: int = 2
    seed: int = 17
    domains: int = 4


def domain_of(source: Column, domains: int) -> Column:
    """Sources are dealt to domains by the number that ends their name."""
    n = F.regexp_extract(source, r"([0-9]+)$", 1).try_cast("bigint") % domains
    return F.coalesce(F.concat(F.lit("d"), n.cast("string")), F.lit("d"))


def _weight(name: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for value, w in weights.items():
        out = F.when(F.col(name) == value, F.lit(int(w))).otherwise(out)
    return out.cast("bigint")


def shared_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Water-filling among siblings. `nodes` has w, c and the parent's
    budget B (at most the sum of c); adds `share`."""
    every = Window.partitionBy(*parent)
    before = every.orderBy(F.col("c") / F.greatest(F.col("w"), F.lit(1)), name).rowsBetween(Window.unboundedPreceding, -1)
    n = nodes.withColumns({"cb": F.coalesce(F.sum("c").over(before), F.lit(0)), "wb": F.coalesce(F.sum("w").over(before), F.lit(0)), "tw": F.sum("w").over(every)})
    n = n.withColumn("full", F.col("c") * (F.col("tw") - F.col("wb")) <= F.col("w") * (F.col("B") - F.col("cb")))
    n = n.withColumns({"tb1": F.col("B") - F.coalesce(F.sum(F.when(F.col("full"), F.col("c"))).over(every), F.lit(0)), "tw1": F.col("tw") - F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(every), F.lit(0))})
    n = n.withColumn("part", F.expr("CASE WHEN full THEN c ELSE (w * tb1) div nullif(tw1, 0) END"))
    n = n.withColumns({"over": F.col("tb1") - F.coalesce(F.sum(F.when(~F.col("full"), F.col("part"))).over(every), F.lit(0)), "nth": F.row_number().over(Window.partitionBy(*parent, "full").orderBy(name))})
    share = F.col("part") + F.when(~F.col("full") & (F.col("nth") <= F.col("over")), 1).otherwise(0)
    return n.withColumn("share", share).drop("cb", "wb", "tw", "full", "tb1", "tw1", "part", "over", "nth")


def _keyed(docs: DataFrame, plan: MixPlan) -> DataFrame:
    """The input's row as one struct, as its columns may have any name."""
    source = F.coalesce(F.col("source"), F.lit(""))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        domain_of(source, plan.domains).alias("__domain"),
        F.coalesce(F.col("lang"), F.lit("")).alias("__lang"),
        source.alias("__source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("__tokens"),
    )


LEAF = ["__domain", "__lang", "__source"]


def leaf_budgets(leaves: DataFrame, plan: MixPlan) -> DataFrame:
    """The budget of each leaf of (domain, lang, source, tokens)."""
    w = leaves.withColumns({"w1": _weight("__domain", plan.domain_weights), "w2": _weight("__lang", plan.lang_weights), "w3": _weight("__source", plan.source_weights)})
    w = w.withColumn("c3", F.when((F.col("w1") > 0) & (F.col("w2") > 0) & (F.col("w3") > 0), F.col("t") * plan.max_epochs).otherwise(F.lit(0)))
    tops = w.groupBy("__domain", "w1").agg(F.sum("c3").alias("c"), F.sum("t").alias("t")).withColumnRenamed("w1", "w")
    whole = Window.partitionBy(F.lit(0))
    tops = tops.withColumn("B", F.least(F.sum("c").over(whole), F.expr("(sum(t) over (partition by 0) * %d) div 100" % plan.budget_percent)))
    tops = shared_out(tops.withColumn("__root", F.lit(0)), ["__root"], "__domain")
    langs = w.groupBy("__domain", "__lang", "w2").agg(F.sum("c3").alias("c")).withColumnRenamed("w2", "w")
    langs = shared_out(langs.join(tops.select("__domain", F.col("share").alias("B")), "__domain"), ["__domain"], "__lang")
    ends = w.select(*LEAF, "t", F.col("w3").alias("w"), F.col("c3").alias("c"))
    ends = shared_out(ends.join(langs.select("__domain", "__lang", F.col("share").alias("B")), ["__domain", "__lang"]), ["__domain", "__lang"], "__source")
    return ends.select(*LEAF, "t", F.col("share").alias("b"))


def _order(plan: MixPlan, key: str) -> Column:
    text = F.concat_ws(":", F.lit(str(plan.seed)), F.col("__full").cast("string"), F.col(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def mixed(docs: DataFrame, plan: MixPlan | None = None, key: str = "doc_id") -> DataFrame:
    """row (the input's columns), domain, lang, source, tokens, leaf_tokens,
    budget and copies (how often the row is taken)."""
    plan = plan or MixPlan()
    slim = common.written(_keyed(docs, plan).select(F.col(f"row.{key}").alias("__id"), *LEAF, "__tokens"), "tokens")
    budgets = leaf_budgets(slim.groupBy(*LEAF).agg(F.sum("__tokens").alias("t")), plan)
    budgets = budgets.select(*LEAF, "t", "b", F.expr("b div nullif(t, 0)").alias("__full"), (F.col("b") % F.nullif(F.col("t"), F.lit(0))).alias("rest"))
    budgets = common.written(budgets, "budgets")
    small = (lambda x: F.broadcast(x)) if budgets.count() <= BROADCAST_LEAVES else (lambda x: x)
    shift = KEY_BITS - BUCKET_BITS
    ordered = slim.join(small(budgets), LEAF).withColumn("__key", _order(plan, "__id")).withColumn("__bucket", F.shiftright("__key", shift))
    sums = ordered.groupBy(*LEAF, "__bucket").agg(F.sum("__tokens").alias("s"), F.first("rest").alias("rest"))
    upto = F.sum("s").over(Window.partitionBy(*LEAF).orderBy("__bucket"))
    last = sums.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
    last = last.groupBy(*LEAF).agg(F.min(F.struct("__bucket", (F.col("upto") - F.col("s")).alias("start"))).alias("x")).select(*LEAF, F.col("x.__bucket").alias("__last"), "x.start")
    inside = ordered.join(small(last), LEAF).where(F.col("__bucket") == F.col("__last"))
    cum = F.sum("__tokens").over(Window.partitionBy(*LEAF).orderBy("__key", "__id", "__tokens"))
    cut = inside.withColumn("cum", F.col("start") + cum).where(F.col("cum") <= F.col("rest")).groupBy(*LEAF).agg(F.max(F.struct("__key", "__id", "__tokens")).alias("__cut"))
    leaf = common.written(budgets.join(last, LEAF, "left").join(cut, LEAF, "left").select(*LEAF, F.col("t").alias("leaf_tokens"), F.col("b").alias("budget"), "__full", "__last", "__cut"), "leaves")
    common.discarded(docs.sparkSession, slim, budgets)
    out = _keyed(docs, plan).join(small(leaf), LEAF).withColumn("__key", _order(plan, f"row.{key}"))
    bucket = F.shiftright("__key", shift)
    mine = F.struct(F.col("__key"), F.col(f"row.{key}").alias("__id"), F.col("__tokens"))
    taken = F.col("__last").isNull() | (bucket < F.col("__last")) | ((bucket == F.col("__last")) & F.coalesce(mine <= F.col("__cut"), F.lit(False)))
    copies = F.when(F.col("__full").isNull(), 0).otherwise(F.col("__full") + F.when(taken, 1).otherwise(0))
    return out.select("row", F.col("__domain").alias("domain"), F.col("__lang").alias("lang"), F.col("__source").alias("source"), F.col("__tokens").alias("tokens"), "leaf_tokens", "budget", copies.cast("bigint").alias("copies"))


def mixed_documents(docs: DataFrame, plan: MixPlan | None = None) -> DataFrame:
    """The mixture itself: each row as often as it is taken."""
    rows = mixed(docs, plan).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(common.table(spark, sf_dir, "documents"))
    return rows.select("row.doc_id", "domain", "lang", "source", F.col("tokens").alias("n_tokens"), "leaf_tokens", F.col("budget").alias("leaf_budget"), "copies")


def _case(name: str, weights: Mapping[str, int]) -> str:
    return f"CASE {' '.join(f"WHEN {name} = '{k}' THEN {v}" for k, v in weights.items())} ELSE 1 END" if weights else "1"


def _level_sql(name: str, source: str, parent: str, key: str, keep: str) -> str:
    p = f"PARTITION BY {parent}"
    return f"""
{name}_a AS (SELECT *, coalesce(sum(c) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb, coalesce(sum(w) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb, sum(w) OVER ({p}) AS tw FROM {source} WINDOW b AS ({p} ORDER BY c::DOUBLE / greatest(w, 1), {key})),
{name}_b AS (SELECT *, c * (tw - wb) <= w * (B - cb) AS filled FROM {name}_a),
{name}_c AS (SELECT *, B - coalesce(sum(c) FILTER (filled) OVER ({p}), 0) AS b1, tw - coalesce(sum(w) FILTER (filled) OVER ({p}), 0) AS w1 FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN filled THEN c ELSE (w * b1) // w1 END AS part FROM {name}_c),
{name}_e AS (SELECT *, b1 - coalesce(sum(part) FILTER (NOT filled) OVER ({p}), 0) AS spare, row_number() OVER ({p}, filled ORDER BY {key}) AS nth FROM {name}_d),
{name} AS (SELECT {keep}, part + CASE WHEN NOT filled AND nth <= spare THEN 1 ELSE 0 END AS share FROM {name}_e)"""


def oracle_ctes(docs: str = "documents", plan: MixPlan | None = None) -> str:
    """CTEs for DuckDB that end in `mix`: every row of `docs` with its copies."""
    p = plan or MixPlan()
    return f"""
keyed AS (SELECT *, coalesce('d' || (TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS BIGINT) % {p.domains})::VARCHAR, 'd') AS k1, coalesce(lang, '') AS k2, coalesce(source, '') AS k3, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM {docs}),
leaf0 AS (SELECT k1, k2, k3, sum(n_tokens)::BIGINT AS t, any_value({_case('k1', p.domain_weights)}) AS w1, any_value({_case('k2', p.lang_weights)}) AS w2, any_value({_case('k3', p.source_weights)}) AS w3 FROM keyed GROUP BY ALL),
leaf1 AS (SELECT *, CASE WHEN w1 > 0 AND w2 > 0 AND w3 > 0 THEN t * {p.max_epochs} ELSE 0 END AS c3 FROM leaf0),
top0 AS (SELECT 0 AS root, k1, w1 AS w, sum(c3) AS c, sum(t) AS t FROM leaf1 GROUP BY ALL),
top1 AS (SELECT *, least(sum(c) OVER (), (sum(t) OVER () * {p.budget_percent}) // 100) AS B FROM top0),{_level_sql('top2', 'top1', 'root', 'k1', 'k1')},
lang0 AS (SELECT l.k1, l.k2, l.w2 AS w, sum(l.c3) AS c, any_value(s.share) AS B FROM leaf1 l JOIN top2 s USING (k1) GROUP BY ALL),{_level_sql('lang1', 'lang0', 'k1', 'k2', 'k1, k2')},
end0 AS (SELECT l.k1, l.k2, l.k3, l.t, l.w3 AS w, l.c3 AS c, s.share AS B FROM leaf1 l JOIN lang1 s USING (k1, k2)),{_level_sql('end1', 'end0', 'k1, k2', 'k3', 'k1, k2, k3, t')},
drawn AS (SELECT d.*, e.t, e.share, e.share // nullif(e.t, 0) AS whole, e.share % nullif(e.t, 0) AS rest FROM keyed d JOIN end1 e USING (k1, k2, k3)),
placed AS (SELECT *, ('0x' || substr(md5('{p.seed}:' || whole::VARCHAR || ':' || doc_id::VARCHAR), 1, 15))::BIGINT AS pos FROM drawn),
mix AS (SELECT *, CASE WHEN whole IS NULL THEN 0 ELSE whole + CASE WHEN sum(n_tokens) OVER (PARTITION BY k1, k2, k3 ORDER BY pos, doc_id, n_tokens) <= rest THEN 1 ELSE 0 END END AS copies FROM placed)"""


def oracle() -> str:
    return f"WITH {oracle_ctes().strip()}\nSELECT doc_id, k1 AS domain, k2 AS lang, k3 AS source, n_tokens, t AS leaf_tokens, share::BIGINT AS leaf_budget, copies::BIGINT AS copies FROM mix"
