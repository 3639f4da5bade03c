"""Reranking, context selection, neighbours and budgets over ranked hits.

Hits have query_id, pos and the chunk's columns; every operator takes hits
of many queries at once and keeps an explicit order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K
from ..functions.lexicon import LexiconProfile

def per_query() -> WindowSpec:
    return Window.partitionBy("query_id")


def _renumbered(hits: DataFrame, *order) -> DataFrame:
    return hits.withColumn("pos", F.row_number().over(per_query().orderBy(*order)))


def lexical_score(question: Column, text: Column) -> Column:
    """A reranker without a model: the share of the question's distinct
    tokens that the text has."""
    q, t = F.array_distinct(K.bm25_tokens(question)), K.bm25_tokens(text)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, t)).cast("double"), F.size(q).cast("double")), F.lit(0.0))


def reranked(hits: DataFrame, scorer: Callable[[Column, Column], Column] | None = lexical_score, top_k: int | None = None) -> DataFrame:
    """Order by the scorer (a Column function; a model goes in as an Arrow
    UDF), best first, ties as they were. `score` is left as it is. Without a
    scorer only the cut applies."""
    if scorer is not None:
        hits = hits.withColumn("rerank_score", scorer(F.col("question"), F.col("text"))).withColumn("original_rank", F.col("pos"))
        hits = _renumbered(hits, F.round("rerank_score", 9).desc(), "original_rank").withColumn("rerank_rank", F.col("pos"))
    return hits.where(F.col("pos") <= top_k) if top_k else hits


def metadata_bonus(lex: LexiconProfile) -> Column:
    """What structure, type and risk add to a hit's score, at most 0.25."""
    words, q = F.col("keywords"), F.col("question")
    section, chapter, text = F.coalesce("section", F.lit("")), F.coalesce("chapter", F.lit("")), F.col("text")
    hits = {n: F.size(T.contained(words, c)) for n, c in (("section", section), ("chapter", chapter), ("text", text))}
    wants = K.intents(q, lex)
    risky = F.coalesce(F.col("risk_level").isin("high", "medium"), F.lit(False))
    kind = F.coalesce("content_type", F.lit(""))

    def when(test: Column, x: float) -> Column:
        return F.when(test, x).otherwise(0.0)

    parts = [
        F.least(hits["section"] * 0.05, F.lit(0.15)), F.least(hits["chapter"] * 0.03, F.lit(0.06)), F.least(hits["text"] * 0.015, F.lit(0.09)),
        when(wants["operation"] & (kind == "procedure"), 0.06), when(wants["operation"] & ((hits["section"] > 0) | (hits["text"] > 0)), 0.04),
        when(wants["safety"] & kind.isin("warning", "caution"), 0.07), when(wants["safety"] & risky, 0.04),
        when(wants["fault"] & (T.any_of(section, lex.fault_intent) | T.any_of(text, lex.fault_intent)), 0.06), when(wants["fault"] & risky, 0.03),
    ]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.least(total, F.lit(0.25))


def selected(hits: DataFrame, lex: LexiconProfile, top_k: int = 5, enabled: bool = True, base: str = "score") -> DataFrame:
    """The top_k hits by score plus bonus; disabled, the first top_k."""
    if enabled:
        hits = hits.withColumn("keywords", K.keywords(F.col("question"), lex))
        hits = hits.withColumn("selection_score", F.coalesce(base, F.lit(0.0)) + metadata_bonus(lex)).drop("keywords")
        hits = _renumbered(hits, F.round("selection_score", 9).desc(), "pos")
    return hits.where(F.col("pos") <= top_k)


def neighbours(anchors: DataFrame, chunks: DataFrame, most: int = 1) -> DataFrame:
    """The next one or two chunks of an anchor's source, in its chapter and
    section (without a section: at most one page away), nearest first.
    `anchors` has query_id and chunk_id; the range join is an equi-join on
    source_file and chunk_index, as each anchor looks at two places."""
    a = anchors.join(chunks.select("chunk_id", "source_file", "chunk_index", "chapter", "section", "page"), "chunk_id")
    a = a.select("query_id", F.col("chunk_id").alias("anchor_id"), "source_file", F.col("chapter").alias("a_chapter"), F.col("section").alias("a_section"), F.col("page").alias("a_page"), F.explode(F.array(F.lit(1), F.lit(2))).alias("delta"), "chunk_index")
    a = a.withColumn("chunk_index", F.col("chunk_index") + F.col("delta"))
    near = a.join(chunks, ["source_file", "chunk_index"])
    has = F.coalesce("a_section", F.lit("")) != ""
    same = ((F.coalesce("a_chapter", F.lit("")) == "") | F.coalesce(F.col("chapter") == F.col("a_chapter"), F.lit(False))) & F.when(has, F.coalesce(F.col("section") == F.col("a_section"), F.lit(False))).otherwise(F.coalesce(F.abs(F.col("page") - F.col("a_page")) <= 1, F.lit(False)))
    near = near.where(same).withColumn("n", F.row_number().over(Window.partitionBy("query_id", "anchor_id").orderBy("delta", "chunk_id")))
    return near.where(F.col("n") <= most).drop("n", "a_chapter", "a_section", "a_page")


def expanded(hits: DataFrame, chunks: DataFrame, most: int = 1, enabled: bool = True) -> DataFrame:
    """Hits, and behind all of them the neighbours of those that call for
    more: warnings, cautions, procedures, and texts that end open."""
    if not enabled or most <= 0:
        return hits
    calls = F.coalesce("content_type", F.lit("")).isin("warning", "caution", "procedure") | T.strip(F.col("text")).rlike("[：:，、]$")
    anchors = hits.where(calls)
    near = neighbours(anchors.select("query_id", "chunk_id"), chunks, most)
    near = near.join(anchors.select("query_id", F.col("chunk_id").alias("anchor_id"), F.col("pos").alias("of")), ["query_id", "anchor_id"])
    last = hits.groupBy("query_id").agg(F.max("pos").alias("last"), F.first("question").alias("question")) if "question" in hits.columns else hits.groupBy("query_id").agg(F.max("pos").alias("last"))
    near = near.join(last, "query_id").withColumn("pos", F.col("last") + F.row_number().over(per_query().orderBy("of", "delta"))).withColumn("is_expanded_neighbor", F.lit(True))
    return hits.withColumn("is_expanded_neighbor", F.lit(False)).unionByName(near.drop("of", "delta", "last", "anchor_id"), allowMissingColumns=True)


def within_chars(hits: DataFrame, max_chars: int) -> DataFrame:
    """The longest run of first hits that fits; the first hit always stays."""
    if max_chars <= 0:
        return hits
    so_far = F.sum(F.length("text")).over(per_query().orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(per_query().orderBy("pos")) == 1
    return hits.withColumns({"__sum": so_far, "__first": first}).where(F.col("__first") | (F.col("__sum") <= max_chars)).drop("__sum", "__first")


def final_contexts(hits: DataFrame, max_contexts: int, max_chars: int) -> DataFrame:
    if max_contexts <= 0:
        return hits.where(F.lit(False))
    return within_chars(_renumbered(hits, "pos").where(F.col("pos") <= max_contexts), max_chars)
