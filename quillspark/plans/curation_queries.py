"""Registered queries of the curation operators, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bm25, curation
from . import queries as q
from .catalog import query


def _answer_cases(spark, sf):
    i = F.col("item_id")
    return q.table(spark, sf, "benchmark").select(
        F.concat(F.lit("a"), i.cast("string")).alias("case_id"), F.when(i % 3 == 0, i + 1_000_000).otherwise(i).cast("string").alias("source_case_id"),
        F.when(i % 4 == 0, curation.HARD_NEGATIVE).otherwise("condition").alias("answer_type"), (i % 8 == 0).alias("allow_insufficient_answer"),
        F.when((i % 4 == 0) & (i % 12 != 0), F.array().cast("array<bigint>")).otherwise(F.array(i, i + 1)).alias("evidence_ids"), F.when(i % 6 == 0, curation.REVIEW_MARKER + ": look again").alias("notes"),
    )


@query("answer_case_issues", "WITH a AS (SELECT 'a' || item_id AS case_id, CASE WHEN item_id % 3 = 0 THEN item_id + 1000000 ELSE item_id END AS src, item_id AS i FROM benchmark), r AS (SELECT item_id AS id, item_id % 5 = 0 AS excluded FROM benchmark), j AS (SELECT * FROM a LEFT JOIN r ON src = id) SELECT case_id, 'source_case_not_found' AS issue_type, src::VARCHAR AS expected, NULL::VARCHAR AS actual FROM j WHERE id IS NULL UNION ALL SELECT case_id, 'source_case_excluded', 'active retrieval case', id::VARCHAR FROM j WHERE excluded UNION ALL SELECT case_id, 'hard_negative_not_allowed_insufficient', 'true', 'false' FROM a WHERE i % 4 = 0 AND i % 8 <> 0 UNION ALL SELECT case_id, 'hard_negative_has_evidence', '[]', i || ',' || (i + 1) FROM a WHERE i % 12 = 0")
def answer_case_issues(spark, sf):
    retrieval = q.table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), (F.col("item_id") % 5 == 0).alias("excluded"))
    return curation.answer_case_issues(_answer_cases(spark, sf), retrieval)


@query("answer_semantics", "SELECT coalesce(string_agg('a' || item_id, ',' ORDER BY 'a' || item_id) FILTER (item_id % 6 = 0), '') AS outstanding, CASE WHEN count(*) FILTER (item_id % 6 = 0) > 0 THEN 'outstanding_answer_contract_review' ELSE '' END AS issues, count(*) FILTER (item_id % 6 = 0) = 0 AS valid FROM benchmark")
def answer_semantics(spark, sf):
    return curation.answer_semantics(_answer_cases(spark, sf)).select(F.array_join("outstanding", ",").alias("outstanding"), F.array_join("issues", ",").alias("issues"), "valid")


@query("adjudicated_answers", f"{q._REVIEWS_SQL} SELECT l.doc_id AS case_id, md5(coalesce(d.text, '')) AS answer, g = 2 AND c = 2 AND m = 2 AND h = 2 AND s = 2 AND r.toxic = 0 AND r.quality = 1 AS full_pass, c = 0 OR g = 0 OR s = 0 OR r.quality = 0 AS severe_failure FROM labels l JOIN documents d USING (doc_id) JOIN r USING (doc_id)")
def adjudicated_answers(spark, sf):
    docs = q.table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), F.md5(F.coalesce("text", F.lit(""))).alias("answer"))
    answered = docs.join(q.table(spark, sf, "labels").select(F.col("doc_id").alias("case_id")), "case_id", "left_semi")
    return curation.adjudicated(answered, q._reviews(spark, sf)).select("case_id", "answer", "full_pass", "severe_failure")


@query("recalibrated_cases", "SELECT doc_id AS id, doc_id % 9 <> 0 AS updated, CASE WHEN doc_id % 9 = 0 THEN doc_id + 1000000000 ELSE doc_id END AS chunk_id, CASE WHEN doc_id % 9 = 0 THEN -1 ELSE doc_id // 10 END AS page, md5(CASE WHEN doc_id % 9 <> 0 AND doc_id % 2 = 1 THEN d.text WHEN doc_id % 2 = 1 THEN 'not in any text' ELSE d.text END) AS quote FROM labels JOIN documents d USING (doc_id) WHERE d.text <> ''")
def recalibrated_cases(spark, sf):
    i, d = F.col("doc_id"), q.table(spark, sf, "documents").join(q.table(spark, sf, "labels").select("doc_id"), "doc_id").where("text <> ''")
    quote = F.when(i % 2 == 1, "not in any text").otherwise(F.col("text"))
    cases = d.select(i.alias("id"), F.array(F.struct((i + 10**9).alias("chunk_id"), F.lit(-1).cast("bigint").alias("page"), quote.alias("quote"))).alias("evidence"))
    audit = d.select(i.alias("case_id"), (i % 9 == 0).alias("requires_manual_review"), F.array(F.array(F.struct(i.alias("chunk_id"), F.expr("doc_id div 10").alias("page"), "text"))).alias("found"))
    return curation.recalibrated(cases, audit).select("id", "updated", F.col("evidence")[0]["chunk_id"].alias("chunk_id"), F.col("evidence")[0]["page"].alias("page"), F.md5(F.col("evidence")[0]["quote"]).alias("quote"))


@query("expected_page", "WITH c AS (SELECT doc_id, source, doc_id // 10 AS page, doc_id // 10 = TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) * 4 AS same FROM documents), w AS (SELECT *, bool_or(coalesce(same, false)) OVER (PARTITION BY source) AS any_same FROM c) SELECT source, doc_id FROM w WHERE coalesce(same, false) OR NOT any_same")
def expected_page(spark, sf):
    expected = F.regexp_extract(F.col("source"), r"([0-9]+)$", 1).try_cast("bigint") * 4
    c = q.table(spark, sf, "documents").select("source", "doc_id", F.expr("doc_id div 10").alias("page"), expected.alias("expected_page"))
    return curation.on_expected_page(c, ["source"]).select("source", "doc_id")


@query("inspect_chunks", f"WITH {q.TYPED}, {q.ASKED}, i AS (SELECT chunk_id, coalesce(page, 999999) AS page, chunk_index, len(list_filter(tokens, lambda w: w <> '' AND contains(text, w))) AS hits FROM typed, asked WHERE query_id = 3 AND NOT is_toc AND NOT is_noise AND page BETWEEN 2 AND 80 AND contains(coalesce(section, ''), 'src1')) SELECT chunk_id, hits::BIGINT AS hits FROM i WHERE hits > 0 ORDER BY hits DESC, page, chunk_index LIMIT 20")
def inspect_chunks(spark, sf):
    asked = bm25.question_terms(q.questions(spark, sf).where("query_id = 3"), q.LEX).select(F.col("tokens").alias("__tokens"))
    chunks = q.typed_chunks(spark, sf).crossJoin(F.broadcast(asked))  # one question
    return curation.inspected(chunks, F.col("__tokens"), pages=(2, 80), section="src1").select("chunk_id", F.col("hits").cast("long").alias("hits"))


_PLACES = "SELECT case_id, movement, row_number() OVER (PARTITION BY movement ORDER BY CASE movement WHEN 'improved' THEN NOT newly_top1 ELSE NOT lost_top1 END, CASE movement WHEN 'improved' THEN -coalesce(rank_delta, 0) ELSE coalesce(rank_delta, 0) END, case_id) AS place FROM moved WHERE movement IN ('improved', 'regressed')"


@query("report_order", f"{q._MOVES_SQL} {_PLACES}")
def report_order(spark, sf):
    m = q.scratch.written(q._moves(spark, sf), "moves")
    rows = curation.improved_first(m).unionByName(curation.regressed_first(m))
    return rows.select("case_id", "movement", F.col("place").cast("long").alias("place"))
