"""Keeping evaluation sets in step with the chunks: provenance of answer
cases, recalibration after an audit, joins of reviews, and chunk inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import evaluation

#: Stands for a page or index that a chunk doesn't have when chunks are put in order.
LAST = 999_999
# The type of cases that evidence must not answer, the fields of a review, and the version of their meaning.
HARD_NEGATIVE = "insufficient_evidence"
RUBRIC = evaluation.SCORES
SEMANTICS_VERSION = "1"
REVIEW_MARKER = "ANSWER_CONTRACT_REVIEW"


def _issues(rows: DataFrame, rules: list[tuple[Column, str, Column, Column]]) -> DataFrame:
    found = [F.when(test, F.struct(F.lit(kind).alias("issue_type"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual"))) for test, kind, expected, actual in rules]
    return rows.select("case_id", F.explode(F.array_compact(F.array(*found))).alias("x")).select("case_id", "x.*")


def answer_case_issues(answer_cases: DataFrame, retrieval_cases: DataFrame) -> DataFrame:
    """(case_id, issue_type, expected, actual): answer cases (case_id,
    source_case_id, answer_type, allow_insufficient_answer, evidence_ids) whose
    retrieval case (id, excluded) is missing or excluded, and cases without an
    answer that allow one or name evidence."""
    source = retrieval_cases.select(F.col("id").alias("__id"), F.coalesce("excluded", F.lit(False)).alias("__excluded"))
    rows = answer_cases.join(source, F.col("source_case_id") == F.col("__id"), "left")
    negative = F.coalesce(F.col("answer_type") == HARD_NEGATIVE, F.lit(False))
    allowed = F.coalesce("allow_insufficient_answer", F.lit(False))
    none = F.lit(None).cast("string")
    return _issues(rows, [
        (F.col("__id").isNull(), "source_case_not_found", F.coalesce(F.nullif(F.col("source_case_id").cast("string"), F.lit("")), F.lit("non-empty source_case_id")), none),
        (F.coalesce("__excluded", F.lit(False)), "source_case_excluded", F.lit("active retrieval case"), F.col("__id")),
        (negative & ~allowed, "hard_negative_not_allowed_insufficient", F.lit("true"), F.lit("false")),
        (negative & (F.size("evidence_ids") > 0), "hard_negative_has_evidence", F.lit("[]"), F.array_join(F.col("evidence_ids").cast("array<string>"), ",")),
    ])


def answer_semantics(answer_cases: DataFrame, rubric: tuple[str, ...] = RUBRIC, version: str = SEMANTICS_VERSION, marker: str = REVIEW_MARKER) -> DataFrame:
    """One row: whether the rubric and version are right and no case's notes
    still ask for a review, and the ids of those that do."""
    open_ids = F.sort_array(F.collect_list(F.when(F.contains(F.coalesce("notes", F.lit("")), F.lit(marker)), F.col("case_id"))))
    row = answer_cases.agg(open_ids.alias("outstanding"))
    issues = F.array_compact(F.array(F.when(F.lit(not version), "missing_semantics_version"), F.when(F.lit(set(rubric) != {*RUBRIC}), "human_review_rubric_schema_mismatch"), F.when(F.size("outstanding") > 0, "outstanding_answer_contract_review")))
    return row.withColumn("issues", issues).withColumn("valid", F.size("issues") == 0)


def adjudicated(baseline: DataFrame, decisions: DataFrame) -> DataFrame:
    """Answers with the reviews of the same cases; it fails if one side has a
    case that the other lacks. The baseline's columns stay as they are."""
    mine = decisions.withColumnRenamed("case_id", "__case")
    both = baseline.join(mine, F.col("case_id").eqNullSafe(F.col("__case")) & F.col("case_id").isNotNull(), "full")
    apart = F.col("case_id").isNull() | F.col("__case").isNull()
    name = F.coalesce(F.col("case_id").cast("string"), F.col("__case").cast("string"), F.lit("null"))
    checked = F.when(apart, F.raise_error(F.concat(F.lit("reviews and answers differ in case "), name))).otherwise(F.col("case_id"))
    return both.withColumn("case_id", checked).where("case_id IS NOT NULL").drop("__case").withColumns({"full_pass": evaluation.full_pass(), "severe_failure": evaluation.severe()})


def recalibrated(cases: DataFrame, audit: DataFrame) -> DataFrame:
    """Cases (id, evidence: an array of structs) with each evidence item moved
    to the one chunk that the audit (case_id, requires_manual_review, found: an
    array, for each evidence item, of candidate structs) found for it. Cases
    that a person must look at stay; `updated` tells. The quote is kept where
    the chunk still contains it, else the chunk's text takes its place."""
    fields = [f.name for f in cases.schema["evidence"].dataType.elementType.fields]
    known = {f.name for f in audit.schema["found"].dataType.elementType.elementType.fields}
    rows = cases.join(audit.withColumnRenamed("case_id", "__case"), F.col("id") == F.col("__case"), "left")
    said = lambda text: F.raise_error(F.concat(F.lit(text), F.col("id").cast("string")))
    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")

    def moved(old: Column, new: Column) -> Column:
        kept = (flat(old["quote"]) != "") & F.contains(flat(new["text"]), flat(old["quote"]))
        quote = F.when(kept, old["quote"]).otherwise(new["text"])
        return F.struct(*((quote if f == "quote" else new[f] if f in known else old[f]).alias(f) for f in fields))

    fresh = F.zip_with("evidence", "found", lambda old, new: moved(old, new[0]))
    exact = F.forall("found", lambda c: F.size(c) == 1)
    evidence = (
        F.when(F.col("__case").isNull(), said("no audit record for case "))
        .when(F.col("requires_manual_review"), F.col("evidence"))
        .when(F.size("evidence") != F.size("found"), said("evidence changed after the audit of case "))
        .when(~exact, said("not one candidate for each evidence item of case "))
        .otherwise(fresh)
    )
    return rows.select(*[evidence.alias(c) if c == "evidence" else F.col(c) for c in cases.columns], (~F.col("requires_manual_review")).alias("updated"))


def on_expected_page(candidates: DataFrame, by: list[str], page: str = "page", expected: str = "expected_page") -> DataFrame:
    """Of each group's candidates those on the expected page, if there are
    any; else all."""
    same = F.coalesce(F.col(page) == F.col(expected), F.lit(False))
    return candidates.withColumn("__same", same).withColumn("__any", F.max("__same").over(Window.partitionBy(*by))).where("__same OR NOT __any").drop("__same", "__any")


def inspected(chunks: DataFrame, tokens: Column | None = None, page: int | None = None, pages: tuple[int, int] | None = None, section: str | None = None, show_filtered: bool = False, limit: int = 20) -> DataFrame:
    """The first `limit` chunks by page and index, or by how many of the query
    tokens they contain (those with none go), under the given conditions."""
    c = chunks
    if page is not None:
        c = c.where(F.col("page") == page)
    if pages is not None:
        c = c.where(F.col("page").between(*pages))
    if section:
        c = c.where(F.contains(F.coalesce("section", F.lit("")), F.lit(section)))
    if not show_filtered:
        c = c.where(~F.col("is_toc") & ~F.col("is_noise"))
    place = [F.coalesce("page", F.lit(LAST)), F.coalesce("chunk_index", F.lit(LAST))]
    if tokens is not None:
        c = c.withColumn("hits", F.size(F.filter(tokens, lambda t: (t != "") & F.contains("text", t)))).where("hits > 0")
        place = [F.col("hits").desc(), *place]
    return c.orderBy(*place).limit(limit)


def improved_first(moves: DataFrame) -> DataFrame:
    """Improved cases: new first places, then the greatest gains."""
    by = Window.partitionBy("movement").orderBy(~F.col("newly_top1"), F.coalesce("rank_delta", F.lit(0)).desc(), "case_id")
    return moves.where("movement = 'improved'").withColumn("place", F.row_number().over(by))


def regressed_first(moves: DataFrame) -> DataFrame:
    """Regressed cases: lost first places, then the greatest losses."""
    by = Window.partitionBy("movement").orderBy(~F.col("lost_top1"), F.coalesce("rank_delta", F.lit(0)), "case_id")
    return moves.where("movement = 'regressed'").withColumn("place", F.row_number().over(by))
