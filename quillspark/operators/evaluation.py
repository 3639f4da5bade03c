"""Evaluation of answers, gold data, reports, reviews and repeated runs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import scratch
from . import answers, winnow

SCORES = ("groundedness", "correctness", "completeness", "condition_handling", "safety_preservation")
# Where a failed answer went wrong, and the labels of cases.
LAYERS = ("NONE", "RETRIEVAL", "CONTEXT_SELECTION", "GENERATION", "BENCHMARK", "EVALUATOR", "MIXED", "UNCERTAIN")
CATEGORIES = ("alarm", "explanation", "location", "maintenance", "parameter", "procedure", "warning")
#: Characters of a needle's beginning that are looked up by hash, and characters of needles that a task holds at once.
ANCHOR = 16
NEEDLES = 4_000_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


# ------------------------------------------------------------------ answers


def answer_checks(rows: DataFrame) -> DataFrame:
    """Deterministic checks of answers; `rows` has case_id, answer, the term
    lists, expected and cited sections and subsections (arrays) and
    allow_insufficient_answer. A check without an expectation is null."""
    key = T.answer_key(F.col("answer"))

    def keyed(name: str) -> Column:
        return F.col(f"__{name}")

    terms = ("must_include_terms", "must_not_include_terms")
    out = rows.withColumn("__key", key)
    for t in terms:
        # terms are folded the way the answer is; one Arrow call for the list
        out = out.withColumn(f"__{t}", F.split(T.answer_key(F.array_join(F.transform(t, lambda x: F.regexp_replace(x, "\u0001", " ")), "\u0001")), "\u0001", -1))
    include = F.arrays_zip(F.col("must_include_terms").alias("t"), keyed("must_include_terms").alias("k"))
    forbidden = F.arrays_zip(F.col("must_not_include_terms").alias("t"), keyed("must_not_include_terms").alias("k"))

    def has(x: Column) -> Column:
        return (x["k"] != "") & F.contains(F.col("__key"), x["k"])

    matched = F.transform(F.filter(include, lambda x: (x["t"] != "") & has(x)), lambda x: x["t"])
    missing = F.transform(F.filter(include, lambda x: (x["t"] != "") & ~has(x)), lambda x: x["t"])
    hits = F.transform(F.filter(forbidden, lambda x: (x["t"] != "") & has(x)), lambda x: x["t"])

    def cited(expected: str, got: str) -> Column:
        hit = F.exists(got, lambda s: (F.coalesce(s, F.lit("")) != "") & F.exists(expected, lambda e: F.contains(s, e) | F.contains(e, s)))
        return F.when(F.size(expected) > 0, F.coalesce(hit, F.lit(False)))

    section, sub = cited("expected_sections", "cited_sections"), cited("expected_subsections", "cited_subsections")
    structure = F.when(section.isNull() & sub.isNull(), F.lit(None).cast("boolean")).otherwise(F.coalesce(section, F.lit(True)) & F.coalesce(sub, F.lit(True)))
    return out.select(
        "case_id", (T.strip(F.col("answer")) != "").alias("answer_non_empty"),
        F.when(F.size("must_include_terms") > 0, F.size(matched) / F.size("must_include_terms")).alias("term_coverage"), matched.alias("matched_terms"), missing.alias("missing_terms"), hits.alias("forbidden_hits"),
        section.alias("expected_section_hit"), sub.alias("expected_subsection_hit"), structure.alias("evidence_structure_hit"),
        F.when(F.col("allow_insufficient_answer"), F.contains("answer", F.lit(answers.NO_ANSWER))).alias("insufficient_behavior"), answers.leaks_reference(F.col("answer")).alias("internal_reference_leak"),
    )


def answer_summary(checks: DataFrame) -> DataFrame:
    def share(c: str) -> Column:
        return F.avg(F.col(c).cast("double")).alias(f"{c}_rate")

    return checks.agg(F.count(F.lit(1)).alias("case_count"), F.avg("term_coverage").alias("mean_term_coverage"), F.sum((F.size("forbidden_hits") > 0).cast("long")).alias("forbidden_cases"), share("answer_non_empty"), share("expected_section_hit"), share("expected_subsection_hit"), share("evidence_structure_hit"), share("insufficient_behavior"), F.sum(F.col("internal_reference_leak").cast("long")).alias("leak_count"))


# -------------------------------------------------------------- gold checks


def gold_issues(evidence: DataFrame, chunks: DataFrame, strict: bool = False) -> DataFrame:
    """(case_id, issue_type, field, expected, actual) of gold evidence that
    does not match the current chunks. Blank expectations are skipped;
    `strict` compares them too (nulls included) and misses quotes."""
    fields = ("page", "chapter", "section", "subsection")
    got = chunks.select(F.col("chunk_id").alias("g_id"), F.col("text").alias("g_text"), *(F.col(f).alias(f"g_{f}") for f in fields), *([F.col("index_status").alias("g_status")] if "index_status" in chunks.columns else [F.lit("indexed").alias("g_status")]))
    e = evidence.join(got, evidence["chunk_id"] == got["g_id"], "left")
    gone = F.col("g_id").isNull()

    def issue(test: Column, kind: str, field: str, expected: Column, actual: Column) -> Column:
        return F.when(test, F.struct(F.lit(kind).alias("issue_type"), F.lit(field).alias("field"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual")))

    found = [issue(gone, "missing_chunk", "chunk_id", F.col("chunk_id"), F.lit(None)), issue(~gone & (F.col("g_status") == "filtered"), "filtered_chunk", "chunk_id", F.col("chunk_id"), F.col("g_status"))]
    for f in fields:
        differs = ~F.col(f).eqNullSafe(F.col(f"g_{f}"))
        told = F.lit(True) if strict else F.coalesce(F.col(f).cast("string"), F.lit("")) != ""
        found.append(issue(~gone & told & differs, "field_mismatch", f, F.col(f), F.col(f"g_{f}")))
    quote = T.compact(F.coalesce("quote", F.lit("")))
    if strict:
        found.append(issue(quote == "", "missing_quote", "quote", F.col("quote"), F.lit(None)))
    found.append(issue(~gone & (quote != "") & ~F.contains(T.compact(F.col("g_text")), quote), "quote_not_found", "quote", F.col("quote"), F.lit(None)))
    return e.select("case_id", F.explode(F.array_compact(F.array(*found))).alias("x")).select("case_id", "x.*")


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_type").agg(F.count(F.lit(1)).alias("issues"))


def ensure_valid(issues: DataFrame, first: int = 20) -> None:
    """Raise with the first issues, if there are any."""
    rows = issues.orderBy("case_id", "issue_type", "field").limit(first).collect()
    if rows:
        raise ValueError("gold data do not match the index:\n" + "\n".join(f"{r.case_id}: {r.issue_type} {r.field}: expected {r.expected}, found {r.actual}" for r in rows))


def _windows(text: str, widths: list[int]) -> dict[int, np.ndarray]:
    """A hash of every window of so many characters (powers of two)."""
    h, width, out = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), 1, {}
    while len(h):
        if width in widths:
            out[width] = h * _SPREAD
        if width >= widths[-1]:
            break
        h = (h[:-width] * (_SPREAD + np.uint64(2 * width))) ^ (h[width:] + (h[width:] >> np.uint64(29)))
        width *= 2
    return out


def _anchors(needles: list[str]) -> dict[int, tuple[np.ndarray, list[list[str]]]]:
    """For each width, the hashes of the needles' beginnings, sorted, and the
    needles of each; a needle's width is the greatest that it fills."""
    by: dict[int, dict[int, list[str]]] = {}
    for x in needles:
        width = min(ANCHOR, 1 << (len(x).bit_length() - 1))
        by.setdefault(width, {}).setdefault(int(_windows(x[:width], [width])[width][0]), []).append(x)
    return {w: (np.array(sorted(d), np.uint64), [d[h] for h in sorted(d)]) for w, d in sorted(by.items())}


def containing(needles: DataFrame, chunks: DataFrame) -> DataFrame:
    """(needle, new_id, new_page) of the chunks whose new_flat contains a
    needle; new_id is unique. Needles of NEEDLES characters together are handed to
    all tasks. Beyond, those that have a fingerprint are looked up in a
    winnowed index of the chunks by shuffle, and only shorter ones are handed out."""
    needles = needles.where("needle <> ''").distinct()
    if (needles.agg(F.sum(F.length("needle"))).first()[0] or 0) <= NEEDLES:
        return handed_out(needles, chunks)
    held = scratch.written(winnow.index(chunks, "new_id", "new_flat"), "winnowed")
    return winnow.contained(needles, chunks, held).unionByName(handed_out(needles.where(F.length("needle") < winnow.LEAST), chunks))


def handed_out(needles: DataFrame, chunks: DataFrame) -> DataFrame:
    """`containing` with needles in blocks of NEEDLES characters, each handed to
    all tasks; windows of a chunk that hash like a needle's beginning are
    compared with the needle."""
    spark, out, block, held = chunks.sparkSession, None, [], 0
    c = chunks.select("new_id", "new_page", "new_flat")
    kinds = f"needle string, new_id {c.schema['new_id'].dataType.simpleString()}, new_page {c.schema['new_page'].dataType.simpleString()}"

    def found(block: list[str]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            anchors = _anchors(shared.value)
            widths = list(anchors)
            for b in batches:
                row, hit = [], []
                for r, text in enumerate(b.column(2).to_pylist()):
                    mine: set[str] = set()
                    for width, h in _windows(text or "", widths).items() if widths else ():
                        keys, held = anchors[width]
                        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                        for p in np.flatnonzero(keys[at] == h).tolist():
                            mine.update(x for x in held[at[p]] if x not in mine and text.startswith(x, p))
                    row += [r] * len(mine)
                    hit += sorted(mine)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(hit, pa.string()), b.column(0).take(at), b.column(1).take(at)], names=["needle", "new_id", "new_page"])

        return c.mapInArrow(rows, kinds)

    for r in needles.toLocalIterator():
        block.append(r[0])
        held += len(r[0])
        if held >= NEEDLES:
            out, block, held = found(block) if out is None else out.unionByName(found(block)), [], 0
    if block:
        out = found(block) if out is None else out.unionByName(found(block))
    return spark.createDataFrame([], kinds) if out is None else out


def candidates(evidence: DataFrame, chunks: DataFrame, enough: float = 0.5) -> DataFrame:
    """Current chunks for old evidence by a ladder of methods: the same id,
    the exact quote, a phrase of it, the page with enough of the terms. The
    first method that finds any is used, and only evidence without a chunk
    goes on to the next. Ids and pages are equi-joins, quotes and phrases are
    looked up in blocks, so neither side has a limit. Chunk ids are unique."""
    return _ladder(evidence, chunks, enough, False).drop("n")


def counted_candidates(evidence: DataFrame, chunks: DataFrame, enough: float = 0.5) -> DataFrame:
    """`candidates` for `audit`: of the chunks with a quote, only their number
    n and the least id and page, so that rows don't grow with the square of a
    group of equal quotes."""
    return _ladder(evidence, chunks, enough, True)


def _ladder(evidence: DataFrame, chunks: DataFrame, enough: float, counted: bool) -> DataFrame:
    quote = T.compact(F.coalesce("quote", F.lit("")))
    phrases = F.filter(F.split(F.coalesce("quote", F.lit("")), "[。；;！!？?\n\r■□]"), lambda p: F.length(T.squeeze(p)) >= 10)
    left = evidence.withColumns({"__q": quote, "__p": F.transform(phrases, T.compact)})
    c = chunks.select(F.col("chunk_id").alias("new_id"), F.col("page").alias("new_page"), F.col("text").alias("new_text"), T.compact(F.col("text")).alias("new_flat"))
    share = F.when(F.size("terms") > 0, F.size(T.contained(F.col("terms"), F.col("new_text"))) / F.size("terms")).otherwise(0.0)
    one = F.lit(1).cast("long").alias("n")
    named = ["case_id", "evidence_no", F.col("chunk_id").alias("old_id"), "new_id", "new_page"]

    def by_text(e: DataFrame, needles: Column) -> DataFrame:
        e = e.select("case_id", "evidence_no", "chunk_id", needles.alias("__needles"))
        n = e.select("__needles").distinct().withColumn("needle", F.explode("__needles"))
        found = n.join(containing(n.select("needle"), c), "needle").select("__needles", "new_id", "new_page").distinct().withColumn("n", one)
        if counted:
            found = found.groupBy("__needles").agg(F.min("new_id").alias("new_id"), F.min("new_page").alias("new_page"), F.count(F.lit(1)).alias("n"))
        return e.join(found, "__needles").select(*named, "n")

    steps = [
        ("existing_chunk_id", lambda e: e.join(c.select("new_id", "new_page"), e["chunk_id"] == F.col("new_id")).select(*named, one)), ("exact_quote", lambda e: by_text(e, F.array("__q"))),
        ("phrase", lambda e: by_text(e, F.col("__p"))), ("page_terms", lambda e: e.join(c, e["page"] == F.col("new_page")).where(share >= enough).select(*named, one)),
    ]
    out = None
    for name, step in steps:
        found = scratch.written(step(left).withColumn("match_method", F.lit(name)), "found")
        done = found.select(F.col("case_id").alias("__case"), F.col("evidence_no").alias("__no")).distinct()
        if name == steps[-1][0]:
            return found if out is None else out.unionByName(found)
        left = scratch.written(left.join(done, left["case_id"].eqNullSafe(done["__case"]) & left["evidence_no"].eqNullSafe(done["__no"]), "left_anti"), "left")
        out = found if out is None else out.unionByName(found)
    return out


def audit(evidence: DataFrame, found: DataFrame) -> DataFrame:
    """(case_id, classification, confidence, needs_review) of each case, from
    `candidates` or `counted_candidates`."""
    n = F.sum("n") if "n" in found.columns else F.count(F.lit(1))
    per = evidence.select("case_id", "evidence_no", "chunk_id", "page").join(found.groupBy("case_id", "evidence_no").agg(n.alias("n"), F.min("new_id").alias("new_id"), F.min("new_page").alias("new_page"), F.min("match_method").alias("how")), ["case_id", "evidence_no"], "left")
    by = per.groupBy("case_id").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("least"), F.max(F.coalesce("n", F.lit(0))).alias("most"), F.array_sort(F.collect_set("chunk_id")).alias("old"), F.array_sort(F.collect_set("new_id")).alias("new"),
        F.max((F.col("page").isNotNull() & ~F.col("page").eqNullSafe(F.col("new_page"))).cast("int")).alias("moved"), F.collect_set("how").alias("how"),
    )
    kind = (
        F.when((F.col("least") == 0) | (F.col("most") > 1), "AMBIGUOUS").when((F.col("old") == F.col("new")) & (F.col("moved") == 0), "UNCHANGED")
        .when(F.size("old") != F.size("new"), "MULTI_GOLD_CHANGED").when(F.col("moved") == 1, "METADATA_CHANGED").otherwise("CHUNK_ID_CHANGED")
    )
    sure = F.size(F.array_except("how", F.array(F.lit("existing_chunk_id"), F.lit("exact_quote")))) == 0
    confidence = F.when(F.col("least") == 0, "low").when(F.col("most") > 1, "medium").when((kind == "CHUNK_ID_CHANGED") & ~sure, "medium").otherwise("high")
    return by.select("case_id", kind.alias("classification"), confidence.alias("confidence"), (confidence != "high").alias("needs_review"))


# ------------------------------------------------------------------ reports


def movements(baseline: DataFrame, experiment: DataFrame) -> DataFrame:
    """Case by case: (case_id, baseline_rank, experiment_rank, rank_delta,
    movement, top-1 gained or lost, hit@5 lost). Both have (case_id, rank);
    a null rank is worst. Cases of one side only are an error."""
    b, e = baseline.select("case_id", F.col("rank").alias("baseline_rank"), F.lit(1).alias("b")), experiment.select("case_id", F.col("rank").alias("experiment_rank"), F.lit(1).alias("e"))
    both = b.join(e, "case_id", "full")
    sided = F.when(F.col("b").isNull() | F.col("e").isNull(), F.raise_error(F.concat(F.lit("a case is in one report only: "), F.col("case_id").cast("string"))))
    x, y = F.coalesce("baseline_rank", F.lit(10**9)), F.coalesce("experiment_rank", F.lit(10**9))
    return both.where(sided.isNull()).select(
        "case_id", "baseline_rank", "experiment_rank", (F.col("baseline_rank") - F.col("experiment_rank")).alias("rank_delta"), F.when(y < x, "improved").when(y > x, "regressed").otherwise("unchanged").alias("movement"),
        ((y == 1) & (x != 1)).alias("newly_top1"), ((x == 1) & (y != 1)).alias("lost_top1"), ((x <= 5) & (y > 5)).alias("hit5_regression"),
    )


def movement_summary(moves: DataFrame) -> DataFrame:
    def n(test: Column, name: str) -> Column:
        return F.coalesce(F.count_if(test), F.lit(0)).alias(name)

    return moves.agg(F.count(F.lit(1)).alias("cases"), *(n(F.col("movement") == m, m) for m in ("improved", "regressed", "unchanged")), n(F.col("newly_top1"), "newly_top1"), n(F.col("lost_top1"), "lost_top1"), n(F.col("hit5_regression"), "hit5_regressions"))


def recommendation(summary: dict) -> str:
    """A verdict in words from a movement summary."""
    if summary["hit5_regressions"] or summary["regressed"] > summary["improved"]:
        return "keep the baseline"
    return "adopt the experiment" if summary["improved"] > summary["regressed"] else "no difference"


def group_deltas(baseline: DataFrame, experiment: DataFrame, metrics: list[str], group: str) -> DataFrame:
    """Means of metrics by group on both sides and their difference."""

    def means(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(F.coalesce(F.nullif(F.col(group), F.lit("")), F.lit("N/A")).alias(group)).agg(*(F.avg(F.col(f"`{m}`").cast("double")).alias(f"{side}_{m}") for m in metrics))

    both = means(baseline, "baseline").join(means(experiment, "experiment"), group, "full")
    return both.select("*", *((F.col(f"experiment_{m}") - F.col(f"baseline_{m}")).alias(f"delta_{m}") for m in metrics))


def latency(baseline_s: float, experiment_s: float, cases: int) -> dict[str, float | None]:
    return {"baseline_per_case": baseline_s / cases if cases else None, "experiment_per_case": experiment_s / cases if cases else None, "ratio": experiment_s / baseline_s if baseline_s else None}


def across_modes(ranks: DataFrame, modes: tuple[str, ...] = ("dense", "bm25", "hybrid")) -> DataFrame:
    """Ranks by mode, the best and worst modes (ties joined), and notes."""
    wide = ranks.groupBy("case_id").pivot("mode", list(modes)).agg(F.min("rank"))
    worst = 10**9
    at = {m: F.coalesce(F.col(m), F.lit(worst)) for m in modes}
    top, low = F.least(*at.values()), F.greatest(*at.values())
    best = F.when(top < worst, F.concat_ws("/", *(F.when(at[m] == top, m) for m in modes)))
    bad = F.when(low > top, F.concat_ws("/", *(F.when(at[m] == low, m) for m in modes)))
    notes = F.concat_ws(",", F.when(at["hybrid"] < F.least(at["dense"], at["bm25"]), "hybrid_best"), F.when(at["hybrid"] > at["dense"], "hybrid_worse_than_dense"), F.when(at["hybrid"] > at["bm25"], "hybrid_worse_than_bm25"), F.when(top == worst, "all_missed"))
    return wide.select("case_id", *modes, best.alias("best_modes"), bad.alias("worst_modes"), notes.alias("notes"))


# ------------------------------------------------------------------ reviews


def full_pass() -> Column:
    out = ~F.col("unsupported_claim") & ~F.col("critical_safety_omission")
    for s in SCORES:
        out = out & (F.col(s) == 2)
    return out


def severe() -> Column:
    return (F.col("correctness") == 0) | (F.col("groundedness") == 0) | (F.col("safety_preservation") == 0) | F.col("critical_safety_omission")


def review_summary(reviews: DataFrame) -> DataFrame:
    """One row: counts, rates, means and the histogram of each score."""
    n = F.count(F.lit(1))
    flags = {"full_pass": full_pass(), "severe_failure": severe(), "unsupported_claim": F.col("unsupported_claim"), "critical_safety_omission": F.col("critical_safety_omission")}
    counts = [x for k, f in flags.items() for x in (F.count_if(f).alias(f"{k}_count"), F.try_divide(F.count_if(f), n).alias(f"{k}_rate"))]
    return reviews.agg(n.alias("case_count"), *counts, *(F.avg(s).alias(f"{s}_mean") for s in SCORES), *(F.count_if(F.col(s) == v).alias(f"{s}_{v}") for s in SCORES for v in (0, 1, 2)))


def layer_counts(reviews: DataFrame) -> DataFrame:
    layers = reviews.sparkSession.createDataFrame([(x,) for x in LAYERS], "layer string")
    return layers.join(reviews.groupBy(F.col("primary_failure_layer").alias("layer")).count(), "layer", "left").select("layer", F.coalesce("count", F.lit(0)).alias("cases"))


def label_counts(reviews: DataFrame, labels: str = "failure_labels") -> DataFrame:
    return reviews.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("cases"))


def stability(runs: DataFrame) -> DataFrame:
    """(case_id, runs, raw_stable, final_stable, evidence_stable, stable) of
    repeated runs (case_id, raw_answer, final_answer, evidence_json); null
    counts as a value."""

    def one(c: str) -> Column:
        return F.countDistinct(F.struct(c)) == 1

    out = runs.groupBy("case_id").agg(F.count(F.lit(1)).alias("runs"), one("raw_answer").alias("raw_stable"), one("final_answer").alias("final_stable"), one("evidence_json").alias("evidence_stable"))
    return out.withColumn("stable", F.col("raw_stable") & F.col("final_stable") & F.col("evidence_stable"))


def stability_cases(cases: DataFrame, ids: list | None = None) -> DataFrame:
    """The cases that are run again: those with the given ids, all of which
    must be there, or all cases."""
    if ids is None:
        return cases
    asked = cases.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], cases.select("case_id").schema)
    missing = [r[0] for r in asked.join(cases, "case_id", "left_anti").orderBy("case_id").collect()]
    if missing:
        raise ValueError(f"cases that are not in the dataset: {missing}")
    return cases.join(asked, "case_id", "left_semi")


def verification(stable: DataFrame, status: str, runs_per_case: int, provenance: dict | None = None, identity: dict | None = None, error: str | None = None) -> DataFrame:
    """One row that states what a repeated run has shown, of `stability` rows. Nothing is
    verified without cases, or unless the run itself ended well (VERIFIED)."""
    n = F.count(F.lit(1))
    every = lambda c: (n > 0) & F.coalesce(F.bool_and(c), F.lit(False))
    out = stable.agg(
        n.alias("case_count"), F.count_if(~F.col("stable")).alias("unstable_cases"), F.count_if(F.col("runs") != runs_per_case).alias("incomplete_cases"),
        every("raw_stable").alias("raw_answers_match"), every("final_stable").alias("final_answers_match"), every("evidence_stable").alias("evidence_matches"), every("stable").alias("all_stable"),
    )
    told = {"verification_status": status, "runs_per_case": runs_per_case, "generation": json.dumps(provenance or {}, sort_keys=True), "runtime": json.dumps(identity or {}, sort_keys=True), "environment_error": error}
    out = out.withColumns({k: F.lit(v) for k, v in told.items()})
    return out.withColumn("repeated_run_stability_verified", (F.col("verification_status") == "VERIFIED") & F.col("all_stable") & (F.col("incomplete_cases") == 0))


def benchmark_counts(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: records, active and excluded ones, and the evidence items of
    active ones; cases are (case_id, excluded), evidence is (case_id, ...)."""
    active = cases.where(~F.coalesce("excluded", F.lit(False)))
    items = evidence.join(active.select("case_id").distinct(), "case_id", "left_semi").agg(F.count(F.lit(1)).alias("evidence_items"), F.countDistinct("case_id").alias("cases_with_evidence"))
    # two single rows
    return cases.agg(F.count(F.lit(1)).alias("records"), F.count_if(~F.coalesce("excluded", F.lit(False))).alias("active"), F.count_if(F.coalesce("excluded", F.lit(False))).alias("excluded")).crossJoin(items)


# --------------------------------------------------------------------- lint


def lint(cases: DataFrame, id_pattern: str = "^[a-z]+_[0-9]{3}$", categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(id, issue): malformed, empty, unknown and repeated entries."""
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    rules = [F.when(~F.coalesce(F.col("id").rlike(id_pattern), F.lit(False)), "bad_id"), F.when(T.strip(F.coalesce("question", F.lit(""))) == "", "empty_question"), F.when(~F.coalesce(F.col("category").isin(*categories), F.lit(False)), "unknown_category"), F.when(F.col("__n") > 1, "duplicate_id")]
    return cases.withColumn("__n", n).select("id", F.explode(F.array_compact(F.array(*rules))).alias("issue"))


# What a case of the retrieval benchmark may be, and words of questions that a picture is needed for.
CASE_ID = r"^[a-z0-9]+(_[a-z0-9]+)*_[0-9]{3}$"
CASE_CATEGORIES = ("alarm_handling", "explanation", "location_query", "maintenance_check", "parameter_query", "procedure", "warning_notice")
CASE_INTENTS = (
    "alarm_handling", "broad_usage_guidance", "concept_explanation", "forbidden_condition", "limit_parameter", "location_and_operation",
    "location_and_parameter", "location_query", "maintenance_guidance", "safety_notice", "specific_operation", "state_explanation",
)
VISUAL_TERMS = ("按钮图标", "第几个编号", "见图", "图示", "图标", "如图")


def dataset_rules(cases: DataFrame, categories: tuple[str, ...] = CASE_CATEGORIES, intents: tuple[str, ...] = CASE_INTENTS, visual: tuple[str, ...] = VISUAL_TERMS) -> DataFrame:
    """(line, id, severity, issue, detail) of cases (line, id, question,
    category, intent_type, expected_pages, expected_sections,
    acceptable_sections, must_contain_terms, evidence of section and quote) that break a rule. A repeated
    id counts from its second line on, a repeated question once for all its lines (id null)."""
    blank = lambda c: T.strip(F.coalesce(c, F.lit(""))) == ""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    first = cases.groupBy(F.col("id").alias("__id")).agg(F.min("line").alias("__first"))
    c = cases.join(first, F.col("id").eqNullSafe(F.col("__id")), "left")

    def rule(test: Column, severity: str, issue: str, detail: Column | None = None) -> Column:
        return F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(issue).alias("issue"), (F.lit(None).cast("string") if detail is None else detail).alias("detail")))

    seen = T.contained(F.array(*map(F.lit, visual)), F.coalesce("question", F.lit("")))
    found = [
        rule(F.col("line") > F.col("__first"), "error", "duplicate_id"), rule(~F.coalesce(F.col("id").rlike(CASE_ID), F.lit(False)), "error", "bad_id"),
        rule(blank(F.col("question")), "error", "empty_question"), rule(blank(F.col("category")) | blank(F.col("intent_type")), "error", "empty_category_or_intent"),
        rule(~F.coalesce(F.col("category").isin(*categories), F.lit(False)), "error", "unknown_category", F.col("category")), rule(~F.coalesce(F.col("intent_type").isin(*intents), F.lit(False)), "error", "unknown_intent", F.col("intent_type")),
        rule(~some(F.col("evidence")), "error", "missing_evidence"), rule(F.coalesce(F.exists("evidence", lambda e: blank(e["quote"])), F.lit(False)), "error", "empty_quote"),
        rule(~(some(F.col("expected_pages")) | some(F.col("expected_sections")) | some(F.col("acceptable_sections")) | some(F.col("must_contain_terms")) | some(F.col("evidence"))), "error", "no_anchor"),
        rule(F.coalesce(F.exists("evidence", lambda e: F.coalesce(e["section"], F.lit("")) == ""), F.lit(False)), "warning", "section_missing"), rule(F.size(seen) > 0, "warning", "visual_question", F.array_join(seen, ",")),
    ]
    each = c.select("line", "id", F.explode(F.array_compact(F.array(*found))).alias("x")).select("line", "id", "x.*")
    asked = cases.select("line", T.strip(F.coalesce("question", F.lit(""))).alias("q")).groupBy("q").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return each.unionByName(asked.select("line", F.lit(None).cast("string").alias("id"), F.lit("error").alias("severity"), F.lit("duplicate_question").alias("issue"), F.col("q").alias("detail")))


def length_stats(chunks: DataFrame) -> DataFrame:
    size = F.length("text")
    return chunks.agg(F.coalesce(F.min(size), F.lit(0)).alias("min_length"), F.coalesce(F.max(size), F.lit(0)).alias("max_length"), F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_length"))


def distribution(chunks: DataFrame, field: str) -> DataFrame:
    return chunks.groupBy(T.or_unknown(F.col(field)).alias(field)).agg(F.count(F.lit(1)).alias("chunks"))
