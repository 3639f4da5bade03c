"""Provenance, recalibration, reviews, inspection, reranker adapters, reports."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import curation, rerankers, select
from quillspark.sources import writers


def test_answer_cases(spark):
    rows = [("ok", "r1", "condition", False, ["e"], ""), ("gone", None, "condition", False, ["e"], None), ("shut", "r2", "condition", False, ["e"], ""), ("neg", "r1", "insufficient_evidence", None, ["e", "f"], f"x {curation.REVIEW_MARKER}"), ("fine", "r1", "insufficient_evidence", True, [], "")]
    cases = spark.createDataFrame(rows, "case_id string, source_case_id string, answer_type string, allow_insufficient_answer boolean, evidence_ids array<string>, notes string")
    retrieval = spark.createDataFrame([("r1", None), ("r2", True)], "id string, excluded boolean")
    got = {(r.case_id, r.issue_type, r.expected, r.actual) for r in curation.answer_case_issues(cases, retrieval).collect()}
    assert got == {("gone", "source_case_not_found", "non-empty source_case_id", None), ("shut", "source_case_excluded", "active retrieval case", "r2"), ("neg", "hard_negative_not_allowed_insufficient", "true", "false"), ("neg", "hard_negative_has_evidence", "[]", "e,f")}
    row = curation.answer_semantics(cases).first()
    assert (row.outstanding, row.issues, row.valid) == (["neg"], ["outstanding_answer_contract_review"], False)
    row = curation.answer_semantics(cases.where("case_id = 'ok'"), rubric=("other",), version="").first()
    assert row.issues == ["missing_semantics_version", "human_review_rubric_schema_mismatch"]
    assert curation.answer_semantics(cases.where("false")).first().valid


def test_reviews_must_match_the_answers(spark):
    scores = ", ".join(f"{s} int" for s in curation.RUBRIC)
    reviews = spark.createDataFrame([("a", 2, 2, 2, 2, 2, False, False), ("b", 0, 2, 2, 2, 2, False, False)], f"case_id string, {scores}, unsupported_claim boolean, critical_safety_omission boolean")
    answered = spark.createDataFrame([("a", "x"), ("b", "y")], "case_id string, answer string")
    got = {r.case_id: (r.answer, r.full_pass, r.severe_failure) for r in curation.adjudicated(answered, reviews).collect()}
    assert got == {"a": ("x", True, False), "b": ("y", False, True)}
    for few, all_ in ((answered.limit(1), reviews), (answered, reviews.limit(1))):
        with pytest.raises(Exception, match="differ in case"):
            curation.adjudicated(few, all_).collect()


def test_recalibration(spark):
    cases = spark.createDataFrame([("a", [("c1", 1, "a  quote", "k")]), ("b", [("c2", 1, "lost", "k")]), ("m", [("c3", 1, "q", "k")])], "id string, evidence array<struct<chunk_id:string,page:int,quote:string,note:string>>")
    found = "case_id string, requires_manual_review boolean, found array<array<struct<chunk_id:string,page:int,text:string>>>"
    audit = spark.createDataFrame([("a", False, [[("n1", 7, "with a quote in it")]]), ("b", False, [[("n2", 8, "other")]]), ("m", True, [[]])], found)
    got = {r.id: (*r.evidence[0], r.updated) for r in curation.recalibrated(cases, audit).collect()}
    assert got == {"a": ("n1", 7, "a  quote", "k", True), "b": ("n2", 8, "other", "k", True), "m": ("c3", 1, "q", "k", False)}
    for bad, said in (([("a", False, [])], "changed after the audit"), ([("a", False, [[]])], "not one candidate"), ([("z", False, [])], "no audit record")):
        with pytest.raises(Exception, match=said):
            curation.recalibrated(cases.limit(1), spark.createDataFrame(bad, found)).collect()


def test_pages_and_inspection(spark):
    c = spark.createDataFrame([("g", 1, 5), ("g", 2, 5), ("h", 3, 9), ("h", None, 9), ("n", 4, None)], "g string, page int, expected_page int")
    assert sorted((r.g, r.page or 0) for r in curation.on_expected_page(c.withColumn("expected_page", F.when(F.col("g") == "g", 2).otherwise(F.col("expected_page"))), ["g"]).collect()) == [("g", 2), ("h", 0), ("h", 3), ("n", 4)]
    rows = [("a", 3, 0, "s1", "apple pear", False), ("b", None, 1, None, "apple", False), ("c", 1, 2, "s2", "apple pear", False), ("d", 1, 1, "s1", "plum", True)]
    t = spark.createDataFrame(rows, "chunk_id string, page int, chunk_index int, section string, text string, is_toc boolean").withColumn("is_noise", F.lit(False))
    ids = lambda **k: [r.chunk_id for r in curation.inspected(t, **k).collect()]
    assert ids() == ["c", "a", "b"] and ids(show_filtered=True) == ["d", "c", "a", "b"] and ids(page=3) == ["a"] and ids(pages=(1, 2)) == ["c"] and ids(section="s1") == ["a"]
    assert ids(tokens=F.array(F.lit("apple"), F.lit("pear"), F.lit(""))) == ["c", "a", "b"] and ids(tokens=F.array(F.lit("pear")), limit=1) == ["c"]


def test_rerankers(spark):
    assert rerankers.float_scores([1, [0.5]], 2) == [1.0, 0.5]
    for bad in ([[1, 2]], [1, 2]):
        with pytest.raises(ValueError):
            rerankers.float_scores(bad, 1)
    assert rerankers.resolved_device("cpu", lambda d: True) == "cpu" and rerankers.resolved_device("auto", lambda d: d == "mps") == "mps" and rerankers.resolved_device("auto", lambda d: False) == "cpu"
    assert rerankers.chosen_reranker(False) is None and rerankers.chosen_reranker(True) is select.lexical_score
    d = spark.createDataFrame([("q", "long text"), ("q", "t"), (None, None)], "question string, text string")
    score = rerankers.chosen_reranker(True, lambda: lambda pairs: [[len(t)] for _, t in pairs])
    assert sorted(r.s for r in d.select(score("question", "text").alias("s")).collect()) == [0.0, 1.0, 9.0]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", {"mrr": 0.5}), ("b", {"hit": 1.0, "mrr": 0.25})], "case_id string, metrics map<string,double>")
    writers.write_report(rows, f"{tmp_path}/r.csv")
    got = spark.read.option("header", True).csv(f"{tmp_path}/r.csv")
    assert got.columns == ["case_id", "hit", "mrr"] and {(r.case_id, r.hit, r.mrr) for r in got.collect()} == {("a", None, "0.5"), ("b", "1.0", "0.25")}
    writers.write_pair(writers.widened(rows), rows.groupBy().count(), f"{tmp_path}/r.md", f"{tmp_path}/r.json", "T")
    assert spark.read.json(f"{tmp_path}/r.json").count() == 2 and "# T" in [r.value for r in spark.read.text(f"{tmp_path}/r.md").collect()]
