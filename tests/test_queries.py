"""Registered queries on small tables, against the whole job."""

import numpy as np
import pytest

from quillspark.operators import evaluation
from quillspark.plans import catalog, queries

N = 120


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """120 vectors; 14 questions of 20 words, each document holds the end of one."""
    d = str(tmp_path_factory.mktemp("sf"))
    v = np.random.default_rng(1).standard_normal((N, 8))
    spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    items = [(i, " ".join([f"common{j}" for j in range(14)] + [f"late{i}x{j}" for j in range(6)])) for i in range(14)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = [(i, f"some words before late{i % 40}x3 late{i % 40}x4 and after number{i}", "en", f"src{i % 5}", 50) for i in range(N)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


def test_every_dense_query_and_whole_questions(spark, sf):
    got = queries.dense_topk(spark, sf).collect()
    assert {r.query_id for r in got} == {0, 50, 100}
    v = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()])
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 50, 100):
        assert {r.chunk_id for r in got if r.query_id == q} == set(np.argsort(-(n @ n[q]))[:10].tolist())
    fused = queries.rrf_fusion(spark, sf).collect()
    assert {r.query_id for r in fused if r.dense_rank is not None} == set(range(14))
    # only the last words of a question stand in documents
    assert {r.query_id for r in fused if r.bm25_rank is not None} == set(range(14))


def test_lsh_query_recalls_nine_tenths_of_the_real_neighbours(spark):
    sf = "/root/testdata/sf0.1"
    best = {(r.query_id, r.chunk_id) for r in queries.dense_topk(spark, sf).collect()}
    near = {(r.query_id, r.chunk_id) for r in queries.dense_lsh_topk(spark, sf).collect()}
    assert len(best) == 400 and len(near & best) >= 0.9 * len(best)


def test_audit_takes_all_labels(spark):
    import duckdb

    con, sf = duckdb.connect(), "/root/testdata/sf0.01"
    for t in ("labels", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    whole = con.execute(catalog.ORACLES["audit_classify"].replace(" WHERE d.doc_id < 200", "")).fetchall()
    got = [tuple(r) for r in queries.audit_classify(spark, sf).collect()]
    assert len(got) == con.execute("SELECT count(*) FROM labels JOIN documents USING (doc_id)").fetchone()[0]
    assert sorted(got) == sorted(whole)


@pytest.mark.parametrize("size", [4_000_000, 1])
def test_candidates_by_each_method(spark, monkeypatch, size):
    monkeypatch.setattr(evaluation, "NEEDLES", size)
    chunks = [(1, 1, "the quick brown fox jumps over the lazy dog"), (2, 1, "xx quickbrown  fox\njumps yy"), (3, 2, "alpha beta gamma"), (4, 2, "alpha"), (5, 3, "日本語の文章がここにあります。終わり"), (6, 4, None)]
    c = spark.createDataFrame(chunks, "chunk_id long, page int, text string")
    cases = [("id", 0, 1, 1, "fox", []), ("quote", 0, 90, 1, "quick brown fox jumps", []), ("short", 0, 91, 9, "f", []), ("phrase", 0, 92, 9, "not there at all; quick brown fox; brown fox jumps", []), ("wide", 0, 93, 9, "文章がここにあり", []), ("terms", 0, 94, 2, "nowhere to be found", ["alpha", "beta", "delta"]), ("none", 0, 95, 2, None, ["delta"]), ("blank", 0, None, None, " ", [])]
    e = spark.createDataFrame(cases, "case_id string, evidence_no int, chunk_id long, page int, quote string, terms array<string>")
    got = {(r.case_id, r.new_id, r.match_method) for r in evaluation.candidates(e, c).collect()}
    expected = {("id", 1, "existing_chunk_id"), ("quote", 1, "exact_quote"), ("quote", 2, "exact_quote"), ("short", 1, "exact_quote"), ("short", 2, "exact_quote"), ("phrase", 1, "phrase"), ("phrase", 2, "phrase"), ("wide", 5, "exact_quote"), ("terms", 3, "page_terms")}
    assert got == expected
