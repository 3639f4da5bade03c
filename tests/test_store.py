"""Sources and sinks: errors, and round trips against DuckDB."""

import json
from dataclasses import replace

import duckdb
import pytest

from quillspark.functions import lexicon
from quillspark.plans import catalog, engine, store_queries  # noqa: F401  (it registers queries)
from quillspark.plans.config import EngineConfig
from quillspark.sources import readers, writers

SF = "/root/testdata/sf0.001"
ROUND_TRIPS = ("store_upsert", "store_rebuild", "bm25_index_stored", "flat_chunks", "eval_cases_read", "eval_cases_by_category", "answer_cases_read", "raw_lines_read", "report_csv", "report_json")


@pytest.mark.parametrize("name", ROUND_TRIPS)
def test_round_trip(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want))


def test_upsert_refuses_repeated_keys(spark, tmp_path):
    twice = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "chunk_id string, n int")
    with pytest.raises(ValueError, match="repeated chunk_id: a"):
        writers.upsert(twice, f"{tmp_path}/t")
    assert writers.latest(spark, f"{tmp_path}/t") is None


def test_upsert_of_an_empty_table(spark, tmp_path):
    some, none = spark.createDataFrame([("a", 1)], "chunk_id string, n int"), spark.createDataFrame([], "chunk_id string, n int")
    writers.upsert(some, f"{tmp_path}/t")
    writers.upsert(none, f"{tmp_path}/t")
    assert writers.read_table(spark, f"{tmp_path}/t").collect() == some.collect()


def test_raw_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{ "n":1,  "id": "x"}\n\n{"id":"y", "é": [1, 2]}\n')
    assert sorted(map(tuple, readers.raw_lines(spark, f"{tmp_path}/a.jsonl").collect())) == [("x", '{ "n":1,  "id": "x"}'), ("y", '{"id":"y", "é": [1, 2]}')]
    (tmp_path / "b.jsonl").write_text("{not json\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        readers.raw_lines(spark, f"{tmp_path}/b.jsonl").collect()


def test_json_report_is_an_object(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n {"summary": {"n": 2}}')
    (tmp_path / "b.json").write_text('[{"n": 2}]')
    assert readers.json_report(spark, f"{tmp_path}/a.json").select("summary.n").first()[0] == 2
    with pytest.raises(ValueError, match="JSON object"):
        readers.json_report(spark, f"{tmp_path}/b.json")


def test_files_without_structure_are_cut_each_for_itself(spark):
    plain = "plain words of no manual at all. " * 60
    text = "用车前准备\n使用安全带\n请按以下步骤系好安全带：插入锁舌，拉紧肩部安全带。"
    lex = replace(lexicon.ZH_MANUAL, sections=("使用安全带",))
    rows = [("a", "manual", 20, text), ("b", "plain", 1, plain), ("c", None, 1, plain)]
    config = EngineConfig(lexicon=lex)
    got = engine.chunked(spark.createDataFrame(rows, "doc_id string, source_file string, page int, text string"), config).collect()
    assert {r.section for r in got if r.source_file == "manual"} == {"使用安全带"}
    alone = engine.chunked(spark.createDataFrame(rows[1:2], "doc_id string, source_file string, page int, text string"), config).collect()
    key = lambda r: (r.chunk_index, r.text, r.page, r.source_pages, r.section, r.content_type)
    assert len(alone) > 1
    assert sorted(key(r) for r in got if r.source_file == "plain") == sorted(map(key, alone))
    assert sorted(key(r) for r in got if r.source_file is None) == sorted(map(key, alone))


def test_reviews(spark, tmp_path):
    scores = {"groundedness": 2, "correctness": 1, "completeness": 0, "condition_handling": 2, "safety_preservation": 2}

    def put(name, *records):
        (tmp_path / name).write_text(json.dumps({"records": list(records)}, indent=1))
        return f"{tmp_path}/{name}"

    a, b = {"case_id": "a", **scores, "failure_labels": ["x"]}, {"case_id": "b", **scores}
    assert sorted((r.case_id, r.correctness, r.failure_labels) for r in readers.reviews(spark, put("a.json", a, b)).collect()) == [("a", 1, ["x"]), ("b", 1, None)]
    for name, bad, said in (("b.json", {**b, "correctness": 3}, "out of range: b"), ("c.json", {"case_id": "b"}, "out of range: b"), ("d.json", a, "repeated case_id: a")):
        with pytest.raises(ValueError, match=said):
            readers.reviews(spark, put(name, a, bad))
