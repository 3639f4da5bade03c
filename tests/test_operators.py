"""Operators on small hand-made cases."""

import uuid

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import tokens as K
from quillspark.functions.lexicon import LATIN_GENERIC, ZH_MANUAL
from quillspark.operators import answers, bm25, dedup, dense, evaluation, fusion, hygiene, metrics, select, split, structure
from quillspark.plans import catalog, engine
from quillspark.plans import queries as _queries  # noqa: F401
from quillspark.plans.config import EngineConfig
from quillspark.sources import readers, writers

ZH = ZH_MANUAL.__class__(**{**ZH_MANUAL.__dict__, "sections": ("安全带", "儿童锁", "涉水驾驶")})


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw", ["a\r\nb\rc", "  x\t\ty \n\n\n\n z　", "", "　全　"])
def test_clean_text(spark, raw):
    import re

    t = raw.replace("\r\n", "\n").replace("\r", "\n")
    t = re.sub(r"\n{3,}", "\n\n", re.sub(r"\n[ \t]+", "\n", re.sub(r"[ \t]+", " ", t))).strip()
    assert one(spark, T.clean_text(F.col("t")), t=raw) == t


def test_uuid_lines_and_keys(spark):
    assert one(spark, T.uuid5(F.col("t")), t="demo.pdf:3") == str(uuid.uuid5(uuid.NAMESPACE_URL, "demo.pdf:3"))
    for t in ("a\nb\n", "", "\n", "x\x0by\x85z w", " p \r\n q"):
        assert one(spark, T.lines(F.col("t")), t=t) == [x.strip() for x in t.splitlines()]
    assert one(spark, T.dedup_key(F.col("t")), t="12 ■ 甲（１）乙，3. 丙 7") == "甲乙丙"
    assert one(spark, T.context_key(F.col("t")), t="■ 甲（1）乙，3.丙") == "甲乙，丙"


@pytest.mark.parametrize(("a", "b", "same"), [("10 cm", "10厘米", True), ("ＡＢＳ", "abs", True), ("10 cm", "30 cm", False), ("10 cm", "10 m", False), ("Straße！", "strasse", True)])
def test_answer_key(spark, a, b, same):
    assert (one(spark, T.answer_key(F.col("t")), t=a) == one(spark, T.answer_key(F.col("t")), t=b)) is same
    assert one(spark, T.answer_key(F.col("t")), t=a) == T.folded(a)


def test_tokens(spark):
    assert one(spark, K.bm25_tokens(F.col("t")), t="EPB 安，全 a+b") == ["epb", "a+b", "安", "全", "安全"]
    got = one(spark, K.query_tokens(K.bm25_tokens(F.col("t")), ZH), t="如何使用安全带")
    assert "如何" not in got and "使用" not in got and "安全带" in got
    assert one(spark, K.query_tokens(K.bm25_tokens(F.col("t")), ZH), t="如何") == ["如", "何", "如何"]
    assert "安全带" in one(spark, K.coverage_terms(K.query_tokens(K.bm25_tokens(F.col("t")), ZH), ZH), t="如何使用安全带")
    assert one(spark, K.keywords(F.col("t"), ZH), t="如何使用儿童锁ABS") == ["儿童锁", "ABS"]
    assert one(spark, K.keywords(F.col("t"), ZH), t="涉水驾驶 提示") == ["涉水驾驶", "提示", "涉水", "水驾", "驾驶"]


def pages(spark, *rows):
    return spark.createDataFrame([(f"d{p}", "m.pdf", p, t) for p, t in rows], "doc_id string, source_file string, page int, text string")


def blocks_of(spark, *rows):
    b = structure.blocks(structure.classified_lines(pages(spark, *rows), ZH), ZH)
    return sorted(b.collect(), key=lambda r: r.block_index)


def test_sections_and_page_numbers(spark):
    b = blocks_of(spark, (20, "安全带\n请系好安全带后再起步。\n图示说明文字。\n儿童锁\n后排有儿童时应使用儿童锁。"))
    assert [(x.section, x.content_type) for x in b] == [("安全带", "normal"), ("儿童锁", "normal")]
    assert b[0].text == "请系好安全带后再起步。\n图示说明文字。" and b[0].heading_path == ["安全带"]
    b = blocks_of(spark, (10, "安全带"), (11, "11\n正文内容一共不少字。"))
    assert len(b) == 1 and (b[0].start_page, b[0].section, b[0].subsection) == (11, "安全带", None)
    b = blocks_of(spark, (20, "安全带\n使用方法说明\n正文第一句。"), (21, "21\n正文第二句。"))
    assert (b[-1].start_page, b[-1].end_page, b[-1].source_pages) == (20, 21, [20, 21]) and "21" not in b[-1].text


def test_markers_cross_pages(spark):
    b = blocks_of(spark, (30, "前文已经足够长。\n警告！"), (31, "可能造成人身伤害。"))
    assert [(x.content_type, x.start_page, x.end_page, x.risk_level) for x in b] == [("normal", 30, 30, "low"), ("warning", 30, 31, "high")]
    b = blocks_of(spark, (40, "警告！"), (41, "安全带\n正文内容一共不少字。"))
    assert len(b) == 1 and b[0].section == "安全带"  # a lone marker is too short for a block
    b = blocks_of(spark, (50, "警告！\n注意！\n说明！\n内容在这里。"))
    assert [x.text for x in b] == ["警告！\n注意！", "说明！\n内容在这里。"]


def test_types_and_split(spark):
    for t, kind, risk in (("警告灯亮起表示故障", "normal", "medium"), ("警告！\n■ 不要触摸", "warning", "high"), ("注意！\n■ 小心", "caution", "medium"), ("1 打开车门\n2 关闭车门", "procedure", "low"), ("请关闭车窗", "normal", "low")):
        assert one(spark, structure.content_type(F.col("t"), ZH), t=t) == kind
        assert one(spark, structure.risk_level(F.col("t"), F.lit(kind), ZH), t=t) == risk
    long = "。".join(f"第{i}句话的内容" for i in range(200))
    p = pages(spark, (1, long), (2, ""), (3, "短"))
    got = split.fixed(p, 100, 20).orderBy("page", "chunk_index").collect()
    assert {r.page for r in got} == {1, 3} and all(len(r.text) <= 100 for r in got) and got[-1].chunk_id == str(uuid.uuid5(uuid.NAMESPACE_URL, "d3:0"))
    assert all(r.text.endswith("。") for r in got[:-2])
    assert len(split.pieces_of("x" * 100 + "\n1. y" * 50, 50, 45, split.STRUCTURE_SHARE, (("。",),), True)) < 400  # goes on whatever the overlap
    with pytest.raises(ValueError):
        split.fixed(p, 10, 10)
    b = structure.blocks(structure.classified_lines(p, ZH), ZH)
    c = split.structured(b, ZH, 120, 20).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in c] == list(range(len(c))) and all(r.split_strategy == "manual_structure" for r in c)


def test_hygiene(spark):
    rows = [("a", "甲甲.......12\n乙乙.......13\n丙丙.......14", None, None), ("b", "目录\n甲甲....3", "目录", None), ("c", "注意事项", "前言", None), ("d", "警告！触电可致人身伤害", "前言", None), ("e", " ", None, None), ("f", "01 甲\n02 乙\n03 丙", "x", "y"), ("g", "普通的正文内容，足够长，没有任何问题，可以放心保留下来。", "x", "y")]
    c = spark.createDataFrame(rows, "chunk_id string, text string, chapter string, section string")
    got = {r.chunk_id: r.filter_reason for r in hygiene.flagged(c, ZH).collect()}
    assert got == {"a": "toc_dotted_fragment", "b": "toc_heading", "c": "generic_preface_notice", "d": "", "e": "empty_text", "f": "figure_legend_only", "g": ""}


def test_bm25_floor_and_fusion(spark):
    docs = spark.createDataFrame([(1, "apple pear"), (2, "apple"), (3, "apple plum plum")], "chunk_id long, text string").withColumns({"is_toc": F.lit(False), "is_noise": F.lit(False)})
    index = bm25.build(docs)
    idf = {r.term: r.idf for r in index.terms.collect()}
    import math

    raw = {t: math.log(3 - d + 0.5) - math.log(d + 0.5) for t, d in (("apple", 3), ("pear", 1), ("plum", 1))}
    assert abs(idf["apple"] - 0.25 * sum(raw.values()) / 3) < 1e-9
    q = spark.createDataFrame([(0, "plum plum pear")], "query_id long, question string")
    hits = bm25.search(index, docs, q, LATIN_GENERIC, 5).orderBy("pos").collect()
    assert [h.chunk_id for h in hits] == [3, 1] and hits[0].score == 1.0
    d = spark.createDataFrame([(0, 7, 1, 0.9), (0, 8, 2, 0.8)], "query_id long, chunk_id long, pos int, score double")
    s = spark.createDataFrame([(0, 9, 1, 1.0), (0, 8, 2, 0.5)], "query_id long, chunk_id long, pos int, score double")
    assert [(r.chunk_id, r.retrieval_source) for r in fusion.rrf(d, s).orderBy("pos").collect()] == [(8, "hybrid"), (7, "dense"), (9, "bm25")]
    with pytest.raises(ValueError):
        fusion.checked_mode("other")


def test_dense_blocks_and_lsh(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    v = rng.standard_normal((300, 16))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "chunk_id long, embedding array<float>")
    q = df.where("chunk_id < 7").withColumnRenamed("chunk_id", "query_id")
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    best = np.argsort(-(n[:7] @ n.T), axis=1)[:, :5]
    for block in (4096, 3):
        monkeypatch.setattr(dense, "BLOCK", block)
        got = {(r.query_id, r.chunk_id) for r in dense.search(df, q, 5).collect()}
        assert got == {(i, int(c)) for i in range(7) for c in best[i]}
    near = {(r.query_id, r.chunk_id) for r in dense.lsh_search(df, q, 5, tables=40, planes=3).collect()}
    assert len(near & got) >= 0.9 * len(got)


def test_content_dedup(spark):
    long = "这是一段足够长的正文内容，用来测试按内容去重的规则是否正确，超过三十个字符。"
    rows = [(0, 1, "a", long, None, None, 0.9, 1), (0, 2, "b", "（1）" + long, "节", "章", 0.1, 1), (0, 3, "c", "短", "s", "c", 0.5, 1), (0, 4, "d", "短", "s", "c", 0.5, 1), (0, 5, "c", "短", "s", "c", 0.9, 1)]
    h = spark.createDataFrame(rows, "query_id long, pos long, chunk_id string, text string, section string, chapter string, score double, n_meta int")
    got = [(r.pos, r.chunk_id, r.score) for r in dedup.by_content(h, ["query_id"]).orderBy("pos").collect()]
    assert got == [(1, "b", 0.1), (3, "c", 0.9), (4, "d", 0.5)]
    kept = dedup.contexts(h.withColumn("selection_score", F.col("score")), ["query_id"]).orderBy("pos").collect()
    assert [r.chunk_id for r in kept] == ["a", "c"]


def hits_of(spark, *texts):
    return spark.createDataFrame([(0, i, f"c{i}", t, "q") for i, t in enumerate(texts, 1)], "query_id long, pos long, chunk_id string, text string, question string").withColumns({c: F.lit(None).cast("string") for c in ("chapter", "section", "subsection", "content_type", "risk_level")}).withColumns({"page": F.lit(1), "score": F.lit(1.0), "source_file": F.lit("m")})


def test_budgets(spark):
    h = hits_of(spark, "aaaa", "b" * 17, "c" * 13, "dd")
    ids = lambda df: [r.chunk_id for r in df.orderBy("pos").collect()]
    assert ids(answers.evidence(h, 2, 6000)) == ["c1", "c2"] and ids(answers.evidence(h, 5, 6)) == ["c1"] and ids(answers.evidence(h, 5, 0)) == []
    e = answers.evidence(hits_of(spark, "x" * 50, "y"), 5, 20).collect()
    assert len(e) == 1 and e[0].truncated and e[0].content == "x" * 8 + "\n[TRUNCATED]" and e[0].original_text_chars == 50
    assert answers.evidence(hits_of(spark, "x" * 50), 5, 4).first().content == "[TRU"
    assert ids(select.within_chars(h, 3)) == ["c1"] and ids(select.final_contexts(h, 3, 25)) == ["c1", "c2"] and ids(select.final_contexts(h, 0, 9)) == []


@pytest.mark.parametrize(("raw", "clean"), [("根据[Evidence E1]，请检查", "请检查"), ("请检查（证据E2）。", "请检查。"), ("见 evidence id E3 中的说明", "见 的说明"), ("资料 2：请系安全带", "请系安全带"), ("因此根据手册操作", "因此根据手册操作"), ("event E12 happened", "event E12 happened")])
def test_references(spark, raw, clean):
    assert one(spark, answers.without_references(F.col("t")), t=raw) == clean
    assert one(spark, answers.leaks_reference(F.col("t")), t=raw) is (raw != clean)
    assert one(spark, answers.without_references(F.col("t")), t=clean) == clean


def test_quotes(spark):
    rows = [("如何使用安全带", "开头的话没有关系。请系好安全带并检查锁扣。结尾。"), ("无关", "长" * 300), ("x", "  "), (None, None)]
    d = spark.createDataFrame(rows, "question string, text string").withColumn("i", F.monotonically_increasing_id())
    got = [r.quote for r in answers.quoted(d, ZH, 40).orderBy("i").collect()]
    assert "安全带" in got[0] and 0 < len(got[1]) <= 40 and got[2:] == ["", ""]
    assert {r.quote for r in answers.quoted(d, ZH, 0).collect()} == {""}
    # the heart, then the list items after it, then nothing that is too long
    steps = "如何更换机油？请打开机油盖并检查。■ 放出旧机油。■ 加入新机油。" + "其他内容" * 40 + "。"
    one_row = spark.createDataFrame([("如何更换机油", steps)], "question string, text string")
    assert answers.quoted(one_row, ZH).first().quote.startswith("如何更换机油？")


@pytest.mark.parametrize(("text", "expected"), [("aaaaaa\n1. bbbb", ["aaaaaa", "1. bbbb"]), ("aaaaaaa。bbbbbb", ["aaaaaaa。", "bbbbbb"]), ("aaaaaa\n\n■ bbbb", ["aaaaaa", "■ bbbb"]), ("aaaaaaaaaaaa", ["aaaaaaaaaa", "aa"]), ("a。bbbbbbbbbbb", ["a。bbbbbbbb", "bbb"]), ("", []), (None, [])])
def test_cuts(text, expected):
    assert split.pieces_of(text, 10, 0, split.STRUCTURE_SHARE, (("。",), ("\n",)), True) == expected


def test_neighbours(spark):
    c = spark.createDataFrame([(i, "m", i, "c", "s" if i < 3 else "t", i, "text") for i in range(6)], "chunk_id long, source_file string, chunk_index long, chapter string, section string, page int, text string")
    got = select.neighbours(c.select(F.lit(0).alias("query_id"), "chunk_id"), c, 2).select("anchor_id", "chunk_id").collect()
    assert sorted(map(tuple, got)) == [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5)]


def test_metrics_and_movements(spark):
    cases = spark.createDataFrame([("a", ["g1", "g2"], [], [1], ["s"], [], ["warning"], ["x", "y"]), ("b", [], ["a quote of words"], [], [], [], [], [])], "case_id string, gold_ids array<string>, quotes array<string>, expected_pages array<int>, expected_sections array<string>, acceptable_sections array<string>, expected_content_types array<string>, must_contain_terms array<string>")
    rows = [("a", "m", 1, "w", "x here", 1, "s1", "warning"), ("a", "m", 2, "g2", "y here", 2, "t", "normal"), ("b", "m", 1, "z", "no", 1, None, None), ("b", "m", 2, "u", "with a  quote of\nwords", 1, None, None)]
    h = spark.createDataFrame(rows, "case_id string, mode string, pos int, chunk_id string, text string, page int, section string, content_type string").withColumns({"source_file": F.lit("m"), "is_toc": F.lit(False), "is_noise": F.lit(False)})
    m = {r.case_id: r for r in metrics.by_case(h, cases).collect()}
    a, b = m["a"], m["b"]
    assert (a["evidence_hit@1"], a["evidence_hit@3"], a["first_evidence_hit_rank"], a["mrr"]) == (False, True, 2, 0.5)
    assert (a["page_hit@1"], a["expected_section_hit@1"], a["term_coverage_ratio@1"], a["all_terms_hit@3"]) == (True, True, 0.5, True)
    assert b["page_hit@1"] is None and b["term_coverage_ratio@5"] is None and b["first_evidence_hit_rank"] == 2
    base = spark.createDataFrame([("1", 3), ("2", 1), ("3", 2), ("4", 5)], "case_id string, rank int")
    exp = spark.createDataFrame([("1", 1), ("2", 3), ("3", 2), ("4", None)], "case_id string, rank int")
    s = evaluation.movement_summary(evaluation.movements(base, exp)).first()
    assert (s.improved, s.regressed, s.unchanged, s.newly_top1, s.lost_top1, s.hit5_regressions) == (1, 2, 1, 1, 1, 1)
    with pytest.raises(Exception, match="one report only"):
        evaluation.movements(base, exp.limit(1)).collect()


def test_store_and_answers(spark, tmp_path):
    (tmp_path / "m.txt").write_text("安全带\n使用安全带\n请按以下步骤系好安全带：插入锁舌，拉紧肩部安全带。\f儿童锁\n后排有儿童时请启用儿童锁，防止车门被打开。\f涉水驾驶\n警告！\n涉水深度不得超过规定，否则车辆损坏。")
    p = readers.read_pages(spark, f"{tmp_path}/m.txt")
    assert p.count() == 3 and p.orderBy("page").first().doc_id == str(uuid.uuid5(uuid.NAMESPACE_URL, "m.txt:1"))
    store = engine.ingest(p, f"{tmp_path}/store", EngineConfig(lexicon=ZH))
    n = store.chunks.count()
    assert n >= 3 and store.vectors.count() == n
    flags = store.chunks.select("is_toc", "is_noise", "filter_reason").collect()
    assert store.counts["chunks"] == len(flags) and store.counts["removed_toc"] == sum(r.is_toc for r in flags) and store.counts["kept"] == sum(not (r.is_toc or r.is_noise) for r in flags)
    assert {k: v for k, v in store.counts.items() if k in hygiene.REASONS and v} == {k: n for k in {r.filter_reason for r in flags} - {""} for n in [sum(r.filter_reason == k for r in flags)]}
    again = engine.ingest(p, f"{tmp_path}/store", EngineConfig(lexicon=ZH), rebuild=False)
    assert again.chunks.count() == n
    q = spark.createDataFrame([(1, "如何使用安全带"), (2, "zzzz")], "query_id long, question string")
    done, cited, chosen = engine.answer(again, q, EngineConfig(lexicon=ZH, mode="bm25"))
    got = {r.query_id: r for r in done.collect()}
    assert "安全带" in got[1].final_answer and got[2].final_answer == answers.NO_ANSWER and got[2].n_evidence == 0
    assert cited.where("query_id = 1").count() == chosen.where("query_id = 1").count() == got[1].n_evidence
    flat = writers.flat(again.chunks)
    assert dict(flat.dtypes)["heading_path"] == "string" and writers.nested(flat).select("heading_path").collect() == again.chunks.select("heading_path").collect()
    assert writers.report_format("a.csv") == "csv" and writers.report_format("a") == "md"
    assert writers.markdown(q, "T").count("\n|") >= 3


def test_readers(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"id":"a","question":"q","category":"warning","evidence":[]}\n{"id":"b","question":"q","excluded":true}\n')
    assert [r.id for r in readers.eval_cases(spark, f"{tmp_path}/e.jsonl").collect()] == ["a"]
    (tmp_path / "bad.jsonl").write_text('{"id":')
    with pytest.raises(Exception):  # noqa: B017
        readers.eval_cases(spark, f"{tmp_path}/bad.jsonl").collect()
    (tmp_path / "d.jsonl").write_text('{"id":"a","split":"dev"}\n{"id":"a","split":"test"}\n')
    with pytest.raises(ValueError, match="repeated"):
        readers.answer_cases(spark, f"{tmp_path}/d.jsonl")


def test_entry_without_training_data():
    import __spark_entry__ as e

    names = set(e.queries())
    assert set(catalog.QUERIES) <= names and set(e.oracle_sql()) <= names
