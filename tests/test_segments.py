"""The reader by ranges and as a stream, against the reader by windows."""

import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from quillspark.functions.lexicon import ZH_MANUAL
from quillspark.operators import segments, structure

ZH = ZH_MANUAL.__class__(**{**ZH_MANUAL.__dict__, "sections": ("安全带", "儿童锁", "涉水驾驶")})
SCHEMA = "doc_id string, source_file string, page int, text string, last boolean"
CHOICES = ["前言", "空调", "安全带", "儿童锁", "EPB AUTO功能", "警告！", "注意！", "说明！", "警告 小心触电", "正文第一句话在这里。", "短", "■ 检查轮胎", "", "12", "1 打开车门", "2 关闭车门", "plain latin text"]


def manual(seed, sources=3, pages=40):
    rng, rows = random.Random(seed), []
    for s in range(sources):
        chapter = "前言"
        for p in range(1, pages + 1):
            lines = [chapter] if rng.random() < 0.4 else []
            for _ in range(rng.randrange(0, 7)):
                lines.append(rng.choice(CHOICES))
                if lines[-1] in ("前言", "空调"):
                    chapter = lines[-1]
            rows.append((f"d{s}", f"m{s}.pdf", p, "\n".join(lines), p == pages))
    return rows


def as_rows(df):
    return sorted((tuple(str(r[c]) for c in sorted(structure_columns)) for r in df.collect()))


structure_columns = ["source_file", "doc_id", "block_index", "block_id", "text", "chapter", "section", "subsection", "heading_path", "start_page", "end_page", "source_pages", "content_type", "risk_level", "has_warning", "is_procedure"]


def test_functions_compose_as_lines_are_read():
    rng = random.Random(1)
    kinds = [("chapter", "a"), ("chapter", "b"), ("section", "s"), ("section", "t"), ("subsection", "u"), ("body", ""), ("mark", ""), ("bare", "")]
    token = {"body": "x", "mark": "m", "bare": "b"}
    for _ in range(300):
        lines = [rng.choice(kinds[: rng.randrange(1, 9)]) for _ in range(rng.randrange(0, 14))]
        reader = segments.Reader()
        for k, h in lines:
            reader.read(k, h, token.get(k, "x"))
        fs = [segments.of_line(k, h, token.get(k, "x")) for k, h in lines] or [segments.IDENTITY]
        while len(fs) > 1:  # in any bracketing
            i = rng.randrange(len(fs) - 1)
            fs[i : i + 2] = [segments.composed(fs[i], fs[i + 1])]
        after = segments.Reader.after(fs[0])
        assert (after.headings, after.state, after.opened) == (reader.headings, reader.state, reader.opened)


@pytest.mark.parametrize("fan", [2, 256])
def test_ranges_give_the_same_blocks(spark, monkeypatch, fan):
    monkeypatch.setattr(segments, "FAN", fan)
    lines = structure.classified_lines(spark.createDataFrame(manual(5), SCHEMA), ZH).cache()
    whole = structure.blocks(lines, ZH)
    cuts = sorted(random.Random(fan).sample(range(1, 41), 9))
    number = sum(((F.col("page") >= c).cast("int") for c in cuts), F.lit(0))
    assert as_rows(segments.segmented_blocks(lines, ZH, number)) == as_rows(whole)
    assert as_rows(segments.segmented_blocks(lines, ZH)) == as_rows(whole)
    assert segments.segmented_blocks(lines.where("false"), ZH).count() == 0


def test_no_window_runs_over_a_source(spark):
    lines = structure.classified_lines(spark.createDataFrame(manual(5), SCHEMA), ZH)
    plan = segments.segmented_blocks(lines, ZH)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(source_file" in plan and all("seg#" in w.split("ROWS")[0].split("ASC")[0] for w in plan.split("windowspecdefinition(source_file")[1:])


def test_ranges_are_no_python_groups(spark):
    """A table of many one-page sources costs no call for each of them."""
    pages = [(f"d{i}", f"m{i}", 1, "警告！\n正文第一句话在这里。", True) for i in range(300)]
    lines = structure.classified_lines(spark.createDataFrame(pages, SCHEMA), ZH)
    found = segments.segmented_blocks(lines, ZH)
    assert "InPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 300


@pytest.fixture
def states(spark):
    before = spark.conf.get(segments.PROVIDER[0])
    spark.conf.set(*segments.PROVIDER)
    yield
    spark.conf.set(segments.PROVIDER[0], before)


def run(spark, root, out, lex=ZH, **options):
    pages = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    q = segments.stream_blocks(pages, lex, **options).writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", out).trigger(availableNow=True).start()
    q.awaitTermination(100)
    assert q.exception() is None and not q.isActive


def test_stream_with_restart(spark, states):
    root = tempfile.mkdtemp(prefix="spark-")
    rows = manual(8, sources=2, pages=12)
    put = lambda part: spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
    put([r for r in rows if r[2] <= 4])
    run(spark, root, f"{root}/out", last="last")
    put([r for r in rows if 4 < r[2] <= 7])
    put([r for r in rows if r[2] > 7] + [("d0", "m0.pdf", 2, "警告！\n来得太晚的一页正文。", False)])  # a late page
    run(spark, root, f"{root}/out", last="last")
    got = spark.read.parquet(f"{root}/out")
    whole = structure.blocks(structure.classified_lines(spark.createDataFrame(rows, SCHEMA), ZH), ZH)
    assert as_rows(got) == as_rows(whole)
    assert {r.source_file: r.m for r in got.groupBy("source_file").agg(F.max("late_lines").alias("m")).collect()} == {"m0.pdf": 2, "m1.pdf": 0}


def test_stream_timer_closes_the_last_block(spark, states):
    root = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([("d", "m.pdf", 1, "安全带\n请系好安全带后再起步。", False)], SCHEMA).coalesce(1).write.parquet(f"{root}/in")
    found = segments.stream_blocks(spark.readStream.schema(SCHEMA).parquet(f"{root}/in"), ZH, idle=1)
    q = found.writeStream.format("memory").queryName("closed").option("checkpointLocation", f"{root}/state").trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while time.time() < until and not spark.table("closed").count():
            time.sleep(1)
        assert [(r.source_file, r.section, r.text) for r in spark.table("closed").collect()] == [("m.pdf", "安全带", "请系好安全带后再起步。")]
    finally:
        q.stop()
