"""Registered round trips: a table goes through a sink and its source, the SQL
takes the same rows from the table itself."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bm25
from ..sources import readers, scratch, writers
from ..sources.segments import SegmentedStore
from . import queries as q
from .catalog import ORACLES, query


def _folder(spark: SparkSession, tag: str) -> str:
    """A new name in the folder that driver and executors share."""
    return f"{scratch.shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@query("store_upsert", "SELECT doc_id AS chunk_id, md5(coalesce(text, '') || CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN ' (revised)' ELSE '' END) AS text_md5 FROM documents")
def store_upsert(spark, sf):
    """All documents, then the labelled ones once more with another text."""
    chunks, path = q.chunk_table(spark, sf).select("chunk_id", F.coalesce("text", F.lit("")).alias("text")), _folder(spark, "store")
    writers.upsert(chunks, path)
    labelled = q.table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"))
    writers.upsert(chunks.join(labelled, "chunk_id", "left_semi").withColumn("text", F.concat("text", F.lit(" (revised)"))), path)
    return writers.read_table(spark, path).select("chunk_id", F.md5("text").alias("text_md5"))


@query("store_rebuild", "SELECT doc_id AS chunk_id FROM labels")
def store_rebuild(spark, sf):
    """All documents, then a rebuild with the labelled ones alone."""
    chunks, path = q.chunk_table(spark, sf).select("chunk_id"), _folder(spark, "store")
    writers.upsert(chunks, path)
    writers.upsert(q.table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id")), path, rebuild=True)
    return writers.read_table(spark, path)


@query("bm25_index_stored", ORACLES["bm25_index_stats"])
def bm25_index_stored(spark, sf):
    """The written index: df counted from its postings, idf from its terms."""
    path = _folder(spark, "bm25")
    writers.write_bm25(bm25.build(q.chunk_table(spark, sf), lambda df: scratch.written(df, "index")), path)
    index = writers.read_bm25(spark, path)
    counted = index.postings.groupBy("term").agg(F.count("*").alias("df"))
    return counted.join(index.terms.select("term", "idf"), "term").select("term", "df", F.round("idf", 6).alias("idf"))


@query("flat_chunks", "SELECT doc_id AS chunk_id, CASE WHEN doc_id // 10 > 0 THEN doc_id // 10 END AS page, nullif(lang, '') AS chapter, nullif(source, '') AS section, concat_ws('|', nullif(lang, ''), nullif(source, '')) AS heading_path, (doc_id // 10) || '|' || (doc_id // 10 + 1) AS source_pages FROM documents")
def flat_chunks(spark, sf):
    """Chunks with lists and nulls through a store of scalars."""
    none, path = F.lit(None).cast("string"), _folder(spark, "flat")
    chunks = q.chunk_table(spark, sf).withColumns({"content_type": none, "risk_level": none, "heading_path": F.array_compact(F.array("chapter", "section")), "source_pages": F.array(F.col("page"), F.col("page") + 1)})
    writers.flat(chunks).write.parquet(path)
    back = writers.nested(spark.read.parquet(path))
    return back.select("chunk_id", F.col("page").cast("long").alias("page"), "chapter", "section", F.array_join("heading_path", "|").alias("heading_path"), F.array_join(F.col("source_pages").cast("array<string>"), "|").alias("source_pages"))


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    """`benchmark` as cases: every second one has an empty quote, the others
    have no evidence, every third no terms and every fifth is excluded."""
    i = F.col("item_id")
    evidence = F.array(F.struct(i.cast("int").alias("page"), F.lit("").alias("quote")))
    return q.table(spark, sf, "benchmark").select(
        i.cast("string").alias("id"), F.col("text").alias("question"), F.concat(F.lit("c"), (i % 4).cast("string")).alias("category"), F.concat(F.lit("s"), (i % 2).cast("string")).alias("split"),
        F.when(i % 2 == 0, evidence).alias("evidence"), F.when(i % 3 != 0, F.array(F.lit("term"))).alias("must_contain_terms"), F.when(i % 5 == 0, True).alias("excluded"),
    )


@query("eval_cases_read", "SELECT item_id::VARCHAR AS id, text AS question, item_id % 5 = 0 AS excluded, item_id % 2 <> 0 AS no_evidence, item_id % 2 = 0 AS blank_quote, item_id % 2 <> 0 AND item_id % 3 = 0 AS no_anchor FROM benchmark")
def eval_cases_read(spark, sf):
    path = _folder(spark, "cases")
    _cases(spark, sf).write.json(path)
    return readers.eval_cases(spark, path, include_excluded=True).select("id", "question", "excluded", "no_evidence", "blank_quote", "no_anchor")


@query("eval_cases_by_category", "SELECT item_id % 4 AS category, item_id::VARCHAR AS id FROM benchmark WHERE item_id % 5 <> 0")
def eval_cases_by_category(spark, sf):
    """The filters of the reader, asked for each category: all active cases."""
    path = _folder(spark, "cases")
    _cases(spark, sf).write.json(path)
    some = [readers.eval_cases(spark, path, category=f"c{c}").select(F.lit(c).cast("long").alias("category"), "id") for c in range(4)]
    return some[0].unionByName(some[1]).unionByName(some[2]).unionByName(some[3])


@query("answer_cases_read", "SELECT item_id::VARCHAR AS id, text AS question, CASE WHEN item_id % 3 <> 0 THEN 1 ELSE 0 END::BIGINT AS terms, CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS evidence FROM benchmark")
def answer_cases_read(spark, sf):
    path = _folder(spark, "cases")
    _cases(spark, sf).withColumnRenamed("must_contain_terms", "must_include_terms").write.json(path)
    return readers.answer_cases(spark, path, split=None).select("id", "question", F.size("must_include_terms").cast("long").alias("terms"), F.size("evidence").cast("long").alias("evidence"))


@query("raw_lines_read", """SELECT doc_id::VARCHAR AS id, md5('{ "n": ' || coalesce(n_chars, 0) || ',  "id": "' || doc_id || '" }') AS raw_md5 FROM documents""")
def raw_lines_read(spark, sf):
    """Lines of a dataset stay as they were written, spaces and order too."""
    path, d = _folder(spark, "lines"), q.table(spark, sf, "documents")
    d.select(F.concat(F.lit('{ "n": '), F.coalesce("n_chars", F.lit(0)).cast("string"), F.lit(',  "id": "'), F.col("doc_id").cast("string"), F.lit('" }')).alias("value")).write.text(path)
    return readers.raw_lines(spark, path).select("id", F.md5("raw").alias("raw_md5"))


def _report(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's own metrics: all have a length, some a page."""
    i = F.col("doc_id")
    length, page = F.struct(F.lit("n_chars").alias("key"), F.col("n_chars").cast("long").alias("value")), F.struct(F.lit("page").alias("key"), F.expr("doc_id div 10").alias("value"))
    return q.table(spark, sf, "documents").select(i.alias("case_id"), F.map_from_entries(F.when(i % 2 == 0, F.array(length, page)).otherwise(F.array(length))).alias("metrics"))


_REPORT_SQL = "SELECT doc_id AS case_id, n_chars, CASE WHEN doc_id % 2 = 0 THEN doc_id // 10 END AS page FROM documents"


@query("report_csv", _REPORT_SQL)
def report_csv(spark, sf):
    """A report's CSV has a column for each metric that any row has."""
    path = _folder(spark, "report") + ".csv"
    writers.write_report(_report(spark, sf), path)
    names = spark.read.option("header", True).csv(path).columns
    back = spark.read.option("header", True).schema(", ".join(f"`{c}` long" for c in names)).csv(path)
    return back.select("case_id", "n_chars", "page")


@query("report_json", _REPORT_SQL)
def report_json(spark, sf):
    path = _folder(spark, "report") + ".json"
    writers.write_report(_report(spark, sf), path)
    back = spark.read.schema("case_id long, metrics map<string, long>").json(path)
    return back.select("case_id", F.col("metrics")["n_chars"].alias("n_chars"), F.col("metrics")["page"].alias("page"))


_REVISED = "SELECT doc_id AS chunk_id, coalesce(text, '') || CASE WHEN source IN ('src3', 'src7') THEN ' again revised' ELSE '' END AS text FROM documents"


def _segmented(spark, sf):
    """All documents by source, then two sources once more with other texts."""
    d = q.table(spark, sf, "documents")
    chunks = d.select(F.col("doc_id").alias("chunk_id"), F.coalesce("source", F.lit("")).alias("source_file"), F.col("doc_id").alias("chunk_index"), F.coalesce("text", F.lit("")).alias("text"))
    store = SegmentedStore(spark, _folder(spark, "segments")).ingest(chunks)
    return store.ingest(chunks.where("source_file IN ('src3', 'src7')").withColumn("text", F.concat("text", F.lit(" again revised"))))


@query("segmented_chunks", f"SELECT chunk_id, md5(text) AS text_md5 FROM ({_REVISED})")
def segmented_chunks(spark, sf):
    return _segmented(spark, sf).chunks().select("chunk_id", F.md5("text").alias("text_md5"))


@query("segmented_index", f"WITH chunks AS ({_REVISED}), {q.INDEX} SELECT term, df, round(idf, 6) AS idf FROM idfs")
def segmented_index(spark, sf):
    """The statistics of a base, a delta and its tombstones, summed up."""
    return _segmented(spark, sf).index().terms.select("term", F.col("df").cast("long").alias("df"), F.round("idf", 6).alias("idf"))


@query("segmented_source", "SELECT doc_id AS chunk_id FROM documents WHERE source = 'src7'")
def segmented_source(spark, sf):
    """One source's chunks, by its bucket."""
    return _segmented(spark, sf).chunks(["src7"]).select("chunk_id")
