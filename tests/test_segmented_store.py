"""The segmented store against an index built anew."""

import tempfile

import pytest
from pyspark.sql import functions as F

from quillspark.functions.lexicon import LATIN_GENERIC
from quillspark.operators import bm25
from quillspark.sources.segments import SegmentedStore

SCHEMA = "chunk_id string, source_file string, chunk_index int, text string, is_toc boolean, is_noise boolean"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def file(name, n, turn=0):
    return [(f"{name}-{turn}-{i}", name, i, " ".join(WORDS[(i * k + turn + len(name)) % 10] for k in range(1, 5 + i % 4)) if i else "", False, False) for i in range(n)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_ingest_replace_and_compact(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/store"
    make = lambda *files: spark.createDataFrame([r for f in files for r in f], SCHEMA)
    store = SegmentedStore(spark, path).ingest(make(file("a", 30), file("b", 30), file("c", 30)))
    first = store.rows_written()
    store = store.ingest(make(file("b", 4, 1), file("dd", 3)))
    second = store.rows_written()
    assert second["chunks"] == 7 and second["postings"] < first["postings"] / 4 and second["stats"] <= 2 * 12
    store = store.ingest(make(file("b", 6, 2)))
    live = make(file("a", 30), file("b", 6, 2), file("c", 30), file("dd", 3))
    for s in (store, store.compact()):
        whole, index = bm25.build(live), s.index()
        assert rows_of(s.chunks().select(*live.columns)) == rows_of(live)
        assert rows_of(index.postings.select("term", "chunk_id", "tf", "dl")) == rows_of(whole.postings.select("term", "chunk_id", "tf", "dl"))
        assert rows_of(index.terms.select("term", "df", F.round("idf", 9))) == rows_of(whole.terms.select("term", "df", F.round("idf", 9)))
        assert rows_of(index.docs) == rows_of(whole.docs) and rows_of(index.corpus) == rows_of(whole.corpus)
        q = spark.createDataFrame([(0, "alpha kappa"), (1, "zeta")], "query_id long, question string")
        assert rows_of(bm25.search(index, live, q, LATIN_GENERIC, 5).select("query_id", "chunk_id", "pos")) == rows_of(bm25.search(whole, live, q, LATIN_GENERIC, 5).select("query_id", "chunk_id", "pos"))
    assert [n for _, n in SegmentedStore(spark, path).live] == ["base=00000003"]


def test_chunks_without_index_and_failed_ingest(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/store"
    df = spark.createDataFrame(file("a", 10), SCHEMA)
    store = SegmentedStore(spark, path).ingest(df, F.col("chunk_index") < 5)
    assert store.chunks().count() == 10 and store.index().corpus.first().n == 5
    df.write.parquet(f"{path}/delta=00000001/chunks")  # an ingest that did not end
    again = SegmentedStore(spark, path)
    assert again.chunks().count() == 10 and again.next == 2 and again.compact().index().corpus.first().n == 5
    with pytest.raises(ValueError):
        again.ingest(df.union(df))


def test_one_source_reads_its_bucket(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/store"
    store = SegmentedStore(spark, path).ingest(spark.createDataFrame([r for i in range(40) for r in file(f"f{i}", 2)], SCHEMA))
    one = store.chunks(["f7"])
    assert rows_of(one.select("chunk_id")) == [("f7-0-0",), ("f7-0-1",)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert one.select(F.input_file_name()).distinct().count() == 1
