"""A look-up by source starts no Python rows to find its buckets."""

import tempfile

from quillspark.sources.segments import SegmentedStore

SCHEMA = "chunk_id long, source_file string, chunk_index long, text string"


def test_buckets_without_python_rows(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/store"
    store = SegmentedStore(spark, path).ingest(spark.createDataFrame([(i, f"f{i % 3}", i, "a b") for i in range(9)], SCHEMA))

    def refused(*_, **__):
        raise AssertionError("rows are made in Python")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    assert sorted(r[0] for r in store.chunks(["f1", "f2", "none"]).select("chunk_id").collect()) == [1, 2, 4, 5, 7, 8]
    assert store.chunks([]).count() == 0
