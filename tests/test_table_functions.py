"""Splitter and parser from SQL, against their DataFrame forms."""

import pytest
from test_segments import SCHEMA, ZH, as_rows, manual

from quillspark.functions import table_functions
from quillspark.operators import segments, split, structure


def test_from_sql(spark):
    table_functions.register(spark)
    pages = spark.createDataFrame(manual(3), SCHEMA)
    lines = structure.classified_lines(pages, ZH)
    segments.marked(lines, ZH).createOrReplaceTempView("zh_lines")
    found = structure.finished(spark.sql("SELECT * FROM manual_blocks(TABLE(zh_lines))"), ZH)
    assert as_rows(found) == as_rows(structure.blocks(lines, ZH))
    pages.createOrReplaceTempView("zh_pages")
    sql = spark.sql("SELECT doc_id, page, p.chunk_index, p.piece FROM zh_pages, LATERAL fixed_pieces(text, 20, 5) p")
    assert sorted(map(tuple, sql.collect())) == sorted((r.doc_id, r.page, r.chunk_index, r.text) for r in split.fixed(pages, 20, 5).collect())
    for wrong in ("SELECT p.* FROM zh_pages, LATERAL fixed_pieces(text, 5, 5) p", "SELECT * FROM manual_blocks(TABLE(zh_pages))"):
        with pytest.raises(Exception, match="overlap|classified lines"):
            spark.sql(wrong).collect()
