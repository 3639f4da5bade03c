"""Content de-duplication of chunks and of ranked hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LEAST_LENGTH = 30


def by_content(hits: DataFrame, within: list[str], least_length: int = LEAST_LENGTH) -> DataFrame:
    """Keep one hit of each normalised text (of each chunk_id, where the text
    is short): that with a section, a chapter, the higher score, the longer
    text, more metadata, and then the earlier one. It takes the first
    position of its group; then chunk ids are made distinct.

    `hits` has chunk_id, text, section, chapter, score, n_meta and pos.
    Groups are of equal texts within a query, so they are small; for tables
    without a query (`within` empty) use `distinct_texts`, which aggregates
    before it shuffles.
    """
    body = T.dedup_key(F.col("text"))
    h = hits.withColumn("__key", F.when(F.length(body) < least_length, F.concat(F.lit("chunk:"), "chunk_id")).otherwise(F.concat(F.lit("text:"), body)))
    group = Window.partitionBy(*within, "__key")
    best = group.orderBy((F.coalesce("section", F.lit("")) != "").desc(), (F.coalesce("chapter", F.lit("")) != "").desc(), F.coalesce("score", F.lit(0.0)).desc(), F.length("text").desc(), F.desc("n_meta"), "pos")
    h = h.withColumns({"__n": F.row_number().over(best), "__first": F.min("pos").over(group)}).where("__n = 1")
    ids = Window.partitionBy(*within, "chunk_id").orderBy("__first")
    return h.withColumn("pos", F.col("__first")).withColumn("__n", F.row_number().over(ids)).where("__n = 1").drop("__key", "__n", "__first")


def distinct_texts(chunks: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """The first chunk_id of each normalised text, with the group's size;
    partial aggregation keeps hot texts out of one task."""
    body = T.dedup_key(F.col("text"))
    key = F.when(F.length(body) < least_length, F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string"))).otherwise(F.concat(F.lit("text:"), body))
    return chunks.select(F.sha2(key, 256).alias("k"), "chunk_id").groupBy("k").agg(F.min("chunk_id").alias("chunk_id"), F.count(F.lit(1)).alias("copies")).select("chunk_id", "copies")


def contexts(hits: DataFrame, within: list[str]) -> DataFrame:
    """Greedy by score: drop a hit whose chunk_id or context key came before.

    A hit is dropped only for a hit that stays; as a dropped hit can only
    share its id or text with earlier ones, the greedy answer is found by an
    ordered fold over each query's (few) hits."""
    rank = F.coalesce("selection_score", "score", F.lit(-999.0))
    rows = hits.groupBy(*within).agg(F.array_sort(F.collect_list(F.struct((-rank).alias("o"), F.col("pos").alias("p"), F.col("chunk_id").alias("i"), T.context_key(F.col("text")).alias("t")))).alias("x"))
    none = F.array().cast("array<struct<o:double,p:bigint,i:string,t:string>>")
    kept = F.aggregate("x", none, lambda acc, h: F.when(F.exists(acc, lambda e: (e["i"] == h["i"].cast("string")) | ((e["t"] == h["t"]) & (h["t"] != ""))), acc).otherwise(F.concat(acc, F.array(F.struct(h["o"].cast("double").alias("o"), h["p"].cast("bigint").alias("p"), h["i"].cast("string").alias("i"), h["t"].alias("t"))))))
    return rows.select(*within, F.posexplode(kept).alias("n", "h")).select(*within, F.col("h.i").alias("chunk_id"), (F.col("n") + 1).alias("pos"))
