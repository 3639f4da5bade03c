"""Hybrid retrieval: reciprocal-rank fusion of two ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
MODES = ("dense", "bm25", "hybrid")


def rrf(dense: DataFrame, bm25: DataFrame, k: int = RRF_K, top: int | None = None) -> DataFrame:
    """Fuse (query_id, chunk_id, pos, score[, distance]) lists by the sum of
    1 / (k + pos). One grouping on (query_id, chunk_id) is both the full
    outer merge and the sum; ties keep the dense list first."""
    tagged = dense.select("query_id", "chunk_id", "pos", "score", (F.col("distance") if "distance" in dense.columns else F.lit(None).cast("double")).alias("distance"), F.lit("dense").alias("source"))
    tagged = tagged.unionByName(bm25.select("query_id", "chunk_id", "pos", "score", F.lit(None).cast("double").alias("distance"), F.lit("bm25").alias("source")))

    def of(source: str, column: str):
        return F.max(F.when(F.col("source") == source, F.col(column)))

    fused = tagged.groupBy("query_id", "chunk_id").agg(
        F.sum(1 / (F.lit(k) + F.col("pos"))).alias("rrf_score"),
        of("dense", "pos").alias("dense_rank"), of("dense", "score").alias("dense_score"), of("dense", "distance").alias("distance"),
        of("bm25", "pos").alias("bm25_rank"), of("bm25", "score").alias("bm25_score"),
    )
    source = F.when(F.col("bm25_rank").isNull(), "dense").when(F.col("dense_rank").isNull(), "bm25").otherwise("hybrid")
    by = Window.partitionBy("query_id").orderBy(F.round("rrf_score", 12).desc(), F.col("dense_rank").asc_nulls_last(), "bm25_rank", "chunk_id")
    out = fused.withColumns({"retrieval_source": source, "pos": F.row_number().over(by)})
    return out.where(F.col("pos") <= top) if top else out


def checked_mode(mode: str | None, default: str = "hybrid") -> str:
    mode = (mode or default).lower()
    if mode not in MODES:
        raise ValueError(f"retrieval mode must be one of {', '.join(MODES)}, not {mode!r}")
    return mode
