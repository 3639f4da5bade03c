"""The two pipelines: pages to indexes, and questions to cited answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens as K
from ..operators import answers, bm25, dedup, dense, fusion, hygiene, select, split, structure
from ..sources import scratch, writers
from .config import EngineConfig

SPLIT_COLUMNS = ("chunk_id", "source_file", "chunk_index", "page", "text", "chapter", "section", "subsection", "content_type", "risk_level", "heading_path", "source_pages")
FLAG_COLUMNS = ("n_meta", "is_toc", "is_noise", "filter_reason")


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """An embedding without a model: signed counts of hashed tokens, scaled to
    length one. A real model goes in as an Arrow UDF of the same shape."""
    words = K.bm25_tokens(text)
    slots = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(size)).alias("i"), F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(slots, lambda x: x["i"] == i), F.lit(0.0), lambda a, x: a + x["s"]))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(raw, lambda x: F.when(norm == 0, F.lit(1.0 / size**0.5)).otherwise(x / norm).cast("float"))


def chunked(pages: DataFrame, config: EngineConfig) -> DataFrame:
    """Pages to typed, risk-graded chunks with hygiene flags. Files in which
    no structure is found are cut by fixed windows, each file for itself."""
    lex = config.lexicon
    clean = pages.withColumn("text", T.clean_text(F.col("text")))
    blocks = structure.blocks(structure.classified_lines(clean, lex, config.skip_toc_pages), lex)
    found = scratch.written(split.structured(blocks, lex, config.chunk_size, config.overlap).select(*SPLIT_COLUMNS), "structured")
    known = found.select(F.col("source_file").alias("__known")).distinct()
    rest = clean.join(known, F.col("source_file").eqNullSafe(F.col("__known")), "left_anti")
    empty = {c: F.lit(None).cast("string") for c in ("chapter", "section", "subsection", "content_type", "risk_level")}
    windows = split.fixed(rest, config.chunk_size, config.overlap).withColumns({**empty, "heading_path": F.array().cast("array<string>"), "source_pages": F.array("page")})
    chunks = found.unionByName(windows.select(*SPLIT_COLUMNS)).withColumn("n_meta", F.lit(10))
    return hygiene.flagged(chunks, lex).select(*SPLIT_COLUMNS, *FLAG_COLUMNS)


@dataclass(frozen=True)
class Store:
    chunks: DataFrame
    vectors: DataFrame
    index: bm25.Bm25Index
    #: What the ingest that made it counted, by the way: chunks, and those that hygiene removes by reason.
    counts: dict[str, int] | None = None


def observed(chunks: DataFrame, watch: Observation) -> DataFrame:
    """Flagged chunks that are counted while they are written: all, those
    removed as contents or noise, each reason, and chunks by length of text."""
    reasons = [F.count_if(F.col("filter_reason") == r).alias(r) for r in hygiene.REASONS]
    size = F.length("text")
    return chunks.observe(watch, F.count(F.lit(1)).alias("chunks"), F.count_if("is_toc").alias("removed_toc"), F.count_if(F.col("is_noise") & ~F.col("is_toc")).alias("removed_noise"), F.count_if(~F.col("is_toc") & ~F.col("is_noise")).alias("kept"), *reasons, F.coalesce(F.sum(size), F.lit(0)).alias("characters"), F.coalesce(F.max(size), F.lit(0)).alias("longest"))


def ingest(pages: DataFrame, path: str, config: EngineConfig | None = None, rebuild: bool = True, embed: Callable[[Column], Column] | None = None) -> Store:
    """Write chunks, vectors and the sparse index under `path`. All chunks get
    a vector; only those that pass hygiene are in the sparse index."""
    config = config or EngineConfig()
    spark = pages.sparkSession
    watch = Observation("ingest")
    made = scratch.written(observed(chunked(pages, config), watch), "chunked")
    writers.upsert(made, f"{path}/chunks", rebuild=rebuild)
    chunks = writers.read_table(spark, f"{path}/chunks")
    make = embed or (lambda c: hashed_embedding(c, config.embedding_size))
    writers.upsert(chunks.select("chunk_id", make(F.col("text")).alias("embedding")), f"{path}/vectors", rebuild=True)
    writers.write_bm25(bm25.build(hygiene.kept(chunks)), f"{path}/bm25")
    return replace(open_store(spark, path), counts=watch.get)


def open_store(spark: SparkSession, path: str) -> Store:
    return Store(writers.read_table(spark, f"{path}/chunks"), writers.read_table(spark, f"{path}/vectors"), writers.read_bm25(spark, f"{path}/bm25"))


def retrieve(store: Store, questions: DataFrame, config: EngineConfig | None = None, mode: str | None = None, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Ranked hits of each question (query_id, question) with their chunks."""
    config = config or EngineConfig()
    mode = fusion.checked_mode(mode, config.mode)
    wide = max(config.top_k, 10 if config.select_contexts else 0, config.rerank_pool if config.rerank else 0)
    lists = {}
    ok = hygiene.kept(store.chunks).select("chunk_id")
    if mode != "bm25":
        # vectors are keyed by number for the block search, names come back after
        make = embed or (lambda c: hashed_embedding(c, config.embedding_size))
        named = store.vectors.withColumn("n", F.xxhash64("chunk_id"))
        asked = questions.select(F.xxhash64(F.col("query_id").cast("string")).alias("query_id"), make(F.col("question")).alias("embedding"))
        found = dense.search(named.select(F.col("n").alias("chunk_id"), "embedding"), asked, max(wide, config.dense_candidates))
        found = found.withColumnRenamed("chunk_id", "n").join(named.select("n", "chunk_id"), "n").drop("n").withColumnRenamed("query_id", "q")
        found = found.join(questions.select("query_id", F.xxhash64(F.col("query_id").cast("string")).alias("q")), "q").drop("q")
        lists["dense"] = select._renumbered(found.join(ok, "chunk_id", "left_semi"), "pos")
    if mode != "dense":
        flags = store.chunks.select("chunk_id", "text", "is_toc", "is_noise")
        lists["bm25"] = bm25.search(store.index, flags, questions, config.lexicon, max(wide, config.sparse_candidates)).select("query_id", "chunk_id", "score", "pos")
    if mode == "hybrid":
        hits = fusion.rrf(lists["dense"], lists["bm25"], config.rrf_k, max(wide, 10)).withColumn("score", F.col("rrf_score"))
    else:
        hits = lists[mode].withColumn("retrieval_source", F.lit(mode))
    hits = hits.join(store.chunks, "chunk_id").join(questions.select("query_id", "question"), "query_id")
    return dedup.by_content(hits, ["query_id"]).where(F.col("pos") <= wide)


def explained(store: Store, questions: DataFrame, config: EngineConfig | None = None, embed: Callable[[Column], Column] | None = None) -> dict[str, DataFrame]:
    """A retrieval trace without an answer: the questions' terms, the hits of
    each mode, and the evidence that a prompt would show."""
    config = config or EngineConfig()
    out = {"terms": bm25.question_terms(questions, config.lexicon)}
    out |= {mode: retrieve(store, questions, config, mode, embed) for mode in fusion.MODES}
    limit = min(config.top_k, config.max_contexts)
    hits = select.selected(out[fusion.checked_mode(config.mode)], config.lexicon, max(config.top_k, 5), config.select_contexts, config.selection_base)
    out["evidence"] = answers.evidence(select.final_contexts(hits, limit, config.max_chars), limit, config.max_chars)
    return out


def answer(store: Store, questions: DataFrame, config: EngineConfig | None = None, mode: str | None = None, generate: Callable[[pd.Series], pd.Series] | None = None, embed: Callable[[Column], Column] | None = None, reranker: Callable[[Column, Column], Column] = select.lexical_score) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers, citations and prompt evidence of a batch of questions; one
    lazy plan up to the generator."""
    config = config or EngineConfig()
    lex, limit = config.lexicon, min(config.top_k, config.max_contexts)
    hits = retrieve(store, questions, config, mode, embed)
    hits = select.reranked(hits.where(F.col("pos") <= max(config.top_k, 10)), reranker if config.rerank else None, max(config.top_k, 5) if config.rerank else None)
    hits = select.selected(hits, lex, max(config.top_k, 5), config.select_contexts, config.selection_base)
    if config.expand_neighbours:
        hits = select.expanded(hits, hygiene.kept(store.chunks), config.neighbours_per_chunk)
    hits = dedup.by_content(hits, ["query_id"])
    chosen = answers.evidence(select.final_contexts(hits, limit, config.max_chars), limit, config.max_chars)
    asked = answers.prompts(questions, chosen)
    if generate is None:
        asked = asked.join(answers.extractive(questions, chosen, lex), "query_id", "left")
    else:
        asked = answers.generated(asked, generate)
    return answers.finished(asked), answers.citations(chosen, lex), chosen
