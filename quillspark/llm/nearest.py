"""Approximate nearest neighbours by largest inner product, on robust-pruned
directed graphs.

Vectors with all components the same are one node, which holds the
`copies` least ids (more can't be among the nearest, as ties go to the smaller
id); so a third of all rows may be one vector. Nodes are dealt by hash to
shards within a band (dimension, and power of two of the greatest component, so
that a few very long vectors don't flatten the distances of the others).
A band has a shard for each SHARD_LEAST nodes up to SHARDS shards, and more
only beyond SHARD_MOST nodes in each, which bounds the memory of the task that
builds one. A graph is built for each shard (see `vamana`), and the index is
a table: a row for each node with its edges.

A query visits every shard of its dimension by beam search and brings back its
nearest of each, scored in double precision on the original vectors; the best of all
shards are its result. The queries of a shard come in blocks of QUERY_BLOCK.
With Q queries, n vectors and S shards the work is about Q * S * log(n / S), so
it is linear in Q as long as S stays SHARDS, up to 8 million vectors of a band; beyond that
S grows with n and each query costs more.

All vectors are indexed; nothing is fitted on a sample. The search is
approximate; tests hold its recall against brute force.

Defined cases: vectors that are null, empty, all zero or hold null or
non-finite components, and rows without an id, take no part; rows that agree
in id and vector are one; a query's own id is no candidate; queries that share
an id but not the vector have results of their own; a query meets vectors of
its dimension only, and has fewer results if there are fewer candidates; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, vamana

SHARDS, SHARD_LEAST, SHARD_MOST = 16, 256, 500_000
QUERY_BLOCK = 20_000
SHARD = ["dim", "band", "shard"]
INDEX = "dim int, band int, shard int, node int, ids array<long>, vec array<double>, edges array<int>, seed boolean"


def takes_part(vec: Column) -> Column:
    """Whether a vector can be compared."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def cleaned(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(id, vec, print, dim, band) of the rows that take part; print tells vectors apart."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & takes_part(F.col("vec")))
    greatest = F.array_max(F.transform("vec", F.abs))
    return rows.select("id", "vec", F.struct(F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(1), "vec").alias("b")).alias("print"), F.size("vec").alias("dim"), F.floor(F.log2(greatest)).cast("int").alias("band"))


def nodes(rows: DataFrame, copies: int) -> DataFrame:
    """(dim, band, shard, ids, vec): a row for each vector with its least ids."""
    # a vector that many rows share is one row for each task before the shuffle
    vectors = rows.groupBy("print").agg(F.first("vec").alias("vec"), F.first("dim").alias("dim"), F.first("band").alias("band"))
    ids = common.first_rows(rows.select("print", "id").distinct(), "print", ["id"], copies)
    ids = ids.groupBy("print").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    found = common.written(vectors.join(ids, "print"), "nodes")
    sizes = found.groupBy("dim", "band").agg(F.count(F.lit(1)).alias("n"))
    shards = F.greatest(F.least(F.ceil(F.col("n") / SHARD_LEAST), F.lit(SHARDS)), F.ceil(F.col("n") / SHARD_MOST))
    sizes = common.small_side(common.written(sizes.select("dim", "band", shards.cast("long").alias("shards")), "bands"))
    return found.join(sizes, ["dim", "band"]).select("dim", "band", F.pmod(F.xxhash64(F.lit(2), "print"), "shards").cast("int").alias("shard"), "ids", "vec")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a column of lists of equal length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def indexed(vectors: DataFrame, degree: int = vamana.DEGREE, beam: int = vamana.BEAM, alpha: float = vamana.ALPHA) -> DataFrame:
    """The index of the rows of `nodes`: INDEX."""

    def graph(table: pa.Table) -> pa.Table:
        scale = 2.0 ** -float(table.column("band")[0].as_py())
        _, edges, seeds = vamana.build(_matrix(table.column("vec")) * scale, degree, beam, alpha)
        n, flags = table.num_rows, np.zeros(table.num_rows, bool)
        flags[seeds] = True
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * degree + 1, degree), pa.int32()), pa.array(edges.reshape(-1).astype(np.int32)))
        own = table.select(SHARD).append_column("node", pa.array(np.arange(n), pa.int32()))
        return own.append_column("ids", table.column("ids")).append_column("vec", table.column("vec")).append_column("edges", lists).append_column("seed", pa.array(flags))

    return vectors.groupBy(*SHARD).applyInArrow(graph, INDEX)


def searched(index: DataFrame, queries: DataFrame, k: int = 20, beam: int = vamana.BEAM) -> DataFrame:
    """(id, print, other, score): for each query (id, print, vec, dim) up to k
    nearest of each shard."""

    def nearest(graph: pa.Table, asked: pa.Table) -> pa.Table:
        if not graph.num_rows or not asked.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("other", pa.int64()), ("score", pa.float64()))})
        graph = graph.sort_by("node")
        own, mine = _matrix(graph.column("vec")), _matrix(asked.column("vec"))
        x = vamana.lifted(own * 2.0 ** -float(graph.column("band")[0].as_py()))
        # a query's length changes no order; it is brought near 1 for single precision
        q = mine / np.abs(mine).max(1, keepdims=True)
        q = np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)
        seeds = np.flatnonzero(graph.column("seed").to_numpy(zero_copy_only=False))
        found, _ = vamana.walk(x, _matrix(graph.column("edges")).astype(np.int64), seeds, q, max(beam, k + 1))
        row, place = np.nonzero(found >= 0)
        node = found[row, place]
        score = (own[node] * mine[row]).sum(1)
        ids = graph.column("ids").combine_chunks()
        first = ids.offsets.to_numpy().astype(np.int64)
        many, flat = np.diff(first), ids.values.to_numpy()
        # each hit stands for all ids of its vector
        times = many[node]
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row, score, other = np.repeat(row, times), np.repeat(score, times), flat[np.repeat(first[:-1][node], times) + inner]
        asker = asked.column("id").to_numpy()
        keep = other != asker[row]
        row, score, other = row[keep], score[keep], other[keep]
        order = np.lexsort((other, -score, row))
        row, score, other = row[order], score[order], other[order]
        begin = np.searchsorted(row, np.arange(len(mine)))
        keep = np.arange(len(row)) - begin[row] < k
        row, score, other = row[keep], score[keep], other[keep]
        return pa.table({"id": asker[row], "a": asked.column("a").to_numpy()[row], "b": asked.column("b").to_numpy()[row], "other": other, "score": score})

    blocks = 1 + queries.count() // QUERY_BLOCK
    shards = common.small_side(common.written(index.where("node = 0").select(*SHARD), "shards"))
    asked = queries.select("dim", "id", F.col("print.a").alias("a"), F.col("print.b").alias("b"), "vec", F.pmod(F.xxhash64("id", "print"), F.lit(blocks)).alias("block")).join(shards, "dim")
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    by = [*SHARD, "block"]
    return held.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(nearest, "id long, a long, b long, other long, score double")


def nearest_neighbours(df: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vec: str = "embedding", beam: int = vamana.BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by `every`."""
    rows = cleaned(df, key, vec)
    index = common.written(indexed(nodes(rows, k + 1)), "graphs")
    queries = rows.where(F.col("id") % every == 0).dropDuplicates(["id", "print"])
    best = searched(index, queries, k, beam)
    best = best.withColumn("query", F.struct("id", "a", "b"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "other"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("other").alias("vec_id"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(common.table(spark, sf_dir, "embeddings"))
