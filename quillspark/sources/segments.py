"""A chunk store and sparse index in segments that are never changed.

An ingest writes one segment with the chunks of the files it was given, their
postings, and their statistics (number of chunks, tokens, and the document
frequency of each term). For files that older segments hold, it also writes
tombstones of their old chunks, and the statistics of these with a
minus sign. Everything that is written is in proportion to what was given.

A reader takes the newest base and the segments after it as one index: postings
and chunks less the tombstones of later segments, statistics summed up. Sums are
all that is needed, as idf and average length are functions of them. `compact` writes
what is live as a new base. A segment counts once its last table is complete.

Chunks lie in BUCKETS folders by source file and sorted by source and chunk
index, so a look-up by source reads one folder of each segment.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bm25
from . import scratch
from .readers import unique

BUCKETS = 64


def bucket_of(source: Column) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(BUCKETS)).cast("int")


class SegmentedStore:
    """The store under a path; made anew to see what others have added."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []
        whole = [n for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/stats/_SUCCESS"))]
        numbers = {int(n.split("=")[1]): n for n in whole if n.startswith(("base=", "delta="))}
        base = max((k for k, n in numbers.items() if n.startswith("base=")), default=-1)
        self.live = [(k, numbers[k]) for k in sorted(numbers) if k >= base]
        self.deletes = {n for _, n in self.live if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/dead"))}
        self.next = 1 + max((int(n.split("=")[1]) for n in names if "=" in n), default=-1)

    # ------------------------------------------------------------ writing

    def ingest(self, chunks: DataFrame, indexed: Column | None = None) -> SegmentedStore:
        """Add chunks (chunk_id, source_file, chunk_index, text, ...), whole
        files; chunks that the store has of these files are replaced. Those without
        `indexed` are stored but not in the sparse index."""
        chunks = scratch.written(unique(chunks, "chunk_id"), "ingested")
        dead = None
        if self.live:
            files = chunks.select(F.col("source_file").alias("__s")).distinct()
            old = self._located("chunks", ["bucket", "source_file", "chunk_id"])
            dead = scratch.written(old.join(files.withColumn("__b", bucket_of(F.col("__s"))), (F.col("bucket") == F.col("__b")) & F.col("source_file").eqNullSafe(F.col("__s")), "left_semi").select("chunk_id", "segment"), "dead")
        return self._write("delta", chunks, indexed, dead)

    def compact(self) -> SegmentedStore:
        """Write what is live as one base; older segments are left for readers that have them open."""
        kept = self.postings().select("chunk_id").distinct().withColumnRenamed("chunk_id", "__i")
        chunks = scratch.written(self.chunks().join(kept, F.col("chunk_id") == F.col("__i"), "left").withColumn("__indexed", F.col("__i").isNotNull()).drop("__i"), "live")
        return self._write("base", chunks.drop("__indexed"), None, None, chunks.where("__indexed").select("chunk_id", "text"))

    def _write(self, kind: str, chunks: DataFrame, indexed: Column | None, dead: DataFrame | None, given: DataFrame | None = None) -> SegmentedStore:
        at = f"{self.path}/{kind}={self.next:08d}"
        chunks.withColumn("bucket", bucket_of(F.col("source_file"))).repartition("bucket").sortWithinPartitions("bucket", "source_file", "chunk_index").write.partitionBy("bucket").parquet(f"{at}/chunks")
        some = given if given is not None else (chunks if indexed is None else chunks.where(indexed)).select("chunk_id", "text")
        bm25.postings_of(some).sortWithinPartitions("term").write.parquet(f"{at}/postings")
        new = self.spark.read.parquet(f"{at}/postings")
        stats = bm25.counted(new)
        if dead is not None:
            dead.write.parquet(f"{at}/dead")
            gone = self._located("postings", ["term", "chunk_id", "dl", "tf"]).join(dead, ["chunk_id", "segment"], "left_semi")
            stats = stats.unionByName(bm25.counted(gone).select("term", *((-F.col(c)).alias(c) for c in ("df", "tokens", "chunks"))))
        stats.write.parquet(f"{at}/stats")
        return SegmentedStore(self.spark, self.path)

    # ------------------------------------------------------------ reading

    def _all(self, table: str) -> DataFrame:
        out = None
        for k, name in self.live:
            if table == "dead" and name not in self.deletes:
                continue
            part = self.spark.read.parquet(f"{self.path}/{name}/{table}").withColumn("in_segment", F.lit(k))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def _located(self, table: str, columns: list[str]) -> DataFrame:
        """Live rows with the number of their segment."""
        rows = self._all(table).withColumnRenamed("in_segment", "segment").select(*columns, "segment")
        dead = self._all("dead")
        return rows if dead is None else rows.join(dead.select("chunk_id", "segment"), ["chunk_id", "segment"], "left_anti")

    def chunks(self, sources: list[str] | None = None) -> DataFrame:
        """The live chunks, of all or of some source files; then only their buckets are read."""
        columns = [c for c in self._all("chunks").columns if c not in ("in_segment", "bucket")]
        out = self._located("chunks", [*columns, "bucket"])
        if sources is not None:
            # the buckets as values, so that folders are pruned before any is listed
            named = F.array(*map(F.lit, sources)).cast("array<string>")
            asked = self.spark.range(1).select(F.transform(named, bucket_of).alias("b")).first()["b"]
            out = out.where(F.col("bucket").isin(asked) & F.col("source_file").isin(list(sources)))
        return out.select(*columns)

    def postings(self) -> DataFrame:
        return self._located("postings", ["term", "chunk_id", "dl", "tf"]).drop("segment")

    def index(self) -> bm25.Bm25Index:
        """The sparse index of all live segments."""
        return bm25.from_counts(self.postings(), self._all("stats").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("df", "tokens", "chunks"))))

    def rows_written(self) -> dict[str, int]:
        """Rows of each table of the newest segment."""
        at = f"{self.path}/{self.live[-1][1]}"
        return {PurePosixPath(t).name: self.spark.read.parquet(f"{at}/{t}").count() for t in ("chunks", "postings", "stats")}
