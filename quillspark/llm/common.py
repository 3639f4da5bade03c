"""Helpers shared by the training-data operators: table access, the shared
scratch folder, bounded ranking, and vectorised token hashing over Arrow
buffers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows handed to a Python worker at once; long texts make wide batches.
BATCH_ROWS = 512
#: Rows of ids up to which a side of a join is broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 1_000_000
#: Bytes of text hashed at once by a worker.
CHUNK_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_ROWS rows, as whole texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). One
    is set where none is named, but only if all tasks run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc._jsc.sc().isLocal():
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(f"/tmp/checkpoints/{uuid.uuid4().hex}")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write a table into the shared folder and read it back. As nothing reads
    the write's shuffle files again, Spark deletes them with its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discarded(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables of `written` that nothing reads any more."""
    for df in frames:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame) -> DataFrame:
    """Broadcast a materialised side of a few short columns if its row count
    allows; otherwise leave it to a shuffled join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


class Stepwise:
    """Keeps the table of an iteration as Parquet in the shared folder; each
    step's table replaces the one before, whose files are deleted."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.step = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.step += 1
        df.write.parquet(f"{self.root}/{self.step}")
        if self.step > 1:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{self.step - 1}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.step}")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` has not, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions_for(spark: SparkSession, least: int = 12) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranked(df: DataFrame, within: list[str], order: list[str], spread: list[str], buckets: int, name: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in `name`.

    Groups may hold most of the rows, so each is cut into `buckets` by a
    hash of `spread`; only a bucket is ever sorted in one task, and the
    bucket counts give its starting number.
    """
    df = df.withColumn("__b", F.pmod(F.xxhash64(*spread), F.lit(buckets)))
    key = [*within, "__b"]
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*within).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*key, F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__at"))
    inner = Window.partitionBy(*key).orderBy(*order)
    return (
        df.join(starts, key)
        .withColumn(name, F.col("__at") + F.row_number().over(inner) - 1)
        .drop("__b", "__at")
    )


def first_rows(df: DataFrame, within: str, order: list, n: int, buckets: int = 256) -> DataFrame:
    """The first `n` rows of each group. Groups may hold most of the rows, so
    the first of `buckets` parts of each are found before those of the whole;
    no task sorts more than buckets * n rows of a group."""
    part = Window.partitionBy(within, F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(buckets))).orderBy(*order)
    whole = Window.partitionBy(within).orderBy(*order)
    some = df.withColumn("__r", F.row_number().over(part)).where(F.col("__r") <= n).drop("__r")
    return some.withColumn("__r", F.row_number().over(whole)).where(F.col("__r") <= n)


# ------------------------------------------------------------------ hashing

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_SYMBOL = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: All of ASCII but letters and digits; other characters count as letters.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SYMBOL_LOWER = _SYMBOL[_LOWER]
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_R, _RINV)):
            p = np.full(max(n, CHUNK_BYTES + 4096), base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads hash values over all 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


def word_hashes(raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of every row, with A-Z lower-cased, and the
    number of words of each row. `breaks` marks the bytes between words; by
    default words are `[^\\x20\\x09-\\x0D]+`.

    A word's hash is a polynomial in its bytes, found for all words at once
    from prefix sums; memory is bounded by CHUNK_BYTES (a longer single
    word is taken whole).
    """
    n, hashes, starts_at = len(raw), [], []
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    at = 0
    while at < n:
        to = min(n, at + CHUNK_BYTES)
        while to < n:  # move the end to a break between words
            cut = np.flatnonzero(breaks[raw[at:to]] | edge[at:to])
            if len(cut) and cut[-1] > 0:
                to = at + int(cut[-1])
                break
            to = min(n, to + CHUNK_BYTES)
        part = raw[at:to]
        word = ~breaks[part]
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[at + 1 : to]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[at + 1 : to]
        power, inverse = _grown(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_SYMBOL_LOWER[part] * power[: len(part)], out=sums[1:])
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes.append(mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)))
        starts_at.append(s + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    where = np.concatenate(starts_at)
    return np.concatenate(hashes), np.diff(np.searchsorted(where, offsets)).astype(np.int64)


_MIX = np.uint64(0xD6E8FEB86659FD93)


def rolled(h: np.ndarray, m: int) -> np.ndarray:
    """A hash of every m neighbouring words."""
    n = len(h) - m + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(m):
        out = out * _MIX + h[j : j + n]
    return mixed(out)


def from_columns(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def per_text(docs: DataFrame, function, names: list[str], schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Apply `function(text or None) -> tuple` to whole texts in Arrow batches;
    the key passes through untouched."""
    bounded_batches(docs.sparkSession)
    types = [f.dataType for f in docs.sparkSession.createDataFrame([], schema).schema]
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(t) for t in types]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*map(function, b.column(1).to_pylist()), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(found, kinds, strict=True))], names=[key, *names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.selectExpr(f"`{key}` AS __key", f"`{text}` AS __text").mapInArrow(rows, f"`{key}` {kind}, {schema}")
