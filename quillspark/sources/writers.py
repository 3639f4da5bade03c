"""Sinks: the chunk store with upserts, the index tables, and reports."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bm25 import Bm25Index
from .readers import unique


def upsert(new: DataFrame, path: str, key: str = "chunk_id", rebuild: bool = False) -> str:
    """Write a new generation of a table next to the old one: the old rows
    whose key is not in `new`, and `new`, whose keys must differ. Returns the
    generation's path; the table at `path` is the one named by the greatest
    number."""
    spark, new = new.sparkSession, unique(new, key)
    last = latest(spark, path)
    rows = new
    if last is not None and not rebuild:
        old = spark.read.parquet(last)
        rows = old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
    number = 1 + (int(PurePosixPath(last).name.split("=")[1]) if last else 0)
    to = f"{path}/generation={number:08d}"
    rows.write.parquet(to)
    return to


def latest(spark: SparkSession, path: str) -> str | None:
    """The newest generation of a table, or None."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("generation=") and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return f"{path}/{names[-1]}" if names else None


def read_table(spark: SparkSession, path: str) -> DataFrame:
    last = latest(spark, path)
    if last is None:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.parquet(last)


def write_bm25(index: Bm25Index, path: str) -> None:
    """Postings lie sorted by term, so a probe reads few row groups."""
    if index.docs.isEmpty():
        raise ValueError("no chunk is left to index")
    index.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    index.terms.write.mode("overwrite").parquet(f"{path}/terms")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    index.corpus.write.mode("overwrite").parquet(f"{path}/corpus")


def read_bm25(spark: SparkSession, path: str) -> Bm25Index:
    return Bm25Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "docs", "corpus")))


def flat(chunks: DataFrame) -> DataFrame:
    """Nested columns as flat ones, for stores that know only scalars."""
    return chunks.withColumns({"heading_path": F.concat_ws(" > ", "heading_path"), "source_pages": F.concat_ws(",", F.col("source_pages").cast("array<string>")), "page": F.coalesce("page", F.lit(-1)), **{c: F.coalesce(c, F.lit("")) for c in ("chapter", "section", "subsection", "content_type", "risk_level")}})


def nested(flat_chunks: DataFrame) -> DataFrame:
    """The inverse of `flat`."""
    path = F.filter(F.split("heading_path", " > "), lambda x: x != "")
    return flat_chunks.withColumns({"heading_path": path, "source_pages": F.filter(F.split("source_pages", ","), lambda x: x != "").cast("array<int>"), "page": F.when(F.col("page") > 0, F.col("page")), **{c: F.nullif(c, F.lit("")) for c in ("chapter", "section", "subsection", "content_type", "risk_level")}})


def report_format(path: str, fmt: str | None = None) -> str:
    fmt = (fmt or PurePosixPath(path).suffix.lstrip(".") or "md").lower()
    return fmt if fmt in ("json", "csv", "md") else "md"


def markdown(rows: DataFrame, title: str, limit: int = 50) -> str:
    """A bounded table of rows as Markdown."""
    names = rows.columns
    shown = rows.limit(limit).collect()
    cell = lambda v: "N/A" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"# {title}", "", f"| {' | '.join(names)} |", f"|{' --- |' * len(names)}", *(f"| {' | '.join(cell(v) for v in r)} |" for r in shown)]
    return "\n".join(lines) + "\n"


def widened(rows: DataFrame, metrics: str = "metrics") -> DataFrame:
    """A map of metrics as columns: the union of all rows' keys, sorted. Keys
    are names of metrics, so they are few."""
    keys = sorted(r[0] for r in rows.select(F.explode(F.map_keys(metrics))).distinct().collect())
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != metrics], *[F.col(metrics)[k].alias(k) for k in keys])


def write_pair(rows: DataFrame, summary: DataFrame, md: str, json: str, title: str = "Report") -> None:
    """A report as Markdown with its summary first, and all rows as JSON."""
    spark, text = rows.sparkSession, markdown(summary, title) + "\n" + markdown(rows, "Cases")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(md)
    rows.write.mode("overwrite").json(json)


def write_report(rows: DataFrame, path: str, fmt: str | None = None, title: str = "Report") -> None:
    kind = report_format(path, fmt)
    if kind == "md":
        spark = rows.sparkSession
        spark.createDataFrame([(markdown(rows, title),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    elif kind == "csv":
        maps = [f.name for f in rows.schema if f.dataType.typeName() == "map"]
        for m in maps:
            rows = widened(rows, m)
        rows.select(sorted(rows.columns)).write.mode("overwrite").option("header", True).csv(path)
    else:
        rows.write.mode("overwrite").json(path)
