"""Sources: pages of files, evaluation sets, reviews, reports, indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

EVIDENCE = "array<struct<page:int,chapter:string,section:string,subsection:string,heading_path:array<string>,chunk_id:string,quote:string>>"
EVAL_CASE = f"id string, question string, category string, intent_type string, expected_pages array<int>, expected_sections array<string>, acceptable_sections array<string>, expected_content_types array<string>, must_contain_terms array<string>, answer_must_cover array<string>, forbidden_content array<string>, evidence {EVIDENCE}, split string, notes string, excluded boolean, exclusion_reason string"
ANSWER_CASE = f"id string, question string, answer_type string, must_include_terms array<string>, must_include_points array<string>, must_not_include_terms array<string>, must_not_claim array<string>, critical_warning_points array<string>, expected_sections array<string>, expected_subsections array<string>, allow_insufficient_answer boolean, evidence {EVIDENCE}, source_case_id string, split string, notes string"
REVIEW = "case_id string, groundedness int, correctness int, completeness int, condition_handling int, safety_preservation int, unsupported_claim boolean, critical_safety_omission boolean, primary_failure_layer string, secondary_failure_layer string, failure_labels array<string>, evaluator_diagnostics array<string>, rationale string, adjudication_status string, post_hoc_root_cause_evidence_audit string"

Extractor = Callable[[bytes], list[str]]


def text_pages(data: bytes) -> list[str]:
    """Pages of a plain text file, parted by form feeds."""
    return data.decode("utf-8", "replace").split("\f")


def pdf_pages(data: bytes) -> list[str]:
    """Pages of a PDF, where a PDF library is installed."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the package pymupdf; give another extractor") from e
    with fitz.open(stream=data, filetype="pdf") as doc:
        return [page.get_text() for page in doc]


def read_pages(spark: SparkSession, path: str, extract: Extractor = text_pages) -> DataFrame:
    """(doc_id, source_file, page, text, file_path) of every page of the files
    at `path`; pages count from 1 and empty ones stay."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, data in zip(part["path"], part["content"], strict=True):
                pages = extract(bytes(data))
                yield pd.DataFrame({"file_path": p, "page": range(1, len(pages) + 1), "text": pages})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = files.mapInPandas(rows, "file_path string, page int, text string")
    out = out.withColumn("source_file", F.element_at(F.split("file_path", "/"), -1))
    return out.withColumn("doc_id", T.uuid5(F.concat_ws(":", "source_file", F.col("page").cast("string"))))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file; a malformed line is an error, blank lines
    are skipped, missing arrays are empty."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    arrays = {f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in df.schema if f.dataType.typeName() == "array"}
    return df.withColumns(arrays)


def eval_cases(spark: SparkSession, path: str, category: str | None = None, intent_type: str | None = None, split: str | None = None, limit: int | None = None, include_excluded: bool = False) -> DataFrame:
    """The retrieval set, filtered before the limit, with weak-anchor flags."""
    df = read_jsonl(spark, path, EVAL_CASE).withColumn("excluded", F.coalesce("excluded", F.lit(False)))
    df = df if include_excluded else df.where(~F.col("excluded"))
    for name, value in (("category", category), ("intent_type", intent_type), ("split", split)):
        df = df.where(F.col(name) == value) if value is not None else df
    blank = F.exists("evidence", lambda e: F.coalesce(e["quote"], F.lit("")) == "")
    df = df.withColumns({"no_evidence": F.size("evidence") == 0, "blank_quote": blank, "no_anchor": (F.size("evidence") == 0) & (F.size("expected_pages") == 0) & (F.size("expected_sections") == 0) & (F.size("must_contain_terms") == 0)})
    return df.orderBy("id").limit(limit) if limit is not None else df


def unique(df: DataFrame, key: str) -> DataFrame:
    """The same rows, after checking that no key is repeated."""
    twice = [r[0] for r in df.groupBy(key).count().where("count > 1").limit(20).collect()]
    if twice:
        raise ValueError(f"repeated {key}: {', '.join(map(str, twice))}")
    return df


def answer_cases(spark: SparkSession, path: str, limit: int | None = None, split: str | None = "dev") -> DataFrame:
    df = unique(read_jsonl(spark, path, ANSWER_CASE), "id")
    df = df if split is None else df.where(F.col("split") == split)
    return df.orderBy("id").limit(limit) if limit is not None else df


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """Human reviews from {"records": [...]}; scores must be 0, 1 or 2."""
    df = spark.read.schema(f"records array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split(' ', 1) for x in REVIEW.split(', ')))}>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    df = unique(df.select(F.explode("records").alias("r")).select("r.*"), "case_id")
    bad = df.where(" OR ".join(f"NOT coalesce({c} BETWEEN 0 AND 2, false)" for c in ("groundedness", "correctness", "completeness", "condition_handling", "safety_preservation"))).select("case_id").limit(20).collect()
    if bad:
        raise ValueError(f"scores out of range: {', '.join(r[0] for r in bad)}")
    return df


def raw_lines(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """(key, raw): the lines of a JSON lines file as they stand, beside their
    keys, for rewriting a set without touching other fields; a malformed line
    is an error, blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", f"`{key}` string", {"mode": "FAILFAST"})[key].alias(key), F.col("value").alias("raw"))


def json_report(spark: SparkSession, path: str) -> DataFrame:
    """A report of one JSON object a file; anything else is an error."""
    other = spark.read.text(path, wholetext=True).where(~F.col("value").rlike(r"^\s*\{"))
    if not other.isEmpty():
        raise ValueError(f"a report must be a JSON object: {path}")
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
