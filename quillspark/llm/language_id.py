"""Language identification by rank-order n-gram profiles.

Texts are lower-cased and every run of letters is padded with a space on
both sides; their n-grams of 1 to 3 characters (none across a gap but the
padding) are counted over the whole text. A language's profile holds the
PROFILE most frequent n-grams of its training texts by rank, and a
document's profile those of the document. The out-of-place distance adds,
for each of the document's n-grams, how far its rank is from that in the
language's profile, or PROFILE where it is missing there. The language with
the least distance is predicted (the first by name where they tie), and the
score is 1 - distance / greatest possible distance.

Training: of each language, the TRAIN_DOCS documents first by a hash of
their id, among the labelled documents that the query may learn from. This
sample is bounded by that parameter; its texts are used whole. Scoring sees
every document.

Defined cases: a null text, or one without a letter, is `und` with score 0;
so is every text when there is nothing to learn from; long texts are counted
in slices of SLICE characters; ties between n-grams go by code point;
repeated rows are scored each for itself; a null language is not learned
from; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PROFILE = 300
TRAIN_DOCS = 600
SLICE = 1 << 20
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _grams(code: np.ndarray) -> np.ndarray:
    """The 1- to 3-grams of code points in which 32 stands for padding; each
    is one number of 21 bits a character."""
    x = code.astype(np.int64)
    pad = x == 32
    two = x[:-1] << 21 | x[1:]
    two = two[~(pad[:-1] & pad[1:])]
    three = x[:-2] << 42 | x[1:-1] << 21 | x[2:]
    return np.concatenate([x[~pad], two, three[~pad[1:-1]]])


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text and their counts."""
    grams, counts = [], []
    text = text or ""
    for at in range(0, len(text), SLICE):
        to = at + SLICE
        while at and at < len(text) and text[at - 1].isalpha() and text[at].isalpha():
            at += 1  # this run of letters was taken by the slice before
            if at >= to:
                break
        while to < len(text) and text[to - 1].isalpha() and text[to].isalpha():
            to += 1
        code = np.frombuffer(text[at:to].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(code):
            continue
        code = np.where(_letters()[np.minimum(code, 0x10FFFF)], code, 32)
        code = np.concatenate([[32], code, [32]])
        code = code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])]
        if len(code) < 3:
            continue
        g, n = np.unique(_grams(code), return_counts=True)
        grams.append(g)
        counts.append(n)
    if len(grams) < 2:
        return (grams[0], counts[0]) if grams else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    g, where = np.unique(np.concatenate(grams), return_inverse=True)
    return g, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The n-grams by rank: most frequent first, then by code point."""
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        grams, counts = grams[counts >= least], counts[counts >= least]
    return grams[np.lexsort((grams, -counts))][:size]


class Profiles:
    """The languages' profiles as one table: a row for each n-gram."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        self.grams = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.array(profiles[x], np.int64) for x in self.langs)]))
        self.ranks = np.full((len(self.grams) + 1, max(1, len(self.langs))), -1, np.int32)
        for j, x in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, np.array(profiles[x], np.int64)), j] = np.arange(len(profiles[x]))

    def predict(self, text: str | None) -> tuple[str, float]:
        mine = ranked(*counted(text))
        if not len(mine) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, mine)
        at[(at >= len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != mine)] = len(self.grams)
        theirs = self.ranks[at]
        apart = np.where(theirs < 0, PROFILE, np.abs(theirs - np.arange(len(mine))[:, None])).sum(0)
        best = int(np.argmin(apart))
        return self.langs[best], float(1 - apart[best] / (PROFILE * len(mine)))


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def learned(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS) -> Profiles:
    """Profiles from a bounded sample of `labelled`."""
    slim = labelled.where(F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.xxhash64(F.lit(7), key).alias("h"))
    chosen = common.first_rows(slim, "lang", ["h", "k"], train_docs).select("k").distinct()
    # at most train_docs ids of each language
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(F.broadcast(chosen), "k")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                g, n = counted(t)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g), pa.array(n)], names=["lang", "gram", "n"])

    common.bounded_batches(labelled.sparkSession)
    total = rows.mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = common.first_rows(total, "lang", [F.desc("n"), F.col("gram")], PROFILE).withColumnRenamed("__r", "rank")
    profiles: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").collect():  # PROFILE rows a language
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(profiles)


def predicted(docs: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    return common.per_text(docs, lambda t: shared.value.predict(t), ["lang_pred", "score"], "lang_pred string, score double", key, text)


def kept(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """The rows of `docs` whose language is known, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    common.bounded_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = [shared.value.predict(t)[0] != UNKNOWN for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = predicted(docs, learned(docs.where(~held_out("doc_id"))))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
