"""A containment index by winnowing.

Of the hashes of all runs of GRAM characters of a text, the least of every WINDOW
neighbours is a fingerprint of the text. A window that lies in a needle lies
in every text that contains it, so all fingerprints of a needle of LEAST
characters or more are fingerprints of those texts. It is enough to look for one: the
rarest. The fingerprints of a table are an index (fp, new_id) that is
joined by shuffle, so neither side has a bound; what is found is compared as text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM, WINDOW = 16, 17
#: Characters that a needle needs to have a fingerprint.
LEAST = GRAM + WINDOW - 1
_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(text: str, width: int = GRAM) -> np.ndarray:
    """A hash of every run of `width` characters (a power of two), by doubling."""
    h, have = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) * _STEP, 1
    while have < width and len(h) > have:
        h = (h[:-have] ^ (h[:-have] >> np.uint64(31))) * (_STEP + np.uint64(2 * have)) + (h[have:] ^ (h[have:] >> np.uint64(29)))
        have *= 2
    return h if have == width and len(text) >= width else np.zeros(0, np.uint64)


def fingerprints(text: str | None) -> np.ndarray:
    """The distinct fingerprints of a text; none if it is shorter than LEAST."""
    h = gram_hashes(text or "")
    if len(h) < WINDOW:
        return np.zeros(0, np.int64)
    # the order of hashes is mixed once more, so that no character makes a gram small
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, WINDOW).min(axis=1)).view(np.int64)


def index(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(fp, key): the fingerprints of every text."""
    kind = texts.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprints(t) for t in b.column(1).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)), b.column(0).take(at)], names=["fp", key])

    return texts.select(key, text).mapInArrow(rows, f"fp long, `{key}` {kind}")


def contained(needles: DataFrame, chunks: DataFrame, held: DataFrame) -> DataFrame:
    """(needle, new_id, new_page) of the chunks whose new_flat contains a
    needle of LEAST characters or more; `held` is the index of the chunks by new_id."""
    named = needles.where(F.length("needle") >= LEAST).select("needle").distinct().select(F.xxhash64("needle").alias("a"), F.xxhash64(F.lit(1), "needle").alias("b"), "needle")
    prints = index(named.select(F.struct("a", "b").alias("n"), "needle"), "n", "needle")
    known = held.join(prints.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.count(F.lit(1)).alias("df"))
    # a fingerprint that no chunk has rules its needle out
    rarest = prints.join(known, "fp", "left").groupBy("n").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "fp")).alias("x")).where("x.df > 0").select("n", F.col("x.fp").alias("fp"))
    met = rarest.join(held, "fp").select(F.col("n.a").alias("a"), F.col("n.b").alias("b"), "new_id").distinct()
    both = met.join(named, ["a", "b"]).join(chunks.select("new_id", "new_page", "new_flat"), "new_id")
    return both.where(F.contains("new_flat", "needle")).select("needle", "new_id", "new_page")
