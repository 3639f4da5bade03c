"""Benchmark decontamination: pigeonhole edit matching.

Texts and items are word sequences (A-Z lower-cased, ASCII punctuation taken
as space). An item of n words may be found with up to k = n div 6 word edits
(insert, delete, replace). Cut into k+1 pieces, at least one piece must then
stand in the text unchanged, by the pigeonhole principle; so only exact
piece hits are looked up (rolling hashes of all word positions, checked
against the pieces' hashes), and each hit's surroundings are verified by
Myers' bit-parallel edit distance, in which the item may begin and end
anywhere in the window.

Items go to the tasks in blocks of at most ITEM_WORDS words; each block is
matched against all texts, so that memory is bounded however many items
there are. The answer has a row for each (document, item) that match, with
the best match: the least distance, then the earliest end.

An item of fewer than six words has no budget (k = 0): it is one piece, found
only as that whole row of words. `matches` searches items of all lengths
and reports their words, so that a user may leave short ones aside; `clean`
needs `min_words` words (5), as fewer identify no text.

Defined cases: null and empty texts match nothing; items without a word, or with
fewer than `min_words`, are not searched; repeated items
are reported each under its id, repeated rows each for itself; a null item
id or doc_id stays null; an empty table gives an empty result; other columns
are ignored by `matches` and kept by `clean`, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

EDITS_PER_WORD = 6
#: Words that an item needs to clean a document.
MIN_WORDS = 5
#: Words of items that a task holds at once.
ITEM_WORDS = 2_000_000


def myers(pattern_masks: dict[int, int], n: int, words: list[int]) -> list[int]:
    """For each end position in `words`, the least number of edits between the
    pattern and any piece of text ending there."""
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, out = full, 0, n, []
    for w in words:
        eq = pattern_masks.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full  # the text may begin anywhere
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        out.append(score)
    return out


class Pieces:
    """The pieces of a block of items, by length, and the items' bit masks."""

    def __init__(self, ids: list, words: list[list[int]]):
        self.ids, self.words, self.masks = ids, words, []
        self.by_length: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for i, w in enumerate(words):
            masks: dict[int, int] = {}
            for j, x in enumerate(w):
                masks[x] = masks.get(x, 0) | 1 << j
            self.masks.append(masks)
            k = len(w) // EDITS_PER_WORD
            cuts = [len(w) * p // (k + 1) for p in range(k + 2)]
            h = np.array(w, np.uint64)
            for a, b in zip(cuts, cuts[1:], strict=False):
                self.by_length[b - a][int(common.rolled(h[a:b], b - a)[0])].append((i, a))
        self.sorted = {m: np.sort(np.fromiter(d, np.uint64, len(d))) for m, d in self.by_length.items()}
        self.seen = {}
        for m, keys in self.sorted.items():
            self.seen[m] = np.zeros(1 << 16, bool)
            self.seen[m][keys >> np.uint64(48)] = True

    def hits(self, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(position, item, offset of the piece in the item)."""
        for m, keys in self.sorted.items():
            g = common.rolled(h, m)
            at = np.flatnonzero(self.seen[m][g >> np.uint64(48)])
            if len(at):
                x = g[at]
                found = keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x
                for p, v in zip(at[found].tolist(), x[found].tolist(), strict=True):
                    for i, a in self.by_length[m][v]:
                        yield p, i, a

    def verified(self, h: np.ndarray, starts: np.ndarray, hits) -> dict[tuple[int, int], tuple[int, int, int]]:
        """The best (distance, end, n) of each (row, item)."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        done: set[tuple[int, int, int]] = set()
        for p, i, a in hits:
            row = int(np.searchsorted(starts, p, side="right")) - 1
            lo, hi = int(starts[row]), int(starts[row + 1])
            n = len(self.words[i])
            k = n // EDITS_PER_WORD
            if (row, i, p - a) in done:
                continue
            done.add((row, i, p - a))
            frm, to = max(lo, p - a - k), min(hi, p - a + n + k)
            scores = myers(self.masks[i], n, h[frm:to].tolist())
            d = min(scores)
            if d <= k:
                end = frm + scores.index(d) + 1 - lo
                best[row, i] = min(best.get((row, i), (d, end, n)), (d, end, n))
        return best


def _words(text: str | None) -> list[int]:
    raw, offsets = common.text_buffers(pa.array([text], pa.string()))
    return common.word_hashes(raw, offsets, common.PUNCTUATION)[0].tolist()


def item_blocks(items: DataFrame, item_key: str, text: str, min_words: int) -> Iterator[Pieces]:
    """The items of `min_words` words or more in blocks of bounded size,
    streamed to the driver."""
    ids, words, held = [], [], 0
    for r in items.select(item_key, text).toLocalIterator():
        w = _words(r[1])
        if len(w) < max(1, min_words):
            continue
        if held + len(w) > ITEM_WORDS and ids:
            yield Pieces(ids, words)
            ids, words, held = [], [], 0
        ids.append(r[0])
        words.append(w)
        held += len(w)
    yield Pieces(ids, words)


def searched(pieces: Pieces, column: pa.Array) -> dict[tuple[int, int], tuple[int, int, int]]:
    """The best (distance, end, n) of each (row, item) of a batch of texts."""
    raw, offsets = common.text_buffers(column)
    h, counts = common.word_hashes(raw, offsets, common.PUNCTUATION)
    # a hit that runs over the end of its row can't be verified there
    return pieces.verified(h, np.concatenate([[0], np.cumsum(counts)]), pieces.hits(h))


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", min_words: int = 1) -> DataFrame:
    """(key, item_key, distance, n_words, end_word) of every match."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    kind, item_kind = docs.schema[key].dataType, items.schema[item_key].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(item_kind)
    out = None
    for block in item_blocks(items, item_key, text, min_words):
        shared = spark.sparkContext.broadcast((block.ids, block.words))

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces = Pieces(*shared.value)
            for b in batches:
                best = sorted(searched(pieces, b.column(1)).items())
                at = pa.array([row for (row, _), _ in best], pa.int64())
                yield common.from_columns([key, item_key, "distance", "n_words", "end_word"], [b.column(0).take(at), pa.array([pieces.ids[i] for (_, i), _ in best], item_type), pa.array([x[0] for _, x in best], pa.int64()), pa.array([x[2] for _, x in best], pa.int64()), pa.array([x[1] for _, x in best], pa.int64())])

        found = docs.selectExpr(f"`{key}` AS __key", f"`{text}` AS __text").mapInArrow(rows, f"`{key}` {kind.simpleString()}, `{item_key}` {item_kind.simpleString()}, distance long, n_words long, end_word long")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of `docs` in which no item is found, with all their columns.
    Each row is judged by its own text, whatever its id."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    at, out = docs.columns.index(text), docs
    for block in item_blocks(items, item_key, text, min_words):
        shared = spark.sparkContext.broadcast((block.ids, block.words))

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces = Pieces(*shared.value)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[row for row, _ in searched(pieces, b.column(at))]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(rows, docs.schema)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
