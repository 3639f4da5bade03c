"""Media columns: chroma audio fingerprints and their alignment.

A recording is a row of pitch-class frames: 12 energies for each short span
of time, from audio samples (`chroma_of_samples`) or from notes. From the
integral image over (time, pitch class), 16 filters compare the energies of
rectangles; each gives two bits, Gray coded, so that every position of the
filter window is packed into one 32-bit integer: the fingerprint.

Two recordings match when, at some offset, they overlap in at least
LEAST_OVERLAP fingerprints and in LEAST_SHARE of the shorter one, and at most
ERROR_RATE of the bits of the overlap differ. Of such offsets the one with
the least share of differing bits is taken (of ties, the smaller shift, then
the lower).

Candidates come from all fingerprints. Each has six sub-keys, its pairs of
bytes, so that a sub-key meets another although bits of the other two bytes
differ. An offset of two recordings is verified on all its bits if enough
sub-keys meet there: one where the overlap is under SHORT, and else two, or a
VOTE_SHARE of the overlap. With 20 % of the bits wrong at random a sub-key meets with
probability 0.8 ** 16 = 0.028, so 0.17 for each fingerprint of the overlap are expected, more than three
times that share. All fingerprints of either recording are held against each other. The search is not exact; recall at the limit is measured in the tests. Queries go to the tasks in blocks
of PRINTS fingerprints, each matched against all recordings. Recordings with
equal fingerprints are collapsed into one class; searches run between classes
and members are listed with their class.

The tables hold no audio. `query` takes conversations as recordings: a
conversation's turns in order are its voice, and each word sounds as one
frame, whose letters are the notes (letter number modulo 12). Queries are
the conversations whose id is divisible by 50, against all conversations.

Defined cases: null or empty recordings have no fingerprints and align with
nothing; recordings shorter than the filter window are padded with silence;
a null turn text is silent; ties between offsets go to the smaller shift;
repeated rows sound twice; a null id is not a query, and is not matched; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CLASSES = 12
WINDOW = 8
LEAST_SHARE = 0.5
ERROR_RATE = 0.2
LEAST_OVERLAP = 12
#: Sub-keys of a fingerprint, the overlap below which one that meets is enough, and the share of the overlap that must meet beyond.
SUBKEY_BYTES = tuple((a, b) for a in (0, 8, 16, 24) for b in (0, 8, 16, 24) if a < b)
SHORT = 40
VOTE_SHARE = 0.05
#: Fingerprints of queries that a task holds at once, hits that it counts at once, and counters that it holds for them.
PRINTS = 500_000
HITS = 500_000
CELLS = 8_000_000
#: Fixed layout of the filters: (form, first class, classes, frames). Forms:
#: 0 whole against nothing, 1 upper against lower half, 2 earlier against
#: later half, 3 the two diagonals, 4 middle against outer thirds.
FILTERS = ((0, 0, 6, 4), (0, 6, 6, 4), (1, 0, 4, 8), (1, 4, 4, 8), (1, 8, 4, 8), (1, 2, 8, 2), (2, 0, 3, 8), (2, 3, 3, 8), (2, 6, 3, 8), (2, 9, 3, 8), (3, 0, 6, 4), (3, 6, 6, 4), (3, 3, 6, 8), (4, 0, 12, 4), (4, 0, 6, 6), (2, 0, 12, 2))
#: Cuts between the four levels of a filter's log ratio.
CUTS = (-0.35, 0.0, 0.35)
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def chroma_of_samples(samples: np.ndarray, rate: int, frame: int = 4096, hop: int = 1365) -> np.ndarray:
    """Pitch-class frames of mono samples, from 55 Hz to 3,520 Hz."""
    if len(samples) < frame:
        samples = np.pad(samples, (0, frame - len(samples)))
    n = 1 + (len(samples) - frame) // hop
    shape = np.lib.stride_tricks.as_strided(samples, (n, frame), (samples.strides[0] * hop, samples.strides[0]))
    power = np.abs(np.fft.rfft(shape * np.hanning(frame), axis=1)) ** 2
    hz = np.arange(power.shape[1]) * rate / frame
    heard = (hz >= 55) & (hz <= 3520)
    note = np.rint(12 * np.log2(np.maximum(hz, 1) / 440.0)).astype(int) % CLASSES
    out = np.zeros((n, CLASSES))
    for c in range(CLASSES):
        out[:, c] = power[:, heard & (note == c)].sum(axis=1)
    return out


def chroma_of_words(text: str) -> np.ndarray:
    """One frame for each word; its letters and digits are the notes."""
    words = text.lower().split()
    raw = [w.encode("utf-32-le") for w in words]
    code = np.frombuffer(b"".join(raw), np.uint32)
    row = np.repeat(np.arange(len(words)), [len(x) // 4 for x in raw])
    return np.bincount(row * CLASSES + code % CLASSES, minlength=len(words) * CLASSES).reshape(-1, CLASSES).astype(float)


def fingerprints(frames: np.ndarray) -> np.ndarray:
    """One packed integer for each position of the filter window."""
    n = len(frames)
    if not n:
        return np.zeros(0, np.uint32)
    if n < WINDOW:
        frames, n = np.vstack([frames, np.zeros((WINDOW - n, CLASSES))]), WINDOW
    image = np.zeros((n + 1, CLASSES + 1))
    image[1:, 1:] = np.cumsum(np.cumsum(frames, axis=0), axis=1)
    at = np.arange(n - WINDOW + 1)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return image[at + t1, c1] - image[at + t0, c1] - image[at + t1, c0] + image[at + t0, c0]

    out = np.zeros(len(at), np.uint32)
    for form, c, high, wide in FILTERS:
        half, mid = c + high // 2, wide // 2
        if form == 0:
            a, b = area(0, wide, c, c + high), area(0, WINDOW, 0, CLASSES) * wide * high / (WINDOW * CLASSES)
        elif form == 1:
            a, b = area(0, wide, c, half), area(0, wide, half, c + high)
        elif form == 2:
            a, b = area(0, mid, c, c + high), area(mid, wide, c, c + high)
        elif form == 3:
            a, b = area(0, mid, c, half) + area(mid, wide, half, c + high), area(0, mid, half, c + high) + area(mid, wide, c, half)
        else:
            a = area(0, wide, c + high // 3, c + 2 * high // 3)
            b = (area(0, wide, c, c + high) - a) / 2
        level = np.searchsorted(CUTS, np.log((1 + a) / (1 + b)))
        out = out << np.uint32(2) | _GRAY[level]
    return out


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """(differing bits, overlap) where a[i] meets b[i + offset]."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    if hi <= lo:
        return 0, 0
    return int(np.bitwise_count(a[lo:hi] ^ b[lo + offset : hi + offset]).sum()), hi - lo


class Queries:
    """A block of queries, with the sub-keys of all their fingerprints."""

    def __init__(self, ids: list, prints: list[np.ndarray]):
        self.ids, self.prints = ids, prints
        self.sizes = np.array([len(p) for p in prints], np.int64)
        every = np.concatenate(prints) if prints else np.zeros(0, np.uint32)
        self.owner = np.repeat(np.arange(len(prints)), self.sizes)
        self.at = np.arange(len(every)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.every = every
        self.before = np.cumsum(self.sizes) - self.sizes
        # in a table of counters queries are in the order of their sizes
        self.order = np.argsort(self.sizes, kind="stable")

    @cached_property
    def keys(self) -> list[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
        """For each sub-key its bytes, where each of its values begins, and the fingerprints in the order of values."""
        out = []
        for two in SUBKEY_BYTES:
            key = sub_key(self.every, two)
            out.append((two, np.concatenate([[0], np.cumsum(np.bincount(key, minlength=1 << 16))]), np.argsort(key.astype(np.uint16), kind="stable")))
        return out

    @cached_property
    def index(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`keys` in one piece: where each value of each sub-key begins, and in
        the order of sub-keys and values the fingerprints' place in a table of
        counters (but for what depends on its width) and their query's rank."""
        every = len(self.every)
        begin = [begin[:-1] + i * every for i, (_, begin, _) in enumerate(self.keys)]
        places = np.concatenate([places for _, _, places in self.keys])
        rank, zero = np.zeros_like(self.order), np.zeros_like(self.sizes)
        rank[self.order] = np.arange(len(self.order))
        zero[self.order] = np.cumsum(self.sizes[self.order]) - 1
        return np.concatenate([*begin, [len(places)]]), (zero[self.owner] - self.at).astype(np.int32)[places], rank[self.owner].astype(np.int32)[places]

    def met(self, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(fingerprint of a query, of `b`) where a sub-key meets, in pieces."""
        for two, begin, places in self.keys:
            key = sub_key(b, two)
            lo = begin[key]
            n = begin[key + 1] - lo
            cut = np.flatnonzero(np.diff(np.cumsum(n) // HITS, prepend=0)) if n.sum() > HITS else []
            for part in np.split(np.flatnonzero(n), np.searchsorted(np.flatnonzero(n), cut)):
                m = n[part]
                yield places[np.repeat(lo[part] - np.cumsum(m) + m, m) + np.arange(m.sum())], np.repeat(part, m)

    def cells(self, width: int) -> int:
        """How many offsets of all queries there are to a recording of `width` fingerprints."""
        return int(self.sizes.sum()) + len(self.sizes) * (width - 1)

    def counted(self, many: list[np.ndarray], least: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(recording, query, offset, votes) by a table of counters, in pieces;
        with `least`, without those of too few votes for any overlap."""
        width, kinds = max(len(b) for b in many), len(SUBKEY_BYTES)
        begin, place, rank = self.index
        slot = place + rank * np.int32(width - 1)
        # cells are looked through by eights
        votes = np.zeros(-(-self.cells(width) // 8) * 8, np.uint16 if kinds * width < 1 << 16 else np.uint32)
        enough = np.zeros(len(votes), bool)
        sizes = self.sizes[self.order]
        starts = np.cumsum(sizes + width - 1) - (sizes + width - 1)
        need = least_votes(sizes) if least else np.ones(len(sizes), np.int64)  # it grows with the size
        runs = np.flatnonzero(np.diff(need, prepend=0))
        runs = list(zip(starts[runs].tolist(), [*starts[runs[1:]].tolist(), len(votes)], need[runs].tolist(), strict=True))
        lengths = np.array([len(b) for b in many], np.int64)
        ends, most = np.cumsum(lengths), least_votes(lengths).tolist()
        every, upto = np.concatenate(many), np.zeros(0, np.int64)
        at = np.arange(len(every)) - np.repeat(ends - lengths, lengths)
        keys = np.stack([(sub_key(every, two) + (i << 16) << 32) + at for i, two in enumerate(SUBKEY_BYTES)])
        held, waiting = [], 0
        for r, (end, length) in enumerate(zip(ends.tolist(), lengths.tolist(), strict=True)):
            votes.fill(0)
            key = np.sort(keys[:, end - length : end].ravel())  # so that memory is read in its order
            key, at = key >> 32, key.astype(np.int32)
            lo = begin[key]
            n = begin[key + 1] - lo
            to = np.cumsum(n)
            cuts = [0, *np.searchsorted(to, np.arange(HITS, to[-1], HITS), side="right").tolist(), len(to)]
            for first, last in zip(cuts, cuts[1:], strict=False):
                if first < last:
                    before, m = to[first] - n[first], n[first:last]
                    i = np.repeat(lo[first:last] - to[first:last] + m + before, m)
                    upto = upto if len(upto) >= len(i) else np.arange(len(i))
                    i += upto[: len(i)]
                    cell = slot[i]
                    cell += np.repeat(at[first:last], m)
                    np.add.at(votes, cell, votes.dtype.type(1))
            for first, last, few in runs:
                if few >= most[r]:  # the recording is the shorter one from here on
                    np.greater_equal(votes[first:], votes.dtype.type(most[r]), out=enough[first:])
                    break
                np.greater_equal(votes[first:last], votes.dtype.type(few), out=enough[first:last])
            eight = np.flatnonzero(enough.view(np.uint64) != 0)
            x = np.flatnonzero(enough.reshape(-1, 8)[eight])
            x = (eight[x >> 3] << 3) + (x & 7)
            held.append((np.full(len(x), r), x, votes[x]))
            waiting += len(x)
            if waiting > HITS or r == len(many) - 1:
                which, x, v = (np.concatenate(y) for y in zip(*held, strict=True))
                k = np.searchsorted(starts, x, side="right") - 1
                yield which, self.order[k], x - starts[k] - sizes[k] + 1, v.astype(np.int64)
                held, waiting = [], 0

    def sorted(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`hits` by sorting, where a table would be too large."""
        found, votes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for where, at in self.met(b):
            x, v = np.unique((self.owner[where] << 33) + (at - self.at[where] + (1 << 32)), return_counts=True)
            found.append(x)
            votes.append(v)
        x, back = np.unique(np.concatenate(found), return_inverse=True)
        return x >> 33, (x & ((1 << 33) - 1)) - (1 << 32), np.bincount(back, np.concatenate(votes), len(x)).astype(np.int64)

    def hits(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, offset, votes): how many sub-keys of `b` meet those of a
        query at an offset."""
        if not len(b) or not 0 < self.cells(len(b)) <= CELLS:
            return self.sorted(b)
        _, q, offset, votes = next(self.counted([b], False))
        by = np.lexsort((offset, q))
        return q[by], offset[by], votes[by]

    def parts(self, width: int) -> Iterator[tuple[np.ndarray, Queries]]:
        """The queries in blocks whose tables of counters hold CELLS or, of
        one query, more."""
        if self.cells(width) <= CELLS or len(self.sizes) < 2:
            yield np.arange(len(self.sizes)), self
            return
        nth = np.cumsum(self.sizes + width - 1) // max(CELLS // 2, 1)
        for which in np.split(np.arange(len(self.sizes)), np.flatnonzero(np.diff(nth)) + 1):
            yield which, Queries([self.ids[i] for i in which], [self.prints[i] for i in which])

    def candidates(self, many: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(recording, query, offset, overlap) where enough sub-keys of the
        recordings meet, in pieces."""
        sizes = np.array([len(b) for b in many], np.int64)
        if 0 < self.cells(int(sizes.max())) <= CELLS:
            found = self.counted(many, True)
        else:
            found = ((np.full(len(x[0]), r), *x) for r, x in enumerate(map(self.sorted, many)))
        for r, q, offset, votes in found:
            overlap = np.minimum(self.sizes[q], sizes[r] - offset) - np.maximum(0, -offset)
            ok = (overlap >= least_overlap(self.sizes[q], sizes[r])) & (votes >= np.where(overlap < SHORT, 1, np.maximum(2, overlap * VOTE_SHARE)))
            yield r[ok], q[ok], offset[ok], overlap[ok]

    def differing(self, a: np.ndarray, whole: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """How many bits differ in `n` fingerprints, one or more, of the
        queries from `a` and of `whole` from `b`."""
        out = np.zeros(len(n), np.int64)
        for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // HITS)) + 1):
            if len(part):
                m = n[part]
                to = np.cumsum(m)
                i = np.arange(to[-1])
                differ = np.bitwise_count(self.every[np.repeat(a[part] - to + m, m) + i] ^ whole[np.repeat(b[part] - to + m, m) + i])
                out[part] = np.add.reduceat(differ, to - m, dtype=np.int64)
        return out

    def verified(self, many: list[np.ndarray]) -> Iterator[tuple[int, int, tuple[float, int, int, int]]]:
        """(recording, query, (error rate, shift, offset, overlap)) of the
        best of a piece's candidates that match."""
        sizes = np.array([len(b) for b in many], np.int64)
        begins, whole = np.cumsum(sizes) - sizes, np.concatenate(many)
        for r, q, offset, overlap in self.candidates(many):
            lo = np.maximum(0, -offset)
            a, b, half, most = self.before[q] + lo, begins[r] + lo + offset, (overlap + 1) // 2, ERROR_RATE * 32 * overlap
            # the first half of an overlap may not differ in more bits than all of it may
            wrong = self.differing(a, whole, b, half)
            near = np.flatnonzero(wrong <= most)
            m = half[near]
            wrong = wrong[near] + self.differing(a[near] + m, whole, b[near] + m, overlap[near] - m)
            near, wrong = near[wrong <= most[near]], wrong[wrong <= most[near]]
            r, q, offset, overlap = r[near], q[near], offset[near], overlap[near]
            rate = wrong / (32 * overlap)
            by = np.lexsort((offset, np.abs(offset), rate, q, r))
            first = by[np.flatnonzero(np.diff(r[by], prepend=-1) | np.diff(q[by], prepend=-1))]
            yield from zip(r[first].tolist(), q[first].tolist(), zip(rate[first].tolist(), np.abs(offset)[first].tolist(), offset[first].tolist(), overlap[first].tolist(), strict=True), strict=True)

    def matches_of(self, many: list[np.ndarray]) -> list[dict[int, tuple[float, int, int, int, int]]]:
        """`matches` of several recordings."""
        best: list[dict[int, tuple[float, int, int, int]]] = [{} for _ in many]
        # tables are laid out for all recordings of about one length
        widths = np.array([1 << (len(b) - 1).bit_length() if len(b) else 0 for b in many], np.int64)
        for width in np.unique(widths[widths > 0]).tolist():
            group = np.flatnonzero(widths == width)
            mates = [many[j] for j in group]
            for which, block in self.parts(max(len(b) for b in mates)):
                for r, q, one in block.verified(mates):
                    mine, i = best[group[r]], int(which[q])
                    mine[i] = min(mine.get(i, one), one)
        return [{i: (rate, shift, o, votes_at(self.prints[i], b, o), both) for i, (rate, shift, o, both) in found.items()} for b, found in zip(many, best, strict=True)]

    def matches(self, b: np.ndarray) -> dict[int, tuple[float, int, int, int, int]]:
        """For each query that matches `b`, (error rate, shift, offset, votes,
        overlap) of the best offset."""
        return self.matches_of([b])[0]


def sub_key(prints: np.ndarray, two: tuple[int, int]) -> np.ndarray:
    """The bytes `two` of fingerprints as an integer."""
    return (prints >> np.uint32(two[0]) & np.uint32(0xFF)).astype(np.int64) << 8 | (prints >> np.uint32(two[1]) & np.uint32(0xFF)).astype(np.int64)


def votes_at(a: np.ndarray, b: np.ndarray, offset: int) -> int:
    """How many sub-keys meet where a[i] meets b[i + offset]."""
    lo, hi = max(0, -offset), min(len(a), len(b) - offset)
    differ = a[lo:hi] ^ b[lo + offset : hi + offset]
    return int(sum(np.count_nonzero(sub_key(differ, two) == 0) for two in SUBKEY_BYTES))


def step_of(n: int) -> int:
    """The greatest step that leaves SHORT fingerprints of half of `n`. The
    search takes all fingerprints; a test of `met` takes steps."""
    return max(1, -(-n // 2) // SHORT)


def least_overlap(a, b):
    """The overlap that recordings of `a` and `b` fingerprints must have."""
    return np.maximum(LEAST_OVERLAP, np.ceil(np.minimum(a, b) * LEAST_SHARE).astype(np.int64))


def least_votes(n: np.ndarray) -> np.ndarray:
    """The votes that no match with recordings of `n` fingerprints or more is below."""
    short = least_overlap(n, n)
    return np.where(short < SHORT, 1, np.maximum(2, (short * VOTE_SHARE).astype(np.int64)))


def best_offset(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """The offset at which `a` matches `b`, the overlap there (0 if they do
    not match), and the overlap that is needed."""
    found = Queries([0], [a]).matches(b).get(0, (1.0, 0, 0, 0, 0))
    return found[2], found[4], int(least_overlap(len(a), len(b)))


def fingerprinted(recordings: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cid, prints): packed fingerprints; equal ones have equal cid."""

    def of(t: str | None) -> tuple[int | None, bytes]:
        prints = fingerprints(chroma_of_words(t or ""))
        if not len(prints):
            return None, b""
        at = np.arange(len(prints), dtype=np.uint64) << np.uint64(32)
        return int(common.mixed(prints.astype(np.uint64) + at).sum(dtype=np.uint64) >> np.uint64(1)), prints.tobytes()

    return common.per_text(recordings, of, ["cid", "prints"], "cid long, prints binary", key, text)


def query_blocks(asked: DataFrame) -> Iterator[tuple[list, list]]:
    """The queries' (cid, prints) in blocks, streamed to the driver."""
    ids, prints, held = [], [], 0
    for r in asked.select("cid", "prints").toLocalIterator():
        if ids and held + len(r[1]) // 4 > PRINTS:
            yield ids, prints
            ids, prints, held = [], [], 0
        ids.append(r[0])
        prints.append(bytes(r[1]))
        held += len(r[1]) // 4
    yield ids, prints


def aligned(prints: DataFrame, is_query) -> DataFrame:
    """(q, c, offset, votes, overlap, error_rate) of the classes that match;
    `prints` has cid, prints and the flag is_query for each class."""
    spark, out = prints.sparkSession, None
    common.bounded_batches(spark)
    dealt = prints.select("cid", "prints").repartition(common.partitions_for(spark), "cid")
    for block in query_blocks(prints.where(is_query)):
        shared = spark.sparkContext.broadcast(block)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, raw = shared.value
            asked = Queries(ids, [np.frombuffer(p, np.uint32) for p in raw])
            for b in batches:
                found = []
                recordings = [np.frombuffer(data, np.uint32) for data in b.column(1).to_pylist()]
                for c, matched in zip(b.column(0).to_pylist(), asked.matches_of(recordings), strict=True):
                    for i, (rate, _, offset, votes, overlap) in matched.items():
                        if ids[i] != c:
                            found.append((ids[i], c, offset, votes, overlap, rate))
                columns = list(zip(*found, strict=True)) or [()] * 6
                yield common.from_columns(["q", "c", "offset", "votes", "overlap", "error_rate"], [*(pa.array(x, pa.int64()) for x in columns[:5]), pa.array(columns[5], pa.float64())])

        found = dealt.mapInArrow(rows, "q long, c long, offset long, votes long, overlap long, error_rate double")
        out = found if out is None else out.unionByName(found)
    return out


def search(recordings: DataFrame, key: str, text: str, every: int = 50) -> DataFrame:
    """For every recording, its class, and for the classes of queries the
    classes they align with: (row, key, class_id, match_class_id, offset,
    votes, overlap, error_rate). Rows are `member` (a recording and its
    class; classes have their least key as id) or `match`."""
    rows = common.written(fingerprinted(recordings, key, text), "prints")
    asked = F.coalesce(F.col(key) % every == 0, F.lit(False))
    classes = rows.where("cid IS NOT NULL").groupBy("cid").agg(F.min(key).alias("least"), F.max(asked.cast("int")).alias("asked"), F.first("prints").alias("prints")).where("least IS NOT NULL")
    classes = common.written(classes, "classes")
    found = aligned(classes, F.col("asked") == 1)
    names = classes.select("cid", "least")
    blank = [F.lit(None).cast("long").alias(x) for x in ("match_class_id", "offset", "votes", "overlap")]
    members = rows.join(names, "cid", "left").select(F.lit("member").alias("row"), key, F.col("least").alias("class_id"), *blank, F.lit(None).cast("double").alias("error_rate"))
    matches = found.join(names.toDF("q", "class_id"), "q").join(names.toDF("c", "match_class_id"), "c").select(F.lit("match").alias("row"), F.lit(None).cast(recordings.schema[key].dataType).alias(key), "class_id", "match_class_id", "offset", "votes", "overlap", "error_rate")
    return members.unionByName(matches)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations")
    # a conversation is bounded by what one voice can say; its turns in order
    said = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("x"))
    recordings = said.select("conv_id", F.array_join(F.col("x.text"), "\n").alias("text"))
    return search(recordings, "conv_id", "text")
