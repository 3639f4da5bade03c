"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct shingles of so many words (words
`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased) by 64-bit hash; with fewer words, the
whole sequence is its one shingle. Two sets link when their Jaccard
similarity is at least the threshold, reckoned in whole numbers. A `Measure`
holds both: 4 words and 85/100 for op10, 5 words and 80/100 for the stage of
the pipeline.

Candidates come from PartEnum. Sets are in size bands whose sizes differ by
at most the threshold squared; a set carries its band's tag, and the next
one's if a partner can be in the next band, so linked sets share a tag. Within
a tag of greatest size r, linked sets differ in at most
k = floor(2r * (1 - t) / (1 + t)) shingles, t being the threshold. The shingle
domain is cut by hash into n = floor(k/2) + 2 partitions in a ring. Such a
partition is cut into three; with at most one difference in it, two of the
three are equal. So a set's signatures are, for each partition, the three
pairs of thirds. Bands with k = 0 link equal sets only.

Popular passages make sets share a signature that have little else in common.
So a signature carries a sketch: the parities, by hash into 60 bits, of the
shingles of the CHAIN partitions that start with its own. Two sets that differ
in d of these shingles have sketches that differ in d bits at most. A set of m
shingles differs from those it links with in at most d = min(k, m * (1 - t) / t)
shingles. By the cycle lemma there is a partition such that, for every l, the
l partitions that start with it hold at most l * d / n differences. Were two
more differences in it, it would hold more than (d + 2) / n < 2, so
another one starts chains of at most l * (d + 2) / n. So linked sets share a
signature of at least two partitions whose sketches differ in
CHAIN * (d + 2) / n bits at most, d being that of either set; others are not
brought together by it.

A pair of thirds in which a set has no shingle at all says nothing, and
sharing it would bring together sets at random, ever more of them as the
input grows. Its signature is left out unless the set has two partitions
with such a pair: if linked sets shared empty pairs only, both would have at
least two, as there are two partitions of the kind above. So no link is lost.

A task passes on the signatures of a set once. Sets that share a signature
form a bucket; no pairs are made from it, only a forest of those whose
sketches agree, and a task hands on a forest of the forests of its buckets.
First each set is compared with one neighbour of the forest, on whole
texts. The components of the links found are parts. If an edge of the forests
joins two parts, these are open; sets of other parts have all their links, as
any two sets with agreeing sketches are joined by edges, of which the first
and the last that leave a part leave theirs. The signatures of the open
parts' sets are put into buckets again, now with a wide sketch too: the
parities by hash into 64 * WORDS bits of the shingles of the next WIDE
partitions. What was said of l partitions holds for WIDE of them; and sets of
m and m' shingles that link differ in at most d = (m + m') * (1 - t) / (1 + t).
Buckets give the pairs of parts that hold sets whose two sketches agree, so
nearly only those of sets that are about as similar as links ask for, and
not all that have a passage in common. Such parts are compared on whole texts,
each with all its partners, in blocks of up to BLOCK_SETS sets and BLOCK_BYTES. A
group counts all intersections by a matrix product over the shingles that
several sets have and hands on a spanning forest of its links, so that its
output grows with its sets and not with their pairs. The components of all
links are the answer.

Defined cases: a null or empty text, or one of white space, has an empty set
and is linked with nothing; equal texts link; repeated rows are documents of
their own; a null doc_id takes part, but a component's id is its least
non-null doc_id (null if there is none); an empty table gives an empty
result; other columns are ignored by `joined` and kept by `one_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph

THIRDS = 3
#: Partitions whose shingles a signature's sketch takes in, and its bits.
CHAIN = 6
SKETCH_BITS = 60
#: The same of a wide sketch, in words of 64 bits.
WIDE = 32
WORDS = 4
#: Members of a bucket that are compared with each other; beyond, runs of so many are joined unseen.
BUCKET = 50_000
#: Sets and bytes of text in a block of a cluster.
BLOCK_SETS = 256
BLOCK_BYTES = 8 << 20
#: Signatures that one task sorts.
SIGNATURES = 2_000_000
#: The bits of a signature that are kept; the others are zero and cost no disk. Sketches keep apart what meets by chance.
_SIGNATURE = np.uint64(0xFFFFFFFFFFFF0000)
_KEYS = np.array([0x8CB92BA72F3D8DD7, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F], np.uint64)


class Measure(NamedTuple):
    """Words of a shingle, and the threshold as a fraction."""

    words: int = 4
    numerator: int = 85
    denominator: int = 100


OP10 = Measure()
PIPELINE = Measure(5, 80, 100)


def shingle_sets(column: pa.Array, words: int = OP10.words) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of every row, sorted, and each row's number."""
    raw, offsets = common.text_buffers(column)
    h, n = common.word_hashes(raw, offsets)
    rows = len(n)
    starts = np.cumsum(n) - n
    row = np.repeat(np.arange(rows), n)
    g = common.rolled(h, words)
    inside = row[: len(g)] == row[words - 1 :] if len(g) else np.zeros(0, bool)
    g, owner = g[inside], row[: len(g)][inside]
    for m in range(1, words):
        short = np.flatnonzero(n == m)
        if len(short):
            part = np.zeros(len(short), np.uint64)
            for j in range(m):
                part = part * np.uint64(0xD6E8FEB86659FD93) + h[starts[short] + j]
            g, owner = np.concatenate([g, common.mixed(part + np.uint64(m))]), np.concatenate([owner, short])
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    return g[first], np.bincount(owner[first], minlength=rows)


def set_ids(g: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 63-bit id of each row's set; equal sets have equal ids."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(common.mixed(g + _KEYS[0]), dtype=np.uint64)])
    to = np.cumsum(n)
    return (common.mixed((sums[to] - sums[to - n]) + n.astype(np.uint64) * _KEYS[1]) >> np.uint64(1)).astype(np.int64)


def bands(most: int, measure: Measure = OP10) -> np.ndarray:
    """Least sizes of the bands, up to two beyond size `most`."""
    wider = lambda size: size * measure.denominator // measure.numerator + 1
    out = [1]
    while len(out) < 3 or out[-3] <= most:
        out.append(wider(wider(out[-1]) - 1))
    return np.array(out, np.int64)


def signatures(g: np.ndarray, n: np.ndarray, measure: Measure = OP10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature, sketch) of every set. A sketch's highest bits hold the
    number of bits in which the sketches of sets it links with may differ."""
    return wide_signatures(g, n, measure, 0)[:3]


def wide_signatures(g: np.ndarray, n: np.ndarray, measure: Measure = OP10, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same, and the wide sketch: its words, and then the set's size and
    number of partitions in one."""
    if not len(g):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros((0, words + 1), np.uint64)
    low = bands(int(n.max()), measure)
    own = np.searchsorted(low, n, side="right") - 1
    owner = np.repeat(np.arange(len(n)), n)
    spot, third, value = g >> np.uint64(32), common.mixed(g + _KEYS[2]) % np.uint64(THIRDS), common.mixed(g + _KEYS[1])
    bit = np.uint64(1) << (value % np.uint64(SKETCH_BITS))
    if words:
        spread = common.mixed(value)
        bits = np.zeros((len(g), words), np.uint64)
        bits[np.arange(len(g)), (spread >> np.uint64(32)) % np.uint64(words)] = np.uint64(1) << (spread % np.uint64(64))
    rows, found, sketches, wides = [], [], [], []
    for step in (0, 1):
        tag = own + step
        k = 2 * (low[tag + 1] - 1) * (measure.denominator - measure.numerator) // (measure.denominator + measure.numerator)
        reaches = n * measure.denominator // measure.numerator >= low[tag]
        parts = np.where((n > 0) & (k > 0) & reaches, k // 2 + 2, 0)
        at = np.cumsum(parts) - parts
        live = parts[owner] > 0
        o = owner[live]
        part = at[o] + ((spot[live] * parts[o].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        total = int(parts.sum())
        cells = np.zeros((total, THIRDS), np.uint64)
        cell = part * THIRDS + third[live].astype(np.int64)
        np.add.at(cells.reshape(-1), cell, value[live])
        held = np.zeros((total, THIRDS), bool)
        held.reshape(-1)[cell] = True
        row = np.repeat(np.arange(len(n)), parts)
        hollow = np.bincount(row, held.sum(1) <= 1, len(n)) >= 2
        # shingles are in the order of their partitions, so a chain is a run of them, or two about the ring's end
        begin = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=total))])
        here, first, ring = np.arange(total), at[row], parts[row]

        def chained(bit: np.ndarray, partitions: int) -> np.ndarray:
            parity = np.concatenate([np.zeros_like(bit, shape=(1, *bit.shape[1:])), np.bitwise_xor.accumulate(bit, axis=0)])
            beyond = here + np.minimum(partitions, ring)
            over = np.maximum(beyond - (first + ring), 0)
            return parity[begin[beyond - over]] ^ parity[begin[here]] ^ parity[begin[first + over]] ^ parity[begin[first]]

        chain = chained(bit[live], CHAIN)
        wide = np.zeros((total, words + 1), np.uint64)
        if words:
            wide[:, :-1] = chained(bits[live], WIDE)
            wide[:, -1] = (n[row].astype(np.uint64) << np.uint64(32)) + ring.astype(np.uint64)
        most = np.minimum(k, n * (measure.denominator - measure.numerator) // measure.numerator)[row]
        span = np.minimum(CHAIN, ring)
        may = np.minimum(np.minimum(most, span * (most + 2) // np.maximum(ring, 1)), 2 * span - 1).astype(np.uint64)
        chain |= may << np.uint64(SKETCH_BITS)
        place = (tag[row].astype(np.uint64) << np.uint64(40)) + (here - first).astype(np.uint64)
        for left in range(THIRDS):
            a, b = (x for x in range(THIRDS) if x != left)
            says = held[:, a] | held[:, b] | hollow[row]
            rows.append(row[says])
            sketches.append(chain[says])
            wides.append(wide[says])
            found.append(_SIGNATURE & common.mixed(cells[says, a] * _KEYS[0] + cells[says, b] * _KEYS[1] + common.mixed(place[says] * np.uint64(THIRDS) + np.uint64(left))))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(sketches), np.concatenate(wides)


_BITS = np.uint64((1 << SKETCH_BITS) - 1)


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches of one bucket differ in few enough bits."""
    return np.bitwise_count((a ^ b) & _BITS) <= np.minimum(a, b) >> np.uint64(SKETCH_BITS)


def alike(a: np.ndarray, b: np.ndarray, measure: Measure = OP10) -> np.ndarray:
    """Whether wide sketches of one bucket differ in few enough bits for sets
    of their sizes to link."""
    size, ring = (a[:, -1] >> np.uint64(32)) + (b[:, -1] >> np.uint64(32)), (a[:, -1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    most = size.astype(np.int64) * (measure.denominator - measure.numerator) // (measure.denominator + measure.numerator)
    may = np.minimum(most, np.minimum(WIDE, ring) * (most + 2) // np.maximum(ring, 1))
    return np.bitwise_count(a[:, :-1] ^ b[:, :-1]).sum(1, dtype=np.int64) <= may


def bucket_forest(cid: np.ndarray, sketch: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that join the members of a bucket as near sketches do."""
    out = []
    if len(cid) > BUCKET:
        starts = np.arange(0, len(cid), BUCKET)
        out.append((cid[starts[:-1]], cid[starts[1:]]))
        for s in starts:
            out += bucket_forest(cid[s : s + BUCKET], sketch[s : s + BUCKET])
            out.append((np.repeat(cid[s], len(cid[s : s + BUCKET])), cid[s : s + BUCKET]))
        return out
    only, first, which = np.unique(sketch, return_index=True, return_inverse=True)
    out.append((cid[first][which], cid))
    left, queue = np.arange(len(only)), []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        met = near(only[at : at + 1], only[left])
        out.append((np.repeat(cid[first[at]], int(met.sum())), cid[first[left[met]]]))
        queue += left[met].tolist()
        left = left[~met]
    return out


def spanning(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which of the edges make a forest with the components of all; those to
    the least nodes come first, so that tasks choose alike."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root, keep = list(range(len(node))), np.zeros(len(u), bool)
    order = np.lexsort((v, u))
    for e, a, b in zip(order.tolist(), at[: len(u)][order].tolist(), at[len(u) :][order].tolist(), strict=True):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[max(a, b)] = min(a, b)
            keep[e] = True
    return keep


def slim_table(docs: DataFrame, key: str, text: str, measure: Measure) -> DataFrame:
    """(key, th, n_shingles, cid): cid names the set, null if empty."""
    common.bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, n = shingle_sets(b.column(2), measure.words)
            yield common.from_columns([key, "th", "n_shingles", "cid"], [b.column(0), b.column(1), pa.array(n.astype(np.int64)), pa.array(set_ids(g, n), mask=n == 0)])

    return docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("th"), F.col(text).alias("__text")).mapInArrow(rows, f"`{key}` {kind}, th long, n_shingles long, cid long")


def stars(docs: DataFrame, text: str, parts: int, measure: Measure) -> DataFrame:
    """(u, v): edges that join the members of each bucket that near sketches join."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: set[int] = set()
        for b in batches:
            g, n = shingle_sets(b.column(0), measure.words)
            cid = set_ids(g, n)
            new = np.zeros(len(n), bool)
            for i, c in enumerate(cid.tolist()):
                if n[i] and c not in passed:
                    passed.add(c)
                    new[i] = True
            row, sig, sketch = signatures(g[np.repeat(new, n)], np.where(new, n, 0), measure)
            yield common.from_columns(["sig", "cid", "sketch"], [pa.array(sig.view(np.int64)), pa.array(cid[row]), pa.array(sketch.view(np.int64))])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(c.to_numpy() for c in b.columns) for b in batches]
        if not held:
            return
        sig, cid, sketch = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(sig)
        sig = sig[order]
        lone = np.ones(len(sig) + 1, bool)
        lone[1:-1] = sig[1:] != sig[:-1]
        several = ~(lone[:-1] & lone[1:])
        sig, order = sig[several], order[several]
        cid, sketch = cid[order], sketch[order].view(np.uint64)
        order = np.lexsort((cid, sig))
        sig, cid, sketch = sig[order], cid[order], sketch[order]
        again = np.zeros(len(sig), bool)
        again[1:] = (sig[1:] == sig[:-1]) & (cid[1:] == cid[:-1])
        sig, cid, sketch = sig[~again], cid[~again], sketch[~again]
        if not len(sig):
            return
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        head = start[group]
        met = near(sketch, sketch[head])
        pairs = [np.stack([cid[head[met]], cid[met]])]
        # where all are near the least member, its star is enough
        to = np.append(start[1:], len(sig))
        for i in np.unique(group[~met]).tolist():
            mine = slice(start[i], to[i])
            if to[i] - start[i] > 2:
                pairs += [np.stack(e) for e in bucket_forest(cid[mine], sketch[mine])]
        pair = np.concatenate(pairs, axis=1)
        pair = np.unique(np.sort(pair[:, pair[0] != pair[1]], axis=0), axis=1)
        pair = pair[:, spanning(*pair)]
        yield common.from_columns(["u", "v"], [pa.array(pair[0]), pa.array(pair[1])])

    made = docs.select(F.col(text).alias("t")).mapInArrow(signed, "sig long, cid long, sketch long")
    return made.repartition(parts, "sig").mapInArrow(shared, "u long, v long").distinct()


def forest(g: np.ndarray, n: np.ndarray, measure: Measure = OP10) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets of a group."""
    rows = len(n)
    owner = np.repeat(np.arange(rows), n)
    _, column, times = np.unique(g, return_inverse=True, return_counts=True)
    several = times[column] > 1
    place = np.cumsum(times > 1) - 1
    owner, column = owner[several], place[column[several]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both, width, wide = np.zeros((rows, rows), np.float64), 4096, int(column[-1]) + 1 if len(column) else 0
    for at in range(0, wide, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        x = np.zeros((rows, width), np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        both += x @ x.T
    linked = measure.denominator * both >= measure.numerator * (n[:, None] + n[None, :] - both)
    linked &= (n > 0)[:, None] & (n > 0)[None, :]
    root, out = np.arange(rows), []
    for i in range(rows):  # each set joins the components it links with
        near = np.unique(root[:i][linked[i, :i]])
        for r in near.tolist():
            out.append((int(np.flatnonzero((root[:i] == r) & linked[i, :i])[0]), i))
        if len(near):
            root[np.isin(root, near)] = i
            root[i] = i
    return out


def grouped_links(rows: DataFrame, by: list[str], measure: Measure) -> DataFrame:
    """(u, v): a forest of the links between the sets (cid, text) of each group."""

    def links(table: pa.Table) -> pa.Table:
        cid = table.column("cid").to_numpy()
        found = forest(*shingle_sets(table.column("text"), measure.words), measure)
        return pa.table({"u": pa.array([int(cid[a]) for a, _ in found], pa.int64()), "v": pa.array([int(cid[b]) for _, b in found], pa.int64())})

    return rows.groupBy(*by).applyInArrow(links, "u long, v long")


def neighbour_links(near: DataFrame, texts: DataFrame, measure: Measure) -> DataFrame:
    """(u, v): the links of each set with its least neighbour, found in groups
    of up to BLOCK_SETS sets or BLOCK_BYTES about a neighbour."""
    tree = near.groupBy(F.col("v").alias("cid")).agg(F.min("u").alias("hub")).join(texts, "cid")
    sizes = tree.groupBy("hub").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("long").alias("blocks"))
    leaves = tree.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("cid"), "blocks").alias("i"), "cid", "text")
    hubs = sizes.join(texts, sizes["hub"] == texts["cid"]).select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("i"), "cid", "text")
    return grouped_links(leaves.unionByName(hubs), ["hub", "i"], measure)


def parts_met(sig: np.ndarray, part: np.ndarray, sketch: np.ndarray, wide: np.ndarray | None = None, measure: Measure = OP10) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): the pairs of parts, a < b, with near sketches in one bucket,
    whose wide sketches are alike if there are any."""
    order = np.lexsort((sketch, part, sig))
    sig, part, sketch = sig[order], part[order], sketch[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (part[1:] != part[:-1]) | (sketch[1:] != sketch[:-1])
    if wide is not None:
        wide = wide[order]
        new[1:] |= (wide[1:] != wide[:-1]).any(1)
        wide = wide[new]
    sig, part, sketch = sig[new], part[new], sketch[new]
    # a row is held against those of its bucket's later parts, from `at` to `end`
    starts = np.ones(len(sig), bool)
    starts[1:] = sig[1:] != sig[:-1]
    runs = starts.copy()
    runs[1:] |= part[1:] != part[:-1]
    end = np.append(np.flatnonzero(starts), len(sig))[np.cumsum(starts)]
    at = np.append(np.flatnonzero(runs), len(sig))[np.cumsum(runs)]
    rows, found, held = np.flatnonzero(at < end), [np.zeros((2, 0), np.int64)], 0
    at, end = at[rows], end[rows]
    while len(rows):
        met = np.flatnonzero(near(sketch[rows], sketch[at]))
        if wide is not None:
            met = met[alike(wide[rows[met]], wide[at[met]], measure)]
        found.append(np.stack([part[rows[met]], part[at[met]]]))
        held += len(found[-1][0])
        if held > SIGNATURES:
            found = [np.unique(np.concatenate(found, axis=1), axis=1)]
            held = len(found[0][0])
        at = at + 1
        left = at < end
        rows, at, end = rows[left], at[left], end[left]
    a, b = np.unique(np.concatenate(found, axis=1), axis=1)
    return a, b


def part_pairs(members: DataFrame, parts: int, measure: Measure) -> DataFrame:
    """(a, b): the pairs of parts, a < b, that may have a link, `members` being
    (cid, part, text)."""

    names = ["sig", "part", "sketch", *(f"w{i}" for i in range(WORDS)), "sizes"]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, sig, sketch, wide = wide_signatures(*shingle_sets(b.column(1), measure.words), measure)
            yield common.from_columns(names, [pa.array(x) for x in (sig.view(np.int64), b.column(0).to_numpy()[row], *np.column_stack([sketch, wide]).view(np.int64).T)])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(c.to_numpy() for c in b.columns) for b in batches]
        if held:
            sig, part, sketch, *wide = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            a, b = parts_met(sig, part, sketch.view(np.uint64), np.stack(wide, axis=1).view(np.uint64), measure)
            yield common.from_columns(["a", "b"], [pa.array(a), pa.array(b)])

    made = members.select("part", "text").mapInArrow(signed, ", ".join(f"{x} long" for x in names))
    return made.repartition(parts, "sig").mapInArrow(met, "a long, b long").distinct()


def part_links(pairs: DataFrame, members: DataFrame, measure: Measure) -> DataFrame:
    """(u, v): links between the parts of each pair, `members` being (cid,
    part, text). Of a pair the part with more text is the hub; the sets of a
    hub's partners share blocks, each of which meets each of the hub's."""
    blocks = F.greatest(F.ceil(F.sum("n") / BLOCK_SETS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("long")
    sizes = common.written(members.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")), "sizes")
    size = lambda x: sizes.select(F.col("part").alias(x), F.struct("bytes", "n", "part").alias(f"size_{x}"))
    known = pairs.join(size("a"), "a").join(size("b"), "b").select(F.greatest("size_a", "size_b").alias("hub"), F.least("size_a", "size_b").alias("leaf"))
    known = common.written(known.select(F.col("hub.part").alias("hub"), F.col("leaf.part").alias("part"), F.col("leaf.n").alias("n"), F.col("leaf.bytes").alias("bytes")), "pairs")
    leaf_blocks = known.groupBy("hub").agg(blocks.alias("wide"))
    hub_blocks = sizes.groupBy(F.col("part").alias("hub")).agg(blocks.alias("high"))
    hubs = common.written(leaf_blocks.join(hub_blocks, "hub"), "hubs")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("cid"), F.col(n))
    ids = members.select("cid", "part")
    leaves = known.select("hub", "part").join(ids, "part").join(hubs, "hub").select("hub", each("high").alias("i"), dealt("wide").alias("j"), "cid")
    own = hubs.join(ids.toDF("cid", "hub"), "hub").select("hub", dealt("high").alias("i"), each("wide").alias("j"), "cid")
    return grouped_links(leaves.unionByName(own).join(members.select("cid", "text"), "cid"), ["hub", "i", "j"], measure)


def linked_roots(docs: DataFrame, slim: DataFrame, key: str, text: str, measure: Measure) -> DataFrame:
    """(cid, root): the component of every set that links with another one."""
    spark = docs.sparkSession
    total = slim.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(common.partitions_for(spark), math.ceil(total * 0.6 / SIGNATURES))
    near = common.written(stars(docs, text, parts, measure), "stars")
    # the tables below grow with the sets that have candidates
    members = near.select("u").union(near.select("v")).distinct().toDF("cid")
    first = slim.where("cid IS NOT NULL").join(members, "cid", "left_semi").groupBy("cid").agg(F.min(F.struct(F.col(key).alias("k"), "th")).alias("x")).select("cid", F.col("x.k").alias("k"), F.col("x.th").alias("th"))
    small = common.small_side(common.written(first, "firsts"))
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    texts = rows.join(small, rows["th"].eqNullSafe(small["th"]) & rows["k"].eqNullSafe(small["k"])).select("cid", "text")
    doubled = slim.groupBy(key, "th").count().where("count > 1").isEmpty()
    texts = common.written(texts if doubled else texts.dropDuplicates(["cid"]), "texts")
    joined_parts = common.written(graph.components(common.written(neighbour_links(near, texts, measure), "links")), "parts")
    part = lambda x: joined_parts.toDF(x, f"part_{x}")
    edges = near.join(part("u"), "u", "left").join(part("v"), "v", "left").select(F.coalesce("part_u", "u").alias("a"), F.coalesce("part_v", "v").alias("b")).where("a <> b")
    edges = common.written(edges.distinct(), "edges")
    open_ones = edges.select("a").union(edges.select("b")).distinct().toDF("part")
    open_sets = texts.join(joined_parts.toDF("cid", "part"), "cid", "left").withColumn("part", F.coalesce("part", "cid")).join(open_ones, "part", "left_semi")
    open_sets = common.written(open_sets.select("cid", "part", "text"), "open")
    pairs = common.written(part_pairs(open_sets, parts, measure), "pairs")
    more = common.written(part_links(pairs, open_sets, measure), "links")
    common.discarded(spark, near, texts, edges, open_sets, pairs)
    if more.isEmpty():
        return joined_parts.toDF("cid", "root")
    return graph.components(more.union(joined_parts.toDF("u", "v"))).toDF("cid", "root")


def placed(docs: DataFrame, key: str, text: str, measure: Measure) -> DataFrame:
    """(key, th, n_shingles, cid, root) of every row; root names the
    component and is null for an empty set."""
    slim = common.written(slim_table(docs, key, text, measure), "sets")
    roots = linked_roots(docs, slim, key, text, measure)
    return slim.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))


def joined(docs: DataFrame, key: str = "doc_id", text: str = "text", measure: Measure = OP10) -> DataFrame:
    """(key, th, n_shingles, component_id) of every row."""
    rows = placed(docs, key, text, measure)
    # a row that is alone in its component, or has no set, is its own
    least = rows.where("root IS NOT NULL").groupBy("root").agg(F.min(key).alias("__least"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    out = rows.join(common.small_side(common.written(least, "least")), "root", "left")
    return out.select(key, "th", "n_shingles", F.coalesce("__least", key).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", measure: Measure = OP10) -> DataFrame:
    """`docs` less all but one row of each component: one with the least id
    (null ids last; of several texts under that id, any one). Empty texts
    stay."""
    found = common.written(placed(docs, key, text, measure).where("root IS NOT NULL").select(F.col(key).alias("__k"), F.col("th").alias("__th"), "root"), "found")
    # a row is known by id and text, so rows that agree in both are of one component
    first = F.min(F.struct(F.col("__k").isNull().alias("none"), F.col("__k").alias("k"), F.col("__th").alias("th"))).alias("x")
    several = common.written(found.groupBy("root").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "x"), "several")
    members = found.join(common.small_side(several), "root")
    mine = F.col("__k").eqNullSafe(F.col("x.k")) & (F.col("__th") == F.col("x.th"))

    def those(df: DataFrame, few: DataFrame, how: str) -> DataFrame:
        return df.join(few, df[key].eqNullSafe(few["__k"]) & (F.xxhash64(df[text]) == few["__th"]), how)

    gone = common.written(members.where(~mine).select("__k", "__th").distinct(), "gone")
    kept = those(docs, common.small_side(gone), "left_anti")
    doubled = common.written(members.where(mine).groupBy("__k", "__th").count().where("count > 1").select("__k", "__th"), "doubled")
    if doubled.isEmpty():
        return kept
    twice = common.small_side(doubled)
    hashed = common.fresh(docs, "hashed")
    some = those(kept, twice, "left_semi").withColumn(hashed, F.xxhash64(text)).dropDuplicates([key, hashed]).drop(hashed)
    return those(kept, twice, "left_anti").unionByName(some)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(common.table(spark, sf_dir, "documents"), measure=OP10).drop("th")
