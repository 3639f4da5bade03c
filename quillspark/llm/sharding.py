"""Sharding: best-fit-decreasing packing of indivisible groups.

Groups (rows with equal texts) go, largest first, into the bin with the
tightest remaining capacity that still takes them, found in a balanced
search tree. Groups of one size are placed together: after the first one
enters a bin, that bin is still the tightest until it is full, so placing a
run of equal groups at once gives the very result of placing them one by
one.

The packing itself sees a histogram of size classes and never the groups.
Sizes up to 2,048 are classes of their own and each octave above has 1,024,
so that the histogram has at most about 2,048 + 1,024 * 53 rows whatever the
input. With a fixed capacity a class counts with the greatest size it may
hold, so that no bin runs over (by up to a thousandth of its room too early
a new one is opened); with a fixed number of bins, with the exact mean size
of its groups.

Defined cases: a null text has size 1 and all null texts are one group,
apart from empty texts (size 1 too); repeated rows each take a slot; an
empty table gives an empty result; other columns are ignored; a group larger
than the capacity has a bin to itself (with a fixed number of shards, the
other groups then share the rest evenly).
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Distinct values below which each size is a class of its own.
EXACT_SIZES = 2048
#: Rows sorted by one task when slots are dealt.
ROWS_PER_BUCKET = 50_000


class _Node:
    __slots__ = ("height", "key", "left", "right")

    def __init__(self, key: tuple[float, int]):
        self.key, self.left, self.right, self.height = key, None, None, 1


class CapacityTree:
    """An AVL tree over (remaining capacity, bin)."""

    def __init__(self) -> None:
        self._root: _Node | None = None

    @staticmethod
    def _h(n: _Node | None) -> int:
        return n.height if n else 0

    def _fix(self, n: _Node) -> _Node:
        n.height = 1 + max(self._h(n.left), self._h(n.right))
        lean = self._h(n.left) - self._h(n.right)
        if lean > 1:
            if self._h(n.left.left) < self._h(n.left.right):
                n.left = self._turn(n.left, "left")
            return self._turn(n, "right")
        if lean < -1:
            if self._h(n.right.right) < self._h(n.right.left):
                n.right = self._turn(n.right, "right")
            return self._turn(n, "left")
        return n

    def _turn(self, n: _Node, way: str) -> _Node:
        if way == "left":
            top = n.right
            n.right, top.left = top.left, n
        else:
            top = n.left
            n.left, top.right = top.right, n
        for x in (n, top):
            x.height = 1 + max(self._h(x.left), self._h(x.right))
        return top

    def add(self, key: tuple[float, int]) -> None:
        def put(n: _Node | None) -> _Node:
            if n is None:
                return _Node(key)
            if key < n.key:
                n.left = put(n.left)
            else:
                n.right = put(n.right)
            return self._fix(n)

        self._root = put(self._root)

    def remove(self, key: tuple[float, int]) -> None:
        def cut(n: _Node, key: tuple[float, int]) -> _Node | None:
            if key < n.key:
                n.left = cut(n.left, key)
            elif key > n.key:
                n.right = cut(n.right, key)
            elif n.left is None or n.right is None:
                return n.left or n.right
            else:
                low = n.right
                while low.left:
                    low = low.left
                n.key = low.key
                n.right = cut(n.right, low.key)
            return self._fix(n)

        self._root = cut(self._root, key)

    def tightest(self, size: float) -> tuple[float, int] | None:
        """The least entry whose remaining capacity is at least `size`."""
        n, best = self._root, None
        while n:
            if n.key[0] >= size:
                best, n = n.key, n.left
            else:
                n = n.right
        return best


def best_fit_decreasing(classes: Iterable[tuple[float, int]], capacity: float, bins: int | None = None) -> list[list[tuple[int, int]]]:
    """Place `count` groups of `size` for each class, given in any order.

    Without `bins`, bins are opened as needed and a group above the capacity
    has one to itself. With `bins`, that many are open from the start, and
    what fits nowhere goes, one group at a time, to the emptiest. Returns
    for each class of the input its runs (bin, groups).
    """
    rows = list(classes)
    out: list[list[tuple[int, int]]] = [[] for _ in rows]
    tree, rest = CapacityTree(), []

    def opened(room: float) -> None:
        tree.add((room, len(rest)))
        rest.append(room)

    for _ in range(bins or 0):
        opened(capacity)
    for i in sorted(range(len(rows)), key=lambda i: (-rows[i][0], i)):
        size, left = rows[i]
        while left:
            best = tree.tightest(size)
            if best is None:
                if bins is None:
                    opened(max(capacity, size))
                    continue
                room, at = max(rest), rest.index(max(rest))
                best, fits = (room, at), 1
            else:
                room, at = best
                fits = left if size <= 0 else min(left, max(1, math.floor(room / size)))
            tree.remove(best)
            rest[at] = room - fits * size
            tree.add((rest[at], at))
            if out[i] and out[i][-1][0] == at:
                out[i][-1] = (at, out[i][-1][1] + fits)
            else:
                out[i].append((at, fits))
            left -= fits
    return out


def even_capacity(classes: list[tuple[float, int]], bins: int) -> float:
    """The room that makes `bins` bins even: groups above an even share have
    a bin to themselves and the others share the rest."""
    total, left, rest = sum(s * n for s, n in classes), bins, sorted(classes, reverse=True)
    for size, n in rest:
        for _ in range(n):
            if left > 1 and size > total / left:
                total, left = total - size, left - 1
            else:
                return total / left * (1 + 1e-9) + 1e-6
    return max(total / max(left, 1), 1e-6)


def size_class(size):
    """The class of a size column: itself up to EXACT_SIZES, then rounded up
    to a 1,024th of its octave."""
    unit = F.pow(F.lit(2.0), F.length(F.bin(size)) - 11).cast("long")
    return F.when(size <= EXACT_SIZES, size).otherwise(F.ceil(size / unit).cast("long") * unit)


def pack_groups(groups: DataFrame, key: str, size: str, bins: int | None = None, capacity: int | None = None) -> DataFrame:
    """Give every row of `groups` (unique `key`, its whole `size`) a `shard`."""
    spark = groups.sparkSession
    classed = groups.withColumn("__class", size_class(F.col(size)))
    found = classed.groupBy("__class").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("s")).collect()
    found = sorted(found, key=lambda r: r["__class"])
    classes = [(r["s"] / r["n"] if capacity is None else r["__class"], r["n"]) for r in found]
    if capacity is None:
        capacity = even_capacity(classes, bins or 1)
    runs = []
    for r, placed in zip(found, best_fit_decreasing(classes, capacity, bins), strict=True):
        at = 0
        for shard, n in placed:
            runs.append((r["__class"], at, at + n, shard))
            at += n
    plan = spark.createDataFrame(runs, "__class long, __from long, __to long, shard int")
    many = max((r["n"] for r in found), default=1)
    numbered = common.ranked(classed, ["__class"], [key], [key], max(1, math.ceil(many / ROWS_PER_BUCKET)), "__rank")
    # at most one run a class and one more for each bin that fills up: bounded as the histogram is
    on = (numbered["__class"] == plan["__class"]) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to"))
    small = plan if len(runs) > 200_000 else F.broadcast(plan)
    return numbered.join(small, on).drop("__class", "__rank", "__from", "__to")


def shard_documents(docs: DataFrame, bins: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    slim = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.coalesce(F.sha2(body, 256).substr(1, 40), F.lit("")).alias("h"),
        F.col(text).isNull().alias("none"),
    ).withColumn("__group", F.when(F.col("none"), F.lit("null")).otherwise(F.col("h"))).drop("h", "none")
    slim = common.written(slim, "sizes")
    groups = slim.groupBy("__group").agg(F.sum("size").alias("__size"))
    placed = pack_groups(groups, "__group", "__size", bins=bins).select("__group", "shard")
    rows = slim.join(placed, "__group").drop("__group")
    total = slim.count()
    # a whole number of tasks each sort a slice of a shard
    slots = common.ranked(rows, ["shard"], ["doc_id", "text_crc32"], ["doc_id"], max(1, math.ceil(total / bins / ROWS_PER_BUCKET)) * 4, "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(common.table(spark, sf_dir, "documents"))
