"""Language-model scoring with a sharded Elias-Fano n-gram trie.

The model is an interpolated trigram model with absolute discounting over
the unigram base (c + 1) / (N + V + 1). Nothing is pruned or sampled, so the
trie grows with the corpus; it is dealt to shards by first word and no
machine holds all of it. Words that are so frequent that their successors
would swell a shard (more than 1/(4 shards) of all tokens, so at most 4 for
each shard) are dealt to all shards by their second word.

1. Unigrams: every task counts the distinct words of its block of texts;
   the counts meet by word shard and give N, V and the frequent words. A
   second look at the frequent words alone counts their distinct successors
   over all shards, so that dealing them out changes no probability. Only
   sums and the frequent words come to the driver.
2. Each block of documents sends every shard its distinct n-grams rooted
   there, sorted, with their training counts.
3. A shard adds the counts, builds its trie, asks it for the n-grams of
   every block, and sends each block its quantised values.
4. A block's values meet its documents (as places in the block's list of
   n-grams) and the documents are scored.

The documents' scan runs once for step 2 and once for step 4; blocks carry a
hash of their ids, and a block without its values fails the query.

Defined cases: a null or empty text is only its end token; long texts are a
block of their own; a null doc_id is not held out; repeated rows are scored
each for itself and learned from each; with nothing to learn from, N and V
are 0; an empty table gives an empty result; other columns are ignored.
Words are told apart by 64-bit hash (63 bits in the trie), successors by 32
bits within their context, and values have an error of at most 1.1e-4 in
log10. The number of shards decides where n-grams are kept and nothing else:
scores are equal for any.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .ngram_trie import END, NONE, NgramTrie, left_over, value_of

#: Bytes of text in a block, and in the share of the corpus of one shard.
BLOCK_BYTES = 12 << 20
SHARD_BYTES = 24 << 20
END_HASH = int(common.mixed(np.array([0x5EED], np.uint64))[0])


def packed(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, protocol=5))


def unpacked(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def fingerprint(h: np.ndarray) -> np.ndarray:
    f = np.maximum(h >> np.uint64(32), np.uint64(END + 1))
    return np.where(h == np.uint64(END_HASH), np.uint64(END), f)


class Block:
    """Documents of one task, up to BLOCK_BYTES of text."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bytes = 0

    def add(self, ids: pa.Array, held: np.ndarray, text: pa.Array) -> None:
        raw, offsets = common.text_buffers(text)
        h, n = common.word_hashes(raw, offsets)
        self.ids.append(ids)
        self.parts.append((h, n, held))
        self.bytes += len(raw)

    def sequences(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens with an end after each document; each document's number
        of tokens; held out or not."""
        h, n, held = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        seq = np.full(len(h) + len(n), END_HASH, np.uint64)
        word = np.ones(len(seq), bool)
        word[np.cumsum(n + 1) - 1] = False
        seq[word] = h
        return seq, n + 1, held

    def name(self) -> str:
        """A hash of the block's ids and words in order."""
        ids = pa.concat_arrays([x.cast(pa.string()) for x in self.ids])
        out = 0
        for h in (common.word_hashes(*common.text_buffers(ids))[0], self.sequences()[0]):
            at = np.arange(len(h), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            out = out << 64 | int(common.mixed(h + at).sum(dtype=np.uint64))
        return f"{out:032x}-{len(ids)}"


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Block]]:
    block = Block()
    for b in batches:
        if not b.num_rows:
            continue
        at = 0
        # a batch of long texts is cut where the block is full
        lengths = np.diff(common.text_buffers(b.column(2))[1])
        while at < b.num_rows:
            room = BLOCK_BYTES - block.bytes
            take = max(1, int(np.searchsorted(np.cumsum(lengths[at:]), room, side="right")))
            if block.bytes and lengths[at] > room:
                yield block.name(), block
                block = Block()
                continue
            part = b.slice(at, take)
            block.add(part.column(0), part.column(1).to_numpy(zero_copy_only=False), part.column(2))
            at += take
    if block.parts:
        yield block.name(), block


class Ngrams:
    """The distinct n-grams of a block by shard, and each token's place."""

    def __init__(self, block: Block, shards: int, hot: np.ndarray):
        seq, n, held = block.sequences()
        left = np.repeat(np.cumsum(n), n) - np.arange(len(seq))  # tokens up to the end of the document, this one included
        words, word = np.unique(seq, return_inverse=True)
        prints, of_word = np.unique(fingerprint(words), return_inverse=True)
        # n-grams are sorted by ranks: of (shard, first word), and of the others' fingerprints, from 1
        rank = (of_word + 1)[word].astype(np.uint64)
        second, third = np.zeros(len(seq), np.uint64), np.zeros(len(seq), np.uint64)
        second[:-1], third[:-2] = rank[1:], rank[2:]
        second[left < 2], third[left < 3] = 0, 0
        shard, root, first = shard_of(words, shards), word, words
        if len(hot):
            place = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
            often = hot[place] == words
            at = np.flatnonzero(often[word] & (left > 1))
            code, part = np.unique(place[word[at]] * shards + shard[word[at + 1]], return_inverse=True)
            root = word.copy()
            root[at] = len(words) + part
            shard, first = np.concatenate([shard, code % shards]), np.concatenate([words, hot[code // shards]])
        order = np.lexsort((first, shard))
        place = np.empty(len(order), np.uint64)
        place[order] = np.arange(len(order))
        width = np.uint64(len(prints).bit_length())
        if 2 * int(width) + len(order).bit_length() <= 64:
            key = place[root] << (width + width) | second << width | third
            by = np.argsort(key)
            new = np.append(True, key[by][1:] != key[by][:-1])
        else:
            by = np.lexsort((third, second, place[root]))
            new = np.ones(len(seq), bool)
            new[1:] = np.any([x[by][1:] != x[by][:-1] for x in (third, second, place[root])], axis=0)
        at = np.flatnonzero(new)
        self.place = np.empty(len(seq), np.uint32)
        self.place[by] = np.cumsum(new) - 1
        train = np.repeat(~held, n)[by].astype(np.int64)
        self.counts = np.add.reduceat(train, at).astype(np.uint32)
        told = np.append(np.uint64(NONE), prints)
        one = by[at]
        self.shard, self.words = shard[root[one]], first[root[one]]
        self.pairs = told[second[one].astype(np.int64)] << np.uint64(32) | told[third[one].astype(np.int64)]
        self.n, self.held = n, held

    def by_shard(self) -> Iterator[tuple[int, bytes]]:
        cut = np.flatnonzero(np.append(True, self.shard[1:] != self.shard[:-1]))
        for a, b in zip(cut, np.append(cut[1:], len(self.shard)), strict=True):
            w, p = self.words[a:b], self.pairs[a:b]
            new1 = np.append(True, w[1:] != w[:-1])
            fp2 = (p >> np.uint64(32)).astype(np.uint32)
            new2 = new1 | np.append(True, fp2[1:] != fp2[:-1])
            at1, at2 = np.flatnonzero(new1), np.flatnonzero(new2)
            runs2 = np.diff(np.append(at2, b - a)).astype(np.uint32)  # triples of each pair
            runs1 = np.diff(np.append(np.searchsorted(at2, at1), len(at2))).astype(np.uint32)  # pairs of each word
            yield int(self.shard[a]), packed(w[at1], runs1, fp2[at2], runs2, p.astype(np.uint32), self.counts[a:b])


def _unigrams(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for _, block in blocks(batches):
        seq, n, held = block.sequences()
        w, c = np.unique(seq[np.repeat(~held, n)], return_counts=True)
        s = shard_of(w, shards)
        order = np.argsort(s, kind="stable")
        s, w, c = s[order], w[order], c[order]
        cut = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, int)
        for a, b in zip(cut, np.append(cut[1:], len(s)), strict=True):
            yield common.from_columns(["shard", "data"], [pa.array([int(s[a])], pa.int32()), pa.array([packed(w[a:b], c[a:b].astype(np.uint32))], pa.binary())])


def _vocabulary(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[bytes]] = defaultdict(list)
    for b in batches:
        for s, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held[s].append(data)
    for s, rows in held.items():
        w, c = (np.concatenate(x) for x in zip(*map(unpacked, rows), strict=True))
        w, at = np.unique(w, return_inverse=True)
        c = np.bincount(at, c).astype(np.int64)
        often = c > c.sum() / (4 * shards)
        yield common.from_columns(["shard", "n", "v", "words", "counts"], [pa.array([s], pa.int32()), pa.array([int(c.sum())]), pa.array([len(w)]), pa.array([w[often].tobytes()], pa.binary()), pa.array([c[often].tobytes()], pa.binary())])


def _successors(batches: Iterator[pa.RecordBatch], hot: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """The distinct successors of each frequent word in a block, by part."""
    for _, block in blocks(batches):
        seq, n, held = block.sequences()
        at = np.flatnonzero(np.repeat(~held, n)[:-1])
        place = np.minimum(np.searchsorted(hot, seq[at]), len(hot) - 1)
        often = hot[place] == seq[at]
        place, after = place[often], seq[at[often] + 1]
        order = np.lexsort((after, place))
        place, after = place[order], after[order]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (after[1:] != after[:-1])
        place, after = place[new].astype(np.uint32), after[new]
        part = shard_of(after, parts)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        for i in np.flatnonzero(np.diff(cut)).tolist():
            mine = order[cut[i] : cut[i + 1]]
            yield common.from_columns(["part", "data"], [pa.array([i], pa.int32()), pa.array([packed(place[mine], after[mine])], pa.binary())])


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[bytes]] = defaultdict(list)
    for b in batches:
        for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held[i].append(data)
    for rows in held.values():
        place, after = (np.concatenate(x) for x in zip(*map(unpacked, rows), strict=True))
        order = np.lexsort((after, place))
        place, after = place[order], after[order]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (after[1:] != after[:-1])
        word, kinds = np.unique(place[new], return_counts=True)
        yield common.from_columns(["word", "kinds"], [pa.array(word.astype(np.int64)), pa.array(kinds.astype(np.int64))])


class Vocabulary:
    """Sums over the training tokens and the frequent words: for each, its
    count and its distinct successors."""

    def __init__(self, rows, shards: int):
        self.n, self.v = sum(r["n"] for r in rows), sum(r["v"] for r in rows)
        self.z = self.n + self.v + 1
        self.hot: dict[int, tuple[int, int]] = {}
        for r in rows:
            for w, c in zip(np.frombuffer(r["words"], np.uint64).tolist(), np.frombuffer(r["counts"], np.int64).tolist(), strict=True):
                if c > self.n / (4 * shards) and w != END_HASH:
                    self.hot[w] = (c, 0)
        self.hot_words = np.sort(np.fromiter(self.hot, np.uint64, len(self.hot)))

    def followed(self, rows) -> None:
        for r in rows:
            w = int(self.hot_words[r["word"]])
            self.hot[w] = (self.hot[w][0], r["kinds"])


def _answered(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """Build the trie of each shard and ask it for every block's n-grams."""
    held: dict[int, list[tuple[str, bytes]]] = defaultdict(list)
    for b in batches:
        for s, name, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            held[s].append((name, data))
    for s in sorted(held):
        rows = held.pop(s)
        w1, pair, count = [], [], []
        for _, data in rows:
            w, runs1, f2, runs2, f3, c = unpacked(data)
            keep = c > 0
            w1.append(np.repeat(np.repeat(w, runs1), runs2)[keep])
            pair.append((np.repeat(f2.astype(np.uint64), runs2) << np.uint64(32) | f3)[keep])
            count.append(c[keep])
        w, p, c = np.concatenate(w1), np.concatenate(pair), np.concatenate(count).astype(np.int64)
        w1.clear(), pair.clear(), count.clear()
        order = np.lexsort((p, w))
        w, p, c = w[order], p[order], c[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (p[1:] != p[:-1])
        at = np.flatnonzero(new)
        trie = NgramTrie(w[at], p[at], np.add.reduceat(c, at) if len(at) else c, vocabulary.hot)
        del w, p, c, order, new
        hot = vocabulary.hot_words
        hot_count = np.array([vocabulary.hot[w][0] for w in hot.tolist()], np.int64)
        hot_left = left_over(np.array([vocabulary.hot[w][1] for w in hot.tolist()], np.int64), hot_count)
        for name, data in rows:
            words, runs1, f2, runs2, f3, _ = unpacked(data)
            of1, of2 = np.repeat(np.arange(len(words)), runs1), np.repeat(np.arange(len(f2)), runs2)
            n, left1, share2, left2, share3 = trie.query(words, of1, f2, of2, f3)
            if len(hot):  # a frequent word none of whose successors are here
                place = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
                there = hot[place] == words
                n[there], left1[there] = hot_count[place[there]], hot_left[place[there]]
            answer = packed(n.astype(np.uint32) if not len(n) or n.max() < 1 << 32 else n, left1, runs1, share2, left2, runs2, share3)
            yield common.from_columns(["block", "shard", "data"], [pa.array([name]), pa.array([s], pa.int32()), pa.array([answer], pa.binary())])


def _scored(batches: Iterator[pa.RecordBatch], z: int, total: int, key: str) -> Iterator[pa.RecordBatch]:
    held: dict[str, dict[int, bytes]] = defaultdict(dict)
    lists: list[tuple[str, bytes]] = []  # equal blocks have one name and equal values
    for b in batches:
        for name, s, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if s < 0:
                lists.append((name, data))
            else:
                held[name][s] = data
    for name, listed in lists:
        rows = held[name]
        ids, n, out, low, high, expected = unpacked(listed)
        if sorted(rows) != expected:
            raise RuntimeError("a block's values are missing: its scan was not repeated alike")
        place = low.astype(np.int64) | high.astype(np.int64) << 16
        columns: list[list[np.ndarray]] = [[] for _ in range(5)]
        for s in expected:
            c, left1, runs1, share2, left2, runs2, share3 = unpacked(rows[s])
            for j, x in enumerate((np.repeat(np.repeat(c, runs1), runs2), np.repeat(np.repeat(left1, runs1), runs2), np.repeat(share2, runs2), np.repeat(left2, runs2), share3)):
                columns[j].append(x)
        c, left1, share2, left2, share3 = (np.concatenate(x) for x in columns)
        c = c[place].astype(np.float64)
        first = np.cumsum(n) - n
        base = (c + 1) / z
        two = base.copy()
        two[1:] = value_of(share2[place[:-1]]) + value_of(left1[place[:-1]]) * base[1:]
        two[first] = base[first]
        p = two.copy()
        p[2:] = value_of(share3[place[:-2]]) + value_of(left2[place[:-2]]) * two[2:]
        p[first] = base[first]
        second = first[n > 1] + 1
        p[second] = two[second]
        with np.errstate(divide="ignore"):
            sums = [np.add.reduceat(x, first) for x in ((c > 0).astype(np.int64), np.log10(base), np.log10(np.maximum(p, 1e-300)))]
        ids = pa.ipc.open_stream(ids).read_all().column(0).combine_chunks()
        yield common.from_columns([key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], [ids, pa.array(out), pa.array(n), pa.array(sums[0]), pa.array(np.full(len(n), total)), pa.array(sums[1]), pa.array(sums[2])])


def score_documents(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Learn from the rows that aren't held out and score all rows; the trie is
    in `shards` shards, by default one for each partition and SHARD_BYTES."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = shards or max(common.partitions_for(spark), math.ceil(size / SHARD_BYTES))
    found = rows.where("NOT held").mapInArrow(lambda b: _unigrams(b, shards), "shard int, data binary").repartition(shards, "shard")
    vocabulary = Vocabulary(found.mapInArrow(lambda b: _vocabulary(b, shards), "shard int, n long, v long, words binary, counts binary").collect(), shards)
    if len(vocabulary.hot_words):
        hot = vocabulary.hot_words
        pairs = rows.where("NOT held").mapInArrow(lambda b: _successors(b, hot, shards), "part int, data binary").repartition(shards, "part")
        # a row for each frequent word: at most four for each shard
        vocabulary.followed(pairs.mapInArrow(_kinds, "word long, kinds long").groupBy("word").agg(F.sum("kinds").alias("kinds")).collect())
    shared = spark.sparkContext.broadcast(vocabulary)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in blocks(batches):
            for s, data in Ngrams(block, shards, shared.value.hot_words).by_shard():
                yield common.from_columns(["shard", "block", "data"], [pa.array([s], pa.int32()), pa.array([name]), pa.array([data], pa.binary())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block in blocks(batches):
            g = Ngrams(block, shards, shared.value.hot_words)
            ids = pa.concat_arrays(block.ids)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("k", ids.type)])) as w:
                w.write_batch(pa.RecordBatch.from_arrays([ids], names=["k"]))
            data = packed(sink.getvalue().to_pybytes(), g.n, g.held, g.place.astype(np.uint16), (g.place >> 16).astype(np.uint16), np.unique(g.shard).tolist())
            yield common.from_columns(["block", "shard", "data"], [pa.array([name]), pa.array([-1], pa.int32()), pa.array([data], pa.binary())])

    ngrams = rows.mapInArrow(sent, "shard int, block string, data binary").repartition(shards, "shard")
    values = ngrams.mapInArrow(lambda b: _answered(b, shared.value), "block string, shard int, data binary")
    lists = rows.mapInArrow(listed, "block string, shard int, data binary")
    z, total = vocabulary.z, vocabulary.n
    return values.unionByName(lists).repartition(shards, "block").mapInArrow(lambda b: _scored(b, z, total, key), f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
