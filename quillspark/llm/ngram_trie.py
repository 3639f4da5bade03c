"""An n-gram trie of three levels with Elias-Fano pointers.

Level 1 holds the words (64-bit hashes, Elias-Fano coded), level 2 the
successors of each word and level 3 the successors of each word pair, as 32-bit
word fingerprints. A context's successors stand together and rise. Where they
begin is a pointer for each context; the pointers rise too and are Elias-Fano coded.
With each entry go quantised smoothed values (absolute discounting, interpolated):

* level 2: the discounted share of the pair, and the weight that its context
  leaves to the next lower level;
* level 3: the same for the triple and its pair.

A query walks down: find the word, follow its pointer and the next one to its
successors, seek the fingerprint among these, and do the same from
the pair. Levels are in memory maps and are read where they lie; besides the coded
numbers there is a count of ones for each 64 bits of the unary parts, by which the
i-th one or zero is found.
"""

from __future__ import annotations

import mmap

import numpy as np

DISCOUNT = 0.75
#: Fingerprints that are no word: nothing follows; the end of the text.
NONE, END = 0, 1
LEAST_LOG, LOGS = -12.0, 14.0
CODES = 65533


def quantised(x: np.ndarray) -> np.ndarray:
    """16-bit codes, equal steps of the logarithm; 0 stands for 0."""
    with np.errstate(divide="ignore"):
        code = 1 + np.rint((np.log10(x) - LEAST_LOG) / LOGS * CODES)
    return np.where(x > 0, np.clip(code, 1, CODES + 1), 0).astype(np.uint16)


def value_of(code: np.ndarray) -> np.ndarray:
    return np.where(code == 0, 0.0, 10.0 ** ((code.astype(np.float64) - 1) / CODES * LOGS + LEAST_LOG))


def mapped(a: np.ndarray) -> np.ndarray:
    """The array in a memory map of its own."""
    if not a.nbytes:
        return a
    place = mmap.mmap(-1, a.nbytes)
    place[:] = a.tobytes()
    return np.frombuffer(place, a.dtype)


class Bits:
    """Bits in 64-bit words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        raw = np.packbits(bits, bitorder="little")
        words = np.concatenate([raw, np.zeros(8 - len(raw) % 8, np.uint8)]).view(np.uint64)
        self.words = mapped(words)
        self.ones = mapped(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.uint32))

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.ones.nbytes

    def _within(self, w: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The place of the r-th one of each word, by halving."""
        at = np.zeros(len(w), np.int64)
        for s in (32, 16, 8, 4, 2, 1):
            low = w & np.uint64((1 << s) - 1)
            n = np.bitwise_count(low).astype(np.int64)
            up = r >= n
            r = np.where(up, r - n, r)
            at += np.where(up, s, 0)
            w = np.where(up, w >> np.uint64(s), low)
        return at

    def one(self, i: np.ndarray) -> np.ndarray:
        """The place of the i-th one, from 0."""
        k = np.searchsorted(self.ones, i.astype(np.uint32), side="right") - 1
        return k * 64 + self._within(self.words[k], i - self.ones[k].astype(np.int64))

    def zero(self, i: np.ndarray) -> np.ndarray:
        """The place of the i-th zero, from 0."""
        lo, hi = np.zeros(len(i), np.int64), np.full(len(i), len(self.words), np.int64)
        while (hi - lo > 1).any():  # the last word with no more than i zeros before it
            mid = (lo + hi) >> 1
            few = mid * 64 - self.ones[np.minimum(mid, len(self.words) - 1)].astype(np.int64) <= i
            lo, hi = np.where(few, mid, lo), np.where(few, hi, mid)
        return lo * 64 + self._within(~self.words[lo], i - (lo * 64 - self.ones[lo].astype(np.int64)))


class EliasFano:
    """A rising sequence of numbers below 2**63: low bits packed, high parts in unary."""

    def __init__(self, values: np.ndarray):
        values = values.astype(np.uint64)
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low_bits = max(0, (top // max(1, self.n)).bit_length() - 1)
        low = values & np.uint64((1 << self.low_bits) - 1)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        self.last = top >> self.low_bits
        bits = np.zeros(self.last + 1 + self.n, np.uint8)
        bits[high + np.arange(self.n)] = 1
        self.unary = Bits(bits)
        packed = self._packed(low, self.low_bits) if self.low_bits else np.zeros(0, np.uint8)
        self._bytes = len(packed)
        self._low = mapped(np.concatenate([packed, np.zeros(16, np.uint8)]))

    @staticmethod
    def _packed(low: np.ndarray, width: int) -> np.ndarray:
        """The low bits in slices, to hold memory down."""
        step = 8 * 32_768
        out = [np.packbits((low[i : i + step, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little") for i in range(0, len(low), step)]
        return np.concatenate(out) if out else np.zeros(0, np.uint8)

    @property
    def nbytes(self) -> int:
        return self.unary.nbytes + self._bytes

    def low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.uint64)
        first = at.astype(np.int64) * self.low_bits
        # every byte offset as the start of a 64-bit word
        words = np.ndarray((self._bytes + 1,), "<u8", self._low, 0, (1,))
        byte, shift = first >> 3, (first & 7).astype(np.uint64)
        out = words[byte] >> shift
        if self.low_bits > 56:
            out |= np.where(shift > 0, self._low[byte + 8].astype(np.uint64) << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
        return out & np.uint64((1 << self.low_bits) - 1)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The entries at these places: an entry's high part is the number of zeros before its one."""
        at = at.astype(np.int64)
        return ((self.unary.one(at) - at).astype(np.uint64) << np.uint64(self.low_bits)) | self.low(at)

    def _from(self, high: np.ndarray) -> np.ndarray:
        """How many entries have a smaller high part; a zero ends each part."""
        out = np.full(len(high), self.n, np.int64)
        out[high <= 0] = 0
        some = (high > 0) & (high <= self.last)
        h = high[some] - 1
        out[some] = self.unary.zero(h) - h
        return out

    def seek(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x, the place of its successor (first entry >= x), and
        whether that equals x."""
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        low = x & np.uint64((1 << self.low_bits) - 1)
        at = self._from(high)
        end = self._from(high + 1)
        return sought(self.low, at, end, low)


def sought(value_at, at: np.ndarray, end: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the first value >= x within [at, end), where values rise,
    and whether it is x."""
    at, to = at.copy(), end.copy()
    todo = np.flatnonzero(at < to)
    while len(todo):  # halve: frequent contexts have many
        mid = (at[todo] + to[todo]) >> 1
        less = value_at(mid) < x[todo]
        at[todo[less]], to[todo[~less]] = mid[less] + 1, mid[~less]
        todo = todo[at[todo] < to[todo]]
    found = np.zeros(len(x), bool)
    here = np.flatnonzero(at < end)
    found[here] = value_at(at[here]) == x[here]
    return at, found


class Successors:
    """A level: the fingerprints that follow each context of the level above,
    and where each context's begin."""

    def __init__(self, owner: np.ndarray, prints: np.ndarray, contexts: int):
        self.first = EliasFano(np.searchsorted(owner, np.arange(contexts + 1)))
        self.prints = mapped(prints.astype(np.uint32))

    @property
    def nbytes(self) -> int:
        return self.first.nbytes + self.prints.nbytes

    def seek(self, context: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each fingerprint among its context's successors, and whether it is one."""
        # contexts come in runs, and each is followed once
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        one, run = context[new], np.cumsum(new) - 1
        ends = self.first.get(np.concatenate([one, one + 1])).astype(np.int64)
        return sought(lambda at: self.prints[at], ends[: len(one)][run], ends[len(one) :][run], prints.astype(np.uint32))


def left_over(kinds: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Codes of the weight that contexts leave to the next lower level."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return quantised(np.where(tokens > 0, DISCOUNT * kinds / tokens, 1.0))


def _runs(new: np.ndarray) -> np.ndarray:
    return np.flatnonzero(new)


class NgramTrie:
    """Built from sorted distinct rows (w1, fp2 << 32 | fp3) with counts.

    `hot` gives the whole count of the words whose successors are spread over
    several tries, and how many distinct successors they have in all of them.
    """

    def __init__(self, w1: np.ndarray, pair: np.ndarray, count: np.ndarray, hot: dict[int, tuple[int, int]]):
        n = len(w1)
        new1 = np.ones(n, bool)
        new1[1:] = w1[1:] != w1[:-1]
        fp2 = pair >> np.uint64(32)
        new2 = new1.copy()
        new2[1:] |= fp2[1:] != fp2[:-1]
        at1, at2 = _runs(new1), _runs(new2)
        words = w1[at1]
        c1 = np.add.reduceat(count, at1) if n else np.zeros(0, np.int64)
        rank1 = np.cumsum(new1) - 1
        c2 = np.add.reduceat(count, at2) if n else np.zeros(0, np.int64)
        is2 = fp2[at2] != NONE
        rank2of = rank1[at2][is2]
        self.level2 = Successors(rank2of, fp2[at2][is2], len(words))
        c2 = c2[is2]
        rank2 = np.cumsum(is2) - 1  # of each run of at2
        fp3 = pair & np.uint64(0xFFFFFFFF)
        is3 = fp3 != NONE
        owner = rank2[(np.cumsum(new2) - 1)[is3]]
        self.level3 = Successors(owner, fp3[is3], len(c2))
        c3 = count[is3]
        n1, n2 = np.bincount(rank2of, minlength=len(words)), np.bincount(owner, minlength=len(c2))
        self.count, context = c1.copy(), np.bincount(rank2of, c2, len(words)).astype(np.int64)
        spread = np.flatnonzero(np.isin(words, np.fromiter(hot, np.uint64, len(hot))))
        for i in spread.tolist():  # every word but the end has a successor
            self.count[i], n1[i] = hot[int(words[i])]
            context[i] = self.count[i]
        self.left1 = left_over(n1, context)
        self.share2 = quantised((c2 - DISCOUNT) / np.maximum(context[rank2of], 1))
        context2 = np.bincount(owner, c3, len(c2))
        self.left2 = left_over(n2, context2)
        self.share3 = quantised((c3 - DISCOUNT) / np.maximum(context2[owner], 1) if len(c3) else np.zeros(0))
        # level 1: 64-bit hashes lose their last bit to fit the coder
        self.level1 = EliasFano(words >> np.uint64(1))
        self.one = quantised(np.array([1.0]))[0]

    def query(self, words: np.ndarray, of1: np.ndarray, fp2: np.ndarray, of2: np.ndarray, fp3: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Counts and left-over codes of `words`; share and left-over codes of
        the pairs (words[of1], fp2); share codes of (pairs[of2], fp3)."""
        at1, known1 = self.level1.seek(words >> np.uint64(1))
        count, left1 = np.zeros(len(words), np.int64), np.full(len(words), self.one, np.uint16)
        count[known1], left1[known1] = self.count[at1[known1]], self.left1[at1[known1]]
        share2, left2 = np.zeros(len(fp2), np.uint16), np.full(len(fp2), self.one, np.uint16)
        ok = np.flatnonzero(known1[of1])
        at, hit = self.level2.seek(at1[of1[ok]], fp2[ok])
        pairs, at2 = ok[hit], np.full(len(fp2), -1, np.int64)
        at2[pairs] = at[hit]
        share2[pairs], left2[pairs] = self.share2[at[hit]], self.left2[at[hit]]
        share3 = np.zeros(len(fp3), np.uint16)
        ok = np.flatnonzero(at2[of2] >= 0)
        at, hit = self.level3.seek(at2[of2[ok]], fp3[ok])
        share3[ok[hit]] = self.share3[at[hit]]
        return count, left1, share2, left2, share3
