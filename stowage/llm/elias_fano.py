"""Monotone sequences in Elias-Fano form and an n-gram trie of such levels, over any buffer (bytes or a memory map)."""

from __future__ import annotations

import mmap
import struct

import numpy as np

_U = np.uint64


def _select_in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th (from 0) set bit of each word."""
    at = np.zeros(len(word), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = word & _U((1 << width) - 1)
        n = np.bitwise_count(low)
        go = r >= n
        r = r - np.where(go, n, 0)
        word = np.where(go, word >> _U(width), low)
        at += go * width
    return at


class EliasFano:
    """A non-decreasing sequence below `universe`: low bits packed, high parts as unary gaps with a rank directory."""

    HEAD = struct.Struct("<qqqqq")  # n, universe, low bits per value, low words, high words

    def __init__(self, values: np.ndarray | None, universe: int = 0):
        if values is None:
            return
        values = np.asarray(values, np.uint64)
        self.n, self.universe = len(values), max(1, int(universe))
        self.width = max(0, (self.universe // max(1, self.n)).bit_length() - 1)
        low = np.zeros(self.n * self.width // 64 + 2, _U)
        if self.width and self.n:
            x = values & _U((1 << self.width) - 1)
            bit = np.arange(self.n, dtype=np.int64) * self.width
            word, shift = bit >> 6, (bit & 63).astype(_U)
            np.bitwise_or.at(low, word, x << shift)
            over = (bit & 63) + self.width > 64
            np.bitwise_or.at(low, word[over] + 1, x[over] >> (_U(64) - shift[over]))
        ones = (values >> _U(self.width)).astype(np.int64) + np.arange(self.n)
        bits = np.zeros((self.n + (self.universe >> self.width) + 2 + 63) // 64 * 64, np.uint8)
        bits[ones] = 1
        self.low, self.high = low, np.packbits(bits, bitorder="little").view("<u8")
        self._directory()

    def _directory(self) -> None:
        ones = np.bitwise_count(self.high)
        self.ones = np.concatenate([[0], np.cumsum(ones, dtype=np.int64)])
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    def dumps(self) -> bytes:
        return self.HEAD.pack(self.n, self.universe, self.width, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def over(cls, buffer, at: int) -> tuple[EliasFano, int]:
        self = cls(None)
        self.n, self.universe, self.width, lows, highs = cls.HEAD.unpack_from(buffer, at)
        at += cls.HEAD.size
        self.low = np.frombuffer(buffer, "<u8", lows, at)
        self.high = np.frombuffer(buffer, "<u8", highs, at + 8 * lows)
        self._directory()
        return self, at + 8 * (lows + highs)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), _U)
        bit = i * self.width
        word, shift = bit >> 6, (bit & 63).astype(_U)
        x = self.low[word] >> shift
        over = shift + _U(self.width) > _U(64)
        x[over] |= self.low[word[over] + 1] << (_U(64) - shift[over])
        return x & _U((1 << self.width) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, k, side="right") - 1
        return word * 64 + _select_in_word(~self.high[word], k - self.zeros[word])

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + _select_in_word(self.high[word], i - self.ones[word])
        return ((place - i).astype(_U) << _U(self.width)) | self._low(i)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x the number of values below it (the place of its successor), and whether it is there."""
        x = np.asarray(x, np.uint64)
        high, low = (x >> _U(self.width)).astype(np.int64), x & _U((1 << self.width) - 1)
        end = self._zero(high) - high
        at = np.zeros(len(x), np.int64)
        on = high > 0
        at[on] = self._zero(high[on] - 1) - (high[on] - 1)
        last = end.copy()
        todo = np.flatnonzero(at < last)
        while len(todo):  # halve each range of equal high parts
            mid = (at[todo] + last[todo]) >> 1
            below = self._low(mid) < low[todo]
            at[todo[below]] = mid[below] + 1
            last[todo[~below]] = mid[~below]
            todo = todo[at[todo] < last[todo]]
        hit = at < end
        hit[hit] = self._low(at[hit]) == low[hit]
        return at, hit


#: Codes of probabilities: -log10(p) in steps of 1/512, rounded up, so that coded probabilities never add up to more.
STEP = 512
NONE = 0xFFFF


def encode(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        code = np.ceil(-np.log10(p) * STEP - 1e-9)
    return np.where(p > 0, np.clip(code, 0, NONE - 1), NONE).astype("<u2")


def decode(code: np.ndarray) -> np.ndarray:
    return np.where(code == NONE, 0.0, 10.0 ** (-code.astype(np.float64) / STEP))


class Trie:
    """Two levels: contexts, and the words that follow them with their quantised probabilities.

    Level 1 is the sorted contexts and, per context, a pointer to its range in level 2. Level 2 is one monotone sequence: a
    context's followers rise within its range, and each range starts one above the last value of the range before. A
    lookup finds the context, reads its range from the pointers, and searches the successor of the word, relative to the
    range's start, inside the range.
    """

    def __init__(self, context: np.ndarray, word: np.ndarray, p: np.ndarray):
        """Sorted distinct pairs with probabilities."""
        new = np.concatenate([[True], context[1:] != context[:-1]]) if len(context) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(context)) - 1 if len(first) else first
        start = np.concatenate([[0], np.cumsum(word[last].astype(np.int64) + 1)]).astype(_U)
        self.contexts = EliasFano(context[first], int(context[-1]) + 1 if len(context) else 1)
        self.pointers = EliasFano(np.append(first, len(context)), len(context) + 1)
        self.followers = EliasFano(start[np.cumsum(new) - 1] + word.astype(_U), int(start[-1]) + 1)
        self.p = encode(p)

    def dumps(self) -> bytes:
        return b"".join([struct.pack("<q", len(self.p)), self.contexts.dumps(), self.pointers.dumps(), self.followers.dumps(), self.p.tobytes()])

    @classmethod
    def over(cls, buffer) -> Trie:
        self = cls.__new__(cls)
        (n,) = struct.unpack_from("<q", buffer)
        self.contexts, at = EliasFano.over(buffer, 8)
        self.pointers, at = EliasFano.over(buffer, at)
        self.followers, at = EliasFano.over(buffer, at)
        self.p = np.frombuffer(buffer, "<u2", n, at)
        return self

    def mapped(self) -> Trie:
        """The same trie over an anonymous memory map."""
        raw = self.dumps()
        space = mmap.mmap(-1, len(raw))
        space[:] = raw
        return Trie.over(space)

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of the pairs, NONE where a pair isn't there."""
        p = np.full(len(context), NONE, "<u2")
        if not len(self.p) or not len(context):
            return p
        context, word = np.asarray(context, _U), np.asarray(word, _U)
        new = np.concatenate([[True], context[1:] != context[:-1]])
        run = np.cumsum(new) - 1  # equal neighbours are looked up once
        asked = context[new]
        inside = np.flatnonzero(asked < _U(self.contexts.universe))
        r, there = self.contexts.find(asked[inside])
        r, inside = r[there], inside[there]
        first, end = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        start = np.zeros(len(asked), _U)
        first[inside], end[inside] = self.pointers.get(r).astype(np.int64), self.pointers.get(r + 1).astype(np.int64)
        later = inside[first[inside] > 0]
        start[later] = self.followers.get(first[later] - 1) + _U(1)
        target = start[run] + word
        at = np.flatnonzero((end[run] > 0) & (target < _U(self.followers.universe)))
        place, hit = self.followers.find(target[at])
        hit &= place < end[run[at]]
        p[at[hit]] = self.p[place[hit]]
        return p
