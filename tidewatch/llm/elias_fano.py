"""Elias-Fano sequences and a two-level n-gram trie over them, in one buffer that can be memory-mapped."""

from __future__ import annotations

import mmap
from typing import NamedTuple

import numpy as np


#: Questions that are answered at once; what a look-up takes besides the levels grows with this only.
AT_ONCE = 1 << 16
_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BYTE.sum(1).astype(np.uint8)
#: Place of the k-th set bit of each byte (8 where there is none).
_PLACE = np.stack([np.where(_ONES > k, ((np.cumsum(_BYTE, axis=1) == k + 1) & (_BYTE == 1)).argmax(1), 8) for k in range(8)], axis=1).astype(np.int64)


def bit_in_words(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each word."""
    parts = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)
    upto = np.cumsum(_ONES[parts], axis=1, dtype=np.int64)
    at = np.minimum((upto <= k[:, None]).sum(1), 7)
    rows = np.arange(len(at))
    before = np.where(at > 0, upto[rows, np.maximum(at - 1, 0)], 0)
    return 8 * at + _PLACE[parts[rows, at], k - before]


class EliasFano(NamedTuple):
    """A non-decreasing sequence: low bits packed, high bits in unary. About 2 + log2(largest / length) bits a value, and half
    a bit for the number of set bits before each word of the unary part, by which values are found without decoding others."""

    n: int
    low_bits: int
    lows: np.ndarray  # uint64 words
    highs: np.ndarray  # uint64 words of the unary bit vector
    ranks: np.ndarray  # uint32, set bits before each of these words

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        place = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(place[-1]) + 1 if n else 0) + 63 & ~63, np.uint8)
        bits[place] = 1
        highs = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = _ONES[highs.view(np.uint8)].reshape(-1, 8).sum(1, dtype=np.uint32)
        return cls(n, low_bits, pack(values & np.uint64((1 << low_bits) - 1), low_bits), highs, (np.cumsum(ones) - ones).astype(np.uint32))

    def nbytes(self) -> int:
        return self.lows.nbytes + self.highs.nbytes + self.ranks.nbytes

    def low(self, at: np.ndarray) -> np.ndarray:
        return bits_at(self.lows, self.low_bits, at)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at these places: the k-th set bit at place p stands for the high part p - k."""
        word = np.searchsorted(self.ranks, at, "right") - 1
        place = 64 * word + bit_in_words(self.highs[word], at - self.ranks[word])
        return ((place - at).astype(np.uint64) << np.uint64(self.low_bits)) | self.low(at)

    def bucket_ends(self, high: np.ndarray, zeros: np.ndarray) -> np.ndarray:
        """How many values have a high part of at most ``high``: what stands before the zero of that number. ``zeros`` are
        those before each word."""
        inside = high < 64 * len(self.highs) - self.n
        word = np.searchsorted(zeros, np.where(inside, high, 0), "right") - 1
        place = 64 * word + bit_in_words(~self.highs[word], np.where(inside, high, 0) - zeros[word])
        return np.where(inside, place - high, self.n)

    def find(self, values: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The place of each value, and whether it is there; looked for between ``first`` and ``last`` only, if given.

        The zeros around its high part bound a run of candidates, in which the low bits are searched by halves.
        """
        if not self.n:
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        zeros = 64 * np.arange(len(self.highs)) - self.ranks
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        low = values & np.uint64((1 << self.low_bits) - 1)
        start = np.where(high > 0, self.bucket_ends(np.maximum(high - 1, 0), zeros), 0)
        end = self.bucket_ends(high, zeros)
        if first is not None:
            start, end = np.maximum(start, first), np.minimum(end, last)
        stop = end
        for _ in range(int(np.max(end - start, initial=0)).bit_length()):
            middle = (start + end) >> 1
            less = (start < end) & (self.low(np.minimum(middle, self.n - 1)) < low)
            start, end = np.where(less, middle + 1, start), np.where(less, end, middle)
        at = np.minimum(start, self.n - 1)
        return at, (start < stop) & (self.low(at) == low)

    def decode(self) -> np.ndarray:
        """All values."""
        return self.get(np.arange(self.n)) if self.n else np.zeros(0, np.uint64)


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of so many bits in 64-bit words, one after the other."""
    if not bits or not len(values):
        return np.zeros(0, np.uint64)
    at = np.arange(len(values), dtype=np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    np.bitwise_or.at(out, word, values << shift)
    over = shift + np.uint64(bits) > np.uint64(64)
    np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


def bits_at(words: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    """The packed values at these places."""
    if not bits or not len(at):
        return np.zeros(len(at), np.uint64)
    at = at.astype(np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    out = words[word] >> shift
    over = np.flatnonzero(shift + np.uint64(bits) > np.uint64(64))
    out[over] |= words[word[over] + 1] << (np.uint64(64) - shift[over])
    return out & np.uint64((1 << bits) - 1)


#: Quantised log10 of probabilities: code 255 stands for 0, each code below it for a 1/32 less; 0 for none.
STEPS = 32.0


def quantise(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        codes = np.rint(255 + STEPS * np.log10(p))
    return np.where(p > 0, np.clip(codes, 1, 255), 0).astype(np.uint8)


PROBABILITY = np.where(np.arange(256) > 0, 10.0 ** ((np.arange(256) - 255) / STEPS), 0.0)


class Trie(NamedTuple):
    """Contexts, monotone pointers to their successors, and the successors, with a quantised value for each.

    Successors are sorted inside a context. To make the whole level monotone, each context's successors are shifted by
    its rank times ``span``, which is what a search relative to the context adds to the word it looks for.
    """

    span: int
    contexts: EliasFano
    pointers: EliasFano
    successors: EliasFano
    backoffs: np.ndarray  # a code per context
    values: np.ndarray  # a code per successor

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, value: np.ndarray, backoff: np.ndarray, span: int) -> Trie:
        """From distinct (context, word) in order, a code for each, and a code for each distinct context."""
        names, first = np.unique(context, return_index=True)
        rank = np.repeat(np.arange(len(names), dtype=np.uint64), np.diff(np.append(first, len(context))))
        return cls(span, EliasFano.of(names), EliasFano.of(np.append(first, len(context))), EliasFano.of(rank * np.uint64(span) + word), backoff, value)

    def search(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words after their contexts, and of the contexts; 0 where the trie has none.

        A context is found in its level, its pointers bound its successors, and the word is looked for among those, AT_ONCE
        questions at a time and without decoding a level.
        """
        values, backoffs = np.zeros(len(word), np.uint8), np.zeros(len(word), np.uint8)
        if not self.contexts.n:
            return values, backoffs
        for i in range(0, len(word), AT_ONCE):
            here = slice(i, i + AT_ONCE)
            rank, known = self.contexts.find(context[here])
            first, last = self.pointers.get(rank).astype(np.int64), self.pointers.get(rank + 1).astype(np.int64)
            at, hit = self.successors.find(rank.astype(np.uint64) * np.uint64(self.span) + word[here], first, last)
            values[here] = np.where(hit & known, self.values[at], 0)
            backoffs[here] = np.where(known, self.backoffs[rank], 0)
        return values, backoffs

    def to_bytes(self) -> bytes:
        parts: list[np.ndarray] = []
        head = [self.span]
        for level in (self.contexts, self.pointers, self.successors):
            head += [level.n, level.low_bits, len(level.lows), len(level.highs)]
            parts += [level.lows, level.highs, level.ranks]
        parts += [self.backoffs, self.values]
        head += [len(self.backoffs), len(self.values)]
        return np.array(head, np.uint64).tobytes() + b"".join(p.tobytes() + bytes(-p.nbytes % 8) for p in parts)

    @classmethod
    def from_buffer(cls, data) -> Trie:
        """A view of ``to_bytes`` output; nothing is copied."""
        head = np.frombuffer(data, np.uint64, 15).tolist()
        at = 15 * 8

        def view(kind, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes + -out.nbytes % 8
            return out

        levels = [EliasFano(n, bits, view(np.uint64, lows), view(np.uint64, highs), view(np.uint32, highs)) for n, bits, lows, highs in (head[i:i + 4] for i in (1, 5, 9))]
        return cls(head[0], *levels, view(np.uint8, head[13]), view(np.uint8, head[14]))

    @classmethod
    def open(cls, path: str) -> Trie:
        """A memory-mapped file."""
        with open(path, "rb") as f:
            return cls.from_buffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
