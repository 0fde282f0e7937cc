"""Texts of an Arrow batch as flat numpy arrays: words, their hashes, runs of words.

A block is a quarter of a megabyte of UTF-8 from whole texts, so the arrays below stay
small whatever a batch holds. One text longer than that is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_STEP, _STEP_BACK = 0xD6E8FEB86659FD93 | 1, pow(0xD6E8FEB86659FD93 | 1, -1, 1 << 64)


def white_words() -> np.ndarray:
    """Class of each byte: 0 for white space, else the byte itself."""
    table = np.arange(256, dtype=np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 0
    table[0] = 1  # a NUL is part of a word; equality is checked on the bytes
    return table


def plain_words() -> np.ndarray:
    """Class of each byte: lower-case letters, digits and all beyond ASCII; 0 for the rest."""
    table = np.zeros(256, np.uint8)
    for low, high in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
        table[low:high] = np.arange(low, high)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    h = h ^ np.uint64(seed)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the bases, grown as longer blocks come."""

    def __init__(self):
        self.held: dict[int, np.ndarray] = {}

    def __call__(self, base: int, n: int) -> np.ndarray:
        have = self.held.get(base)
        if have is None or len(have) < n:
            have = self.held[base] = _powers(base, max(n, 1 << 16))
            if n > 4 * BLOCK_BYTES:  # a very long text: do not keep them
                del self.held[base]
        return have[:n]


class Block:
    """Whole texts next to each other: bytes, and where each text ends."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, first: int, classes: np.ndarray, powers: _Powers):
        """ends: of n texts, n + 1 offsets from 0; first: the index of the first text in its batch."""
        self.data, self.ends, self.first, self.powers = data, ends, first, powers
        self.n = len(ends) - 1
        self.folded = classes[data]
        inside = self.folded > 0
        before = np.empty(len(data) + 1, bool)
        before[0] = before[-1] = False
        before[1:] = inside
        before[ends] = False
        after = np.empty(len(data) + 1, bool)
        after[:-1] = inside
        after[ends] = False
        self.starts = np.flatnonzero(inside & ~before[:-1])
        self.stops = np.flatnonzero(inside & ~after[1:]) + 1
        #: Words of text i are numbered bounds[i] to bounds[i + 1].
        self.bounds = np.searchsorted(self.starts, ends)
        self.counts = np.diff(self.bounds)

    def word_hashes(self) -> np.ndarray:
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.folded.astype(np.uint64) * self.powers(_BASE, n), out=sums[1:])
        h = (sums[self.stops] - sums[self.starts]) * self.powers(_BACK, n)[self.starts]
        return mix(h ^ (self.stops - self.starts).astype(np.uint64))

    def grams(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on; the last of a text run into the next text."""
        n = len(hashes)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self.powers(_STEP, n), out=sums[1:])
        if n < size:
            return np.zeros(0, np.uint64)
        return mix((sums[size:] - sums[: n - size + 1]) * self.powers(_STEP_BACK, n)[: n - size + 1])

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text."""
        return np.repeat(self.bounds[1:], self.counts) - np.arange(len(self.starts))

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words, each followed by one space; starts and stops there."""
        lengths = self.stops - self.starts
        at = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths + 1, out=at[1:])
        out = np.full(at[-1], 32, np.uint8)
        flat = ranges(at[:-1], lengths)
        out[flat] = self.data[ranges(self.starts, lengths)]
        return out, at[:-1], at[:-1] + lengths


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def portions(lengths: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive lengths whose sum is ``most`` at most, or of one."""
    sums, low = np.cumsum(lengths), 0
    while low < len(lengths):
        high = max(low + 1, int(np.searchsorted(sums, (sums[low - 1] if low else 0) + most, "right")))
        yield slice(low, high)
        low = high


def binaries(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Arrow binary values cut out of data."""
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data[ranges(starts, lengths)])])


def blocks(texts: pa.Array, classes: np.ndarray, powers: _Powers | None = None, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts (null as empty) in blocks of about ``most`` bytes."""
    texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    if not len(texts):
        return
    powers = powers or _Powers()
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        yield Block(flat[at[low] : at[high]], at[low : high + 1] - at[low], low, classes, powers)
        low = high


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of ``width`` values from each value on."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


Powers = _Powers
