"""Static binary-fuse filters of three segments, built and probed with numpy.

After the published construction (Graf and Lemire, 2022): each key has a cell
in each of three neighbouring segments, the key graph is peeled, and the
cells are filled in reverse so that the three cells of a key xor to its
fingerprint. A key that was put in is always found; another one is found with
a chance of 2**-16.
"""

from __future__ import annotations

import math

import numpy as np


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys ^ np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def shape(n: int) -> tuple[int, int]:
    """Length and number of the segments for n keys."""
    n = max(n, 4)
    length = min(1 << 18, 1 << int(math.log(n) / math.log(3.33) + 2.25))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    return length, max(1, math.ceil(n * factor / length) - 2)


def cells(keys: np.ndarray, seed: int, length: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The three cells and the fingerprint of each key."""
    h = _mixed(keys, seed)
    first = ((h >> np.uint64(32)) * np.uint64(length * count)) >> np.uint64(32)
    mask = np.uint64(length - 1)
    at = np.stack([first, (first + np.uint64(length)) ^ ((h >> np.uint64(18)) & mask), (first + np.uint64(2 * length)) ^ (h & mask)], axis=1)
    return at.astype(np.int64), (_mixed(h, 0x9E3779B97F4A7C15) & np.uint64(0xFFFF)).astype(np.uint16)


def build(keys: np.ndarray, tries: int = 64) -> tuple[int, int, int, np.ndarray]:
    """Seed, segment length, segment count and cells of a filter over the keys."""
    keys = np.unique(keys.astype(np.uint64))
    length, count = shape(len(keys))
    for seed in range(1, tries + 1):
        at, prints = cells(keys, seed, length, count)
        order = _peeled(at, (count + 2) * length)
        if order is None:
            count += max(1, count // 16)  # a little more room for the next try
            continue
        table = np.zeros((count + 2) * length, np.uint16)
        for some, cell in reversed(order):
            table[cell] = prints[some] ^ table[at[some, 0]] ^ table[at[some, 1]] ^ table[at[some, 2]]
        return seed, length, count, table
    raise ValueError(f"no filter over {len(keys)} keys after {tries} tries")


def _peeled(at: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, own cells); a round's cells hold no other key left."""
    n = len(at)
    degree = np.bincount(at.ravel(), minlength=size)
    held = np.zeros(size, np.int64)
    np.bitwise_xor.at(held, at.ravel(), np.repeat(np.arange(n), 3))
    order, done, alone = [], 0, np.flatnonzero(degree == 1)
    while len(alone):
        some, first = np.unique(held[alone], return_index=True)
        order.append((some, alone[first]))
        done += len(some)
        touched = at[some].ravel()
        np.subtract.at(degree, touched, 1)
        np.bitwise_xor.at(held, touched, np.repeat(some, 3))
        touched = np.unique(touched)
        alone = touched[degree[touched] == 1]
    return order if done == n else None


def probe(keys: np.ndarray, seed: int, length: int, count: int, table: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter."""
    at, prints = cells(keys.astype(np.uint64), seed, length, count)
    return (table[at[:, 0]] ^ table[at[:, 1]] ^ table[at[:, 2]]) == prints
