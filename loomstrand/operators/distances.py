"""Distances between k-mer profiles (contig_id, counts): total variation and chi-squared."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.sequences import K
from ..scratch import Scratch
from .blocks import BLOCK_ROWS, block_pairs, dealt
from .kmers import _reverse_number

#: Percentiles of the distance report; fixed values.
DISTANCE_POINTS = (0.0025, 0.005, 0.01, 0.05, 0.1, 0.5, 0.99, 0.999)
#: Cells in which values are counted for percentiles.
CELLS = 100_000
#: Sums under this are no evidence, and expected counts are no less than FLOOR; fixed values.
EMPTY, FLOOR = 0.5, 0.01
#: Contigs of a block whose links are counted and joined, at most, and rows of it that are looked at together.
LINK_ROWS, STRIP = 4096, 256
#: Features of a count, at most; the part of a count's own term that they may leave; undecided pairs of a strip, one of so many, from which on features decide.
PIVOTS, LEFT, DENSE = 14, 1e-4, 16
#: Products that are summed in single precision without a break.
PART = 512
#: Neighbouring shares that are summed for a first lower bound of a distance, and what rounding may add to it.
COARSE, ROUNDING = 16, 1e-9
#: Rows of 256 shares that are compared with one at a time.
NEAR = 128
#: Decimals of a distance. Sums of 256 shares differ by 1e-14 with their order, and distances of contigs
#: of under 300,000 bases lie on a threshold or 2e-13 off it at least: rounded, a distance that equals a threshold is not under it.
DECIMALS = 13


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    return table[column].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(table), -1) if len(table) else np.zeros((0, 0))


def _ordered(a: list, b: list, i: np.ndarray, j: np.ndarray, same: bool) -> tuple[list, list]:
    left, right = [a[x] for x in i], [b[y] for y in j]
    return [min(x, y) for x, y in zip(left, right, strict=True)], [max(x, y) for x, y in zip(left, right, strict=True)]


def _variation(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of ``p`` to the rows of ``y``, NEAR of them at a time: these stay in the processor's cache."""
    out, held = np.empty(len(y)), np.empty((min(NEAR, len(y)), y.shape[1]))
    for low in range(0, len(y), NEAR):
        own = held[: min(NEAR, len(y) - low)]
        np.subtract(y[low : low + NEAR], p, out=own)
        np.abs(own, out=own)
        own.sum(1, out=out[low : low + NEAR])
    return np.round(out / 2, DECIMALS)


def _rounded(d: np.ndarray, digits: int) -> np.ndarray:
    """Distances, of DECIMALS decimals, rounded half up as decimals: by whole numbers, no half is lost."""
    part = 10 ** (DECIMALS - digits)
    return ((np.rint(d * 10.0**DECIMALS).astype(np.int64) + part // 2) // part) / 10.0**digits


def _all_variation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of two blocks, as half of both sums less the sum of the smaller shares: fewer passes than ``_variation``."""
    out, held, ones = np.empty((len(x), len(y))), np.empty_like(y), np.ones(y.shape[1])
    for i, p in enumerate(x):
        np.minimum(y, p, out=held)
        np.dot(held, ones, out=out[i])
    out *= -1
    out += (x.sum(1) / 2)[:, None]
    out += y.sum(1) / 2
    return np.round(np.maximum(out, 0, out=out), DECIMALS, out=out)


def every_variation(shares: DataFrame, digits: int) -> DataFrame:
    """``variation_pairs`` of all pairs with dist rounded to ``digits``, as ``F.round`` does it, where it is taken."""
    kind = shares.schema["contig_id"].dataType

    def run(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        left, right = left.sort_by("contig_id"), right.sort_by("contig_id")
        x, y = _matrix(left, "p"), _matrix(right, "p")
        names = pa.chunked_array([*left["contig_id"].chunks, *right["contig_id"].chunks], to_arrow_type(kind)).combine_chunks()
        values = names.to_pylist()
        if not len(x) or not len(y):
            return pa.table({"a": names[:0], "b": names[:0], "dist": pa.array([], pa.float64())})
        d = _rounded(_all_variation(x, y), digits)
        if same:
            i, j = np.triu_indices(len(x), 1)
            d = d[i, j]
        else:
            i, j, d = np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x)), d.ravel()
        rank = np.empty(len(values), np.int64)
        rank[sorted(range(len(values)), key=values.__getitem__)] = np.arange(len(values))
        j = j + len(x)
        turned = rank[i] > rank[j]
        return pa.table({"a": names.take(pa.array(np.where(turned, j, i))), "b": names.take(pa.array(np.where(turned, i, j))), "dist": pa.array(d)})

    name = kind.simpleString()
    return block_pairs(shares.select("contig_id", "p"), shares.count(), "contig_id", run, f"a {name}, b {name}, dist double")


def variation_kernel(below: float | None, inclusive: bool = False, column: str = "p"):
    """Pairs (a, b, dist) of two blocks with dist under ``below``."""

    def run(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        x, y = _matrix(left, column), _matrix(right, column)
        names, kind = [*left["contig_id"].to_pylist(), *right["contig_id"].to_pylist()], left["contig_id"].type
        rank = np.empty(len(names), np.int64)
        rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        firsts, seconds, dists = [], [], []
        for i in range(len(x) if len(y) else 0):
            first = i + 1 if same else 0
            d = _variation(x[i], y[first:])
            j = np.arange(len(d)) if below is None else np.flatnonzero(d <= below if inclusive else d < below)
            firsts.append(np.full(len(j), i))
            seconds.append(j + first + len(x))
            dists.append(d[j])
        i, j, d = (np.concatenate([np.zeros(0, t), *parts]) for t, parts in ((np.int64, firsts), (np.int64, seconds), (np.float64, dists)))
        turned, table = rank[i] > rank[j], pa.array(names, kind)
        return pa.table({"a": table.take(pa.array(np.where(turned, j, i))), "b": table.take(pa.array(np.where(turned, i, j))), "dist": pa.array(d)})

    return run


def variation_pairs(shares: DataFrame, below: float | None = None, inclusive: bool = False) -> DataFrame:
    """(a, b, dist) with a < b of rows (contig_id, p array), those closer than ``below`` (None: all)."""
    kind = shares.schema["contig_id"].dataType.simpleString()
    return block_pairs(shares.select("contig_id", "p"), shares.count(), "contig_id", variation_kernel(below, inclusive), f"a {kind}, b {kind}, dist double")


def _coarse(x: np.ndarray) -> np.ndarray:
    """Sums of COARSE neighbouring shares: half the difference of two rows' sums is no more than their distance."""
    return np.add.reduceat(x, np.arange(0, x.shape[1], COARSE), axis=1) if x.size else np.zeros((len(x), 1))


def _maybe(p: np.ndarray, y: np.ndarray, most: float) -> np.ndarray:
    """Which rows of sums may be as close to ``p`` as ``most``."""
    return np.abs(y - p).sum(1) <= 2 * most + ROUNDING


def _joined(x: np.ndarray, y: np.ndarray, of_x: np.ndarray, of_y: np.ndarray, labels: int, below: float, same: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The group of each label, and the links (label, label) that made them: labels are joined as soon as a row of ``x`` and one of ``y``
    are closer than ``below``. Every pair of rows is compared unless its labels are in one group by then, so the groups are those of all pairs."""
    group, links, last = np.arange(labels), [], None
    sums_x, sums_y = _coarse(x), _coarse(y)
    sizes = np.bincount(of_x, minlength=labels)
    for i in np.arange(len(x)) if same else np.argsort(-sizes[of_x], kind="stable"):
        own = group[of_x[i]]
        if last != (own, len(links)):
            last = own, len(links)
            others = np.flatnonzero(group[of_y] != own)
            sums = sums_y[others]
        # of one block, earlier rows have been compared with this one
        first = np.searchsorted(others, i) if same else 0
        near = others[first:][_maybe(sums_x[i], sums[first:], below)]
        if not len(near):
            continue
        found = np.unique(group[of_y[near[_variation(x[i], y[near]) < below]]])
        if len(found):
            links.extend((int(own), int(g)) for g in found)
            group[np.isin(group, found)] = own
    return group, links


def variation_links(scratch: Scratch, rows: DataFrame, below: float, tag: str = "near") -> DataFrame:
    """Links (a, b) with the components of all pairs of rows (node: long, p array) closer than ``below``, at most a few for a row.

    Components within a block come first; then rows of two blocks are compared only while they are in different ones.
    """
    n = rows.count()
    block = min(LINK_ROWS, max(256, -(-n // 12)))

    def within(group: pa.Table) -> pa.Table:
        x, node = _matrix(group, "p"), group["node"].to_numpy()
        names, of = np.unique(node, return_inverse=True)
        found, _ = _joined(x, x, of, of, len(names), below, True)
        least = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(least, found, names)
        return group.select(["node", "p"]).append_column("root", pa.array(least[found[of]], pa.int64()))

    def across(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        links = []
        if not same and len(left) and len(right):
            names, of = np.unique(np.concatenate([t["root"].to_numpy() for t in (left, right)]), return_inverse=True)
            _, links = _joined(_matrix(left, "p"), _matrix(right, "p"), of[: len(left)], of[len(left) :], len(names), below, False)
            links = names[np.array(links, np.int64).reshape(-1, 2)].tolist()
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    blocks, own = dealt("node", n, block)
    rows = rows.select(F.col("node").cast("long").alias("node"), "p").withColumn("own_block", own)
    held = scratch.write(rows.groupBy("own_block").applyInArrow(lambda g: within(g), "node long, p array<double>, root long"), f"{tag}-blocks")
    links = held.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    if blocks > 1:
        links = links.unionByName(block_pairs(held, n, "node", across, "a long, b long", block))
    return scratch.write(links, f"{tag}-links")


def nearest_variation(rows: DataFrame, most: float) -> DataFrame:
    """(contig_id, bin) of the rows (contig_id, bin, p array) without a bin: that of the nearest row with one, if it is at most ``most`` away,
    ties to the smaller contig_id. Blocks of open rows meet blocks of binned ones, and send on one row for each open row."""
    kind, number = (rows.schema[c].dataType.simpleString() for c in ("contig_id", "bin"))
    size = rows.agg(F.count("bin").alias("binned"), F.count("*").alias("all")).first()
    size_of = {"binned": size["binned"], "open": size["all"] - size["binned"]}
    if not all(size_of.values()):
        return rows.sparkSession.createDataFrame([], f"contig_id {kind}, bin {number}")
    (n_binned, binned), (n_open, open_) = (dealt("contig_id", n, min(LINK_ROWS, max(256, -(-n // 24)))) for n in (size_of["binned"], size_of["open"]))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.select("contig_id", "bin", "p")
    met = rows.where("bin is not null").withColumn("i", binned).withColumn("j", every(n_open))
    met = met.unionByName(rows.where("bin is null").withColumn("i", every(n_binned)).withColumn("j", open_))

    def run(group: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        left, right = group.filter(pc.is_null(group["bin"])), group.filter(pc.is_valid(group["bin"])).sort_by("contig_id")
        x, y = _matrix(left, "p"), _matrix(right, "p")
        sums_x, sums_y, found = _coarse(x), _coarse(y), []
        for i in range(len(x) if len(y) else 0):
            near = np.flatnonzero(_maybe(sums_x[i], sums_y, most))
            if len(near):
                d = _variation(x[i], y[near])
                k = d.argmin()
                if d[k] <= most:
                    found.append((i, near[k], d[k]))
        i, j = (pa.array([f[c] for f in found], pa.int64()) for c in (0, 1))
        return pa.table({"contig_id": left["contig_id"].take(i), "bin": right["bin"].take(j), "b": right["contig_id"].take(j), "dist": pa.array([f[2] for f in found], pa.float64())})

    found = met.groupBy("i", "j").applyInArrow(lambda g: run(g), f"contig_id {kind}, bin {number}, b {kind}, dist double")
    return found.groupBy("contig_id").agg(F.min_by("bin", F.struct("dist", "b")).alias("bin"))


def sparse_variation_pairs(counts: DataFrame) -> DataFrame:
    """(a, b, dist) with a < b of pairs that share a k-mer, from (contig_id, kmer, p): one less the sum of the smaller shares."""
    left = counts.select(F.col("contig_id").alias("a"), "kmer", F.col("p").alias("pa"))
    right = counts.select(F.col("contig_id").alias("b"), "kmer", F.col("p").alias("pb"))
    return left.join(right, "kmer").where("a < b").groupBy("a", "b").agg((1 - F.sum(F.least("pa", "pb"))).alias("dist"))


def chi_squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Statistic of the two-column tables of profile ``a`` with each row of ``b``."""
    size_a, size_b = a.sum(), b.sum(1)
    rows = a + b
    total = np.maximum(size_a + size_b, 1e-300)[:, None]
    out = np.zeros(len(b))
    for own, size in ((np.broadcast_to(a, b.shape), np.broadcast_to(size_a, size_b.shape)), (b, size_b)):
        expected = rows * size[:, None] / total
        part = np.where(rows < EMPTY, 0, (own - expected) ** 2 / np.maximum(FLOOR, expected)).sum(1)
        out += np.where(size < EMPTY, 0, part)
    return out


def chi_squared_kernel(most: float | None, k: int = K):
    """Pairs (a, b, chi, chi_reverse) whose smaller statistic is at most ``most``."""
    order = [_reverse_number(i, k) for i in range(4**k)]

    def run(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        x, y = _matrix(left, "counts"), _matrix(right, "counts")
        kind = left["contig_id"].type
        ids = left["contig_id"].to_pylist(), right["contig_id"].to_pylist()
        out: tuple[list, list, list, list] = ([], [], [], [])
        for i in range(len(x)):
            forward, backward = chi_squared(x[i], y), chi_squared(x[i], y[:, order])
            keep = np.ones(len(y), bool) if most is None else np.minimum(forward, backward) <= most
            if same:
                keep[: i + 1] = False
            j = np.flatnonzero(keep)
            lows, highs = _ordered(ids[0], ids[1], np.full(len(j), i), j, same)
            for held, new in zip(out, (lows, highs, forward[j].tolist(), backward[j].tolist()), strict=True):
                held.extend(new)
        return pa.table({"a": pa.array(out[0], kind), "b": pa.array(out[1], kind), "chi": pa.array(out[2], pa.float64()), "chi_reverse": pa.array(out[3], pa.float64())})

    return run


def chi_squared_pairs(profiles: DataFrame, most: float | None = None, k: int = K) -> DataFrame:
    """(a, b, chi, chi_reverse) of rows (contig_id, counts): either orientation may be similar."""
    kind = profiles.schema["contig_id"].dataType.simpleString()
    return block_pairs(profiles.select("contig_id", "counts"), profiles.count(), "contig_id", chi_squared_kernel(most, k), f"a {kind}, b {kind}, chi double, chi_reverse double")


def _bounds(a: np.ndarray, b: np.ndarray, most: float, off: float) -> tuple[np.ndarray, np.ndarray]:
    """From which sum(sqrt(pq)) of the shares on a pair's statistic is surely at most ``most``, and under which it surely is not, where
    that sum is wrong by at most ``off``; of the profiles' sums. With r = a + b the statistic is sum(AB (p - q) ** 2 / (Ap + Bq)),
    that is min(A, B) h at least and (A + B) h at most, by Cauchy's inequality, of h = sum((sqrt p - sqrt q) ** 2) = 2 - 2 sum(sqrt(pq))."""
    total, least = a + b, np.minimum(a, b)
    slack = 1e-3 + 1e-12 * total
    sure, may = 1 - (most - slack) / np.maximum(total, 1) / 2 + off, 1 - (most + slack) / np.maximum(least, 1e-3) / 2 - off
    return sure.astype(np.float32), may.astype(np.float32)


class Harmonic:
    """sum(ab / (a + b)) of two profiles of counts as a scalar product of features, wrong by a known bound.

    The function is positive definite, 1 / (1/a + 1/b) = integral(exp(-t/a) exp(-t/b)), so what a pivoted Cholesky
    factor of few pivots leaves of it is too: by Cauchy's inequality a sum's error is sqrt(rest of x * rest of y) at most.
    """

    def __init__(self, top: int):
        values = np.arange(1, top + 1, dtype=np.float64)
        tried = np.unique(np.geomspace(1, top, 400).astype(np.int64)) - 1
        rest, features = values / 2, np.zeros((0, top))
        while len(features) < PIVOTS and (rest[tried] / values[tried]).max() > LEFT:
            at = tried[np.argmax(rest[tried] / values[tried])]
            new = (values * values[at] / (values + values[at]) - features[:, at] @ features) / np.sqrt(rest[at])
            features = np.vstack([features, new])
            rest = np.maximum(rest - new * new, 0)
        self.table = np.vstack([np.zeros(len(features), np.float32), features.T.astype(np.float32)])
        # the last term is for the rounding of ``rest`` itself
        self.rest = np.append(0.0, rest + 1e-12 * values)
        #: Of sqrt(AB): the most that single precision may add, PART products summed one after another, then these sums.
        self.rounding = (PART + -(-256 * len(features) // PART) + 4) * 2.0**-24 / 2

    def features(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row, one feature of all counts after another, and the root of what they leave."""
        whole = counts.astype(np.int64)
        out = np.empty((len(counts), self.table.shape[1], counts.shape[1]), np.float32)
        for k, column in enumerate(self.table.T):
            out[:, k] = np.ascontiguousarray(column)[whole]
        return out.reshape(len(counts), -1), np.sqrt(self.rest[whole].sum(1))

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Scalar products of features, PART of them at a time."""
        out = x[:, :PART] @ y[:, :PART].T
        for low in range(PART, x.shape[1], PART):
            out += x[:, low : low + PART] @ y[:, low : low + PART].T
        return out


def _linked(x: np.ndarray, y: np.ndarray, most: float, order: list[int]) -> np.ndarray:
    """Which rows of ``x`` and ``y`` have a statistic of at most ``most``, either way: as ``chi_squared`` says.

    Most pairs are decided by bounds, which are matrix products in single precision: of roots of shares, then of ``Harmonic``, as
    the statistic is N - N ** 2 sum(ab / r) / AB. The few others' is (N ** 2 sum(a ** 2 / r) - N A ** 2) / AB; close to ``most``,
    or where an expected count may be under FLOOR, it is taken as it is defined.
    """
    a, b = x.sum(1), y.sum(1)
    root = lambda m, n: np.sqrt(m / np.maximum(n, 1)[:, None]).astype(np.float32)
    left, right = root(x, a), root(y, b)
    ways = [(y, right.T), (y[:, order], right[:, order].T)]
    ways = [(m, m + 1e-300, np.ascontiguousarray(r)) for m, r in ways]  # no division by zero, where the share is 0 as well
    off = (x.shape[1] + 8) * 2.0**-24  # of a sum of roots in single precision, at most
    out, made = np.zeros((len(x), len(y)), bool), {}

    def featured(way: int) -> tuple:
        if not made:
            made["by"] = Harmonic(int(max(x.max(), y.max(), 1)))
            made["x"] = made["by"].features(x)
        if way not in made:
            made[way] = made["by"].features(ways[way][0])
        return made["by"], *made["x"], *made[way]

    for low in range(0, len(x), STRIP):
        some = slice(low, low + STRIP)
        n, m = a[some, None], b[None, :]
        odd = np.minimum(n, m) <= 1.01 * FLOOR * (n + m)
        surely, maybe = _bounds(n, m, most, off)
        surely[odd], maybe[odd] = np.inf, -np.inf
        for way, (own, safe, r) in enumerate(ways):
            h = left[some] @ r
            may = h >= maybe
            if not may.any():
                continue
            out[some] |= h >= surely
            may &= ~out[some]
            near = np.flatnonzero(may.any(0))
            if len(near) and np.count_nonzero(may) * DENSE > may.shape[0] * len(near):
                by, fx, rest_x, fy, rest_y = featured(way)
                may, total, product = may[:, near], n + b[near], n * b[near]
                with np.errstate(all="ignore"):  # what is odd is not decided here
                    scale = total * total / product
                    chi = total - scale * by.sums(fx[some], fy[near])
                    slack = scale * (rest_x[some, None] * rest_y[near] + by.rounding * np.sqrt(product)) + 1e-3 + 1e-10 * total
                    decided = (np.abs(chi - most) > slack) & ~odd[:, near]
                out[some, near] |= may & decided & (chi <= most)
                may &= ~decided
            else:
                may = may[:, near]
            for i in np.flatnonzero(may.any(1)):
                j = near[may[i]]
                k, far = low + i, odd[i, j]
                total = a[k] + b[j]
                with np.errstate(all="ignore"):  # what is odd is done again
                    chi = (total * total * ((1 / (safe[j] + x[k])) @ (x[k] * x[k])) - total * a[k] * a[k]) / (a[k] * b[j])
                    again = np.flatnonzero(far | ~(np.abs(chi - most) > 1e-4 + 1e-10 * total * a[k] / b[j]))
                if len(again):
                    chi[again] = chi_squared(x[k], own[j[again]])
                out[k, j[chi <= most]] = True
    return out


def _first_linked(links: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a matrix of links (and its transpose) the number of its component, -1 without links."""
    of_row, of_column, n = np.full(links.shape[0], -1), np.full(links.shape[1], -1), 0
    for start in np.flatnonzero(links.any(1)):
        if of_row[start] >= 0:
            continue
        rows = np.array([start])
        of_row[start] = n
        while len(rows):
            columns = np.flatnonzero(links[rows].any(0) & (of_column < 0))
            of_column[columns] = n
            rows = np.flatnonzero(others[columns].any(0) & (of_row < 0))
            of_row[rows] = n
        n += 1
    return of_row, of_column


def chi_squared_links(profiles: DataFrame, most: float, k: int = K) -> DataFrame:
    """(node, root, degree) of rows (contig_id: long, counts): the pairs of ``chi_squared_pairs``, counted and joined block by block.

    A row for each contig and pair of blocks in which it has links: how many, and the smallest contig of its component among them.
    So the degrees' sums are those of all pairs, and node and root have their components, with as many rows as contigs for a pair of blocks.
    """
    order = [_reverse_number(i, k) for i in range(4**k)]

    def run(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        x, y = _matrix(left, "counts"), _matrix(right, "counts")
        ids = [t["contig_id"].to_numpy() for t in ((left,) if same else (left, right))]
        links = _linked(x, y, most, order) if len(x) and len(y) else np.zeros((len(x), len(y)), bool)
        if same:  # the pairs of a row and a later one, both ways
            links = np.triu(links, 1)
            links |= links.T
        others = np.ascontiguousarray(links.T)
        of_row, of_column = _first_linked(links, others)
        node, of, degree = ids[0], of_row, links.sum(1)
        if not same:
            node, of, degree = np.concatenate(ids), np.concatenate([of_row, of_column]), np.concatenate([degree, others.sum(1)])
        have = of >= 0
        node, of, degree = node[have], of[have], degree[have]
        root = np.full(of.max(initial=-1) + 1, np.iinfo(np.int64).max)
        np.minimum.at(root, of, node)
        return pa.table({"node": pa.array(node, pa.int64()), "root": pa.array(root[of], pa.int64()), "degree": pa.array(degree, pa.int64())})

    n = profiles.count()
    rows = profiles.select(F.col("contig_id").cast("long").alias("contig_id"), F.col("counts").cast("array<int>").alias("counts"))
    return block_pairs(rows, n, "contig_id", run, "node long, root long, degree long", min(LINK_ROWS, max(256, -(-n // 24))))


def exact_percentiles(rows: DataFrame, points: tuple[float, ...], *keys: str, column: str = "dist") -> DataFrame:
    """(keys, n, mean, min, max, points) of a column's values, all from 0 to 1, with percentiles as ``F.percentile`` has them.

    Values are counted in CELLS equal cells of the range; only those of the cells that hold a wanted
    rank are looked at, by value. So no task holds a group's values. ``rows`` are computed twice.
    """
    value = F.col(column)
    cell = F.least(F.floor(value * CELLS), F.lit(CELLS - 1)).cast("int")
    rows = rows.where(value.isNotNull()).select(*keys, value.alias("x"), cell.alias("cell"))
    cells = rows.groupBy(*keys, "cell").agg(F.count("*").alias("n"), F.sum("x").alias("sum"), F.min("x").alias("min"), F.max("x").alias("max"))
    cells = Scratch(rows.sparkSession, "cells").write(cells, "cells")
    group = lambda df: df.groupBy(*keys)
    totals = group(cells).agg(F.sum("n").alias("n"), (F.sum("sum") / F.sum("n")).alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"))
    before = lambda *order: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = lambda left, right, on: left.join(F.broadcast(right), on) if on else left.crossJoin(F.broadcast(right))
    sizes = totals.select(*keys, F.col("n").alias("total"))  # one row a group
    # ranks from 0, below and above each point
    low = [F.floor((F.col("total") - 1) * p) for p in points]
    high = [F.ceil((F.col("total") - 1) * p) for p in points]
    holds = lambda: [(F.col("before") <= r) & (r < F.col("before") + F.col("n")) for r in (*low, *high)]
    wanted = joined(cells.select(*keys, "cell", "n", before("cell").alias("before")), sizes, list(keys)).where(reduce(or_, holds()))
    wanted = wanted.select(*keys, "cell", F.col("before").alias("skipped"))  # as many cells a group as ranks, at most
    values = rows.join(F.broadcast(wanted), [*keys, "cell"]).groupBy(*keys, "cell", "skipped", "x").agg(F.count("*").alias("n"))
    within = Window.partitionBy(*keys, "cell").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("before", F.col("skipped") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    found = joined(values, sizes, list(keys))
    at = holds()
    found = group(found).agg(*[F.max(F.when(hold, F.col("x"))).alias(f"x{i}") for i, hold in enumerate(at)], F.max("total").alias("total"))
    k = len(points)
    between = []
    for i, p in enumerate(points):
        place = (F.col("total") - 1) * p
        between.append(F.when(low[i] == high[i], F.col(f"x{i}")).otherwise((high[i] - place) * F.col(f"x{i}") + (place - low[i]) * F.col(f"x{i + k}")))
    found = found.select(*keys, F.array(*between).alias("points"))
    return totals.join(found, list(keys)) if keys else totals.join(found, how="left")


def distance_stats(dists: DataFrame, column: str = "dist") -> DataFrame:
    """Mean, extremes and percentiles of a column, as one row."""
    names = ["p0_25", "p0_5", "p1", "p5", "p10", "p50", "p99", "p99_9"]
    out = exact_percentiles(dists, DISTANCE_POINTS, column=column)
    return out.select(F.coalesce("n", F.lit(0)).alias("n"), "mean", "min", "max", *[F.get("points", F.lit(i)).alias(name) for i, name in enumerate(names)])


def full_matrix(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(dist) of the whole square matrix: each pair twice and a zero for each row."""
    twice = pairs.select("dist").unionByName(pairs.select("dist"))
    return twice.unionByName(rows.select(F.lit(0.0).alias("dist")))


def organism_stats(pairs: DataFrame, prefix: int = 2) -> DataFrame:
    """Distance report for each pair of organisms (label prefixes) of the pairs' ends, within and across."""
    labels = [F.substring("a", 1, prefix), F.substring("b", 1, prefix)]
    rows = pairs.select(F.least(*labels).alias("org"), F.greatest(*labels).alias("other"), "dist")
    out = exact_percentiles(rows, (0.01, 0.5, 0.99), "org", "other")
    return out.select("org", "other", "n", "mean", "min", "max", *[F.get("points", F.lit(i)).alias(x) for i, x in enumerate(("p1", "p50", "p99"))])


def share_below_cross(pairs: DataFrame, prefix: int = 2) -> DataFrame:
    """(org, share): within-organism distances smaller than the smallest one across."""
    labelled = pairs.withColumn("org", F.substring("a", 1, prefix)).withColumn("other", F.substring("b", 1, prefix))
    least = labelled.where("org <> other").agg(F.least(F.coalesce(F.min("dist"), F.lit(1.0)), F.lit(1.0)).alias("least"))
    return labelled.where("org = other").crossJoin(F.broadcast(least)).groupBy("org").agg(F.avg((F.col("dist") < F.col("least")).cast("double")).alias("share"))


def _nearest(x: np.ndarray, y: np.ndarray, of_x: np.ndarray, of_y: np.ndarray, same: bool, across: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``x`` its label and its distances to the rows of ``y`` of other labels, or of its own. Rows are in order of their labels."""
    low, high = np.searchsorted(of_y, of_x, "left"), np.searchsorted(of_y, of_x, "right")
    for i in range(len(x)):
        first = i + 1 if same else 0
        for a, b in ((0, low[i]), (high[i], len(y))) if across else ((low[i], high[i]),):
            if max(a, first) < b:
                yield of_x[i], _variation(x[i], y[max(a, first) : b])


def share_below_cross_of(shares: DataFrame, prefix: int = 2) -> DataFrame:
    """``share_below_cross`` of all pairs of rows (contig_id, p array): blocks send on their least distance, then counts of each organism, no pair."""
    n, rows = shares.count(), shares.select("contig_id", "p")
    block = min(LINK_ROWS, max(BLOCK_ROWS, -(-n // 24)))

    def numbered(left: pa.Table, right: pa.Table) -> tuple:
        names = [[x[:prefix] for x in t["contig_id"].to_pylist()] for t in (left, right)]
        labels, of = np.unique(np.array(names[0] + names[1], object), return_inverse=True)
        of = of[: len(left)], of[len(left) :]
        orders = [np.argsort(x, kind="stable") for x in of]
        return *[_matrix(t, "p")[o] for t, o in zip((left, right), orders, strict=True)], *[x[o] for x, o in zip(of, orders, strict=True)], labels

    def closest(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        x, y, of_x, of_y, _ = numbered(left, right)
        return pa.table({"least": pa.array([min((d.min() for _, d in _nearest(x, y, of_x, of_y, same, True)), default=1.0)], pa.float64())})

    least = block_pairs(rows, n, "contig_id", closest, "least double", block).agg(F.min("least").alias("least")).first()["least"]
    least = 1.0 if least is None else min(least, 1.0)

    def counted(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        x, y, of_x, of_y, labels = numbered(left, right)
        pairs, below = np.zeros(len(labels), np.int64), np.zeros(len(labels), np.int64)
        for label, d in _nearest(x, y, of_x, of_y, same, False):
            pairs[label] += len(d)
            below[label] += int((d < least).sum())
        some = np.flatnonzero(pairs)
        return pa.table({"org": pa.array(labels[some].tolist(), pa.string()), "pairs": pa.array(pairs[some]), "below": pa.array(below[some])})

    return block_pairs(rows, n, "contig_id", counted, "org string, pairs long, below long", block).groupBy("org").agg((F.sum("below") / F.sum("pairs")).alias("share"))
