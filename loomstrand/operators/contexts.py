"""Variable-length context models: counts, smoothing, weights and scores.

A state is a context of up to DEPTH known bases, the last one first, that more
than ``support`` known bases follow; the root is the empty context. Support
never grows with length, so states are found level by level. No supported state
is dropped.

The driver holds only the tops of the tries: the first levels, and further ones
below states that more than HEAVY bases follow. The top's last states are cuts.
What follows a cut goes with its remaining context to one task, packed, which
grows the trie below; these tries are stored. Scores are summed over pieces of
them: PIECE states at a time go to all tasks.

A base weighs by the longest state that its context has. One special case is
kept by default: after a base that is no state itself, the walk stands still
with weight 0 until the next unknown base.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import BASES, FLOOR
from ..scratch import Scratch

#: Bases of the longest context, at most 40 as packed; bases that must follow a state, more than.
DEPTH, SUPPORT = 40, 50
#: Levels counted in one pass of the top, fewer if the counters were over COUNTERS; states that more bases follow get further levels of the top.
LEVELS, COUNTERS, HEAVY = 7, 2_000_000, 1_000_000
#: Places (16 bytes each) that one task gets, about, and one pass shuffles, at least; passes at most; states of the tries in one pass of scoring, about.
BUCKET, PASS, PASSES, PIECE = 1_000_000, 32_000_000, 8, 2_000_000
#: Bases of the contexts that scoring looks up at once, at most.
JUMP = 11
#: Bases that a task looks at together; unknown ones before the first.
TOGETHER, PAD = 500_000, 48

_CODES = np.full(256, 4, np.int8)
_CODES[[65, 67, 71, 84]] = range(4)


def coded(seq: str | None, reverse: bool = False) -> np.ndarray:
    """Codes 0 to 3, 4 for anything else; of the reverse complement if asked."""
    code = _CODES[np.frombuffer((seq or "").encode("utf-8", "replace"), np.uint8)]
    return np.where(code < 4, 3 - code, 4).astype(np.int8)[::-1] if reverse else code


def _rolled(code: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bases before each place as one number of base 5, the last one first."""
    out = np.zeros(len(code), np.int32)
    for back in range(1, size + 1):
        out[back:] += np.multiply(code[:-back], np.int32(5 ** (size - back)), dtype=np.int32)
    return out


def _joined(codes: list[np.ndarray]) -> np.ndarray:
    """Sequences as one, PAD unknown bases before it and one after each."""
    end = np.full(1, 4, np.int8)
    return np.concatenate([np.full(PAD, 4, np.int8), *[x for code in codes for x in (code, end)]])


@dataclass
class Top:
    """The tops of the tries of all clusters in common arrays; node 0 stands for none."""

    clusters: list = field(default_factory=list)
    child: np.ndarray = field(default_factory=lambda: np.zeros((1, 4), np.int32))
    parent: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    level: np.ndarray = field(default_factory=lambda: np.full(1, -1, np.int16))
    last: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int8))
    counts: np.ndarray = field(default_factory=lambda: np.zeros((1, 4), np.int64))
    of: np.ndarray = field(default_factory=lambda: np.full(1, -1, np.int32))
    probabilities: np.ndarray | None = None
    #: Levels of the first pass, which a table of all contexts finds.
    first: int = 1

    def __post_init__(self):
        self.number, self.tables = {c: k for k, c in enumerate(self.clusters)}, {}

    def __getstate__(self):
        return self.__dict__ | {"tables": {}}

    def add(self, parent: np.ndarray, last: np.ndarray, level: int, counts: np.ndarray, of: np.ndarray) -> np.ndarray:
        nodes = np.arange(len(self.parent), len(self.parent) + len(parent), dtype=np.int32)
        self.child = np.concatenate([self.child, np.zeros((len(parent), 4), np.int32)])
        self.parent, self.last = np.concatenate([self.parent, parent.astype(np.int32)]), np.concatenate([self.last, last.astype(np.int8)])
        self.level, self.counts = np.concatenate([self.level, np.full(len(parent), level, np.int16)]), np.concatenate([self.counts, counts])
        self.of, self.tables = np.concatenate([self.of, of.astype(np.int32)]), {}
        if level:
            self.child[parent, last] = nodes
        return nodes

    def root(self, cluster) -> int:
        return 1 + self.number[cluster]

    def table(self, cluster) -> np.ndarray:
        """The longest state of each context of ``first`` bases."""
        if cluster not in self.tables:
            every = np.arange(5**self.first)
            node, on = np.full(5**self.first, self.root(cluster), np.int32), np.ones(5**self.first, bool)
            for back in range(1, self.first + 1):
                base = every // 5 ** (self.first - back) % 5
                to = np.where(base < 4, self.child[node, np.minimum(base, 3)], 0)
                on &= to > 0
                node = np.where(on, to, node)
            self.tables[cluster] = node
        return self.tables[cluster]

    def placed(self, code: np.ndarray, rolled: np.ndarray, cluster) -> np.ndarray:
        """The longest state in the top of each place's context; ``rolled`` has its last ``first`` bases."""
        node = self.table(cluster)[rolled]
        inner, back = (self.child > 0).any(1) & (self.level >= self.first), self.first
        at = np.flatnonzero(inner[node]) if inner.any() else np.zeros(0, np.int64)
        while len(at):
            back += 1
            before = code[at - back]
            at, before = at[before < 4], before[before < 4]
            to = self.child[node[at], before]
            at, to = at[to > 0], to[to > 0]
            node[at] = to
            at = at[inner[to]]
        return node

    def smoothed(self) -> None:
        """Probabilities: counts backed off to the next shorter context."""
        p = np.full((len(self.parent), 4), 0.25)
        for level in range(int(self.level.max()) + 1):
            nodes = np.flatnonzero(self.level == level)
            p[nodes] = _backed_off(self.counts[nodes], p[self.parent[nodes]] if level else np.full((len(nodes), 4), 0.25))
        self.probabilities = p

    def contexts(self) -> list[str]:
        """The context of each node, the last base first."""
        out = [""] * len(self.parent)
        for i in range(1, len(out)):
            if self.level[i] > 0:
                out[i] = out[self.parent[i]] + BASES[self.last[i]]
        return out


def _backed_off(counts: np.ndarray, above: np.ndarray) -> np.ndarray:
    total = counts.sum(1, keepdims=True).astype(np.float64)
    share = 1 / np.maximum(total, 1)
    return np.where(total > 0, (1 - share) * counts * share + share * above, above)


def _weights(p: np.ndarray, floor: float) -> np.ndarray:
    """Bits over chance."""
    return np.log2(4 * np.maximum(floor, p))


@dataclass
class Below:
    """The tries below some cuts, level by level: the cuts, which children each node has, and the counts of all but the cuts."""

    roots: np.ndarray
    masks: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Below:
        return cls(np.frombuffer(row["roots"], np.int32), np.frombuffer(row["masks"], np.uint8), np.frombuffer(row["counts"], np.int32).reshape(-1, 4))

    def unfolded(self, top: Top) -> tuple[np.ndarray, ...]:
        """child (0: none), parent, last, level and probabilities of each node."""
        n = len(self.masks)
        child, parent, last, level = np.zeros((n, 4), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int8), np.zeros(n, np.int16)
        p = np.empty((n, 4))
        low, high = 0, len(self.roots)
        level[:high], p[:high] = top.level[self.roots], top.probabilities[self.roots]
        while high < n:
            node, base = np.nonzero(self.masks[low:high, None] >> np.arange(4, dtype=np.uint8) & 1)
            node, new = node + low, slice(high, high + len(node))
            child[node, base], parent[new], last[new], level[new] = np.arange(new.start, new.stop), node, base, level[node] + 1
            p[new] = _backed_off(self.counts[new.start - len(self.roots) : new.stop - len(self.roots)], p[node])
            low, high = high, new.stop
        return child, parent, last, level, p


class Piece:
    """The top and the tries below some of its cuts, for scores; ``first`` of all pieces has what ends above the cuts."""

    def __init__(self, top: Top, belows: list[Below], cuts: np.ndarray, first: bool, floor: float):
        self.top, self.belows, self.cuts, self.first, self.floor, self.ready, self.jumps = top, belows, cuts, first, floor, None, {}
        self.clusters = list(top.clusters) if first else [top.clusters[k] for k in np.unique(top.of[np.concatenate([x.roots for x in belows])])]

    def __getstate__(self):
        return self.__dict__ | {"ready": None, "jumps": {}}

    def tries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """child, weights, and which nodes are this piece's, the top's nodes first; others weigh 0. Made once in each process."""
        if self.ready is None:
            at = len(self.top.parent)
            n = at + sum(len(x.masks) - len(x.roots) for x in self.belows)
            child, weights, own = np.zeros((n, 4), np.int32), np.zeros((n, 4)), np.ones(n, bool)
            child[:at], own[:at] = self.top.child, ~self.cuts & (self.top.level >= 0) & self.first
            weights[:at][own[:at]] = _weights(self.top.probabilities[own[:at]], self.floor)
            for below in self.belows:
                c, _, _, _, p = below.unfolded(self.top)
                cut, new = len(below.roots), slice(at, at + len(c) - len(below.roots))
                c[c > 0] += at - cut
                child[below.roots], child[new] = c[:cut], c[cut:]
                w = _weights(p, self.floor)
                weights[below.roots], weights[new] = w[:cut], w[cut:]
                own[below.roots] = True
                at = new.stop
            self.ready = child, weights, own
        return self.ready

    def jump(self, cluster) -> tuple[int, np.ndarray]:
        """A number of bases, and the longest state of each context of so many known bases: 0 if it is not this piece's, under 0 if longer contexts may have one that is."""
        if cluster not in self.jumps:
            child, _, own = self.tries()
            k = self.top.number[cluster]
            n = int((own[: len(self.top.of)] & (self.top.of == k)).sum()) + sum(len(x.masks) for x in self.belows if (self.top.of[x.roots] == k).any())
            size = next((x for x in range(1, JUMP) if 4**x >= n), JUMP)
            node, on = np.full(1, self.top.root(cluster), np.int32), np.ones(1, bool)
            for _ in range(size):
                to = np.where(on[:, None], child[node], 0)
                on, node = (to > 0).ravel(), np.where(to > 0, to, node[:, None]).ravel()
            on &= (child > 0).any(1)[node]
            self.jumps[cluster] = size, np.where(on, -node, np.where(own[node], node, 0))
        return self.jumps[cluster]

    def scored(self, codes: list[np.ndarray], stand_still: bool, only: frozenset | None = None) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
        """(cluster, sums, sums of squares): what this piece adds to each sequence's score, under ``only`` these clusters."""
        child, weights, _ = self.tries()
        child, weights = child.ravel(), weights.ravel()
        code = _joined(codes)
        starts = PAD + np.append(0, np.cumsum([len(x) + 1 for x in codes])[:-1])
        unknown, plain, words = np.flatnonzero(code == 4), code & 3, {}
        for cluster in self.clusters:
            if only is not None and cluster not in only:
                continue
            size, jump = self.jump(cluster)
            if size not in words:
                few = np.zeros(len(code), bool)  # less known bases than that before them
                for back in range(1, size + 1):
                    few[unknown[unknown < len(code) - back] + back] = True
                words[size] = _words(code, size), np.flatnonzero(few)
            word, few = words[size]
            node = jump[word]
            node[few] = -self.top.root(cluster)
            node[unknown] = 0
            if stand_still:
                lost = np.append(self.top.child[self.top.root(cluster)] == 0, False)
                if lost.any():
                    place = np.arange(1, len(code) + 1)
                    stopped = np.maximum.accumulate(np.where(lost[code], place, 0))
                    freed = np.maximum.accumulate(np.where(code == 4, place, 0))
                    node[1:][(stopped > freed)[:-1]] = 0
            walking = np.flatnonzero(node < 0)
            back = walking - size - 1
            if len(few):
                short = np.searchsorted(walking, few)
                short = short[(short < len(walking)) & (walking[np.minimum(short, len(walking) - 1)] == few)] if len(walking) else short[:0]
                back[short] = walking[short] - 1
            here = -node[walking]
            node[walking] = here
            while len(walking):
                before = code[back]
                to = child[here * np.int64(4) + (before & 3)]
                ok = np.flatnonzero((to > 0) & (before < 4))
                walking, here, back = walking[ok], to[ok], back[ok] - 1
                node[walking] = here
            on = np.flatnonzero(node)
            if 2 * len(on) > len(code):
                w = weights[node * np.int64(4) + plain]  # node 0 weighs 0
            else:
                w = np.zeros(len(code))
                w[on] = weights[node[on] * np.int64(4) + plain[on]]
            yield cluster, np.add.reduceat(w, starts), np.add.reduceat(w * w, starts)


def _words(code: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bases before each place as one number of base 4, the last one first; unknown ones are 0."""
    part, have, out, got = np.append(np.int32(0), np.where(code < 4, code, 0)[:-1].astype(np.int32)), 1, np.zeros(len(code), np.int32), 0
    while True:
        if size & have:
            out <<= np.int32(2 * have)
            out[got:] |= part[: len(part) - got]
            got += have
        if have * 2 > size:
            return out
        longer = part << np.int32(2 * have)
        longer[have:] |= part[:-have]
        part, have = longer, have * 2


def _by_cluster(shared, look: Callable) -> Callable:
    """A step on batches (seq, reverse, cluster): look(top, cluster, code) for sequences of one cluster at a time, and its record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict = {}
            cluster = batch.column("cluster").to_pylist()
            for i in np.argsort(np.array([shared.value[0].number.get(c, -1) for c in cluster]), kind="stable"):
                if cluster[i] not in shared.value[0].number:
                    continue
                codes = held.setdefault(cluster[i], [])
                codes.append(coded(batch.column("seq")[int(i)].as_py(), batch.column("reverse")[int(i)].as_py()))
                if sum(map(len, codes)) >= TOGETHER:
                    yield from look(shared.value, cluster[i], _joined(held.pop(cluster[i])))
            for c, codes in held.items():
                yield from look(shared.value, c, _joined(codes))

    return run


def _counted(shared, more: int) -> Callable:
    """Rows (key, n): how often a base follows a state of the frontier and the ``more`` bases before it."""
    wide = 5**more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, frontier = shared.value
        rank = np.full(len(top.parent), -1, np.int64)
        rank[frontier] = np.arange(len(frontier))
        sums = np.zeros(len(frontier) * wide * 4, np.int64)

        def look(_, cluster, code: np.ndarray) -> tuple:
            rolled = _rolled(code, more)
            own = rank[np.flatnonzero(top.of == top.number[cluster])]
            own = own[own >= 0]  # the frontier is in order of cluster
            if not len(own):
                return ()
            have = int(top.level[frontier[own[0]]])
            at = np.flatnonzero(code < 4)
            state = np.full(len(at), own[0]) if not have else rank[top.placed(code, _rolled(code, top.first), cluster)[at]]
            at, state = at[state >= 0], state[state >= 0]
            low, high = own[0] * wide * 4, (own[-1] + 1) * wide * 4
            sums[low:high] += np.bincount((state * wide + rolled[at - have]) * 4 + code[at] - low, minlength=high - low)
            return ()

        for _ in _by_cluster(shared, look)(batches):
            pass
        keys = np.flatnonzero(sums)
        for low in range(0, len(keys), 100_000):
            some = keys[low : low + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["key", "n"])

    return run


def _packed(shared, depth: int) -> Callable:
    """Rows (bucket, places): all that follows the cuts, packed: 32 bases before the cut's, 8 more, their number, the base, the cut."""

    def look(value, cluster, code: np.ndarray) -> Iterator[pa.RecordBatch]:
        top, bucket = value
        node = top.placed(code, _rolled(code, top.first), cluster)
        at = np.flatnonzero((code < 4) & (bucket[node] >= 0))
        if not len(at):
            return
        of = bucket[node[at]]
        low = of.min()
        at = at[np.argsort((of - low).astype(np.uint16) if of.max() - low < 2**16 else of, kind="stable")]  # short numbers are sorted in linear time
        node = node[at]
        unknown = np.maximum.accumulate(np.where(code == 4, np.arange(len(code), dtype=np.int32), 0))
        run = at - 1 - unknown[at - 1]  # known bases before each place
        words, size = np.append(np.zeros(1, np.uint16), np.where(code < 4, code, 0)[:-1].astype(np.uint16)), 1
        while size < 8:  # the 8 bases before each place, the last one highest
            longer = words << np.uint16(2 * size)
            longer[size:] |= words[:-size]
            words, size = longer, size * 2
        level = top.level[node]
        back = at - level
        far = words[back].astype(np.uint64)
        for _ in range(3):
            back = np.maximum(back - 8, 0)
            far = far << np.uint64(16) | words[back]
        places = np.empty(len(at), [("far", np.uint64), ("near", np.uint32), ("cut", np.int32)])
        places["far"], places["cut"] = far, node
        places["near"] = (words[np.maximum(back - 8, 0)].astype(np.uint32) << np.uint32(8)) | ((np.minimum(run, depth) - level).astype(np.uint32) << np.uint32(2)) | code[at].astype(np.uint32)
        of = bucket[node]
        ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of))
        starts = np.append(0, ends[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(of[starts], pa.int32()), pa.array([places[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())], ["bucket", "places"])

    return _by_cluster(shared, look)


def _grown(support: int) -> Callable:
    """The tries below the cuts of one bucket, of its packed places."""

    def run(group: pa.Table) -> pa.Table:
        places = np.frombuffer(b"".join(group["places"].to_pylist()), [("far", np.uint64), ("near", np.uint32), ("cut", np.int32)])
        bucket = group["bucket"][0].as_py()
        far, near = places["far"].copy(), places["near"].copy()
        cuts, limit = places["cut"] - places["cut"].min(), (near >> np.uint32(2) & np.uint32(63)).astype(np.uint8)
        seen = np.bincount(cuts) > 0  # cuts are nodes of the top, which the driver holds
        roots, node = np.flatnonzero(seen) + places["cut"].min(), (np.cumsum(seen) - 1)[cuts]
        n, masks, counts = len(roots), [], []
        for step in range(40):
            before = far >> np.uint64(62 - 2 * step) if step < 32 else near >> np.uint32(22 - 2 * (step - 32))
            key = node * 4 + (before & 3).astype(np.int64)
            key[limit <= step] = 4 * n
            keep = np.bincount(key, minlength=4 * n + 1) > support
            keep[-1] = False
            masks.append((keep[:-1].reshape(n, 4) * np.array([1, 2, 4, 8], np.uint8)).sum(1).astype(np.uint8))
            ok, n = np.flatnonzero(keep[key]), int(keep.sum())
            if not n:
                break
            if len(ok) < len(key):
                far, near, limit, key = far[ok], near[ok], limit[ok], key[ok]
            node = (np.cumsum(keep) - 1)[key]
            counts.append(np.bincount(node * 4 + (near & 3), minlength=4 * n).astype(np.int32))
        else:
            masks.append(np.zeros(n, np.uint8))
        masks, counts = np.concatenate(masks), np.concatenate([np.zeros(0, np.int32), *counts])
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "n": pa.array([len(masks)], pa.int64()), "roots": pa.array([roots.astype(np.int32).tobytes()], pa.binary()), "masks": pa.array([masks.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})

    return lambda group: run(group)


class Models:
    """Context models of all clusters: the tops of their tries here, what is below the cuts in a stored table (None: nothing)."""

    def __init__(self, scratch: Scratch, top: Top, cuts: np.ndarray, below: DataFrame | None, floor: float):
        self.scratch, self.top, self.cuts, self.below, self.floor = scratch, top, cuts, below, floor
        self.clusters, self.scored = top.clusters, 0
        top.smoothed()

    def pieces(self) -> Iterator[Piece]:
        """All tries, PIECE states at a time, about."""
        sizes = sorted((r["bucket"], r["n"]) for r in self.below.select("bucket", "n").collect()) if self.below is not None else []  # one row a bucket
        groups, held = [[]], 0
        for bucket, n in sizes:
            if held and held + n > PIECE:
                groups, held = [*groups, []], 0
            groups[-1].append(bucket)
            held += n
        self.n_pieces = len(groups)
        for k, group in enumerate(groups):
            rows = self.below.where(F.col("bucket").between(group[0], group[-1])).drop("n").toArrow().to_pylist() if group else []
            yield Piece(self.top, [Below.of(r) for r in rows], self.cuts, not k, self.floor)

    def drop(self) -> None:
        """Delete the stored tries and sums."""
        if self.below is not None:
            self.scratch.drop("")

    def _whole(self, column: str) -> np.ndarray:
        rows = [Below.of(r) for r in self.below.orderBy("bucket").toArrow().to_pylist()] if self.below is not None else []
        if column == "counts":
            return np.concatenate([self.top.counts, *[x.counts.astype(np.int64) for x in rows]])
        return np.concatenate([self.top.level, *[x.unfolded(self.top)[3][len(x.roots) :] for x in rows]])

    @property
    def level(self) -> np.ndarray:
        """The level of each node, -1 for none; as ``counts`` and ``contexts``, of whole tries on the driver, for small ones."""
        return self._whole("level")

    @property
    def counts(self) -> np.ndarray:
        return self._whole("counts")

    def contexts(self) -> list[str]:
        rows = [Below.of(r) for r in self.below.orderBy("bucket").toArrow().to_pylist()] if self.below is not None else []
        return self.top.contexts() + [c for x in rows for c in _contexts(x, self.top, self.top.contexts())]


def _contexts(below: Below, top: Top, names: list[str]) -> list[str]:
    """The contexts of all nodes but the cuts."""
    _, parent, last, _, _ = below.unfolded(top)
    out = [names[x] for x in below.roots]
    for i in range(len(out), len(parent)):
        out.append(out[parent[i]] + BASES[last[i]])
    return out[len(below.roots) :]


def trained(spark: SparkSession, members: DataFrame, support: int = SUPPORT, depth: int = DEPTH, floor: float = FLOOR) -> Models:
    """Models of the clusters of members (contig_id, seq, reverse, cluster), smoothed. Give it a stored table: it is read several times."""
    if depth > 40:
        raise ValueError("contexts have at most 40 bases")
    scratch, members = Scratch(spark, "tries"), members.select("seq", "reverse", "cluster")
    clusters = sorted(r["cluster"] for r in members.select("cluster").distinct().collect())  # one row a cluster
    top, have = Top(clusters), 0
    frontier = top.add(np.zeros(len(clusters), np.int32), np.zeros(len(clusters)), 0, np.zeros((len(clusters), 4), np.int64), np.arange(len(clusters)))
    ends = [frontier[:0]]  # the top's last states, which are no longer than depth
    while len(frontier) and have < depth:
        more = min(depth - have, next((m for m in range(LEVELS, 1, -1) if len(frontier) * 5**m * 4 <= COUNTERS), 1))
        top.first = top.first if have else more
        shared = spark.sparkContext.broadcast((top, frontier))
        rows = members.mapInArrow(_counted(shared, more), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
        shared.destroy()
        sums = np.zeros(len(frontier) * 5**more * 4, np.int64)
        sums[rows["key"].to_numpy()] = rows["n"].to_numpy()
        nodes = frontier[:, None]
        if not have:
            top.counts[frontier] = sums.reshape(len(frontier), -1, 4).sum(1)
        for size in range(1, more + 1):
            counts = sums.reshape(len(frontier), 5**size, -1, 4).sum(2)
            above = np.repeat(nodes, 5, 1)
            state, code = np.nonzero((counts.sum(2) > support) & (above > 0) & (np.arange(5**size) % 5 < 4))
            new = top.add(above[state, code], code % 5, have + size, counts[state, code], top.of[frontier[state]])
            nodes = np.zeros((len(frontier), 5**size), np.int32)
            nodes[state, code] = new
        have += more
        heavy = top.counts[new].sum(1) > HEAVY
        if have < depth:
            ends.append(new[~heavy])
            frontier = new[heavy]
    ends = np.concatenate(ends)
    cuts = np.zeros(len(top.parent), bool)
    cuts[ends] = True
    if not len(ends):
        return Models(scratch, top, cuts, None, floor)
    ends = ends[np.lexsort((ends, top.of[ends]))]
    places = np.cumsum(top.counts[ends].sum(1))
    most = int(min(BUCKET, max(50_000, places[-1] // 16)))
    of = (places - 1) // most
    passes = -(-int(of[-1] + 1) // max(1, int(max(PASS, places[-1] // PASSES)) // most))
    per = -(-int(of[-1] + 1) // passes)
    for k in range(passes):
        now = of // per == k
        if not now.any():
            continue
        bucket = np.full(len(top.parent), -1, np.int32)
        bucket[ends[now]] = of[now]
        some = [clusters[x] for x in np.unique(top.of[ends[now]])]
        shared = spark.sparkContext.broadcast((top, bucket))
        rows = members.where(F.col("cluster").isin(some)) if len(some) < min(100, len(clusters)) else members
        rows = rows.mapInArrow(_packed(shared, depth), "bucket int, places binary").groupBy("bucket").applyInArrow(_grown(support), "bucket int, n long, roots binary, masks binary, counts binary")
        scratch.write(rows, f"below/pass={k}")
        shared.destroy()
        if passes > 1:
            scratch.drop()  # its shuffle
    below = spark.read.schema("bucket int, n long, roots binary, masks binary, counts binary").parquet(scratch.path("below"))
    return Models(scratch, top, cuts, below, floor)


def states(spark: SparkSession, models: Models) -> DataFrame:
    """(cluster, level, context, n_a, n_c, n_g, n_t, w_a, w_c, w_g, w_t) of all states."""
    top, floor, names = models.top, models.floor, models.top.contexts()
    columns = ["cluster", "level", "context", *[f"n_{b}" for b in "acgt"], *[f"w_{b}" for b in "acgt"]]
    kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4, *[pa.float64()] * 4]

    def table(of: np.ndarray, level: np.ndarray, contexts: list[str], counts: np.ndarray, p: np.ndarray) -> list[pa.Array]:
        w = _weights(p, floor)
        values = [[top.clusters[k] for k in of], level, contexts, *counts.T, *w.T]
        return [pa.array(np.ascontiguousarray(v) if isinstance(v, np.ndarray) else v).cast(t) for v, t in zip(values, kinds, strict=True)]

    upper = pa.table(table(top.of[1:], top.level[1:], names[1:], top.counts[1:], top.probabilities[1:]), names=columns)
    upper = spark.createDataFrame(upper)
    if models.below is None:
        return upper
    shared = spark.sparkContext.broadcast((top, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, names = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                below = Below.of(row)
                n = len(below.roots)
                _, parent, _, level, p = below.unfolded(top)
                of = np.empty(len(parent), np.int32)
                of[:n] = top.of[below.roots]
                for i in range(n, len(parent)):
                    of[i] = of[parent[i]]
                contexts = _contexts(below, top, names)
                for low in range(n, len(parent), 10_000):
                    some = slice(low, low + 10_000)
                    yield pa.RecordBatch.from_arrays(table(of[some], level[some], contexts[low - n : low - n + 10_000], below.counts[low - n : low - n + 10_000], p[some]), columns)

    return upper.unionByName(models.below.drop("n").mapInArrow(run, upper.schema))


def scores(spark: SparkSession, contigs: DataFrame, models: Models, both: bool = False, stand_still: bool = True, only: frozenset | None = None) -> DataFrame:
    """(contig_id, cluster, backward, score, squares) of contigs (contig_id, seq) under every model, or ``only`` these clusters'; the other strand too if ``both``.

    Names are unique. With tries of several pieces there is a pass over the contigs for each, whose sums are stored.
    """
    ways = (False, True) if both else (False,)
    kind = contigs.schema["contig_id"].dataType.simpleString()
    schema = f"contig_id {kind}, cluster int, backward boolean, score double, squares double"

    def step(shared) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            piece = shared.value
            kinds = [pa.int32(), pa.bool_(), pa.float64(), pa.float64()]
            for batch in batches:
                ends = np.cumsum([len(x.as_py() or "") + 1 for x in batch.column(1)]) // TOGETHER
                for part in np.unique(ends):
                    at = np.flatnonzero(ends == part)
                    for backward in ways:
                        codes = [coded(batch.column(1)[int(i)].as_py(), backward) for i in at]
                        for cluster, score, squares in piece.scored(codes, stand_still, only):
                            values = [[cluster] * len(at), [backward] * len(at), score, squares]
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *[pa.array(v, t) for v, t in zip(values, kinds, strict=True)]], ["contig_id", "cluster", "backward", "score", "squares"])

        return run

    rows = contigs.select("contig_id", "seq")
    if not models.clusters:
        return spark.createDataFrame([], schema)
    parts, models.scored = models.scratch, models.scored + 1
    for k, piece in enumerate(models.pieces()):
        shared = spark.sparkContext.broadcast(piece)
        found = rows.mapInArrow(step(shared), schema)
        if models.n_pieces == 1:
            return found
        parts.write(found, f"sums-{models.scored}/piece={k}")
        shared.destroy()
    every = spark.read.schema(schema).parquet(parts.path(f"sums-{models.scored}"))
    return every.groupBy("contig_id", "cluster", "backward").agg(F.sum("score").alias("score"), F.sum("squares").alias("squares"))
