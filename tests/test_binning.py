"""Binning operators against direct simulations in plain Python and numpy."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstrand.operators import bins as B
from loomstrand.operators import clusters as C
from loomstrand.operators import contexts as X
from loomstrand.operators import distances as D
from loomstrand.operators import grading as G
from loomstrand.operators.distances import chi_squared, variation_kernel
from loomstrand.operators.graph import components, leaders, sized_components, sized_leaders
from loomstrand import queries as Q
from loomstrand.plans import binnings as P
from loomstrand.scratch import Scratch


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    found = components(Scratch(spark, "t"), spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["root"] for r in found.collect()} == {x: find(x) for x in parent}
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_leaders(spark, seed):
    r = random.Random(seed)
    links = {tuple(sorted(r.sample(range(25), 2))) for _ in range(40)}
    near = {i: {b for a, b in links if a == i} | {a for a, b in links if b == i} for i in range(25)}
    taken = {}
    for i in range(25):
        if i in taken or not near[i]:
            continue
        taken[i] = i
        for j in near[i]:
            taken.setdefault(j, i)
    found = leaders(Scratch(spark, "t"), spark.createDataFrame(list(links), "a int, b int"))
    assert {r["node"]: r["leader"] for r in found.collect()} == taken


@pytest.mark.parametrize("sizes", [[5, 3, 2], [1, 1, 1, 1, 1, 1, 1, 1], [40, 9, 8, 3, 2, 1], [2]])
def test_reduced(spark, sizes):
    total, keep = sum(sizes), [i for i, s in enumerate(sizes) if s * s > sum(sizes)]
    n = keep[-1] + 1 if keep else 1
    while sum(sizes[:n]) ** 2 < min(16.0, total) * total:
        n += 1
    rows = [(f"c{i}_{j}", i + 1) for i, s in enumerate(sizes) for j in range(s)]
    got = B.reduced(spark.createDataFrame(rows, "contig_id string, bin int")).select("bin").distinct().count()
    assert got == n


def test_chi_squared():
    a = np.array([4.0, 4, 0, 0])
    assert chi_squared(a, np.array([[4.0, 4, 0, 0], [8, 8, 0, 0], [0, 0, 0, 0]])) == pytest.approx([0, 0, 0], abs=1e-9)
    assert chi_squared(a * 50, np.array([[0.0, 0, 200, 200]]))[0] > 100


def simulated_distance_binning(seqs: dict[str, str]):
    """The same steps on dictionaries and lists."""
    s = P.DistanceSettings()
    number = {a + b + c + d: i for i, (a, b, c, d) in enumerate((a, b, c, d) for a in "ACGT" for b in "ACGT" for c in "ACGT" for d in "ACGT")}
    p = {}
    for name, seq in seqs.items():
        v = np.zeros(256)
        for i in range(len(seq) - 3):
            v[number[seq[i : i + 4]]] += 1
        p[name] = v / v.sum() if v.sum() else v
    dist = lambda x, y: np.abs(x - y).sum() / 2
    order = sorted((len(q), n) for n, q in seqs.items())[int(len(seqs) * 0.85) : int(len(seqs) * 0.95)]
    chosen = [n for _, n in order]
    groups: list[set] = []
    for a in chosen:
        new = {a} | {b for b in chosen if dist(p[a], p[b]) < s.creation}
        hit = [g for g in groups if g & new]
        first = groups.index(hit[0]) if hit else len(groups)
        groups = [g for g in groups if not g & new]
        groups.insert(min(first, len(groups)), new.union(*hit))
    bins = sorted([g for g in groups if len(g) > 1], key=len, reverse=True)
    held = {c: k for k, b in enumerate(bins) for c in b}
    grown = [set(b) for b in bins]
    for a in chosen:
        if a not in held:
            d, b = min((dist(p[a], p[b]), b) for b in held)
            if d <= s.selection:
                grown[held[b]].add(a)
    bins = sorted(grown, key=len, reverse=True)
    middle = lambda b: np.median(np.stack([p[c] for c in b]), axis=0)
    for t in s.merging:
        m, gone = [middle(b) for b in bins], set()
        for i in range(len(bins)):
            if i in gone:
                continue
            close = [j for j in range(len(bins)) if j != i and j not in gone and dist(m[i], m[j]) < t]
            for j in close:
                bins[i] = bins[i] | bins[j]
            gone |= set(close)
        bins = sorted([b for i, b in enumerate(bins) if i not in gone], key=len, reverse=True)
    total, n = sum(map(len, bins)), max([i + 1 for i, b in enumerate(bins) if len(b) ** 2 > sum(map(len, bins))], default=1)
    while sum(map(len, bins[:n])) ** 2 < min(s.reduction, total) * total:
        n += 1
    bins, rest = bins[:n], set()
    for names, most in ((chosen, s.selection), (list(seqs), s.final)):
        m, held = [middle(b) for b in bins], set().union(*bins)
        bins, rest = [set(b) for b in bins], set()
        for c in names:
            if c not in held:
                d = [dist(p[c], x) for x in m]
                (bins[int(np.argmin(d))] if min(d) <= most else rest).add(c)
        bins = sorted(bins, key=len, reverse=True)
    return bins, rest


def test_distance_binning(spark, small):
    contigs = P.contigs_of(spark.read.parquet(f"{small}/documents.parquet"))
    want, rest = simulated_distance_binning({r["contig_id"]: r["seq"] for r in contigs.collect()})
    bins, unbinned = P.by_distance(spark, contigs)
    got: dict[int, set] = {}
    for r in bins.collect():
        got.setdefault(r["bin"], set()).add(r["contig_id"])
    assert [got[k] for k in sorted(got)] == want
    assert {r["contig_id"] for r in unbinned.collect()} == rest


def walked(train: list[str], seq: str, support: int, depth: int) -> float:
    """Score by counting every context and looking for the longest at each base."""
    counts: dict[str, Counter] = {}
    for s in train:
        for i, b in enumerate(s):
            if b == "N":
                continue
            for n in range(depth + 1):
                ctx = s[i - n : i][::-1]
                if len(ctx) < n or "N" in ctx or i - n < 0:
                    break
                counts.setdefault(ctx, Counter())[b] += 1
    kept = {c: k for c, k in counts.items() if not c or k.total() > support}
    p = {}
    for c in sorted(kept, key=len):
        n = kept[c].total()
        above = p[c[:-1]] if c else dict.fromkeys("ACGT", 0.25)
        p[c] = {b: (1 - 1 / n) * kept[c][b] / n + above[b] / n for b in "ACGT"}
    score, lost = 0.0, False
    for i, b in enumerate(seq):
        if b == "N":
            lost = False
            continue
        if not lost:
            ctx = max((c for n in range(depth + 1) if i >= n and (c := seq[i - n : i][::-1]) in p), key=len)
            score += np.log2(4 * max(1 / 64, p[ctx][b]))
        lost = lost or b not in p
    return score


def test_context_scores(spark):
    r = random.Random(3)
    make = lambda w: "".join(r.choices("ACGTN", w, k=300))
    train = {1: [make([8, 1, 1, 1, 0.1]) for _ in range(4)], 2: [make([1, 1, 6, 6, 0.1]) for _ in range(4)], 3: ["A" * 200, "A" * 150 + "C" * 20, "AAC" * 30]}
    rows = [(f"c{k}_{i}", s, False, k) for k, own in train.items() for i, s in enumerate(own)]
    members = spark.createDataFrame(rows, "contig_id string, seq string, reverse boolean, cluster int")
    for depth in (1, 3, 9):
        models = X.trained(spark, members, 20, depth)
        found = X.scores(spark, members, models)
        by_name = {n: s for n, s, _, _ in rows}
        for x in found.collect():
            assert x["score"] == pytest.approx(walked(train[x["cluster"]], by_name[x["contig_id"]], 20, depth), abs=1e-6), (depth, x)


def test_queries_use_the_whole_depth(spark, tmp_path):
    """Against brute force at depth 40, on few documents with contexts beyond that; the others follow from the scores."""
    r = random.Random(4)
    unit = "".join(r.choices("acgt", k=60))
    docs = [(i, unit * 5 + "".join(r.choices("acgt", k=40)), lang, "s") for i, lang in enumerate(["en"] * 14 + ["fr"] * 2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    contigs = {x["contig_id"]: x["seq"] for x in Q._contigs(spark, str(tmp_path)).collect()}
    train = {k: [s for n, s in contigs.items() if n.startswith(lang)] for k, lang in ((1, "en"), (2, "fr"))}
    found = {(x["contig_id"], x["cluster"]): x["score"] for x in Q.QUERIES["context_scores"](spark, str(tmp_path)).collect()}
    assert len(found) == 32
    for name, cluster in (("en_0", 1), ("en_3", 2), ("fr_15", 1), ("fr_15", 2)):
        assert found[name, cluster] == pytest.approx(walked(train[cluster], contigs[name], 50, 40), abs=1e-3)
    assert Q.QUERIES["context_states"](spark, str(tmp_path)).agg({"level": "max"}).first()[0] == 40


def test_no_supported_state_is_dropped(spark):
    """Far more than two million states, all of them kept."""
    seq = "".join(random.Random(3).choices("ACGT", k=300_000))
    models = X.trained(spark, spark.createDataFrame([("a", seq, False, 1)], "contig_id string, seq string, reverse boolean, cluster int"), 0, 16)
    for level in (8, 9, 16):
        assert (models.level == level).sum() == len({seq[i - level : i] for i in range(level, len(seq))})


def test_reverse_members_train_reversed(spark):
    a = spark.createDataFrame([("a", "AACCGGT" * 30, False, 1)], "contig_id string, seq string, reverse boolean, cluster int")
    b = spark.createDataFrame([("a", "ACCGGTT" * 30, True, 1)], "contig_id string, seq string, reverse boolean, cluster int")
    x, y = X.trained(spark, a, 5, 4), X.trained(spark, b, 5, 4)
    assert dict(zip(x.contexts(), x.counts.tolist(), strict=True)) == dict(zip(y.contexts(), y.counts.tolist(), strict=True))


def test_dissolved_and_reassigned(spark):
    state = spark.createDataFrame([(f"c{i}", "ACGT", 4, 0 if i < 3 else 1, False, i != 4) for i in range(5)], "contig_id string, seq string, len int, cluster int, reverse boolean, active boolean")
    assert {r["contig_id"]: r["cluster"] for r in C.dissolved(state, -1).collect()} == {"c0": 0, "c1": 0, "c2": 0, "c3": -1, "c4": -1}
    found = spark.createDataFrame([("c0", 0, False, 1.0, 0.0), ("c0", 1, False, 1.0, 0.0), ("c1", 0, False, -1.0, 0.0), ("c2", 1, False, 5.0, 0.0)], "contig_id string, cluster int, backward boolean, score double, squares double")
    after = C.reassigned(state, found)
    assert {r["contig_id"]: r["cluster"] for r in after.collect()} == {"c0": 0, "c1": -1, "c2": 1, "c3": -1, "c4": 1}
    assert C.movement(state, after, found).first().asDict() == {"assigned": 0, "reassigned": 1, "stayed": 1, "negative": 2, "deassigned": 2}


def test_clusters_of_unknown_contigs(spark):
    contigs = spark.createDataFrame([("a",), ("b",)], "contig_id string")
    clusters = spark.createDataFrame([("b", 4)], "contig_id string, cluster int")
    assert {tuple(r) for r in C.mapped_back(contigs, clusters).collect()} == {("a", -1), ("b", 4)}
    with pytest.raises(Exception, match="no such contig: c"):
        C.mapped_back(contigs, spark.createDataFrame([("c", 1)], "contig_id string, cluster int")).collect()


def test_weakest():
    row = lambda k, norm, cv, absorb: {"cluster": k, "mean_norm": norm, "cv": cv, "absorbability": absorb}
    assert C.weakest([row(0, 0.5, 0.1, 0.1), row(1, 0.5, 0.1, 0.1)], 2, 0.7, 2.0) == -1
    assert C.weakest([row(0, 0.005, 0.1, 0.1), row(1, 0.5, 0.1, 0.1)], 2, 0.7, 2.0) == 0
    assert C.weakest([row(0, 0.5, 0.1, 0.1)], 2, 0.7, 2.0) == -1
    assert C.weakest([row(0, 0.5, 0.1, 0.1), row(1, 0.5, 0.1, 0.9)], 2, 0.7, 2.0) == 1
    assert C.weakest([row(0, 0.5, 0.9, 0.1), row(1, 0.5, 0.1, 0.9)], 2, 0.7, 2.0) == 0
    assert [C.top_ratio(x) for x in ([], [5.0], [5.0, 0.0], [10.0, 2.0, 1.0])] == [0, 0, 0, 5]


def test_grades(spark):
    names = {1: ["AAfoo", "AAbar", "BBquux"], 2: ["BBx", "BBy"]}
    bins = spark.createDataFrame([(c, k) for k, own in names.items() for c in own], "contig_id string, bin int")
    un = spark.createDataFrame([("CCorphan",)], "contig_id string")
    row = G.grade(bins, un).first()
    assert (row["n_bins"], row["correct"], row["assigned"], row["unassigned"]) == (2, 4, 5, 1)
    assert sorted(tuple(r) for r in G.dump(bins, un).collect())[-1] == ("CCorphan", "bin_none")
    assert not G.all_pure(bins).first()["all_pure"]
    none = bins.where("bin > 9")
    assert G.grade(none, un).first()["accuracy"] == 0.0


def test_details_of_every_bin(spark, small):
    rows = Q.QUERIES["every_bin_details"](spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/part.parquet").count()
    one = {tuple(x) for x in Q.QUERIES["bin_details"](spark, small).collect()}
    assert one == {(x["contig_id"], x["pct"], x["match_len"], x["hit"], x["bitscore"], x["place"]) for x in rows if x["bin"] == 1}
    for k in range(1, 8):
        own = [x["place"] for x in rows if x["bin"] == k]
        assert sorted(own) == list(range(1, len(own) + 1)) and own


def test_empty_binning(spark):
    empty = spark.createDataFrame([], "contig_id string, seq string, len int")
    bins, un = P.by_distance(spark, empty)
    assert bins.count() == 0 and un.count() == 0
    lonely = spark.createDataFrame([("a", "ACGTACGT", 8), ("b", "", 0)], "contig_id string, seq string, len int")
    bins, un = P.by_distance(spark, lonely)
    assert bins.count() == 0 and un.count() == 2
    assert P.by_models(spark, lonely).count() == 2


def test_model_binning_parts_two_kinds(spark):
    r = random.Random(5)
    kinds = {"AA": [6, 1, 1, 2], "BB": [1, 4, 5, 1]}
    rows = [(f"{k}{i}", s := "".join(r.choices("ACGT", w, k=r.randrange(600, 900))), len(s)) for k, w in kinds.items() for i in range(8)]
    contigs = spark.createDataFrame(rows, "contig_id string, seq string, len int")
    settings = P.ModelSettings(min_len=500, min_members=3, thresholds=(500, 1))
    state = P.by_models(spark, contigs, settings)
    groups: dict[int, set] = {}
    for x in state.collect():
        groups.setdefault(x["cluster"], set()).add(x["contig_id"][:2])
    assert all(len(g) == 1 for g in groups.values()), groups


class Simulated:
    """Models of clusters as dictionaries of contexts, and the steps of both model binnings over plain lists.

    A contig is [name, seq, cluster, reverse, active].
    """

    def __init__(self, rows, none, support):
        self.rows, self.none, self.support = rows, none, support

    @staticmethod
    def turned(seq):
        return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))

    def dissolve(self, n=None):
        size = Counter(r[2] for r in self.rows if r[4])
        for r in self.rows:
            if size[r[2]] < 3 or (n is not None and r[2] > n):
                r[2] = self.none

    def models(self, depth=40):
        out = {}
        for k in sorted({r[2] for r in self.rows if r[4]} - {self.none}):
            counts = {}
            for _, seq, _, reverse, _ in (r for r in self.rows if r[4] and r[2] == k):
                s = self.turned(seq) if reverse else seq
                for i, b in enumerate(s):
                    for n in range(min(i, depth) + 1):
                        counts.setdefault(s[i - n : i][::-1], Counter())[b] += 1
            kept = {c: x for c, x in counts.items() if not c or x.total() > self.support}
            p = {}
            for c in sorted(kept, key=len):
                total = kept[c].total()
                above = p[c[:-1]] if c else dict.fromkeys("ACGT", 0.25)
                p[c] = {b: (1 - 1 / total) * kept[c][b] / total + above[b] / total for b in "ACGT"}
            out[k] = p
        return out

    @staticmethod
    def score(p, s):
        out = 0.0
        for i, b in enumerate(s):
            n = 0
            while n < min(i, 40) and s[i - n - 1 : i][::-1] in p:
                n += 1
            out += np.log2(4 * max(1 / 64, p[s[i - n : i][::-1]][b]))
            if b not in p:
                break
        return out

    def scores(self, both):
        models = self.models()
        return {r[0]: {(k, way): self.score(p, self.turned(r[1]) if way else r[1]) for k, p in models.items() for way in ((False, True) if both else (False,))} for r in self.rows if r[4]}

    def settle(self, n):
        while True:
            self.dissolve(n)
            found, moved = self.scores(True), False
            if not any(found.values()):
                return
            for r in self.rows:
                if r[4]:
                    k, way = max(found[r[0]], key=lambda x: (found[r[0]][x], -x[0], not x[1]))
                    moved |= (k, way) != (r[2], r[3])
                    r[2:4] = k, way
            if not moved:
                return

    def by_models(self, n, thresholds, least_next=0.0):
        for least in thresholds:
            for r in self.rows:
                r[4] |= len(r[1]) >= least
            self.settle(n)
            for _ in range(n):
                self.dissolve(n)
                found = self.scores(True)
                elsewhere = {}
                for r in self.rows:
                    if r[4] and 1 <= r[2] <= n:
                        elsewhere.setdefault(r[2], []).append(max((x for (k, _), x in found[r[0]].items() if k != r[2]), default=-np.inf))
                worst, score = max(((k, np.mean(x)) for k, x in elsewhere.items()), key=lambda x: (x[1], -x[0]), default=(1, -np.inf))
                if score < least_next:
                    break
                for r in self.rows:
                    r[2] = 0 if r[2] == worst else r[2]
                self.settle(n)

    def reassign(self, found, without=None):
        for r in self.rows:
            if r[4]:
                best = max(((x, -k) for (k, _), x in found[r[0]].items() if k != without), default=(0, 0))
                r[2] = -best[1] if best[0] > 0 else -1

    def likelihood(self, found):
        own = [(found[r[0]][r[2], False], len(r[1])) for r in self.rows if r[4] and r[2] != -1]
        return sum(x for x, _ in own) / sum(n for _, n in own) if own else -np.inf

    def weakness(self, found):
        out = []
        for k in sorted({r[2] for r in self.rows if r[4]} - {-1}):
            own = [(found[r[0]][k, False], max([x for (j, _), x in found[r[0]].items() if j != k], default=-np.inf), len(r[1])) for r in self.rows if r[4] and r[2] == k]
            norm = [a / n for a, _, n in own]
            out.append({"cluster": k, "mean_norm": np.mean(norm), "cv": np.std(norm) / np.mean(norm) if len(norm) > 1 and np.mean(norm) else 0.0, "absorbability": np.mean([b for _, b, _ in own]) / max(np.mean([a for a, _, _ in own]), 1.0)})
        return out

    def refine(self, n, thresholds):
        def scored():
            self.dissolve()
            return self.scores(False)

        for least in thresholds:
            for r in self.rows:
                r[4] |= len(r[1]) >= least
            found = scored()
            self.reassign(found)
            found = scored()
            for _ in range(max(n, 1)):
                worst = C.weakest(self.weakness(found), n, 0.7, 2.0)
                if worst == -1:
                    break
                before, kept = self.likelihood(found), [list(r) for r in self.rows]
                self.reassign(found, worst)
                new = scored()
                if self.likelihood(new) < before:
                    self.rows = kept
                    break
                found = new


def kinds_of_contigs(seed, sizes, low, high):
    r = random.Random(seed)
    kinds = {"AA": [6, 1, 1, 2], "BB": [1, 4, 5, 1], "CC": [2, 3, 1, 4]}
    return [(f"{k}{i:02d}", "".join(r.choices("ACGT", w, k=r.randrange(low, high)))) for (k, w), n in zip(kinds.items(), sizes, strict=False) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_model_binning_same_as_simulated(spark, seed):
    rows = kinds_of_contigs(seed, (9, 8, 7), 300, 700)
    contigs = spark.createDataFrame([(n, s if i % 3 else Simulated.turned(s), len(s)) for i, (n, s) in enumerate(rows)], "contig_id string, seq string, len int")
    settings = P.ModelSettings(min_len=400, min_members=3, thresholds=(450, 1), support=20)
    state, n = P.seeded(spark, Scratch(spark, "test"), contigs, settings)
    start = [[x["contig_id"], x["seq"], x["cluster"], x["reverse"], False] for x in state.collect()]
    assert n > 1
    plain = Simulated(start, 0, 20)
    plain.by_models(n, settings.thresholds)
    got = {x["contig_id"]: (x["cluster"], x["reverse"], x["active"]) for x in P.by_models(spark, contigs, settings).collect()}
    assert got == {r[0]: tuple(r[2:]) for r in plain.rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_refined_binning_same_as_simulated(spark, seed):
    rows = kinds_of_contigs(seed, (24, 20, 16), 200, 500)
    contigs = spark.createDataFrame([(n, s, len(s)) for n, s in rows], "contig_id string, seq string, len int")
    distance, settings = P.DistanceSettings(low=40, high=95, creation=0.3, selection=0.35, final=0.35), P.ModelSettings(support=20)
    bins, _ = P.by_distance(spark, contigs, distance)
    of = {x["contig_id"]: x["bin"] - 1 for x in bins.collect()}
    assert len(set(of.values())) > 1
    plain = Simulated([[n, s, of.get(n, -1), False, n in of] for n, s in rows], -1, 20)
    plain.refine(max(of.values()) + 1, G.length_thresholds(contigs))
    got = {x["contig_id"]: (x["cluster"], x["active"]) for x in P.by_both(spark, contigs, distance, settings).collect()}
    assert got == {r[0]: (r[2], r[4]) for r in plain.rows}


def test_loops_end_when_states_come_again(spark):
    turns = P.Turns("rows", "x")
    state = lambda *x: spark.createDataFrame([(v,) for v in x], "x int")
    assert not turns.again(state(1, 2)) and not turns.again(state(1, 3))
    with pytest.warns(UserWarning, match="come again after 2 turns"):
        assert turns.again(state(2, 1))


def test_stream(spark, tmp_path, small):
    from loomstrand.operators.kmers import profiles, shares
    from loomstrand.streaming.assign import assigned_stream

    contigs = P.contigs_of(spark.read.parquet(f"{small}/documents.parquet")).where("len > 200")
    own = profiles(contigs).select("contig_id", shares("counts").alias("p"))
    bins, _ = P.by_distance(spark, contigs)
    bins.write.parquet(str(tmp_path / "bins"))
    own.write.parquet(str(tmp_path / "own"))
    contigs.limit(20).select("contig_id", "seq").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("contig_id string, seq string").parquet(str(tmp_path / "in"))
    assigned_stream(spark, stream, spark.read.parquet(str(tmp_path / "bins")), spark.read.parquet(str(tmp_path / "own")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 20 and out.where("bin is not null").count() > 10


def test_distance_at_the_threshold(spark):
    """Profiles exactly 0.1 apart, of contigs of the 0.1 GB tables: sums of rounded shares fall to either side of it."""
    r, found = random.Random(5), []
    for n, m in ((3840, 4752), (4220, 5715), (4348, 5435), (5732, 7165), (4800, 5400), (4000, 4000)) * 20:
        # counts in a common part g of both sizes; a tenth of it is moved
        g = np.gcd(n, m)
        units = np.bincount([r.randrange(256) for _ in range(g - g // 10)], minlength=256)
        moved = [np.bincount([r.randrange(128) + k for _ in range(g // 10)], minlength=256) for k in (0, 128)]
        if g % 10 == 0:
            found.append([((units + x) * (size // g) / size).tolist() for x, size in zip(moved, (n, m), strict=True)])
    assert len(found) > 10
    for x, y in found:
        rows = [{"contig_id": name, "p": p} for name, p in (("x", x), ("y", y))]
        table = [pa.Table.from_pylist([row]) for row in rows]
        assert not len(variation_kernel(0.1)(*table, False))
        assert len(variation_kernel(0.1, True)(*table, False)) == 1


def test_tries_in_pieces(spark, monkeypatch):
    """Tries that the driver never holds whole: deep tops, several passes and pieces, against brute force at depth 40."""
    for name, value in (("HEAVY", 120), ("BUCKET", 500), ("PASS", 1500), ("PIECE", 800), ("LEVELS", 2)):
        monkeypatch.setattr(X, name, value)
    r = random.Random(8)
    unit, make = "".join(r.choices("ACGT", k=90)), lambda k: "".join(r.choices("ACGTN", [4, 3, 2, 1, 0.05], k=k))
    train = {1: [unit + make(300) for _ in range(12)], 2: [make(200) + unit * 2 for _ in range(8)], 3: [make(100)]}
    rows = [(f"c{k}_{i}", s, False, k) for k, own in train.items() for i, s in enumerate(own)]
    members = spark.createDataFrame(rows, "contig_id string, seq string, reverse boolean, cluster int")
    models = X.trained(spark, members, 5, 40)
    found = X.scores(spark, members, models).collect()
    assert models.n_pieces > 2 and (models.top.level > 3).any() and len(X.trained(spark, members, 5, 1).top.parent) == 16
    assert len(models.top.parent) < (models.level >= 0).sum() / 2
    assert len(found) == 3 * len(rows)
    by_name = {n: s for n, s, _, _ in rows}
    for x in r.sample(found, 12):
        assert x["score"] == pytest.approx(walked(train[x["cluster"]], by_name[x["contig_id"]], 5, 40), abs=1e-6), x
    listed = {(x["cluster"], x["context"]): [x[f"n_{b}"] for b in "acgt"] for x in X.states(spark, models).collect()}
    seen = {}
    for k, own in train.items():
        for s in own:
            for i, b in enumerate(s):
                for n in range(41 if b != "N" else 0):
                    if i < n or n and s[i - n] == "N":
                        break
                    seen.setdefault((k, s[i - n : i][::-1]), Counter())[b] += 1
    assert listed == {c: [n[b] for b in "ACGT"] for c, n in seen.items() if n.total() > 5}


def test_percentiles_hold_no_group(spark, monkeypatch):
    """The same as Spark's over whole groups, with ties, cells of many ranks, one value, nulls and none; no plan holds a group's values."""
    r = random.Random(9)
    rows = [("a", "b", r.choice([r.random(), 0.25, 1.0, 0.0])) for _ in range(500)] + [("a", "c", 0.5), ("b", "b", None), ("b", "c", 0.1), ("b", "c", 0.4)]
    df = spark.createDataFrame(rows, "org string, other string, dist double")
    want = df.where("dist is not null").groupBy("org", "other").agg(F.count("*").alias("n"), F.avg("dist").alias("mean"), F.min("dist").alias("min"), F.max("dist").alias("max"), F.percentile("dist", F.array(*[F.lit(p) for p in D.DISTANCE_POINTS])).alias("points"))
    key = lambda x: (x["org"], x["other"])
    for cells in (3, 100_000):
        monkeypatch.setattr(D, "CELLS", cells)
        got = sorted(D.exact_percentiles(df, D.DISTANCE_POINTS, "org", "other").collect(), key=key)
        assert [key(x) for x in got] == [("a", "b"), ("a", "c"), ("b", "c")]
        for x, y in zip(got, sorted(want.collect(), key=key), strict=True):
            assert [x["n"], x["min"], x["max"]] == [y["n"], y["min"], y["max"]]
            assert [x["mean"], *x["points"]] == pytest.approx([y["mean"], *y["points"]], abs=1e-12)
    assert D.distance_stats(df.where("dist > 2")).collect()[0].asDict() == {"n": 0} | dict.fromkeys(["mean", "min", "max", "p0_25", "p0_5", "p1", "p5", "p10", "p50", "p99", "p99_9"])
    for out in (D.distance_stats(df), D.organism_stats(df.select(F.col("org").alias("a"), F.col("other").alias("b"), "dist"))):
        assert "percentile" not in out._jdf.queryExecution().toString()


def test_chi_squared_links(spark, monkeypatch):
    """Degrees and components of blocks are those of all pairs, for profiles alike, apart, empty and far apart in size."""
    r = np.random.default_rng(5)
    kinds = r.dirichlet(np.full(256, 2.0), 3)
    kinds = np.concatenate([kinds, kinds[:1][:, [D._reverse_number(i, 4) for i in range(256)]]])
    rows = [r.multinomial(int(n), kinds[i % 4]) for i, n in enumerate(r.integers(3000, 9000, 90))]
    rows += [r.multinomial(2_000_000, kinds[0]), r.multinomial(40, kinds[0]), np.zeros(256, int), rows[0], 5 * rows[0]]
    rows = [(i * 10, [int(v) for v in x]) for i, x in enumerate(rows)]
    for n, some in ((len(rows), rows), (90, rows[:90])):
        frame = spark.createDataFrame(some, "contig_id long, counts array<long>")
        pairs = D.chi_squared_pairs(frame, 255.0).select("a", "b").collect()
        assert 0 < len(pairs) < n * (n - 1) // 2
        want = Counter(x for p in pairs for x in p)
        for most in (4096, 16):
            monkeypatch.setattr(D, "LINK_ROWS", most)
            links = D.chi_squared_links(frame, 255.0).collect()
            assert len(links) <= n * (-(-n // most)) * 2
            got = Counter()
            for x in links:
                got[x["node"]] += x["degree"]
            assert got == want
            graph = lambda found: {x["node"]: x["root"] for x in components(Scratch(spark, "t"), spark.createDataFrame(found, "a long, b long")).collect()}
            assert graph([(x["root"], x["node"]) for x in links]) == graph([tuple(x) for x in pairs])


def test_share_below_cross_of_no_pairs(spark, monkeypatch):
    """Shares of close pairs within organisms from blocks' counts, as from the list of all pairs."""
    r = np.random.default_rng(3)
    kinds = {"aa": r.dirichlet(np.full(256, 1.0)), "bb": r.dirichlet(np.full(256, 1.0)), "c": r.dirichlet(np.full(256, 1.0))}
    kinds["cc"] = 0.7 * kinds["bb"] + 0.3 * kinds["aa"]
    rows = [(f"{k}_{i}" if k != "c" else f"c{i}", [float(v) for v in r.multinomial(400, p) / 400]) for k, p in kinds.items() for i in range(25)] + [("aa_x", [0.0] * 256)]
    for some in (rows, rows[:25], rows[:1], []):
        frame = spark.createDataFrame(some, "contig_id string, p array<double>")
        want = D.share_below_cross(D.variation_pairs(frame)).collect()
        for most in (7, 512):
            monkeypatch.setattr(D, "LINK_ROWS", most)
            found = D.share_below_cross_of(frame)
            assert {x["org"]: round(x["share"], 9) for x in found.collect()} == {x["org"]: round(x["share"], 9) for x in want}


def test_harmonic_bound_decides_close_pairs():
    """Features give sum(ab / (a + b)) within their bound, and nearly all pairs that bounds by shares leave open are decided without a sum of their own."""
    r = np.random.default_rng(8)
    kind = r.dirichlet(np.full(256, 3.0))
    x, y = (np.array([r.multinomial(int(n), r.dirichlet(kind * 8000)) for n in r.integers(3000, 9000, 300)], float) for _ in range(2))
    by = D.Harmonic(int(max(x.max(), y.max())))
    (fx, rest_x), (fy, rest_y) = by.features(x), by.features(y)
    bound = rest_x[:, None] * rest_y + by.rounding * np.sqrt(x.sum(1)[:, None] * y.sum(1))
    a, b = x[:40, None], y[None]
    assert (np.abs(by.sums(fx, fy)[:40] - (a * b / np.maximum(a + b, 1)).sum(2)) <= bound[:40]).all()
    order = [D._reverse_number(i, 4) for i in range(256)]
    want = np.array([np.minimum(D.chi_squared(v, y), D.chi_squared(v, y[:, order])) <= 380.0 for v in x])
    assert 0.1 < want.mean() < 0.9
    x, y = CountedRows.of(x), CountedRows.of(y)
    assert (D._linked(x, y, 380.0, order) == want).all()
    assert CountedRows.taken < want.size / 10


class CountedRows(np.ndarray):
    """Profiles that count the rows taken from them one by one."""

    taken = 0

    @classmethod
    def of(cls, x):
        return x.view(cls)

    def __getitem__(self, key):
        if isinstance(key, np.ndarray) and key.dtype == np.int64 and key.ndim == 1:
            CountedRows.taken += len(key)
        return super().__getitem__(key)


def test_only_changed_clusters_are_trained(spark, monkeypatch):
    """A cluster whose members stay is not trained again, for a removal, a next threshold or the turns' last look, and the result is that of plain turns."""
    contigs = spark.createDataFrame([(n, s, len(s)) for n, s in kinds_of_contigs(3, (8, 8, 8), 300, 700)], "contig_id string, seq string, len int")
    settings = P.ModelSettings(min_len=400, min_members=3, thresholds=(450, 1), support=20)
    held, trained = [], C.trained

    def counted(spark, members, support):
        sets = {}
        for r in members.collect():
            sets.setdefault(r["cluster"], set()).add((r["seq"], r["reverse"]))
        held.append(sets)
        return trained(spark, members, support)

    monkeypatch.setattr(C, "trained", counted)
    got = sorted(map(tuple, P.by_models(spark, contigs, settings).collect()))
    assert held and all(before.get(c) != members for before, after in zip(held, held[1:], strict=False) for c, members in after.items())
    times, used = len(held), C.Comparison.of
    monkeypatch.setattr(C.Comparison, "of", lambda self, state, tag: used(C.Comparison(spark, self.scratch, self.none, self.both, self.support), state, tag))
    assert sorted(map(tuple, P.by_models(spark, contigs, settings).collect())) == got
    assert len(held) - times > times


def test_variation_links_and_nearest_of_no_pairs(spark, monkeypatch):
    """Components and nearest bins of blocks are those of all pairs, for families, copies, single rows and empty profiles, in one block and in many."""
    r = np.random.default_rng(11)
    kinds = r.dirichlet(np.full(256, 2.0), 3)
    rows = [r.multinomial(int(n), kinds[i % 3]) / int(n) for i, n in enumerate(r.integers(900, 9000, 90))]
    rows += [r.multinomial(1500, 0.93 * kinds[0] + 0.07 * kinds[1]) / 1500 for _ in range(8)] + [rows[0], rows[1], np.zeros(256), r.dirichlet(np.full(256, 0.1))]
    rows = [(f"c{i}", i, [float(v) for v in p]) for i, p in enumerate(rows)]
    frame = spark.createDataFrame(rows, "contig_id string, rank long, p array<double>").localCheckpoint()
    pairs = D.variation_pairs(frame).localCheckpoint()
    close = pairs.where("dist < 0.13")
    assert 0 < close.count() < len(rows) * (len(rows) - 1) // 2
    bins = B.created(Scratch(spark, "t"), frame, close).localCheckpoint()
    want, near = sorted(map(tuple, bins.collect())), sorted(map(tuple, B.with_nearest(frame, pairs, bins, 0.3).collect()))
    assert 1 < len(want) < len(near) < len(rows)
    for most in (16, 4096):
        monkeypatch.setattr(D, "LINK_ROWS", most)
        links = D.variation_links(Scratch(spark, "t"), frame.select(F.col("rank").alias("node"), "p"), 0.13)
        assert links.count() < close.count() / 2
        assert sorted(map(tuple, B.linked(Scratch(spark, "t"), frame, links).collect())) == want
        assert sorted(map(tuple, B.with_nearest_of(frame, bins, 0.3).collect())) == near


def test_distance_binning_lists_no_pairs(spark, monkeypatch):
    """Distance binning takes no list of a selection's pairs: nearly all pairs of one organism are close, so it grew with their square."""
    contigs = spark.createDataFrame([(n, s, len(s)) for n, s in kinds_of_contigs(3, (8, 8), 600, 900)], "contig_id string, seq string, len int")

    def listed(*_):
        raise AssertionError("pairs are listed")

    monkeypatch.setattr(P, "variation_pairs", listed, raising=False)
    bins, rest = P.by_distance(spark, contigs, P.DistanceSettings(low=0, high=100, creation=0.2, selection=0.3, minimal=True))
    assert bins.count() + rest.count() == 16 and bins.count()


def test_few_links_in_one_task(spark):
    r = random.Random(4)
    links = [(r.randrange(40), r.randrange(40)) for _ in range(35)] + [(50, i) for i in range(51, 60)]
    frame = spark.createDataFrame(links, "a int, b int")
    for one, rounds in ((sized_components, components), (sized_leaders, leaders)):
        assert sorted(map(tuple, one(Scratch(spark, "t"), frame).collect())) == sorted(map(tuple, rounds(Scratch(spark, "t"), frame).collect()))


def test_lettered_same_as_contigs(spark):
    rows = [(1, "en", "Ab, zZéİ x\n"), (2, None, None), (3, "de", ""), (4, "fr", "K 12 \U0001f600 q")]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert sorted(map(tuple, P.lettered(frame).collect())) == sorted(map(tuple, P.contigs_of(frame).collect()))


def test_every_variation_rounded_where_it_is_taken(spark, monkeypatch):
    """All pairs with distances rounded as by SQL, halves upwards, within blocks and across; Spark's slow rounding of decimals is not in the plan."""
    r = np.random.default_rng(2)
    rows = [r.multinomial(6400 if i % 2 else 3200, r.dirichlet(np.full(256, 1.0))) / (6400 if i % 2 else 3200) for i in range(40)]
    near = rows[1].copy()
    near[near.argmax()] -= 4 / 6400
    near[near.argmin()] += 4 / 6400
    rows = [(f"c{i}", [float(v) for v in p]) for i, p in enumerate([*rows, rows[0], near, np.zeros(256)])]
    frame = spark.createDataFrame(rows, "contig_id string, p array<double>")
    want = {(a, b): d for a, b, d in D.variation_pairs(frame).withColumn("dist", F.round("dist", 6)).collect()}
    found = D.every_variation(frame, 6)
    assert {(a, b): d for a, b, d in found.collect()} == want and len(want) == 43 * 42 // 2
    assert (D._rounded(np.array([0.0003125, 0.0000005, 0.1234564999999]), 6) == [0.000313, 0.000001, 0.123456]).all()


def test_scores_of_contigs_without_bases(spark, tmp_path):
    """Texts without a letter, and a cluster of nothing else: z-scores as SQL has them."""
    import duckdb

    from loomstrand.oracles import ORACLE_SQL

    from .conftest import canonical

    r = random.Random(5)
    docs = [(i, "".join(r.choices("abcd", k=80)), "en", "s") for i in range(30)]
    docs += [(30, "", "en", "s"), (31, None, "en", "s"), (32, "12 34", "fr", "s"), (33, "...", "fr", "s")]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(path)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    for name in ("score_histogram", "score_outliers", "score_per_base"):
        rel = duck.sql(ORACLE_SQL[name])
        want = [dict(zip(rel.columns, row, strict=True)) for row in rel.fetchall()]
        assert canonical([x.asDict() for x in Q.QUERIES[name](spark, str(tmp_path)).collect()]) == canonical(want), name


def test_z_scores_without_variance(spark):
    """Without variance, or with one that rounding left under 0, scores over the mean are at the top, those under it outliers."""
    state = spark.createDataFrame([("a", 4, 1), ("b", 4, 1), ("c", 4, 1), ("d", 0, 1), ("e", 4, 2)], "contig_id string, len int, cluster int")
    found = spark.createDataFrame([("a", 1, 8.0), ("b", 1, 0.0), ("c", 1, 4.0), ("d", 1, 0.0), ("e", 2, 1e12)], "contig_id string, cluster int, score double")
    for var in (0.0, -1e-17):
        stats = spark.createDataFrame([(1, 1.0, var), (2, 0.0, 1e-30)], "cluster int, mean double, var double")
        assert {tuple(x) for x in G.score_histogram(state, found, stats).collect()} == {(1, 10, 3, 0), (1, -10, 1, 0), (2, 10, 1, 0)}
        assert {x["contig_id"]: x["cluster"] for x in G.outliers(state, found, stats).collect()} == {"a": 1, "b": 0, "c": 1, "d": 1, "e": 2}


@pytest.mark.parametrize("longest", [1, 3, 11])
def test_contexts_looked_up_at_once(spark, monkeypatch, longest):
    """Scoring looks up the last bases of a context at once: as many as the clusters' tries need, at most JUMP, and walks on from there, in all pieces."""
    for name, value in (("HEAVY", 120), ("BUCKET", 500), ("PASS", 1500), ("PIECE", 800), ("LEVELS", 2), ("JUMP", longest)):
        monkeypatch.setattr(X, name, value)
    r = random.Random(9)
    unit, make = "".join(r.choices("ACGT", k=70)), lambda k: "".join(r.choices("ACGTN", [4, 3, 2, 1, 0.1], k=k))
    train = {1: [unit + make(200) for _ in range(10)], 2: [make(200) + unit for _ in range(6)], 3: ["", "N", "A", "NNAC"]}
    rows = [(f"c{k}_{i}", s, False, k) for k, own in train.items() for i, s in enumerate(own)]
    models = X.trained(spark, spark.createDataFrame(rows, "contig_id string, seq string, reverse boolean, cluster int"), 5, 40)
    pieces = list(models.pieces())
    sizes = {piece.jump(c)[0] for piece in pieces for c in piece.clusters}
    assert len(pieces) > 2 and max(sizes) <= longest and (longest < 11 or len(sizes) > 1)
    seqs, sums = [s for _, s, _, _ in rows], {}
    for piece in pieces:
        for c, score, squares in piece.scored([X.coded(s) for s in seqs], True):
            assert (squares >= 0).all()
            sums[c] = sums.get(c, 0) + score
    for c, own in train.items():
        assert sums[c] == pytest.approx([walked(own, s, 5, 40) for s in seqs], abs=1e-6)
