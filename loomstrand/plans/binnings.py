"""Whole binnings: by distances, by context models, and both after each other.

The loops run on the driver over stored tables: each turn reads the last
turn's table, so plans stay short and a lost executor repeats one step.
"""

from __future__ import annotations

import warnings
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import K, oriented, pseudo_sequence
from ..joins import sized
from ..operators import bins as B
from ..operators import clusters as C
from ..operators.distances import chi_squared, variation_links
from ..operators.grading import grade, length_thresholds
from ..operators.kmers import _reverse_number, profiles, shares
from ..scratch import Scratch, interpreted


@dataclass(frozen=True)
class DistanceSettings:
    """Fixed values of the defaults."""

    k: int = K
    low: float = 85.0
    high: float = 95.0
    creation: float = 0.1
    selection: float = 0.175
    merging: tuple[float, ...] = (0.02, 0.03125, 0.04, 0.05, 0.0625)
    reduction: float = 16.0
    final: float = 0.5
    minimal: bool = False


@dataclass(frozen=True)
class ModelSettings:
    """Fixed values of the defaults."""

    min_len: int = 3000
    min_members: int = 6
    chi: float = 255.0
    thresholds: tuple[int, ...] = (3000, 2000, 1000, 1)
    least_next: float = 0.0
    absorb: float = 0.7
    cv_ratio: float = 2.0
    tolerance: float = 0.0
    skip_removal: bool = False
    support: int = 50


def contigs_of(documents: DataFrame, unknown: bool = False) -> DataFrame:
    """(contig_id, seq, len) from documents: letters stand for bases; names are lang_doc_id."""
    rows = documents.select(F.concat_ws("_", F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string")).alias("contig_id"), pseudo_sequence(F.coalesce("text", F.lit("")), unknown).alias("seq"))
    return rows.withColumn("len", F.length("seq"))


def lettered(documents: DataFrame) -> DataFrame:
    """``contigs_of`` without unknown bases, letter by letter in Arrow batches: some times faster. It reads whole texts, and is meant for a table that is stored."""

    def run(batches):
        import pyarrow as pa

        letters = bytes(c for c in range(128) if chr(c).isalpha())
        base = bytes.maketrans(letters, bytes(ord("ACGT"[(c | 32) - ord("a") & 3]) for c in letters))
        others = bytes(c for c in range(256) if c not in letters)
        for batch in batches:
            seqs = [x.as_buffer().to_pybytes().translate(base, others) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seqs, pa.binary()).cast(pa.string())], ["contig_id", "seq"])

    rows = documents.select(F.concat_ws("_", F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string")).alias("contig_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "contig_id string, seq string").withColumn("len", F.length("seq"))


def spread(contigs: DataFrame) -> DataFrame:
    """The contigs over as many tasks as a shuffle has: one file may hold them all."""
    n = int(contigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contigs.repartition(n, "contig_id")


def by_distance(spark: SparkSession, contigs: DataFrame, settings: DistanceSettings = DistanceSettings()) -> tuple[DataFrame, DataFrame]:
    """(contig_id, bin) and (contig_id) unbinned, of contigs (contig_id, seq, len)."""
    with interpreted(spark):
        return _by_distance(spark, contigs, settings)


def _by_distance(spark: SparkSession, contigs: DataFrame, settings: DistanceSettings) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark, "distance")
    return _binned(scratch, scratch.write(measured(contigs, settings.k), "shares"), settings)


def measured(contigs: DataFrame, k: int = K) -> DataFrame:
    """(contig_id, len, p) of contigs (contig_id, seq, len), in one pass."""
    return profiles(spread(contigs.select("contig_id", "seq", "len")), k, "len").select("contig_id", "len", shares("counts").alias("p"))


def _binned(scratch: Scratch, rows: DataFrame, settings: DistanceSettings) -> tuple[DataFrame, DataFrame]:
    """``by_distance`` of stored rows (contig_id, len, p)."""
    own, lens = rows.select("contig_id", "p"), rows.select("contig_id", "len")
    selection = scratch.write(B.percentile_selection(lens, settings.low, settings.high), "selection")
    chosen = scratch.write(own.join(sized(selection.select("contig_id", "rank")), "contig_id"), "chosen")
    links = variation_links(scratch, chosen.select(F.col("rank").alias("node"), "p"), settings.creation)
    first = scratch.write(B.linked(scratch, selection, links), "first")
    near = scratch.write(B.with_nearest_of(chosen, first, settings.selection), "near")
    if not settings.minimal and not near.isEmpty():
        merged = B.combined(scratch, near, own, settings.merging)
        core = scratch.write(B.reduced(merged, settings.reduction), "core")
        again = scratch.write(B.with_nearest_median(core, selection, own, settings.selection)[0], "again")
        near = scratch.write(B.with_nearest_median(again, lens, own, settings.final)[0], "final")
    return near, lens.select("contig_id").join(near, "contig_id", "left_anti")


class Turns:
    """The states that a loop has been in, as digests of their rows.

    A turn depends on the state alone, so a state that comes again would come
    again for ever: the loop ends there, with a warning, in that state.
    """

    def __init__(self, what: str, *columns: str):
        self.what, self.columns, self.seen = what, columns, set()

    def again(self, state: DataFrame) -> bool:
        row = lambda seed: F.xxhash64(F.lit(seed), *self.columns)
        mark = tuple(state.agg(F.bit_xor(row(1)), F.bit_xor(row(2)), F.count("*")).first())
        if mark in self.seen:
            warnings.warn(f"{self.what} come again after {len(self.seen)} turns without a fixpoint", stacklevel=2)
            return True
        self.seen.add(mark)
        return False


def directions(scratch: Scratch, contigs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(contig_id, cluster, reverse): strands under which members agree best with their cluster's profile, to a fixpoint.

    The first reference is the member with the smallest pos, then the sum.
    """
    rows = scratch.write(profiles(contigs.join(seeds, "contig_id").select("contig_id", "seq")).join(seeds, "contig_id").join(contigs.select("contig_id", "pos"), "contig_id"), "direction-rows")
    order = [_reverse_number(i, K) for i in range(4**K)]
    state = rows.select("contig_id", "cluster", F.lit(False).alias("reverse"))
    reference = rows.groupBy("cluster").agg(F.min_by("counts", "pos").alias("profile"))
    kind = rows.schema["contig_id"].dataType.simpleString()

    def turned(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for own, profile in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x = np.array([own], float)
                out.append(bool(chi_squared(np.array(profile, float), x[:, order])[0] < chi_squared(np.array(profile, float), x)[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], ["contig_id", "cluster", "reverse"])

    turns = Turns("strands of seeds", "contig_id", "cluster", "reverse")
    for turn in count():
        new = rows.join(F.broadcast(reference), "cluster").select("contig_id", "cluster", "counts", "profile").mapInArrow(turned, f"contig_id {kind}, cluster int, reverse boolean")
        new = scratch.write(new, f"directions-{turn}")
        if new.join(state.withColumnRenamed("reverse", "old"), ["contig_id", "cluster"]).where("reverse <> old").isEmpty() or turns.again(new):
            return new
        state = new
        long_ = rows.join(new, ["contig_id", "cluster"]).select("cluster", "reverse", F.posexplode("counts").alias("i", "n"))
        flip = F.get(F.array(*[F.lit(x) for x in order]), F.col("i"))
        sums = long_.withColumn("i", F.when(F.col("reverse"), flip).otherwise(F.col("i"))).groupBy("cluster", "i").agg(F.sum("n").alias("n"))
        reference = scratch.write(sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "n"))), lambda x: x["n"]).alias("profile")), f"references-{turn}")


def seeded(spark: SparkSession, scratch: Scratch, contigs: DataFrame, settings: ModelSettings = ModelSettings()) -> tuple[DataFrame, int]:
    """The state (contig_id, seq, len, cluster, reverse, active) with seed clusters, and their number; others are in cluster 0."""
    placed = scratch.write(positioned(scratch, contigs), "placed")
    seeds = scratch.write(C.seed_clusters(scratch, placed, settings.min_len, settings.min_members, settings.chi), "seeds")
    n = seeds.agg(F.coalesce(F.max("cluster"), F.lit(0)).alias("n")).first()["n"]
    turned = directions(scratch, placed, seeds) if n else seeds.withColumn("reverse", F.lit(False))
    state = placed.join(turned, "contig_id", "left")
    state = state.select("contig_id", "seq", "len", F.coalesce("cluster", F.lit(0)).cast("int").alias("cluster"), F.coalesce("reverse", F.lit(False)).alias("reverse"), F.lit(False).alias("active"))
    return scratch.write(state, "state"), n


def positioned(scratch: Scratch, contigs: DataFrame) -> DataFrame:
    """contigs with pos: the place of contig_id in order."""
    return B.numbered(scratch, contigs, "positions", "contig_id").withColumnRenamed("place", "pos")


def settled(scratch: Scratch, comparison: C.Comparison, state: DataFrame, n: int, tag: str) -> DataFrame:
    """state after turns of models and best strands until no active contig moves."""
    turns = Turns("assignments", "contig_id", "cluster", "reverse")
    for turn in count():
        state = scratch.write(C.dissolved(state, 0, n), f"{tag}-in-{turn}")
        found = comparison.of(state, f"{tag}-scores-{turn}")
        if found.isEmpty():
            return state  # no cluster is left to move to
        new = scratch.write(C.best_orientations(state, found), f"{tag}-out-{turn}")
        moved = new.join(state.select("contig_id", F.col("cluster").alias("c"), F.col("reverse").alias("r")), "contig_id").where("active and (cluster <> c or reverse <> r)")
        if moved.isEmpty() or turns.again(new):
            return new
        state = new


def by_models(spark: SparkSession, contigs: DataFrame, settings: ModelSettings = ModelSettings()) -> DataFrame:
    """The final state (contig_id, len, cluster, reverse, active) of model binning."""
    with interpreted(spark):
        return _by_models(spark, contigs, settings)


def _by_models(spark: SparkSession, contigs: DataFrame, settings: ModelSettings) -> DataFrame:
    scratch = Scratch(spark, "models")
    state, n = seeded(spark, scratch, contigs, settings)
    comparison = C.Comparison(spark, scratch, 0, True, settings.support)
    for least in settings.thresholds:
        state = settled(scratch, comparison, C.activated(state, least), n, f"at-{least}") if n else C.activated(state, least)
        for turn in range(n):
            state = scratch.write(C.dissolved(state, 0, n), f"at-{least}-rest-{turn}")
            found = comparison.of(state, f"at-{least}-others-{turn}")
            worst, score = C.replaceable(state, found, n)
            if score < settings.least_next:
                break
            state = scratch.write(state.withColumn("cluster", F.when(F.col("cluster") == worst, 0).otherwise(F.col("cluster"))), f"at-{least}-without-{turn}")
            state = settled(scratch, comparison, state, n, f"at-{least}-again-{turn}")
    comparison.drop()
    return state.drop("seq")


def by_both(spark: SparkSession, contigs: DataFrame, distance: DistanceSettings = DistanceSettings(final=0.175), settings: ModelSettings = ModelSettings()) -> DataFrame:
    """The final state of distance binning refined by models.

    ``contigs`` may have ``reverse``. Models learn the read direction; scores
    are taken of the sequence as it is stored.
    """
    with interpreted(spark):
        return _by_both(spark, contigs, distance, settings)


def _by_both(spark: SparkSession, contigs: DataFrame, distance: DistanceSettings, settings: ModelSettings) -> DataFrame:
    scratch = Scratch(spark, "both")
    rows = contigs if "reverse" in contigs.columns else contigs.withColumn("reverse", F.lit(False))
    rows = scratch.write(spread(rows.select("contig_id", "seq", "len", "reverse")), "contigs")
    bins, _ = by_distance(spark, rows.select("contig_id", oriented("seq", "reverse").alias("seq"), "len"), distance)
    n = bins.agg(F.coalesce(F.max("bin"), F.lit(0)).alias("n")).first()["n"]
    state = rows.join(bins, "contig_id", "left").select("contig_id", "seq", "len", F.coalesce(F.col("bin") - 1, F.lit(-1)).cast("int").alias("cluster"), "reverse", F.col("bin").isNotNull().alias("active"))
    state, comparison = scratch.write(state, "start"), C.Comparison(spark, scratch, -1, False, settings.support)
    for k, least in enumerate(length_thresholds(rows)):
        def scored(state: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
            state = scratch.write(C.dissolved(state, -1), f"{tag}-state")
            return state, comparison.of(state, f"{tag}-scores")

        state, found = scored(C.activated(state, least), f"{k}-first")
        state, found = scored(C.reassigned(state, found), f"{k}-second")
        for turn in range(0 if settings.skip_removal else max(n, 1)):
            worst = C.weakest(C.weakness(state, found).collect(), n, settings.absorb, settings.cv_ratio)  # one row a cluster
            if worst == -1:
                break
            before = C.log_likelihood(state, found)
            without = state.withColumn("cluster", F.when(F.col("cluster") == worst, -1).otherwise(F.col("cluster")))
            new, new_found = scored(C.reassigned(without, found.where(F.col("cluster") != worst)), f"{k}-cull-{turn}")
            if C.log_likelihood(new, new_found) < before - settings.tolerance:
                break  # the cull is taken back
            state, found = new, new_found
    comparison.drop()
    return state.drop("seq")


def all_pairs(spark: SparkSession, contigs: DataFrame, settings: DistanceSettings = DistanceSettings(), prefix: int = 2, workers: int = 4) -> DataFrame:
    """(i, j, n_bins, correct, assigned, accuracy, unassigned): each pair of organisms (label prefixes) binned on its own, ``workers`` at a time."""
    scratch, org = Scratch(spark, "experiments"), F.substring("contig_id", 1, prefix)
    # profiles are taken once, and a pair reads the folders of its organisms
    folder = lambda name: "o" + name.encode().hex().upper()
    rows = scratch.write(measured(contigs, settings.k).withColumn("folder", F.concat(F.lit("o"), F.hex(org))), "all", "folder")
    orgs = [r["org"] for r in rows.select(org.alias("org")).distinct().orderBy("org").collect()]

    def one(pair: tuple[str, str]) -> DataFrame:
        with interpreted(spark):
            found = _binned(Scratch(spark, "distance"), rows.where(F.col("folder").isin(*map(folder, pair))).drop("folder"), settings)
        row = grade(*found, prefix)
        row = row.select(F.lit(pair[0]).alias("i"), F.lit(pair[1]).alias("j"), "n_bins", "correct", "assigned", "accuracy", "unassigned")
        return scratch.write(row, f"pair-{orgs.index(pair[0])}-{orgs.index(pair[1])}")

    with ThreadPoolExecutor(workers) as pool:
        rows = list(pool.map(one, combinations(orgs, 2)))
    kinds = "i string, j string, n_bins long, correct long, assigned long, accuracy double, unassigned long"
    return reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame([], kinds)
