"""Steps on assignments (contig_id, seq, len, cluster, reverse, active) under context models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..joins import sized
from ..scratch import Scratch
from .contexts import SUPPORT, scores, trained
from .distances import chi_squared_links
from .graph import components
from .kmers import profiles

#: A cluster of fewer active members is dissolved; models under this mean are bad. Fixed values.
LEAST_MEMBERS, BAD_MODEL = 3, 0.01
#: Trainings whose models are kept together, at most: more, and all clusters are trained again.
KEPT = 3
#: Positions numbered by one task.
PLACES = 1_000_000


def activated(state: DataFrame, least: float) -> DataFrame:
    """Contigs of that length and longer become active; active ones stay so."""
    return state.withColumn("active", F.col("active") | (F.col("len") >= least))


def dissolved(state: DataFrame, none: int, n_clusters: int | None = None) -> DataFrame:
    """Clusters of fewer than LEAST_MEMBERS active members lose all members; numbers out of range are dropped."""
    sizes = state.groupBy("cluster").agg(F.sum(F.col("active").cast("int")).alias("size"))
    small = sizes.where(F.col("size") < LEAST_MEMBERS).select("cluster", F.lit(True).alias("small"))
    gone = F.coalesce("small", F.lit(False))
    if n_clusters is not None:
        gone = gone | (F.col("cluster") > n_clusters)
    return state.join(F.broadcast(small), "cluster", "left").withColumn("cluster", F.when(gone, F.lit(none)).otherwise(F.col("cluster"))).drop("small").select(state.columns)


def mapped_back(contigs: DataFrame, clusters: DataFrame, none: int = -1) -> DataFrame:
    """contigs with the cluster that (contig_id, cluster) has for them, ``none`` where it has none; an id that no contig has is an error."""
    known = clusters.select("contig_id", "cluster").join(contigs.select("contig_id", F.lit(True).alias("known")), "contig_id", "left")
    name = F.when(F.col("known"), F.col("contig_id")).otherwise(F.raise_error(F.concat(F.lit("no such contig: "), "contig_id")))
    return contigs.join(known.select(name.alias("contig_id"), "cluster"), "contig_id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(none)))


def placed_back(contigs: DataFrame, clusters: DataFrame, least_len: int, none: int = 0) -> DataFrame:
    """contigs (contig_id, len, pos) with the clusters of (place, cluster), where place counts from 0 the
    contigs of ``least_len`` and longer in order of pos; the others, and places without a cluster, get ``none``."""
    long_ = contigs.where(F.col("len") >= least_len).select("contig_id", "pos", F.floor(F.col("pos") / PLACES).alias("part"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = long_.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", before).select("part", "before")
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("pos")) - 1
    found = long_.join(parts, "part").select("contig_id", place.alias("place")).join(clusters, "place").select("contig_id", "cluster")
    return contigs.join(found, "contig_id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(none)))


class Comparison:
    """Scores of all active contigs under the model of each cluster, turn after turn.

    A score depends on the contig and the cluster's members alone. So only clusters whose members (active, with their strands)
    are not those of the last turn are trained again, and the others' scores are kept; what has become active since is scored under
    their kept models. Members are compared by digests of (contig_id, reverse); names are unique, and contigs never cease to be active.
    """

    def __init__(self, spark: SparkSession, scratch: Scratch, none: int, both: bool, support: int = SUPPORT):
        self.spark, self.scratch, self.none, self.both, self.support = spark, scratch, none, both, support
        self.marks, self.n_active, self.found, self.seen, self.kept = {}, 0, None, None, []

    def of(self, state: DataFrame, tag: str) -> DataFrame:
        """Stored scores of all active contigs of ``state`` under the model of each cluster."""
        active = state.where("active")
        row = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "contig_id", "reverse"))
        marks = {r[0]: tuple(r[1:]) for r in active.groupBy("cluster").agg(F.count("*").alias("n"), row(1), row(2)).collect()}  # one row a cluster
        n_active = sum(m[0] for m in marks.values())
        marks.pop(self.none, None)
        same = {c for c, mark in marks.items() if self.marks.get(c) == mark}
        if self.found is not None and n_active == self.n_active and len(same) == len(marks) == len(self.marks):
            return self.found
        self.kept = [(models, of & same) for models, of in self.kept]
        if len([of for _, of in self.kept if of]) > KEPT or n_active < self.n_active:
            same, self.kept = set(), [(models, set()) for models, _ in self.kept]
        parts = [self.found.where(F.col("cluster").isin(*same))] if same else []
        if same and n_active > self.n_active:
            fresh = active.join(self.seen, "contig_id", "left_anti")
            parts += [scores(self.spark, fresh, models, self.both, only=frozenset(of)) for models, of in self.kept if of]
        if len(same) < len(marks) or not marks:
            members = active.where(F.col("cluster") != self.none)
            members = members.where(~F.col("cluster").isin(*same)) if same else members
            models = trained(self.spark, members.select("contig_id", "seq", "reverse", "cluster"), self.support)
            parts.append(scores(self.spark, active, models, self.both))
            self.kept.append((models, set(marks) - same))
        self.found = self.scratch.write(reduce(DataFrame.unionByName, parts), tag)
        if n_active != self.n_active:
            self.seen = self.scratch.write(active.select("contig_id"), f"{tag}-active")
        for models, of in self.kept:
            if not of:
                models.drop()
        self.kept = [(models, of) for models, of in self.kept if of]
        self.marks, self.n_active = marks, n_active
        return self.found

    def drop(self) -> None:
        """Delete the kept models."""
        for models, _ in self.kept:
            models.drop()
        self.kept = []


def reassigned(state: DataFrame, found: DataFrame) -> DataFrame:
    """Each active contig in its best cluster, -1 if no score is above 0; ties to the smaller number."""
    best = found.groupBy("contig_id").agg(F.max(F.struct("score", (-F.col("cluster")).alias("low"))).alias("x")).select("contig_id", F.col("x.score").alias("best"), (-F.col("x.low")).alias("to"))
    moved = state.join(best, "contig_id", "left")
    to = F.when(~F.col("active"), F.col("cluster")).when(F.coalesce(F.col("best") > 0, F.lit(False)), F.col("to")).otherwise(-1)
    return moved.withColumn("cluster", to.cast("int")).select(state.columns)


def movement(before: DataFrame, after: DataFrame, found: DataFrame) -> DataFrame:
    """One row: assigned, reassigned, stayed, negative, deassigned of the active contigs."""
    best = found.groupBy("contig_id").agg(F.max("score").alias("best"))
    rows = before.where("active").select("contig_id", F.col("cluster").alias("old")).join(after.select("contig_id", F.col("cluster").alias("new")), "contig_id").join(best, "contig_id", "left")
    bad = ~F.coalesce(F.col("best") > 0, F.lit(False))
    return rows.agg(
        F.count_if(~bad & (F.col("old") == -1)).alias("assigned"), F.count_if(~bad & (F.col("old") != -1) & (F.col("old") != F.col("new"))).alias("reassigned"),
        F.count_if(~bad & (F.col("old") == F.col("new"))).alias("stayed"), F.count_if(bad).alias("negative"), F.count_if(bad & (F.col("old") != -1)).alias("deassigned"),
    )


def best_orientations(state: DataFrame, found: DataFrame) -> DataFrame:
    """Each active contig in its best (cluster, strand); ties to the smaller number, then forward."""
    best = found.groupBy("contig_id").agg(F.max(F.struct("score", (-F.col("cluster")).alias("low"), (~F.col("backward")).alias("forward"))).alias("x"))
    best = best.select("contig_id", (-F.col("x.low")).alias("to"), (~F.col("x.forward")).alias("turned"))
    moved = state.join(best, "contig_id", "left")
    return moved.withColumn("cluster", F.when(F.col("active"), F.coalesce("to", F.lit(1))).otherwise(F.col("cluster")).cast("int")).withColumn("reverse", F.when(F.col("active"), F.coalesce("turned", F.lit(False))).otherwise(F.col("reverse"))).select(state.columns)


def score_totals(found: DataFrame) -> DataFrame:
    """One row: sum of each contig's best score, and how many are negative."""
    best = found.groupBy("contig_id").agg(F.max("score").alias("best"))
    return best.agg(F.sum("best").alias("total"), F.count_if(F.col("best") < 0).alias("negative"))


def per_base(state: DataFrame, found: DataFrame) -> DataFrame:
    """(cluster, size, bases, mean, var): score per base of the active members under their own model, on the better strand.

    Without bases, mean and var are not a number.
    """
    own = state.where("active").select("contig_id", "cluster", "len").join(found, ["contig_id", "cluster"])
    own = own.groupBy("contig_id", "cluster", "len").agg(F.max(F.struct("score", (~F.col("backward")).alias("forward"), "squares")).alias("x"))
    share = lambda c: F.coalesce(F.try_divide(F.sum(c), F.sum("len")), F.lit(float("nan")))
    out = own.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("len").alias("bases"), share("x.score").alias("mean"), share("x.squares").alias("squares"))
    return out.select("cluster", "size", "bases", "mean", (F.col("squares") - F.col("mean") * F.col("mean")).alias("var"))


def log_likelihood(state: DataFrame, found: DataFrame) -> float:
    """Score per base of the active assigned contigs under their own models; -inf without any."""
    own = state.where("active and cluster <> -1").join(found.select("contig_id", "cluster", "score"), ["contig_id", "cluster"])
    row = own.agg(F.sum("score").alias("s"), F.sum("len").alias("n")).first()
    return row["s"] / row["n"] if row["n"] else float("-inf")


def weakness(state: DataFrame, found: DataFrame) -> DataFrame:
    """(cluster, size, own, other, absorbability, mean_norm, cv) of the live clusters."""
    own = state.where("active and cluster <> -1").select("contig_id", F.col("cluster").alias("mine"), "len")
    rows = own.join(found.select("contig_id", "cluster", "score"), "contig_id")
    per = rows.groupBy("contig_id", "mine", "len").agg(F.max(F.when(F.col("cluster") == F.col("mine"), F.col("score"))).alias("own"), F.max(F.when(F.col("cluster") != F.col("mine"), F.col("score"))).alias("other"))
    per = per.withColumn("norm", F.col("own") / F.greatest("len", F.lit(1))).withColumn("other", F.coalesce("other", F.lit(float("-inf"))))
    out = per.groupBy(F.col("mine").alias("cluster")).agg(F.count("*").alias("size"), F.avg("own").alias("own"), F.avg("other").alias("other"), F.avg("norm").alias("mean_norm"), F.stddev_pop("norm").alias("sd"))
    cv = F.when((F.col("size") < 2) | (F.col("mean_norm") == 0), F.lit(0.0)).otherwise(F.col("sd") / F.col("mean_norm"))
    return out.select("cluster", "size", "own", "other", (F.col("other") / F.greatest("own", F.lit(1.0))).alias("absorbability"), "mean_norm", cv.alias("cv"))


def top_ratio(values: list[float]) -> float:
    """The largest over the second largest; 0 without two, or if the second is not positive."""
    first, second = [*sorted(values, reverse=True)[:2], 0.0, 0.0][:2]
    return first / second if len(values) > 1 and second > 0 else 0.0


def weakest(rows: list, n_clusters: int, absorb: float, cv_ratio: float) -> int:
    """The cluster to cull of the rows of ``weakness`` (one row a cluster), or -1."""
    live = sorted(rows, key=lambda r: r["cluster"])
    if len(live) <= 1:
        return -1
    low = min(live, key=lambda r: (r["mean_norm"], r["cluster"]))
    if low["mean_norm"] < BAD_MODEL:
        return low["cluster"]
    spread = {r["cluster"]: r["cv"] for r in live}
    if top_ratio([spread.get(k, 0.0) for k in range(n_clusters)]) > cv_ratio:
        return max(live, key=lambda r: (r["cv"], -r["cluster"]))["cluster"]
    most = max(live, key=lambda r: (r["absorbability"], -r["cluster"]))
    return most["cluster"] if most["absorbability"] > absorb else -1


def replaceable(state: DataFrame, found: DataFrame, n_clusters: int) -> tuple[int, float]:
    """The cluster whose members score best elsewhere on average, and that score."""
    own = state.where("active").select("contig_id", F.col("cluster").alias("mine"))
    other = found.join(own, "contig_id").where("cluster <> mine").groupBy("contig_id", "mine").agg(F.max("score").alias("other"))
    every = own.join(other, ["contig_id", "mine"], "left").withColumn("other", F.coalesce("other", F.lit(float("-inf"))))
    rows = every.where(F.col("mine").between(1, n_clusters)).groupBy("mine").agg(F.avg("other").alias("x")).collect()  # one row a cluster
    best = max(rows, key=lambda r: (r["x"], -r["mine"]), default=None)
    return (best["mine"], best["x"]) if best else (1, float("-inf"))


def seed_clusters(scratch: Scratch, contigs: DataFrame, least_len: int = 3000, least_members: int = 6, chi: float = 255.0) -> DataFrame:
    """(contig_id, cluster): components of the chi-squared graph over long contigs,
    numbered from 1 by their largest degree, ties to the smallest contig position.

    ``contigs`` has (contig_id, seq, len, pos).
    """
    rows = scratch.write(profiles(contigs.where(F.col("len") >= least_len)), "seed-profiles").join(contigs.select("contig_id", "pos"), "contig_id")
    links = scratch.write(chi_squared_links(rows.select(F.col("pos").alias("contig_id"), "counts"), chi), "seed-links")
    found = components(scratch, links.select(F.col("root").alias("a"), F.col("node").alias("b")), "seed")
    degrees = links.groupBy("node").agg(F.sum("degree").alias("degree"))
    sizes = found.join(degrees, "node").groupBy("root").agg(F.count("*").alias("size"), F.max(F.struct("degree", (-F.col("node")).alias("low"))).alias("x")).where(F.col("size") >= max(2, least_members))
    number = F.row_number().over(Window.orderBy(F.desc("x.degree"), F.desc("x.low")))
    members = found.join(sized(sizes.withColumn("cluster", number).select("root", "cluster")), "root")
    return members.join(contigs.select("contig_id", "pos"), members["node"] == contigs["pos"]).select("contig_id", "cluster")
