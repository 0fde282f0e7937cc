"""Grades of binnings: labels, external matches, histograms, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LENGTH_POINTS = (0.01, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def bins_of(state: DataFrame, none: int = -1) -> tuple[DataFrame, DataFrame]:
    """(contig_id, bin) of active assigned contigs, and (contig_id) of the others."""
    assigned = F.col("active") & (F.col("cluster") != none)
    return state.where(assigned).select("contig_id", F.col("cluster").alias("bin")), state.where(~assigned).select("contig_id")


def dump(bins: DataFrame, unbinned: DataFrame) -> DataFrame:
    """(contig_id, bin_label): bin_0001 on, and bin_none."""
    return bins.select("contig_id", F.format_string("bin_%04d", F.col("bin").cast("int")).alias("bin_label")).unionByName(unbinned.select("contig_id", F.lit("bin_none").alias("bin_label")))


def label_counts(bins: DataFrame, prefix: int = 2) -> DataFrame:
    """(bin, label, n): labels are prefixes of the contigs' names."""
    return bins.groupBy("bin", F.substring("contig_id", 1, prefix).alias("label")).agg(F.count("*").alias("n"))


def purity(bins: DataFrame, prefix: int = 2) -> DataFrame:
    """(bin, label, correct, size, purity): the most frequent label of each bin, ties to the larger label."""
    out = label_counts(bins, prefix).groupBy("bin").agg(F.max(F.struct("n", "label")).alias("x"), F.sum("n").alias("size"))
    return out.select("bin", F.col("x.label").alias("label"), F.col("x.n").alias("correct"), "size", (F.col("x.n") / F.col("size")).alias("purity"))


def grade(bins: DataFrame, unbinned: DataFrame, prefix: int = 2) -> DataFrame:
    """One row: n_bins, correct, assigned, accuracy, unassigned, unassigned_share."""
    per = purity(bins, prefix).agg(F.count("*").alias("n_bins"), F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"), F.coalesce(F.sum("size"), F.lit(0)).alias("assigned"))
    out = per.crossJoin(unbinned.agg(F.count("*").alias("unassigned")))  # one row each
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return out.select("n_bins", "correct", "assigned", share(F.col("correct"), F.col("assigned")).alias("accuracy"), "unassigned", share(F.col("unassigned"), F.col("assigned") + F.col("unassigned")).alias("unassigned_share"))


def top_bins(bins: DataFrame, limit: int = 5, prefix: int = 2) -> DataFrame:
    """The report's largest bins with label and purity."""
    return purity(bins, prefix).orderBy(F.desc("size"), "bin").limit(limit)


def all_pure(bins: DataFrame, prefix: int = 2) -> DataFrame:
    return purity(bins, prefix).agg(F.coalesce(F.every(F.col("purity") == 1.0), F.lit(False)).alias("all_pure"))


def length_stats(contigs: DataFrame) -> DataFrame:
    """One row over len: count, mean, min, max and percentiles."""
    points = F.percentile("len", F.array(*[F.lit(p) for p in LENGTH_POINTS]))
    out = contigs.agg(F.count("len").alias("n"), F.avg("len").alias("mean"), F.min("len").alias("min"), F.max("len").alias("max"), points.alias("points"))
    return out.select("n", "mean", "min", "max", *[F.get("points", F.lit(i)).alias(f"p{int(p * 100):02d}") for i, p in enumerate(LENGTH_POINTS)])


def length_thresholds(contigs: DataFrame) -> list[int]:
    """Lengths from which on contigs are active: the median, two lower percentiles, and 1."""
    row = contigs.agg(F.percentile("len", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.1))).alias("p")).first()["p"]
    return [int(x) for x in row or []] + [1]


def length_probe(contigs: DataFrame, most: int = 10000, step: int = 500) -> DataFrame:
    """(least, n): contigs of each least length, from counts of each step."""
    spark = contigs.sparkSession
    per = contigs.select(F.least(F.floor(F.col("len") / step), F.lit(most // step)).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    steps = spark.range(0, most + 1, step).select((F.col("id") / step).cast("long").alias("k"), F.col("id").alias("least"))
    joined = steps.join(F.broadcast(per), "k", "left")
    return joined.select("least", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("least"))), F.lit(0)).alias("n"))


def _z() -> Column:
    """Deviations of a score from its cluster's mean. As floating point has it, infinite without variance, and not a number,
    which is over all others, where that leaves 0 over 0: for contigs without bases. A variance that rounding left under 0 is 0."""
    over, deviation = F.col("score") - F.col("len") * F.col("mean"), F.sqrt(F.col("len") * F.greatest("var", F.lit(0.0)))
    none = F.when(over > 0, F.when(~F.isnan(over), float("inf")).otherwise(float("nan"))).when(over < 0, float("-inf")).when(over == 0, float("nan"))
    return F.coalesce(F.try_divide(over, deviation), none)


def score_histogram(state: DataFrame, found: DataFrame, stats: DataFrame) -> DataFrame:
    """(cluster, z, members, others): z-scores of all scores under each cluster, cut to -10 .. 10, whole parts."""
    rows = found.groupBy("contig_id", "cluster").agg(F.max("score").alias("score")).join(F.broadcast(stats.select("cluster", "mean", "var")), "cluster")
    rows = rows.join(state.select("contig_id", "len", F.col("cluster").alias("mine")), "contig_id")
    kept = rows.withColumn("z", F.greatest(F.lit(-10.0), F.least(F.lit(10.0), _z())).cast("int"))
    return kept.groupBy("cluster", "z").agg(F.count_if(F.col("cluster") == F.col("mine")).alias("members"), F.count_if(F.col("cluster") != F.col("mine")).alias("others"))


def outliers(state: DataFrame, found: DataFrame, stats: DataFrame, least: float = -3.0, none: int = 0) -> DataFrame:
    """state with members whose score is more than 3 deviations under their cluster's unassigned."""
    own = state.join(found.groupBy("contig_id", "cluster").agg(F.max("score").alias("score")), ["contig_id", "cluster"], "left").join(F.broadcast(stats.select("cluster", "mean", "var")), "cluster", "left")
    return own.withColumn("cluster", F.when(F.coalesce(_z() < least, F.lit(False)), F.lit(none)).otherwise(F.col("cluster"))).select(state.columns)


# external matches: queries (query, target, pct, match_len, line), hits (query, hit, bitscore, line), taxa (contig_id, counts map)


def best_identity(matches: DataFrame, least_len: int = 100) -> DataFrame:
    """(query, pct): the highest identity of each query's matches of ``least_len`` and more."""
    return matches.where(F.col("match_len") >= least_len).groupBy("query").agg(F.max("pct").alias("pct"))


def best_hit(hits: DataFrame) -> DataFrame:
    """(query, hit, bitscore): the highest score, ties to the first line."""
    best = hits.groupBy("query").agg(F.max_by(F.struct("hit", "bitscore"), F.struct("bitscore", -F.col("line"))).alias("x"))
    return best.select("query", "x.hit", "x.bitscore")


def last_match(matches: DataFrame) -> DataFrame:
    """(query, pct, match_len): the last line of each query."""
    return matches.groupBy("query").agg(F.max_by(F.struct("pct", "match_len"), "line").alias("x")).select("query", "x.pct", "x.match_len")


def taxon_class(taxa: DataFrame, host: str = "Rhizaria", symbiont: str = "Haptophyta") -> DataFrame:
    """(contig_id, class): host if only the host's count is above 0, symb if only the symbiont's, else other."""
    h, s = F.col("counts")[host], F.col("counts")[symbiont]
    return taxa.select("contig_id", F.when((s == 0) & (h > 0), "host").when((s > 0) & (h == 0), "symb").otherwise("other").alias("class"))


def match_grade(bins: DataFrame, identity: DataFrame, classes: DataFrame, over: float = 99.0) -> DataFrame:
    """(bin, size, comparable, no_pct, avg_pct, over, host, symb, other) of each bin."""
    rows = bins.join(identity.withColumnRenamed("query", "contig_id"), "contig_id", "left").join(classes, "contig_id", "left")
    return rows.groupBy("bin").agg(
        F.count("*").alias("size"), F.count("pct").alias("comparable"), F.count_if(F.col("pct").isNull()).alias("no_pct"), F.coalesce(F.avg("pct"), F.lit(0.0)).alias("avg_pct"),
        F.count_if(F.coalesce(F.col("pct") > over, F.lit(False))).alias("over"), *[F.count_if(F.coalesce(F.col("class") == c, F.lit(False))).alias(c) for c in ("host", "symb", "other")],
    )


def best_bin(grades: DataFrame) -> DataFrame:
    """The bin with the most contigs over the identity, ties to the first."""
    return grades.agg(F.max_by("bin", F.struct("over", -F.col("bin"))).alias("best_bin"))


def bin_details(bins: DataFrame, matches: DataFrame, hits: DataFrame, each: bool = False) -> DataFrame:
    """(contig_id, pct, match_len, hit, bitscore, place) of one bin's contigs, best first, nulls last; ``each``: of every bin, with bin, placed within it."""
    by = ["bin"] if each else []
    rows = bins.select("contig_id", *by).join(last_match(matches).withColumnRenamed("query", "contig_id"), "contig_id", "left").join(best_hit(hits).withColumnRenamed("query", "contig_id"), "contig_id", "left")
    order = Window.partitionBy(*by).orderBy(F.desc_nulls_last("pct"), F.desc_nulls_last("match_len"), F.desc_nulls_last("bitscore"), "contig_id")
    return rows.withColumn("place", F.row_number().over(order))


def compared_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: mean, largest and smallest difference of two runs' grades (i, j, grade)."""
    d = left.withColumnRenamed("grade", "l").join(right.withColumnRenamed("grade", "r"), ["i", "j"]).select((F.col("l") - F.col("r")).alias("d"))
    return d.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.max("d").alias("max"), F.min("d").alias("min"))
