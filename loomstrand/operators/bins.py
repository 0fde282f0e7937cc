"""Steps of distance binning over (contig_id, ...) tables; a bin is a rank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..joins import sized
from ..scratch import Scratch
from .distances import _matrix, nearest_variation, variation_pairs
from .graph import sized_components, sized_leaders

#: Centroids that one pass of the nearest-centroid join holds: 40 MB of doubles.
CENTROIDS = 20_000
#: Shares that a task holds to take medians of, at most, or one k-mer's of one bin.
HELD = 4_000_000


def numbered(scratch: Scratch, rows: DataFrame, tag: str, *order: str) -> DataFrame:
    """rows with place, from 0 on in order of the columns: numbered within range-sorted parts, then the parts' sizes are summed.

    No task holds more than a part, however many rows are alike in the first columns.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = scratch.write(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), tag)
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))  # one row a part
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return parts.join(F.broadcast(sizes), "part").withColumn("place", place.cast("long")).drop("part", "before")


def percentile_selection(contigs: DataFrame, low: float = 85.0, high: float = 95.0) -> DataFrame:
    """(contig_id, len, rank): the slice of contigs by (len, contig_id) between two percentages of their number.

    Counts of each length tell which lengths are looked at; only contigs of these are put in order.
    """
    n = contigs.count()
    first, last = int(n * low / 100), int(n * high / 100)
    sizes = contigs.groupBy("len").agg(F.count("*").alias("same"))
    before = F.coalesce(F.sum("same").over(Window.orderBy("len").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("before", before).where((F.col("before") < last) & (F.col("before") + F.col("same") > first))
    row = sizes.agg(F.min("before").alias("skipped"), F.min("len").alias("low"), F.max("len").alias("high")).first()
    some = contigs.select("contig_id", "len").where(F.col("len").between(F.lit(row["low"]), F.lit(row["high"])))
    ranked = numbered(Scratch(contigs.sparkSession, "selection"), some, "lengths", "len", "contig_id").withColumn("rank", F.col("place") + 1 + (row["skipped"] or 0))
    return ranked.where((F.col("rank") > first) & (F.col("rank") <= last)).select("contig_id", "len", "rank")


def ordered(members: DataFrame, first: str) -> DataFrame:
    """(contig_id, bin) with bins numbered from 1 by size, the larger first, ties by the smallest ``first``; ``members`` has (contig_id, grp, first)."""
    sizes = members.groupBy("grp").agg(F.count("*").alias("size"), F.min(first).alias("first"))
    number = F.row_number().over(Window.orderBy(F.desc("size"), "first"))
    return members.join(sized(sizes.withColumn("bin", number).select("grp", "bin")), "grp").select("contig_id", "bin")


def touched(bins: DataFrame, members: DataFrame) -> DataFrame:
    """(bin) of the bins that hold any of the members (contig_id)."""
    return bins.join(members.select("contig_id"), "contig_id", "left_semi").select("bin").distinct()


def created(scratch: Scratch, selection: DataFrame, close: DataFrame) -> DataFrame:
    """Components of the close pairs (a, b) of two and more, as (contig_id, bin); ties go by selection rank."""
    ranks = selection.select("contig_id", "rank")
    links = close.join(ranks.select(F.col("contig_id").alias("a"), F.col("rank").alias("ra")), "a").join(ranks.select(F.col("contig_id").alias("b"), F.col("rank").alias("rb")), "b")
    return linked(scratch, selection, links.select(F.col("ra").alias("a"), F.col("rb").alias("b")))


def linked(scratch: Scratch, selection: DataFrame, links: DataFrame) -> DataFrame:
    """``created`` of links (a, b) of ranks."""
    ranks = selection.select("contig_id", "rank")
    found = sized_components(scratch, links, "created")
    members = found.join(ranks, found["node"] == ranks["rank"]).select("contig_id", F.col("root").alias("grp"), "rank")
    return ordered(members, "rank")


def with_nearest(selection: DataFrame, pairs: DataFrame, bins: DataFrame, most: float = 0.175) -> DataFrame:
    """bins with each unbinned contig of the selection that is at most ``most`` from its nearest binned contig."""
    both = pairs.select("a", "b", "dist").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist")).where(F.col("dist") <= most)
    open_ = selection.select("contig_id").join(bins, "contig_id", "left_anti")
    reached = both.join(open_, both["a"] == open_["contig_id"]).join(bins.select(F.col("contig_id").alias("b"), "bin"), "b")
    nearest = reached.groupBy("a").agg(F.min_by("bin", F.struct("dist", "b")).alias("bin"))
    return _grown(bins, nearest.select(F.col("a").alias("contig_id"), "bin"))


def with_nearest_of(chosen: DataFrame, bins: DataFrame, most: float = 0.175) -> DataFrame:
    """``with_nearest`` of a selection's rows (contig_id, p array): no pair is listed."""
    return _grown(bins, nearest_variation(chosen.join(bins, "contig_id", "left").select("contig_id", "bin", "p"), most))


def _grown(bins: DataFrame, more: DataFrame) -> DataFrame:
    members = bins.unionByName(more)
    return ordered(members.select("contig_id", F.col("bin").alias("grp"), F.col("bin").alias("first")), "first")


def medians(bins: DataFrame, shares: DataFrame) -> DataFrame:
    """(bin, p): the exact median of each k-mer's share over the bin's contigs."""
    largest = bins.groupBy("bin").count().agg(F.max("count").alias("n")).first()["n"] or 1
    width = max(1, HELD // largest)  # k-mers that a task takes together
    number = bins.schema["bin"].dataType.simpleString()
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("p") - 1) / width).cast("int")), lambda i: F.struct(i.alias("part"), F.slice("p", i * width + 1, F.lit(width)).alias("p")))
    rows = bins.join(shares.select("contig_id", "p"), "contig_id").where(F.size("p") > 0).select("bin", F.inline(parts))

    def run(group: pa.Table) -> pa.Table:
        return pa.table({"bin": group["bin"][:1], "part": group["part"][:1], "p": pa.array([np.median(_matrix(group, "p"), axis=0)], pa.list_(pa.float64()))})

    found = rows.groupBy("bin", "part").applyInArrow(lambda g: run(g), f"bin {number}, part int, p array<double>")
    return found.groupBy("bin").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "p"))), lambda x: x["p"])).alias("p"))


def merge_links(bins: DataFrame, shares: DataFrame, below: float) -> DataFrame:
    """(a, b, dist): pairs of bins whose medians are closer than ``below``."""
    middle = Scratch(bins.sparkSession, "medians").write(medians(bins, shares), "medians")
    return _median_links(middle, below)


def _median_links(middle: DataFrame, below: float) -> DataFrame:
    return variation_pairs(middle.withColumnRenamed("bin", "contig_id"), below)


def combined(scratch: Scratch, bins: DataFrame, shares: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """bins after a round for each threshold, in which every bin takes the later ones close to it."""
    middle = None
    for k, below in enumerate(thresholds):
        if middle is None:
            bins = scratch.write(bins, f"combine-{k}")
            middle = scratch.write(medians(bins, shares), f"combine-medians-{k}")
        links = scratch.write(_median_links(middle, below), f"combine-links-{k}")
        if links.isEmpty():
            continue
        middle = None  # they change with the bins
        led = sized_leaders(scratch, links, f"combine-leaders-{k}")
        members = bins.join(led, bins["bin"] == led["node"], "left").select("contig_id", F.coalesce("leader", "bin").alias("grp"))
        bins = ordered(members.withColumn("first", F.col("grp")), "first")
    return scratch.write(bins, "combined")


def reduced(bins: DataFrame, constant: float = 16.0) -> DataFrame:
    """The large bins: those whose squared size exceeds the number of contigs,
    at least one, and on until the squared sum reaches ``constant`` times that number."""
    sizes = bins.groupBy("bin").agg(F.count("*").alias("size"))
    along = Window.orderBy("bin")
    total = F.sum("size").over(Window.partitionBy())
    sizes = sizes.withColumn("total", total).withColumn("sums", F.sum("size").over(along))
    sizes = sizes.withColumn("large", F.max(F.when(F.col("size") * F.col("size") > F.col("total"), F.col("bin")).otherwise(1)).over(Window.partitionBy()))
    enough = F.col("sums") * F.col("sums") >= F.least(F.lit(constant), F.col("total")) * F.col("total")
    sizes = sizes.withColumn("enough", F.min(F.when(enough, F.col("bin"))).over(Window.partitionBy()))
    keep = sizes.where(F.col("bin") <= F.greatest("large", "enough")).select("bin")
    return bins.join(sized(keep), "bin", "left_semi").select("contig_id", "bin")


def _nearest(centroids):
    def run(batches):
        numbers, matrix = centroids.value
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1) if len(batch) else np.zeros((0, matrix.shape[1]))
            best = np.array([np.abs(matrix - row).sum(1).argmin() for row in x], np.int64)
            dist = np.abs(matrix[best] - x).sum(1) / 2 if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers[best], pa.int32()), pa.array(dist)], ["contig_id", "bin", "dist"])

    return run


def nearest_median(bins: DataFrame, candidates: DataFrame, shares: DataFrame) -> DataFrame:
    """(contig_id, bin, dist): the bin with the nearest median for each candidate, ties to the first bin."""
    spark = shares.sparkSession
    rows = shares.join(candidates.select("contig_id"), "contig_id", "left_semi").select("contig_id", "p")
    kind = shares.schema["contig_id"].dataType.simpleString()
    middle = medians(bins, shares)
    n, found = bins.agg(F.max("bin").alias("n")).first()["n"] or 0, None
    for low in range(1, n + 1, CENTROIDS):  # as many centroids at a time as one task may hold
        some = middle.where(F.col("bin").between(low, low + CENTROIDS - 1)).orderBy("bin").toArrow()
        if not len(some):
            continue
        shared = spark.sparkContext.broadcast((some["bin"].to_numpy(), np.array(some["p"].to_pylist())))
        part = rows.mapInArrow(_nearest(shared), f"contig_id {kind}, bin int, dist double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"contig_id {kind}, bin int, dist double")
    if n <= CENTROIDS:
        return found
    return found.groupBy("contig_id").agg(F.min(F.struct("dist", "bin")).alias("x")).select("contig_id", "x.bin", "x.dist")


def with_nearest_median(bins: DataFrame, candidates: DataFrame, shares: DataFrame, most: float) -> tuple[DataFrame, DataFrame]:
    """bins with the candidates at most ``most`` from a median, and (contig_id) of the others."""
    open_ = candidates.select("contig_id").join(bins, "contig_id", "left_anti")
    near = nearest_median(bins, open_, shares)
    members = bins.select("contig_id", "bin").unionByName(near.where(F.col("dist") <= most).select("contig_id", "bin"))
    return ordered(members.select("contig_id", F.col("bin").alias("grp"), F.col("bin").alias("first")), "first"), near.where(F.col("dist") > most).select("contig_id")
