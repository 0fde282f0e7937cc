"""Sequence files: FASTA, two-column text, peptide headers, older fixed layouts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequences import encode, reverse_complement


def read_fasta(spark: SparkSession, path: str, label_col: int = 0, id_chars: int | None = None) -> DataFrame:
    """(contig_id, seq): one row a record, its lines joined; blank lines and
    those that begin with ";" are left out, records without a sequence too.

    Records are split by the reader, so a large file is read by many tasks.
    """
    lines = spark.read.option("lineSep", "\n>").text(path)
    body = F.split(F.col("value"), "\r?\n")
    kept = F.transform(F.filter(body, lambda x: (F.trim(x) != "") & ~F.trim(x).startswith(";")), lambda x: F.trim(x))
    rows = lines.select(kept.alias("lines")).where(F.size("lines") > 1)
    label = F.ltrim(F.get(F.split(F.get("lines", F.lit(0)), r"\s+"), F.lit(label_col)), F.lit(">"))
    label = F.substring(label, 1, id_chars) if id_chars else label
    return rows.select(label.alias("contig_id"), F.array_join(F.slice("lines", 2, F.size("lines") - 1), "").alias("seq"))


def write_fasta(contigs: DataFrame, path: str, width: int = 60) -> None:
    """Records of (contig_id, seq) with lines of ``width`` bases."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    contigs.select(F.concat(F.lit(">"), "contig_id", F.lit("\n"), body).alias("value")).write.mode("overwrite").text(path)


def read_peptides(spark: SparkSession, path: str) -> DataFrame:
    """(contig_id, forward): the orientation of each contig's longest peptide, ties to the later line.

    A header ends in ``id:start-end(+)`` or ``(-)``; any other is an error.
    """
    return peptide_orientation(spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line")))


def peptide_orientation(lines: DataFrame) -> DataFrame:
    """As ``read_peptides``, of (value, line)."""
    last = F.element_at(F.split(F.trim("value"), r"\s+"), -1)
    shape = r"^([^:]*):(-?\d+)-(-?\d+)\(([^()]*)\)+$"
    heads = lines.where(F.col("value").startswith(">")).select(last.alias("last"), "value", "line")
    name = F.when(F.col("last").rlike(shape), F.regexp_extract("last", shape, 1)).otherwise(F.raise_error(F.concat(F.lit("malformed peptide header: "), F.trim("value"))))
    part = lambda k: F.regexp_extract("last", shape, k)
    rows = heads.select(F.ltrim(name, F.lit(">")).alias("contig_id"), (part(3).cast("long") - part(2).cast("long")).alias("size"), part(4).alias("strand"), "line")
    return rows.groupBy("contig_id").agg((F.max_by("strand", F.struct("size", "line")) == "+").alias("forward"))


def read_two_columns(spark: SparkSession, path: str, keep_first: bool = True) -> DataFrame:
    """(contig_id, seq) of lines ``label sequence``; of one label the first line, or all lines encoded."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("line"), parts[0].alias("contig_id"), parts[1].alias("seq"))
    if not keep_first:
        return rows.select("contig_id", encode("seq").alias("seq"))
    return rows.groupBy("contig_id").agg(F.min_by("seq", "line").alias("seq"))


def normalised(contigs: DataFrame, orientation: DataFrame, prefix: str = "") -> DataFrame:
    """The contigs with an orientation, read forward, names after ``prefix``."""
    rows = contigs.join(orientation, "contig_id")
    return rows.select(F.concat(F.lit(prefix), "contig_id").alias("contig_id"), F.when(F.col("forward"), F.col("seq")).otherwise(reverse_complement("seq", strict=True)).alias("seq"))


def kept_and_skipped(contigs: DataFrame, orientation: DataFrame) -> DataFrame:
    """One row: kept, skipped."""
    rows = contigs.join(orientation.withColumn("known", F.lit(True)), "contig_id", "left")
    return rows.agg(F.count("known").alias("kept"), F.count_if(F.col("known").isNull()).alias("skipped"))


def tagged(contigs: DataFrame, orientation: DataFrame, prefix: str = "", id_chars: int = 25) -> DataFrame:
    """(contig_id, seq, len, reverse): encoded sequences with their strand as a flag; names cut before they are looked up."""
    rows = contigs.select(F.substring("contig_id", 1, id_chars).alias("contig_id"), encode("seq").alias("seq")).join(orientation, "contig_id")
    return rows.select(F.concat(F.lit(prefix), "contig_id").alias("contig_id"), "seq", F.length("seq").alias("len"), (~F.col("forward")).alias("reverse"))


def organisms(spark: SparkSession, folder: str, prefix: int = 3) -> DataFrame:
    """(org, file, prefix): files of a folder in order of their names, numbered from 0, with the beginnings of the names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    names = sorted(n for n in (f.getPath().getName() for f in files) if not n.startswith(("_", ".")))
    return spark.createDataFrame([(i, n, n[:prefix]) for i, n in enumerate(names)], "org int, file string, prefix string")


def united(*organisms: DataFrame, last_wins: bool = False) -> DataFrame:
    """The contigs of all organisms, rows of one name all kept, or only that of the last organism which has it."""
    rows = [o.withColumn("order", F.lit(k)) for k, o in enumerate(organisms)]
    both = reduce(DataFrame.unionByName, rows)
    if not last_wins:
        return both.drop("order")
    columns = [c for c in both.columns if c not in ("contig_id", "order")]
    return both.groupBy("contig_id").agg(F.max_by(F.struct(*columns), "order").alias("row")).select("contig_id", "row.*")


def organism_pairs(orgs: DataFrame) -> DataFrame:
    """(i, j) with i < j, the experiments of an all-pairs run."""
    return orgs.select(F.col("org").alias("i")).join(orgs.select(F.col("org").alias("j")), F.col("i") < F.col("j"))


def _fixed(start: int, size: int) -> Column:
    return F.trim(F.substring("value", start, size))


def read_fixed_hits(spark: SparkSession, path: str) -> DataFrame:
    """(contig_id, pct) of an older layout: 25 characters of name, 8 of a number."""
    return spark.read.text(path).select(_fixed(1, 25).alias("contig_id"), _fixed(26, 8).cast("double").alias("pct"))


def read_restart(spark: SparkSession, path: str) -> DataFrame:
    """(pos, cluster, direction) by line, after 25 characters of name.

    Lines are numbered within each part of the file, then the parts' sizes are summed.
    """
    at = F.monotonically_increasing_id()
    rows = spark.read.text(path).select(F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("place"), _fixed(26, 3).cast("int").alias("cluster"), _fixed(29, 3).cast("int").alias("direction"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", before)  # one row a part
    return rows.join(parts, "part").select((F.col("before") + F.col("place")).alias("pos"), "cluster", "direction")


def read_old_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA of the older layout: names end at the first blank and have 25 characters at most."""
    return read_fasta(spark, path, id_chars=25)
