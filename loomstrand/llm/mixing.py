"""Mixing sources to target weights: hash-random order, prefix sums, exact cuts.

Each row has a key that looks random and depends on its id and text alone, so
the order within a source is a fixed shuffle. Sizes are summed over ranges of
that order (equal prefixes of the key, about as many as the root of the source's rows), ranges
are summed up along the source, and only the range in which the budget ends is
looked into. What results is one cut for each source: so many whole passes,
then all rows before the cut key and part of the row there. Applying cuts is a
lookup by source, so texts are never shuffled.

Defined results: null texts have size 0; a null source is a source, after all
others; rows that repeat id and text share the words at the cut evenly, rounded
down; a source of no words gets a target of 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .common import NOT_WHITE, fresh, sized, text_of

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def size_of(text_col: str) -> Column:
    return F.regexp_count(text_of(text_col), F.lit(NOT_WHITE)).cast("long")


def key_of(id_col: str, text_col: str) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text_of(text_col))))


def group_of(source_col: str) -> Column:
    """The source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("+"), F.col(source_col)), F.lit("-"))


def rows_of(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, grp, size, key, copies) of the distinct rows, summed before the shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), group_of(source_col).alias("grp"), size_of(text_col).alias("size"), key_of(id_col, text_col).alias("key"))
    return rows.groupBy("id", "grp", "size", "key").agg(F.count("*").alias("copies"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(grp, source_size, n_rows, target): one row a source, so its windows are over as many rows as there are sources."""
    per = rows.groupBy("grp").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("n_rows"))
    order = Window.orderBy(F.col("grp") == "-", "grp")
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.get(pattern, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # fill from the source that is full first: before it, all are full
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("grp") == "-", "grp")
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) * F.lit(share) - before) / left).withColumn("place", F.row_number().over(fill))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))
    per = per.withColumn("level", F.min(fits).over(Window.partitionBy())["level"])
    return per.select("grp", "source_size", "n_rows", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def cuts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with passes, cut_key, cut_words: whole passes, then what to take in order of the key."""
    budget = F.round("target").cast("long")
    plan = wanted.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", budget - F.col("passes") * F.col("source_size"))
    # as many ranges as a range has rows, about: a task sorts the ranges of a source, another the rows of one range
    plan = plan.withColumn("digits", F.ceil(F.log(F.sqrt(F.col("n_rows"))) / F.log(F.lit(16.0))).cast("int"))
    of = sized(plan.select("grp", "rest", "digits"), wanted.count())
    ranged = rows.join(of, "grp").withColumn("part", F.expr("substring(key, 1, digits)")).withColumn("words", F.col("size") * F.col("copies"))
    parts = ranged.groupBy("grp", "part", "rest").agg(F.sum("words").alias("words"))
    along = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0)))
    ends = parts.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest"))).select("grp", "part", "before")
    inside = ranged.join(ends, ["grp", "part"])
    along = Window.partitionBy("grp", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(along), F.lit(0)))
    ends = inside.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
    ends = ends.select("grp", F.col("key").alias("cut_key"), F.floor((F.col("rest") - F.col("before")) / F.col("copies")).cast("long").alias("cut_words"))
    return plan.join(ends, "grp", "left").select("grp", "source_size", "target", "passes", F.coalesce("cut_key", F.lit("")).alias("cut_key"), F.coalesce("cut_words", F.lit(0)).cast("long").alias("cut_words"))


def taken(size: Column, key: Column) -> Column:
    """Words that the mix takes of a row, all passes together."""
    part = F.when(key < F.col("cut_key"), size).when(key == F.col("cut_key"), F.col("cut_words")).otherwise(F.lit(0))
    return (size * F.col("passes") + part).cast("long")


def planned(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, source_col: str, **how) -> tuple[DataFrame, DataFrame]:
    """Stored rows of ``rows_of`` and the cut of each source."""
    scratch = Scratch(spark, "mixing")
    rows = scratch.write(rows_of(docs, id_col, text_col, source_col), "rows")
    wanted = scratch.write(targets(rows, **how), "targets")
    return rows, scratch.write(cuts(rows, wanted), "cuts")


def report(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row for each input row: id, size, source_size, target, taken."""
    rows, plan = planned(spark, docs, id_col, text_col, source_col, **how)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).join(sized(plan), "grp")
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", taken(F.col("size"), F.col("key")).alias("taken"))


def mixed(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of the mix with all columns: one for each pass, its number in
    ``pass`` and its words in ``pass_words``; the text is cut where the budget ends."""
    _, plan = planned(spark, docs, id_col, text_col, source_col, **how)
    n, words, grp, size, total = fresh(docs, "pass", "pass_words", "grp", "row_size", "row_taken")
    side = sized(plan.withColumnRenamed("grp", grp))
    rows = docs.withColumn(grp, group_of(source_col)).withColumn(size, size_of(text_col)).join(side, grp)
    rows = rows.withColumn(total, taken(F.col(size), key_of(id_col, text_col))).where(F.col(total) > 0)
    rows = rows.withColumn(n, F.explode(F.sequence(F.lit(1), F.ceil(F.col(total) / F.col(size)).cast("int"))))
    rows = rows.withColumn(words, F.least(F.col(size), F.col(total) - (F.col(n) - 1) * F.col(size)))
    some = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(NOT_WHITE), F.lit(0)), F.lit(1), F.col(words).cast("int")), " ")
    text = F.when(F.col(words) == F.col(size), F.col(text_col)).otherwise(some)
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], n, words)
