"""Exact duplicates: digests screened by static binary-fuse filters.

Rows arrive in batches. Equal digests of one batch are grouped first. Digests
that no earlier batch has form the batch's snapshot, which never changes: a
table bucketed by digest, with a fuse filter for each bucket. A new batch's
groups pass the filters of the earlier snapshots, and only those that may be
there meet the snapshot's buckets, which stay where they are; what is found
goes to a table of its own beside the snapshot. All groups of more than one
row are then checked byte by byte.

Defined results: null text counts as empty; runs of white space count as one
space; a null id sorts after all others; of rows that repeat id and text, one
stays; an empty table gives no rows; other columns are kept untouched.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from .common import WHITE, fresh, hot_join, sized, text_of
from .fuse import build, probe

#: Digests of one bucket, about, for which one filter is made; buckets of a snapshot, at least and at most.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 500_000, 8, 100_000


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_of(text), WHITE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    return np.array([int.from_bytes(x[-8:].rjust(8, b"\0"), "little") for x in column.to_pylist()], np.uint64)


def _filter_of(group: pa.Table) -> pa.Table:
    seed, length, count, table = build(_keys(group["digest"]))
    return pa.table({"bucket": pa.array([group["bucket"][0].as_py()], pa.int32()), "seed": [seed], "length": [length], "count": [count], "cells": pa.array([table.tobytes()], pa.binary())})


def _screened(rows: pa.Table, filters: pa.Table) -> pa.Table:
    if not len(rows):
        return rows.select(["digest", "keep_id", "n"]).append_column("maybe", pa.array([], pa.bool_()))
    found = np.zeros(len(rows), bool)
    if len(filters):
        f = filters.slice(0, 1).to_pylist()[0]
        found = probe(_keys(rows["digest"]), f["seed"], f["length"], f["count"], np.frombuffer(f["cells"], np.uint16))
    return rows.select(["digest", "keep_id", "n"]).append_column("maybe", pa.array(found))


class Snapshot:
    """An immutable table of groups (digest, keep_id, n), bucketed by digest, with its filters."""

    def __init__(self, spark: SparkSession, root: str, k: int, buckets: int, groups: DataFrame | None = None):
        """Opens the snapshot, or writes it first if ``groups`` are given. Without any rows it is a plain table of no buckets."""
        self.k, self.buckets, name = k, buckets, f"groups_{uuid.uuid4().hex}"
        path, filters = f"{root}/snapshot-{k}-{buckets}", f"{root}/filters-{k}"
        if groups is not None:
            if buckets:
                held = groups.repartition(buckets, "digest").sortWithinPartitions("digest")
                held.write.mode("overwrite").option("compression", "zstd").option("path", f"{path}.new").bucketBy(buckets, "digest").sortBy("digest").saveAsTable(name)
                self.bucketed(spark.table(name)).groupBy("bucket").applyInArrow(_filter_of, _FILTER).write.mode("overwrite").parquet(filters)
                spark.sql(f"DROP TABLE {name}")  # its files stay
            else:
                groups.write.mode("overwrite").parquet(f"{path}.new")
            moved = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.new")
            moved.getFileSystem(spark._jsc.hadoopConfiguration()).rename(moved, spark._jvm.org.apache.hadoop.fs.Path(path))
        self.groups = spark.read.parquet(path)
        if buckets:
            columns = ", ".join(f"{c} {t}" for c, t in self.groups.dtypes)
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")
            self.groups, self.filters = spark.table(name), spark.read.schema(_FILTER).parquet(filters)

    def bucketed(self, groups: DataFrame) -> DataFrame:
        return groups.withColumn("bucket", F.pmod(F.hash("digest"), F.lit(self.buckets)))

    def screen(self, groups: DataFrame) -> DataFrame:
        """The groups with ``maybe``: false where the snapshot can't hold the digest."""
        kind = groups.schema["keep_id"].dataType.simpleString()
        return self.bucketed(groups).groupBy("bucket").cogroup(self.filters.groupBy("bucket")).applyInArrow(_screened, f"digest binary, keep_id {kind}, n long, maybe boolean")

    def matched(self, groups: DataFrame) -> DataFrame:
        """The (stored) groups whose digest the snapshot holds; its own rows are not shuffled."""
        return self.groups.select("digest").join(sized(groups), "digest").select("digest", "keep_id", "n")


_FILTER = "bucket int, seed long, length long, count long, cells binary"


class Snapshots:
    """The snapshots below a folder, in the order of their batches.

    ``add`` leaves all that is there as it is; a batch counts once its
    snapshot has its name, which is the last step.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.scratch = spark, Scratch(spark, "exact-batches")
        self.path = path or self.scratch.path("snapshots")
        root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        found = sorted((int(m[1]), int(m[2])) for m in (re.fullmatch(r"snapshot-(\d+)-(\d+)", n) for n in names) if m)
        self.held = [Snapshot(spark, self.path, k, buckets) for k, buckets in found]

    def _found(self, k: int, j: int) -> str:
        return f"{self.path}/found-{k}-{j}"

    def add(self, rows: DataFrame) -> None:
        """Add a batch's rows (id, digest, copies)."""
        k = len(self.held)
        groups = self.scratch.write(grouped(rows), f"new-{k}")
        for snapshot in (s for s in self.held if s.buckets):
            screened = self.scratch.write(snapshot.screen(groups), f"screened-{k}-{snapshot.k}")
            maybe = self.scratch.write(screened.where("maybe").drop("maybe"), f"maybe-{k}-{snapshot.k}")
            snapshot.matched(maybe).write.mode("overwrite").option("compression", "zstd").parquet(self._found(k, snapshot.k))
            found = self.spark.read.schema(maybe.schema).parquet(self._found(k, snapshot.k))
            groups = screened.where("not maybe").drop("maybe").unionByName(maybe.join(sized(found.select("digest")), "digest", "left_anti"))
        n = groups.count()
        buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-n // BUCKET_ROWS))) if n else 0
        self.held.append(Snapshot(self.spark, self.path, k, buckets, groups))

    def groups(self) -> DataFrame:
        """(digest, keep_id, n) of each digest, over all batches."""
        out = []
        for snapshot in self.held:
            later = [self.spark.read.parquet(self._found(k, snapshot.k)) for k in range(snapshot.k + 1, len(self.held)) if snapshot.buckets]
            if later:
                more = reduce(DataFrame.unionByName, later).groupBy("digest").agg(F.min("keep_id").alias("new_id"), F.sum("n").alias("new_n"))
                more = sized(self.scratch.write(more, f"later-{snapshot.k}"))
                out.append(snapshot.groups.join(more, "digest", "left").select("digest", F.least("keep_id", "new_id").alias("keep_id"), (F.col("n") + F.coalesce("new_n", F.lit(0))).alias("n")))
            else:
                out.append(snapshot.groups.select("digest", "keep_id", "n"))
        return reduce(DataFrame.unionByName, out)


def digested(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, batches: int, digest=sha256) -> DataFrame:
    """(id, digest, copies, batch) for each distinct row; repeated rows are counted before any shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), digest(normalised(text_col)).alias("digest"))
    rows = rows.groupBy("id", "digest").agg(F.count("*").alias("copies"))
    return scratch.write(rows.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")), "digests")


def grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("id").alias("keep_id"), F.sum("copies").alias("n"))


def groups_of(spark: SparkSession, rows: DataFrame, scratch: Scratch, batches: int) -> DataFrame:
    """One row (digest, keep_id, n) for each digest, batch after batch."""
    snapshots = Snapshots(spark)
    for k in range(batches):
        snapshots.add(rows.where(F.col("batch") == k))
    return scratch.write(snapshots.groups(), "groups")


def collided(docs: DataFrame, groups: DataFrame, text_col: str, digest=sha256) -> DataFrame:
    """Digests that stand for more than one text, by comparing whole texts."""
    many = groups.where("n > 1").select("digest")
    texts = docs.select(normalised(text_col).alias("body")).withColumn("digest", digest(F.col("body"))).join(sized(many), "digest", "left_semi")
    exact = texts.groupBy("digest", "body").agg(F.lit(1).alias("one"))
    return exact.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")


def _told_apart(docs: DataFrame, apart: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """Rows of colliding digests under longer digests: own number of each text."""
    texts = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("body")).withColumn("digest", digest(F.col("body")))
    texts = texts.join(sized(apart), "digest", "left_semi").groupBy("id", "digest", "body").agg(F.count("*").alias("copies"))
    per = texts.groupBy("digest", "body").agg(F.min("id").alias("keep_id"), F.sum("copies").alias("n"))
    return texts.join(per, ["digest", "body"]).select("id", "digest", "copies", "keep_id", "n", F.col("body"))


def verdicts(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2, digest=sha256) -> DataFrame:
    """(id, digest, copies, keep_id, n, text_no) of each distinct (id, text).

    ``copies`` rows repeat id and text; ``n`` rows have an equal text, of
    which a row with ``keep_id`` stays. ``text_no`` is the text itself where
    two texts share a digest, else null.
    """
    scratch = Scratch(spark, "exact")
    rows = digested(docs, scratch, id_col, text_col, batches, digest)
    groups = groups_of(spark, rows, scratch, batches)
    total = rows.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    apart = scratch.write(collided(docs, groups, text_col, digest), "collided")
    none = F.lit(None).cast("string").alias("text_no")
    if apart.isEmpty():
        return hot_join(rows.drop("batch"), groups, ["digest"], "n", total).select("id", "digest", "copies", "keep_id", "n", none)
    rows = rows.drop("batch").join(apart, "digest", "left_anti")
    kept = groups.join(apart, "digest", "left_anti")
    plain = hot_join(rows, kept, ["digest"], "n", total).select("id", "digest", "copies", "keep_id", "n", none)
    return plain.unionByName(_told_apart(docs, apart, id_col, text_col, digest).withColumnRenamed("body", "text_no"))


def report(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256."""
    rows = verdicts(spark, docs, id_col, text_col, batches).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2) -> DataFrame:
    """The rows that stay, with all their columns."""
    found = verdicts(spark, docs, id_col, text_col, batches)
    scratch = Scratch(spark, "exact-kept")
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    gone = scratch.write(found.where(~stays | (F.col("copies") > 1)).select("id", "digest", "text_no", stays.alias("stays")), "gone")
    key, digest_col, body = fresh(docs, "row_id", "row_digest", "row_body")
    gone = gone.select(F.col("id").alias(key), F.col("digest").alias(digest_col), F.col("text_no").alias(body), F.col("stays"))
    marked = docs.withColumn(digest_col, sha256(normalised(text_col)))
    match = lambda side: F.col(id_col).eqNullSafe(side[key]) & (marked[digest_col] == side[digest_col]) & F.coalesce(side[body] == normalised(text_col), F.lit(True))
    out = marked.join(side := sized(gone), match(side), "left_anti").drop(digest_col)
    repeated = scratch.write(gone.where("stays"), "repeated")
    if repeated.isEmpty():
        return out
    again = marked.join(side := sized(repeated), match(side), "left_semi").withColumn(body, normalised(text_col))
    one = again.groupBy(F.col(id_col).alias(key), digest_col, body).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row"))
    return out.unionByName(one.select("row.*"))
