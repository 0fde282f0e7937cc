"""Benchmark decontamination: winnowed fingerprints joined, hits extended exactly.

Everything is DataFrame functions. A fingerprint is the hash of ``gram``
words; of each ``window - gram + 1`` consecutive ones the smallest is kept, so
any span of ``window`` words that a text and an item share has a fingerprint
kept on both sides. Texts with a kept fingerprint of an item are candidates,
all others are clean for certain. A candidate's fingerprints give diagonals
(text place minus item place); along each diagonal the words themselves are
compared, so what is marked is exact, whatever the hashes did.

Items of fewer than ``window`` words are one window of their own; each such
length is hashed whole and goes the same way.

Defined results: null and empty texts have no words and are clean; empty items
mark nothing; rows that repeat are judged each; an item_id that is null or
repeated counts as its own item, listed by its string ("" for null).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from .common import fresh, hot_join, sized, text_of

WINDOW, GRAM = 10, 4
#: The characters of a word, after A-Z are lower-cased, and before.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]++"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str | Column) -> Column:
    return F.filter(F.split(F.translate(text_of(text), UPPER, LOWER), GAPS), lambda x: x != "")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once: the optimiser would copy a
    plain column into each place, so into each step of the loops below."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _head(values: Column, less: int) -> Column:
    """Without the last ``less`` values."""
    return F.slice(values, 1, F.greatest(F.size(values) - less, F.lit(0))) if less else values


def _doubled(values: Column, size: int, join, have: int = 1) -> Column:
    """Each value joined with the ``size`` - 1 after it, by ever longer steps."""
    if have == size:
        return _head(values, size - 1)
    step = min(have, size - have)
    return _let(values, lambda a: _doubled(F.transform(a, lambda x, i: join(x, F.get(a, i + step))), size, join, have + step))


def grams(words_: Column, size: int) -> Column:
    """Hash of the ``size`` words at each place where so many follow (steps that overlap take a word twice)."""
    return _doubled(F.transform(words_, lambda x: F.xxhash64(x)), size, lambda x, y: F.xxhash64(x, y))


def winnowed(prints: Column, window: int = WINDOW, gram: int = GRAM) -> Column:
    """The smallest of each ``window - gram + 1`` fingerprints, each once."""
    return F.array_distinct(_doubled(prints, window - gram + 1, lambda x, y: F.least(x, y)))


class Index:
    """The benchmark's items: words, and the fingerprints that lead to them."""

    def __init__(self, scratch: Scratch, items: DataFrame, id_col: str, text_col: str, window: int, gram: int):
        self.window, self.gram = window, gram
        rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"), words(text_col).alias("item_words")).where(F.size("item_words") > 0)
        self.items = scratch.write(rows.withColumn("item", F.monotonically_increasing_id()), "items")
        long_ = self.items.where(F.size("item_words") >= window)
        places = long_.select("item", F.posexplode(grams(F.col("item_words"), gram)).alias("item_at", "h"), "item_words")
        places = places.join(long_.select("item", F.explode(winnowed(grams(F.col("item_words"), gram), window, gram)).alias("h")), ["item", "h"], "left_semi")
        places = places.select(F.lit(window).alias("size"), "h", "item", "item_at")
        short = self.items.where(F.size("item_words") < window).withColumn("size", F.size("item_words"))
        places = places.unionByName(short.select("size", F.explode(self._whole("item_words")).alias("h"), "item", F.lit(0).alias("item_at")))
        self.places = scratch.write(places, "places")
        #: Lengths of the short items, each below the window.
        self.lengths = sorted(r["size"] for r in self.places.where(F.col("size") < window).select("size").distinct().collect())
        self.keys = scratch.write(self.places.select("size", "h").distinct(), "keys")

    def _whole(self, words_col: str) -> Column:
        """The one gram of all words of a short item."""
        of = F.lit(None).cast("array<long>")
        for n in range(1, self.window):
            of = F.when(F.size(words_col) == n, grams(F.col(words_col), n)).otherwise(of)
        return of

    def candidate_keys(self, docs: DataFrame) -> DataFrame:
        """(mark, size, h) of docs (mark, words): kept fingerprints, and whole grams of the short lengths."""
        tagged = lambda values, n: F.transform(values, lambda x: F.struct(F.lit(n).alias("size"), x.alias("h")))
        arrays = [tagged(winnowed(grams(F.col("words"), self.gram), self.window, self.gram), self.window)]
        arrays += [tagged(F.array_distinct(grams(F.col("words"), n)), n) for n in self.lengths]
        return docs.select("mark", F.explode(F.concat(*arrays) if len(arrays) > 1 else arrays[0]).alias("key")).select("mark", "key.*")

    def hits(self, docs: DataFrame) -> DataFrame:
        """(row_id, item_id, size, starts) of candidates (row_id, words): places where a window of the item is, compared word by word."""
        places = [docs.select("row_id", F.posexplode(grams(F.col("words"), n)).alias("at", "h")).withColumn("size", F.lit(size)) for size, n in [(self.window, self.gram), *zip(self.lengths, self.lengths, strict=True)]]
        places = reduce(DataFrame.unionByName, places)
        side = self.places.join(sized(self.items), "item").select("size", "h", "item", "item_at")
        diagonals = places.join(sized(side), ["size", "h"]).groupBy("row_id", "item").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("diagonals"), F.first("size").alias("size"))
        both = diagonals.join(sized(self.items), "item").join(docs.select("row_id", "words"), "row_id")

        def matches(d: Column) -> Column:
            """Places of the text on one diagonal where a whole window is equal."""
            return F.filter(
                F.sequence(F.greatest(d, F.lit(0)), F.least(d + F.size("item_words"), F.size("words")) - F.col("size")),
                lambda i: F.slice("words", i + 1, F.col("size")) == F.slice("item_words", i - d + 1, F.col("size")),
            )

        fits = F.filter("diagonals", lambda d: F.least(d + F.size("item_words"), F.size("words")) - F.col("size") >= F.greatest(d, F.lit(0)))
        return both.select("row_id", "item_id", "item", "size", F.array_distinct(F.flatten(F.transform(fits, matches))).alias("starts")).where(F.size("starts") > 0)


def judged(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Each row of docs with n_words, n_hit, n_items, hit_items (strings in order), spans (first word, words) as added columns."""
    scratch = Scratch(spark, "contamination")
    index = Index(scratch, items, item_id, item_text, window, gram)
    mark, row = fresh(docs, "text_mark", "row_id")
    texts = docs.select(F.xxhash64(text_of(text_col)).alias("mark"), words(text_col).alias("words")).where(F.size("words") >= min([window, *index.lengths]))
    found = index.candidate_keys(texts).join(sized(index.keys), ["size", "h"], "left_semi").select("mark").distinct()
    marks = scratch.write(found.withColumnRenamed("mark", mark), "marks")
    side = sized(marks)
    marked = docs.withColumn(mark, F.xxhash64(text_of(text_col)))
    added = {"n_words": F.regexp_count(text_of(text_col), F.lit(ANY_CASE_WORD)).cast("long"), "n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "hit_items": F.array().cast("array<string>"), "spans": F.array().cast("array<struct<first:int,words:int>>")}
    names = dict(zip(added, fresh(docs, *added), strict=True))
    clean = marked.select(*docs.columns, mark, *[c.alias(names[n]) for n, c in added.items()]).join(side, mark, "left_anti").select(*docs.columns, *names.values())
    open_ = scratch.write(marked.join(side, mark, "left_semi").drop(mark).withColumn(row, F.monotonically_increasing_id()), "candidates")
    split = open_.select(F.col(row).alias("row_id"), words(text_col).alias("words"))
    hits = index.hits(split).groupBy("row_id").agg(
        F.array_sort(F.collect_list("item_id")).alias("hit_items"),
        F.array_distinct(F.flatten(F.collect_list(F.transform("starts", lambda i: F.struct(i.cast("int").alias("first"), F.col("size").cast("int").alias("words")))))).alias("spans"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["first"] + s["words"] - 1)))))
    hits = hits.select(
        F.col("row_id").alias(row), covered.cast("long").alias(names["n_hit"]), F.size("hit_items").cast("long").alias(names["n_items"]),
        F.col("hit_items").alias(names["hit_items"]), F.array_sort("spans").alias(names["spans"]),
    )
    dirty = open_.withColumn(names["n_words"], added["n_words"]).join(hits, row, "left")
    dirty = dirty.select(*docs.columns, *[F.coalesce(F.col(names[n]), added[n]).alias(names[n]) if n != "n_words" else F.col(names[n]) for n in added])
    return clean.unionByName(dirty)


def report(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    out = judged(spark, docs.select("doc_id", "text"), items)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def decontaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, text_col: str = "text", share: float = 0.0) -> DataFrame:
    """The rows of which no more than ``share`` of the words is hit, with their columns."""
    out = judged(spark, docs, items, text_col=text_col)
    n_words, n_hit = fresh(docs, "n_words", "n_hit")
    return out.where(F.col(n_hit) <= share * F.col(n_words)).select(*docs.columns)
