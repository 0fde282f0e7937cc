"""Near duplicates: weighted minhashes of word shingles, banded, then verified.

A text is the multiset of its runs of ``size`` words (letters, digits and all
beyond ASCII, lower-cased). A shingle weighs its count times its damped IDF.
Samples are drawn by improved consistent weighted sampling (Ioffe, 2010) over
all shingles of a text, whatever its length. Bands of samples give buckets, of
which those with equal members count once. Bucket members are compared with
the bucket's most central member over their whole texts, by weighted Jaccard
similarity. In buckets that still hold several components, all pairs of
different components are compared: small buckets pair by pair, larger ones
block against block with a prefix filter that loses none. So every pair that
shares a bucket is compared or already linked.

Document frequencies are counted over all documents into a table of fixed
size. Its error is a fixed share of the documents (a text's mean number of
shingles over the table's width) at any scale. From a mean of some 4,000 on it
exceeds the share at which IDF begins to fall; then all weights fall alike
towards FLOOR, for sampling and verification both, and similarity comes closer
to that of plain counts.

Defined results: copies of one word sequence are one class; null texts and
texts without words are classes of their own, each; a text of fewer than
``size`` words is one shingle; other columns are kept untouched.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..scratch import Scratch, interpreted
from .blocks import Block, Powers, blocks, mix, plain_words, ranges
from .common import fresh, hot_join, sized, text_of

SIZE, LEAST = 5, 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: Width of the frequency table, its parts, and how many tables are summed at once.
WIDTH_BITS, PARTS, FAN = 22, 64, 64
#: A shingle in less than this share of documents has the full weight 1, one in all has FLOOR.
RARE, FLOOR = 1e-3, 0.7
#: Shingles whose samples are drawn at a time.
DRAWN = 1024
#: Members of a bucket whose pairs are made one by one, at most.
SMALL = 8
#: Members of an open bucket that are compared with as many others in one group, and bytes of their words, about.
BLOCK, BLOCK_TEXTS = 512, 4 << 20
#: Comparisons that one pivot's copy serves; a pivot of more is copied again.
SERVES = 500


class Grams:
    """Distinct shingles of a block's texts in order of (text, hash), with counts."""

    def __init__(self, block: Block, size: int = SIZE):
        words = block.word_hashes()
        hashes, text = block.grams(words, size), block.text_of_word()
        valid = block.room()[: len(hashes)] >= size
        h, t = hashes[valid], text[: len(hashes)][valid]
        for n in range(1, size):  # short texts are one shingle
            some = np.flatnonzero(block.counts == n)
            if len(some):
                first = block.bounds[:-1][some]
                h = np.concatenate([h, mix(block.grams(words, n)[first], n)])
                t = np.concatenate([t, some])
        order = np.argsort((t.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
        h, t = h[order], t[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        at = np.flatnonzero(new)
        self.hashes, self.text, self.counts = h[at], t[at], np.diff(np.append(at, len(h)))
        self.bounds = np.searchsorted(self.text, np.arange(block.n + 1))


def folded(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words of the block, each followed by a space, and where each text's begin."""
    plain = Block(block.folded, block.ends, block.first, np.arange(256, dtype=np.uint8), block.powers)
    joined, starts, _ = plain.joined()
    return joined, np.append(starts, len(joined))[plain.bounds]


def frequencies(size: int):
    """Rows (part, slice, counts): packed counters of how many texts hold a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        classes, powers, counts = plain_words(), Powers(), np.zeros(1 << WIDTH_BITS, np.uint32)
        for batch in batches:
            for block in blocks(batch.column(0), classes, powers):
                np.add.at(counts, (Grams(block, size).hashes >> np.uint64(64 - WIDTH_BITS)).astype(np.int64), 1)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(PARTS), pa.int32()), pa.array([task] * PARTS, pa.int64()), pa.array([zlib.compress(x.astype(np.int64).tobytes(), 1) for x in np.split(counts, PARTS)], pa.binary())],
            ["part", "slice", "counts"],
        )

    return run


def _summed(group: pa.Table) -> pa.Table:
    total = np.zeros((1 << WIDTH_BITS) // PARTS, np.int64)
    for x in group["counts"]:
        total += np.frombuffer(zlib.decompress(x.as_py()), np.int64)
    return pa.table({"part": group["part"].slice(0, 1), "slice": pa.array([group["slice"][0].as_py() // FAN], pa.int64()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def weights(docs: DataFrame, scratch: Scratch, size: int) -> np.ndarray:
    """Weight of a shingle by its place in the frequency table, 256 levels: 4 MB, whatever the input."""
    tables = docs.mapInArrow(frequencies(size), "part int, slice long, counts binary")
    tables = scratch.write(tables, "counts-0")
    n, slices, turn = docs.count(), tables.agg(F.coalesce(F.max("slice"), F.lit(0)).alias("n")).first()["n"] + 1, 0
    while slices > 1 or not turn:  # FAN tables at a time, so no task holds more
        summed = tables.withColumn("group", F.floor(F.col("slice") / FAN)).groupBy("part", "group").applyInArrow(lambda g: _summed(g), "part int, slice long, counts binary")
        tables, turn, slices = scratch.write(summed, f"counts-{turn + 1}"), turn + 1, -(-slices // FAN)
    rows = {r["part"]: r["counts"] for r in tables.collect()}  # PARTS rows
    empty = zlib.compress(np.zeros((1 << WIDTH_BITS) // PARTS, np.int64).tobytes())
    counts = np.concatenate([np.frombuffer(zlib.decompress(rows.get(p, empty)), np.int64) for p in range(PARTS)])
    share = np.clip(counts / max(n, 1), RARE, 1)
    level = np.rint(255 * np.log(share) / np.log(RARE)).astype(np.uint8)
    scratch.drop(*[f"counts-{k}" for k in range(turn + 1)])
    return level


def weight_of(grams: Grams, level: np.ndarray) -> np.ndarray:
    idf = level[(grams.hashes >> np.uint64(64 - WIDTH_BITS)).astype(np.int64)] / 255
    return grams.counts * (FLOOR + (1 - FLOOR) * idf)


@cache
def gamma_quantiles() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A Gamma(2, 1) variable at 2**16 even chances, its inverse and its logarithm."""
    x = np.concatenate([np.geomspace(1e-4, 1, 20_000), np.linspace(1, 40, 200_000)[1:]])
    q = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), -np.expm1(-x) - x * np.exp(-x), x)
    return q.astype(np.float32), (1 / q).astype(np.float32), np.log(q).astype(np.float32)


def consistent_samples(grams: Grams, weight: np.ndarray) -> np.ndarray:
    """(texts, SAMPLES): of each sample the shingle and level with the smallest key.

    A shingle's own r, c ~ Gamma(2, 1) and beta ~ Uniform(0, 1) of a sample are
    the same in every text. With t = floor(ln w / r + beta) its key is
    ln c - r (t - beta) - r, and the sample is (shingle, t): two texts draw the
    same one with their weighted Jaccard similarity as chance. Shingles come
    DRAWN at a time, so long texts need no more room than short ones.
    """
    r_of, inverse_of, log_c_of = gamma_quantiles()
    log_weight = np.log(weight).astype(np.float32)
    seeds, factor, half = mix(np.arange(1, SAMPLES + 1).astype(np.uint64), 5)[:, None], np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
    least = np.full((SAMPLES, len(grams.bounds) - 1), np.inf, np.float32)
    out = np.zeros(least.shape, np.uint64)
    for low in range(0, len(weight), DRAWN):
        h, log_w, text = (x[low : low + DRAWN] for x in (grams.hashes, log_weight, grams.text))
        z = (h ^ seeds) * factor
        z ^= z >> half
        z *= factor
        z ^= z >> half
        parts = z.view(np.uint16).reshape(SAMPLES, -1, 4)
        beta = parts[:, :, 1].astype(np.float32) * np.float32(2.0**-16)
        level = np.floor(inverse_of.take(parts[:, :, 0]) * log_w + beta)
        key = log_c_of.take(parts[:, :, 2]) - r_of.take(parts[:, :, 0]) * (level - beta + 1)
        starts = np.flatnonzero(np.diff(text, prepend=-1))
        smallest, own = np.minimum.reduceat(key, starts, axis=1), text[starts]
        better = smallest < least[:, own]
        least[:, own] = np.minimum(smallest, least[:, own])
        sample, at = np.nonzero(key == np.repeat(np.where(better, smallest, -np.inf), np.diff(np.append(starts, len(text))), axis=1))
        out[sample, text[at]] = mix(h[at] ^ mix(level[sample, at].astype(np.int64).view(np.uint64), 3))
    return out.T


def banded(samples: np.ndarray) -> np.ndarray:
    """Bucket of each band, told apart by band."""
    parts = samples.reshape(len(samples), BANDS, ROWS)
    out = np.broadcast_to((np.arange(BANDS) + 1).astype(np.uint64), parts.shape[:2])
    for k in range(ROWS):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k])
    return out


def signed(size: int, level):
    """Rows (doc_id, key, length, buckets): key is a digest of the words, null without any; length is in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, powers, table = plain_words(), Powers(), level.value
        for batch in batches:
            for block in blocks(batch.column(1), classes, powers):
                grams = Grams(block, size)
                joined, at = folded(block)
                some = np.diff(grams.bounds) > 0
                found = banded(consistent_samples(grams, weight_of(grams, table)))
                buckets = [own if any_ else [] for own, any_ in zip(found.view(np.int64).tolist(), some.tolist(), strict=True)]
                keys = [hashlib.blake2b(joined[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() if some[i] else None for i in range(block.n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n), pa.array(keys, pa.binary()), pa.array(np.diff(at)), pa.array(buckets, pa.list_(pa.int64()))], ["doc_id", "key", "length", "buckets"]
                )

    return run


def worded():
    """Rows (key, words) of the texts, as in ``signed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, powers = plain_words(), Powers()
        for batch in batches:
            for block in blocks(batch.column(0), classes, powers):
                joined, at = folded(block)
                words = [joined[at[i] : at[i + 1]].tobytes() for i in range(block.n)]
                words = [x for x in words if x]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in words], pa.binary()), pa.array(words, pa.binary())], ["key", "words"])

    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, weights)."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    both = a[0][at] == b[0]
    shared = float(np.minimum(a[1][at[both]], b[1][both]).sum())
    return shared / (float(a[1].sum()) + float(b[1].sum()) - shared)


def profile(words: bytes, size: int, level: np.ndarray, classes: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    (block,) = blocks(pa.array([words], pa.binary()), classes, powers, most=1 << 62)
    grams = Grams(block, size)
    order = np.argsort(grams.hashes)
    return grams.hashes[order], weight_of(grams, level)[order]


def compared(size: int, least: float, level):
    """Rows (pivot, salt, kind, node, words) in that order; a pivot's own row
    comes first. Rows (a, b) of the pairs that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, powers, table = plain_words(), Powers(), level.value
        pivot, own = None, None
        for batch in batches:
            a, b = [], []
            pivots, kinds, nodes, words = (batch.column(k) for k in ("pivot", "kind", "node", "words"))
            for i in range(len(batch)):
                x = profile(words[i].as_py(), size, table, classes, powers)
                if kinds[i].as_py() == 0:
                    pivot, own = pivots[i].as_py(), x
                elif own is not None and pivots[i].as_py() == pivot and similarity(own, x) >= least:
                    a.append(pivot)
                    b.append(nodes[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, size: int, least: float, level) -> DataFrame:
    """The pairs (pivot, node) whose whole texts are similar, as (a, b).

    Sorted by pivot, so that a task holds one pivot's shingles at a time; a
    pivot of many pairs is copied once for each SERVES of them.
    """
    served = pairs.groupBy("pivot").agg(F.count("*").alias("pairs")).withColumn("salts", F.ceil(F.col("pairs") / SERVES))
    of_pivots = served.join(texts, served["pivot"] == texts["node"]).select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "node", "words")
    total = pairs.count()
    salted = hot_join(pairs, served.select("pivot", "pairs", "salts"), ["pivot"], "pairs", total).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")))
    of_nodes = salted.select("pivot", "salt", "node").join(texts, "node").select("pivot", "salt", F.lit(1).alias("kind"), "node", "words")
    rows = of_pivots.unionByName(of_nodes).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "kind")
    return rows.mapInArrow(compared(size, least, level), "a long, b long")


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Each unordered pair (pivot, node) once."""
    low, high = F.least("pivot", "node").alias("low"), F.greatest("pivot", "node").alias("high")
    once = pairs.groupBy(low, high).agg(F.min("pivot").alias("pivot"))
    return once.select("pivot", F.when(F.col("pivot") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("node"))


def first_pairs(members: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members (bucket, node, length, size) of buckets of two and more; pairs of each with its bucket's most central member.

    Of buckets with the same members one is kept. A node's degree is how many
    members its buckets have in all: the text that a family was copied from is
    similar to most of it and has the highest.
    """
    name = lambda seed: F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"x{seed}")
    many = members.groupBy("bucket").agg(F.count("*").alias("size"), name(1), name(2)).where("size > 1")
    many = scratch.write(many.groupBy("size", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket", "size"), "buckets")
    total = many.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    held = scratch.write(hot_join(members, many, ["bucket"], "size", total, listed=True), "members")
    degrees = held.groupBy("node").agg(F.sum("size").alias("degree"))
    pivots = held.join(degrees, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node"))["node"].alias("pivot"), F.max("size").alias("of"))
    pairs = hot_join(held.select("bucket", "node"), scratch.write(pivots, "pivots"), ["bucket"], "of", total, listed=True).where("node <> pivot")
    return held, distinct_pairs(pairs.select("pivot", "node"))


def opened(held: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, node, length, size, root) of the buckets that hold several components."""
    rooted = held.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("size").alias("of")).where("low <> high").select("bucket", "of")
    return hot_join(rooted, scratch.write(split, "split"), ["bucket"], "of", held.count(), listed=True).drop("of")


def small_pairs(open_: DataFrame) -> DataFrame:
    """Pairs (pivot, node) of different components of the buckets of up to SMALL members."""
    few = open_.where(F.col("size") <= SMALL).groupBy("bucket").agg(F.collect_list(F.struct("node", "root")).alias("all"))
    few = few.select(F.explode("all").alias("x"), "all").select("x.*", F.explode("all").alias("y"))
    return distinct_pairs(few.where("root <> y.root").select(F.col("y.node").alias("pivot"), "node"))


def all_pairs(size: int, least: float, level):
    """Rows (a, b) of the similar pairs of different components in a group of
    rows (side, node, root, shared, words): of one side, or else across its two.

    Shingles are put in order from the group's rarest on. What a text has left
    after its prefix weighs less than ``least`` of it, so similar texts share a
    shingle of both prefixes. A pair is left to the smallest bucket it shares.
    """

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        classes, powers, table = plain_words(), Powers(), level.value
        bucket, low, high = (k.as_py() for k in key)
        side, nodes, root = (group[c].to_numpy() for c in ("side", "node", "root"))
        root, shared, profiles = root.copy(), [set(x) for x in group["shared"].to_pylist()], []
        for block in blocks(group["words"].combine_chunks(), classes, powers):
            grams = Grams(block, size)
            w = weight_of(grams, table)
            for i in range(block.n):
                h, own = grams.hashes[grams.bounds[i] : grams.bounds[i + 1]], w[grams.bounds[i] : grams.bounds[i + 1]]
                order = np.argsort(h)
                profiles.append((h[order], own[order]))
        lengths, total = np.array([len(h) for h, _ in profiles]), np.array([w.sum() for _, w in profiles])
        _, name, often = np.unique(np.concatenate([h for h, _ in profiles]), return_inverse=True, return_counts=True)
        place = np.empty(len(often), np.int64)
        place[np.argsort(often, kind="stable")] = np.arange(len(often))
        text, place = np.repeat(np.arange(len(profiles)), lengths), place[name]
        order = np.lexsort((place, text))
        place, w = place[order], np.concatenate([w for _, w in profiles])[order]
        ends = np.cumsum(lengths)
        before = np.cumsum(w) - w
        left = np.append(before, w.sum())[ends][text] - before
        inside = left >= (least - 1e-6) * total[text]
        text, place = text[inside], place[inside]
        of_text = np.searchsorted(text, np.arange(len(profiles) + 1))
        order = np.argsort(place, kind="stable")
        holders, starts = text[order], np.searchsorted(place[order], np.arange(len(often) + 1))
        a, b = [], []
        for x in np.flatnonzero(side == low).tolist():
            mine = place[of_text[x] : of_text[x + 1]]
            y = np.unique(holders[ranges(starts[mine], starts[mine + 1] - starts[mine])])
            y = y[(y > x) if low == high else (side[y] == high)]
            y = y[np.minimum(total[y], total[x]) >= (least - 1e-6) * np.maximum(total[y], total[x])]
            for other in y.tolist():
                if root[other] != root[x] and min(shared[x] & shared[other]) == bucket and similarity(profiles[x], profiles[other]) >= least:
                    a.append(nodes[x])
                    b.append(nodes[other])
                    root[root == root[other]] = root[x]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def remaining(open_: DataFrame, texts: DataFrame, scratch: Scratch, size: int, least: float, level) -> DataFrame:
    """Links (a, b) among all pairs of different components of the larger open buckets.

    A bucket's largest component need not be compared with itself: the blocks
    of the others come first, numbered 0 to rest, then its own.
    """
    large = open_.where(F.col("size") > SMALL)
    parts = large.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    split = parts.groupBy("bucket").agg(F.max(F.struct("n", "root", "bytes")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    blocked = lambda n, bytes_: F.greatest(F.ceil(n / BLOCK), F.ceil(bytes_ / BLOCK_TEXTS)).cast("long")
    split = split.select("bucket", F.col("main.root").alias("main"), blocked(F.col("main.n"), F.col("main.bytes")).alias("own"), blocked(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("rest"), F.col("n").alias("of"))
    sides = hot_join(large, scratch.write(split, "sides"), ["bucket"], "of", large.count(), listed=True)
    shared = large.groupBy("node").agg(F.collect_set("bucket").alias("shared"))
    of_main, part = F.col("root") == F.col("main"), lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    side = F.when(of_main, F.col("rest") + part("own")).otherwise(part("rest"))
    others = F.sequence(F.lit(0).cast("long"), F.when(of_main, F.col("rest")).otherwise(F.col("rest") + F.col("own")) - 1)
    rows = sides.select("bucket", "node", "root", side.alias("side"), F.explode(others).alias("other"))
    rows = rows.select("bucket", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "node", "root")
    return rows.join(shared, "node").join(texts, "node").groupBy("bucket", "low", "high").applyInArrow(all_pairs(size, least, level), "a long, b long")


def merged(scratch: Scratch, roots: DataFrame, found: DataFrame) -> DataFrame:
    """(node, root) after more links; only their ends' components are joined anew."""
    ends = found
    for end in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    above = components(scratch, ends.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")), "graph-more")
    above = scratch.write(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "above")
    known = roots.join(sized(above), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return known.unionByName(above.select(F.col("root").alias("node"), F.col("top").alias("root")).join(roots, "node", "left_anti"))


def classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, least: float = LEAST) -> tuple[Scratch, DataFrame, DataFrame]:
    """Stored rows (doc_id, key) and, for each key, (key, n, class_id, class_size)."""
    scratch = Scratch(spark, "near")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    level = spark.sparkContext.broadcast(weights(texts.select("text"), scratch, size))
    rows = scratch.write(texts.mapInArrow(signed(size, level), "doc_id long, key binary, length long, buckets array<long>"), "rows")
    keys = rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("length").alias("length"), F.first("buckets").alias("buckets"))
    keys = scratch.write(keys.withColumn("node", F.monotonically_increasing_id()), "keys")
    held, pairs = first_pairs(keys.select("node", "length", F.explode("buckets").alias("bucket")), scratch)
    pairs = scratch.write(pairs, "pairs")
    wanted = scratch.write(held.select("node").distinct().join(keys.select("node", "key"), "node"), "wanted")
    words = texts.select("text").mapInArrow(worded(), "key binary, words binary").join(sized(wanted), "key")
    words = scratch.write(words.groupBy("node", "words").agg(F.lit(1).alias("one")).drop("one"), "words")
    links = scratch.write(verified(pairs, words, size, least, level), "links")
    with interpreted(spark):  # many plans over tables of links; all work on texts is in numpy
        roots = scratch.write(components(scratch, links, "graph"), "roots")
        open_ = scratch.write(opened(held, roots, scratch), "open")
        pairs = scratch.write(small_pairs(open_), "small-pairs")
        more = scratch.write(verified(pairs, words, size, least, level).unionByName(remaining(open_, words, scratch, size, least, level)), "more-links")
        if not more.isEmpty():
            roots = scratch.write(merged(scratch, roots, more), "merged")
    scratch.drop("words", "members", "open")
    of_key = keys.select("key", "node", "doc_id", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per = of_key.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("members"))
    of_key = scratch.write(hot_join(of_key, per, ["root"], "members", keys.count()).select("key", "n", "class_id", "class_size"), "classes")
    return scratch, rows.select("doc_id", "key"), of_key


def report(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, least: float = LEAST) -> DataFrame:
    """One row for each input row: doc_id, class_id (smallest doc_id of its class), class_size, kept."""
    _, rows, of_key = classes(spark, docs, id_col, text_col, size, least)
    alone = rows.where("key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    others = hot_join(rows.where("key is not null"), of_key, ["key"], "n", rows.count())
    out = alone.unionByName(others.select("doc_id", "class_id", "class_size"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id"))).withColumnRenamed("doc_id", id_col)


def deduplicated(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, least: float = LEAST) -> DataFrame:
    """The rows of the smallest id of each class, with all their columns.

    Rows that repeat that id and its words all stay: exact duplicates are for
    the exact operator, which comes first.
    """
    scratch, rows, of_key = classes(spark, docs, id_col, text_col, size, least)
    found = hot_join(rows.where("key is not null"), of_key, ["key"], "n", rows.count())
    key = fresh(docs, "gone_id")[0]
    gone = scratch.write(found.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias(key)).distinct(), "gone")
    side = sized(gone)
    return docs.join(side, F.col(id_col).cast("long") == side[key], "left_anti")
