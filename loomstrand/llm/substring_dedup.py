"""Repeated passages: windows of words counted exactly through super-k-mers.

The minimiser of a window is the smallest hash among its runs of ``core``
words. Consecutive windows with one minimiser travel as one packed string (a
super-k-mer) to the minimiser's bucket; equal windows share a minimiser, so
each bucket counts its own windows exactly by sorting them.

Two lossless screens keep the volume down. A window can only repeat if its
minimiser occurs at two places, so minimisers are counted first and the
repeated ones marked in a bit table of fixed size; what it lets through by
chance is merely counted in vain. Very frequent minimisers are ranked behind
all others, so a common phrase gathers no bucket unless whole windows consist
of it; such buckets are parted by a second minimiser, and equal strings are
summed before they are shuffled. What still gathers many strings, such as a
notice that stands in many texts with other words around it each time, is
counted window by window instead, by digest, so that no task holds a bucket of
over HELD strings.

Defined results: words are runs of other than white space, unchanged; null and
empty texts have none and are kept as they are; a text shorter than a window
loses nothing; rows that repeat are separate rows and so repeat each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from .blocks import BLOCK_BYTES, Block, Powers, binaries, blocks, mix, portions, ranges, sliding_min, white_words
from .common import hot_join, sized, text_of

#: Bits of the table of repeated minimisers; 8 MB whatever the input.
SCREEN_BITS = 1 << 26
#: A minimiser is frequent from this many places on, or from this share.
FREQUENT, FREQUENT_SHARE = 500, 1e-6
#: Strings of a bucket that one task counts, at most.
HELD = 1000
_TOP = np.uint64(1 << 63)


def _minimisers(block: Block, window: int, core: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word: hash of the core run there, top bit clear; whether a window of its text starts there."""
    cores = block.grams(block.word_hashes(), core) & ~_TOP
    return cores, block.room() >= window


def _changes(values: np.ndarray, valid: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where a new run of valid windows with equal values in one text begins."""
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | ~valid[:-1] | (text[1:] != text[:-1])
    return np.flatnonzero(new & valid)


def count_minimisers(window: int, core: int):
    """Rows (h, n): places of each minimiser, summed within each block.

    A place is a run of ``core`` words that is the smallest in some window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, powers = white_words(), Powers()
        for batch in batches:
            for block in blocks(batch.column(0), classes, powers):
                if not len(block.starts) or len(block.starts) < window:
                    continue
                cores, valid = _minimisers(block, window, core)
                width = window - core + 1
                least = sliding_min(cores, width)
                least = np.where(valid[: len(least)], least, np.uint64(0))
                most = ~sliding_min(~np.pad(least, width - 1), width)  # of the windows that hold a place
                h, n = np.unique(cores[(most == cores) & (cores > 0)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n)], ["h", "n"])

    return run


def repeated_bits(counts: DataFrame) -> np.ndarray:
    """The bit table of all minimisers with n > 1; at most SCREEN_BITS / 64 rows reach the driver."""
    words = SCREEN_BITS // 64
    twice = counts.where("n > 1").select(F.explode(F.array("h", F.shiftrightunsigned("h", 29))).alias("p")).select(F.col("p").bitwiseAND(SCREEN_BITS - 1).alias("p"))
    rows = twice.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(words, np.int64)
    table[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return table.view(np.uint64)


def _maybe(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for p in (h, h >> np.uint64(29)):
        p = p & np.uint64(SCREEN_BITS - 1)
        out &= (table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return out


_PASS = pa.schema([
    ("kind", pa.int32()), ("row_id", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("body", pa.binary()), ("sha", pa.string()),
    ("first", pa.int32()), ("windows", pa.int32()), ("bucket", pa.int64()), ("packed", pa.binary()),
])
_PASS_SQL = "kind int, row_id long, doc_id long, n_words long, body binary, sha string, first int, windows int, bucket long, packed binary"


def _rows(n: int, **have) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([have[f.name] if f.name in have else pa.nulls(n, f.type) for f in _PASS], schema=_PASS)


def cut(window: int, core: int, shared, with_text: bool):
    """Kind 0: texts without a window that may repeat, done. Kind 1: the other
    texts, words joined by a space. Kind 2: their super-k-mers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, powers = white_words(), Powers()
        bits, frequent = shared.value
        for batch in batches:
            for block in blocks(batch.column(2), classes, powers):
                ids, rows = batch.column(1).slice(block.first, block.n), batch.column(0).slice(block.first, block.n).to_numpy()
                joined, starts, stops = block.joined()
                text = block.text_of_word()
                travels = np.zeros(block.n, bool)
                if len(block.starts) >= window:
                    cores, valid = _minimisers(block, window, core)
                    least = sliding_min(cores, window - core + 1)
                    valid = valid[: len(least)]
                    valid = valid & _maybe(bits, least)
                    late = np.isin(cores, frequent)
                    if late.any():
                        least = sliding_min(np.where(late, cores | _TOP, cores), window - core + 1)
                        if (hot := least >= _TOP).any():  # nothing but frequent runs: a second minimiser parts the bucket
                            second = sliding_min(mix(cores, 5), window - core + 1)
                            least = np.where(hot, mix(least ^ mix(second, 9)) | _TOP, least)
                    begin = _changes(least, valid, text[: len(least)])
                    stop = np.ones(len(least), bool)
                    stop[:-1] = (least[1:] != least[:-1]) | ~valid[1:] | (text[1 : len(least)] != text[: len(least) - 1])
                    end = np.flatnonzero(stop & valid)
                    travels[text[begin]] = True
                    for part in portions(stops[end + window - 1] - starts[begin], 1 << 28):
                        b, e = begin[part], end[part]
                        low, high = starts[b], stops[e + window - 1]
                        yield _rows(
                            len(b), kind=pa.array(np.full(len(b), 2, np.int32)), row_id=pa.array(rows[text[b]]),
                            first=pa.array((b - block.bounds[text[b]]).astype(np.int32)), windows=pa.array((e - b + 1).astype(np.int32)),
                            bucket=pa.array(least[b].view(np.int64)), packed=binaries(joined, low, high - low),
                        )
                some = block.counts > 0
                at = np.zeros(block.n, np.int64)
                to = np.zeros(block.n, np.int64)
                at[some], to[some] = starts[block.bounds[:-1][some]], stops[block.bounds[1:][some] - 1]
                done = np.flatnonzero(~travels)
                yield _rows(
                    len(done), kind=pa.array(np.zeros(len(done), np.int32)), row_id=pa.array(rows[done]), doc_id=ids.take(pa.array(done)), n_words=pa.array(block.counts[done]),
                    sha=pa.array([hashlib.sha256(joined[a:b].tobytes()).hexdigest() for a, b in zip(at[done], to[done], strict=True)], pa.string()),
                    **({"body": binaries(joined, at[done], (to - at)[done])} if with_text else {}),
                )
                open_ = np.flatnonzero(travels)
                yield _rows(
                    len(open_), kind=pa.array(np.ones(len(open_), np.int32)), row_id=pa.array(rows[open_]), doc_id=ids.take(pa.array(open_)),
                    n_words=pa.array(block.counts[open_]), body=binaries(joined, at[open_], (to - at)[open_]),
                )

    return run


def _equal_windows(block: Block, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Whether windows a[i] and b[i], numbered by their first words, hold the same words."""
    low_a, low_b = block.starts[a], block.starts[b]
    length = block.stops[a + window - 1] - low_a
    out = length == block.stops[b + window - 1] - low_b
    for at in range(0, len(a), 1 << 14):
        part = np.flatnonzero(out[at : at + (1 << 14)]) + at
        if len(part):
            same = block.data[ranges(low_a[part], length[part])] == block.data[ranges(low_b[part], length[part])]
            firsts = np.zeros(len(part), np.int64)
            np.cumsum(length[part][:-1], out=firsts[1:])
            out[part] = np.logical_and.reduceat(same, firsts)
    return out


def window_counts(strings: pa.Array, times: np.ndarray, window: int, hashed=None) -> tuple[Block, np.ndarray, np.ndarray]:
    """Block of the packed strings, the first words of their windows, how often each window occurs in all."""
    (block,) = blocks(strings, white_words(), most=1 << 62)
    first = np.flatnonzero(block.room() >= window)
    h = (hashed or (lambda b: b.grams(b.word_hashes(), window)))(block)[first]
    order = np.argsort(h, kind="stable")
    near = h[order][1:] == h[order][:-1]
    a, b = first[order[:-1][near]], first[order[1:][near]]
    weight = times[block.text_of_word()[first]]
    if len(a) and not _equal_windows(block, a, b, window).all():  # one hash for two texts: count by the words
        held: dict[bytes, int] = {}
        keys = [block.data[block.starts[i] : block.stops[i + window - 1]].tobytes() for i in first]
        for key, n in zip(keys, weight.tolist(), strict=True):
            held[key] = held.get(key, 0) + n
        return block, first, np.array([held[k] for k in keys], np.int64)
    group = np.zeros(len(first), np.int64)
    group[order[1:]] = np.cumsum(~near) if len(near) else 0
    return block, first, np.bincount(group, weight).astype(np.int64)[group]


def count_windows(window: int, most: int = 8 * BLOCK_BYTES):
    """Sorted rows (bucket, sid, packed, n): flags of the windows that repeat, for each string that has any."""

    def flagged(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        strings = table["packed"].chunk(0) if table["packed"].num_chunks else pa.array([], pa.binary())
        block, first, counts = window_counts(strings, table["n"].to_numpy(), window)
        text, hit = block.text_of_word()[first], counts > 1
        bounds = np.searchsorted(text, np.arange(block.n + 1))
        some = [i for i in range(block.n) if hit[bounds[i] : bounds[i + 1]].any()]
        yield pa.RecordBatch.from_arrays(
            [table["sid"].chunk(0).take(pa.array(some, pa.int64())), pa.array(table["n"].to_numpy()[some]), pa.array([np.packbits(hit[bounds[i] : bounds[i + 1]]).tobytes() for i in some], pa.binary())],
            ["sid", "n", "flags"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            while len(batch):
                bucket = batch.column("bucket").to_numpy()
                if held and size >= most and held[-1].column("bucket")[-1].as_py() != bucket[0]:
                    yield from flagged(held)
                    held, size = [], 0
                lengths = pc.binary_length(batch.column("packed")).to_numpy()
                # up to the first change of bucket after enough bytes
                sums = size + np.cumsum(lengths)
                new = np.flatnonzero((bucket[1:] != bucket[:-1]) & (sums[:-1] >= most))
                n = int(new[0]) + 1 if len(new) else len(batch)
                held.append(batch.slice(0, n))
                size = int(sums[n - 1])
                batch = pa.RecordBatch.from_arrays([c.take(pa.array(np.arange(n, len(batch)))) for c in batch.columns], schema=batch.schema)
        if held:
            yield from flagged(held)

    return run


def single_windows(window: int):
    """Rows (sid, windows, place, wid, n) of rows (sid, packed, n): the digest of each window of the string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, powers = white_words(), Powers()
        for batch in batches:
            for block in blocks(batch.column("packed"), classes, powers):
                sid, n = batch.column("sid").slice(block.first, block.n), batch.column("n").slice(block.first, block.n)
                first = np.flatnonzero(block.room() >= window)
                text = block.text_of_word()[first]
                low, high = block.starts[first], block.stops[first + window - 1]
                wid = [hashlib.sha256(block.data[a:b]).digest()[:16] for a, b in zip(low, high, strict=True)]
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [sid.take(at), pa.array((block.counts - window + 1)[text].astype(np.int32)), pa.array((first - block.bounds[text]).astype(np.int32)), pa.array(wid, pa.binary()), n.take(at)],
                    ["sid", "windows", "place", "wid", "n"],
                )

    return run


def packed_flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sid, n, flags) of rows (sid, n, windows, places)."""
    for batch in batches:
        flags = []
        for windows, places in zip(batch.column("windows").to_pylist(), batch.column("places"), strict=True):
            marks = np.zeros(windows, bool)
            marks[places.values.to_numpy()] = True
            flags.append(np.packbits(marks).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("sid"), batch.column("n"), pa.array(flags, pa.binary())], ["sid", "n", "flags"])


def flags_by_window(strings: DataFrame, scratch: Scratch, window: int) -> DataFrame:
    """As ``count_windows``, of rows (sid, packed, n) in any order."""
    single = scratch.write(strings.mapInArrow(single_windows(window), "sid binary, windows int, place int, wid binary, n long"), "single-windows")
    times = single.groupBy("wid").agg(F.sum("n").alias("times"), F.count("*").alias("rows")).where("times > 1")
    hit = hot_join(single, times, ["wid"], "rows", single.count())
    places = hit.groupBy("sid", "n", "windows").agg(F.collect_list("place").alias("places"))
    return places.mapInArrow(packed_flags, "sid binary, n long, flags binary")


def resolve(window: int, with_text: bool):
    """Rows (row_id, doc_id, n_words, body, parts): words left after the removal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(len(batch)):
                body, n = batch.column("body")[i].as_py(), batch.column("n_words")[i].as_py()
                marks = np.zeros(n + 1, np.int64)
                for part in batch.column("parts")[i].as_py() or ():
                    hit = np.flatnonzero(np.unpackbits(np.frombuffer(part["flags"], np.uint8), count=part["windows"])) + part["first"]
                    np.add.at(marks, hit, 1)
                    np.subtract.at(marks, hit + window, 1)
                gone = np.cumsum(marks[:-1]) > 0
                words = body.split(b" ") if body else []
                left = b" ".join(w for w, x in zip(words, gone.tolist(), strict=True) if not x)
                out.append((int(gone.sum()), hashlib.sha256(left).hexdigest(), left))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), *([pa.array([x[2].decode() for x in out], pa.string())] if with_text else [])],
                ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text],
            )

    return run


def without_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, core: int = 8, with_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept) for each row: each word is
    removed that a window covers whose words start anywhere else too; kept is
    what is left, joined by single spaces (not carried without ``with_text``)."""
    scratch = Scratch(spark, "substring")
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    counts = rows.select("text").mapInArrow(count_minimisers(window, core), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = scratch.write(counts.where("n > 1"), "minimisers")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    least = max(FREQUENT, int(total * FREQUENT_SHARE))
    frequent = counts.where(F.col("n") > least).select("h").toArrow()["h"].to_numpy().astype(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast((repeated_bits(counts), frequent))
    scratch.drop("minimisers")
    passed = scratch.write(rows.mapInArrow(cut(window, core, shared, with_text), _PASS_SQL), "cut", "kind")
    pieces = passed.where("kind = 2").withColumn("sid", F.unhex(F.sha2("packed", 256)))
    large = scratch.write(pieces.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > HELD).select("bucket"), "large-buckets")
    side = sized(large)
    strings = pieces.join(side, "bucket", "left_anti").groupBy("bucket", "sid", "packed").agg(F.count("*").alias("n"))
    flags = strings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count_windows(window), "sid binary, n long, flags binary")
    many = pieces.join(side, "bucket", "left_semi").groupBy("sid", "packed").agg(F.count("*").alias("n"))
    flags = scratch.write(flags.unionByName(flags_by_window(many, scratch, window)), "flags")
    n_pieces = passed.where("kind = 2").count()
    parts = hot_join(pieces.select("row_id", "first", "windows", "sid"), flags, ["sid"], "n", n_pieces)
    parts = parts.groupBy("row_id").agg(F.collect_list(F.struct("first", "windows", "flags")).alias("parts"))
    open_ = passed.where("kind = 1").select("row_id", "doc_id", "n_words", "body").join(parts, "row_id", "left")
    done = passed.where("kind = 0").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), *[F.col("body").cast("string").alias("kept")] * with_text)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return done.unionByName(open_.mapInArrow(resolve(window, with_text), schema)).withColumnRenamed("doc_id", id_col)
