"""k-mer features of contigs (contig_id, seq): sparse tables and dense profiles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import K, kmers, reverse_index


def kmer_counts(contigs: DataFrame, k: int = K) -> DataFrame:
    """(contig_id, kmer, n): windows with an unknown base are left out."""
    return contigs.select("contig_id", F.explode(kmers("seq", k)).alias("kmer")).groupBy("contig_id", "kmer").agg(F.count("*").alias("n"))


def kmer_shares(counts: DataFrame) -> DataFrame:
    """counts with p: the share of the contig's windows."""
    totals = counts.groupBy("contig_id").agg(F.sum("n").alias("total"))
    return counts.join(totals, "contig_id").withColumn("p", F.col("n") / F.col("total"))


def _counted(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(256, 4, np.int64)
        table[[65, 67, 71, 84]] = range(4)
        for batch in batches:
            out = np.zeros((len(batch), 4**k), np.int64)
            for i, seq in enumerate(batch.column(1)):
                code = table[np.frombuffer(seq.as_buffer() or b"", np.uint8)] if seq.is_valid else np.zeros(0, np.int64)
                if len(code) < k:
                    continue
                n = len(code) - k + 1
                number, known = code[:n].copy(), None
                for j in range(1, k):
                    number = number * 4 + code[j : j + n]
                if code.max() > 3:
                    known = np.lib.stride_tricks.sliding_window_view(code < 4, k).all(1)
                out[i] = np.bincount(number if known is None else number[known], minlength=4**k)
            counts = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), 4**k).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, *batch.columns[2:]], ["contig_id", "counts", *batch.schema.names[2:]])

    return run


def profiles(contigs: DataFrame, k: int = K, *more: str) -> DataFrame:
    """(contig_id, counts, more): the counts of all 4**k k-mers in order, where the row is; nothing is shuffled."""
    kind = lambda c: contigs.schema[c].dataType.simpleString()
    return contigs.select("contig_id", "seq", *more).mapInArrow(_counted(k), ", ".join([f"contig_id {kind('contig_id')}", "counts array<long>", *[f"`{c}` {kind(c)}" for c in more]]))


def shares(counts: str | Column = "counts") -> Column:
    """Counts as shares of their sum; all zero where the sum is."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    # the sum is bound once, else it would be taken again for each count
    return F.get(F.transform(F.array(total), lambda t: F.transform(counts, lambda x: F.when(t > 0, x / t).otherwise(0.0))), F.lit(0))


def reversed_profile(counts: str | Column = "counts", k: int = K) -> Column:
    """The profile of the reverse complement."""
    order = F.array(*[F.lit(_reverse_number(i, k)) for i in range(4**k)])
    source = F.col(counts) if isinstance(counts, str) else counts
    return F.transform(order, lambda i: F.get(source, i))


def _reverse_number(i: int, k: int) -> int:
    out = 0
    for _ in range(k):
        out, i = out * 4 + 3 - i % 4, i // 4
    return out


def reverse_numbers(counts: DataFrame, k: int = K) -> DataFrame:
    """(kmer_index, reverse_index) of the k-mers of a frame with kmer_index."""
    return counts.select("kmer_index", reverse_index("kmer_index", k).alias("reverse_index"))


def contexts(contigs: DataFrame, depth: int) -> DataFrame:
    """(contig_id, pos, base, context): the ``depth`` bases before each base, the last one first; fewer near the start."""
    at = F.posexplode(F.filter(F.split("seq", ""), lambda c: c != "")).alias("pos", "base")
    rows = contigs.select("contig_id", "seq", at)
    before = F.expr(f"reverse(substring(seq, greatest(pos - {depth} + 1, 1), least(pos, {depth})))")
    return rows.select("contig_id", "pos", "base", before.alias("context"))


#: Steps of a digest that are written out together.
STEPS = 20_000


def _digested(seqs: list[str], depth: int) -> tuple[int, str]:
    """How many steps ``context>base`` the sequences have, and the MD5 of all by (pos, step), comma-joined."""
    if len(seqs) > 1 or not seqs[0].isascii():
        steps = [step for _, step in sorted((i, f"{seq[max(0, i - depth) : i][::-1]}>{base}") for seq in seqs for i, base in enumerate(seq))]
        return len(steps), hashlib.md5(",".join(steps).encode()).hexdigest()
    (seq,) = seqs
    out = hashlib.md5(",".join(f"{seq[:i][::-1]}>{base}" for i, base in enumerate(seq[:depth])).encode())
    code = np.frombuffer(seq.encode(), np.uint8)
    for low in range(depth, len(code), STEPS):
        n = min(STEPS, len(code) - low)
        lines = np.empty((n, depth + 3), np.uint8)
        lines[:, 0], lines[:, depth + 1] = ord(","), ord(">")
        for back in range(1, depth + 1):
            lines[:, back] = code[low - back : low - back + n]
        lines[:, depth + 2] = code[low : low + n]
        out.update(lines.data)
    return len(code), out.hexdigest()


def context_digests(contigs: DataFrame, depth: int) -> DataFrame:
    """(contig_id, n, steps_md5) of what ``contexts`` gives for each contig, its steps ``context>base`` in order of pos.

    Steps are written and digested where the sequence is, STEPS at a time: no row a base is made.
    """
    kind = contigs.schema["contig_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [[x for x in some if x] for some in batch.column(1).to_pylist()]
            at = [i for i, some in enumerate(seqs) if some]
            found = [_digested(seqs[i], depth) for i in at]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string())], ["contig_id", "n", "steps_md5"])

    return contigs.groupBy("contig_id").agg(F.collect_list("seq").alias("seqs")).mapInArrow(run, f"contig_id {kind}, n long, steps_md5 string")
