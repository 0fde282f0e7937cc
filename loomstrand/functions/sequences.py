"""Column functions over nucleotide sequences.

Strict functions raise an error for a base outside ACGT; the others treat any
other character, lower case included, as the unknown base N.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASES, PAIRS = "ACGT", "TGCA"
K = 4
#: Contexts weigh at least this probability; fixed value.
FLOOR = 1 / 64


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def encode(seq: str | Column) -> Column:
    """Every character outside ACGT as N."""
    return F.regexp_replace(_col(seq), "[^ACGT]", "N")


def codes(seq: str | Column) -> Column:
    """Array of 0 to 3 for A, C, G, T and 4 for anything else."""
    return F.transform(F.filter(F.split(_col(seq), ""), lambda c: c != ""), lambda c: F.coalesce(F.nullif(F.instr(F.lit(BASES), c), F.lit(0)), F.lit(5)) - 1)


def from_codes(values: str | Column) -> Column:
    """The sequence of an array of codes; 4 gives N."""
    return F.array_join(F.transform(_col(values), lambda c: F.substring(F.lit(BASES + "N"), c + 1, F.lit(1))), "")


def complement(base: str | Column) -> Column:
    """The complement of one base; an error for any other character."""
    base = _col(base)
    return F.when(base.rlike("^[ACGT]$"), F.translate(base, BASES, PAIRS)).otherwise(F.raise_error(F.concat(F.lit("not a base: "), F.coalesce(base, F.lit("null")))))


def reverse_complement(seq: str | Column, strict: bool = False) -> Column:
    seq = _col(seq)
    out = F.translate(F.reverse(seq), BASES, PAIRS)
    if not strict:
        return out
    return F.when(seq.rlike("^[ACGT]*$"), out).otherwise(F.raise_error(F.concat(F.lit("not only bases: "), F.substring(seq, 1, 40))))


def oriented(seq: str | Column, reverse: str | Column) -> Column:
    """The sequence in its reading direction."""
    return F.when(_col(reverse), reverse_complement(seq)).otherwise(_col(seq))


def kmers(seq: str | Column, k: int = K) -> Column:
    """All windows of k known bases, in order; windows with N are left out."""
    return F.regexp_extract_all(_col(seq), F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))


def kmer_index(kmer: str | Column) -> Column:
    """Number of a k-mer, first base highest, A < C < G < T."""
    return F.conv(F.translate(_col(kmer), BASES, "0123"), 4, 10).cast("int")


def index_kmer(index: str | Column, k: int = K) -> Column:
    return F.translate(F.lpad(F.conv(_col(index).cast("string"), 10, 4), k, "0"), "0123", BASES)


def kmer_indices(seq: str | Column, k: int = K) -> Column:
    return F.transform(kmers(seq, k), kmer_index)


def reverse_index(index: str | Column, k: int = K) -> Column:
    """Number of the k-mer's reverse complement."""
    return kmer_index(reverse_complement(index_kmer(index, k)))


def from_indices(indices: str | Column, k: int = K) -> Column:
    """The sequence whose windows have these numbers; an error if neighbours don't overlap in k - 1 bases."""

    def joined(windows: Column) -> Column:
        fits = F.forall(F.sequence(F.lit(1), F.greatest(F.size(windows) - 1, F.lit(1))), lambda i: F.coalesce(F.get(windows, i).isNull() | (F.substring(F.get(windows, i - 1), 2, k - 1) == F.substring(F.get(windows, i), 1, k - 1)), F.lit(True)))
        ends = F.transform(F.slice(windows, 2, F.greatest(F.size(windows) - 1, F.lit(0))), lambda w: F.substring(w, k, 1))
        out = F.concat(F.coalesce(F.get(windows, F.lit(0)), F.lit("")), F.array_join(ends, ""))
        return F.when(fits, out).otherwise(F.raise_error(F.lit("neighbouring k-mers do not overlap")))

    # bound once: a plain column would be computed again for each element
    return F.get(F.transform(F.array(F.transform(_col(indices), lambda i: index_kmer(i, k))), joined), F.lit(0))


def kmer_table(spark: SparkSession, k: int = K) -> DataFrame:
    """(kmer_index, kmer) of all 4**k k-mers."""
    return spark.range(4**k).select(F.col("id").cast("int").alias("kmer_index"), index_kmer("id", k).alias("kmer"))


def log_weight(p: str | Column) -> Column:
    """Bits by which a base of probability p is likelier than by chance, p no less than FLOOR."""
    return F.log2(4 * F.greatest(_col(p), F.lit(FLOOR)))


def organism(label: str | Column, prefix: int = 2) -> Column:
    return F.substring(_col(label), 1, prefix)


def total_variation(a: str | Column, b: str | Column) -> Column:
    """Half the L1 distance of two arrays of equal length."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / 2


def pseudo_sequence(text: str | Column, unknown: bool = False) -> Column:
    """A deterministic sequence from text: its ASCII letters in turn stand for
    A, C, G, T; with ``unknown`` all other characters are kept as N."""
    letters = F.lower(F.regexp_replace(_col(text), "[^A-Za-z]", "!" if unknown else ""))
    return F.translate(letters, "abcdefghijklmnopqrstuvwxyz!", "ACGTACGTACGTACGTACGTACGTACN")
