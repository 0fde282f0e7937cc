import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomstrand.functions import sequences as S
from loomstrand.functions import wide as W
from loomstrand.operators import kmers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_reverse_complement(spark):
    assert one(spark, S.reverse_complement(F.lit("TGTCGCGTGTTTTGGATGA"), strict=True)) == "TCATCCAAAACACGCGACA"
    assert one(spark, S.reverse_complement(F.lit("ACNT"))) == "ANGT"
    with pytest.raises(PySparkException):
        one(spark, S.reverse_complement(F.lit("ACNT"), strict=True))
    with pytest.raises(PySparkException):
        one(spark, S.complement(F.lit("N")))


@pytest.mark.parametrize("k", [3, 4, 5, 6])
@pytest.mark.parametrize("seq", ["ACGTACGTTGCA", "AAAAAAAAAAAC"])
def test_indices_round_trip(spark, k, seq):
    assert one(spark, S.from_indices(S.kmer_indices(F.lit(seq), k), k)) == seq


def test_indices_that_do_not_overlap(spark):
    with pytest.raises(PySparkException):
        one(spark, S.from_indices(F.array(F.lit(0), F.lit(255)), 4))


def test_codes(spark):
    assert one(spark, S.codes(F.lit("ACGTNa"))) == [0, 1, 2, 3, 4, 4]
    assert one(spark, S.from_codes(F.array(*[F.lit(i) for i in (0, 1, 2, 3, 4)]))) == "ACGTN"
    assert one(spark, S.encode(F.lit("AcGx"))) == "ANGN"


def test_reverse_numbers(spark):
    rows = {r["kmer_index"]: r["r"] for r in S.kmer_table(spark).select("kmer_index", S.reverse_index("kmer_index").alias("r")).collect()}
    assert len(rows) == 256 and rows[97] == 182 and rows[0] == 255 and rows[27] == 27
    assert all(rows[rows[i]] == i for i in rows)


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


@pytest.mark.parametrize("by", [0, 1, 3, 63, 64, 65, 100, 127, 128, -1, -3, -63, -64, -65, -127, -128])
def test_wide_shift(spark, by):
    x = (0xDEADBEEF01234567 << 64) | 0x89ABCDEFFEDCBA98
    row = one(spark, W.shift(W.make(signed(x >> 64), signed(x & (1 << 64) - 1)), by))
    got = ((row["hi"] % (1 << 64)) << 64) | (row["lo"] % (1 << 64))
    assert got == ((x << by) & ((1 << 128) - 1) if by >= 0 else x >> -by)


def test_wide_parts(spark):
    x = (0x1234 << 64) | 0x8000000000000001
    key = W.make(0x1234, signed(0x8000000000000001))
    row = one(spark, W.extract(key, 60, 10))
    assert row["lo"] == (x >> 60) & 1023 and row["hi"] == 0
    assert one(spark, W.bits(key)) == f"{x:0128b}"
    assert one(spark, W.is_zero(W.differing(key, key)))
    assert one(spark, W.bits(W.prefix_mask(2))) == f"{0b111111 << 117:0128b}"
    assert one(spark, W.order(W.make(0, -1)) > W.order(W.make(0, 1)))


def test_tv_and_weights(spark):
    a, b = F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(0.0), F.lit(1.0))
    assert one(spark, S.total_variation(a, b)) == 0.5
    assert one(spark, S.log_weight(F.lit(0.25))) == 0.0
    assert one(spark, S.log_weight(F.lit(0.0))) == -4.0


def test_context_digests(spark, monkeypatch):
    """The digest of a row for each base, without making any."""
    monkeypatch.setattr(kmers, "STEPS", 7)
    rows = [("a", "ACGTNACGGT" * 9), ("b", "ACG"), ("twice", "ACGTTGCA"), ("twice", "CCGT"), ("empty", ""), ("none", None), ("wide", "AC\u00e9GT"), ("edge", "ACGTACGTA"), (None, "GATTACA")]
    contigs = spark.createDataFrame(rows, "contig_id string, seq string")
    steps = F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(">", "context", "base").alias("step"))))
    for depth in (3, 8, 40):
        want = kmers.contexts(contigs, depth).groupBy("contig_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(steps, lambda x: x["step"]), ",")).alias("steps_md5"))
        found = kmers.context_digests(contigs, depth)
        assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
