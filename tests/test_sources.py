import pytest
from pyspark.errors import PySparkException

from loomstrand.sources import fasta, sinks, tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_fasta(spark, tmp_path):
    p = tmp_path / "a.fasta"
    p.write_text(">id1 more > words\nACGT\n\n;note\nAC\n>id2 x\nTT\n>id3\n>id4 y\nGG\n")
    assert rows(fasta.read_fasta(spark, str(p))) == [("id1", "ACGTAC"), ("id2", "TT"), ("id4", "GG")]
    assert rows(fasta.read_fasta(spark, str(p), id_chars=2)) == [("id", "ACGTAC"), ("id", "GG"), ("id", "TT")]


def test_peptides_longest_wins(spark, tmp_path):
    p = tmp_path / "a.pep"
    p.write_text(">x y id1:0-100(-)\nMMM\n>x id1:101-120(+)\nMM\n>x id2:11-12(+)\nM\n>x id3:0-5(+)\n>x id3:5-10(-)\n")
    assert rows(fasta.read_peptides(spark, str(p))) == [("id1", False), ("id2", True), ("id3", False)]
    p.write_text(">x id1 0-100\n")
    with pytest.raises(PySparkException, match="malformed peptide header"):
        fasta.read_peptides(spark, str(p)).collect()


def test_normalised(spark):
    contigs = spark.createDataFrame([("id1", "AACG"), ("id2", "TTT"), ("id3", "A")], "contig_id string, seq string")
    orient = spark.createDataFrame([("id1", False), ("id2", True)], "contig_id string, forward boolean")
    assert rows(fasta.normalised(contigs, orient, "AA")) == [("AAid1", "CGTT"), ("AAid2", "TTT")]
    assert rows(fasta.kept_and_skipped(contigs, orient)) == [(2, 1)]
    assert rows(fasta.tagged(contigs, orient, "AA")) == [("AAid1", "AACG", 4, True), ("AAid2", "TTT", 3, False)]


def test_two_columns(spark, tmp_path):
    (tmp_path / "a").write_text("l1 ACG\nl2 TTx\nl1 GGG\n")
    assert rows(fasta.read_two_columns(spark, str(tmp_path / "a"))) == [("l1", "ACG"), ("l2", "TTx")]
    assert rows(fasta.read_two_columns(spark, str(tmp_path / "a"), keep_first=False)) == [("l1", "ACG"), ("l1", "GGG"), ("l2", "TTN")]


def test_tables(spark, tmp_path):
    (tmp_path / "m").write_text("q1 t1 99.5 120 x\nq1\tt2 98 80\n")
    assert [tuple(r)[1:] for r in tables.read_matches(spark, str(tmp_path / "m")).orderBy("line").collect()] == [("q1", "t1", 99.5, 120), ("q1", "t2", 98.0, 80)]
    (tmp_path / "h").write_text("\t".join(["q1.p1", "hit", *"123456789", "55.5"]) + "\n")
    assert tuple(tables.read_hits(spark, str(tmp_path / "h")).first())[1:] == ("q1", "hit", 55.5)
    (tmp_path / "t").write_text("id Haptophyta Rhizaria\nc1 0 3\nc1 1 0\nc2 2 2\n")
    assert {r["contig_id"]: r["counts"] for r in tables.read_taxa(spark, str(tmp_path / "t")).collect()} == {"c1": {"Haptophyta": 1, "Rhizaria": 0}, "c2": {"Haptophyta": 2, "Rhizaria": 2}}


def test_settings(tmp_path):
    (tmp_path / "a").write_text("# c\nk: 4\nflag: false\nt:\n  - 0.1\n  - 0.2\nname: x\n")
    (tmp_path / "b").write_text("k: 5\n")
    (tmp_path / "c").write_text("k: 6\n")
    files = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert tables.settings(files) == {"k": 5, "flag": False, "t": [0.1, 0.2], "name": "x"}
    assert tables.settings(files, extra=str(tmp_path / "c"))["k"] == 6
    got = tables.settings(files, ["--k", "7", "--flag", "--t", "1", "2.5"], str(tmp_path / "c"))
    assert got["k"] == 7 and got["flag"] is True and got["t"] == [1, 2.5]
    assert tables.settings(files, ["--no-flag"])["flag"] is False


def test_old_layouts(spark, tmp_path):
    (tmp_path / "hits").write_text(f"{'c1':<25}{99.25:8.2f}\n")
    assert rows(fasta.read_fixed_hits(spark, str(tmp_path / "hits"))) == [("c1", 99.25)]
    (tmp_path / "restart").write_text(f"{'c1':<25}  3  1\n{'c2':<25} 12  0\n")
    assert rows(fasta.read_restart(spark, str(tmp_path / "restart"))) == [(0, 3, 1), (1, 12, 0)]
    state = spark.createDataFrame([("c1", 3, True, -1.5)], "contig_id string, cluster int, reverse boolean, score double")
    assert sinks.fixed_lines(state).first()["value"] == f"{'c1':<25}  3  1{-1.5:11.2f}"


def test_organisms(spark, tmp_path):
    for n in ("02_b.fa", "01_a.fa", "03_c.fa"):
        (tmp_path / n).write_text("")
    orgs = fasta.organisms(spark, str(tmp_path))
    assert rows(orgs) == [(0, "01_a.fa", "01_"), (1, "02_b.fa", "02_"), (2, "03_c.fa", "03_")]
    assert rows(fasta.organism_pairs(orgs)) == [(0, 1), (0, 2), (1, 2)]


def test_token_files(spark, tmp_path):
    contigs = spark.createDataFrame([(f"c{i}", "ACGTACGT") for i in range(50)], "contig_id string, seq string")
    sinks.write_tokens(contigs, str(tmp_path / "t"), share=0.5)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 50 and {r["split"] for r in back.select("split").distinct().collect()} == {"train", "val"}
    assert back.first()["n_tokens"] == 5
