"""The engine's operators as queries over the test tables, with independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import sequences as S
from .functions import wide as W
from .operators import bins as B
from .operators import clusters as C
from .operators import contexts as X
from .operators import distances as D
from .operators import grading as G
from .operators import kmers as M
from .plans import binnings as P
from .scratch import Scratch
from .sources import fasta, sinks, tables


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _contigs(spark: SparkSession, sf_dir: str, unknown: bool = False) -> DataFrame:
    return P.contigs_of(_table(spark, sf_dir, "documents"), unknown)


def _orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contig_id, forward): labels stand for peptides; a contig without a label has no orientation."""
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")
    return rows.select(F.concat_ws("_", F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string")).alias("contig_id"), (F.col("toxic") == 0).alias("forward"))


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without a negative zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _selected_shares(spark: SparkSession, sf_dir: str) -> tuple[Scratch, DataFrame, DataFrame]:
    """Scratch, the length selection and its shares."""
    scratch = Scratch(spark, "query")
    contigs = scratch.write(P.spread(P.lettered(_table(spark, sf_dir, "documents"))), "contigs")
    selection = scratch.write(B.percentile_selection(contigs), "selection")
    own = M.profiles(contigs.join(selection.select("contig_id"), "contig_id", "left_semi")).select("contig_id", M.shares("counts").alias("p"))
    return scratch, selection, scratch.write(own, "shares")


def _selected(spark: SparkSession, sf_dir: str, below: float | None = None) -> tuple[Scratch, DataFrame, DataFrame, DataFrame]:
    """Scratch, the length selection, its shares and its pairs, all or those under ``below``."""
    scratch, selection, own = _selected_shares(spark, sf_dir)
    return scratch, selection, own, D.variation_pairs(own, below)


def pair_counts(spark, sf_dir):
    _, _, _, close = _selected(spark, sf_dir, 0.1)
    labels = [S.organism("a"), S.organism("b")]
    return close.groupBy(F.least(*labels).alias("org"), F.greatest(*labels).alias("other")).agg(F.count("*").alias("n_pairs"))


def fasta_scan(spark, sf_dir):
    scratch = Scratch(spark, "fasta")
    fasta.write_fasta(_contigs(spark, sf_dir).where("len > 0"), scratch.path("contigs.fasta"))
    rows = fasta.read_fasta(spark, scratch.path("contigs.fasta"))
    return rows.select("contig_id", F.length("seq").alias("len"), F.md5("seq").alias("seq_md5"))


def two_column_scan(spark, sf_dir):
    scratch = Scratch(spark, "columns")
    sinks.write_two_columns(_contigs(spark, sf_dir).where("len > 0"), scratch.path("contigs.txt"))
    return fasta.read_two_columns(spark, scratch.path("contigs.txt")).select("contig_id", F.md5("seq").alias("seq_md5"))


def encoded_scan(spark, sf_dir):
    """Every label twice in the file, with unknown bases; this reader keeps both rows."""
    scratch = Scratch(spark, "encoded")
    rows = _contigs(spark, sf_dir, unknown=True).where("len > 0").select("contig_id", "seq")
    sinks.write_two_columns(rows.unionByName(rows.withColumn("seq", F.reverse("seq"))), scratch.path("contigs.txt"))
    return fasta.read_two_columns(spark, scratch.path("contigs.txt"), keep_first=False).select("contig_id", F.md5("seq").alias("seq_md5"))


def old_fasta_scan(spark, sf_dir):
    scratch = Scratch(spark, "old-fasta")
    rows = _contigs(spark, sf_dir).where("len > 0")
    fasta.write_fasta(rows.withColumn("contig_id", F.concat(F.lit("a_name_of_many_letters_"), "contig_id", F.lit(" more"))), scratch.path("contigs.fasta"), 100)
    return fasta.read_old_fasta(spark, scratch.path("contigs.fasta")).select("contig_id", F.md5("seq").alias("seq_md5"))


def _one_file(lines: DataFrame, path: str) -> str:
    """Write the values of (line, value) as one file, in order of line."""
    lines.coalesce(1).sortWithinPartitions("line").select("value").write.text(path)
    return path


def fixed_hit_scan(spark, sf_dir):
    scratch, p = Scratch(spark, "fixed"), _table(spark, sf_dir, "part")
    p.select(F.format_string("%-25s%8.2f", F.concat(F.lit("p"), "p_partkey"), F.col("p_partkey") / 7).alias("value")).write.text(scratch.path("hits.txt"))
    return fasta.read_fixed_hits(spark, scratch.path("hits.txt"))


def restart_scan(spark, sf_dir):
    scratch, p = Scratch(spark, "restart"), _table(spark, sf_dir, "part")
    value = F.format_string("%-25s%3d%3d", F.concat(F.lit("p"), "p_partkey"), F.col("p_partkey") % 40, F.col("p_partkey") % 2)
    return fasta.read_restart(spark, _one_file(p.select(F.col("p_partkey").alias("line"), value.alias("value")), scratch.path("restart.txt")))


def file_catalog(spark, sf_dir):
    """One file or folder of contigs for each organism."""
    scratch = Scratch(spark, "catalog")
    rows = _contigs(spark, sf_dir).select(S.organism("contig_id").alias("org"), F.concat_ws(" ", "contig_id", "seq").alias("value"))
    rows.write.partitionBy("org").text(scratch.path("organisms"))
    return fasta.organisms(spark, scratch.path("organisms"), 7)


def united_organisms(spark, sf_dir):
    """Contigs as read, and the same names turned around from another source, which wins."""
    rows = _contigs(spark, sf_dir).select("contig_id", "seq")
    turned = rows.where(S.organism("contig_id") == "en").withColumn("seq", S.reverse_complement("seq"))
    return fasta.united(rows, turned, last_wins=True).select("contig_id", F.md5("seq").alias("seq_md5"))


def peptide_orientation(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    head = F.format_string(">p%d data c%d:%d-%d(%s)", "doc_id", F.col("doc_id") % 40, F.lit(10), F.lit(10) + F.col("n_chars") % 200, F.when(F.col("doc_id") % 3 == 0, "+").otherwise("-"))
    return fasta.peptide_orientation(docs.select(head.alias("value"), F.col("doc_id").alias("line")))


def normalised_contigs(spark, sf_dir):
    rows = fasta.normalised(_contigs(spark, sf_dir), _orientation(spark, sf_dir), "x_")
    return rows.select("contig_id", F.md5("seq").alias("seq_md5"))


def tagged_contigs(spark, sf_dir):
    rows = fasta.tagged(_contigs(spark, sf_dir, unknown=True), _orientation(spark, sf_dir), "x_")
    return rows.select("contig_id", "len", "reverse", F.md5(S.oriented("seq", "reverse")).alias("oriented_md5"))


def kept_and_skipped(spark, sf_dir):
    return fasta.kept_and_skipped(_contigs(spark, sf_dir), _orientation(spark, sf_dir))


def kmer_counts(spark, sf_dir):
    return M.kmer_counts(P.spread(_contigs(spark, sf_dir, unknown=True)))


def kmer_shares(spark, sf_dir):
    return _round(M.kmer_shares(M.kmer_counts(P.spread(_contigs(spark, sf_dir)))).select("contig_id", "kmer", "p"))


def kmer_profiles(spark, sf_dir):
    rows = M.profiles(P.spread(_contigs(spark, sf_dir)))
    return rows.select("contig_id", F.posexplode("counts").alias("kmer_index", "n")).where("n > 0")


def kmer_dictionary(spark, sf_dir):
    return S.kmer_table(spark).withColumn("reverse_index", S.reverse_index("kmer_index"))


def sequence_round_trips(spark, sf_dir):
    rows = P.spread(_contigs(spark, sf_dir)).where("len >= 4")
    return rows.select("contig_id", F.md5(S.reverse_complement("seq", strict=True)).alias("reverse_md5"), F.md5(S.from_indices(S.kmer_indices("seq"))).alias("indices_md5"), F.md5(S.from_codes(S.codes("seq"))).alias("codes_md5"), S.complement(F.substring("seq", 1, 1)).alias("first_complement"))


def wide_keys(spark, sf_dir):
    x = W.make(F.col("event_id"), F.col("event_id") * 7919 + 13)
    rows = _table(spark, sf_dir, "events").select("event_id", x.alias("x"))
    shifted = W.differing(W.shift(F.col("x"), 70), W.shift(F.col("x"), -3))
    return rows.select("event_id", W.bits(shifted).alias("mixed_bits"), W.bits(W.extract(F.col("x"), 3, 66)).alias("part_bits"), W.is_zero(W.both(F.col("x"), W.prefix_mask(20))).alias("no_head"), W.bits(W.either(F.col("x"), W.make(0, 1))).alias("odd_bits"))


def key_ranks(spark, sf_dir):
    key = W.make(F.col("user_id"), -F.col("event_id"))
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", W.order(key).alias("key"))
    return rows.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("key")).alias("place"))


def key_lookup(spark, sf_dir):
    """Places of 128-bit keys, half of which the table lacks."""
    rows = _table(spark, sf_dir, "events").select("event_id", W.make(F.col("user_id"), F.col("event_id")).alias("key"))
    keys = _table(spark, sf_dir, "events").select(W.make(F.col("user_id"), F.col("event_id") * 2).alias("key"), F.col("event_id").alias("place"))
    return W.looked_up(rows, keys).select("event_id", "place")


def length_selection(spark, sf_dir):
    return B.percentile_selection(_contigs(spark, sf_dir))


def length_probe(spark, sf_dir):
    return G.length_probe(_contigs(spark, sf_dir))


def length_stats(spark, sf_dir):
    return _round(G.length_stats(_contigs(spark, sf_dir)), 4)


def length_thresholds(spark, sf_dir):
    found = G.length_thresholds(_contigs(spark, sf_dir))
    return spark.createDataFrame(list(enumerate(found)), "step int, least int")


def variation_pairs(spark, sf_dir):
    return D.every_variation(_selected_shares(spark, sf_dir)[2], 6)


def sparse_variation_pairs(spark, sf_dir):
    scratch, selection, _, _ = _selected(spark, sf_dir)
    contigs = _contigs(spark, sf_dir).join(selection.select("contig_id"), "contig_id", "left_semi")
    return _round(D.sparse_variation_pairs(scratch.write(M.kmer_shares(M.kmer_counts(contigs)), "sparse")))


def distance_stats(spark, sf_dir):
    _, selection, _, pairs = _selected(spark, sf_dir)
    return _round(D.distance_stats(D.full_matrix(pairs, selection)))


def organism_stats(spark, sf_dir):
    return _round(D.organism_stats(_selected(spark, sf_dir)[3]))


def share_below_cross(spark, sf_dir):
    return _round(D.share_below_cross_of(_selected(spark, sf_dir)[2]))


def created_bins(spark, sf_dir):
    scratch, selection, _, close = _selected(spark, sf_dir, 0.1)
    return B.created(scratch, selection, close.select("a", "b"))


def nearest_bins(spark, sf_dir):
    scratch, selection, _, pairs = _selected(spark, sf_dir)
    pairs = scratch.write(pairs, "pairs")
    first = scratch.write(B.created(scratch, selection, pairs.where("dist < 0.1").select("a", "b")), "first")
    return B.with_nearest(selection, pairs, first)


def _language_bins(rows: DataFrame) -> DataFrame:
    """(contig_id, bin): one bin a language prefix, numbered by name."""
    label = rows.select("contig_id", S.organism("contig_id").alias("label"))
    names = label.select("label").distinct().withColumn("bin", F.row_number().over(Window.orderBy("label")))
    return label.join(F.broadcast(names), "label").select("contig_id", "bin")


def bin_medians(spark, sf_dir):
    _, _, own, _ = _selected(spark, sf_dir)
    rows = B.medians(_language_bins(own), own)
    return _round(rows.select("bin", F.posexplode("p").alias("kmer_index", "p")))


def merge_links(spark, sf_dir):
    _, _, own, _ = _selected(spark, sf_dir)
    return _round(B.merge_links(_language_bins(own), own, 0.6))


def nearest_median(spark, sf_dir):
    scratch, _, own, _ = _selected(spark, sf_dir)
    contigs = P.spread(_contigs(spark, sf_dir))
    all_ = scratch.write(M.profiles(contigs).select("contig_id", M.shares("counts").alias("p")), "all-shares")
    return _round(B.nearest_median(_language_bins(own), all_.select("contig_id"), all_))


def _source_bins(spark, sf_dir) -> DataFrame:
    """(contig_id, bin): documents binned by source, the larger sources first."""
    rows = _table(spark, sf_dir, "documents").select(F.concat_ws("_", F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string")).alias("contig_id"), F.coalesce("source", F.lit("")).alias("grp"))
    return B.ordered(rows.withColumn("first", F.col("grp")), "first")


def reduced_bins(spark, sf_dir):
    return B.reduced(_source_bins(spark, sf_dir)).groupBy("bin").agg(F.count("*").alias("size"))


def distance_binning(spark, sf_dir):
    bins, unbinned = P.by_distance(spark, P.lettered(_table(spark, sf_dir, "documents")))
    return G.dump(bins, unbinned)


def distance_grade(spark, sf_dir):
    return _round(G.grade(*P.by_distance(spark, P.lettered(_table(spark, sf_dir, "documents")))))


def organism_experiments(spark, sf_dir):
    return _round(P.all_pairs(spark, P.lettered(_table(spark, sf_dir, "documents"))))


def chi_squared_pairs(spark, sf_dir):
    rows = M.profiles(P.spread(_contigs(spark, sf_dir)).where("len >= 3000"))
    return _round(D.chi_squared_pairs(rows, 255.0), 3)


def seed_clusters(spark, sf_dir):
    scratch = Scratch(spark, "seeds")
    return C.seed_clusters(scratch, scratch.write(P.positioned(scratch, _contigs(spark, sf_dir)), "placed"))


def mapped_back(spark, sf_dir):
    contigs = _contigs(spark, sf_dir).select("contig_id", "len")
    return C.mapped_back(contigs, _language_bins(contigs.where("len >= 1000")).withColumnRenamed("bin", "cluster")).select("contig_id", F.col("cluster").cast("int").alias("cluster"))


def placed_back(spark, sf_dir):
    """Clusters by the place among contigs of 1000 bases and more."""
    placed = P.positioned(Scratch(spark, "placed"), _contigs(spark, sf_dir)).select("contig_id", "len", "pos")
    clusters = spark.range(placed.count()).select(F.col("id").alias("place"), (F.col("id") % 9 + 1).cast("int").alias("cluster"))
    return C.placed_back(placed, clusters, 1000).select("contig_id", "cluster")


def seed_directions(spark, sf_dir):
    scratch = Scratch(spark, "seeds")
    state, _ = P.seeded(spark, scratch, _contigs(spark, sf_dir))
    return state.where("cluster > 0").select("contig_id", "cluster", "reverse")


def _state(spark, sf_dir) -> DataFrame:
    """All contigs active in one cluster a language prefix, none turned."""
    contigs = P.spread(_contigs(spark, sf_dir))
    return contigs.join(_language_bins(contigs), "contig_id").select("contig_id", "seq", "len", F.col("bin").alias("cluster"), F.lit(False).alias("reverse"), F.lit(True).alias("active"))


def _models(spark, sf_dir):
    state = Scratch(spark, "state").write(_state(spark, sf_dir), "state")
    return state, X.trained(spark, state.select("contig_id", "seq", "reverse", "cluster"))


def _found(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    state, models = _models(spark, sf_dir)
    return state, Scratch(spark, "found").write(X.scores(spark, state, models), "found")


def context_states(spark, sf_dir):
    _, models = _models(spark, sf_dir)
    return _round(X.states(spark, models))


def context_levels(spark, sf_dir):
    _, models = _models(spark, sf_dir)
    return X.states(spark, models).groupBy("cluster", "level").agg(F.count("*").alias("n_states"), F.sum(F.expr("n_a + n_c + n_g + n_t")).alias("support"))


def context_scores(spark, sf_dir):
    return _round(_found(spark, sf_dir)[1].select("contig_id", "cluster", "score", "squares"), 4)


def strand_scores(spark, sf_dir):
    state, models = _models(spark, sf_dir)
    return _round(X.scores(spark, state, models, both=True).select("contig_id", "cluster", "backward", "score"), 4)


def look_behind(spark, sf_dir):
    """Each contig's bases with up to 40 before them, as one digest."""
    return M.context_digests(P.spread(_contigs(spark, sf_dir)), X.DEPTH)


def score_per_base(spark, sf_dir):
    return _round(C.per_base(*_found(spark, sf_dir)), 4)


def cluster_weakness(spark, sf_dir):
    return _round(C.weakness(*_found(spark, sf_dir)), 4)


def reassignment(spark, sf_dir):
    state, found = _found(spark, sf_dir)
    return C.reassigned(state, found).select("contig_id", "cluster")


def reassignment_counts(spark, sf_dir):
    state, found = _found(spark, sf_dir)
    return C.movement(state, C.reassigned(state, found), found)


def best_strands(spark, sf_dir):
    """One step of the model binning: each contig to its best cluster and strand."""
    state, models = _models(spark, sf_dir)
    found = Scratch(spark, "found").write(X.scores(spark, state, models, both=True), "found")
    return C.best_orientations(state, found).select("contig_id", "cluster", "reverse")


def score_totals(spark, sf_dir):
    return _round(C.score_totals(_found(spark, sf_dir)[1]), 2)


def log_likelihood(spark, sf_dir):
    state, found = _found(spark, sf_dir)
    return _round(spark.createDataFrame([(C.log_likelihood(state, found),)], "log_likelihood double"), 4)


def cull_candidate(spark, sf_dir):
    state, found = _found(spark, sf_dir)
    n = state.agg(F.max("cluster").alias("n")).first()["n"] or 0
    worst, score = C.replaceable(state, found, n)
    return _round(spark.createDataFrame([(worst, score)], "cluster int, score double"), 2)


def score_histogram(spark, sf_dir):
    state, found = _found(spark, sf_dir)
    return G.score_histogram(state, found, C.per_base(state, found))


def score_outliers(spark, sf_dir):
    state, found = _found(spark, sf_dir)
    return G.outliers(state, found, C.per_base(state, found)).select("contig_id", "cluster")


def fixed_lines(spark, sf_dir):
    state, found = _found(spark, sf_dir)
    return sinks.fixed_lines(state.join(found.select("contig_id", "cluster", "score"), ["contig_id", "cluster"]))


def model_binning(spark, sf_dir):
    return P.by_models(spark, _contigs(spark, sf_dir))


def refined_binning(spark, sf_dir):
    state = P.by_both(spark, _contigs(spark, sf_dir))
    return G.dump(*G.bins_of(state.withColumn("cluster", F.col("cluster") + 1), 0))


def dumped_bins(spark, sf_dir):
    bins = _source_bins(spark, sf_dir)
    return G.dump(bins.where("bin <= 10"), bins.where("bin > 10").select("contig_id"))


def bin_purity(spark, sf_dir):
    return _round(G.purity(_source_bins(spark, sf_dir)))


def bin_labels(spark, sf_dir):
    return G.label_counts(_source_bins(spark, sf_dir))


def bin_grade(spark, sf_dir):
    bins = _source_bins(spark, sf_dir)
    return _round(G.grade(bins.where("bin <= 10"), bins.where("bin > 10").select("contig_id")))


def top_bins(spark, sf_dir):
    return _round(G.top_bins(_source_bins(spark, sf_dir)))


def all_pure(spark, sf_dir):
    contigs = _contigs(spark, sf_dir)
    return G.all_pure(_language_bins(contigs)).unionByName(G.all_pure(_source_bins(spark, sf_dir)))


def token_stream(spark, sf_dir):
    rows = sinks.tokens(P.spread(_contigs(spark, sf_dir)))
    return rows.select("split", "contig_id", "n_tokens", F.md5(F.array_join(F.transform("tokens", lambda x: x.cast("string")), ",")).alias("tokens_md5"))


def _match_lines(spark, sf_dir) -> DataFrame:
    """Alignment-like lines from lineitem: query part, target supplier, identity, length."""
    li = _table(spark, sf_dir, "lineitem")
    value = F.concat_ws("  ", F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey"), (F.lit(90) + F.col("l_discount") * 100).cast("decimal(8,2)").cast("string"), (F.col("l_quantity") * 4).cast("int").cast("string"), F.lit("more"))
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), value.alias("value"))


def _matches(spark, sf_dir) -> DataFrame:
    return tables.matches(_match_lines(spark, sf_dir))


def _hits(spark, sf_dir) -> DataFrame:
    o = _table(spark, sf_dir, "lineitem")
    return o.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.concat(F.lit("p"), "l_partkey").alias("query"), F.concat(F.lit("o"), "l_orderkey").alias("hit"), F.floor(F.col("l_extendedprice") / 1000).cast("double").alias("bitscore"))


def _taxa(spark, sf_dir) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    counts = F.create_map(F.lit("Haptophyta"), (F.col("p_partkey") % 3).cast("int"), F.lit("Rhizaria"), (F.col("p_partkey") % 5).cast("int"))
    return p.select(F.concat(F.lit("p"), "p_partkey").alias("contig_id"), counts.alias("counts"))


def _part_bins(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("contig_id"), (F.col("p_partkey") % 7 + 1).cast("int").alias("bin"))


def best_identity(spark, sf_dir):
    return G.best_identity(_matches(spark, sf_dir))


def best_hit(spark, sf_dir):
    return G.best_hit(_hits(spark, sf_dir))


def last_match(spark, sf_dir):
    return G.last_match(_matches(spark, sf_dir))


def hit_scan(spark, sf_dir):
    """Best hits of a file of twelve columns."""
    scratch, li = Scratch(spark, "hits"), _table(spark, sf_dir, "lineitem")
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    score = (F.col("l_extendedprice") + line / 1e9).cast("string")
    value = F.concat_ws("\t", F.concat(F.lit("p"), "l_partkey", F.lit("."), "l_linenumber"), F.concat(F.lit("o"), "l_orderkey"), *[F.lit(str(k)) for k in range(9)], score)
    li.select(value.alias("value")).write.text(scratch.path("hits.txt"))
    return _round(G.best_hit(tables.read_hits(spark, scratch.path("hits.txt"))))


def taxon_scan(spark, sf_dir):
    scratch, p = Scratch(spark, "taxa"), _table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("line"), F.concat_ws(" ", F.concat(F.lit("p"), "p_partkey"), F.col("p_partkey") % 3, F.col("p_partkey") % 5).alias("value"))
    head = spark.sql("SELECT -1L AS line, 'id Haptophyta Rhizaria' AS value")
    return G.taxon_class(tables.read_taxa(spark, _one_file(head.unionByName(rows), scratch.path("taxa.txt"))))


def touched_bins(spark, sf_dir):
    """Bins that share a member with the long contigs."""
    return B.touched(_source_bins(spark, sf_dir), _contigs(spark, sf_dir).where("len >= 3000"))


def taxon_classes(spark, sf_dir):
    return G.taxon_class(_taxa(spark, sf_dir))


def match_grade(spark, sf_dir):
    return _round(G.match_grade(_part_bins(spark, sf_dir), G.best_identity(_matches(spark, sf_dir)), G.taxon_class(_taxa(spark, sf_dir))), 4)


def best_bin(spark, sf_dir):
    return G.best_bin(match_grade(spark, sf_dir))


def bin_details(spark, sf_dir):
    bins = _part_bins(spark, sf_dir)
    return G.bin_details(bins.where("bin = 1"), _matches(spark, sf_dir), _hits(spark, sf_dir))


def every_bin_details(spark, sf_dir):
    return G.bin_details(_part_bins(spark, sf_dir), _matches(spark, sf_dir), _hits(spark, sf_dir), each=True)


def organism_pairs(spark, sf_dir):
    return fasta.organism_pairs(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("org")))


def compared_runs(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("j"), "o_totalprice")
    left = rows.select("i", "j", F.floor(F.col("o_totalprice") / 100).cast("double").alias("grade"))
    right = rows.select("i", "j", F.floor(F.col("o_totalprice") / 110).cast("double").alias("grade"))
    return _round(G.compared_runs(left, right))



QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        pair_counts, fasta_scan, two_column_scan, encoded_scan, old_fasta_scan, fixed_hit_scan, restart_scan, file_catalog, united_organisms, peptide_orientation, normalised_contigs, tagged_contigs, kept_and_skipped, kmer_counts, kmer_shares, kmer_profiles, kmer_dictionary,
        sequence_round_trips, wide_keys, key_ranks, key_lookup, length_selection, length_probe, length_stats, length_thresholds, variation_pairs, sparse_variation_pairs, distance_stats, organism_stats,
        share_below_cross, created_bins, nearest_bins, bin_medians, merge_links, nearest_median, reduced_bins, distance_binning, distance_grade, organism_experiments, chi_squared_pairs,
        seed_clusters, mapped_back, placed_back, seed_directions, context_states, context_levels, context_scores, strand_scores, look_behind, score_per_base, cluster_weakness, reassignment, reassignment_counts, best_strands, score_totals,
        log_likelihood, cull_candidate, score_histogram, score_outliers, fixed_lines, model_binning, refined_binning, dumped_bins, bin_purity, bin_labels, bin_grade, top_bins, all_pure,
        token_stream, best_identity, best_hit, hit_scan, taxon_scan, touched_bins, last_match, taxon_classes, match_grade, best_bin, bin_details, every_bin_details, organism_pairs, compared_runs,
    )
}
