"""SQL that says the same as the queries, for another engine over the same tables."""

_CONTIGS = """
contigs AS (
  SELECT coalesce(lang, '') || '_' || CAST(doc_id AS VARCHAR) AS contig_id,
         translate(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq,
         CAST(doc_id AS BIGINT) AS doc_id
  FROM documents)"""
_UNKNOWN = _CONTIGS.replace("'[^A-Za-z]', '', 'g'", "'[^A-Za-z]', '!', 'g'").replace("xyz',", "xyz!',").replace("ACGTACGTAC')", "ACGTACGTACN')")
_BASES = """
bases AS (SELECT contig_id, unnest(string_split(seq, '')) AS b, generate_subscripts(string_split(seq, ''), 1) AS pos FROM contigs WHERE seq <> ''),
windows AS (
  SELECT contig_id, b || lead(b, 1) OVER w || lead(b, 2) OVER w || lead(b, 3) OVER w AS kmer FROM bases WINDOW w AS (PARTITION BY contig_id ORDER BY pos)),
counts AS (SELECT contig_id, kmer, count(*) AS n FROM windows WHERE kmer IS NOT NULL AND NOT contains(kmer, 'N') GROUP BY contig_id, kmer),
shares AS (SELECT contig_id, kmer, n, n / sum(n) OVER (PARTITION BY contig_id) AS p FROM counts)"""
_ORIENTATION = """
orientation AS (SELECT coalesce(lang, '') || '_' || CAST(doc_id AS VARCHAR) AS contig_id, toxic = 0 AS forward FROM documents JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id))"""
_SELECTION = """
ranked AS (SELECT contig_id, len(seq) AS len, row_number() OVER (ORDER BY len(seq), contig_id) AS rank, count(*) OVER () AS total FROM contigs),
selection AS (SELECT contig_id, len, rank FROM ranked WHERE rank > CAST(floor(total * 85.0 / 100) AS BIGINT) AND rank <= CAST(floor(total * 95.0 / 100) AS BIGINT))"""
_PAIRS = """
dictionary AS (SELECT a.x || b.x || c.x || d.x AS kmer FROM (VALUES ('A'), ('C'), ('G'), ('T')) a(x), (VALUES ('A'), ('C'), ('G'), ('T')) b(x), (VALUES ('A'), ('C'), ('G'), ('T')) c(x), (VALUES ('A'), ('C'), ('G'), ('T')) d(x)),
dense AS (SELECT s.contig_id, k.kmer, coalesce(p, 0) AS p FROM selection s CROSS JOIN dictionary k LEFT JOIN shares USING (contig_id, kmer)),
pairs AS (
  SELECT x.contig_id AS a, y.contig_id AS b, sum(abs(x.p - y.p)) / 2 AS dist
  FROM dense x JOIN dense y ON x.kmer = y.kmer AND x.contig_id < y.contig_id GROUP BY ALL)"""
_ALL = f"WITH RECURSIVE {_CONTIGS}, {_BASES}, {_SELECTION}, {_PAIRS}"
_CREATED = """
links AS (SELECT ra.rank AS u, rb.rank AS v FROM pairs JOIN selection ra ON ra.contig_id = a JOIN selection rb ON rb.contig_id = b WHERE dist < 0.1),
both_links AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT u AS node, u AS root FROM both_links UNION SELECT v, root FROM reach JOIN both_links ON node = u WHERE root < v),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
grouped AS (SELECT contig_id, root, count(*) OVER (PARTITION BY root) AS size FROM roots JOIN selection ON rank = node),
created AS (SELECT contig_id, CAST(dense_rank() OVER (ORDER BY size DESC, root) AS INTEGER) AS bin FROM grouped)"""
_LANG = """
lang_bins AS (SELECT contig_id, CAST(dense_rank() OVER (ORDER BY left(contig_id, 2)) AS INTEGER) AS bin FROM {rows})"""
_MEDIANS = f"""{_LANG.format(rows="selection")},
medians AS (SELECT bin, kmer, quantile_cont(p, 0.5) AS p FROM dense JOIN lang_bins USING (contig_id) GROUP BY bin, kmer)"""
_NUMBER = "CAST(strpos('ACGT', kmer[1]) * 64 + strpos('ACGT', kmer[2]) * 16 + strpos('ACGT', kmer[3]) * 4 + strpos('ACGT', kmer[4]) - 85 AS INTEGER)"
_SOURCES = """
src AS (SELECT coalesce(lang, '') || '_' || CAST(doc_id AS VARCHAR) AS contig_id, coalesce(source, '') AS grp, count(*) OVER (PARTITION BY coalesce(source, '')) AS size FROM documents),
source_bins AS (SELECT contig_id, CAST(dense_rank() OVER (ORDER BY size DESC, grp) AS INTEGER) AS bin FROM src)"""
_PURITY = """
labels_of AS (SELECT bin, left(contig_id, 2) AS label, count(*) AS n FROM source_bins GROUP BY ALL),
purity AS (SELECT bin, arg_max(label, (n, label)) AS label, max(n) AS correct, CAST(sum(n) AS BIGINT) AS size, max(n) / sum(n) AS purity FROM labels_of GROUP BY bin)"""
# models of one cluster a language: contexts of up to 40 bases with more than 50 following bases, smoothed. A context is a
# number: 1, then a digit of base 4 for each base, the last one first; its shorter context is a quarter of it
_MODELS = f"""WITH RECURSIVE {_CONTIGS}, {_LANG.format(rows="contigs")},
bases AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY contig_id, pos) AS INTEGER) AS id, contig_id, bin AS cluster, CAST(strpos('ACGT', b) - 1 AS INTEGER) AS b
  FROM (SELECT contig_id, bin, unnest(string_split('!' || seq, '')) AS b, generate_subscripts(string_split('!' || seq, ''), 1) AS pos FROM contigs JOIN lang_bins USING (contig_id))),
seen AS (
  SELECT 0 AS level, id, cluster, b, CAST(1 AS HUGEINT) AS code FROM bases WHERE b >= 0
  UNION ALL
  SELECT level, id, cluster, b, code FROM (
    SELECT a.level + 1 AS level, a.id, a.cluster, a.b, a.code * 4 + p.b AS code, count(*) OVER (PARTITION BY a.cluster, a.code * 4 + p.b) AS n
    FROM seen a JOIN bases p ON p.id = a.id - a.level - 1 WHERE p.b >= 0 AND a.level < 40) WHERE n > 50),
states AS MATERIALIZED (
  SELECT cluster, level, code, count(*) FILTER (b = 0) AS n_a, count(*) FILTER (b = 1) AS n_c, count(*) FILTER (b = 2) AS n_g, count(*) FILTER (b = 3) AS n_t, count(*) AS n FROM seen GROUP BY ALL),
tall AS (SELECT cluster, level, code, n, unnest([0, 1, 2, 3]) AS b, unnest([n_a, n_c, n_g, n_t]) AS k FROM states),
probs AS (
  SELECT cluster, level, code, b, (1 - 1.0 / n) * k / n + (1.0 / n) * 0.25 AS p FROM tall WHERE level = 0
  UNION ALL
  SELECT t.cluster, t.level, t.code, t.b, (1 - 1.0 / n) * k / n + (1.0 / n) * p.p FROM probs p JOIN tall t ON t.cluster = p.cluster AND t.code // 4 = p.code AND t.b = p.b AND t.level = p.level + 1),
weights AS MATERIALIZED (SELECT cluster, code, b, log2(4 * greatest(p, 1.0 / 64)) AS w FROM probs)"""
# what each longer context adds to the score, so that the sum over all levels is that of the longest state of each base
_WALK = """
steps AS MATERIALIZED (
  SELECT x.cluster, x.code, x.b, x.w - coalesce(y.w, 0) AS w, x.w * x.w - coalesce(y.w * y.w, 0) AS q
  FROM weights x LEFT JOIN weights y ON y.cluster = x.cluster AND y.code = x.code // 4 AND y.b = x.b),
clusters AS (SELECT DISTINCT bin AS cluster FROM lang_bins),
walk AS (
  SELECT 0 AS level, x.id, x.contig_id, x.b, k.cluster, CAST(1 AS HUGEINT) AS code FROM {bases} x CROSS JOIN clusters k WHERE x.b >= 0
  UNION ALL
  SELECT w.level + 1, w.id, w.contig_id, w.b, w.cluster, s.code
  FROM walk w JOIN {bases} p ON p.id = w.id - w.level - 1 JOIN states s ON s.cluster = w.cluster AND s.code = w.code * 4 + p.b WHERE p.b >= 0),
walked AS (SELECT contig_id, cluster, sum(w) AS score, sum(q) AS squares FROM walk JOIN steps USING (cluster, code, b) GROUP BY ALL),
scores AS (
  SELECT contig_id, cluster, coalesce(score, 0) AS score, coalesce(squares, 0) AS squares, len(seq) AS len, bin AS mine
  FROM contigs CROSS JOIN clusters JOIN lang_bins USING (contig_id) LEFT JOIN walked USING (contig_id, cluster))"""
_SCORES = f"{_MODELS},{_WALK.format(bases='bases')}"
_REVERSED = f"""{_MODELS},
reversed AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY contig_id, pos) AS INTEGER) AS id, contig_id, CAST(strpos('ACGT', b) - 1 AS INTEGER) AS b
  FROM (SELECT contig_id, unnest(string_split('!' || translate(reverse(seq), 'ACGT', 'TGCA'), '')) AS b, generate_subscripts(string_split('!' || seq, ''), 1) AS pos FROM contigs)),
{_WALK.format(bases="reversed").strip()}"""
_STRANDS = f"""WITH strands AS (
  SELECT contig_id, cluster, false AS backward, score FROM ({_SCORES} SELECT * FROM scores)
  UNION ALL SELECT contig_id, cluster, true AS backward, score FROM ({_REVERSED} SELECT * FROM scores))"""
_BEST = "best AS (SELECT contig_id, any_value(mine) AS mine, max(score) AS score, arg_max(cluster, (score, -cluster)) AS cluster FROM scores GROUP BY contig_id)"
_STATS = "stats AS (SELECT cluster, count(*) AS size, CAST(sum(len) AS BIGINT) AS bases, sum(score) / sum(len) AS mean, sum(squares) / sum(len) - (sum(score) / sum(len)) * (sum(score) / sum(len)) AS var FROM scores WHERE cluster = mine GROUP BY cluster)"
_MATCHES = """
matches AS (
  SELECT l_orderkey * 10 + l_linenumber AS line, 'p' || l_partkey AS query, CAST(CAST(90 + l_discount * 100 AS DECIMAL(8, 2)) AS DOUBLE) AS pct, CAST(l_quantity * 4 AS INTEGER) AS match_len,
         'o' || l_orderkey AS hit, CAST(floor(l_extendedprice / 1000) AS DOUBLE) AS bitscore FROM lineitem)"""
_CLASSES = """
classes AS (
  SELECT 'p' || p_partkey AS contig_id, p_partkey % 7 + 1 AS bin,
         CASE WHEN p_partkey % 3 = 0 AND p_partkey % 5 > 0 THEN 'host' WHEN p_partkey % 3 > 0 AND p_partkey % 5 = 0 THEN 'symb' ELSE 'other' END AS class FROM part),
identity AS (SELECT query AS contig_id, max(pct) AS pct FROM matches WHERE match_len >= 100 GROUP BY query),
grades AS (
  SELECT CAST(bin AS INTEGER) AS bin, count(*) AS size, count(pct) AS comparable, count(*) FILTER (pct IS NULL) AS no_pct, round(coalesce(avg(pct), 0), 4) AS avg_pct, count(*) FILTER (pct > 99.0) AS over,
         count(*) FILTER (class = 'host') AS host, count(*) FILTER (class = 'symb') AS symb, count(*) FILTER (class = 'other') AS other
  FROM classes LEFT JOIN identity USING (contig_id) GROUP BY bin)"""
_CHI = f"""{_CONTIGS}, {_BASES}, {_PAIRS.split("pairs AS")[0].strip().rstrip(",").replace("FROM selection s", "FROM (SELECT contig_id FROM contigs WHERE len(seq) >= 3000) s").replace("coalesce(p, 0) AS p", "coalesce(n, 0) AS n")},
sums AS (SELECT contig_id, sum(n) AS t FROM dense GROUP BY contig_id),
turned AS (SELECT contig_id, translate(reverse(kmer), 'ACGT', 'TGCA') AS kmer, n FROM dense),
cells AS (
  SELECT x.contig_id AS a, y.contig_id AS b, x.n AS na, y.n AS nb, z.n AS nz, sa.t AS ta, sb.t AS tb
  FROM dense x JOIN dense y ON x.kmer = y.kmer AND x.contig_id < y.contig_id JOIN turned z ON z.contig_id = y.contig_id AND z.kmer = x.kmer
  JOIN sums sa ON sa.contig_id = x.contig_id JOIN sums sb ON sb.contig_id = y.contig_id),
chi AS (
  SELECT a, b,
         sum(CASE WHEN na + nb > 0 THEN pow(na - (na + nb) * ta / (ta + tb), 2) / greatest(0.01, (na + nb) * ta / (ta + tb)) + pow(nb - (na + nb) * tb / (ta + tb), 2) / greatest(0.01, (na + nb) * tb / (ta + tb)) ELSE 0 END) AS chi,
         sum(CASE WHEN na + nz > 0 THEN pow(na - (na + nz) * ta / (ta + tb), 2) / greatest(0.01, (na + nz) * ta / (ta + tb)) + pow(nz - (na + nz) * tb / (ta + tb), 2) / greatest(0.01, (na + nz) * tb / (ta + tb)) ELSE 0 END) AS chi_reverse
  FROM cells GROUP BY a, b)"""
_SEEDS = """
both_links AS (SELECT a AS u, b AS v FROM chi WHERE least(chi, chi_reverse) <= 255 UNION SELECT b, a FROM chi WHERE least(chi, chi_reverse) <= 255),
reach AS (SELECT u AS node, u AS root FROM both_links UNION SELECT v, root FROM reach JOIN both_links ON node = u),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
degrees AS (SELECT u AS node, count(*) AS degree FROM both_links GROUP BY u),
comps AS (SELECT root, max(degree) AS top, arg_min(node, (-degree, node)) AS first FROM roots JOIN degrees USING (node) GROUP BY root HAVING count(*) >= 6),
numbered AS (SELECT root, CAST(row_number() OVER (ORDER BY top DESC, first) AS INTEGER) AS cluster FROM comps),
seeds AS MATERIALIZED (SELECT node AS contig_id, cluster FROM roots JOIN numbered USING (root))"""
_HALF = "pow({x} - ({p} + {y}) * {t} / (ta + tb), 2) / greatest(0.01, ({p} + {y}) * {t} / (ta + tb))"


def _two_columns(y: str) -> str:
    a, b = (_HALF.replace("{x}", x).replace("{y}", y).replace("{p}", "{profile}").replace("{t}", t) for x, t in (("{profile}", "ta"), (y, "tb")))
    return f"sum(CASE WHEN {{profile}} + {y} > 0 THEN {a} + {b} ELSE 0 END)"


_TURN = f"({_two_columns('turned')} < {_two_columns('n')})"


def _merged(bins: str, out: str, below: float) -> str:
    """Bins of ``bins`` after one round in which each, in order, leads unless it was taken and takes the later ones close to it."""
    return f"""
{out}_m AS MATERIALIZED (SELECT bin, kmer, quantile_cont(p, 0.5) AS p FROM filled JOIN {bins} USING (contig_id) GROUP BY bin, kmer),
{out}_l AS MATERIALIZED (SELECT y.bin, list(x.bin) AS before FROM (SELECT x.bin AS a, y.bin AS b FROM {out}_m x JOIN {out}_m y ON x.kmer = y.kmer AND x.bin < y.bin GROUP BY ALL HAVING sum(abs(x.p - y.p)) / 2 < {below}) z
  JOIN (SELECT DISTINCT bin FROM {bins}) x ON x.bin = z.a JOIN (SELECT DISTINCT bin FROM {bins}) y ON y.bin = z.b GROUP BY y.bin),
{out}_w AS (
  SELECT 0 AS i, CAST([] AS INTEGER[]) AS leads, 0 AS taker
  UNION ALL
  SELECT i + 1, CASE WHEN list_has_any(coalesce(before, []), leads) THEN leads ELSE list_append(leads, i + 1) END, coalesce(list_min(list_intersect(coalesce(before, []), leads)), i + 1)
  FROM {out}_w LEFT JOIN {out}_l ON bin = i + 1 WHERE i < (SELECT coalesce(max(bin), 0) FROM {bins})),
{out} AS MATERIALIZED (
  SELECT contig_id, CAST(dense_rank() OVER (ORDER BY size DESC, taker) AS INTEGER) AS bin
  FROM (SELECT contig_id, taker, count(*) OVER (PARTITION BY taker) AS size FROM {bins} JOIN {out}_w ON i = bin))"""


def _near(bins: str, candidates: str, out: str, most: float) -> str:
    """Bins of ``bins`` with the candidates at most ``most`` from their nearest median."""
    return f"""
{out}_m AS MATERIALIZED (SELECT bin, kmer, quantile_cont(p, 0.5) AS p FROM filled JOIN {bins} USING (contig_id) GROUP BY bin, kmer),
{out}_d AS (
  SELECT contig_id, arg_min(bin, (dist, bin)) AS bin, min(dist) AS dist
  FROM (SELECT f.contig_id, m.bin, sum(abs(f.p - m.p)) / 2 AS dist FROM filled f JOIN {out}_m m USING (kmer) WHERE f.contig_id IN (SELECT contig_id FROM {candidates}) AND f.contig_id NOT IN (SELECT contig_id FROM {bins}) GROUP BY ALL) GROUP BY contig_id),
{out} AS MATERIALIZED (
  SELECT contig_id, CAST(dense_rank() OVER (ORDER BY size DESC, bin) AS INTEGER) AS bin
  FROM (SELECT contig_id, bin, count(*) OVER (PARTITION BY bin) AS size FROM (SELECT contig_id, bin FROM {bins} UNION ALL SELECT contig_id, bin FROM {out}_d WHERE dist <= {most})))"""


def _binned(where: str = "true") -> str:
    """The whole distance binning of the contigs for which ``where`` holds, as the table ``binned``."""
    rounds = [_merged(f"c{k}", f"c{k + 1}", below) for k, below in enumerate((0.02, 0.03125, 0.04, 0.05, 0.0625))]
    return f"""{_ALL.replace("FROM documents)", f"FROM (SELECT *, coalesce(lang, '') || '_' || CAST(doc_id AS VARCHAR) AS name FROM documents) WHERE {where})", 1)}, {_CREATED},
filled AS MATERIALIZED (SELECT c.contig_id, k.kmer, coalesce(p, 0) AS p FROM contigs c CROSS JOIN dictionary k LEFT JOIN shares USING (contig_id, kmer)),
two_way AS (SELECT a, b, dist FROM pairs UNION ALL SELECT b, a, dist FROM pairs),
first_near AS (SELECT a, arg_min(bin, (dist, b)) AS bin FROM two_way JOIN created ON created.contig_id = b WHERE dist <= 0.175 AND a NOT IN (SELECT contig_id FROM created) GROUP BY a),
c0 AS MATERIALIZED (
  SELECT contig_id, CAST(dense_rank() OVER (ORDER BY size DESC, bin) AS INTEGER) AS bin
  FROM (SELECT contig_id, bin, count(*) OVER (PARTITION BY bin) AS size FROM (SELECT contig_id, bin FROM created UNION ALL SELECT a, bin FROM first_near))),
{",".join(rounds).strip()},
sizes AS (SELECT bin, count(*) AS size FROM c5 GROUP BY bin),
large AS (SELECT CAST(sum(size) AS BIGINT) AS total, coalesce(max(bin) FILTER (size * size > (SELECT sum(size) FROM sizes)), 1) AS last FROM sizes),
along AS (SELECT bin, sum(size) OVER (ORDER BY bin) AS sums FROM sizes),
core AS MATERIALIZED (SELECT contig_id, bin FROM c5 WHERE bin <= (SELECT greatest(last, (SELECT min(bin) FROM along WHERE sums * sums >= least(16, total) * total)) FROM large)),
{_near("core", "selection", "again", 0.175).strip()},
{_near("again", "contigs", "binned", 0.5).strip()}"""


_GRADED = """
per AS (SELECT bin, max(n) AS correct, CAST(sum(n) AS BIGINT) AS size FROM (SELECT bin, left(contig_id, 2) AS label, count(*) AS n FROM binned GROUP BY ALL) GROUP BY bin),
graded AS (SELECT count(*) AS n_bins, coalesce(CAST(sum(correct) AS BIGINT), 0) AS correct, coalesce(CAST(sum(size) AS BIGINT), 0) AS assigned, (SELECT count(*) FROM contigs WHERE contig_id NOT IN (SELECT contig_id FROM binned)) AS unassigned FROM per)"""
_SHARES = "round(CASE WHEN assigned > 0 THEN correct / assigned ELSE 0 END, 6) AS accuracy, unassigned"


def _experiments(orgs: tuple[str, ...] = ("de", "en", "es", "fr")) -> str:
    parts = [
        f"SELECT * FROM ({_binned(f"left(name, 2) IN ('{x}', '{y}')")}, {_GRADED} SELECT '{x}' AS i, '{y}' AS j, n_bins, correct, assigned, {_SHARES} FROM graded)"
        for k, x in enumerate(orgs) for y in orgs[k + 1 :]
    ]
    return " UNION ALL ".join(parts)


_STATS_OF = "count(*) AS n, round(avg(dist), 6) AS mean, round(min(dist), 6) AS min, round(max(dist), 6) AS max"


def _points(column: str, **names: float) -> str:
    return ", ".join(f"round(quantile_cont({column}, {p}), 6) AS {name}" for name, p in names.items())


ORACLE_SQL = {
    "pair_counts": f"{_ALL} SELECT least(left(a, 2), left(b, 2)) AS org, greatest(left(a, 2), left(b, 2)) AS other, count(*) AS n_pairs FROM pairs WHERE dist < 0.1 GROUP BY ALL",
    "fasta_scan": f"WITH {_CONTIGS} SELECT contig_id, CAST(len(seq) AS INTEGER) AS len, md5(seq) AS seq_md5 FROM contigs WHERE seq <> ''",
    "two_column_scan": f"WITH {_CONTIGS} SELECT contig_id, md5(seq) AS seq_md5 FROM contigs WHERE seq <> ''",
    "encoded_scan": f"WITH {_UNKNOWN} SELECT contig_id, md5(seq) AS seq_md5 FROM contigs WHERE seq <> '' UNION ALL SELECT contig_id, md5(reverse(seq)) FROM contigs WHERE seq <> ''",
    "old_fasta_scan": f"WITH {_CONTIGS} SELECT left('a_name_of_many_letters_' || contig_id, 25) AS contig_id, md5(seq) AS seq_md5 FROM contigs WHERE seq <> ''",
    "fixed_hit_scan": "SELECT 'p' || p_partkey AS contig_id, CAST(printf('%.2f', p_partkey / 7) AS DOUBLE) AS pct FROM part",
    "restart_scan": "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, CAST(p_partkey % 40 AS INTEGER) AS cluster, CAST(p_partkey % 2 AS INTEGER) AS direction FROM part",
    "file_catalog": f"WITH {_CONTIGS}, o AS (SELECT DISTINCT left(contig_id, 2) AS org FROM contigs) SELECT CAST(row_number() OVER (ORDER BY org) - 1 AS INTEGER) AS org, 'org=' || org AS file, left('org=' || org, 7) AS prefix FROM o",
    "united_organisms": f"WITH {_CONTIGS} SELECT contig_id, md5(CASE WHEN left(contig_id, 2) = 'en' THEN translate(reverse(seq), 'ACGT', 'TGCA') ELSE seq END) AS seq_md5 FROM contigs",
    "peptide_orientation": "SELECT 'c' || doc_id % 40 AS contig_id, arg_max(doc_id % 3 = 0, (n_chars % 200, doc_id)) AS forward FROM documents GROUP BY ALL",
    "normalised_contigs": f"WITH {_CONTIGS}, {_ORIENTATION} SELECT 'x_' || contig_id AS contig_id, md5(CASE WHEN forward THEN seq ELSE translate(reverse(seq), 'ACGT', 'TGCA') END) AS seq_md5 FROM contigs JOIN orientation USING (contig_id)",
    "tagged_contigs": f"WITH {_UNKNOWN}, {_ORIENTATION} SELECT 'x_' || contig_id AS contig_id, CAST(len(seq) AS INTEGER) AS len, NOT forward AS reverse, md5(CASE WHEN forward THEN seq ELSE translate(reverse(seq), 'ACGT', 'TGCA') END) AS oriented_md5 FROM contigs JOIN orientation USING (contig_id)",
    "kept_and_skipped": f"WITH {_CONTIGS}, {_ORIENTATION} SELECT count(forward) AS kept, count(*) FILTER (forward IS NULL) AS skipped FROM contigs LEFT JOIN orientation USING (contig_id)",
    "kmer_counts": f"WITH {_UNKNOWN}, {_BASES} SELECT contig_id, kmer, n FROM counts",
    "kmer_shares": f"WITH {_CONTIGS}, {_BASES} SELECT contig_id, kmer, round(p, 6) AS p FROM shares",
    "kmer_profiles": f"WITH {_CONTIGS}, {_BASES} SELECT contig_id, {_NUMBER} AS kmer_index, n FROM counts",
    "kmer_dictionary": f"WITH {_PAIRS[1:].split('dense AS')[0].strip().rstrip(',')}, r AS (SELECT kmer AS own, translate(reverse(kmer), 'ACGT', 'TGCA') AS kmer FROM dictionary) SELECT {_NUMBER.replace('kmer', 'own')} AS kmer_index, own AS kmer, {_NUMBER} AS reverse_index FROM r",
    "sequence_round_trips": f"WITH {_CONTIGS} SELECT contig_id, md5(translate(reverse(seq), 'ACGT', 'TGCA')) AS reverse_md5, md5(seq) AS indices_md5, md5(seq) AS codes_md5, translate(left(seq, 1), 'ACGT', 'TGCA') AS first_complement FROM contigs WHERE len(seq) >= 4",
    "key_ranks": "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id = 0 THEN 0 ELSE 1 END, event_id DESC) AS INTEGER) AS place FROM events",
    "key_lookup": "SELECT a.event_id, coalesce(b.event_id, -1) AS place FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND a.event_id = 2 * b.event_id",
    "length_selection": f"WITH {_CONTIGS}, {_SELECTION} SELECT contig_id, CAST(len AS INTEGER) AS len, rank FROM selection",
    "length_probe": f"WITH {_CONTIGS} SELECT least, count(*) FILTER (len(seq) >= least) AS n FROM contigs, (SELECT unnest(range(0, 10001, 500)) AS least) GROUP BY least",
    "length_stats": f"WITH {_CONTIGS} SELECT count(*) AS n, round(avg(len(seq)), 4) AS mean, CAST(min(len(seq)) AS INTEGER) AS min, CAST(max(len(seq)) AS INTEGER) AS max, " + _points("len(seq)", p01=0.01, p25=0.25, p50=0.5, p75=0.75, p90=0.9, p95=0.95, p99=0.99).replace(", 6)", ", 4)") + " FROM contigs",
    "length_thresholds": f"WITH {_CONTIGS} SELECT 0 AS step, CAST(floor(quantile_cont(len(seq), 0.5)) AS INTEGER) AS least FROM contigs UNION ALL SELECT 1, CAST(floor(quantile_cont(len(seq), 0.25)) AS INTEGER) FROM contigs UNION ALL SELECT 2, CAST(floor(quantile_cont(len(seq), 0.1)) AS INTEGER) FROM contigs UNION ALL SELECT 3, 1",
    "variation_pairs": f"{_ALL} SELECT a, b, round(dist, 6) AS dist FROM pairs",
    "sparse_variation_pairs": f"{_ALL} SELECT a, b, round(dist, 6) AS dist FROM pairs WHERE dist < 1 - 1e-12",
    "distance_stats": f"{_ALL}, m AS (SELECT dist FROM pairs UNION ALL SELECT dist FROM pairs UNION ALL SELECT 0 FROM selection) SELECT {_STATS_OF}, " + _points("dist", p0_25=0.0025, p0_5=0.005, p1=0.01, p5=0.05, p10=0.1, p50=0.5, p99=0.99, p99_9=0.999) + " FROM m",
    "organism_stats": f"{_ALL} SELECT least(left(a, 2), left(b, 2)) AS org, greatest(left(a, 2), left(b, 2)) AS other, {_STATS_OF}, " + _points("dist", p1=0.01, p50=0.5, p99=0.99) + " FROM pairs GROUP BY ALL",
    "share_below_cross": f"{_ALL}, l AS (SELECT least(1, coalesce(min(dist), 1)) AS m FROM pairs WHERE left(a, 2) <> left(b, 2)) SELECT left(a, 2) AS org, round(avg(CASE WHEN dist < m THEN 1.0 ELSE 0.0 END), 6) AS share FROM pairs, l WHERE left(a, 2) = left(b, 2) GROUP BY ALL",
    "created_bins": f"{_ALL}, {_CREATED} SELECT contig_id, bin FROM created",
    "nearest_bins": f"""{_ALL}, {_CREATED},
two_way AS (SELECT a, b, dist FROM pairs UNION ALL SELECT b, a, dist FROM pairs),
near AS (SELECT a, arg_min(bin, (dist, b)) AS bin FROM two_way JOIN created ON created.contig_id = b WHERE dist <= 0.175 AND a NOT IN (SELECT contig_id FROM created) GROUP BY a),
members AS (SELECT contig_id, bin FROM created UNION ALL SELECT a, bin FROM near),
sized AS (SELECT contig_id, bin, count(*) OVER (PARTITION BY bin) AS size FROM members)
SELECT contig_id, CAST(dense_rank() OVER (ORDER BY size DESC, bin) AS INTEGER) AS bin FROM sized""",
    "bin_medians": f"{_ALL}, {_MEDIANS} SELECT bin, {_NUMBER} AS kmer_index, round(p, 6) AS p FROM medians",
    "merge_links": f"{_ALL}, {_MEDIANS} SELECT x.bin AS a, y.bin AS b, round(sum(abs(x.p - y.p)) / 2, 6) AS dist FROM medians x JOIN medians y ON x.kmer = y.kmer AND x.bin < y.bin GROUP BY ALL HAVING sum(abs(x.p - y.p)) / 2 < 0.6",
    "nearest_median": f"""{_ALL}, {_MEDIANS},
filled AS (SELECT c.contig_id, k.kmer, coalesce(p, 0) AS p FROM contigs c CROSS JOIN dictionary k LEFT JOIN shares USING (contig_id, kmer)),
d AS (SELECT contig_id, bin, sum(abs(f.p - m.p)) / 2 AS dist FROM filled f JOIN medians m USING (kmer) GROUP BY ALL)
SELECT contig_id, arg_min(bin, (dist, bin)) AS bin, round(min(dist), 6) AS dist FROM d GROUP BY contig_id""",
    "reduced_bins": f"""WITH RECURSIVE {_SOURCES},
s AS (SELECT bin, count(*) AS size FROM source_bins GROUP BY bin),
t AS (SELECT CAST(sum(size) AS BIGINT) AS total, coalesce(max(bin) FILTER (size * size > (SELECT sum(size) FROM s)), 1) AS large FROM s),
grow AS (SELECT large AS last FROM t UNION ALL SELECT last + 1 FROM grow, t WHERE (SELECT sum(size) FROM s WHERE bin <= last) * (SELECT sum(size) FROM s WHERE bin <= last) < least(16, total) * total)
SELECT bin, size FROM s WHERE bin <= (SELECT max(last) FROM grow)""",
    "chi_squared_pairs": f"WITH {_CHI} SELECT a, b, round(chi, 3) AS chi, round(chi_reverse, 3) AS chi_reverse FROM chi WHERE least(chi, chi_reverse) <= 255",
    "seed_clusters": f"WITH RECURSIVE {_CHI}, {_SEEDS} SELECT contig_id, cluster FROM seeds",
    "mapped_back": f"WITH {_CONTIGS}, b AS (SELECT contig_id, CAST(dense_rank() OVER (ORDER BY left(contig_id, 2)) AS INTEGER) AS bin FROM contigs WHERE len(seq) >= 1000) SELECT contig_id, coalesce(bin, -1) AS cluster FROM contigs LEFT JOIN b USING (contig_id)",
    "placed_back": f"WITH {_CONTIGS} SELECT contig_id, CAST(CASE WHEN len(seq) >= 1000 THEN (row_number() OVER (PARTITION BY len(seq) >= 1000 ORDER BY contig_id) - 1) % 9 + 1 ELSE 0 END AS INTEGER) AS cluster FROM contigs",
    "seed_directions": f"""WITH RECURSIVE {_CHI}, {_SEEDS},
held AS MATERIALIZED (
  SELECT contig_id, cluster, d.kmer, d.n, t.n AS turned, first_value(d.n) OVER (PARTITION BY cluster, d.kmer ORDER BY contig_id) AS first
  FROM seeds JOIN dense d USING (contig_id) JOIN turned t USING (contig_id, kmer)),
turns AS (
  SELECT 0 AS turn, contig_id, cluster, {_TURN.format(profile="first")} AS reverse, {_TURN.format(profile="first")} AS changed
  FROM (SELECT *, sum(first) OVER w AS ta, sum(n) OVER w AS tb FROM held WINDOW w AS (PARTITION BY contig_id)) GROUP BY contig_id, cluster
  UNION ALL
  SELECT turn + 1, contig_id, cluster, {_TURN.format(profile="profile")}, {_TURN.format(profile="profile")} <> reverse
  FROM (
    SELECT *, sum(profile) OVER w AS ta, sum(n) OVER w AS tb
    FROM (SELECT turn, reverse, h.*, bool_or(changed) OVER () AS more, sum(CASE WHEN reverse THEN turned ELSE n END) OVER (PARTITION BY h.cluster, kmer) AS profile FROM turns r JOIN held h USING (contig_id))
    WINDOW w AS (PARTITION BY contig_id))
  WHERE more GROUP BY turn, contig_id, cluster, reverse)
SELECT contig_id, cluster, reverse FROM turns WHERE turn = (SELECT max(turn) FROM turns)""",
    "wide_keys": """
WITH k AS (SELECT event_id, lpad(bin(event_id), 64, '0') || lpad(bin(event_id * 7919 + 13), 64, '0') AS x FROM events)
SELECT event_id, CAST(xor(CAST(substr(x, 71) || repeat('0', 70) AS BIT), CAST('000' || left(x, 125) AS BIT)) AS VARCHAR) AS mixed_bits,
       lpad(substr(x, 60, 66), 128, '0') AS part_bits, substr(x, 6, 60) = repeat('0', 60) AS no_head, left(x, 127) || '1' AS odd_bits FROM k""",
    "context_states": f"""{_MODELS},
names AS (
  SELECT cluster, code, '' AS context FROM states WHERE level = 0
  UNION ALL
  SELECT s.cluster, s.code, context || substr('ACGT', CAST(s.code % 4 AS INTEGER) + 1, 1) FROM names m JOIN states s ON s.cluster = m.cluster AND s.code // 4 = m.code AND s.level > 0)
SELECT k.cluster, CAST(level AS INTEGER) AS level, context, n_a, n_c, n_g, n_t,
       round(max(w) FILTER (b = 0), 6) + 0.0 AS w_a, round(max(w) FILTER (b = 1), 6) + 0.0 AS w_c, round(max(w) FILTER (b = 2), 6) + 0.0 AS w_g, round(max(w) FILTER (b = 3), 6) + 0.0 AS w_t
FROM states k JOIN names m ON m.cluster = k.cluster AND m.code = k.code JOIN weights w ON w.cluster = k.cluster AND w.code = k.code GROUP BY ALL""",
    "context_levels": f"{_MODELS} SELECT cluster, CAST(level AS INTEGER) AS level, count(*) AS n_states, CAST(sum(n) AS BIGINT) AS support FROM states GROUP BY ALL",
    "strand_scores": f"{_STRANDS} SELECT contig_id, cluster, backward, round(score, 4) AS score FROM strands",
    "best_strands": f"{_STRANDS}, b AS (SELECT contig_id, max((score, -cluster, NOT backward)) AS x FROM strands GROUP BY contig_id) SELECT contig_id, -x[2] AS cluster, NOT x[3] AS reverse FROM b",
    "context_scores": f"{_SCORES} SELECT contig_id, cluster, round(score, 4) AS score, round(squares, 4) AS squares FROM scores",
    "look_behind": f"""WITH {_CONTIGS},
places AS (SELECT contig_id, seq, unnest(range(1, len(seq) + 1)) AS pos FROM contigs)
SELECT contig_id, count(*) AS n, md5(string_agg(reverse(substr(seq, greatest(pos - 40, 1), least(pos - 1, 40))) || '>' || substr(seq, pos, 1), ',' ORDER BY pos)) AS steps_md5 FROM places GROUP BY contig_id""",
    "score_per_base": f"{_SCORES}, {_STATS} SELECT cluster, size, bases, round(mean, 4) AS mean, round(var, 4) AS var FROM stats",
    "cluster_weakness": f"""{_SCORES},
per AS (SELECT contig_id, mine, any_value(len) AS len, max(score) FILTER (cluster = mine) AS own, max(score) FILTER (cluster <> mine) AS other FROM scores GROUP BY contig_id, mine)
SELECT mine AS cluster, count(*) AS size, round(avg(own), 4) AS own, round(avg(other), 4) AS other, round(avg(other) / greatest(avg(own), 1), 4) AS absorbability,
       round(avg(own / greatest(len, 1)), 4) AS mean_norm, round(stddev_pop(own / greatest(len, 1)) / avg(own / greatest(len, 1)), 4) AS cv FROM per GROUP BY mine""",
    "reassignment": f"{_SCORES}, {_BEST} SELECT contig_id, CAST(CASE WHEN score > 0 THEN cluster ELSE -1 END AS INTEGER) AS cluster FROM best",
    "reassignment_counts": f"{_SCORES}, {_BEST} SELECT CAST(0 AS BIGINT) AS assigned, count(*) FILTER (score > 0 AND cluster <> mine) AS reassigned, count(*) FILTER (score > 0 AND cluster = mine) AS stayed, count(*) FILTER (score <= 0) AS negative, count(*) FILTER (score <= 0) AS deassigned FROM best",
    "score_totals": f"{_SCORES}, {_BEST} SELECT round(sum(score), 2) AS total, count(*) FILTER (score < 0) AS negative FROM best",
    "log_likelihood": f"{_SCORES} SELECT round(sum(score) / sum(len), 4) AS log_likelihood FROM scores WHERE cluster = mine",
    "cull_candidate": f"{_SCORES}, o AS (SELECT contig_id, mine, max(score) AS s FROM scores WHERE cluster <> mine GROUP BY ALL), g AS (SELECT mine, avg(s) AS s FROM o GROUP BY mine) SELECT CAST(arg_max(mine, (s, -mine)) AS INTEGER) AS cluster, round(max(s), 2) AS score FROM g",
    "score_histogram": f"{_SCORES}, {_STATS} SELECT s.cluster, CAST(greatest(-10, least(10, trunc((score - len * mean) / sqrt(len * var)))) AS INTEGER) AS z, count(*) FILTER (s.cluster = mine) AS members, count(*) FILTER (s.cluster <> mine) AS others FROM scores s JOIN stats t ON t.cluster = s.cluster GROUP BY ALL",
    "score_outliers": f"{_SCORES}, {_STATS} SELECT contig_id, CAST(CASE WHEN (score - len * mean) / sqrt(len * var) < -3 THEN 0 ELSE s.cluster END AS INTEGER) AS cluster FROM scores s JOIN stats t ON t.cluster = s.cluster WHERE s.cluster = mine",
    "fixed_lines": f"{_SCORES} SELECT printf('%-25s%3d%3d%11.2f', left(contig_id, 25), cluster, 0, score) AS value FROM scores WHERE cluster = mine",
    "distance_binning": f"{_binned()} SELECT contig_id, coalesce(printf('bin_%04d', bin), 'bin_none') AS bin_label FROM contigs LEFT JOIN binned USING (contig_id)",
    "distance_grade": f"{_binned()}, {_GRADED} SELECT n_bins, correct, assigned, {_SHARES}, round(unassigned / (assigned + unassigned), 6) AS unassigned_share FROM graded",
    "organism_experiments": _experiments(),
    "dumped_bins": f"WITH {_SOURCES} SELECT contig_id, CASE WHEN bin <= 10 THEN printf('bin_%04d', bin) ELSE 'bin_none' END AS bin_label FROM source_bins",
    "bin_purity": f"WITH {_SOURCES}, {_PURITY} SELECT bin, label, correct, size, round(purity, 6) AS purity FROM purity",
    "bin_labels": f"WITH {_SOURCES}, {_PURITY} SELECT * FROM labels_of",
    "bin_grade": f"WITH {_SOURCES}, {_PURITY}, t AS (SELECT count(*) AS n_bins, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(size) AS BIGINT) AS assigned FROM purity WHERE bin <= 10), u AS (SELECT count(*) AS unassigned FROM source_bins WHERE bin > 10) SELECT n_bins, correct, assigned, round(correct / assigned, 6) AS accuracy, unassigned, round(unassigned / (assigned + unassigned), 6) AS unassigned_share FROM t, u",
    "top_bins": f"WITH {_SOURCES}, {_PURITY} SELECT bin, label, correct, size, round(purity, 6) AS purity FROM purity ORDER BY size DESC, bin LIMIT 5",
    "all_pure": f"WITH {_SOURCES}, {_PURITY} SELECT true AS all_pure UNION ALL SELECT bool_and(purity = 1) FROM purity",
    "token_stream": f"WITH {_CONTIGS}, bases AS (SELECT contig_id, unnest(string_split(seq, '')) AS b, generate_subscripts(string_split(seq, ''), 1) AS pos FROM contigs WHERE seq <> ''), w AS (SELECT contig_id, pos, b || lead(b, 1) OVER w || lead(b, 2) OVER w || lead(b, 3) OVER w AS kmer FROM bases WINDOW w AS (PARTITION BY contig_id ORDER BY pos)), t AS (SELECT contig_id, count(*) AS n, string_agg(CAST({_NUMBER} AS VARCHAR), ',' ORDER BY pos) AS ids FROM w WHERE kmer IS NOT NULL GROUP BY contig_id) SELECT CASE WHEN left(md5(contig_id), 8) < '80000000' THEN 'train' ELSE 'val' END AS split, contig_id, coalesce(n, 0) AS n_tokens, md5(coalesce(ids, '')) AS tokens_md5 FROM contigs LEFT JOIN t USING (contig_id)",
    "best_identity": f"WITH {_MATCHES} SELECT query, max(pct) AS pct FROM matches WHERE match_len >= 100 GROUP BY query",
    "best_hit": f"WITH {_MATCHES} SELECT query, arg_max(hit, (bitscore, -line)) AS hit, max(bitscore) AS bitscore FROM matches GROUP BY query",
    "last_match": f"WITH {_MATCHES} SELECT query, arg_max(pct, line) AS pct, arg_max(match_len, line) AS match_len FROM matches GROUP BY query",
    "hit_scan": "SELECT 'p' || l_partkey AS query, arg_max('o' || l_orderkey, s) AS hit, round(max(s), 6) AS bitscore FROM (SELECT *, l_extendedprice + (l_orderkey * 10 + l_linenumber) / 1e9 AS s FROM lineitem) GROUP BY l_partkey",
    "taxon_scan": f"WITH {_MATCHES}, {_CLASSES} SELECT contig_id, class FROM classes",
    "touched_bins": f"WITH {_CONTIGS}, {_SOURCES} SELECT DISTINCT bin FROM source_bins JOIN contigs USING (contig_id) WHERE len(seq) >= 3000",
    "taxon_classes": f"WITH {_MATCHES}, {_CLASSES} SELECT contig_id, class FROM classes",
    "match_grade": f"WITH {_MATCHES}, {_CLASSES} SELECT * FROM grades",
    "best_bin": f"WITH {_MATCHES}, {_CLASSES} SELECT arg_max(bin, (over, -bin)) AS best_bin FROM grades",
    "bin_details": f"""WITH {_MATCHES}, {_CLASSES},
m AS (SELECT query, arg_max(pct, line) AS pct, arg_max(match_len, line) AS match_len, arg_max(hit, (bitscore, -line)) AS hit, max(bitscore) AS bitscore FROM matches GROUP BY query)
SELECT contig_id, pct, match_len, hit, bitscore, CAST(row_number() OVER (ORDER BY pct DESC NULLS LAST, match_len DESC NULLS LAST, bitscore DESC NULLS LAST, contig_id) AS INTEGER) AS place
FROM classes LEFT JOIN m ON query = contig_id WHERE bin = 1""",
    "every_bin_details": f"""WITH {_MATCHES}, {_CLASSES},
m AS (SELECT query, arg_max(pct, line) AS pct, arg_max(match_len, line) AS match_len, arg_max(hit, (bitscore, -line)) AS hit, max(bitscore) AS bitscore FROM matches GROUP BY query)
SELECT CAST(bin AS INTEGER) AS bin, contig_id, pct, match_len, hit, bitscore,
       CAST(row_number() OVER (PARTITION BY bin ORDER BY pct DESC NULLS LAST, match_len DESC NULLS LAST, bitscore DESC NULLS LAST, contig_id) AS INTEGER) AS place
FROM classes LEFT JOIN m ON query = contig_id""",
    "organism_pairs": "SELECT CAST(a.n_nationkey AS INTEGER) AS i, CAST(b.n_nationkey AS INTEGER) AS j FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey",
    "compared_runs": "WITH d AS (SELECT CAST(floor(o_totalprice / 100) - floor(o_totalprice / 110) AS DOUBLE) AS d FROM orders) SELECT count(*) AS n, round(avg(d), 6) AS mean, max(d) AS max, min(d) AS min FROM d",
}
