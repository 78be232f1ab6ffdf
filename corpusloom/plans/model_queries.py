"""Redundancy, denominators, the product model, approximate matching, intervals and selection as queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions.grammar import GRAMMARS
from ..operators import alike as L
from ..operators import approx as A
from ..operators import chains as C
from ..operators import model as M
from ..operators import presence as P
from ..operators import redundancy as R
from ..operators import select as X
from ..operators import sites as K
from ..operators.denominators import class_counts, compare, compare_sql
from ..session import cut
from ..sources import texts
from . import prelude as p

QUERIES: dict = {}
SQL: dict[str, str] = {}
K_SIZE, SKETCH, ALIKE = 21, 5000, 0.999


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- redundancy -----------------------------------------------------------------------------------------------------

_SK = f"""{p.RECORDS}, k AS (SELECT seq_id, substring(seq, q + 1, {K_SIZE}) AS w FROM (SELECT seq_id, seq, unnest(range(0, greatest(0, length(seq) - {K_SIZE - 1}))) AS q FROM records)),
canon AS (SELECT DISTINCT seq_id, least(w, {p.rc_sql("w")}) AS c FROM k WHERE regexp_full_match(w, '[ACGT]+')),
h AS (SELECT DISTINCT seq_id, {p.word_hash_sql("c")} AS h FROM canon),
s AS (SELECT seq_id, h, row_number() OVER (PARTITION BY seq_id ORDER BY h) AS rank FROM h QUALIFY rank <= {SKETCH})"""
_PAIRS = f"""{_SK}, sketched AS (SELECT seq_id, list(h ORDER BY h) AS sketch FROM s GROUP BY seq_id), firsts AS (SELECT sketch, min(seq_id) AS seq_id FROM sketched GROUP BY sketch),
fh AS (SELECT seq_id, unnest(sketch) AS h, len(sketch) AS n FROM firsts),
shared AS (SELECT x.seq_id AS a, y.seq_id AS b, count(*) AS k, any_value(x.n + y.n) - count(*) AS u FROM fh x JOIN fh y ON x.h = y.h AND x.seq_id < y.seq_id GROUP BY ALL),
merged AS (SELECT a, b, x.sketch AS sa, y.sketch AS sb, list_sort(list_distinct(list_concat(x.sketch, y.sketch)))[1:{SKETCH}] AS m FROM shared JOIN firsts x ON x.seq_id = a JOIN firsts y ON y.seq_id = b WHERE u > {SKETCH}),
jac AS (SELECT a, b, k / u AS j FROM shared WHERE u <= {SKETCH} UNION ALL SELECT a, b, len(list_intersect(m, list_intersect(sa, sb))) / len(m) AS j FROM merged),
pairs AS (SELECT a, b, round(j, 6) AS jaccard, round(CASE WHEN j <= 0 THEN 0.0 WHEN j >= 1 THEN 1.0 ELSE greatest(0.0, 1 + ln(2 * j / (1 + j)) / {K_SIZE}) END, 6) AS identity FROM jac)"""
_EDGES = f"SELECT a AS u, b AS v FROM pairs WHERE identity >= {ALIKE} UNION ALL SELECT x.seq_id, f.seq_id FROM sketched x JOIN firsts f ON x.sketch = f.sketch AND x.seq_id <> f.seq_id"
_CLUSTERS = f"""edges AS ({_EDGES}), both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach(n, r) AS (SELECT u, u FROM both_ways UNION SELECT b.v, reach.r FROM reach JOIN both_ways b ON reach.n = b.u),
roots AS (SELECT n AS seq_id, min(r) AS root FROM reach GROUP BY n),
c AS (SELECT r.seq_id, accession, lang, coalesce(root, r.seq_id) AS cluster_id, ambiguous_fraction, length_bp, is_refseq FROM records r LEFT JOIN roots USING (seq_id)),
clustered AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS cluster_size, row_number() OVER (PARTITION BY cluster_id ORDER BY ambiguous_fraction, length_bp DESC, is_refseq DESC, accession) = 1 AS is_representative FROM c)"""


@query(f"WITH {_SK} SELECT seq_id, h, rank FROM s")
def minhash_sketch(spark, sf_dir):
    return R.sketch_rows(p.records(spark, sf_dir), K_SIZE, SKETCH)


@query(f"WITH {_PAIRS} SELECT a, b, jaccard, identity FROM pairs")
def sketch_identity_pairs(spark, sf_dir):
    return L.identity_pairs(p.records(spark, sf_dir), K_SIZE, SKETCH)


def _clustered(spark, sf_dir):
    r = p.records(spark, sf_dir)
    return R.clusters(r, R.close_links(r, K_SIZE, SKETCH, ALIKE))


@query(f"WITH RECURSIVE {_PAIRS}, {_CLUSTERS} SELECT seq_id, cluster_id, cluster_size, is_representative FROM clustered")
def dedup_clusters(spark, sf_dir):
    return _clustered(spark, sf_dir).select("seq_id", "cluster_id", "cluster_size", "is_representative")


@query(f"WITH RECURSIVE {_PAIRS}, {_CLUSTERS} SELECT cluster_id, cluster_size, r AS rank FROM (SELECT DISTINCT cluster_id, cluster_size, dense_rank() OVER (ORDER BY cluster_size DESC, cluster_id) AS r FROM clustered WHERE cluster_size > 1) WHERE r <= 6")
def topk_clusters(spark, sf_dir):
    """The first six clusters by size."""
    many = _clustered(spark, sf_dir).where("cluster_size > 1").select("cluster_id", "cluster_size").distinct()
    top = many.orderBy(F.desc("cluster_size"), "cluster_id").limit(6)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("cluster_size"), "cluster_id")))


@query(f"""WITH RECURSIVE {_PAIRS}, groups AS (SELECT sketch, list(seq_id ORDER BY seq_id)[1:2] AS m FROM sketched GROUP BY sketch HAVING count(*) > 1),
same AS (SELECT seq_id, CASE WHEN seq_id = m[1] THEN m[2] ELSE m[1] END AS nearest, 1.0 AS nearest_identity, 1.0 AS nearest_jaccard FROM sketched JOIN groups USING (sketch)),
pair_rows AS (SELECT a AS seq_id, b AS other, identity, jaccard FROM pairs UNION ALL SELECT b, a, identity, jaccard FROM pairs)
SELECT * FROM same UNION ALL (SELECT seq_id, other, identity, jaccard FROM pair_rows WHERE seq_id NOT IN (SELECT seq_id FROM same) QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY jaccard DESC, other) = 1)""")
def nearest_record(spark, sf_dir):
    """Each record's most similar other one, the first on ties."""
    return L.nearest(p.records(spark, sf_dir), K_SIZE, SKETCH)


_THRESHOLDS = (0.95, 0.99, 0.999)


@query(f"""WITH RECURSIVE {_PAIRS}, {p.guides_sql()}, {p.FOUND}, limits AS (SELECT unnest([{", ".join(map(str, _THRESHOLDS))}]::DOUBLE[]) AS threshold),
sweep_edges AS (SELECT threshold, a AS u, b AS v FROM pairs JOIN limits ON identity >= threshold UNION ALL SELECT threshold, x.seq_id, f.seq_id FROM sketched x JOIN firsts f ON x.sketch = f.sketch AND x.seq_id <> f.seq_id CROSS JOIN limits),
sweep_ways AS (SELECT threshold, u, v FROM sweep_edges UNION SELECT threshold, v, u FROM sweep_edges),
sweep_reach(threshold, n, r) AS (SELECT threshold, u, u FROM sweep_ways UNION SELECT b.threshold, b.v, x.r FROM sweep_reach x JOIN sweep_ways b ON x.n = b.u AND x.threshold = b.threshold),
sweep_roots AS (SELECT threshold, n AS seq_id, min(r) AS root FROM sweep_reach GROUP BY ALL),
every AS (SELECT threshold, seq_id, coalesce(root, seq_id) AS root, ambiguous_fraction, length_bp, is_refseq, accession FROM records CROSS JOIN limits LEFT JOIN sweep_roots USING (threshold, seq_id)),
marked AS (SELECT *, count(*) OVER (PARTITION BY threshold, root) AS size, row_number() OVER (PARTITION BY threshold, root ORDER BY ambiguous_fraction, length_bp DESC, is_refseq DESC, accession) = 1 AS first FROM every),
sums AS (SELECT threshold, count_if(first) AS n_clusters, count_if(NOT first) AS n_collapsed, max(size) AS largest FROM marked GROUP BY threshold),
complete AS (SELECT threshold, guide_id, count(DISTINCT seq_id) AS n FROM found JOIN marked USING (seq_id) WHERE first GROUP BY ALL)
SELECT threshold, n_clusters, n_collapsed, largest, count(guide_id) AS n_perfect, round(100.0 * count(guide_id) / greatest((SELECT count(*) FROM guides), 1), 3) AS pct_perfect
FROM sums LEFT JOIN (SELECT c.threshold, guide_id FROM complete c JOIN sums s ON s.threshold = c.threshold AND s.n_clusters = c.n) USING (threshold) GROUP BY ALL""")
def redundancy_sweep(spark, sf_dir):
    r, g = p.records(spark, sf_dir), p.guides(spark, sf_dir)
    pairs, tied = L.linkage(r, K_SIZE, SKETCH, 0.95)
    return R.threshold_sweep(r, cut(pairs), tied, P.presence(r, g, p.CAS), g.count(), _THRESHOLDS)


# --- denominators ---------------------------------------------------------------------------------------------------

_LANGS = ["de", "en", "es", "fr"]


@query(f"WITH {p.ALL}, n AS (SELECT lang, count(*) AS c FROM records GROUP BY lang), f AS (SELECT guide_id, lang, count(*) AS k FROM found JOIN records USING (seq_id) GROUP BY ALL) SELECT g.guide_id, " + ", ".join(f"coalesce((SELECT c FROM n WHERE lang = '{x}'), 0) AS n_{x}, coalesce(max(k) FILTER (lang = '{x}'), 0) AS present_{x}, round(coalesce(max(k) FILTER (lang = '{x}'), 0) / nullif(coalesce((SELECT c FROM n WHERE lang = '{x}'), 0), 0), 6) AS conservation_{x}" for x in _LANGS) + " FROM guides g LEFT JOIN f ON f.guide_id = g.guide_id GROUP BY g.guide_id")
def gene_level_counts(spark, sf_dir):
    r, g = p.records(spark, sf_dir), p.guides(spark, sf_dir)
    return class_counts(r, g, P.presence(r, g, p.CAS), "lang", _LANGS)


_TIERS = f"""tier AS (SELECT p.guide_id, p.gene, p.conservation_fraction AS x, coalesce(k, 0) / (SELECT count(*) FROM records WHERE length_bp >= 2000) AS y, (SELECT count(*) FROM records WHERE length_bp >= 2000) AS records
FROM pool p LEFT JOIN (SELECT guide_id, count(*) AS k FROM found JOIN records USING (seq_id) WHERE length_bp >= 2000 GROUP BY guide_id) USING (guide_id))"""


def _tiers(spark, sf_dir):
    r, g = p.records(spark, sf_dir), p.pool(spark, sf_dir)
    long = r.where("length_bp >= 2000")
    n = long.count()
    k = P.presence(r, g, p.CAS).join(long.select("seq_id"), "seq_id", "left_semi").groupBy("guide_id").agg(F.count(F.lit(1)).alias("k"))
    return g.join(k, "guide_id", "left").select("guide_id", "gene", F.col("conservation_fraction").alias("x"), (F.coalesce("k", F.lit(0)) / F.lit(max(n, 1))).alias("y"), F.lit(n).cast("long").alias("records"))


@query(f"WITH {p.ALL}, {_TIERS} {compare_sql('tier')}")
def denominator_compare(spark, sf_dir):
    return compare(_tiers(spark, sf_dir))


@query(f"WITH {p.ALL}, {_TIERS} SELECT gene, count(*) AS n_sites, count_if(x > 0) AS n_hit, count_if(y > x) AS n_higher, round(median(x), 6) AS median_x, round(max(y), 6) AS max_y FROM tier GROUP BY gene")
def gene_tiers(spark, sf_dir):
    return _tiers(spark, sf_dir).groupBy("gene").agg(F.count(F.lit(1)).alias("n_sites"), F.count_if(F.col("x") > 0).alias("n_hit"), F.count_if(F.col("y") > F.col("x")).alias("n_higher"), F.round(F.median("x"), 6).alias("median_x"), F.round(F.max("y"), 6).alias("max_y"))


# --- product model --------------------------------------------------------------------------------------------------

_R = 1 - 1 / (8.0 - 1 + 1)
_SPECTRUM = f"""spectrum AS (SELECT -n AS length, pow({_R!r}, n - 1) / sum(pow({_R!r}, n - 1)) OVER () * (1 - 0.2 - 0.3) AS p FROM range(1, 31) t(n) UNION ALL VALUES (0, 0.2), (1, 0.3))"""
_STATS = """SELECT round(sum(p) FILTER (length = 0), 9) AS p_wild, round(sum(p) FILTER (length <> 0 AND length % 3 = 0) / sum(p) FILTER (length <> 0), 9) AS inframe_fraction,
round(sum(-length * p) FILTER (length < 0) / sum(p) FILTER (length < 0), 9) AS mean_deletion FROM """


@query(f"WITH {_SPECTRUM} {_STATS} spectrum")
def spectrum_stats(spark, sf_dir):
    return M.spectrum_stats(M.parametric_spectrum(spark))


_SCALED = "scaled AS (SELECT length, p * CASE WHEN length = 0 THEN 1 WHEN length % 3 = 0 THEN 0.4 * t / m ELSE 0.6 * t / (t - m) END AS p FROM spectrum, (SELECT sum(p) FILTER (length <> 0) AS t, sum(p) FILTER (length <> 0 AND length % 3 = 0) AS m FROM spectrum))"


@query(f"WITH {_SPECTRUM}, {_SCALED} SELECT CAST(length AS INT) AS length, round(p, 9) AS p FROM scaled")
def spectrum_rescaled(spark, sf_dir):
    return M.rescaled(M.parametric_spectrum(spark), 0.4).select("length", F.round("p", 9).alias("p"))


@query("SELECT l_linenumber AS length, round(count(*) / sum(count(*)) OVER (), 9) AS p FROM lineitem GROUP BY l_linenumber")
def spectrum_histogram(spark, sf_dir):
    h = p.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("length")).agg(F.count(F.lit(1)).alias("reads"))
    return M.normalised(h, "reads").select("length", F.round("p", 9).alias("p"))


_CODONS = 60
_SITES = f"""tol AS (SELECT list(CASE WHEN (i * 7) % 5 < 2 THEN 0.5 ELSE 0.05 END ORDER BY i) AS t FROM range(0, {_CODONS}) r(i)),
model_sites AS (SELECT guide_id, CAST(ref_start % {_CODONS} AS INT) AS codon, n_copies, t FROM guides, tol),
cond AS (SELECT length, p / sum(p) OVER () AS p FROM spectrum WHERE length <> 0),
widths AS (SELECT guide_id, n_copies, codon, t, length, p, greatest(1, abs(length) // 3) AS m FROM model_sites, cond),
windows AS (SELECT *, greatest(codon - m + 1, 0) AS lo, least(codon, {_CODONS} - m) AS hi FROM widths),
viab AS (SELECT *, CASE WHEN length % 3 = 0 THEN list_avg([list_aggregate(t[s + 1 : s + m], 'product') FOR s IN CASE WHEN lo <= hi THEN range(lo, hi + 1) ELSE [greatest(0, least(codon, {_CODONS} - m))] END]) ELSE 0.0 END AS v FROM windows),
single AS (SELECT guide_id, n_copies, least(1.0, greatest(0.0, sum(p * v))) AS q1 FROM viab GROUP BY guide_id, n_copies),
q AS (SELECT guide_id, n_copies, q1, CASE WHEN n_copies <= 1 THEN q1 ELSE least(1.0, 1 - pow(1 - q1, n_copies)) END AS q FROM single)"""


def _site_q(spark, sf_dir, spectrum=None, variable: float = 0.5, invariant: float = 0.05, **options):
    tol = F.array(*[F.lit(variable if (i * 7) % 5 < 2 else invariant) for i in range(_CODONS)])
    sites = p.guides(spark, sf_dir).select("guide_id", (F.col("ref_start") % _CODONS).cast("int").alias("codon"), tol.alias("tol"), "n_copies")
    return M.site_escape(sites, M.parametric_spectrum(spark) if spectrum is None else spectrum, **options)


@query(f"WITH {p.guides_sql()}, {_SPECTRUM}, {_SITES} SELECT guide_id, n_copies, round(q1, 9) AS q_single, round(q, 9) AS q FROM q")
def site_params(spark, sf_dir):
    return _site_q(spark, sf_dir).select("guide_id", "n_copies", F.round("q_single", 9).alias("q_single"), F.round("q", 9).alias("q"))


_TOP = "top AS (SELECT guide_id, gene, (ref_start + ref_end) // 2 AS middle, row_number() OVER (ORDER BY n_present DESC, guide_id) AS r FROM pool QUALIFY r <= 12)"
_MODEL = f"{p.ALL}, {_SPECTRUM}, {_SITES}, {_TOP}"


def _top(spark, sf_dir, n: int = 12):
    g = p.pool(spark, sf_dir).orderBy(F.desc("n_present"), "guide_id").limit(n)
    return g.select("guide_id", "gene", F.floor((F.col("ref_start") + F.col("ref_end")) / 2).alias("middle"), F.row_number().over(W.orderBy(F.desc("n_present"), "guide_id")).alias("r"))


@query(f"""WITH {_MODEL}, sets AS (SELECT k AS set_id, guide_id FROM range(1, 7) t(k) JOIN top ON r <= k),
f AS (SELECT s.set_id, r.seq_id, product(CASE WHEN f.seq_id IS NULL THEN 1.0 ELSE q.q END) AS f, bool_and(f.seq_id IS NOT NULL) AS every FROM sets s JOIN q USING (guide_id) CROSS JOIN (SELECT seq_id FROM records) r LEFT JOIN found f ON f.guide_id = s.guide_id AND f.seq_id = r.seq_id GROUP BY ALL),
alone AS (SELECT set_id, product(1 - (1 - q.q) * n_present / n_total) AS p FROM sets JOIN q USING (guide_id) JOIN pool USING (guide_id) GROUP BY set_id)
SELECT f.set_id, f.set_id AS k, round(avg(every::INT), 6) AS joint, round(avg(f), 9) AS p_escape, round(any_value(p), 9) AS p_independent FROM f JOIN alone USING (set_id) GROUP BY f.set_id""")
def p_escape_sets(spark, sf_dir):
    sets = _top(spark, sf_dir).join(spark.range(1, 7).withColumnRenamed("id", "set_id"), F.col("r") <= F.col("set_id")).select("set_id", "guide_id")
    r, g = p.records(spark, sf_dir), p.guides(spark, sf_dir)
    return M.set_escape(P.presence(r, g, p.CAS), sets, _site_q(spark, sf_dir), r.count())


@query("""SELECT source, n, round(1 - pow(0.05, 1.0 / n), 9) AS upper, k, round(pow(1 - pow(0.05, 1.0 / n) + pow(0.05, 1.0 / n) * 0.1, k), 12) AS floor FROM (SELECT source, count(*) AS n FROM documents GROUP BY source), range(1, 4) t(k)""")
def resolution_floor(spark, sf_dir):
    """For each source the upper limit of an escape never seen in n records, and the least P(escape) of k sites it allows."""
    n = p.table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("x", F.lit(0).cast("long"))
    u = M.upper_bounds(spark, n, "x", "n").crossJoin(F.broadcast(spark.range(1, 4).withColumnRenamed("id", "k")))
    return u.select("source", "n", F.round("upper", 9).alias("upper"), "k", F.round(F.pow(F.col("upper") + (1 - F.col("upper")) * 0.1, F.col("k")), 12).alias("floor"))


_SETTINGS = [("tolerance", "base", 0.5, 0.05), ("tolerance", "low", 0.25, 0.05), ("tolerance", "high", 0.9, 0.05), ("floor", "zero", 0.5, 0.01), ("floor", "double", 0.5, 0.1)]


@query(f"""WITH {p.guides_sql()}, {_SPECTRUM}, settings(grp, label, tv, ti) AS (VALUES {", ".join(f"('{a}', '{b}', {c}, {d})" for a, b, c, d in _SETTINGS)}),
tols AS (SELECT grp, label, list(CASE WHEN (i * 7) % 5 < 2 THEN tv ELSE ti END ORDER BY i) AS t FROM settings, range(0, {_CODONS}) r(i) GROUP BY ALL),
{_SITES.replace("tol AS (SELECT list(CASE WHEN (i * 7) % 5 < 2 THEN 0.5 ELSE 0.05 END ORDER BY i) AS t FROM range(0, " + str(_CODONS) + ") r(i)),", "").replace("SELECT guide_id, CAST(ref_start", "SELECT grp, label, guide_id, CAST(ref_start").replace("FROM guides, tol)", "FROM guides, tols)").replace("SELECT guide_id, n_copies, codon", "SELECT grp, label, guide_id, n_copies, codon").replace("SELECT guide_id, n_copies, least", "SELECT grp, label, guide_id, n_copies, least").replace("GROUP BY guide_id, n_copies)", "GROUP BY grp, label, guide_id, n_copies)").replace("SELECT guide_id, n_copies, q1", "SELECT grp, label, guide_id, n_copies, q1")}
SELECT grp AS "group", label, count(*) AS n_sites, round(min(q), 9) AS q_min, round(median(q), 9) AS q_median, round(max(q), 9) AS q_max, round(log10(greatest(max(q), 1e-300) / greatest(min(q), 1e-300)), 6) AS log_range FROM q GROUP BY ALL""")
def sensitivity_sweep(spark, sf_dir):
    out = None
    for group, label, tv, ti in _SETTINGS:
        q = _site_q(spark, sf_dir, variable=tv, invariant=ti).withColumn("group", F.lit(group)).withColumn("label", F.lit(label))
        out = q if out is None else out.unionByName(q)
    least, most = F.greatest(F.min("q"), F.lit(1e-300)), F.greatest(F.max("q"), F.lit(1e-300))
    return out.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n_sites"), F.round(F.min("q"), 9).alias("q_min"), F.round(F.median("q"), 9).alias("q_median"), F.round(F.max("q"), 9).alias("q_max"), F.round(F.log10(most / least), 6).alias("log_range"))


@query("SELECT theta, p, round(theta + (1 - theta) * p, 12) AS mixed FROM (VALUES (0.0), (0.001), (0.01), (0.1)) t(theta), (VALUES (0.5), (0.01), (0.000001)) u(p)")
def theta_table(spark, sf_dir):
    t = spark.createDataFrame([(x,) for x in (0.0, 0.001, 0.01, 0.1)], "theta double").crossJoin(spark.createDataFrame([(x,) for x in (0.5, 0.01, 0.000001)], "p double"))
    return t.select("theta", "p", F.round(F.col("theta") + (1 - F.col("theta")) * F.col("p"), 12).alias("mixed"))


# --- approximate matching and intervals --------------------------------------------------------------------------------

_MM = 3
_ALL_SITES = f"""{p.RECORDS}, {p.guides_sql()}, {p.sites_sql("doc_sites", "records", "seq_id", p.CAS)}, spaced AS (SELECT *, substring(target, 1, 20) AS spacer FROM doc_sites),
near AS (SELECT s.*, g.guide_id, hamming(spacer, g.protospacer) AS mismatches, [i FOR i IN range(1, 21) IF substring(spacer, i, 1) <> substring(g.protospacer, i, 1)] AS places FROM spaced s, guides g WHERE hamming(spacer, g.protospacer) <= {_MM})"""


def _near(spark, sf_dir, mismatches: int = _MM):
    g = p.guides(spark, sf_dir)
    return A.near_hits(p.records(spark, sf_dir), g.select("guide_id", F.col("protospacer").alias("spacer")), p.CAS, mismatches), g


@query(f"WITH {_ALL_SITES} SELECT guide_id, seq_id, start0, start0 + 23 AS end0, strand, mismatches, len([x FOR x IN places IF x > 8]) AS seed_mismatches, array_to_string(places, ',') AS mismatch_positions, substring(target, 21, 3) AS pam, CASE WHEN strand = '+' THEN start0 + 17 ELSE start0 + 6 END AS cut_site FROM near")
def approx_match(spark, sf_dir):
    hits, _ = _near(spark, sf_dir)
    cut = p.CAS.cut_offset_in_hit(F.col("start0"), F.col("strand"))
    return hits.select("guide_id", "seq_id", "start0", (F.col("start0") + 23).alias("end0"), "strand", "mismatches", "seed_mismatches", "mismatch_positions", F.substring("target", 21, 3).alias("pam"), cut.alias("cut_site"))


@query(f"WITH {_ALL_SITES}, c AS (SELECT guide_id, mismatches AS m, len([x FOR x IN places IF x > 8]) AS sm FROM near) SELECT g.guide_id, " + ", ".join(f"coalesce(count_if(m = {i}), 0) AS mm{i}" for i in range(_MM + 1)) + ", count(m) AS total, coalesce(count_if(sm <= 1), 0) AS seed_le1 FROM guides g LEFT JOIN c USING (guide_id) GROUP BY g.guide_id")
def approx_summary(spark, sf_dir):
    hits, g = _near(spark, sf_dir)
    return A.summary(hits, g, _MM)


@query(f"""WITH {p.RECORDS}, {p.guides_sql()}, {p.sites_sql("doc_sites", "records", "seq_id", p.CAS)}, seeds AS (SELECT DISTINCT seq_id, substring(target, 9, 12) AS seed FROM doc_sites),
words AS (SELECT DISTINCT substring(protospacer, 9, 12) AS guide_seed FROM guides),
v AS (SELECT guide_seed, seed, count(*) AS n FROM seeds, words WHERE hamming(seed, guide_seed) = 1 GROUP BY ALL)
SELECT guide_seed, count(*) AS n_variants, max(n) AS n_dominant, arg_max(seed, (n, seed)) AS dominant FROM v GROUP BY guide_seed""")
def single_sub_variants(spark, sf_dir):
    """Per 12-base seed the seeds of other sites at exactly one substitution, and the one that most records carry (ties: the greatest)."""
    words = p.guides(spark, sf_dir).select(F.substring("protospacer", 9, 12).alias("spacer")).distinct().select(F.col("spacer").alias("guide_id"), "spacer")
    seeds = K.sites(p.records(spark, sf_dir).select("seq_id", "seq"), "seq", p.CAS).select("seq_id", F.substring("target", 9, 12).alias("spacer")).distinct()
    v = A.similarity_join(seeds, words, 12, 1).where("mismatches = 1").groupBy("guide_id", "spacer").agg(F.count(F.lit(1)).alias("n"))
    return v.groupBy(F.col("guide_id").alias("guide_seed")).agg(F.count(F.lit(1)).alias("n_variants"), F.max("n").alias("n_dominant"), F.max_by("spacer", F.struct("n", "spacer")).alias("dominant"))


_PROBES = f"""seeds AS (SELECT DISTINCT substring(protospacer, 9, 12) AS target FROM guides),
probes AS (SELECT target, target AS probe, false AS turned FROM seeds UNION ALL SELECT target, {p.rc_sql("target")}, true FROM seeds),
doc_windows AS (SELECT seq_id, substring(seq, q + 1, 12) AS w FROM (SELECT seq_id, seq, unnest(range(0, greatest(0, length(seq) - 11))) AS q FROM records)),
half_met AS (SELECT seq_id, w, target, probe, turned FROM doc_windows JOIN probes ON substring(w, 1, 6) = substring(probe, 1, 6) UNION ALL SELECT seq_id, w, target, probe, turned FROM doc_windows JOIN probes ON substring(w, 7) = substring(probe, 7)),
one_off AS (SELECT DISTINCT seq_id, target, CASE WHEN turned THEN {p.rc_sql("w")} ELSE w END AS variant FROM half_met WHERE hamming(w, probe) = 1),
variant_counts AS (SELECT target, variant, list_max([i FOR i IN range(1, 13) IF substring(target, i, 1) <> substring(variant, i, 1)])::INT AS place, count(*) AS n_records FROM one_off GROUP BY target, variant)"""


def _seeds(spark, sf_dir):
    return p.guides(spark, sf_dir).select(F.substring("protospacer", 9, 12).alias("target")).distinct().select(F.col("target").alias("guide_id"), "target")


@query(f"WITH {p.RECORDS}, {p.guides_sql()}, {_PROBES} SELECT target AS seed, variant, place, n_records FROM variant_counts")
def substitution_variants(spark, sf_dir):
    """Windows anywhere in a record, whatever follows them, at one substitution from a 12-base seed, and how many records carry each."""
    return A.one_off_variants(p.records(spark, sf_dir), _seeds(spark, sf_dir)).withColumnRenamed("guide_id", "seed")


@query(f"""WITH {p.RECORDS}, {p.guides_sql()}, {_PROBES}, most AS (SELECT target, count(*) AS n_variants, arg_max(variant, (n_records, variant)) AS dominant, max(n_records) AS n_dominant FROM variant_counts GROUP BY target)
SELECT seeds.target AS seed, coalesce(n_variants, 0) AS n_variants, dominant, place, substring(seeds.target, place, 1) || '>' || substring(dominant, place, 1) AS change, coalesce(n_dominant, 0) AS n_dominant
FROM seeds LEFT JOIN most ON most.target = seeds.target LEFT JOIN variant_counts c ON c.target = seeds.target AND variant = dominant""")
def dominant_variants(spark, sf_dir):
    """For each seed how many variants there are and the one that most records carry (ties: the greatest), with its change; nulls without one."""
    g = _seeds(spark, sf_dir)
    most = F.max_by(F.struct("variant", "place", "n_records"), F.struct("n_records", "variant"))
    v = A.one_off_variants(p.records(spark, sf_dir), g).groupBy("guide_id").agg(F.count(F.lit(1)).alias("n_variants"), most.alias("m"))
    base = lambda c: F.substring(c, F.col("m.place"), F.lit(1))
    return g.join(v, "guide_id", "left").select(
        F.col("target").alias("seed"), F.coalesce("n_variants", F.lit(0)).alias("n_variants"), F.col("m.variant").alias("dominant"), F.col("m.place").alias("place"),
        F.concat(base(F.col("target")), F.lit(">"), base(F.col("m.variant"))).alias("change"), F.coalesce("m.n_records", F.lit(0)).alias("n_dominant"),
    )


@query(f"""WITH {p.ALL}, u AS (SELECT 1 AS prio, guide_id, protospacer FROM pool WHERE conservation_fraction > 0.0015 UNION ALL SELECT 2, guide_id, protospacer FROM pool WHERE passes_filters AND n_present > 0 UNION ALL SELECT 3, guide_id, protospacer FROM pool WHERE n_copies >= 2)
SELECT guide_id, protospacer, prio, substring(seq, CASE WHEN strand = '+' THEN ref_start - 1 ELSE ref_end + 1 END, 1) AS flank FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY protospacer ORDER BY prio, guide_id) = 1) JOIN pool USING (guide_id, protospacer) JOIN segments USING (segment)
WHERE CASE WHEN strand = '+' THEN ref_start > 1 ELSE ref_end < length(seq) END""")
def select_screen_set(spark, sf_dir):
    """Three overlapping rules, one row for each spacer (the first rule wins), with the base on its 5' side; none at an edge."""
    g, out = p.pool(spark, sf_dir), None
    for prio, rule in enumerate(("conservation_fraction > 0.0015", "passes_filters AND n_present > 0", "n_copies >= 2"), 1):
        part = g.where(rule).withColumn("prio", F.lit(prio))
        out = part if out is None else out.unionByName(part)
    first = X.first_of(out, "protospacer", [F.asc("prio"), F.asc("guide_id")]).join(F.broadcast(p.segments(spark, sf_dir).select("segment", "seq")), "segment")
    inside = F.when(F.col("strand") == "+", F.col("ref_start") > 1).otherwise(F.col("ref_end") < F.length("seq"))
    at = F.when(F.col("strand") == "+", F.col("ref_start") - 1).otherwise(F.col("ref_end") + 1)
    return first.where(inside).select("guide_id", "protospacer", "prio", F.substring(F.col("seq"), at, F.lit(1)).alias("flank"))


_HITS = "hits AS (SELECT p_partkey AS hit_id, p_partkey % 25 AS chrom, p_partkey * 37 % 10000 AS qs, p_partkey * 37 % 10000 + 22 AS qe FROM part), intervals AS (SELECT o_custkey % 25 AS chrom, o_orderkey % 10000 AS s, o_orderkey % 10000 + o_orderkey % 97 AS e, o_orderpriority AS name FROM orders)"


def _intervals(spark, sf_dir):
    hits = p.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("hit_id"), (F.col("p_partkey") % 25).alias("chrom"), (F.col("p_partkey") * 37 % 10000).alias("qs"), (F.col("p_partkey") * 37 % 10000 + 22).alias("qe"))
    o = p.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).alias("chrom"), (F.col("o_orderkey") % 10000).alias("s"), (F.col("o_orderkey") % 10000 + F.col("o_orderkey") % 97).alias("e"), F.col("o_orderpriority").alias("name"))
    return hits, o


@query(f"WITH {_HITS} SELECT hit_id, qs, qe, count(name) > 0 AS inside, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS names FROM hits h LEFT JOIN intervals i ON h.chrom = i.chrom AND s <= qe AND e >= qs GROUP BY hit_id, qs, qe")
def interval_annotate(spark, sf_dir):
    return A.annotate(*_intervals(spark, sf_dir)).select("hit_id", "qs", "qe", "inside", "names")


@query(f"WITH {_HITS}, x AS (SELECT hit_id, name FROM hits h JOIN intervals i ON h.chrom = i.chrom AND s <= qs + 17 AND e >= qs + 17) SELECT name AS label, count(*) AS n_overlaps, count(DISTINCT hit_id) AS n_hits, min(hit_id) AS first_hit FROM x GROUP BY name")
def cut_annotation_summary(spark, sf_dir):
    """Per label what a point (the cut) of each hit falls into."""
    hits, o = _intervals(spark, sf_dir)
    points = hits.select("hit_id", "chrom", (F.col("qs") + 17).alias("at"))
    return A.point_depths(points, o).groupBy(F.col("name").alias("label")).agg(F.sum("depth").alias("n_overlaps"), F.count_distinct("hit_id").alias("n_hits"), F.min("hit_id").alias("first_hit"))


# --- selection ------------------------------------------------------------------------------------------------------

_AXES = """axes AS (SELECT s_suppkey AS id, round(s_acctbal, 2) AS balance, n_lines, n_late, discount, n_parts FROM supplier JOIN (SELECT l_suppkey, count(*) AS n_lines, count_if(l_returnflag = 'R') AS n_late, sum(CAST(round(l_discount * 100) AS BIGINT))::BIGINT * 10000 // count(*) AS discount, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY l_suppkey) ON l_suppkey = s_suppkey)"""
_GATES = [("G1 balance", "balance >= 0"), ("G2 lines", "n_lines >= 590"), ("G3 late", "n_late <= 210"), ("G4 parts", "n_parts >= 75")]
_HIGHER, _LOWER = ("balance", "n_lines", "n_parts"), ("n_late", "discount")
_FAILED = "[x FOR x IN [" + ", ".join(f"CASE WHEN NOT coalesce({c}, false) THEN '{n}' END" for n, c in _GATES) + "] IF x IS NOT NULL]"
_GATED = f"gated AS (SELECT *, CASE WHEN len({_FAILED}) = 0 THEN '-' ELSE array_to_string({_FAILED}, '; ') END AS gates_failed, len({_FAILED}) = 0 AS survives FROM axes)"
_DOM = lambda a, b: "(" + " AND ".join([f"{a}.{c} >= {b}.{c}" for c in _HIGHER] + [f"{a}.{c} <= {b}.{c}" for c in _LOWER]) + ") AND (" + " OR ".join([f"{a}.{c} > {b}.{c}" for c in _HIGHER] + [f"{a}.{c} < {b}.{c}" for c in _LOWER]) + ")"


def _axes(spark, sf_dir):
    l = p.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("l_returnflag") == "R").alias("n_late"), F.expr("sum(cast(round(l_discount * 100) as bigint)) * 10000 div count(1)").alias("discount"), F.count_distinct("l_partkey").alias("n_parts"))
    s = p.table(spark, sf_dir, "supplier")
    return s.join(l, s.s_suppkey == l.l_suppkey).select(F.col("s_suppkey").alias("id"), F.round("s_acctbal", 2).alias("balance"), "n_lines", "n_late", "discount", "n_parts")


@query(f"WITH {_AXES} SELECT * FROM axes")
def joint_table(spark, sf_dir):
    return _axes(spark, sf_dir)


def _gated(spark, sf_dir):
    return X.gate(_axes(spark, sf_dir), [(n, F.expr(c)) for n, c in _GATES])


@query(f"WITH {_AXES}, {_GATED} SELECT id, gates_failed, survives FROM gated")
def gates(spark, sf_dir):
    return _gated(spark, sf_dir).select("id", "gates_failed", "survives")


@query(f"WITH {_AXES} SELECT b.* FROM axes b WHERE NOT EXISTS (SELECT 1 FROM axes a WHERE {_DOM('a', 'b')})")
def pareto_front(spark, sf_dir):
    return X.pareto_front(_axes(spark, sf_dir), "id", _HIGHER, _LOWER)


@query(f"WITH {_AXES} SELECT a.id AS winner, b.id AS loser FROM axes a, axes b WHERE {_DOM('a', 'b')}")
def pareto_dominance(spark, sf_dir):
    return X.dominance(_axes(spark, sf_dir), "id", _HIGHER, _LOWER)


@query(f"""WITH {_AXES}, {_GATED}, alive AS (SELECT * FROM gated WHERE survives)
SELECT id, row_number() OVER (ORDER BY n_late, discount, balance DESC, n_parts DESC, id) AS rank, NOT EXISTS (SELECT 1 FROM alive a WHERE {_DOM("a", "b")}) AS on_front FROM alive b""")
def apply_rule(spark, sf_dir):
    alive = _gated(spark, sf_dir).where("survives")
    front = X.pareto_front(alive, "id", _HIGHER, _LOWER).select("id", F.lit(True).alias("f"))
    ranked = alive.withColumn("rank", F.row_number().over(W.orderBy("n_late", "discount", F.desc("balance"), F.desc("n_parts"), "id")))
    return ranked.join(front, "id", "left").select("id", "rank", F.coalesce("f", F.lit(False)).alias("on_front"))


@query(f"WITH {_AXES}, b AS (SELECT * FROM axes WHERE id = 1) SELECT axes.id FROM axes, b WHERE axes.id <> 1 AND axes.n_late <= b.n_late AND axes.discount <= b.discount")
def as_clean_as(spark, sf_dir):
    return X.as_clean(_axes(spark, sf_dir), "id", 1, ["n_late", "discount"]).select("id")


@query("""SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS n_unlabelled, (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS n_labelled,
(SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS n_orphans, (SELECT count(DISTINCT source) FROM documents) AS n_sources, (SELECT count(*) FROM (SELECT lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 3)) AS n_limited""")
def set_algebra(spark, sf_dir):
    d, l = p.table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), p.table(spark, sf_dir, "labels").select("doc_id")
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    ids = d.select("doc_id")
    few = d.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("doc_id"))).where("n <= 3")
    return one(ids.subtract(l), "n_unlabelled").crossJoin(one(ids.intersect(l), "n_labelled")).crossJoin(one(l.join(ids, "doc_id", "left_anti"), "n_orphans")).crossJoin(d.agg(F.count_distinct("source").alias("n_sources"))).crossJoin(one(few, "n_limited"))


_ANCHORS = "anchors AS (SELECT o_custkey AS seq_id, o_orderkey AS ref, o_orderkey + 10 * (o_orderkey // 700 % 3) AS qry FROM orders)"


@query(f"""WITH {_ANCHORS}, a AS (SELECT *, qry - ref AS shift, coalesce(lag(qry - ref) OVER w <> qry - ref OR ref - lag(ref) OVER w > 3000, true)::INT AS new FROM anchors WINDOW w AS (PARTITION BY seq_id ORDER BY ref, qry)),
b AS (SELECT *, sum(new) OVER (PARTITION BY seq_id ORDER BY ref, qry ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT seq_id, run, min(ref) AS low, max(ref) AS high, min(shift) AS shift, count(*) AS n FROM b GROUP BY seq_id, run""")
def offset_runs(spark, sf_dir):
    o = p.table(spark, sf_dir, "orders")
    anchors = o.select(F.col("o_custkey").alias("seq_id"), F.col("o_orderkey").alias("ref"), (F.col("o_orderkey") + 10 * (F.floor(F.col("o_orderkey") / 700) % 3)).alias("qry"))
    return C.offset_runs(anchors, 3000)


_SA, _SR = GRAMMARS["sacas9"], GRAMMARS["sacas9_relaxed"]


@query(f"""WITH {p.SEGMENTS}, {p.sites_sql("a", "segments", "gene, segment", _SA)}, {p.sites_sql("b", "segments", "gene, segment", _SR)}
SELECT x.gene, n_strict, n_relaxed, round(100.0 * n_strict / n_relaxed, 6) AS pct FROM (SELECT gene, count(DISTINCT target) AS n_relaxed FROM b GROUP BY gene) x JOIN (SELECT gene, count(DISTINCT target) AS n_strict FROM a GROUP BY gene) y USING (gene)""")
def grammar_contraction(spark, sf_dir):
    s = p.segments(spark, sf_dir)
    n = lambda g, name: K.sites(s, "seq", g).groupBy("gene").agg(F.count_distinct("target").alias(name))
    both = n(_SR, "n_relaxed").join(n(_SA, "n_strict"), "gene")
    return both.select("gene", "n_strict", "n_relaxed", F.round(100.0 * F.col("n_strict") / F.col("n_relaxed"), 6).alias("pct"))


@query(f"""WITH {p.ALL}, bins AS (SELECT gene, least(CAST(floor(conservation_fraction * 10000) AS INT), 20) AS bin FROM pool) SELECT gene, bin, count(*) AS n_sites, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY gene), 6) AS pct FROM bins GROUP BY gene, bin""")
def figure_data(spark, sf_dir):
    """A histogram of conservation for each gene."""
    b = p.pool(spark, sf_dir).select("gene", F.least(F.floor(F.col("conservation_fraction") * 10000).cast("int"), F.lit(20)).alias("bin"))
    n = b.groupBy("gene", "bin").agg(F.count(F.lit(1)).alias("n_sites"))
    return n.withColumn("pct", F.round(100.0 * F.col("n_sites") / F.sum("n_sites").over(W.partitionBy("gene")), 6))


@query(f"""WITH {_MODEL}, x AS (SELECT min(guide_id) FILTER (r = 1) AS a, min(guide_id) FILTER (r = 2) AS b FROM top),
m AS (SELECT r.seq_id, EXISTS (SELECT 1 FROM found f, x WHERE f.seq_id = r.seq_id AND f.guide_id = x.a) AS ha, EXISTS (SELECT 1 FROM found f, x WHERE f.seq_id = r.seq_id AND f.guide_id = x.b) AS hb FROM records r)
SELECT CASE WHEN ha AND hb THEN 'both' WHEN ha THEN 'first' WHEN hb THEN 'second' ELSE 'neither' END AS state, count(*) AS n_records, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM m GROUP BY ALL""")
def presence_decomposition(spark, sf_dir):
    """Records by which of the two most frequent sites they hold."""
    r, g = p.records(spark, sf_dir), p.guides(spark, sf_dir)
    pair = _top(spark, sf_dir, 2).select("guide_id", "r")
    held = P.presence(r, g, p.CAS).join(F.broadcast(pair), "guide_id").groupBy("seq_id").agg(F.sum(F.col("r")).alias("s"))
    state = F.element_at(F.array(F.lit("neither"), F.lit("first"), F.lit("second"), F.lit("both")), F.coalesce("s", F.lit(0)).cast("int") + 1)
    n = r.select("seq_id").join(held, "seq_id", "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n_records"))
    return n.withColumn("share", F.round(F.col("n_records") / F.sum("n_records").over(W.partitionBy()), 6))


@query(f"""WITH {p.BASE}, pat AS (SELECT seq_id, string_agg(guide_id, ',' ORDER BY guide_id) AS s FROM found GROUP BY seq_id) SELECT (SELECT count(DISTINCT s) FROM pat) + CASE WHEN (SELECT count(*) FROM pat) < (SELECT count(*) FROM records) THEN 1 ELSE 0 END AS n_patterns, (SELECT count(*) FROM pat) AS n_with_site""")
def presence_patterns(spark, sf_dir):
    n = p.records(spark, sf_dir).count()
    pat = p.found(spark, sf_dir).groupBy("seq_id").agg(F.array_sort(F.collect_set("guide_id")).alias("s"))
    return pat.agg(F.count_distinct("s").alias("d"), F.count(F.lit(1)).alias("n_with_site")).select((F.col("d") + F.when(F.col("n_with_site") < n, 1).otherwise(0)).alias("n_patterns"), "n_with_site")


@query()
def byte_checksums(spark, sf_dir):
    b = p.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").cast("binary").alias("raw"))
    return texts.checksums(b, "item_id", "raw")


@query("""WITH t(line) AS (VALUES ('chr1\tx\tgene\t5\t20\t.\t+\t.\tgene_id "G1"; gene_name "ABC";'), ('chr1\tx\texon\t5\t9\t.\t+\t.\tgene_id "G1"; gene_name "";'), ('chr2\tx\tCDS\t7\t9\t.\t-\t0\tgene_id "G2";')),
f AS (SELECT string_split(line, chr(9)) AS c FROM t) SELECT c[3] AS feature, c[1] AS chrom, c[4]::BIGINT AS "start", c[5]::BIGINT AS "end", c[7] AS strand, coalesce(nullif(regexp_extract(c[9], 'gene_name "([^"]*)"', 1), ''), regexp_extract(c[9], 'gene_id "([^"]*)"', 1)) AS name FROM f""")
def annotation_lines(spark, sf_dir):
    rows = [("chr1", "x", "gene", 5, 20, ".", "+", ".", 'gene_id "G1"; gene_name "ABC";'), ("chr1", "x", "exon", 5, 9, ".", "+", ".", 'gene_id "G1"; gene_name "";'), ("chr2", "x", "CDS", 7, 9, ".", "-", "0", 'gene_id "G2";')]
    return texts.annotation_rows(spark.createDataFrame(rows, "chrom string, origin string, feature string, start long, end long, score string, strand string, frame string, attributes string"))
