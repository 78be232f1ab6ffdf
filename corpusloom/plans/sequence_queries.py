"""Sources, scalar functions, sites and presence as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions.grammar import GRAMMARS
from ..operators import presence as P
from ..operators import scan
from ..operators import sites as K
from ..sources import texts
from . import prelude as p

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {p.RECORDS} SELECT seq_id, accession, length_bp, n_ambiguous, ambiguous_fraction, is_refseq, round({p.gc_sql("seq")}, 6) AS gc_fraction, {p.run_sql("seq")} AS longest_run FROM records""")
def seq_manifest(spark, sf_dir):
    r = p.records(spark, sf_dir)
    return r.select("seq_id", "accession", F.col("length_bp"), "n_ambiguous", "ambiguous_fraction", "is_refseq", F.round(S.gc_fraction(F.col("seq")), 6).alias("gc_fraction"), S.max_homopolymer_run(F.col("seq")).alias("longest_run"))


@query(f"""WITH {p.RECORDS} SELECT seq_id, sha256(seq) AS seq_sha256, sha256(replace(replace(d.text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text_sha256
FROM records JOIN documents d ON seq_id = doc_id""")
def seq_checksums(spark, sf_dir):
    d = p.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("seq_id"), F.sha2(S.from_text(F.col("text")).cast("binary"), 256).alias("seq_sha256"), S.normalised_digest(F.col("text")).alias("text_sha256"))


_BODY = r"regexp_replace(regexp_replace(replace(text, 'ß', 's'), '(?m)^>[^\n]*$', '', 'g'), '[\s\x0B]', '', 'g')"


@query(f"""SELECT conv_id || '.' || turn AS seq_id, md5(upper({_BODY})) AS body_md5, length({_BODY}) AS n FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text DESC) = 1""")
def fasta_like_split(spark, sf_dir):
    """Turns of a conversation written as one FASTA text and split again; the last of equal ids wins."""
    c = p.table(spark, sf_dir, "conversations")
    blob = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: F.concat(F.lit(">"), F.col("conv_id").cast("string"), F.lit("."), t["turn"].cast("string"), F.lit(" turn\n"), F.replace(t["text"], F.lit("ß"), F.lit("s")))), "\n").alias("blob"))
    out = texts.split_fasta(blob, "blob")
    return out.select("seq_id", F.md5(F.col("seq").cast("binary")).alias("body_md5"), F.length("seq").cast("long").alias("n"))


@query("""SELECT page_id, CASE WHEN lower(html) LIKE '%complete%' THEN 'complete' WHEN lower(html) LIKE '%partial%' THEN 'partial' ELSE 'unstated' END AS completeness_label,
coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), nullif(trim(url), ''), '') AS definition FROM pages""")
def completeness_case(spark, sf_dir):
    g = p.table(spark, sf_dir, "pages")
    return g.select("page_id", texts.completeness(F.col("html")).alias("completeness_label"), S.first_filled(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.col("url")).alias("definition"))


@query(f"""WITH {p.SEGMENTS} SELECT segment, md5({p.rc_sql("seq")}) AS rc_md5, round({p.gc_sql("seq")}, 6) AS gc_fraction, {p.run_sql("seq")} AS longest_run, contains(seq, 'TTTT') AS has_polyt, regexp_full_match(seq, '[ACGT]*') AS is_concrete FROM segments""")
def revcomp_gc_flags(spark, sf_dir):
    s, q = p.segments(spark, sf_dir), F.col("seq")
    return s.select("segment", F.md5(S.revcomp(q).cast("binary")).alias("rc_md5"), F.round(S.gc_fraction(q), 6).alias("gc_fraction"), S.max_homopolymer_run(q).alias("longest_run"), S.has_polyt(q).alias("has_polyt"), S.is_concrete(q).alias("is_concrete"))


@query(f"WITH {p.SEGMENTS}, {p.sites_sql('s', 'segments', 'gene, segment', p.CAS)} SELECT * FROM s")
def sites_plus_minus(spark, sf_dir):
    return K.sites(p.segments(spark, sf_dir), "seq", p.CAS)


@query(f"WITH {p.guides_sql()} SELECT * FROM guides")
def guide_table(spark, sf_dir):
    return p.guides(spark, sf_dir)


def _grammar_query(name: str):
    g = GRAMMARS[name]

    def run(spark, sf_dir):
        found = K.sites(p.records(spark, sf_dir).select("seq_id", "seq"), "seq", g)
        return found.groupBy("seq_id", "strand").agg(F.count(F.lit(1)).alias("n_sites"), F.count_distinct("target").alias("n_distinct"), F.min("start0").alias("first_start"))

    run.__name__ = f"sites_grammar_{g.pam.lower()}"
    sql = f"WITH {p.RECORDS}, {p.sites_sql('s', 'records', 'seq_id', g)} SELECT seq_id, strand, count(*) AS n_sites, count(DISTINCT target) AS n_distinct, min(start0) AS first_start FROM s GROUP BY ALL"
    query(sql)(run)


_grammar_query("sacas9")
_grammar_query("sacas9_relaxed")


@query(f"WITH {p.BASE} SELECT seq_id, guide_id FROM found")
def presence_long(spark, sf_dir):
    return p.found(spark, sf_dir)


@query(f"WITH {p.BASE} SELECT seq_id, guide_id FROM found")
def presence_naive_equiv(spark, sf_dir):
    return P.presence_by_search(p.records(spark, sf_dir), p.guides(spark, sf_dir))


@query(f"""WITH {p.RECORDS}, {p.sites_sql("s", "records", "seq_id", p.CAS)}, d AS (SELECT target, count(DISTINCT seq_id) AS n_records FROM s GROUP BY target)
SELECT n_records, count(*) AS n_targets FROM d GROUP BY n_records""")
def site_document_frequency(spark, sf_dir):
    """All sites of all records as the dictionary: how many targets stand in how many records."""
    s = K.sites(p.records(spark, sf_dir).select("seq_id", "seq"), "seq", p.CAS).select("seq_id", "target").distinct()
    return s.groupBy("target").agg(F.count(F.lit(1)).alias("n_records")).groupBy("n_records").agg(F.count(F.lit(1)).alias("n_targets"))


@query(f"WITH {p.ALL} SELECT guide_id, target, n_present, n_total, conservation_fraction, absent_in FROM scored")
def conservation(spark, sf_dir):
    r, g = p.records(spark, sf_dir), p.guides(spark, sf_dir)
    return P.conservation(r, g, P.presence(r, g, p.CAS))


_RANK = """row_number() OVER (ORDER BY conservation_fraction DESC, passes DESC, has_polyt, max_homopolymer_run, abs(gc_fraction - (0.35 + 0.75) / 2), gene, ref_start, strand, guide_id)"""
_REPORT = f"""report AS (SELECT *, {_RANK} AS rank FROM (SELECT *, gc_fraction BETWEEN 0.35 AND 0.75 AS gc_in_range, conservation_fraction >= 0.001 AND passes_filters AS passes FROM pool))"""


def _report(spark, sf_dir):
    r, g = p.records(spark, sf_dir), p.guides(spark, sf_dir)
    return P.ranked_report(g, P.conservation(r, g, P.presence(r, g, p.CAS)), min_conservation=0.001)


@query(f"WITH {p.ALL}, {_REPORT} SELECT rank, guide_id, gene, strand, ref_start, ref_end, cut_site_ref, target, gc_fraction, gc_in_range, max_homopolymer_run, has_polyt, n_present, n_total, conservation_fraction, passes AS passes_filters, n_copies, all_positions, absent_in FROM report")
def ranked_guides(spark, sf_dir):
    return _report(spark, sf_dir).select("rank", "guide_id", "gene", "strand", "ref_start", "ref_end", "cut_site_ref", "target", "gc_fraction", "gc_in_range", "max_homopolymer_run", "has_polyt", "n_present", "n_total", "conservation_fraction", "passes_filters", "n_copies", "all_positions", "absent_in")


@query(f"""WITH {p.ALL}, {_REPORT} SELECT count(*) AS n_guides, coalesce(max(n_total), 0) AS n_total, count_if(conservation_fraction >= 1) AS n_ge_1_0, count_if(conservation_fraction >= 0.99) AS n_ge_0_99,
count_if(conservation_fraction >= 0.95) AS n_ge_0_95, count_if(conservation_fraction >= 0.9) AS n_ge_0_9, count_if(conservation_fraction >= 0.5) AS n_ge_0_5, count_if(conservation_fraction <= 0) AS n_zero,
round(avg(conservation_fraction), 6) AS mean, round(median(conservation_fraction), 6) AS median, round(min(conservation_fraction), 6) AS least,
count_if(has_polyt) AS n_polyt, count_if(NOT gc_in_range) AS n_gc_out, count_if(passes) AS n_passing FROM report""")
def report_summary(spark, sf_dir):
    return P.report_summary(_report(spark, sf_dir))


_LIMITS = [0.0, 0.001, 0.005, 0.01, 0.05, 0.1, None]
_LIMIT_SQL = ", ".join(f"({i}, {'NULL' if t is None else t}, '{'none' if t is None else f'{t:g}'}')" for i, t in enumerate(_LIMITS))


@query(f"""WITH {p.BASE}, lim(i, t, max_ambiguous) AS (VALUES {_LIMIT_SQL}),
kept AS (SELECT i, seq_id FROM lim JOIN records ON t IS NULL OR ambiguous_fraction <= t),
sizes AS (SELECT i, count(*) AS n FROM kept GROUP BY i),
perfect AS (SELECT i, count(*) AS k FROM (SELECT k.i, guide_id, count(*) AS c FROM kept k JOIN found f ON k.seq_id = f.seq_id GROUP BY ALL) h JOIN sizes USING (i) WHERE c = n GROUP BY i)
SELECT max_ambiguous, coalesce(n, 0) AS n_records, (SELECT count(*) FROM records) - coalesce(n, 0) AS n_dropped, coalesce(k, 0) AS n_perfect, round(100.0 * coalesce(k, 0) / greatest(1, (SELECT count(*) FROM guides)), 3) AS pct_perfect
FROM lim LEFT JOIN sizes USING (i) LEFT JOIN perfect USING (i)""")
def ambiguity_sweep(spark, sf_dir):
    r, g = p.records(spark, sf_dir), p.guides(spark, sf_dir)
    return P.subset_sweep(r, P.presence(r, g, p.CAS), g.count(), _LIMITS)


@query(f"""WITH {p.BASE}, c AS (SELECT seq_id, CASE WHEN length_bp < 500 THEN 'not_covered' WHEN n_ambiguous > 0 THEN 'ambiguous' ELSE 'resolved' END AS k FROM records),
m AS (SELECT g.guide_id, c.k, f.seq_id IS NOT NULL AS here FROM guides g CROSS JOIN c LEFT JOIN found f ON f.guide_id = g.guide_id AND f.seq_id = c.seq_id),
s AS (SELECT guide_id, count(*) AS n_total, count_if(here) AS n_present, count_if(NOT here AND k = 'resolved') AS n_absent, count_if(NOT here AND k = 'ambiguous') AS n_ambiguous, count_if(NOT here AND k = 'not_covered') AS n_not_covered FROM m GROUP BY guide_id)
SELECT *, round(n_present / n_total, 6) AS conservation_strict, round(n_present / nullif(n_present + n_absent, 0), 6) AS conservation_tolerant FROM s""")
def status_counts(spark, sf_dir):
    r, g = p.records(spark, sf_dir), p.guides(spark, sf_dir)
    classed = r.withColumn("record_class", F.when(F.col("length_bp") < 500, "not_covered").when(F.col("n_ambiguous") > 0, "ambiguous").otherwise("resolved"))
    return P.status_counts(classed, g, P.presence(r, g, p.CAS))


_LOCAL = ", ".join(f"round({p.gc_sql(f'substring(seq, greatest(0, m - {w // 2}) + 1, least(length(seq), m + {w // 2}) - greatest(0, m - {w // 2}))')}, 4) AS local_gc_{w}" for w in (100, 200, 300))


@query(f"WITH {p.guides_sql()} SELECT guide_id, {_LOCAL} FROM (SELECT g.guide_id, s.seq, (ref_start - 1 + ref_end) // 2 AS m FROM guides g JOIN segments s ON g.segment = s.segment)")
def local_gc(spark, sf_dir):
    return K.local_gc(p.guides(spark, sf_dir), p.segments(spark, sf_dir)).select("guide_id", "local_gc_100", "local_gc_200", "local_gc_300")


_LEADS = {"g0": 0.001, "g2": 0.0015, "g4": 0.002}
_LEAD_SQL = "CASE gene " + " ".join(f"WHEN '{g}' THEN {t}" for g, t in _LEADS.items()) + " ELSE 1.1 END"


@query(f"""WITH {p.ALL} SELECT guide_id, gene, conservation_fraction, passes_filters,
row_number() OVER (PARTITION BY gene ORDER BY conservation_fraction DESC, passes_filters DESC, has_polyt, max_homopolymer_run, abs(gc_fraction - (0.35 + 0.75) / 2), ref_start, strand, guide_id) AS rank_in_gene,
rank() OVER (PARTITION BY gene ORDER BY conservation_fraction DESC) - 1 AS n_better_in_gene, conservation_fraction > {_LEAD_SQL} AS beats_lead FROM pool""")
def pool_ranked(spark, sf_dir):
    return P.ranked_pool(p.pool(spark, sf_dir), _LEADS).select("guide_id", "gene", "conservation_fraction", "passes_filters", "rank_in_gene", "n_better_in_gene", "beats_lead")


@query(f"""WITH {p.ALL}, w AS (SELECT gene, max(n_copies) AS most, count(*) AS s0, count_if(a) AS s1, count_if(a AND b) AS s2, count_if(a AND b AND c) AS s3, count_if(a AND b AND c AND d) AS s4, count_if(a AND b AND c AND d AND e) AS s5
FROM (SELECT gene, n_copies, conservation_fraction > 0.0005 AS a, NOT has_polyt AS b, max_homopolymer_run <= 4 AS c, gc_fraction BETWEEN 0.35 AND 0.75 AS d, n_copies >= 2 AS e FROM pool) GROUP BY gene),
steps(step, "constraint") AS (VALUES (0, 'all sites'), (1, 'conserved'), (2, 'no poly-T'), (3, 'short runs'), (4, 'gc in range'), (5, 'in several copies'))
SELECT gene, step, "constraint", CASE step WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3 WHEN 4 THEN s4 ELSE s5 END AS n_sites FROM w CROSS JOIN steps WHERE step < 5 OR most >= 2""")
def filter_cascade(spark, sf_dir):
    return P.filter_cascade(p.pool(spark, sf_dir), 0.0005)


@query(f"""WITH {p.ALL}, l AS (SELECT guide_id AS left_id, conservation_fraction AS left_c, n_present AS n_left FROM pool WHERE gene IN ('g0', 'g1', 'g2')), r AS (SELECT guide_id AS right_id, conservation_fraction AS right_c, n_present AS n_right FROM pool WHERE gene IN ('g3', 'g4')),
b AS (SELECT x.guide_id AS left_id, y.guide_id AS right_id, count(*) AS n_both FROM found x JOIN found y ON x.seq_id = y.seq_id GROUP BY ALL),
j AS (SELECT l.*, r.*, coalesce(n_both, 0) AS n_both, n_total FROM l CROSS JOIN r CROSS JOIN total LEFT JOIN b ON b.left_id = l.left_id AND b.right_id = r.right_id)
SELECT left_id, right_id, left_c, right_c, n_left, n_right, n_both, n_total - (n_left + n_right - n_both) AS n_neither, n_left + n_right - n_both AS n_any, round(n_both / n_total, 6) AS joint,
row_number() OVER (ORDER BY round(n_both / n_total, 6) DESC, least(left_c, right_c) DESC, left_c DESC, right_c DESC, left_id, right_id) AS rank FROM j""")
def pair_joint(spark, sf_dir):
    r, g = p.records(spark, sf_dir), p.pool(spark, sf_dir)
    return P.pair_counts(P.presence(r, g, p.CAS), g.where(F.col("gene").isin("g0", "g1", "g2")), g.where(F.col("gene").isin("g3", "g4")), r.count())


_SUBSETS = {"all": "true", "passing": "passes_filters", "conserved": "conservation_fraction > 0"}


@query(f"WITH {p.ALL} " + " UNION ALL ".join(f"SELECT gene, '{n}' AS subset, count(*) AS n_sites, count_if(passes_filters) AS n_passing, min(gc_fraction) AS gc_min, median(gc_fraction) AS gc_median, max(gc_fraction) AS gc_max FROM pool WHERE {c} GROUP BY gene" for n, c in _SUBSETS.items()))
def subset_stats(spark, sf_dir):
    g, out = p.pool(spark, sf_dir), None
    for name, cond in _SUBSETS.items():
        part = g.where(cond).groupBy("gene").agg(F.count(F.lit(1)).alias("n_sites"), F.count_if("passes_filters").alias("n_passing"), F.min("gc_fraction").alias("gc_min"), F.median("gc_fraction").alias("gc_median"), F.max("gc_fraction").alias("gc_max"))
        part = part.select("gene", F.lit(name).alias("subset"), "n_sites", "n_passing", "gc_min", "gc_median", "gc_max")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {p.RECORDS}, k AS (SELECT seq_id, substring(seq, q + 1, 21) AS w FROM (SELECT seq_id, seq, unnest(range(0, greatest(0, length(seq) - 20))) AS q FROM records))
SELECT seq_id, count(*) AS n_kmers, count(DISTINCT c) AS n_canonical, min(h) AS least_hash FROM (SELECT seq_id, c, {p.word_hash_sql("c")} AS h FROM (SELECT seq_id, least(w, {p.rc_sql("w")}) AS c FROM k WHERE regexp_full_match(w, '[ACGT]+'))) GROUP BY seq_id""")
def kmer_canonical(spark, sf_dir):
    return scan.kmer_totals(p.records(spark, sf_dir).select("seq_id", "seq"), 21)


@query(r"""WITH t(segment_id, start0, end0, spelled) AS (VALUES (1, 9, 32, '10-32(+);5000-5022(-)'), (2, 100, 123, ''), (3, 5, 28, 'x;6-28(-);6-28(-)'), (4, 7, 30, NULL)),
each AS (SELECT segment_id, unnest(regexp_extract_all(coalesce(spelled, ''), '\d+-\d+\([+-]\)')) AS x FROM t),
spans AS (SELECT DISTINCT segment_id, regexp_extract(x, '^(\d+)', 1)::INT - 1 AS a, regexp_extract(x, '-(\d+)', 1)::INT AS b FROM each),
listed AS (SELECT segment_id, string_agg(a || ':' || b, ',' ORDER BY a, b) AS l FROM spans GROUP BY segment_id)
SELECT segment_id, coalesce(l, start0 || ':' || end0) AS spans FROM t LEFT JOIN listed USING (segment_id)""")
def footprints(spark, sf_dir):
    rows = spark.createDataFrame([(1, 9, 32, "10-32(+);5000-5022(-)"), (2, 100, 123, ""), (3, 5, 28, "x;6-28(-);6-28(-)"), (4, 7, 30, None)], "segment_id int, start0 int, end0 int, spelled string")
    spans = S.footprints(F.col("spelled"), F.col("start0") + 1, F.col("end0"))
    return rows.select("segment_id", F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))


@query("""SELECT page_id, regexp_extract(html, 'href="([^"]*)"', 1) AS attribute, try_cast(nullif(regexp_extract(html, '(1[89]\\d{2}|20\\d{2})', 1), '') AS INT) AS year FROM pages""".replace("\\\\", "\\"))
def attribute_and_year(spark, sf_dir):
    g = p.table(spark, sf_dir, "pages")
    return g.select("page_id", F.regexp_extract("html", 'href="([^"]*)"', 1).alias("attribute"), S.year_of(F.col("html")).alias("year"))


@query(f"""WITH {p.RECORDS}, c AS (SELECT seq_id, substring(seq, 3 * i + 1, 3) AS codon FROM (SELECT seq_id, seq, unnest(range(0, length(seq) // 3)) AS i FROM records)),
code(codon, aa) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in sorted(S.CODON.items()))})
SELECT seq_id, count(*) AS n_codons, count_if(coalesce(aa, 'X') = '*') AS n_stops, count_if(aa IS NULL) AS n_unknown, count_if(aa = 'M') AS n_met FROM c LEFT JOIN code USING (codon) GROUP BY seq_id""")
def translated(spark, sf_dir):
    r = p.records(spark, sf_dir).where("length_bp >= 3").withColumn("aa", S.translate_codons(F.col("seq")))
    n = lambda ch: S.count_of(F.col("aa"), ch).cast("long")
    return r.select("seq_id", F.length("aa").cast("long").alias("n_codons"), n("*").alias("n_stops"), n("X").alias("n_unknown"), n("M").alias("n_met"))
