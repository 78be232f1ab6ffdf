"""Gene-level analysis, coding sequences, offtarget reports and small tables as queries.

Documents stand for records that each cover a part of the reference: a record's spans, class and doubtful statuses follow
from its id, so that SQL can hold the operators; segments lie on the reference 400 bases apart.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions.grammar import pam_class
from ..operators import approx as A
from ..operators import chains as C
from ..operators import corpus as Q
from ..operators import presence as P
from ..operators import select as X
from . import model_queries as mq
from . import prelude as p

QUERIES: dict = {}
SQL: dict[str, str] = {}
CLASSES = ("subgenomic", "partial_genome")
_APART = 400


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- records that cover a part ---------------------------------------------------------------------------------------

_PARTS = f"""placed AS (SELECT guide_id, gene, target, segment * {_APART} + ref_start - 1 AS start FROM guides),
classed AS (SELECT seq_id, length_bp, CASE WHEN seq_id % 3 = 0 THEN 'partial_genome' ELSE 'subgenomic' END AS record_class FROM records),
one AS (SELECT seq_id, seq_id * 613 % 80000 AS low, seq_id * 613 % 80000 + 500 + length_bp % 1500 AS high FROM records WHERE length_bp >= 25),
spans AS (SELECT * FROM one UNION ALL SELECT seq_id, high + 700, high + 1000 FROM one WHERE seq_id % 4 = 0),
reach AS (SELECT seq_id, min(low) AS low, max(high) AS high FROM spans GROUP BY seq_id),
asked AS (SELECT seq_id, guide_id, (seq_id * 7 + start) % 4 + 1 AS said FROM reach JOIN placed ON start BETWEEN low - 25 AND high + 25),
status AS (SELECT seq_id, guide_id, CASE WHEN f.seq_id IS NOT NULL THEN 0 ELSE said END AS status FROM asked FULL JOIN (SELECT DISTINCT seq_id, guide_id FROM found) f USING (seq_id, guide_id)),
genes AS (SELECT gene, segment * {_APART} AS s, segment * {_APART} + length(seq) AS e FROM segments)"""
_COUNTED = """counted_sites AS (SELECT guide_id, coalesce(count_if(status <= 1), 0) AS n_covering, coalesce(count_if(status = 0), 0) AS n_present, coalesce(count_if(status = 1), 0) AS n_absent, coalesce(count_if(status = 2), 0) AS n_ambiguous,
  coalesce(count_if(status = 3), 0) AS n_wide, coalesce(count_if(status = 4), 0) AS n_not_covered, count(status) AS n_asked, """ + ", ".join(f"coalesce(count_if(status <= 1 AND record_class = '{c}'), 0) AS n_covering_{c}, coalesce(count_if(status = 0 AND record_class = '{c}'), 0) AS n_present_{c}" for c in CLASSES) + """
  FROM placed LEFT JOIN (SELECT * FROM status JOIN classed USING (seq_id)) USING (guide_id) GROUP BY guide_id),
ratios AS (SELECT c.*, gene, CASE WHEN n_covering > 0 THEN round(n_present / n_covering, 6) END AS conservation, CASE WHEN n_asked > 0 THEN round(n_present / n_asked, 6) END AS conservation_asked, """ + ", ".join(f"CASE WHEN n_covering_{c} > 0 THEN round(n_present_{c} / n_covering_{c}, 6) END AS conservation_{c}" for c in CLASSES) + """
  FROM counted_sites c JOIN placed USING (guide_id))"""  # fmt: skip
_MANIFEST = """manifest AS (SELECT seq_id, record_class, length_bp, coalesce(n, 0) AS n_chains, coalesce(low + 1, -1) AS span_start, coalesce(high, -1) AS span_end, coalesce(names, '') AS genes_covered, coalesce(k, 0) AS n_scored
  FROM classed LEFT JOIN (SELECT seq_id, count(*) AS n, min(low) AS low, max(high) AS high FROM spans GROUP BY seq_id) USING (seq_id)
  LEFT JOIN (SELECT seq_id, string_agg(DISTINCT gene, '|' ORDER BY gene) AS names FROM spans JOIN genes ON low < e AND high > s GROUP BY seq_id) USING (seq_id)
  LEFT JOIN (SELECT seq_id, count(*) AS k FROM status WHERE status <= 1 GROUP BY seq_id) USING (seq_id))"""


class _Parts:
    """The derived tables of one call."""

    def __init__(self, spark, sf_dir):
        r = p.records(spark, sf_dir)
        self.guides = p.guides(spark, sf_dir)
        self.found = P.presence(r, self.guides, p.CAS)
        kind = F.when(F.col("seq_id") % 3 == 0, "partial_genome").otherwise("subgenomic")
        self.records = r.select("seq_id", "length_bp", kind.alias("record_class"))
        low = F.col("seq_id") * 613 % 80000
        one = r.where("length_bp >= 25").select("seq_id", low.alias("low"), (low + 500 + F.col("length_bp") % 1500).alias("high"))
        self.spans = one.unionByName(one.where("seq_id % 4 = 0").select("seq_id", (F.col("high") + 700).alias("low"), (F.col("high") + 1000).alias("high")))
        self.placed = self.guides.select("guide_id", "gene", "target", (F.col("segment") * _APART + F.col("ref_start") - 1).alias("start"))
        seg = p.segments(spark, sf_dir)
        self.genes = seg.select("gene", (F.col("segment") * _APART).alias("start"), (F.col("segment") * _APART + F.length("seq")).alias("end"))

    def status(self):
        reach = self.spans.groupBy("seq_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        pairs = Q.band_pairs(reach, self.placed).join(F.broadcast(self.placed.select("guide_id", "start")), "guide_id")
        return Q.with_hits(pairs.select("seq_id", "guide_id", ((F.col("seq_id") * 7 + F.col("start")) % 4 + 1).cast("int").alias("status")), self.found)

    def counts(self):
        return Q.guide_counts(self.status(), self.records, self.guides, CLASSES)

    def manifest(self):
        return Q.record_manifest(self.records, self.spans, self.genes, self.status())


@query(f"WITH {p.BASE}, {_PARTS}, {_COUNTED} SELECT * FROM ratios")
def gene_band_counts(spark, sf_dir):
    """Per guide the records by status and class, over four denominators."""
    return _Parts(spark, sf_dir).counts()


@query(f"WITH {p.BASE}, {_PARTS}, {_MANIFEST} SELECT * FROM manifest")
def gene_manifest(spark, sf_dir):
    return _Parts(spark, sf_dir).manifest()


@query(f"WITH {p.BASE}, {_PARTS}, {_MANIFEST} SELECT record_class, count(*) AS n_records, count_if(n_chains > 0) AS n_mapped, count_if(genes_covered <> '') AS n_covering_a_gene, CAST(floor(median(length_bp)) AS INT) AS median_bp FROM manifest GROUP BY record_class")
def corpus_composition(spark, sf_dir):
    return Q.composition(_Parts(spark, sf_dir).manifest())


@query(f"""WITH {p.BASE}, {_PARTS}, {_MANIFEST}, each AS (SELECT unnest(string_split(genes_covered, '|')) AS gene, record_class, length_bp FROM manifest)
SELECT gene, count(record_class) AS n_records, """ + ", ".join(f"count_if(coalesce(record_class = '{c}', false)) AS n_{c}" for c in CLASSES) + """, coalesce(CAST(floor(median(length_bp)) AS INT), 0) AS median_bp FROM (SELECT DISTINCT gene FROM genes) LEFT JOIN each USING (gene) GROUP BY gene""")
def gene_records(spark, sf_dir):
    x = _Parts(spark, sf_dir)
    return Q.gene_records(x.manifest(), x.genes, CLASSES)


_TIER_COLUMNS = [("whole_corpus", "conservation", "n_covering"), ("subgenomic_only", "conservation_subgenomic", "n_covering_subgenomic"), ("partial_genomes_only", "conservation_partial_genome", "n_covering_partial_genome"), ("no_coverage_correction", "conservation_asked", "n_covering")]


def _tiers_sql() -> str:
    from ..operators.denominators import compare_sql

    each = []
    for name, value, number in _TIER_COLUMNS:
        rows = f"(SELECT guide_id, conservation_fraction AS x, {value} AS y, {number} AS records FROM scored JOIN ratios USING (guide_id) WHERE {value} IS NOT NULL)"
        each.append(f"SELECT '{name}' AS tier, * FROM ({compare_sql(rows)})")
    return " UNION ALL ".join(each)


@query(f"WITH {p.ALL}, {_PARTS}, {_COUNTED} {_tiers_sql()}")
def denominator_tiers(spark, sf_dir):
    """The strict conservation against that of each tier, for guides with enough records."""
    x = _Parts(spark, sf_dir)
    base = p.scored(spark, sf_dir).select("guide_id", F.col("conservation_fraction").alias("x"))
    from ..session import cut

    return Q.tiers(base, cut(x.counts()).drop("gene"), _TIER_COLUMNS)


@query(f"""WITH {p.BASE}, {_PARTS}, names AS (SELECT DISTINCT protospacer AS name, split_part(gene, '|', 1) AS gene FROM guides WHERE segment % 5 = 0),
held AS (SELECT DISTINCT f.seq_id, protospacer AS name FROM found f JOIN guides USING (guide_id) JOIN names ON name = protospacer),
cover AS (SELECT DISTINCT seq_id, gene FROM spans JOIN genes ON low < e AND high > s), asked_names AS (SELECT seq_id, name FROM cover JOIN names USING (gene) UNION SELECT seq_id, name FROM held)
SELECT *, CASE WHEN n_covering > 0 THEN round(n_present / n_covering, 4) END AS conservation FROM (SELECT name, gene, (SELECT count(*) FROM asked_names a WHERE a.name = n.name) AS n_covering, (SELECT count(*) FROM held h WHERE h.name = n.name) AS n_present FROM names n)""")
def benchmark_guides(spark, sf_dir):
    """Known spacers (those of every fifth segment): records that cover them or their gene, and that hold them."""
    x = _Parts(spark, sf_dir)
    known = x.guides.where("segment % 5 = 0").select(F.col("protospacer").alias("name"), F.split("gene", r"\|")[0].alias("gene")).distinct()
    spelled = x.guides.select("guide_id", F.col("protospacer").alias("name")).join(F.broadcast(known.select("name")), "name", "left_semi")
    hits = x.found.join(F.broadcast(spelled), "guide_id").select("seq_id", "name")
    return Q.benchmark_rows(known, hits, Q.touched(x.spans, x.genes))


@query(f"""WITH {p.ALL}, {_PARTS}, {_COUNTED}, t AS (SELECT guide_id, n_present, n_present + n_absent + n_ambiguous AS n_total, n_covering AS n_resolved FROM ratios)
SELECT count_if(n_present = n_total) AS n_perfect_strict, count_if(n_resolved > 0 AND n_present = n_resolved) AS n_perfect_tolerant, count_if(n_resolved > 0 AND n_present = n_resolved AND n_present < n_total) AS n_rescued FROM t""")
def perfect_totals(spark, sf_dir):
    c = _Parts(spark, sf_dir).counts()
    return Q.perfect_totals(c.select("n_present", (F.col("n_present") + F.col("n_absent") + F.col("n_ambiguous")).alias("n_total"), F.col("n_covering").alias("n_resolved")))


@query(f"WITH {p.BASE}, {_PARTS}, {_COUNTED} SELECT gene, count(*) AS n_guides, count_if(n_present = n_covering) AS n_perfect FROM ratios GROUP BY gene")
def perfect_by_gene(spark, sf_dir):
    return Q.perfect_by_gene(_Parts(spark, sf_dir).counts().select("gene", "n_present", F.col("n_covering").alias("n_total"))).orderBy("gene")


# --- coding sequences --------------------------------------------------------------------------------------------------

_CDS = f"""whole AS (SELECT string_agg(rpad(seq, {_APART}, 'N'), '' ORDER BY segment) AS t FROM (SELECT s.i AS segment, coalesce(substring(seq, 1, {_APART}), '') AS seq FROM range(0, (SELECT max(segment) + 1 FROM segments)) s(i) LEFT JOIN segments ON segment = s.i)),
copies AS (SELECT gene, row_number() OVER (PARTITION BY gene ORDER BY segment)::INT - 1 AS copy, CASE WHEN segment % 2 = 0 THEN 1 ELSE -1 END AS strand, segment * {_APART} AS o, least(length(seq), {_APART}) AS n FROM segments WHERE length(seq) >= 30),
walked AS (SELECT gene, copy, strand, CASE WHEN strand = 1 THEN list_concat(range(o, o + n // 3), range(o + n // 3 + 4, o + n)) ELSE list_concat(list_reverse(range(o + n // 3 + 4, o + n)), list_reverse(range(o, o + n // 3))) END AS positions FROM copies),
spelt AS (SELECT gene, copy, strand, positions, CASE WHEN strand = 1 THEN b ELSE translate(b, 'ACGT', 'TGCA') END AS cds FROM (SELECT *, array_to_string([substring(t, x + 1, 1) FOR x IN positions], '') AS b FROM walked, whole))"""
_AMINO = "list_aggregate([coalesce(map_extract_value(code, substring(cds, (3 * i + 1)::INT, 3)), 'X') FOR i IN range(0, length(cds) // 3)], 'string_agg', '')"
_CODE = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sorted(S.CODON.items())) + "}"


def _copies(spark, sf_dir):
    seg = p.segments(spark, sf_dir)
    last = seg.agg(F.max("segment")).first()[0]
    every = spark.range(0, (last if last is not None else -1) + 1).withColumnRenamed("id", "segment").join(seg.select("segment", F.substring("seq", 1, _APART).alias("seq")), "segment", "left")
    whole = every.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", F.rpad(F.coalesce("seq", F.lit("")), _APART, "N").alias("t")))), lambda x: x["t"]), "").alias("seq"))
    n, o = F.least(F.length("seq"), F.lit(_APART)), F.col("segment") * _APART
    from pyspark.sql import Window as W

    c = seg.where(F.length("seq") >= 30).select("gene", (F.row_number().over(W.partitionBy("gene").orderBy("segment")) - 1).alias("copy"), F.when(F.col("segment") % 2 == 0, 1).otherwise(-1).alias("strand"), o.cast("int").alias("o"), n.alias("n"))
    third = F.floor(F.col("n") / 3).cast("int")
    low, high = F.struct(F.col("o").alias("start"), (F.col("o") + third).alias("end")), F.struct((F.col("o") + third + 4).alias("start"), (F.col("o") + F.col("n")).alias("end"))
    parts = c.select("gene", "copy", "strand", F.posexplode(F.when(F.col("strand") > 0, F.array(low, high)).otherwise(F.array(high, low))).alias("part", "x")).select("gene", "copy", "strand", "part", "x.*")
    return C.cds_copies(parts, whole, strict=False), whole


@query(f"""WITH {p.SEGMENTS}, {_CDS}, code AS (SELECT {_CODE} AS code), told AS (SELECT *, {_AMINO} AS protein FROM spelt, code)
SELECT gene, copy, strand, len(positions) AS n_positions, cds, protein, length(cds) % 3 = 0 AND starts_with(protein, 'M') AND ends_with(protein, '*') AND length(protein) - length(replace(protein, '*', '')) = 1 AS valid FROM told""")
def cds_copies(spark, sf_dir):
    """Two parts of each segment as a coding sequence: its bases in reading order, its protein and whether that is a clean one."""
    return _copies(spark, sf_dir)[0].select("gene", "copy", "strand", F.size("positions").alias("n_positions"), "cds", "protein", "valid")


@query(f"""WITH {p.guides_sql()}, {_CDS}, places AS (SELECT gene, pos, arg_max(codon, copy) AS codon FROM (SELECT gene, copy, unnest(positions) AS pos, (unnest(range(0, len(positions))) // 3)::INT AS codon FROM walked) GROUP BY gene, pos),
s AS (SELECT guide_id, split_part(gene, '|', 1) AS gene, strand, segment * {_APART} + ref_start - 1 AS a, segment * {_APART} + ref_end AS b FROM guides), c AS (SELECT *, CASE WHEN strand = '+' THEN b - 6 ELSE a + 5 END AS cut, (a + b) // 2 AS middle FROM s),
foot AS (SELECT guide_id, arg_min(codon, pos) AS codon FROM c JOIN places USING (gene) WHERE pos >= a AND pos < b GROUP BY guide_id)
SELECT guide_id, coalesce((SELECT codon FROM places x WHERE x.gene = c.gene AND pos = cut), (SELECT codon FROM places x WHERE x.gene = c.gene AND pos = middle), (SELECT codon FROM foot WHERE foot.guide_id = c.guide_id), 0) AS codon FROM c""")
def cut_codons(spark, sf_dir):
    """The codon of each site's cut, with its fallbacks."""
    copies, _ = _copies(spark, sf_dir)
    g = p.guides(spark, sf_dir)
    moved = g.select("guide_id", F.split("gene", r"\|")[0].alias("gene"), "strand", (F.col("segment") * _APART + F.col("ref_start")).alias("ref_start"), (F.col("segment") * _APART + F.col("ref_end")).alias("ref_end"))
    return C.cut_codons(moved, F.broadcast(C.codon_places(copies)), 3)


# --- offtarget reports --------------------------------------------------------------------------------------------------


@query(f"""WITH {mq._ALL_SITES}, c AS (SELECT guide_id, mismatches AS m, CASE WHEN substring(target, 21, 1) = 'T' THEN 'strict' ELSE 'relaxed' END AS k, start0 % 5 = 0 AS cds FROM near)
SELECT g.guide_id, """ + ", ".join(f"coalesce(count_if(m = {i} AND k = '{k}'), 0) AS mm{i}_{k}" for k in ("strict", "relaxed") for i in range(4)) + """, coalesce(count_if(m <= 2), 0) AS n_le2, coalesce(count_if(m <= 2 AND cds), 0) AS n_le2_in_cds FROM guides g LEFT JOIN c USING (guide_id) GROUP BY g.guide_id""")
def approx_by_pam(spark, sf_dir):
    """Per guide the hits at each distance by the class of their PAM (here by its first base), and those near and in a coding part."""
    hits, g = mq._near(spark, sf_dir)
    told = hits.withColumn("pam_class", pam_class(F.substring("target", 21, 3), 1, "T", "strict", "relaxed")).withColumn("in_cds", F.col("start0") % 5 == 0)
    return A.summary_by_class(told, g, 3, ("strict", "relaxed"), 2)


_LOCI = (("PROMO", "cheap"), ("widget", "common"), ("rod", "long"))


@query("""WITH loci(gene, note) AS (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in _LOCI) + """),
hits AS (SELECT p_size % 4 AS mismatches, p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' (21 nt)' ELSE '' END AS label, replace(p_type, ' ', ', ') AS cds_genes, replace(p_name, ' ', ',') AS gene_names FROM part),
each AS (SELECT trim(unnest(string_split(cds_genes || ',' || gene_names, ','))) AS gene, regexp_replace(label, ' \\(\\d+ nt\\)$', '') AS label, mismatches FROM hits)
SELECT gene, label, min(mismatches) AS mismatches, any_value(note) AS note FROM each JOIN loci USING (gene) GROUP BY gene, label""".replace("\\\\", "\\"))
def notable_loci(spark, sf_dir):
    """Known names in the lists of genes of hits, once for each name and label."""
    t = p.table(spark, sf_dir, "part")
    hits = t.select((F.col("p_size") % 4).alias("mismatches"), F.concat("p_brand", F.when(F.col("p_partkey") % 2 == 0, " (21 nt)").otherwise("")).alias("label"), F.replace("p_type", F.lit(" "), F.lit(", ")).alias("cds_genes"), F.replace("p_name", F.lit(" "), F.lit(",")).alias("gene_names"))
    return Q.notable(hits, F.broadcast(spark.createDataFrame(_LOCI, "gene string, note string")))


@query(r"SELECT lang, count(*) AS n_records, count_if(source IS NULL) AS n_without_source, count_if(coalesce(regexp_extract(text, '(1[89]\d{2}|20\d{2})', 1), '') = '') AS n_without_year, count(DISTINCT text) AS n_variants FROM documents GROUP BY lang")
def missing_metadata(spark, sf_dir):
    """Variants, and records without a source or year, by language."""
    d = p.table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("source").isNull()).alias("n_without_source"), F.count_if(S.year_of(F.col("text")).isNull()).alias("n_without_year"), F.count_distinct("text").alias("n_variants"))


_CURVE = "curve AS (SELECT l_suppkey % 5 AS grp, l_linenumber AS k, sum(CAST(round(l_discount * 100) AS BIGINT)) / (1000.0 * l_linenumber * l_linenumber * count(*)) AS v FROM lineitem GROUP BY l_suppkey % 5, l_linenumber), limits(t) AS (VALUES (0.04), (0.01), (0.0015), (0.000001))"


@query(f"WITH {_CURVE} SELECT grp, t AS \"limit\", min(CASE WHEN v < t THEN k END) AS minimum_k FROM curve CROSS JOIN limits GROUP BY grp, t")
def minimum_k(spark, sf_dir):
    """The first k whose value is under each limit; null where none is."""
    l = p.table(spark, sf_dir, "lineitem")
    curve = l.groupBy((F.col("l_suppkey") % 5).alias("grp"), F.col("l_linenumber").alias("k")).agg((F.sum(F.round(F.col("l_discount") * 100).cast("long")) / (F.lit(1000.0) * F.first("l_linenumber") * F.first("l_linenumber") * F.count(F.lit(1)))).alias("v"))
    return X.first_under(curve, ["grp"], "k", "v", [0.04, 0.01, 0.0015, 0.000001])
