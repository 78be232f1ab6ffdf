"""Gene-level analysis from chains: documents and damaged copies of the annotated segments, laid on the reference that the segments make.

The segments of `benchmark` lie on the reference one slot apart.  Records are all documents and, of every segment, copies with
planted defects (turned round, with unknown bases, with a long insertion, cut off, with a changed base, torn apart), so that every
status occurs whatever passages the documents hold.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import chains as C
from ..operators import corpus as Q
from ..operators import model as M
from ..operators import presence as P
from ..operators import sites as K
from ..operators import stitch as Z
from ..operators import sweep as Y
from ..operators.scan import held_words
from ..session import cut
from . import prelude as p

QUERIES: dict = {}
SQL: dict[str, str] = {}
CLASSES = ("subgenomic", "partial_genome")
WORD, STEP, LEAST_COPY = 25, 4, 120


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def damaged(segments):
    """seq_id and seq of copies of segments (segment, seq) with planted defects."""
    seq = F.col("seq")
    changed = F.translate(F.substring(seq, 81, 1), "ACGTN", "CGTAA")
    kinds = {
        "turned": S.revcomp(seq), "gap": F.overlay(seq, F.repeat(F.lit("N"), F.lit(40)), 61), "wide": F.concat(F.substring(seq, 1, 60), F.repeat(F.lit("ACGGT"), F.lit(460)), F.substr(seq, F.lit(101))),
        "cut": F.substr(seq, F.lit(1), F.floor(F.length("seq") / 2).cast("int")), "changed": F.overlay(seq, changed, 81), "torn": F.concat(F.substring(seq, 1, 60), F.repeat(F.lit("N"), F.lit(700)), F.substr(seq, F.lit(91))),
    }
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), s.alias("seq")) for n, s in kinds.items()])).alias("x")
    return segments.where(F.length("seq") >= LEAST_COPY).select("segment", each).select(F.concat(F.lit("b"), F.col("segment").cast("string"), F.lit("-"), "x.kind").alias("seq_id"), "x.seq")


class Ground:
    """Records and reference of one call."""

    def __init__(self, spark, sf_dir):
        self.segments = p.segments(spark, sf_dir)
        self.slot = (self.segments.agg(F.max(F.length("seq")).alias("n")).first().n or 0) + 100
        at = F.col("segment") * self.slot
        docs = p.records(spark, sf_dir).select(F.concat(F.lit("d"), F.col("seq_id").cast("string")).alias("seq_id"), "seq", F.when(F.col("seq_id") % 3 == 0, "partial_genome").otherwise("subgenomic").alias("record_class"))
        self.records = docs.unionByName(damaged(self.segments).withColumn("record_class", F.lit("partial_genome")))
        self.index = Z.reference_of(self.segments.select(at.alias("start"), "seq"), WORD)


class Corpus(Ground):
    """The derived tables of the gene-level flow; what several tables start from is written once."""

    def __init__(self, spark, sf_dir):
        super().__init__(spark, sf_dir)
        at = F.col("segment") * self.slot
        self.guides = p.guides(spark, sf_dir)
        found = K.sites(self.segments, "seq", p.CAS).select("target", (at + F.col("start0")).alias("start"))
        self.places = found.join(self.guides.select("guide_id", "target"), "target").select("guide_id", (F.col("start") + 1).alias("ref_start"), (F.col("start") + p.CAS.length).alias("ref_end"))
        self.genes = self.segments.select("gene", at.alias("start"), (at + F.length("seq")).alias("end"))
        self.laid = Z.Laid(self.records.select("seq_id", "seq"), self.index, STEP)
        self.hits = cut(P.presence(self.records, self.guides, p.CAS))
        self.status = cut(Q.with_hits(self.laid.statuses(self.places), self.hits))
        self.told = self.laid.told.join(self.records.select("seq_id", "record_class"), "seq_id")

    def counts(self):
        return Q.guide_counts(self.status, self.told, self.guides, CLASSES)

    def manifest(self):
        return Q.record_manifest(self.told, self.laid.spans, self.genes, self.status)


@query()
def chain_site_status(spark, sf_dir):
    """(seq_id, guide_id, status): what every record's chains and exact hits say about the sites in their reach."""
    named = F.element_at(F.array(*[F.lit(n) for n in C.STATUS_NAMES]), F.col("status") + 1)
    return Corpus(spark, sf_dir).status.select("seq_id", "guide_id", named.alias("status"))


@query()
def chain_gene_counts(spark, sf_dir):
    """Per guide the records by status and class, and conservation over four denominators, from chains."""
    return Corpus(spark, sf_dir).counts()


@query()
def chain_gene_manifest(spark, sf_dir):
    """Each record: class, length, unknown bases, direction, chains, reference span, genes, and sites that it resolves."""
    x = Corpus(spark, sf_dir)
    told = x.laid.told.select("seq_id", "n_ambiguous", F.when(F.col("turned"), "-").otherwise("+").alias("strand_vs_reference"))
    return x.manifest().join(told, "seq_id")


@query()
def chain_status_totals(spark, sf_dir):
    """How many pairs of a record and a site have each status, in all and by class: pairs that nothing asked are not covered."""
    x = Corpus(spark, sf_dir)
    n = x.guides.count()
    rows = x.status.join(x.told.select("seq_id", "record_class"), "seq_id").groupBy("record_class", "status").agg(F.count(F.lit(1)).alias("asked"))
    every = x.told.groupBy("record_class").agg((F.count(F.lit(1)) * n).alias("pairs"))
    kinds = spark.range(len(C.STATUS_NAMES)).select(F.col("id").cast("int").alias("status"), F.element_at(F.array(*[F.lit(s) for s in C.STATUS_NAMES]), F.col("id").cast("int") + 1).alias("status_name"))
    full = every.crossJoin(F.broadcast(kinds)).join(rows, ["record_class", "status"], "left").withColumn("asked", F.coalesce("asked", F.lit(0)))
    said = full.groupBy("record_class").agg(F.sum("asked").alias("said"))
    left = F.when(F.col("status") == C.NOT_COVERED, F.col("pairs") - F.col("said")).otherwise(0)
    return full.join(said, "record_class").select("record_class", "status_name", (F.col("asked") + left).alias("n_pairs"), "asked")


@query()
def chain_composition(spark, sf_dir):
    """Record classes: records, those with a chain, those over a gene, and their median length."""
    return Q.composition(Corpus(spark, sf_dir).manifest())


@query()
def chain_gene_records(spark, sf_dir):
    """Each gene: the records whose chains touch it, by class."""
    x = Corpus(spark, sf_dir)
    return Q.gene_records(x.manifest(), x.genes, CLASSES)


# --- whole records, and their codons ---------------------------------------------------------------------------------


def _windows(ground):
    """23-base windows of the segments, one every 20 bases: guide_id, target, ref_start and ref_end on the reference."""
    at = ground.segments.where(F.length("seq") >= 23).select("segment", "seq", F.explode(F.sequence(F.lit(1), F.length("seq") - 22, F.lit(20))).alias("i"))
    start = F.col("segment") * ground.slot + F.col("i")
    return at.select(F.concat(F.lit("site"), F.lpad(start.cast("string"), 9, "0")).alias("guide_id"), start.alias("ref_start"), (start + 22).alias("ref_end"), F.substring(F.col("seq"), F.col("i"), F.lit(23)).alias("target"))


@query()
def anchor_chain_status(spark, sf_dir):
    """(seq_id, guide_id, status) of every record's chains about windows of the reference; pairs without a row are not covered."""
    x = Ground(spark, sf_dir)
    sites = _windows(x)
    mapped = C.laid(x.records, x.index, sites, step=STEP)
    book = sites.where(F.col("target").rlike("^[ACGT]+$")).select("guide_id", "target").collect()  # laid() bounds the sites
    held = held_words(x.records, [r.guide_id for r in book], [r.target for r in book]) if book else x.records.select("seq_id", F.lit("").alias("guide_id")).limit(0)
    return C.classify(mapped, held)


@query()
def chain_manifest(spark, sf_dir):
    """Each record's direction, chains, reached span and sites in reach."""
    x = Ground(spark, sf_dir)
    mapped = C.laid(x.records, x.index, _windows(x), step=STEP)
    reach = lambda f, name: F.coalesce(f(F.transform("chains", lambda c: c[name])), F.lit(-1))
    return mapped.select("seq_id", "turned", "length_bp", "n_ambiguous", F.size("chains").alias("n_chains"), reach(F.array_min, "low").alias("low"), reach(F.array_max, "high").alias("high"), F.size("scored").alias("n_scored"))


def _coding(x):
    """Every segment as a coding sequence: its whole codons, odd segments read backwards."""
    n, o = F.floor(F.length("seq") / 3) * 3, F.col("segment") * x.slot
    forward = F.sequence(o, o + n - 1)
    return x.segments.where("length(seq) >= 30").select(F.concat(F.lit("s"), F.col("segment").cast("string")).alias("gene"), F.lit(0).alias("copy"), F.when(F.col("segment") % 2 == 0, 1).otherwise(-1).alias("strand"), F.when(F.col("segment") % 2 == 0, forward).otherwise(F.reverse(forward)).alias("positions"))


def _profile(spark, sf_dir):
    """The segments' codons in the records; prose has stops anywhere, so they reject nothing."""
    x = Ground(spark, sf_dir)
    return C.codon_profile(x.records, x.index, _coding(x), least=0.8, stops=False, every=False)


@query()
def codon_tolerance(spark, sf_dir):
    """Codons of the segments over all records: resolved, varied, and the two-level tolerance."""
    return C.codon_counts(_profile(spark, sf_dir)).withColumn("tolerance", M.tolerance(F.col("n_aa_variant"), 1, 0.5, 0.05))


@query()
def codon_quality(spark, sf_dir):
    """Per segment the records by verdict, and changes of length; records that hold nothing of it are in no row."""
    return C.profile_quality(_profile(spark, sf_dir))


@query()
def site_table(spark, sf_dir):
    """All sites with the codon of their cut, what varies around it in the records, and the escape from a cut there, in 20 columns."""
    x = Ground(spark, sf_dir)
    copies = _coding(x)
    counts = C.codon_counts(C.codon_profile(x.records, x.index, copies, least=0.8, stops=False, every=False))
    at = F.col("segment") * x.slot
    g = p.guides(spark, sf_dir).where(F.col("segment").isNotNull()).select(
        "guide_id", F.concat(F.lit("s"), F.col("segment").cast("string")).alias("gene"), "strand", (at + F.col("ref_start")).alias("ref_start"), (at + F.col("ref_end")).alias("ref_end"), "protospacer", "pam", F.col("n_copies"), F.col("gc_fraction").alias("gc_content"), "max_homopolymer_run", "has_polyt",
    )
    codons = C.cut_codons(g, P.sized_broadcast(C.codon_places(copies)), len(p.CAS.pam))
    variants = Y.gene_variants(copies.select("gene", F.floor(F.size("positions") / 3).alias("n_codons")), counts)
    h = p.table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") - 4).alias("length")).agg(F.count(F.lit(1)).alias("weight"))
    return Y.site_table(g, codons, variants, Y.spectra(spark, h), Y.one_at_a_time("")[0], essential=("s0", "s1"))


# --- anchors ---------------------------------------------------------------------------------------------------------

_SLOT = "((SELECT max(length(seq)) FROM segments) + 100)"
_FOUND_ANCHORS = f"""rk AS (SELECT w, ref FROM (SELECT substring(seq, q + 1, {WORD}) AS w, segment * {_SLOT} + q AS ref FROM (SELECT segment, seq, unnest(range(0, greatest(0, length(seq) - {WORD - 1}))) AS q FROM segments)) WHERE regexp_full_match(w, '[ACGT]+') QUALIFY count(*) OVER (PARTITION BY w) <= 4),
qk AS (SELECT seq_id, substring(seq, q + 1, {WORD}) AS w, q FROM (SELECT seq_id, seq, unnest(range(0, greatest(0, length(seq) - {WORD - 1}), {STEP})) AS q FROM records)),
anchors AS (SELECT seq_id, ref, q AS qry FROM qk JOIN rk USING (w))"""


def _own_anchors(spark, sf_dir):
    segments = p.segments(spark, sf_dir)
    slot = (segments.agg(F.max(F.length("seq")).alias("n")).first().n or 0) + 100
    index = Z.reference_of(segments.select((F.col("segment") * slot).alias("start"), "seq"), WORD)
    pieces = Z.read_pieces(p.records(spark, sf_dir).select("seq_id", "seq"), index, STEP)
    return pieces.select("seq_id", F.explode("own").alias("x")).select("seq_id", "x.ref", "x.qry"), slot


@query(f"WITH {p.RECORDS}, {p.SEGMENTS}, {_FOUND_ANCHORS} SELECT seq_id, ref, qry FROM anchors")
def chain_anchors(spark, sf_dir):
    """Words of the documents, one in four, that occur at most four times in the reference, with both places."""
    return _own_anchors(spark, sf_dir)[0]


@query(f"""WITH {p.RECORDS}, {p.guides_sql()}, {_FOUND_ANCHORS}, best AS (SELECT seq_id, ref, max(qry) AS last, min(qry) AS first FROM anchors GROUP BY ALL), who AS (SELECT DISTINCT seq_id FROM anchors),
asks AS (SELECT seq_id, guide_id, segment * {_SLOT} + ref_start - 1 - {WORD} AS a, segment * {_SLOT} + ref_end AS z FROM who, guides)
SELECT asks.seq_id, guide_id, b.ref AS before_ref, b.last AS before_qry, n.ref AS after_ref, n.first AS after_qry FROM asks ASOF LEFT JOIN best b ON asks.seq_id = b.seq_id AND asks.a >= b.ref ASOF LEFT JOIN best n ON asks.seq_id = n.seq_id AND asks.z <= n.ref""")
def anchor_neighbours(spark, sf_dir):
    """For each site and each document with an anchor: the nearest anchors wholly before and after it."""
    found, slot = _own_anchors(spark, sf_dir)
    found = cut(found)
    at = F.col("segment") * slot
    g = p.guides(spark, sf_dir).select("guide_id", (at + F.col("ref_start") - 1 - WORD).alias("a"), (at + F.col("ref_end")).alias("z"))
    asks = found.select("seq_id").distinct().crossJoin(P.sized_broadcast(g))  # every such document is asked about every site: that is the result
    points = found.select("seq_id", F.col("ref").alias("pos"), F.col("qry").alias("val"))
    one = Z.nearest(asks, points, ["seq_id"], "a").withColumnRenamed("point", "before")
    two = Z.nearest(one, points, ["seq_id"], "z", forward=True)
    return two.select("seq_id", "guide_id", F.col("before.pos").alias("before_ref"), F.col("before.val").alias("before_qry"), F.col("point.pos").alias("after_ref"), F.col("point.val").alias("after_qry"))
