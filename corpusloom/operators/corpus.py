"""Sites over a corpus of records that each cover only part of the reference: who is asked, who answers, over which denominator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chains import ABSENT, AMBIGUOUS, NOT_COVERED, PRESENT, WIDE, with_hits
from .denominators import compare
from .presence import paired

__all__ = ["band_pairs", "benchmark_rows", "composition", "gene_records", "guide_counts", "notable", "perfect_by_gene", "perfect_totals", "ratio", "record_manifest", "tiers", "touched", "with_hits"]


def band_pairs(spans: DataFrame, sites: DataFrame, slack: int = 25, width: int = 512) -> DataFrame:
    """(seq_id, guide_id) for sites (guide_id, start) within `slack` of a record's span (seq_id, low, high), ends included.

    Both sides are dealt by bins of `width` positions: an equal join, of which the residual condition keeps the band.
    """
    low, high = F.col("low") - slack, F.col("high") + slack
    asked = spans.select("seq_id", "low", "high", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))).alias("bin"))
    placed = sites.select("guide_id", "start", F.floor(F.col("start") / width).alias("bin"))
    return asked.join(placed, "bin").where(F.col("start").between(low, high)).select("seq_id", "guide_id")


def touched(spans: DataFrame, genes: DataFrame, width: int = 512) -> DataFrame:
    """Distinct (seq_id, gene): records with a span (seq_id, low, high) that overlaps a gene's span (gene, start, end), half-open."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    s = spans.where("high > low").select("seq_id", "low", "high", bins("low", "high").alias("bin"))
    g = genes.where("end > start").select("gene", "start", "end", bins("start", "end").alias("bin"))
    return s.join(g, "bin").where("low < end AND high > start").select("seq_id", "gene").distinct()


def ratio(part, whole):
    """part / whole to six places; null of nothing."""
    return F.when(whole > 0, F.round(part / whole, 6))


def guide_counts(status: DataFrame, records: DataFrame, guides: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Each guide's records by status, and its conservation over four denominators.

    status: seq_id, guide_id, status; records: seq_id, record_class.  Over the records that cover the site (present or
    resolved absent), over all that were asked, and over those that cover it in each class.
    """
    n = lambda *codes: F.count_if(F.col("status").isin(*codes))
    of = lambda c, *codes: F.count_if((F.col("record_class") == c) & F.col("status").isin(*codes))
    by = status.join(records.select("seq_id", "record_class"), "seq_id").groupBy("guide_id").agg(
        n(PRESENT, ABSENT).alias("n_covering"), n(PRESENT).alias("n_present"), n(ABSENT).alias("n_absent"), n(AMBIGUOUS).alias("n_ambiguous"), n(WIDE).alias("n_wide"), n(NOT_COVERED).alias("n_not_covered"),
        F.count(F.lit(1)).alias("n_asked"), *[x for c in classes for x in (of(c, PRESENT, ABSENT).alias(f"n_covering_{c}"), of(c, PRESENT).alias(f"n_present_{c}"))],
    )
    counted = [c for c in by.columns if c != "guide_id"]
    out = guides.select("guide_id", "gene").join(by, "guide_id", "left").select("guide_id", "gene", *[F.coalesce(c, F.lit(0)).alias(c) for c in counted])
    out = out.withColumn("conservation", ratio(F.col("n_present"), F.col("n_covering"))).withColumn("conservation_asked", ratio(F.col("n_present"), F.col("n_asked")))
    for c in classes:
        out = out.withColumn(f"conservation_{c}", ratio(F.col(f"n_present_{c}"), F.col(f"n_covering_{c}")))
    return out


def record_manifest(records: DataFrame, spans: DataFrame, genes: DataFrame, status: DataFrame) -> DataFrame:
    """seq_id, record_class, length_bp, n_chains, span_start (1-based), span_end, genes_covered (sorted, joined by |), n_scored.

    spans: seq_id, low, high; a record without a span has -1 for both ends.
    """
    ends = spans.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_chains"), (F.min("low") + 1).alias("span_start"), F.max("high").alias("span_end"))
    names = touched(spans, genes).groupBy("seq_id").agg(F.array_join(F.array_sort(F.collect_set("gene")), "|").alias("genes_covered"))
    scored = status.where(F.col("status").isin(PRESENT, ABSENT)).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_scored"))
    out = records.select("seq_id", "record_class", "length_bp").join(ends, "seq_id", "left").join(names, "seq_id", "left").join(scored, "seq_id", "left")
    return out.select("seq_id", "record_class", "length_bp", *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("n_chains", 0), ("span_start", -1), ("span_end", -1), ("genes_covered", ""), ("n_scored", 0))])


def composition(manifest: DataFrame) -> DataFrame:
    """Each record class: records, those with a chain, those that cover a gene, and the median length cut to whole bases."""
    return manifest.groupBy("record_class").agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("n_chains") > 0).alias("n_mapped"), F.count_if(F.col("genes_covered") != "").alias("n_covering_a_gene"), F.floor(F.median("length_bp")).cast("int").alias("median_bp"),
    )


def gene_records(manifest: DataFrame, genes: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Each gene (genes: gene): the records whose list of genes holds it, by class, and their median length."""
    each = manifest.withColumn("gene", F.explode(F.split("genes_covered", r"\|"))).where("gene <> ''")
    by = each.groupBy("gene").agg(F.count(F.lit(1)).alias("n_records"), *[F.count_if(F.col("record_class") == c).alias(f"n_{c}") for c in classes], F.floor(F.median("length_bp")).cast("int").alias("median_bp"))
    counted = [c for c in by.columns if c != "gene"]
    return genes.select("gene").distinct().join(by, "gene", "left").select("gene", *[F.coalesce(c, F.lit(0)).alias(c) for c in counted])


def tiers(base: DataFrame, counts: DataFrame, pairs: Sequence[tuple[str, str, str]], least_records: int = 10) -> DataFrame:
    """compare() of the strict conservation (base: guide_id, x) with each (name, conservation column, records column) of counts."""
    joined = paired(base, counts, "guide_id", needed=False)
    out = None
    for name, value, number in pairs:
        row = compare(joined.where(F.col(value).isNotNull()).select("guide_id", "x", F.col(value).alias("y"), F.col(number).alias("records")), least_records).select(F.lit(name).alias("tier"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def benchmark_rows(names: DataFrame, hits: DataFrame, covered: DataFrame) -> DataFrame:
    """Each known guide (name, gene): records that hold it (hits: seq_id, name), records that hold it or touch its gene
    (covered: seq_id, gene), and their ratio to four places."""
    held = hits.select("seq_id", "name").distinct()
    asked = covered.join(names, "gene").select("seq_id", "name").unionByName(held).distinct()
    n = asked.groupBy("name").agg(F.count(F.lit(1)).alias("n_covering")).join(held.groupBy("name").agg(F.count(F.lit(1)).alias("n_present")), "name", "left")
    out = names.join(n, "name", "left").select("name", "gene", F.coalesce("n_covering", F.lit(0)).alias("n_covering"), F.coalesce("n_present", F.lit(0)).alias("n_present"))
    return out.withColumn("conservation", F.when(F.col("n_covering") > 0, F.round(F.col("n_present") / F.col("n_covering"), 4)))


def perfect_totals(counts: DataFrame) -> DataFrame:
    """One row: guides present in every record, in every record that resolves the site, and those that only the second rule saves.

    counts: n_present, n_total, n_resolved."""
    strict, tolerant = F.col("n_present") == F.col("n_total"), (F.col("n_resolved") > 0) & (F.col("n_present") == F.col("n_resolved"))
    return counts.agg(F.count_if(strict).alias("n_perfect_strict"), F.count_if(tolerant).alias("n_perfect_tolerant"), F.count_if(tolerant & (F.col("n_present") < F.col("n_total"))).alias("n_rescued"))


def perfect_by_gene(scored: DataFrame) -> DataFrame:
    """(gene, n_guides, n_perfect) of scored (gene, n_present, n_total)."""
    return scored.groupBy("gene").agg(F.count(F.lit(1)).alias("n_guides"), F.count_if(F.col("n_present") == F.col("n_total")).alias("n_perfect"))


def notable(hits: DataFrame, loci: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """(gene, label, note) and carry: loci (gene, note) named in the comma lists `cds_genes` or `gene_names` of hits.

    One row for each gene and label (less its suffix in brackets): that of the fewest mismatches.
    """
    lists = F.split(F.concat_ws(",", "cds_genes", "gene_names"), ",")
    each = hits.withColumn("gene", F.explode(F.transform(lists, lambda x: F.trim(x)))).withColumn("label", F.regexp_replace("label", r" \(\d+ nt\)$", ""))
    found = each.where("gene <> ''").join(loci, "gene")
    first = F.struct("mismatches", *carry, "note")
    best = found.groupBy("gene", "label").agg(F.min(first).alias("m"))
    return best.select("gene", "label", "m.*")
