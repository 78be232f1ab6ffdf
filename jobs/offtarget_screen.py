"""Screen a corpus for near matches of target sites: hits by gene, and a summary for each site.

    python jobs/offtarget_screen.py --documents DIR --benchmark DIR --out DIR [--config FILE]

Sites are those of the strict grammar in the annotated segments of `benchmark`; `documents` are scanned under the relaxed
one, on both strands, for spacers within `mismatches` substitutions.  Every hit is counted again, base by base, before it is written:

    out/hits/gene=G        guide_id, seq_id, start, end, strand, mismatches, seed_mismatches, mismatch_positions, pam, pam_class, cut_site
    out/summary/gene=G     per site: hits at each distance, in all, within `near` and with at most one seed mismatch, strict and all

A run replaces what an earlier one has left, so a run that failed is started again.  A null text holds no hits; a null
id is an id like any other; a site without hits has zeros.
"""

from __future__ import annotations

import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import sequences as S
from corpusloom.functions.grammar import GRAMMARS, Grammar, pam_class
from corpusloom.operators import approx as A
from corpusloom.operators import presence as P
from corpusloom.operators import sites as K
from jobs import common

LOG = common.log("offtarget_screen")


def strict_place(strict: Grammar, relaxed: Grammar) -> tuple[int, str]:
    """Where (1-based) and by which base the strict pattern narrows the relaxed one."""
    differ = [i for i, (a, b) in enumerate(zip(strict.pam, relaxed.pam, strict=True)) if a != b]
    if strict.spacer != relaxed.spacer or len(differ) != 1 or strict.pam[differ[0]] not in "ACGT":
        raise ValueError("the strict pattern has to fix one base of the relaxed one")
    return differ[0] + 1, strict.pam[differ[0]]


def found_hits(documents: DataFrame, guides: DataFrame, strict: Grammar, relaxed: Grammar, mismatches: int) -> DataFrame:
    """The verified hits of documents (doc_id, text), with the gene of their site."""
    place, base = strict_place(strict, relaxed)
    records = documents.select(F.col("doc_id").alias("seq_id"), S.from_text(F.coalesce("text", F.lit(""))).alias("seq"))
    book = guides.select("guide_id", F.col("protospacer").alias("spacer"))
    hits = A.verified(A.near_hits(records, book, relaxed, mismatches), book, relaxed.spacer)
    pam = F.substring("target", relaxed.spacer + 1, len(relaxed.pam))
    return hits.join(P.sized_broadcast(guides.select("guide_id", "gene")), "guide_id").select(
        "guide_id", "gene", "seq_id", (F.col("start0") + 1).alias("start"), (F.col("start0") + relaxed.length).alias("end"), "strand", "mismatches", "seed_mismatches", "mismatch_positions",
        pam.alias("pam"), pam_class(pam, place, base, "strict", "relaxed").alias("pam_class"), (relaxed.cut_offset_in_hit(F.col("start0"), F.col("strand")) + 1).alias("cut_site"),
    )


def run(spark: SparkSession, documents: str, benchmark: str, out: str, strict: str = "sacas9", relaxed: str = "sacas9_relaxed", mismatches: int = 3, near: int = 2) -> DataFrame:
    """Write hits and summary; returns the summary read back."""
    tight, loose = GRAMMARS[strict], GRAMMARS[relaxed]
    segments = spark.read.parquet(benchmark).select(F.col("item_id").alias("segment"), F.concat(F.lit("g"), (F.col("item_id") % 7).cast("string")).alias("gene"), S.from_text("text").alias("seq"))
    guides = K.guide_table(K.sites(segments, "seq", tight), tight).select("guide_id", "gene", "protospacer")
    docs = spark.read.parquet(documents)
    LOG.info("read %s: %d sites; %s: %d documents", benchmark, guides.count(), documents, docs.count())
    hits = found_hits(docs, guides, tight, loose, mismatches)
    hits.write.mode("overwrite").partitionBy("gene").parquet(f"{out}/hits")
    written = spark.read.schema(hits.schema).parquet(f"{out}/hits")
    LOG.info("wrote %d hits to %s/hits", written.count(), out)
    told = A.screen_summary(written, guides, mismatches, near=near)
    told.write.mode("overwrite").partitionBy("gene").parquet(f"{out}/summary")
    back = spark.read.schema(told.schema).parquet(f"{out}/summary")
    LOG.info("wrote %d rows to %s/summary", back.count(), out)
    return back


if __name__ == "__main__":
    common.main("offtarget_screen", ["documents", "benchmark", "out"], run)
