"""Sites and k-mers of sequences: the operators that make rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.grammar import Grammar
from ..functions.sequences import gc_fraction, has_polyt, max_homopolymer_run, revcomp
from .scan import sites

TILE = 8192
FINE = 256
__all__ = ["canonical", "canonical_bag", "canonical_kmers", "distinct_sites", "fine_tiles", "guide_table", "kmer_bag", "kmers", "local_gc", "row_numbers", "sites", "tiles"]


def tiles(df: DataFrame, seq: str, overlap: int, size: int = TILE) -> DataFrame:
    """df with `offset` and `tile` in place of seq: pieces of `size` bases, each with `overlap` bases of the next.

    An overlap of window length less one gives every window start exactly one tile, and bounds the work of a task by
    the tile and not by the record.
    """
    n = F.length(F.col(seq))
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size))
    out = df.withColumn("offset", F.explode(starts))
    return out.withColumn("tile", F.substring(F.col(seq), F.col("offset") + 1, F.lit(size + overlap))).drop(seq)


def fine_tiles(df: DataFrame, seq: str, overlap: int, size: int = FINE) -> DataFrame:
    """tiles() in two steps, large and then small: taking a piece of a string costs its distance from the string's start."""
    large = tiles(df, seq, overlap, max(TILE, size))
    if size >= TILE:
        return large
    inner = F.explode(F.sequence(F.lit(0), F.greatest(F.least(F.length("tile"), F.lit(TILE)) - 1, F.lit(0)), F.lit(size)))
    out = large.withColumn("_o", inner)
    return out.withColumn("tile", F.substring(F.col("tile"), F.col("_o") + 1, F.lit(size + overlap))).withColumn("offset", F.col("offset") + F.col("_o")).drop("_o")


def distinct_sites(df: DataFrame, seq: str, grammar: Grammar) -> DataFrame:
    """df's other columns and each distinct window (`kmer`, as on the plus strand) of a site on either strand.

    No positions, so one regular expression pass for each strand and no tiles; windows are made distinct inside a
    record before they become rows.
    """
    keep = [c for c in df.columns if c != seq]
    both = F.array_distinct(F.concat(*[F.regexp_extract_all(F.col(seq), F.lit(f"(?=({r}))"), F.lit(1)) for r in (grammar.plus, grammar.minus)]))
    return df.select(*keep, F.explode(both).alias("kmer"))


def kmers(df: DataFrame, seq: str, k: int, size: int = 256) -> DataFrame:
    """df's other columns, start0 and kmer for every window of k concrete bases."""
    at = fine_tiles(df, seq, k - 1, size).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    rows = at.withColumn("kmer", F.substring(F.col("tile"), F.col("p") + 1, F.lit(k))).where(F.length("kmer") == k).where(F.col("kmer").rlike("^[ACGT]+$"))
    return rows.select(*[c for c in df.columns if c != seq], (F.col("offset") + F.col("p")).alias("start0"), "kmer")


def kmer_bag(df: DataFrame, seq: str, k: int) -> DataFrame:
    """df's other columns and kmer, as kmers() without positions: one regular expression pass over each tile."""
    pieces = tiles(df, seq, k - 1)
    found = F.regexp_extract_all("tile", F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))
    return pieces.select(*[c for c in df.columns if c != seq], F.explode(found).alias("kmer"))


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(kmer, revcomp(kmer))


def canonical_kmers(tile: Column, k: int) -> Column:
    """The canonical k-mers of a piece, in order.

    The piece is reversed and complemented once: its k-mers are those of the other strand, from the end.
    """
    words = lambda s: F.regexp_extract_all(s, F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))
    return F.zip_with(words(tile), F.reverse(words(revcomp(tile))), lambda a, b: F.least(a, b))


def canonical_bag(df: DataFrame, seq: str, k: int) -> DataFrame:
    """df's other columns and kmer: every canonical k-mer occurrence."""
    pieces = tiles(df, seq, k - 1)
    return pieces.select(*[c for c in df.columns if c != seq], F.explode(canonical_kmers(F.col("tile"), k)).alias("kmer"))


def guide_table(found: DataFrame, grammar: Grammar) -> DataFrame:
    """Sites collapsed by target.  found: gene, segment, start0, strand, target.

    The first occurrence, by gene, segment, start and + before -, keeps its place; copies are counted, their positions
    and genes listed in that order.
    """
    order = F.struct(F.col("gene").alias("gene"), F.col("segment").alias("segment"), F.col("start0").alias("start0"), F.when(F.col("strand") == "+", 0).otherwise(1).alias("s"))
    n = grammar.length
    spelled = lambda o: F.concat(o["segment"].cast("string"), F.lit(":"), (o["start0"] + 1).cast("string"), F.lit("-"), (o["start0"] + n).cast("string"), F.when(o["s"] == 0, "(+)").otherwise("(-)"))
    grouped = found.groupBy("target").agg(F.array_sort(F.collect_list(order)).alias("all"))
    first = F.col("all")[0]
    start, strand = first["start0"] + 1, F.when(first["s"] == 0, "+").otherwise("-")
    spacer = F.substring("target", 1, grammar.spacer)
    return grouped.select(
        F.concat(first["gene"], F.lit("_"), first["segment"].cast("string"), F.lit("_"), start.cast("string"), strand).alias("guide_id"),
        F.array_join(F.array_distinct(F.transform("all", lambda o: o["gene"])), "|").alias("gene"),
        first["segment"].alias("segment"),
        strand.alias("strand"),
        start.alias("ref_start"),
        (first["start0"] + n).alias("ref_end"),
        grammar.cut_site(start, first["start0"] + n, strand).alias("cut_site_ref"),
        spacer.alias("protospacer"),
        F.substring(F.col("target"), F.lit(grammar.spacer + 1), F.lit(len(grammar.pam))).alias("pam"),
        "target",
        F.round(gc_fraction(spacer), 4).alias("gc_fraction"),
        max_homopolymer_run(spacer).alias("max_homopolymer_run"),
        has_polyt(spacer).alias("has_polyt"),
        F.size("all").alias("n_copies"),
        F.array_join(F.transform("all", spelled), ";").alias("all_positions"),
    )


def local_gc(pool: DataFrame, reference: DataFrame, flanks: tuple[int, ...] = (100, 200, 300)) -> DataFrame:
    """pool (segment, ref_start, ref_end) with the GC fraction of windows around each site's middle, held to the segment."""
    middle = F.floor((F.col("ref_start") - 1 + F.col("ref_end")) / 2).cast("int")
    out = pool.join(reference.select(F.col("segment"), F.col("seq").alias("_seq")), "segment")
    for w in flanks:
        low = F.greatest(F.lit(0), middle - w // 2)
        high = F.least(F.length("_seq"), middle + w // 2)
        out = out.withColumn(f"local_gc_{w}", F.round(gc_fraction(F.substring(F.col("_seq"), low + 1, high - low)), 4))
    return out.drop("_seq")


def row_numbers(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
