"""The derived tables that the queries share, as DataFrames and as SQL.

The driver's tables hold prose.  A sequence view turns each text into a sequence; benchmark passages are the annotated
segments (seven genes, by item_id), documents are the records.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions.grammar import GRAMMARS, Grammar
from ..operators import presence as P
from ..operators import sites as K
from ..operators.scan import MIX

CAS = GRAMMARS["spcas9"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    seq = S.from_text(F.coalesce("text", F.lit("")))
    kind = F.element_at(F.array(F.lit("NC_"), F.lit("NG_"), F.lit("XX_")), (F.col("doc_id") % 3 + 1).cast("int"))
    return d.select(
        F.col("doc_id").alias("seq_id"), F.concat(kind, F.col("doc_id").cast("string")).alias("accession"), "lang", "source", seq.alias("seq"), F.length(seq).alias("length_bp"),
        S.ambiguous_count(seq).alias("n_ambiguous"), S.ambiguous_fraction(seq).alias("ambiguous_fraction"), (F.col("doc_id") % 3 < 2).alias("is_refseq"),
    )


def segments(spark, sf_dir) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("segment"), F.concat(F.lit("g"), (F.col("item_id") % 7).cast("string")).alias("gene"), S.from_text("text").alias("seq"))


def guides(spark, sf_dir, grammar: Grammar = CAS) -> DataFrame:
    return K.guide_table(K.sites(segments(spark, sf_dir), "seq", grammar), grammar)


def found(spark, sf_dir) -> DataFrame:
    return P.presence(records(spark, sf_dir), guides(spark, sf_dir), CAS)


def scored(spark, sf_dir) -> DataFrame:
    """guides with conservation over the documents."""
    g, r = guides(spark, sf_dir), records(spark, sf_dir)
    c = P.conservation(r, g, P.presence(r, g, CAS))
    return g.join(c.drop("target"), "guide_id")


def pool(spark, sf_dir) -> DataFrame:
    """scored guides with the filters that leave conservation out."""
    return scored(spark, sf_dir).withColumn("passes_filters", P.passes(0.35, 0.75, 4))


# --- the same in SQL -----------------------------------------------------------------------------------------------

_LETTERS = string.ascii_lowercase + string.ascii_uppercase
_BASES = ("ACGT" * 7)[:26] * 2


def seq_sql(text: str) -> str:
    return rf"regexp_replace(translate(regexp_replace(coalesce({text}, ''), '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g'), '{_LETTERS}', '{_BASES}'), '[^ACGT]', 'N', 'g')"


def rc_sql(seq: str) -> str:
    pairs = S.IUPAC + S.IUPAC.lower(), S.IUPAC_COMPLEMENT + S.IUPAC_COMPLEMENT.lower()
    return f"reverse(translate({seq}, '{pairs[0]}', '{pairs[1]}'))"


def gc_sql(seq: str) -> str:
    return f"(CASE WHEN length({seq}) = 0 THEN 0.0 ELSE length(regexp_replace(upper({seq}), '[^GC]', '', 'g')) / length({seq}) END)"


def run_sql(seq: str) -> str:
    return f"coalesce(list_max([length(x) for x in regexp_extract_all({seq}, '(A+|C+|G+|T+|N+)')]), 0)"


def word_hash_sql(word: str) -> str:
    """scan.hashes60() of a word of A, C, G and T."""
    mixed = "('0b' || " + "".join(["replace("] * 4) + word + "".join(f", '{b}', '{bits}')" for b, bits in zip("ACGT", ("00", "01", "10", "11"), strict=True)) + ")::UBIGINT"
    turn = lambda x: f"(SELECT xor(y, y >> 33) FROM (SELECT {x} AS y))"
    out = turn(mixed)
    for m in MIX:
        out = turn(f"({out}::UHUGEINT * {m}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT")
    return f"({out} >> 4)::BIGINT"


RECORDS = f"""records AS (SELECT doc_id AS seq_id, (CASE doc_id % 3 WHEN 0 THEN 'NC_' WHEN 1 THEN 'NG_' ELSE 'XX_' END) || doc_id AS accession, lang, source, s AS seq, length(s) AS length_bp,
  length(regexp_replace(s, '[ACGT]', '', 'g')) AS n_ambiguous,
  CASE WHEN length(s) = 0 THEN 1.0 ELSE round(length(regexp_replace(s, '[ACGT]', '', 'g')) / length(s), 8) END AS ambiguous_fraction, doc_id % 3 < 2 AS is_refseq
  FROM (SELECT *, {seq_sql("text")} AS s FROM documents))"""
SEGMENTS = f"segments AS (SELECT item_id AS segment, 'g' || (item_id % 7) AS gene, {seq_sql('text')} AS seq FROM benchmark)"


def sites_sql(name: str, source: str, keys: str, grammar: Grammar) -> str:
    n = grammar.length
    at = f"SELECT {keys}, p AS start0, substring(seq, p + 1, {n}) AS w FROM (SELECT {keys}, seq, unnest(range(0, greatest(0, length(seq) - {n - 1}))) AS p FROM {source})"
    return f"""{name} AS (SELECT {keys}, start0, '+' AS strand, w AS target FROM ({at}) WHERE regexp_full_match(w, '{grammar.plus}')
  UNION ALL SELECT {keys}, start0, '-', {rc_sql("w")} FROM ({at}) WHERE regexp_full_match(w, '{grammar.minus}'))"""


def guides_sql(grammar: Grammar = CAS) -> str:
    n, p = grammar.length, len(grammar.pam)
    order = "gene, segment, start0, strand"  # '+' sorts before '-'
    spacer = f"substring(target, 1, {grammar.spacer})"
    return f"""{SEGMENTS}, {sites_sql("found_sites", "segments", "gene, segment", grammar)},
ranked_sites AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY {order}) AS r, count(*) OVER (PARTITION BY target) AS n_copies FROM found_sites),
gene_order AS (SELECT target, gene, min(r) AS r FROM ranked_sites GROUP BY target, gene),
gene_list AS (SELECT target, string_agg(gene, '|' ORDER BY r) AS gene FROM gene_order GROUP BY target),
position_list AS (SELECT target, string_agg(segment || ':' || (start0 + 1) || '-' || (start0 + {n}) || '(' || strand || ')', ';' ORDER BY r) AS all_positions FROM ranked_sites GROUP BY target),
guides AS (SELECT s.gene || '_' || segment || '_' || (start0 + 1) || strand AS guide_id, g.gene, segment, strand, start0 + 1 AS ref_start, start0 + {n} AS ref_end,
  CASE WHEN strand = '+' THEN start0 + {n} - {p} - 2 ELSE start0 + 1 + {p} + 1 END AS cut_site_ref, {spacer} AS protospacer, substring(target, {grammar.spacer + 1}, {p}) AS pam, target,
  round({gc_sql(spacer)}, 4) AS gc_fraction, {run_sql(spacer)} AS max_homopolymer_run, contains({spacer}, 'TTTT') AS has_polyt, n_copies, all_positions
  FROM ranked_sites s JOIN gene_list g USING (target) JOIN position_list p USING (target) WHERE r = 1)"""


FOUND = f"found AS (SELECT seq_id, guide_id FROM records, guides WHERE contains(seq, target) OR contains(seq, {rc_sql('target')}))"
BASE = f"{RECORDS}, {guides_sql()}, {FOUND}"
SCORED = """counted AS (SELECT guide_id, count(*) AS n FROM found GROUP BY guide_id),
total AS (SELECT count(*) AS n_total FROM records),
absent AS (SELECT guide_id, string_agg(seq_id, ';' ORDER BY seq_id) AS absent_in FROM (
  SELECT g.guide_id, r.seq_id, row_number() OVER (PARTITION BY g.guide_id ORDER BY r.seq_id) AS k FROM guides g CROSS JOIN (SELECT seq_id FROM records) r
  WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.guide_id = g.guide_id AND f.seq_id = r.seq_id)) WHERE k <= 25 GROUP BY guide_id),
scored AS (SELECT g.*, coalesce(c.n, 0) AS n_present, n_total, round(coalesce(c.n, 0) / n_total, 6) AS conservation_fraction, coalesce(absent_in, '') AS absent_in
  FROM guides g CROSS JOIN total LEFT JOIN counted c ON g.guide_id = c.guide_id LEFT JOIN absent a ON g.guide_id = a.guide_id)"""
POOL = "pool AS (SELECT *, NOT has_polyt AND max_homopolymer_run <= 4 AND gc_fraction BETWEEN 0.35 AND 0.75 AS passes_filters FROM scored)"
ALL = f"{BASE}, {SCORED}, {POOL}"
