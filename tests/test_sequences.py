import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import sequences as S
from corpusloom.functions.grammar import GRAMMARS, Grammar, as_regex, complement_pattern, grammar
from corpusloom.operators import sites as K

COMPLEMENT = str.maketrans("ACGTN", "TGCAN")


def rc(s):
    return s.translate(COMPLEMENT)[::-1]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def random_bases(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_texts_are_read_by_a_table_of_bytes(spark):
    signs = "".join(map(chr, range(0x250))) + "\u200b漢\U0001f600Zz"
    want = "".join("N" if ord(c) > 127 else "ACGT"[(ord(c.lower()) - 97) % 4] for c in signs if ord(c) > 127 or c.isalpha())
    read = spark.createDataFrame([(signs,), ("",), (None,)], "s string").select(S.from_text(F.col("s")).alias("x"))
    assert [r.x for r in read.collect()] == [want, "", None]
    assert "regexp" not in read._jdf.queryExecution().toString()


def test_scalars(spark):
    assert one(spark, S.revcomp(F.col("s")), s="ACGTNRYacgu") == "acgtRYNACGT"
    assert one(spark, S.gc_fraction(F.col("s")), s="") == 0.0
    assert one(spark, S.gc_fraction(F.col("s")), s="gGcA") == 0.75
    assert one(spark, S.max_homopolymer_run(F.col("s")), s="AACCCCGT") == 4
    assert one(spark, S.max_homopolymer_run(F.col("s")), s="") == 0
    assert one(spark, S.has_polyt(F.col("s")), s="aattttc") is True
    assert one(spark, S.ambiguous_fraction(F.col("s")), s="") == 1.0
    assert one(spark, S.translate_codons(F.col("s")), s="ATGTGANNNTT") == "M*X"
    assert one(spark, S.translate_codons(F.col("s")), s="AT") == ""
    assert one(spark, S.translate_codons(F.col("s")), s="éATTGAatgTTTa") == "X*XF"
    assert one(spark, S.mash_identity(F.col("j"), 21), j=0.0) == 0.0
    assert one(spark, S.mash_identity(F.col("j"), 21), j=1.0) == 1.0
    assert one(spark, S.year_of(F.col("s")), s="Mar-1999") == 1999
    assert one(spark, S.year_of(F.col("s")), s="none") is None
    assert one(spark, S.first_filled(F.col("a"), F.col("b")), a=" ", b="x") == "x"
    assert one(spark, S.gtf_attribute(F.col("s"), "gene_name"), s='gene_id "a"; gene_name "b";') == "b"
    assert one(spark, S.from_text(F.col("s")), s="ab, Z é!") == "ACCN"


def test_hamming_counts_n_as_different(spark):
    assert one(spark, S.hamming_positions(F.col("a"), F.col("b"), 5), a="ACGTN", b="ACCTN") == [3, 5]


def test_footprints_fall_back(spark):
    got = one(spark, S.footprints(F.col("p"), F.col("s"), F.col("e")), p="10-32(+);5000-5022(-)", s=1, e=2)
    assert [tuple(x) for x in got] == [(9, 32), (4999, 5022)]
    assert [tuple(x) for x in one(spark, S.footprints(F.col("p"), F.col("s"), F.col("e")), p="", s=10, e=32)] == [(9, 32)]


def test_grammar_rules():
    g = grammar("sacas9")
    assert (g.length, g.plus, complement_pattern("NNGRRT")) == (27, "[ACGT]{23}G[AG]{2}T", "AYYCNN")
    assert grammar("spcas9", pam="NAG", spacer=18).tag == "spcas9_nag_18"
    assert GRAMMARS["spcas9"].anchors() == [("GG", 21)]
    assert as_regex("NNR") == "[ACGT]{2}[AG]"
    with pytest.raises(KeyError):
        grammar("nothing")
    with pytest.raises(ValueError):
        Grammar("x", 20, "TTTV", "5prime")


def test_three_cut_conventions(spark):
    g = GRAMMARS["spcas9"]
    row = {"s": 101, "e": 123, "z": 100, "t": "-"}
    assert one(spark, g.cut_site(F.col("s"), F.col("e"), F.col("t")), **row) == 101 + 3 + 1
    assert one(spark, g.cut_offset_in_frame(F.col("z"), F.col("t")), **row) == 100 + 3 + 2
    assert one(spark, g.cut_offset_in_hit(F.col("z"), F.col("t")), **row) == 100 + 3 + 3


PATTERNS = [("NGG", 20), ("NAG", 20), ("NNGRRT", 21), ("NNGRRT", 20), ("NNGRRN", 21), ("NNN", 4), ("TTTV", 20), ("ACGT", 10)]


@pytest.mark.parametrize(("pam", "spacer"), PATTERNS)
def test_sites_equal_a_plain_scan(spark, pam, spacer):
    rng = random.Random(pam + str(spacer))
    g = Grammar("x", spacer, pam)
    seqs = [random_bases(rng, n, "ACGTACGTACGTN") for n in (0, 3, g.length, 700)]
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    got = sorted(tuple(r) for r in K.sites(df, "seq", g, piece=64).select("seq_id", "start0", "strand", "target").collect())
    want = []
    for i, s in enumerate(seqs):
        for p in range(len(s) - g.length + 1):
            w = s[p : p + g.length]
            if re.fullmatch(g.plus, w):
                want.append((i, p, "+", w))
            if re.fullmatch(g.minus, w):
                want.append((i, p, "-", rc(w)))
    assert got == sorted(want)


def test_kmers_do_not_depend_on_tiles(spark):
    rng = random.Random(4)
    seqs = [random_bases(rng, n, "ACGTN") for n in (0, 10, 21, 300)]
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    want = sorted((i, p, s[p : p + 5]) for i, s in enumerate(seqs) for p in range(len(s) - 4) if "N" not in s[p : p + 5])
    for size in (7, 64, 256):
        assert sorted(tuple(r) for r in K.kmers(df, "seq", 5, size).collect()) == want
    assert sorted(tuple(r) for r in K.canonical_bag(df, "seq", 5).collect()) == sorted((i, min(w, rc(w))) for i, _, w in want)
    assert sorted(tuple(r) for r in K.kmer_bag(df, "seq", 5).collect()) == sorted((i, w) for i, _, w in want)


def test_two_steps_of_tiles(spark):
    rng = random.Random(5)
    seqs = [random_bases(rng, n) for n in (0, K.TILE - 1, K.TILE, K.TILE + 1, 2 * K.TILE + 300)]
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    got = {(r.seq_id, r.offset): r.tile for r in K.fine_tiles(df, "seq", 4).collect()}
    assert all(got[i, o] == s[o : o + K.FINE + 4] for i, s in enumerate(seqs) for o in range(0, len(s), K.FINE))


def test_guide_table_keeps_the_first(spark):
    g = Grammar("x", 3, "GG")
    rows = [("g2", 1, 5, "+", "AAAGG"), ("g1", 4, 9, "-", "AAAGG"), ("g1", 4, 9, "+", "AAAGG"), ("g1", 2, 0, "+", "CCCGG")]
    got = {r.target: r for r in K.guide_table(spark.createDataFrame(rows, "gene string, segment long, start0 int, strand string, target string"), g).collect()}
    assert got["AAAGG"].guide_id == "g1_4_10+" and got["AAAGG"].n_copies == 3 and got["AAAGG"].gene == "g1|g2"
    assert got["AAAGG"].all_positions == "4:10-14(+);4:10-14(-);1:6-10(+)"


def test_local_gc_of_an_island(spark):
    pool = spark.createDataFrame([("a", 1, 540, 562)], "guide_id string, segment long, ref_start int, ref_end int")
    ref = spark.createDataFrame([(1, "A" * 500 + "G" * 100 + "A" * 500)], "segment long, seq string")
    assert K.local_gc(pool, ref, (50,)).first().local_gc_50 == 1.0


def test_long_sequences_are_translated_in_one_walk(spark):
    """Millions of bases in one record beside null, empty and short ones: a walk to each codon's place would not end."""
    rows = [("ATGTGACCN" * 300_000,), (None,), ("",), ("ATGTT",)]
    t = spark.createDataFrame(rows, "s string").select(S.translate_codons(F.col("s")).alias("aa"))
    assert [r.aa for r in t.collect()] == ["M*X" * 300_000, "", "", "M"]
