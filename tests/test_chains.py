"""Chains, statuses, coding sequences and the gene-level tables, against plain versions and planted signals."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import approx as A
from corpusloom.operators import chains as C
from corpusloom.operators import corpus as Q
from corpusloom.operators import presence as P
from corpusloom.operators import select as X


def bases(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_anchors_are_shared_words():
    rng = random.Random(2)
    ref = bases(rng, 300) + "N" + bases(rng, 50)
    ref += ref[:40] * 5
    record = ref[20:200] + "NN" + rc(ref[100:160]) + ref[10:60]
    index = C.Reference(ref, 12, most=3)
    times = {}
    for i in range(len(ref) - 11):
        times.setdefault(ref[i : i + 12], []).append(i)
    for step in (1, 4):
        want = sorted((r, q) for q in range(0, len(record) - 11, step) for r in times.get(record[q : q + 12], []) if "N" not in record[q : q + 12] and len(times[record[q : q + 12]]) <= 3)
        assert list(zip(*(x.tolist() for x in index.anchors(C.coded(record), step)), strict=True)) == want
    assert (C.turned(C.coded(record)) == C.coded(rc(record))).all()


def test_chains_keep_copies_apart():
    a = sorted([(10 * i, 10 * i) for i in range(5)] + [(10 * i, 500 + 10 * i) for i in range(5)])
    labels = C.chain_labels(*np.array(a).T)
    assert len(set(labels.tolist())) == 2 and all(labels[i] == (q >= 500) for i, (_, q) in enumerate(a))
    assert C.chain_labels(np.array([0]), np.array([0])).tolist() == [-1]
    assert C.chain_labels(np.empty(0, int), np.empty(0, int)).tolist() == []
    far = C.chain_labels(np.array([0, 10, 5000, 5010]), np.array([0, 10, 5000, 5010]))
    assert far.tolist() == [0, 0, 1, 1]
    drift = C.chain_labels(np.array([0, 10, 20, 30]), np.array([0, 10, 120, 130]))
    assert drift.tolist() == [0, 0, 1, 1]
    nearer = C.chain_labels(np.array([0, 0, 10, 20, 20]), np.array([100, 200, 205, 130, 225]))  # each goes to the chain of the nearer diagonal
    assert nearer.tolist() == [0, 1, 1, 0, 1]


def status(spark, records, ref, spans, found=()):
    guides = spark.createDataFrame([(g, s + 1, e) for g, s, e in spans], "guide_id string, ref_start int, ref_end int")
    df = spark.createDataFrame(list(records.items()), "seq_id string, seq string")
    mapped = C.laid(df, spark.createDataFrame([(ref,)], "seq string"), guides)
    held = spark.createDataFrame(list(found), "seq_id string, guide_id string")
    return mapped, {(r.seq_id, r.guide_id): r.status for r in C.classify(mapped, held).collect()}


def test_statuses_of_defects(spark):
    rng = random.Random(9)
    ref = bases(rng, 3000)
    changed = ref[:1510] + ("A" if ref[1510] != "A" else "C") + ref[1511:]
    records = {"same": ref, "snp": changed, "turned": rc(changed), "cut": ref[:1400], "gap": ref[:1450] + "N" * 120 + ref[1570:], "wide": ref[:1490] + bases(rng, 2500) + ref[1530:], "none": None, "empty": "", "other": bases(rng, 2000)}
    records["torn"] = ref[:1300] + "N" * 900 + ref[1700:]  # two chains, too far off each other's diagonal, with doubtful bases between
    mapped, got = status(spark, records, ref, [("s", 1500, 1523)], [("same", "s")])
    want = {"same": C.PRESENT, "snp": C.ABSENT, "turned": C.ABSENT, "gap": C.AMBIGUOUS, "wide": C.WIDE, "torn": C.AMBIGUOUS}
    assert got == {(k, "s"): v for k, v in want.items()}  # "cut" ends before the site: it is not asked
    rows = {r.seq_id: r for r in mapped.collect()}
    assert rows["turned"].turned and not rows["snp"].turned and rows["none"].length_bp == 0 and rows["other"].chains == []
    assert [(c.low, c.high) for c in rows["same"].chains] == [(0, 2972 + 25)] and rows["gap"].n_ambiguous == 120


def test_places_of_a_site_and_hits_beyond_the_span(spark):
    rng = random.Random(4)
    ref = bases(rng, 4000)
    records = {"part": ref[:1000], "short": ref[3000:3020]}
    spans = [("a", 500, 523), ("b", 3000, 3023), ("b", 600, 623), ("c", 2000, 2023), ("edge", 1010, 1033)]
    _, got = status(spark, records, ref, spans, [("short", "c"), ("short", "c"), ("part", "a")])
    # b counts by its better place; edge lies 10 beyond the span: asked, not covered; c is far: no row; a hit without chains is present
    assert got == {("part", "a"): C.PRESENT, ("part", "b"): C.ABSENT, ("part", "edge"): C.NOT_COVERED, ("short", "c"): C.PRESENT}


def test_planted_codons(spark):
    rng = random.Random(10)
    ref = bases(rng, 1200).replace("TAA", "TCA").replace("TAG", "TCG").replace("TGA", "TGC")
    stop = ref[:300] + "TAA" + ref[303:]
    grown = ref[:450] + "ACG" + ref[450:]
    rows = [(f"r{i}", ref[:150] + "TGG" + ref[153:] if i < 3 else ref) for i in range(9)] + [("back", rc(ref)), ("bad", ref[:90]), ("stop", stop), ("grown", grown), ("nil", None)]
    copies = spark.createDataFrame([("g", 0, 1, list(range(0, 600))), ("g", 1, 1, list(range(3, 30))), ("m", 0, -1, list(range(1199, 899, -1)))], "gene string, copy int, strand int, positions array<int>")
    prof = C.codon_profile(spark.createDataFrame(rows, "seq_id string, seq string"), spark.createDataFrame([(ref,)], "seq string"), copies, k=12, step=1, least=0.9).cache()
    verdicts = {r.seq_id: (r.verdict, r.copy, r.turned, r.net_offset) for r in prof.where("gene = 'g'").collect()}
    assert verdicts["back"] == ("used", 0, True, 0) and verdicts["bad"][0] == verdicts["nil"][0] == "unresolved"
    assert verdicts["stop"][0] == "stop" and verdicts["grown"] == ("used", 0, False, 3)
    got = {r.codon: (r.n_resolved, r.n_nt_variant) for r in C.codon_counts(prof).where("gene = 'g'").collect()}
    assert got[50] == (11, 3) and all(n == 0 for c, (_, n) in got.items() if c not in (50, 100)) and len(got) == 200
    quality = {(r.gene, r.verdict): (r.n_records, r.n_length_variants, r.n_in_frame) for r in C.profile_quality(prof).collect()}
    assert quality["g", "used"] == (11, 1, 1) and quality["g", "stop"][0] == 1 and sum(v[0] for (g, _), v in quality.items() if g == "m") == len(rows)
    minus = {r.seq_id: r for r in prof.where("gene = 'm'").collect()}
    # a stop on the minus strand may stand in random bases; the codons of used records agree with the reference
    assert all(not c.nt for r in minus.values() for c in r.codons)


def test_cds_copies(spark):
    ref = "CC" + "ATGAAA" + "GG" + "CCCTAA" + "TT" + rc("ATGTGGTGA") + "A"
    parts = [("p", 0, 1, 0, 2, 8), ("p", 0, 1, 1, 10, 16), ("m", 0, -1, 0, 21, 27), ("m", 0, -1, 1, 18, 21), ("x", 0, 1, 0, 0, 6)]
    df = spark.createDataFrame(parts, "gene string, copy int, strand int, part int, start int, end int")
    text = spark.createDataFrame([(ref,)], "seq string")
    got = {r.gene: (r.cds, r.protein, r.valid) for r in C.cds_copies(df, text, strict=False).collect()}
    assert got["p"] == ("ATGAAACCCTAA", "MKP*", True) and got["m"] == ("ATGTGGTGA", "MW*", True) and not got["x"][2]
    with pytest.raises(Exception, match="translate cleanly"):
        C.cds_copies(df, text).collect()
    assert C.cds_copies(df.where("gene <> 'x'"), text).count() == 2


def test_cut_codons_fall_back(spark):
    copies = spark.createDataFrame([("g", 0, list(range(100, 130))), ("g", 1, list(range(120, 150)))], "gene string, copy int, positions array<int>")
    sites = [("cut", "g", "+", 101, 123), ("middle", "g", "+", 139, 161), ("foot", "g", "+", 147, 300), ("none", "h", "+", 100, 122), ("minus", "g", "-", 120, 142)]
    got = {r.guide_id: r.codon for r in C.cut_codons(spark.createDataFrame(sites, "guide_id string, gene string, strand string, ref_start int, ref_end int"), C.codon_places(copies), 3).collect()}
    assert got == {"cut": 5, "middle": 9, "foot": 8, "none": 0, "minus": 1}  # 117 in copy 0; 155 and then 149; 146 as the first held


def test_gene_level_tables(spark):
    rng = random.Random(6)
    spans = [(i, s := rng.randrange(0, 3000), s + rng.randrange(0, 900)) for i in range(40)]
    sites = [(f"g{k}", rng.randrange(0, 4000)) for k in range(60)]
    sp = spark.createDataFrame(spans, "seq_id long, low long, high long")
    got = sorted(tuple(r) for r in Q.band_pairs(sp, spark.createDataFrame(sites, "guide_id string, start long"), 25, 128).collect())
    assert got == sorted((i, g) for i, a, z in spans for g, x in sites if a - 25 <= x <= z + 25)
    genes = [("a", 0, 500), ("b", 400, 401), ("c", 2000, 2600), ("a", 3500, 3900), ("e", 7, 7)]
    over = sorted(tuple(r) for r in Q.touched(sp, spark.createDataFrame(genes, "gene string, start long, end long"), 128).collect())
    assert over == sorted({(i, g) for i, a, z in spans for g, s, e in genes if s < e and a < z and a < e and z > s})


def test_small_selections(spark):
    t = spark.createDataFrame([("chr1", 1), ("chr2", 2), ("chr2", 2)], "chrom string, n int")
    assert X.chosen_names(t, "chrom", ["chr2", "chrX"]).count() == 2
    with pytest.raises(ValueError, match="chrX"):
        X.chosen_names(t, "chrom", ["chrX"])
    assert X.difference(t, t).count() == 0
    assert [tuple(r) for r in X.difference(t, t.distinct()).collect()] == [("chr2", 2, "first")]
    claims = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 1.1), ("c", None, None), ("d", 1.0, None)], "claim string, expected double, actual double")
    assert {r.claim: r.holds for r in X.checked(claims, 0.05).collect()} == {"a": True, "b": False, "c": True, "d": False}


def test_hits_by_class(spark):
    hits = spark.createDataFrame([("a", 0, "s", True), ("a", 2, "r", False), ("a", 3, "s", True)], "guide_id string, mismatches int, pam_class string, in_cds boolean")
    got = {r.guide_id: r for r in A.summary_by_class(hits, spark.createDataFrame([("a",), ("b",)], "guide_id string"), 3, ("s", "r"), 2).collect()}
    assert (got["a"].mm0_s, got["a"].mm2_r, got["a"].mm3_s, got["a"].n_le2, got["a"].n_le2_in_cds) == (1, 1, 1, 2, 1) and got["b"].n_le2 == 0


def test_codons_by_chains_not_by_single_anchors(spark):
    """A repeat inside the gene and an insertion: what is read follows the chains; an unknown base unresolves its codon, not its positions."""
    rng = random.Random(12)
    ref = bases(rng, 400)
    ref += ref[100:160] + bases(rng, 340)
    doubt = ref[:30] + "N" + ref[31:]
    twice = ref[:500] + ref[100:160] + ref[500:]
    copies = spark.createDataFrame([("g", 0, 1, list(range(0, 600)))], "gene string, copy int, strand int, positions array<int>")
    rows = [("same", ref), ("doubt", doubt), ("twice", twice), ("half", ref[:290]), ("away", bases(rng, 300))]
    df, one = spark.createDataFrame(rows, "seq_id string, seq string"), spark.createDataFrame([(ref,)], "seq string")
    got = {r.seq_id: r for r in C.codon_profile(df, one, copies, k=15, step=3, stops=False).collect()}
    assert got["same"].verdict == got["doubt"].verdict == "used" and got["same"].resolved_fraction == got["doubt"].resolved_fraction == 1.0
    assert {c.codon for c in got["same"].codons} == set(range(200)) and {c.codon for c in got["doubt"].codons} == set(range(200)) - {10}
    assert not any(c.nt for k in ("same", "doubt", "twice") for c in got[k].codons) and got["twice"].net_offset == 60
    assert got["half"].verdict == "unresolved" and 280 / 600 < got["half"].resolved_fraction <= 350 / 600  # the repeat maps too
    some = {r.seq_id for r in C.codon_profile(df, one, copies, k=15, step=3, stops=False, every=False).collect()}
    assert some == {"same", "doubt", "twice", "half"} and got["away"].resolved_fraction == 0


def test_a_stop_of_the_reference_rejects_nothing(spark):
    rng = random.Random(2)
    ref = "ATG" + "TGA" + "".join(rng.choice(["GCA", "CTC", "GAG", "CAC", "ACC"]) for _ in range(60))
    copies = spark.createDataFrame([("g", 0, 1, list(range(len(ref))))], "gene string, copy int, strand int, positions array<int>")
    rows = [("same", ref), ("new", ref[:90] + "TAA" + ref[93:]), ("end", ref[:-3] + "TAA")]
    prof = C.codon_profile(spark.createDataFrame(rows, "seq_id string, seq string"), spark.createDataFrame([(ref,)], "seq string"), copies, k=10, step=1, least=0.9)
    assert {r.seq_id: r.verdict for r in prof.collect()} == {"same": "used", "new": "stop", "end": "used"}


def test_anchors_ask_a_bitmap_first():
    rng = random.Random(8)
    bases = "".join(rng.choice("ACGT") for _ in range(400))
    index = C.Reference(bases[:200] + "N" * 5 + bases[150:], 25)
    assert index.marked.sum() <= len(set(index.word.tolist())) and index.marked[index.place(index.word)].all()
    record = "TTACN" + bases[30:120] + "N" + bases[140:260] + "GA"
    where = [(at, q) for q in range(0, len(record) - 24, 4) for at, w in zip(index.at.tolist(), index.word.tolist()) if (C.words(C.coded(record[q : q + 25]), 25)[1] == w).any()]
    ref, qry = index.anchors(C.coded(record), 4)
    assert list(zip(ref.tolist(), qry.tolist())) == sorted(where) and where
