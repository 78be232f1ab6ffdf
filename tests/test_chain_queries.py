"""The gene-level tables and codons on the segments' reference against plain loops: every status and verdict occurs."""

from collections import Counter

import pytest

from corpusloom.operators import chains as C
from corpusloom.plans import chain_queries as Q
from tests.test_chains import rc
from tests.test_queries import DATA
from tests.test_stitch import plain


@pytest.fixture(scope="module")
def world(spark):
    """Records, sites and statuses by loops."""
    x = Q.Ground(spark, DATA)
    slot = x.slot
    segments = sorted((r.segment, r.gene, r.seq) for r in x.segments.collect())
    ref = "".join((s + "N" * slot)[:slot] for _, _, s in segments)
    assert [i for i, _, _ in segments] == list(range(len(segments)))
    records = {r.seq_id: (r.seq, r.record_class) for r in x.records.collect()}
    return x, slot, segments, ref, records


def test_statuses_from_chains(spark, world):
    x, slot, segments, ref, records = world
    guides = {r.guide_id: r for r in Q.p.guides(spark, DATA).collect()}
    sites = [(g, i * slot + at, i * slot + at + 23) for i, _, s in segments for at in range(len(s) - 22) for g, r in guides.items() if r.target in (s[at : at + 23], rc(s[at : at + 23]))]
    want, spans, turned = plain({i: s for i, (s, _) in records.items()}, ref, sites, Q.WORD, Q.STEP)
    for i, (s, _) in records.items():
        for g, r in guides.items():
            if s and (r.target in s or rc(r.target) in s):
                want[i, g] = C.PRESENT
    got = {(r.seq_id, r.guide_id): C.STATUS_NAMES.index(r.status) for r in Q.chain_site_status(spark, DATA).collect()}
    assert got == want and set(got.values()) == set(range(5))
    rows = {r.seq_id: r for r in Q.chain_gene_manifest(spark, DATA).collect()}
    assert set(rows) == set(records)
    for i, r in rows.items():
        assert (r.strand_vs_reference == "-") == turned[i] and r.n_chains == len(spans[i]) and r.length_bp == len(records[i][0] or "")
        genes = {g for n, g, s in segments if any(a < n * slot + len(s) and z > n * slot for a, z in spans[i])}
        assert r.genes_covered == "|".join(sorted(genes)) and r.n_scored == sum(k[0] == i and v <= 1 for k, v in want.items())
        if spans[i]:
            assert (r.span_start, r.span_end) == (spans[i][0][0] + 1, max(z for _, z in spans[i]))
    counts = {r.guide_id: r for r in Q.chain_gene_counts(spark, DATA).collect()}
    for g in guides:
        n = Counter(v for k, v in want.items() if k[1] == g)
        assert (counts[g].n_present, counts[g].n_absent, counts[g].n_ambiguous, counts[g].n_wide, counts[g].n_not_covered) == tuple(n[v] for v in range(5))
    totals = {(r.record_class, r.status_name): r.n_pairs for r in Q.chain_status_totals(spark, DATA).collect()}
    assert sum(totals.values()) == len(records) * len(guides)
    by = Counter((records[i][1], C.STATUS_NAMES[v]) for (i, _), v in want.items() if v != C.NOT_COVERED)
    assert {k: v for k, v in totals.items() if v and k[1] != "not_covered"} == dict(by)


def test_whole_records_say_the_same(spark, world):
    x, slot, segments, ref, records = world
    targets = {f"site{i * slot + at + 1:09d}": (i * slot + at, s[at : at + 23]) for i, _, s in segments for at in range(0, len(s) - 22, 20)}
    want, spans, turned = plain({i: s for i, (s, _) in records.items()}, ref, [(g, a, a + 23) for g, (a, _) in targets.items()], Q.WORD, Q.STEP)
    reach = Counter(i for i, _ in want)
    for i, (s, _) in records.items():
        want |= {(i, g): C.PRESENT for g, (_, t) in targets.items() if s and set(t) <= set("ACGT") and (t in s or rc(t) in s)}
    got = {(r.seq_id, r.guide_id): r.status for r in Q.anchor_chain_status(spark, DATA).collect()}
    assert got == want and set(got.values()) == set(range(5))
    for r in Q.chain_manifest(spark, DATA).collect():
        assert (r.turned, r.n_chains, r.n_scored, r.n_ambiguous) == (turned[r.seq_id], len(spans[r.seq_id]), reach[r.seq_id], sum(c not in "ACGT" for c in records[r.seq_id][0]))


def test_codons_of_planted_copies(spark, world):
    _, _, segments, _, records = world
    verdicts = {(r.gene, r.verdict): r for r in Q.codon_quality(spark, DATA).collect()}
    assert {v for _, v in verdicts} == {"used", "unresolved"} and any(r.n_length_variants for r in verdicts.values())
    counts = {(r.gene, r.codon): r for r in Q.codon_tolerance(spark, DATA).collect()}
    for i, _, s in segments:
        if len(s) >= Q.LEAST_COPY and set(s) <= set("ACGT"):
            codon = 80 // 3 if i % 2 == 0 else (len(s) // 3 * 3 - 1 - 80) // 3
            if (f"s{i}", codon) in counts:
                assert counts[f"s{i}", codon].n_nt_variant >= 1  # the changed base
            middle = counts.get((f"s{i}", len(s) // 6))
            assert middle and middle.n_resolved >= 2  # turned and changed copies
    assert {r.tolerance for r in counts.values()} == {0.5, 0.05}


def test_site_table_follows_mapped_codons(spark, world):
    """Cut codons and what varies around them by loops; q of a plain window model at the measured codons."""
    import math

    from corpusloom.operators import sweep as Y

    x, slot, segments, ref, records = world
    counts = {(r.gene, r.codon): r.n_aa_variant for r in Q.codon_tolerance(spark, DATA).collect()}
    h = Q.p.table(spark, DATA, "lineitem").selectExpr("l_linenumber - 4 AS length", "1 AS weight").groupBy("length").sum("weight").toDF("length", "weight")
    lengths = {r.length: r.p for r in Y.spectra(spark, h).where("spectrum = 'default'").collect()}
    rows = Q.site_table(spark, DATA).collect()
    assert len(rows) == Q.p.guides(spark, DATA).count() and len(rows[0]) == 20 and any(r.codon_varies for r in rows) and any(r.local_variable_codons > 0 and not r.codon_varies for r in rows)
    sizes = {f"s{i}": len(s) // 3 for i, _, s in segments}
    for r in rows:
        i, n = int(r.gene[1:]), sizes[r.gene]
        place = {i * slot + p: (p // 3 if i % 2 == 0 else (3 * n - 1 - p) // 3) for p in range(3 * n)}
        cut = r.ref_end - 6 if r.strand == "+" else r.ref_start + 4
        tries = [cut, (r.ref_start - 1 + r.ref_end) // 2, *range(r.ref_start - 1, r.ref_end)]
        codon = next((place[t] for t in tries if t in place), 0)
        varies = [counts.get((r.gene, c), 0) >= 1 for c in range(n)]
        tol = [0.5 if v else 0.05 for v in varies]
        near = range(max(0, codon - 5), min(n, codon + 6))
        assert (r.cut_codon, r.codon_varies, r.local_variable_codons) == (codon, varies[codon], sum(varies[c] for c in near))
        assert r.local_tolerance == pytest.approx(sum(tol[c] for c in near) / len(near))
        q = 0.0
        for length, p in lengths.items():
            m = max(1, abs(length) // 3)
            if length % 3 == 0:
                starts = [s for s in range(codon - m + 1, codon + 1) if s >= 0 and s + m <= n] or [max(0, min(codon, n - m))]
                q += p * sum(math.prod(tol[s : s + m]) for s in starts) / len(starts)
        assert r.q_single_copy == pytest.approx(q, abs=1e-9) and r.essential == (r.gene in ("s0", "s1"))
