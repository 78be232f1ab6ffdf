"""Records laid piece by piece against a plain version, against whole records, and planted defects."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import chains as C
from corpusloom.operators import stitch as Z
from tests.test_chains import bases, rc


def plain(records, ref, sites, k, step, most=4, oriented=50, max_gap=3000, max_drift=60, least=2, widest=2000, slack=25):
    """{(seq_id, guide_id): status} and {seq_id: spans}, by loops over single anchors."""
    places = {}
    for i in range(len(ref) - k + 1):
        if set(ref[i : i + k]) <= set("ACGT"):
            places.setdefault(ref[i : i + k], []).append(i)
    out, spans, turned = {}, {}, {}
    by = {}
    for g, s, e in sites:
        by.setdefault(g, []).append((s, e))
    for name, seq in records.items():
        seq = seq or ""
        found = [sorted((r, q) for q in range(0, len(t) - k + 1, step) for r in places.get(t[q : q + k], []) if len(places[t[q : q + k]]) <= most) for t in (seq, rc(seq))]
        turned[name] = len(found[0]) < oriented and len(found[1]) > len(found[0])
        text = rc(seq) if turned[name] else seq
        chains = []
        for r, q in found[turned[name]]:
            fit = [(abs((c[-1][1] - c[-1][0]) - (q - r)), i) for i, c in enumerate(chains) if c[-1][0] >= r - max_gap and c[-1][1] < q]
            if fit and min(fit)[0] <= max_drift:
                chains[min(fit)[1]].append((r, q))
            else:
                chains.append([(r, q)])
        chains = [c for c in chains if len(c) >= least]
        spans[name] = sorted((c[0][0], c[-1][0] + k) for c in chains)
        if not chains:
            continue
        unclear = lambda a, z, text=text: z > a and any(x not in "ACGT" for x in text[a:z])
        low, high = min(s[0] for s in spans[name]) - slack, max(s[1] for s in spans[name]) + slack
        for g, each in by.items():
            if not low <= min(s for s, _ in each) <= high:
                continue
            said = []
            for s, e in each:
                for c in chains:
                    before, after = [x for x in c if x[0] + k <= s], [x for x in c if x[0] >= e]
                    if before and after and after[0][1] + k > before[-1][1]:
                        a, z = before[-1][1], after[0][1] + k
                        said.append(C.WIDE if z - a > widest else C.AMBIGUOUS if unclear(a, z) else C.ABSENT)
            if not said:
                for s, e in each:
                    left = [((c[-1][0], -c[0][0], i), c[-1][1]) for i, c in enumerate(chains) if c[-1][0] + k <= s]
                    right = [((c[0][0], c[-1][0], i), c[0][1]) for i, c in enumerate(chains) if c[0][0] >= e]
                    if left and right:
                        said.append(C.AMBIGUOUS if unclear(max(left)[1], min(right)[1] + k) else C.WIDE)
            out[name, g] = min(said, default=C.NOT_COVERED)
    return out, spans, turned


def damaged(rng, ref):
    """Records with planted defects: partial, gapped, turned, grown, shrunken, torn, repeated and foreign ones."""
    n = len(ref)
    records = {"same": ref, "turned": rc(ref), "none": None, "empty": "", "short": ref[: 20], "foreign": bases(rng, 900), "unknown": "N" * 500}
    for i in range(10):
        a, b = sorted(rng.sample(range(n), 2))
        records[f"part{i}"] = ref[a:b] if i % 2 else rc(ref[a:b])
        at = rng.randrange(200, n - 300)
        records[f"gap{i}"] = ref[:at] + "N" * rng.randrange(1, 200) + ref[at + 60 :]
        records[f"wide{i}"] = ref[:at] + bases(rng, rng.choice([30, 70, 2200])) + ref[at + rng.randrange(0, 40) :]
        records[f"torn{i}"] = ref[:at] + rng.choice(["N" * 700, bases(rng, 700)]) + ref[at + 200 :]
        records[f"twice{i}"] = ref[at : at + 300] + bases(rng, 50) + ref[at + 100 : at + 500] + ref[:120]
        changed = list(ref)
        for x in rng.sample(range(n), n // 30):
            changed[x] = rng.choice("ACGTN")
        records[f"noisy{i}"] = "".join(changed) if i % 3 else rc("".join(changed))
    return records


@pytest.mark.parametrize("piece, width, seed", [(64, 128, 1), (1000, 4096, 2), (1 << 20, 50, 3)])
def test_pieces_equal_whole_records_and_a_plain_version(spark, piece, width, seed):
    rng = random.Random(seed)
    ref = bases(rng, 1500)
    ref += ref[200:420] + bases(rng, 300) + "N" * 40 + bases(rng, 400) + ref[200:420]
    records = damaged(rng, ref)
    sites = [(f"g{i}", s := rng.randrange(0, len(ref) - 23), s + 23) for i in range(60)]
    sites += [(f"g{i}", s := rng.randrange(0, len(ref) - 23), s + 23) for i in range(0, 60, 5)]
    k, step = 15, 4
    want, spans, turned = plain(records, ref, sites, k, step)
    assert set(want.values()) == {C.ABSENT, C.AMBIGUOUS, C.WIDE, C.NOT_COVERED}
    df = spark.createDataFrame(list(records.items()), "seq_id string, seq string")
    guides = spark.createDataFrame([(g, s + 1, e) for g, s, e in sites], "guide_id string, ref_start int, ref_end int")
    parts = spark.createDataFrame([(1000, ref[1000:]), (0, ref[:1000]), (5, "")], "start int, seq string")
    laid = Z.Laid(df, Z.reference_of(parts, k), step, piece=piece)
    got = {}
    for r in laid.spans.collect():
        got.setdefault(r.seq_id, []).append((r.low, r.high))
    assert {s: sorted(v) for s, v in got.items()} == {s: v for s, v in spans.items() if v}
    told = {r.seq_id: r for r in laid.told.collect()}
    assert {s: r.turned for s, r in told.items()} == turned and all(r.length_bp == len(records[s] or "") and r.n_ambiguous == (records[s] or "").count("N") for s, r in told.items())
    rows = laid.statuses(guides, width=width).collect()
    assert {(r.seq_id, r.guide_id): r.status for r in rows} == want and len(rows) == len(want)
    whole = C.classify(C.laid(df, spark.createDataFrame([(ref,)], "seq string"), guides, k, step), spark.createDataFrame([], "seq_id string, guide_id string"))
    assert {(r.seq_id, r.guide_id): r.status for r in whole.collect()} == want


def test_chainer_equals_labels():
    import numpy as np

    rng = random.Random(7)
    for _ in range(40):
        rows = sorted((rng.randrange(0, 4000), rng.randrange(0, 600)) for _ in range(120))
        want = C.chain_labels(*np.array(rows).T, least=1).tolist()
        one = Z.Chainer(3000, 60)
        assert [one.label(r, q) for r, q in rows] == want


def test_nearest_equals_a_plain_search(spark):
    rng = random.Random(5)
    points = [(rng.choice("ab"), rng.randrange(0, 3000), rng.randrange(4)) for _ in range(200)]
    asks = [(i, rng.choice("abc"), rng.randrange(-50, 3100)) for i in range(150)]
    p, q = spark.createDataFrame(points, "k string, pos long, val long"), spark.createDataFrame(asks, "i int, k string, at long")
    for width in (7, 256, 10_000):
        got = {r.i: r.point and tuple(r.point) for r in Z.nearest(q, p, ["k"], "at", width=width).collect()}
        assert got == {i: max(((a, v) for k2, a, v in points if k2 == k and a <= at), default=None) for i, k, at in asks}
        got = {r.i: r.point and tuple(r.point) for r in Z.nearest(q, p, ["k"], "at", forward=True, width=width).collect()}
        assert got == {i: min(((a, v) for k2, a, v in points if k2 == k and a >= at), default=None) for i, k, at in asks}


def test_references_in_parts(spark):
    parts = spark.createDataFrame([(0, "ACGT"), (3, "AAAA")], "start int, seq string")
    with pytest.raises(ValueError, match="overlap"):
        Z.reference_of(parts, 3)
    assert len(Z.reference_of(parts.where("start < 0"), 3).code) == 0


def test_dictionaries_over_a_thousand_sites_score_the_same(spark):
    rng = random.Random(3)
    ref = bases(rng, 3000)
    df = spark.createDataFrame([("a", ref[:500]), ("b", bases(rng, 400))], "seq_id string, seq string")
    one = spark.createDataFrame([(ref,)], "seq string")
    for n in (1000, 1001):
        sites = spark.createDataFrame([(f"s{i}", 1 + i, 23 + i) for i in range(n)], "guide_id string, ref_start int, ref_end int")
        got = {r.seq_id: r.n for r in C.laid(df, one, sites).select("seq_id", F.size("scored").alias("n")).collect()}
        assert got["b"] == 0 and got["a"] > 400


def test_a_reference_of_several_rows_is_an_error(spark):
    parts = spark.createDataFrame([("p", 0, 1, 0, 0, 6)], "gene string, copy int, strand int, part int, start int, end int")
    two = spark.createDataFrame([("ATGAAA",), ("ATGCCC",)], "seq string")
    with pytest.raises(Exception, match="one sequence"):
        C.cds_copies(parts, two, strict=False).collect()
