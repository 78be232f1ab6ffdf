import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.grammar import Grammar
from corpusloom.operators import approx as A
from corpusloom.operators import components as CC
from corpusloom.operators import chains as C
from corpusloom.operators import denominators as D
from corpusloom.operators import model as M
from corpusloom.operators import presence as P
from corpusloom.operators import redundancy as R
from corpusloom.operators import select as X
from tests.test_sequences import random_bases, rc

G = Grammar("x", 6, "NGG")


def corpus(spark, rng, n=12):
    targets = sorted({random_bases(rng, 7) + "GG" for _ in range(15)})
    seqs = []
    for _ in range(n):
        s = random_bases(rng, 200, "ACGTACGTN")
        for t in rng.sample(targets, 5):
            at = rng.randrange(190)
            s = s[:at] + (t if rng.random() < 0.5 else rc(t)) + s[at + 9 :]
        seqs.append(s)
    guides = spark.createDataFrame([(f"t{i:02d}", t) for i, t in enumerate(targets)], "guide_id string, target string")
    records = spark.createDataFrame([(i, s, s.count("N") / len(s)) for i, s in enumerate(seqs)], "seq_id long, seq string, ambiguous_fraction double")
    want = {(i, f"t{j:02d}") for i, s in enumerate(seqs) for j, t in enumerate(targets) if t in s or rc(t) in s}
    return records, guides, want


def pairs_of(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_searching_makes_no_pairs_of_record_and_target(spark):
    rng = random.Random(5)
    long = random_bases(rng, 40)
    words = {"long": long, "back": rc(random_bases(rng, 23)), "short": "ACGTTGCA", "odd": "NNRY" + random_bases(rng, 20), "head": long[:16] + "ACGTACGT", "none": None}
    seqs = ["AC" + long, "TT" + rc(words["back"]) + "A", "GGACGTTGCAGG", words["odd"], long[:30], "", "é" + long, None, long[1:]]
    guides = spark.createDataFrame(list(words.items()), "guide_id string, target string")
    found = P.presence_by_search(spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string"), guides)
    assert sorted(map(tuple, found.collect())) == [(0, "long"), (1, "back"), (2, "short"), (3, "odd"), (6, "long")]
    assert "NestedLoopJoin" not in found._jdf.queryExecution().toString()


def test_presence_and_what_follows(spark):
    records, guides, want = corpus(spark, random.Random(1))
    found = P.presence(records.repartition(5), guides, G)
    assert pairs_of(found, "seq_id", "guide_id") == want == pairs_of(P.presence_by_search(records, guides), "seq_id", "guide_id")
    for r in P.conservation(records, guides, found, record_absences=4).collect():
        has = {i for i, g in want if g == r.guide_id}
        absent = [str(i) for i in range(12) if i not in has]
        assert (r.n_present, r.n_total, r.absent_in) == (len(has), 12, ";".join(sorted(absent[:4])) if len(absent) <= 4 else ";".join(map(str, absent[:4])))
    joint = P.pair_counts(found, *(guides.where(F.col("guide_id") < "t05").withColumn("conservation_fraction", F.lit(0.5)), guides.where(F.col("guide_id") >= "t05").withColumn("conservation_fraction", F.lit(0.5))), 12)
    for r in joint.collect():
        a, b = ({i for i, g in want if g == x} for x in (r.left_id, r.right_id))
        assert (r.n_both, r.n_any, r.n_neither) == (len(a & b), len(a | b), 12 - len(a | b))


def test_subset_sweep_has_a_row_for_an_empty_subset(spark):
    records, guides, want = corpus(spark, random.Random(2))
    found = spark.createDataFrame(sorted(want), "seq_id long, guide_id string")
    rows = {r.max_ambiguous: r for r in P.subset_sweep(records, found, guides.count(), [-1.0, 0.1, None]).collect()}
    assert (rows["-1"].n_records, rows["-1"].n_perfect, rows["none"].n_records) == (0, 0, 12)


def test_missing_score_is_an_error(spark):
    guides = spark.createDataFrame([("a", "X", 0.5, 1, False, "g", 1, "+")], "guide_id string, target string, gc_fraction double, max_homopolymer_run int, has_polyt boolean, gene string, ref_start int, strand string")
    scored = spark.createDataFrame([], "guide_id string, target string, n_present long, n_total long, conservation_fraction double")
    with pytest.raises(Exception, match="no partner"):
        P.ranked_report(guides, scored).collect()


def test_one_to_one_joins_fail_on_repeated_keys(spark):
    left, right = spark.createDataFrame([("a", 1), ("b", 2)], "k string, x int"), spark.createDataFrame([("b", 3.0), ("a", 4.0), ("z", 5.0)], "k string, y double")
    assert sorted(map(tuple, P.paired(left, right, "k").collect())) == [("a", 1, 4.0), ("b", 2, 3.0)]
    assert P.paired(right, left, "k", needed=False).columns == ["k", "y", "x"] and P.paired(right, left, "k", needed=False).count() == 2
    for one, two in ((left.unionByName(left), right), (left, right.unionByName(right.where("k = 'a'"))), (left, right.unionByName(right.where("k = 'z'")))):
        with pytest.raises(Exception, match="repeated on one side"):
            P.paired(one, two, "k").collect()
    with pytest.raises(Exception, match="no partner"):
        P.paired(right, left, "k").collect()


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(50)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in CC.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {x: root(x) for x in parent}


def test_representative_and_bridge(spark):
    records = spark.createDataFrame([("Z9", "Z9", 0.1, 10, False), ("A1", "A1", 0.1, 10, False), ("B2", "B2", 0.2, 99, True)], "seq_id string, accession string, ambiguous_fraction double, length_bp long, is_refseq boolean")
    edges = spark.createDataFrame([("Z9", "B2"), ("B2", "A1")], "u string, v string")
    got = {r.seq_id: (r.cluster_id, r.cluster_size, r.is_representative) for r in R.clusters(records, edges).collect()}
    assert got == {"A1": ("A1", 3, True), "B2": ("A1", 3, False), "Z9": ("A1", 3, False)}


@pytest.mark.parametrize("size", [40, 1000])
def test_nearest_by_rounds_equals_all_pairs(spark, size):
    """Families of near copies, loners, equal sketches, an empty one and a hash that all hold; cut sketches and whole ones."""
    rng = random.Random(size)
    sets = [[]]
    for _ in range(6):
        base = rng.sample(range(10, 10**6), 60)
        for _ in range(5):
            sets.append([*rng.sample(base, rng.randint(40, 60)), *rng.sample(range(10, 10**6), rng.randint(0, 30)), 5])
    sets += [[*rng.sample(range(10, 10**6), rng.randint(1, 50)), 5] for _ in range(10)] + [list(sets[3]), list(sets[3]), [7, 8]]
    sets = [sorted(set(x))[:size] for x in sets]

    def jaccard(x, y):
        union = sorted(set(x) | set(y))[:size]
        return round(len(set(x) & set(y) & set(union)) / len(union), 6) if union else 0.0

    want = {}
    for i, x in enumerate(sets):
        equal = [j for j, y in enumerate(sets) if j != i and y == x]
        # copies are tied to their first, which alone stands for them
        near = [(-jaccard(x, y), j) for j, y in enumerate(sets) if j != i and set(x) & set(y) and y not in sets[:j]]
        if equal:
            want[i] = (equal[0], 1.0)
        elif near:
            want[i] = (min(near)[1], -min(near)[0])
    t = spark.createDataFrame(list(enumerate(sets)), "seq_id long, sketch array<long>").repartition(3)
    found, rounds = R.nearest_by_rounds(t, 21, size)
    got = {r.seq_id: (r.nearest, r.nearest_jaccard) for r in found.collect()}
    assert got == want
    assert got == {r.seq_id: (r.nearest, r.nearest_jaccard) for r in R.nearest(t, R.similar_pairs(t, 21, size)).collect()}
    assert [r["limit"] for r in rounds] == [0.8, 0.3, 0.0] and rounds[2]["open"] < rounds[1]["open"] == rounds[0]["open"]


@pytest.mark.parametrize("size", [300, 5000])
def test_close_links_have_the_components_of_all_pairs(spark, size):
    """Copies, chains of records a base apart, records too far apart, one of another length, short and empty ones; cut sketches and whole ones."""
    rng = random.Random(size)
    other = {"A": "C", "C": "G", "G": "T", "T": "A"}
    seqs = ["", "ACGT", "A" * 30, "A" * 40]
    for n in (60, 700, 2500):
        base = "".join(rng.choice("ACGT") for _ in range(n))
        seqs += [base, base, base[:-1], base + "ACGTTGCAAC", base[: n // 2]]
        for _ in range(6):  # each a base from the one before
            at = rng.randrange(n)
            base = base[:at] + other[base[at]] + base[at + 1 :]
            seqs.append(base)
    r = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string").repartition(3)
    s = R.sketches(r, 21, size).cache()
    edges = R.similar_pairs(s, 21, size, 0.999).select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(R.copies(s))
    want = {(x.node, x.root) for x in R.components(edges).collect()}
    assert {(x.node, x.root) for x in R.components(R.close_links(r, 21, size, 0.999)).collect()} == want and len(want) > 12


def test_clusters_keep_no_sketches(spark, monkeypatch):
    """What the cluster query writes on its way is far smaller than the sketches: parts of them, and no more."""
    from corpusloom.operators import redundancy

    seen = []
    monkeypatch.setattr(redundancy, "cut", lambda df: seen.append(df.columns) or df.localCheckpoint())
    rng = random.Random(4)
    r = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(800))) for i in range(5)], "seq_id long, seq string")
    redundancy.close_links(r, 21, 5000, 0.999).count()
    assert seen and not any("sketch" in c for c in seen)
    assert redundancy._traces(r, 21, 5000, redundancy.least_jaccard(0.999, 21)).select(F.max(F.size("keys"))).first()[0] < 800 / 8


def test_sketches_go_out_in_small_batches():
    import pyarrow as pa
    from pyspark.sql import types as T

    class Plain:
        schema = T.StructType([T.StructField("seq_id", T.LongType()), T.StructField("seq", T.StringType())])

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    rng = random.Random(6)
    b = pa.RecordBatch.from_pydict({"seq_id": list(range(40)), "seq": ["".join(rng.choice("ACGT") for _ in range(100)) for _ in range(40)]})
    parts = list(R.sketches(Plain(), 21, 50, most=500)([b]))
    assert [x.num_rows for x in parts] == [10, 10, 10, 10, 0] and max(len(x.column(1).flatten()) for x in parts) == 500
    assert [i for x in parts for i in x.column(0).to_pylist()] == list(range(40))


@pytest.mark.parametrize(("length", "m"), [(12, 2), (20, 3), (21, 4)])
def test_similarity_join_is_lossless(spark, length, m):
    rng = random.Random(length)
    words = [random_bases(rng, length) for _ in range(8)]
    near = []
    for i in range(120):
        s = list(rng.choice(words))
        for p in rng.sample(range(length), rng.randint(0, m + 2)):
            s[p] = rng.choice("ACGTN")
        near.append((i, "".join(s)))
    got = {(r.id, r.guide_id, r.mismatches, r.mismatch_positions) for r in A.similarity_join(spark.createDataFrame(near, "id long, spacer string"), spark.createDataFrame([(f"w{i}", w) for i, w in enumerate(words)], "guide_id string, spacer string"), length, m).collect()}
    want = set()
    for i, s in near:
        for j, w in enumerate(words):
            at = [k + 1 for k in range(length) if s[k] != w[k] or s[k] == "N"]
            if len(at) <= m:
                want.add((i, f"w{j}", len(at), ",".join(map(str, at))))
    assert got == want
    assert sum(n for _, n in A.chunk_layout(length, m)) == length


@pytest.mark.parametrize("length", [2, 9, 23, 31])
def test_windows_at_one_substitution(spark, length):
    """Against every window of both strands: no pattern, N in the record, overlaps, a target that reads alike both ways."""
    rng = random.Random(length)
    targets = sorted({random_bases(rng, length) for _ in range(6)} | {(half := random_bases(rng, length // 2)) + "A" * (length % 2) + rc(half)})
    seqs = [None, "", targets[0][:-1]]
    for _ in range(8):
        s = random_bases(rng, 60, "ACGTN" if rng.random() < 0.5 else "ACGT")
        for _ in range(6):
            t = list(rng.choice(targets))
            for at in rng.sample(range(length), rng.randint(0, 2)):
                t[at] = rng.choice("ACGTN")
            t = "".join(t)
            s += (t if rng.random() < 0.5 else rc(t)) + random_bases(rng, rng.randint(0, 5), "ACGTN")
        seqs.append(s)
    want = set()
    for s in seqs:
        for i in range(len(s or "") - length + 1):
            for j, t in enumerate(targets):
                for w in (s[i : i + length], rc(s[i : i + length])):
                    at = [k + 1 for k in range(length) if w[k] != t[k]]
                    if len(at) == 1:
                        want.add((s, f"t{j}", w, at[0]))
    carried = {}
    for s, t, w, at in want:
        carried.setdefault((t, w, at), set()).update(i for i, x in enumerate(seqs) if x == s)
    records = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    guides = spark.createDataFrame([(f"t{j}", t) for j, t in enumerate(targets)], "guide_id string, target string")
    got = {(r.guide_id, r.variant, r.place): r.n_records for r in A.one_off_variants(records, guides).collect()}
    assert got == {k: len(v) for k, v in carried.items()} and got
    assert A.one_off_variants(records, guides.limit(0)).collect() == []


def test_interval_join_is_inclusive(spark):
    rng = random.Random(8)
    hits = [(i, rng.randint(1, 2), a, a + rng.randint(0, 40)) for i in range(60) for a in [rng.randint(0, 900)]]
    spans = [(rng.randint(1, 2), a, a + rng.randint(0, 400), f"n{i}") for i in range(40) for a in [rng.randint(0, 900)]]
    want = sorted((h, n) for h, c, a, b in hits for d, s, e, n in spans if c == d and s <= b and e >= a)
    for width in (16, 256):
        got = A.interval_join(spark.createDataFrame(hits, "hit_id long, chrom int, qs int, qe int"), spark.createDataFrame(spans, "chrom int, s int, e int, name string"), width)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_depths_and_names_equal_plain_counts(spark):
    """Repeated intervals, many on one place, some that end before they start, null names and places; stretches over several blocks."""
    rng = random.Random(9)
    hits = [(i, rng.choice([1, 2, None]), a, a + rng.randint(-5, 40)) for i in range(80) for a in [rng.randint(0, 900)]]
    spans = [(rng.randint(1, 2), a, a + rng.randint(-6, 200), rng.choice(["x", "y", None])) for _ in range(25) for a in [rng.randint(0, 900)]] * 2 + [(1, 2000, 2003, None), (1, None, 4, "z"), (1, 5000, 5001, "far")]
    hits += [(100, 1, 2001, 2002), (101, 1, 4990, 5010)]
    h = spark.createDataFrame(hits, "hit_id long, chrom int, qs int, qe int")
    o = spark.createDataFrame(spans, "chrom int, s int, e int, name string")
    meets = lambda c, a, b, d, s, e: c == d and s is not None and s <= b and e >= a
    names = {i: sorted({n for d, s, e, n in spans if n is not None and meets(c, a, b, d, s, e)}) for i, c, a, b in hits}
    assert {r.hit_id: (r.inside, r.names) for r in A.annotate(h, o).collect()} == {i: (bool(n), ",".join(n)) for i, n in names.items()}
    depth = {}
    for i, c, a, _ in hits:
        for d, s, e, n in spans:
            if meets(c, a, a, d, s, e):
                depth[i, n] = depth.get((i, n), 0) + 1
    points = h.select("hit_id", "chrom", F.col("qs").alias("at"))
    assert {(r.hit_id, r.name): r.depth for r in A.point_depths(points, o).collect()} == depth and max(depth.values()) > 3
    places = lambda rows: sorted((r.chrom, str(r.name), x, r.depth) for r in rows for x in range(r.s, r.e + 1))
    assert places(A.depths(o, block=64).collect()) == places(A.depths(o).collect())


def test_gates_and_skyline(spark):
    rows = [("a", 1, 1), ("b", 2, 1), ("c", 2, 1), ("d", 0, 9), ("e", None, 0)]
    t = spark.createDataFrame(rows, "id string, up int, down int")
    g = {r.id: r.gates_failed for r in X.gate(t, [("G1", F.col("up") >= 1), ("G2", F.col("down") < 5)]).collect()}
    assert g == {"a": "-", "b": "-", "c": "-", "d": "G1; G2", "e": "G1"}
    assert {r.id for r in X.pareto_front(t.where("up is not null"), "id", ["up"], ["down"]).collect()} == {"b", "c"}
    assert {r.id for r in X.pareto_front(t, "id", ["up"], ["down"]).collect()} == {"b", "c", "e"}
    assert {tuple(r) for r in X.dominance(t.where("up is not null"), "id", ["up"], ["down"]).collect()} == {("b", "a"), ("c", "a"), ("a", "d"), ("b", "d"), ("c", "d")}


@pytest.mark.parametrize("spread", [3, 40, 10**9])
def test_skyline_equals_all_comparisons(spark, spread):
    """Ties, equal points, nulls on an axis, extra columns, a front that is most of the table, cells of several sizes."""
    rng = random.Random(spread)
    rows = [(i, rng.randrange(spread), rng.random() if rng.random() < 0.9 else None, rng.randrange(spread), "x") for i in range(400)]
    rows += [(1000 + i, i, 2.0, i, "front") for i in range(60)] + [(2000, 5, 0.5, None, None)] + [(3000 + i, *rows[i][1:]) for i in range(20)]

    def beats(a, b):
        if None in a or None in b:
            return False
        weak = a[0] >= b[0] and a[1] >= b[1] and a[2] <= b[2]
        return weak and a != b

    want = {r[0] for r in rows if not any(beats(q[1:4], r[1:4]) for q in rows)}
    t = spark.createDataFrame(rows, "id long, up long, more double, down long, cell string").repartition(5)
    for cells in (2, 60, 1024):
        front = X.pareto_front(t, "id", ["up", "more"], ["down"], cells)
        assert front.columns == t.columns and sorted(r.id for r in front.collect()) == sorted(want)
    plan = front._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert X.pareto_front(t.limit(0), "id", ["up", "more"], ["down"]).collect() == []


def test_average_ranks_give_spearman(spark):
    rows = [("a", 1.0, 2.0, 20), ("b", 2.0, 2.0, 20), ("c", 3.0, 5.0, 20), ("d", 9.0, 9.0, 3)]
    r = D.compare(spark.createDataFrame(rows, "guide_id string, x double, y double, records long")).first()
    assert r.n_guides == 3 and r.spearman == pytest.approx(0.866025) and r.median_records == 20


def test_spectrum(spark):
    s = spark.createDataFrame([(0, 0.5), (-3, 0.25), (1, 0.25)], "length int, p double")
    r = M.spectrum_stats(s).first()
    assert (r.p_wild, r.inframe_fraction, r.mean_deletion) == (0.5, 0.5, 3.0)
    assert M.spectrum_stats(M.rescaled(s, 0.2)).first().inframe_fraction == pytest.approx(0.2)
    with pytest.raises(ValueError):
        M.rescaled(s, 1.0)


def test_window_viability(spark):
    tol = [0.5, 0.1, 1.0, 0.2]

    def plain(codon, m):
        m = max(1, m)
        starts = [s for s in range(codon - m + 1, codon + 1) if s >= 0 and s + m <= 4] or [max(0, min(codon, 4 - m))]
        return sum(math.prod(tol[s : s + m]) for s in starts) / len(starts)

    rows = [(c, m, tol) for c in range(6) for m in (0, 1, 2, 3, 4)]
    for r in spark.createDataFrame(rows, "codon int, m int, tol array<double>").withColumn("v", M.window_viability(F.col("tol"), F.col("codon"), F.col("m"))).collect():
        assert r.v == pytest.approx(plain(r.codon, r.m))


def test_set_model_and_search(spark):
    rng = random.Random(11)
    q, n = [0.1, 0.3, 0.2, 0.6, 0.05, 0.4], 20
    held = {i: {r for r in range(n) if rng.random() < 0.7} for i in range(6)}
    found = spark.createDataFrame([(r, f"s{i}") for i in held for r in held[i]], "seq_id long, guide_id string")
    qs = spark.createDataFrame([(f"s{i}", v) for i, v in enumerate(q)], "guide_id string, q double")
    value = lambda s: sum(math.prod(q[i] if r in held[i] else 1 for i in s) for r in range(n)) / n
    sets = [(k, s) for k, s in enumerate([(0,), (0, 1), (2, 3, 4)])]
    rows = spark.createDataFrame([(k, f"s{i}") for k, s in sets for i in s], "set_id long, guide_id string")
    for r in M.set_escape(found, rows, qs, n).collect():
        s = sets[r.set_id][1]
        assert r.p_escape == pytest.approx(value(s), abs=1e-9)
        assert r.joint == pytest.approx(len(set.intersection(*(held[i] for i in s))) / n)
    pair = {(r.a, r.b): r.p_escape for r in M.pair_escape(found, qs, n).collect()}
    assert all(pair[f"s{i}", f"s{j}"] == pytest.approx(value((i, j)), abs=1e-9) for i, j in combinations(range(6), 2))


def test_binomial_limit():
    assert M.binomial_upper(0, 100) == pytest.approx(1 - 0.05**0.01)
    assert M.binomial_upper(5, 5) == 1.0
    assert M.binomial_upper(1, 10) == pytest.approx(0.39416, abs=1e-4)


def test_offset_runs_and_map(spark):
    at = [(0, 0), (10, 0), (20, 3), (30, 3), (500, 3)]
    a = spark.createDataFrame([(1, r, r + s) for r, s in at], "seq_id long, ref int, qry int")
    runs = C.offset_runs(a)
    assert sorted((r.low, r.high, r["shift"], r.n) for r in runs.collect()) == [(0, 10, 0, 2), (20, 30, 3, 2), (500, 500, 3, 1)]
    m = C.position_map([(np.array([r for r, _ in at]), np.array([r + s for r, s in at]))], 600, 15)
    laid = {r: int(q) - r for r, q in enumerate(m) if q != C.NOWHERE}
    assert laid == {r: 0 for r in range(20)} | {r: 3 for r in range(20, 45)} | {r: 3 for r in range(500, 515)}  # of runs with as many anchors the last counts

