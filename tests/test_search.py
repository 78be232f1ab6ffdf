"""Set search, settings and thresholds on the cluster against plain versions of the same rules."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import search as Z
from corpusloom.operators import sweep as Y

ROUND = 12


class Plain:
    """The rules on a dense table."""

    def __init__(self, held, q, genes, middle, n, apart, per_gene):
        self.held, self.q, self.genes, self.middle, self.n, self.apart, self.per_gene = held, q, genes, middle, n, apart, per_gene

    def value(self, s):
        return round(sum(math.prod(self.q[i] if r in self.held[i] else 1.0 for i in s) for r in range(self.n)) / self.n, ROUND)

    def fits(self, i, chosen):
        if any(i == j or self.genes[i] == self.genes[j] and abs(self.middle[i] - self.middle[j]) < self.apart for j in chosen):
            return False
        return not self.per_gene or sum(self.genes[i] == self.genes[j] for j in chosen) < self.per_gene

    def add(self, chosen):
        return min(((self.value([*chosen, i]), i) for i in range(len(self.q)) if self.fits(i, chosen)), default=None)

    def best(self, k, starts):
        singles = sorted((self.value([i]), i) for i in range(len(self.q)))
        if k == 1:
            return singles[0][0], [singles[0][1]]
        if k == 2 and not self.per_gene:
            return min((self.value(c), list(c)) for c in combinations(range(len(self.q)), 2) if self.fits(c[1], [c[0]]))
        found = []
        for _, first in singles[:starts]:
            own = [first]
            while len(own) < k and (got := self.add(own)):
                own.append(got[1])
            if len(own) < k:
                continue
            own = sorted(own)
            now = self.value(own)
            for _ in range(25):
                changed = False
                for place in range(k):
                    rest = [x for i, x in enumerate(own) if i != place]
                    got = self.add(rest)
                    if got and got[0] < now - 5e-12:
                        now, own, changed = got[0], sorted([*rest, got[1]]), True
                if not changed:
                    break
            found.append((now, own))
        return min(found, default=None)


@pytest.mark.parametrize("seed, per_gene", [(1, 0), (2, 1)])
def test_best_sets_equal_plain_search(spark, seed, per_gene):
    rng = random.Random(seed)
    size, n = 11, 40
    held = {i: {r for r in range(n) if rng.random() < rng.choice([0.05, 0.5, 0.9])} for i in range(size)}
    genes, middle = [rng.choice("abc") for _ in range(size)], [rng.randrange(0, 600) for _ in range(size)]
    qs = {m: [rng.choice([0.0, 0.1, 0.1, 0.4, 1.0]) for _ in range(size)] for m in range(3)}
    found = spark.createDataFrame([(r, f"s{i:02d}") for i in held for r in held[i]], "seq_id long, guide_id string")
    sites = spark.createDataFrame([(f"s{i:02d}", genes[i], middle[i]) for i in range(size)], "guide_id string, gene string, middle int")
    q = spark.createDataFrame([(m, f"s{i:02d}", v) for m, x in qs.items() for i, v in enumerate(x)], "model int, guide_id string, q double")
    g = Z.Ground(found, n, sites, q, 150, per_gene)
    for k in (1, 2, 3):
        got = {r.model: (r.value, [int(m.guide_id[1:]) for m in r.members]) for r in g.best(k, 3).collect()}
        for m, x in qs.items():
            want = Plain(held, x, genes, middle, n, 150, per_gene).best(k, 3)
            assert (got[m] == (want[0], want[1])) if want else m not in got
    if not per_gene:
        full = {r.model: (r.value, r.n_sets) for r in g.exhaustive(3, 8).collect()}
        for m, x in qs.items():
            one = Plain(held, x, genes, middle, n, 150, 0)
            pool = [i for _, i in sorted((one.value([i]), i) for i in range(size))[:8]]
            ok = [c for c in combinations(sorted(pool), 3) if all(one.fits(a, [b]) for a, b in combinations(c, 2))]
            assert full.get(m, (None, 0)) == ((min(map(one.value, ok)), len(ok)) if ok else (None, 0))


def test_curve_and_thresholds(spark):
    held = {0: set(range(8)), 1: set(range(4, 10)), 2: {0, 9}}
    q = [0.1, 0.2, 0.5]
    found = spark.createDataFrame([(r, f"s{i}") for i in held for r in held[i]], "seq_id long, guide_id string")
    sites = spark.createDataFrame([(f"s{i}", f"g{i}", 0) for i in range(3)], "guide_id string, gene string, middle int")
    g = Z.Ground(found, 10, sites, spark.createDataFrame([(0, f"s{i}", v) for i, v in enumerate(q)], "model int, guide_id string, q double"))
    rows = {r.k: r for r in g.curve(3).collect()}
    one = Plain(held, q, ["a", "b", "c"], [0] * 3, 10, 150, 0)
    assert [rows[k].value for k in (1, 2, 3)] == [one.value([0]), one.value([0, 1]), one.value([0, 1, 2])]
    assert rows[2].joint == pytest.approx(0.4) and rows[3].joint == 0
    assert rows[2].independent == pytest.approx((1 - 0.9 * 0.8) * (1 - 0.8 * 0.6))
    least = {r.limit: (r.k, r.reached) for r in Z.minimum_k(g.curve(3), [0.9, 0.2, 1e-9]).collect()}
    assert least == {0.9: (1, rows[1].value), 0.2: (2, rows[2].value), 1e-9: (None, None)}
    ids = spark.range(10).select(F.col("id").alias("seq_id"), F.col("id").alias("rank"))
    drawn = Z.drawn(found, 10, [("s0", 0.1), ("s1", 0.2)], ids, 100_000, 5).first()
    assert abs(drawn.estimate - rows[2].value) < 5 * drawn.error


def test_a_ground_without_presence(spark):
    sites = spark.createDataFrame([("a", "g", 0), ("b", "h", 0)], "guide_id string, gene string, middle int")
    q = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.1)], "model int, guide_id string, q double")
    g = Z.Ground(spark.createDataFrame([], "seq_id long, guide_id string"), 4, sites, q)
    assert [(r.value, [m.guide_id for m in r.members]) for r in g.best(2).collect()] == [(1.0, ["a", "b"])]


def test_settings_escape_equals_plain_windows(spark):
    rng = random.Random(4)
    spectra = Y.spectra(spark, spark.createDataFrame([(0, 5), (-3, 2), (1, 1), (6, 1), (2, 0)], "length int, weight long"))
    by = {}
    for r in spectra.collect():
        by.setdefault(r.spectrum, {})[r.length] = r.p
    assert all(sum(v.values()) == pytest.approx(1) for v in by.values()) and by["measured"] == {-3: 0.5, 1: 0.25, 6: 0.25}
    for t in Y.IN_FRAME:
        assert sum(p for n, p in by[f"default@{t:g}"].items() if n % 3 == 0) == pytest.approx(t)
    sites = [(f"s{i}", "gh"[i % 2], rng.randrange(0, 30), rng.choice([1, 2]), [rng.randrange(0, 6) for _ in range(30)]) for i in range(9)] + [("short", "g", 1, 1, [0, 3])]
    settings = Y.one_at_a_time("g")
    assert len(settings) == 37 and len({s[2] for s in settings}) == 37
    got = {(r.setting, r.guide_id): r.q for r in Y.settings_escape(spark.createDataFrame(sites, "guide_id string, gene string, codon int, n_copies int, variants array<int>"), spark.createDataFrame(settings, Y.SETTING), spectra).collect()}
    for setting, _, _, spectrum, tv, ti, least, repeat, gene, shift, disrupt in settings:
        for name, g, codon, copies, variants in sites:
            tol = [tv if v >= least else ti for v in variants]
            q = 0.0
            for n, p in by[spectrum].items():
                if n % 3:
                    q += p * (shift if g == gene else 0.0)
                    continue
                m = max(1, abs(n) // 3)
                starts = [s for s in range(codon - m + 1, codon + 1) if s >= 0 and s + m <= len(tol)] or [max(0, min(codon, len(tol) - m))]
                q += p * sum(math.prod(tol[s : s + m]) * ti ** max(0, s + m - len(tol)) for s in starts) / len(starts)
            q = min(1.0, max(0.0, disrupt * q))
            q = q if copies == 1 or repeat == "single" else 1 - (1 - q) ** copies if repeat == "redundant" else q**copies
            if name != "short":
                assert got[setting, name] == pytest.approx(q, abs=1e-9)


def test_ranks_inside_each_setting(spark):
    q = {0: [0.1, 0.1, 0.3, 0.2], 1: [0.4, 0.1, 0.1, 0.1], 2: [0.5] * 4}
    df = spark.createDataFrame([(s, f"g{i}", v) for s, x in q.items() for i, v in enumerate(x)], "setting int, guide_id string, q double")
    rank = lambda x: [sum(v < y for v in x) + (sum(v == y for v in x) + 1) / 2 for y in x]

    def rho(a, b):
        a, b = rank(a), rank(b)
        ma, mb = sum(a) / 4, sum(b) / 4
        return sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))

    got = {r.setting: r for r in Y.compared(df, top=2).collect()}
    assert got[0].spearman == pytest.approx(1) and got[1].spearman == pytest.approx(rho(q[0], q[1])) and got[2].spearman is None
    assert [got[s].top_overlap for s in range(3)] == [1.0, 0.5, 1.0]
