"""The Jaccard join against all pairs compared plainly."""

import random

import numpy as np
import pytest

from corpusloom.llm import jaccard_join

DOCS = "doc_id long, text string"


def brute(rows):
    """[(id, set size, smallest id reachable)] by position, all pairs compared."""
    sets = []
    for _, t in rows:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), k) if x is not None), default=None)
    return sorted(((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def changed(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


def corpus(seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(900)}" for _ in range(rng.choice([6, 9, 40, 200]))] for _ in range(40)]
    texts = [" ".join(b) for b in base] + [" ".join(changed(rng, b, min(len(b), k % 5))) for k, b in enumerate(base * 2)]
    hub = [f"h{k}" for k in range(300)]
    texts += [" ".join(changed(rng, hub, k % 14)) for k in range(70)]
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [" ".join(changed(rng, base[3] * 2, 12)) + " " + passage for _ in range(12)]
    texts += [passage] * 3 + [None, "", " \t\n", "one two", "One  two", "one two three four", "one two three four five", "x", "ÉTÉ x", "été x", "a b"]
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


def test_join_equals_all_pairs(spark):
    rows = corpus(2)
    want = brute(rows)
    assert got(jaccard_join.linked_documents(spark.createDataFrame(rows, DOCS))) == want
    assert len({x[2] for x in want}) < len(want) - 60


@pytest.mark.parametrize("leaf, block, divided, pivots", [(4, 9, 0.5, 3), (4, 9, 0.0, 3), (4, 3, 0.95, 6), (12, 64, 0.5, 24)])
def test_regions_divide_and_lose_nothing(spark, monkeypatch, leaf, block, divided, pivots):
    """Tiny leaves: regions are divided around pivots, again and again, or compared by blocks, with the same result."""
    for name, value in {"LEAF": leaf, "BLOCK": block, "DIVIDED": divided, "PIVOTS": pivots}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rows = corpus(5)
    assert got(jaccard_join.linked_documents(spark.createDataFrame(rows, DOCS))) == brute(rows)


def test_heavy_sets_divide_too(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "WEIGHT", 900)
    rows = corpus(6)
    assert got(jaccard_join.linked_documents(spark.createDataFrame(rows, DOCS))) == brute(rows)


def test_copies_without_a_centre(spark, monkeypatch):
    """Texts that all differ from a text that is not there: near to each other, few of them linked."""
    monkeypatch.setattr(jaccard_join, "LEAF", 8)
    rng = random.Random(8)
    hub = [f"h{k}" for k in range(400)]
    rows = [(i, " ".join(changed(rng, hub, rng.randrange(5, 12)))) for i in range(80)]
    assert got(jaccard_join.linked_documents(spark.createDataFrame(rows, DOCS))) == brute(rows)


def test_rows_of_all_kinds(spark):
    """Null keys, repeated rows, one key of two texts, clashing and null columns, an empty table, a long text."""
    long = " ".join(f"z{k % 5000}q{k % 7}" for k in range(60_000))
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "q r s t u v"), (4, "q r s t u v"), (5, "q r s t u v"), (5, "k l m n o p"), (6, "k l m n o p"), (7, long), (8, long + " end"), (9, None)]
    df = spark.createDataFrame([(k, t, None, "s", 1) for k, t in rows], DOCS + ", component_id string, sid string, n int")
    assert got(jaccard_join.linked_documents(df)) == brute(rows)
    assert jaccard_join.linked_documents(df.where("doc_id < 0")).collect() == []


def test_linked_sets_share_a_first_shingle():
    rng = np.random.default_rng(1)
    for n in [1, 2, 4, 5, 9, 10, 50, 333]:
        for _ in range(60):
            counts = rng.integers(0, 4, jaccard_join.CELLS)
            a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            most = n // 9
            b = np.unique(np.concatenate((a[rng.permutation(n)[most:]], rng.integers(0, 1 << 63, most, np.uint64))))
            if jaccard_join.linked(jaccard_join.shared(a, b), len(a), len(b)):
                assert jaccard_join.shared(np.sort(jaccard_join.first(a, counts)), np.sort(jaccard_join.first(b, counts)))


def test_sieve_keeps_every_link():
    """Groups by profiles hold all linked pairs, and few others."""
    rng = np.random.default_rng(3)
    sets = []
    for n in [3, 8, 40, 41, 300, 330, 700, 2000]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            sets.append(a)
            for part in (0.05, 0.11, 0.2):
                gone = max(1, int(n * part))
                sets.append(np.unique(np.concatenate((a[rng.permutation(n)[gone:]], rng.integers(0, 1 << 63, rng.integers(0, gone + 1), np.uint64)))))
    sizes = [len(s) for s in sets]
    groups = jaccard_join.sieved(list(range(len(sets))), sizes, [jaccard_join.profile(s) for s in sets])
    of = {x: k for k, g in enumerate(groups) for x in g}
    links = 0
    for i in range(len(sets)):
        for j in range(i):
            if jaccard_join.linked(jaccard_join.shared(sets[i], sets[j]), sizes[i], sizes[j]):
                links += 1
                assert of[i] == of[j]
    assert links > 50 and max(map(len, groups)) < 20


def test_a_region_that_does_not_divide_is_compared_once(spark, monkeypatch):
    """Near copies at many distances: each pivot's cell holds most of the region, whose nodes are not sent once for each."""
    rng = random.Random(8)
    base, few = [f"w{rng.randrange(5000)}" for _ in range(300)], [f"x{k}" for k in range(12)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.sample(range(300), rng.choice([2, 5, 12, 20])):
            words[at] = rng.choice(few)
        rows.append((i, " ".join(words)))
    sent, write = {}, jaccard_join.written

    def counted(df, label):
        out = write(df, label)
        sent[label] = sent.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "LEAF", 64)
    monkeypatch.setattr(jaccard_join, "written", counted)
    assert got(jaccard_join.linked_documents(spark.createDataFrame(rows, DOCS))) == brute(rows)
    assert sent["join-whole"] > 64 and sent["join-open"] < 2 * sent["join-whole"]


def test_overlaps_equal_plain_ones(monkeypatch):
    from corpusloom.operators import alike

    rng = np.random.default_rng(3)
    draw = lambda n: [np.unique(rng.integers(0, 400, rng.integers(1, 60)).astype(np.uint64) << np.uint64(50) | np.uint64(7)) for _ in range(n)]
    for dense in (0, 30, 10**9):
        monkeypatch.setattr(alike, "DENSE", dense)
        left, right = draw(40), draw(25)
        assert jaccard_join.overlaps(left, right).tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]
        assert not jaccard_join.overlaps(left, [np.array([1], np.uint64)]).any()
