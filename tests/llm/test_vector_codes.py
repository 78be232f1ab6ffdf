"""Product codes against Lloyd rounds that compare everything, and the kept bounds against what they skip."""

import hashlib
import math
import random

import numpy as np
import pytest

from corpusloom.llm import vector_codes

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, rounds=2):
    """By plain integers: {(id, vector): (code, error, label_error)} rows, and the digest of the codebooks."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(256 * x) for x in v] for _, v, _ in kept]
    w = len(ints[0]) // 16
    parts = [[v[p * w : p * w + w] for v in ints] for p in range(16)]
    books = [[list(x) for x in parts[p][:64]] for p in range(16)]

    def code(p, x):
        d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in books[p]]
        return d.index(min(d)), min(d)

    for step in range(rounds + 1):
        codes = [[code(p, x) for x in parts[p]] for p in range(16)]
        if step < rounds:
            for p in range(16):
                for e in range(len(books[p])):
                    mine = [x for x, (at, _) in zip(parts[p], codes[p], strict=True) if at == e]
                    if mine:
                        books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    sums, out = {}, []
    for k, (i, _, lab) in enumerate(kept):
        error = sum(codes[p][k][1] for p in range(16))
        sums[lab] = sums.get(lab, 0) + error
        out.append((i, "".join(f"{codes[p][k][0]:02x}" for p in range(16)), error, lab))
    digest = hashlib.sha256(",".join(str(c) for p in range(16) for e in books[p] for c in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[lab]) for i, c, e, lab in out), key=repr), digest


def made(n, width=32, seed=3, near=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(near, width))
    x = (centres[rng.integers(0, near, n)] + 0.2 * rng.normal(size=(n, width))).astype(np.float32)
    return [(int(i), [float(c) for c in v], int(i) % 3 if i % 7 else None) for i, v in enumerate(x)]


def result(df):
    out, book, states = vector_codes.encode(df)
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in out.collect()), key=repr), book and book.digest(), states


def test_codes_equal_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "ROWS", 50)
    rows = made(400)
    random.Random(1).shuffle(rows)
    got, digest, states = result(spark.createDataFrame(rows, ROWS).repartition(3))
    assert (got, digest) == brute(rows)
    seen = vector_codes.rescans(states)
    assert seen[0] == 400 * 16 and seen[1] <= seen[0] and seen[2] <= seen[0]


def test_rows_of_all_kinds(spark):
    """Bad vectors, ties, repeated rows and ids, null ids and labels, extra columns of our names."""
    rows = made(150, 16, near=3) + [(7, [0.5] * 16, 1), (7, [0.25] * 16, 1), (None, [0.5] * 16, None), (None, [-0.001] * 16, 2), (3, None, 1)]
    rows += [(4, [None] + [0.0] * 15, 1), (5, [float("nan")] + [0.0] * 15, 1), (6, [float("inf")] + [0.0] * 15, 1)] + made(150, 16, near=3)[:20]
    df = spark.createDataFrame([(*r, "x", None) for r in rows], ROWS + ", code string, error string")
    got, digest, _ = result(df)
    assert (got, digest) == brute(rows)


def test_few_rows_and_none(spark):
    rows = made(5, 16)
    got, digest, _ = result(spark.createDataFrame(rows, ROWS))
    assert (got, digest) == brute(rows)
    one = [(1, [0.1] * 16, None)]
    assert result(spark.createDataFrame(one, ROWS))[:2] == brute(one)
    out, book, _ = vector_codes.encode(spark.createDataFrame([(1, None, 1)], ROWS))
    assert out.collect() == [] and book is None and out.columns == ["vec_id", "code", "error", "label_error"]


def test_large_components_stay_exact(spark):
    rows = [(i, [((i * 37 + k * 11) % 23 - 11) * 70_001.25 for k in range(16)], 0) for i in range(90)]
    assert result(spark.createDataFrame(rows, ROWS))[:2] == brute(rows)
    with pytest.raises(ValueError):
        vector_codes.integers([[1e30] * 16])
    with pytest.raises(ValueError):
        vector_codes.integers([[1.0] * 16, [1.0] * 32])


def test_members_left_in_their_heaps_keep_their_entry():
    """Over many rounds of random moves, what is not popped would have kept its entry; most parts stay unread."""
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (600, 16, 2))
    book = vector_codes.Book(x[:20].transpose(1, 0, 2).copy())
    codes, keys, heaps, change, _ = vector_codes._first_block(x, book)
    read = []
    for _ in range(12):
        book = book.moved(change)
        codes, keys, heaps, change, count = vector_codes._next_block(x, codes, keys, heaps, book)
        read.append(count)
        want = np.stack([vector_codes.squares(x[:, p], book.entries[p]).argmin(1) for p in range(16)], 1)
        assert (codes == want).all()
        totals = np.zeros_like(book.totals)
        vector_codes._summed(totals, codes, x, 1)
        assert (book.totals + change == totals).all()
    assert read[-1] < 600 * 16 / 2
