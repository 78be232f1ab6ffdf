"""Pairs by blocks of records against plain comparison of whole sketches."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.sequences import mash_identity
from corpusloom.operators import alike as L
from corpusloom.operators import redundancy as R
from corpusloom.operators.components import components
from corpusloom.operators.scan import sketch_of
from corpusloom.plans import catalogue
from corpusloom.session import shared_dir

K = 9


def corpus(n=90, seed=5):
    rng = random.Random(seed)
    word = lambda m: "".join(rng.choice("ACGT") for _ in range(m))
    common, out = word(60), []
    for i in range(n):
        s = word(rng.randrange(5, 600))
        if i % 3 == 0:
            s += common
        if i % 5 == 1 and out:
            s = out[-1] if i % 2 else out[-1][:-4] + word(4)
        out.append(s)
    return [*out, "", "ACG", "N" * 40]


def plain(texts, size):
    least = {i: x for i, t in enumerate(texts) if len(x := sketch_of(t, K, size))}
    first = {}
    for i in sorted(least):
        first.setdefault(least[i].tobytes(), i)
    ids = sorted(first.values())
    return [(a, b, R._jaccard(least[a], least[b], size)) for a in ids for b in ids if a < b and len(np.intersect1d(least[a], least[b]))]


@pytest.mark.parametrize("size", [40, 250, 5000])
def test_pairs_nearest_and_linkage_equal_plain_ones(spark, monkeypatch, size):
    monkeypatch.setattr(L, "CHUNK_BITS", 4)
    monkeypatch.setattr(L, "SLICE", 500)
    monkeypatch.setattr(L, "BUCKET", 3000)
    texts = corpus()
    records = spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")
    want = plain(texts, size)
    made = L.blocks(records, K, size)
    assert sorted(map(tuple, L.compared(made, L.same(made), K, size).collect())) == want
    pairs = spark.createDataFrame(want, "a long, b long, j double").select("a", "b", F.round("j", 6).alias("jaccard"), F.round(mash_identity(F.col("j"), K), 6).alias("identity"))
    sketched = R.sketches(records, K, size)
    assert sorted(map(tuple, L.nearest(records, K, size).collect())) == sorted(map(tuple, R.nearest(sketched, pairs).collect()))
    linked, tied = L.linkage(records, K, size, 0.9)
    assert sorted(map(tuple, tied.collect())) == sorted(map(tuple, R.copies(sketched).collect()))
    for limit in (0.9, 0.95, 0.99):
        one, two = (components(x.where(F.col("identity") >= limit).select(F.col("a").alias("u"), F.col("b").alias("v"))) for x in (linked, pairs))
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_packed_values_come_back():
    for values in ([0], [7, 7, 9], [1, 1 << 40, (1 << 60) - 1], list(range(0, 70000, 300))):
        assert L.unpack(L.pack(np.array(values, np.uint64))).tolist() == values


@pytest.mark.parametrize("name", ["nearest_record", "redundancy_sweep", "sketch_identity_pairs"])
def test_no_sketch_is_written(spark, tmp_path, name):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ACGT") for _ in range(3000)) for _ in range(100)]
    texts += [t[:-300] for t in texts[:5]]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t[:200]) for i, t in enumerate(texts[:5])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    shared = Path(shared_dir(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in shared.rglob("*") if f.is_file())
    before = size()
    rows = catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(rows) >= 3 and size() - before < 3 * sum(map(len, texts))  # the sketches alone are eight times the texts


def test_repeated_sequences_keep_no_hashes(spark, tmp_path):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ACGT") for _ in range(3000)) for _ in range(100)] * 2
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    shared = Path(shared_dir(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in shared.rglob("*") if f.is_file())
    before = size()
    rows = {r.seq_id: r.nearest for r in catalogue.QUERIES["nearest_record"](spark, str(tmp_path)).collect()}
    assert rows == {i: (i + 100) % 200 for i in range(200)} and size() - before < 2 * sum(map(len, texts))  # 12 bytes a hash otherwise


@pytest.mark.parametrize("size", [40, 250, 5000])
def test_tiles_equal_plain_similarities(monkeypatch, size):
    """Common hashes by matrices, few rows at once, and late ones in small groups."""
    monkeypatch.setattr(L, "DENSE", 6)
    monkeypatch.setattr(L, "ROWS", 5)
    monkeypatch.setattr(L, "SLICE", 300)
    first = {}
    for t in corpus(60):
        if len(x := sketch_of(t, K, size)):
            first.setdefault(x.tobytes(), x)
    held = list(first.values())

    def block(low, high):
        own = np.repeat(np.arange(high - low), [len(x) for x in held[low:high]])
        hashes, ranks = np.concatenate(held[low:high]), np.concatenate([np.arange(len(x)) + 1 for x in held[low:high]])
        order = np.argsort(hashes, kind="stable")
        return L.Block(list(range(low, high)), [len(x) for x in held[low:high]], hashes[order], own[order], ranks[order])

    x, y = block(0, 30), block(30, len(held))
    for one, two in ((x, x), (x, y), (y, y)):
        got = [(one.ids[a], two.ids[b], j) for part in L.tiles(one, two, size) for a, b, j in zip(*(c.tolist() for c in part), strict=True)]
        assert sorted(got) == [(a, b, R._jaccard(held[a], held[b], size)) for a in one.ids for b in two.ids if a < b and len(np.intersect1d(held[a], held[b]))]


def test_tiles_of_a_limit_get_only_records_that_can_reach_it(spark):
    rng = random.Random(6)
    word = lambda m: "".join(rng.choice("ACGT") for _ in range(m))
    common = word(400)
    texts = [word(400) + common[:40] for _ in range(20)] + [common + word(5) for _ in range(3)]
    made = L.blocks(spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string"), 21, 5000)
    left = L._trimmed(made.withColumn("gone", F.lit(None).cast("array<int>")), "bigint", 0.5, 5000)
    assert sorted(i for r in left.collect() for i in r.ids) == [20, 21, 22]
