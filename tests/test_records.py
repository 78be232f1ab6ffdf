import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import sequences as Q
from corpusloom.operators import redundancy, select
from corpusloom.sources import catalogue as C
from corpusloom.sources import texts


def test_codes(spark):
    df = spark.createDataFrame([("acGTn-\u00df\n",), ("",), (None,)], "s string")
    codes = Q.base_codes(F.col("s"))
    got = [tuple(r) for r in df.select(codes, Q.bases_of(codes), Q.revcomp_codes(codes)).collect()]
    assert got == [("01234444", "ACGTNNNN", "44440123"), ("", "", ""), (None, None, None)]


def test_country(spark):
    df = spark.createDataFrame([(" Chile : Lota",), ("Peru",), (": x",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(Q.country_of(F.col("c"))).collect()] == ["Chile", "Peru", None, None, None]


def test_fetch_by_id(spark):
    schema = T.StructType([T.StructField("uid", T.StringType()), T.StructField("n", T.LongType())])

    def fetch(uids):
        assert len(uids) <= 3
        return [{"uid": u, "n": None if u == "u0" else len(uids)} for u in uids if u != "gone"]

    ids = spark.createDataFrame([(f"u{i}",) for i in range(10)] + [("u1",), ("gone",), (None,)], "uid string").coalesce(1)
    got = C.fetch_by_id(ids, fetch, schema, 3).collect()
    assert sorted(r.uid for r in got) == [f"u{i}" for i in range(10)]
    assert all((r.n is None) == (r.uid == "u0") for r in got)
    assert C.fetch_by_id(ids.limit(0), fetch, schema).count() == 0


def test_cached_records(spark, tmp_path):
    for name in ("a.1.fasta", "b.fasta", "c.txt"):
        (tmp_path / name).write_text("x")
    rows = spark.createDataFrame([("a.1", 1), ("a.1", 2), ("c", 3), (None, 4)], "uid string, n int")
    assert sorted(r.n for r in C.cached_records(rows, str(tmp_path)).collect()) == [1, 2]


def test_top_overlap(spark):
    rows = [("base", k, v) for k, v in zip("abcd", (4, 3, 2, 1))] + [("other", k, v) for k, v in zip("abcd", (1, 4, 3, 2))] + [("none", "z", 9)]
    got = select.top_overlap(spark.createDataFrame(rows, "s string, k string, v int"), "s", "k", [F.desc("v"), F.col("k")], "base", 2)
    assert {r.s: r.shared for r in got.collect()} == {"base": 2, "other": 1, "none": 0}


def test_identity_range(spark):
    pairs = spark.createDataFrame([(0.5,), (0.9,), (1.0,)], "identity double")
    assert tuple(redundancy.identity_range(pairs).first()) == (3, 0.5, 0.9, 1.0)
    assert tuple(redundancy.identity_range(pairs.limit(0)).first()) == (0, None, None, None)


def test_cached_text(spark, tmp_path):
    path, asked = str(tmp_path / "r"), []

    def fetch():
        asked.append(1)
        return f"LOCUS {len(asked)}\nx"

    good = lambda t: "LOCUS" in t[:200]
    with pytest.raises(ValueError):
        texts.cached_text(spark, path, lambda: "no", good)
    read = lambda **more: [r.value for r in texts.cached_text(spark, path, fetch, good, **more).collect()]
    assert read() == read() == ["LOCUS 1\nx"] and len(asked) == 1
    assert read(refresh=True) == ["LOCUS 2\nx"]
