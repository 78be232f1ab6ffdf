import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.grammar import GRAMMARS
from corpusloom.plans import freshness
from corpusloom.sources import catalogue as C


def test_pages_are_read_and_filtered(spark, tmp_path):
    rows = [{"uid": f"U{i}.1", "taxid": 1 + i % 2, "length_bp": 100 * i, "title": "complete genome" if i % 3 else "a patent, complete", "record_class": "x"} for i in range(12)]
    for p in range(3):
        (tmp_path / f"page-{p}.json").write_text("\n".join(json.dumps(r) for r in rows[4 * p : 4 * p + 4] + rows[:1]))
    got = C.read_catalogue(spark, str(tmp_path))
    assert got.count() == 12
    assert {r.uid for r in got.where(C.selection(2, 100, 900)).collect()} == {"U1.1", "U5.1", "U7.1"}
    tagged = C.tagged_corpus(got, [("odd", F.col("taxid") == 2), ("all", F.lit(True))], 2)
    assert sorted((r.record_class, r.uid) for r in tagged.collect()) == [("all", "U0.1"), ("all", "U1.1"), ("odd", "U1.1"), ("odd", "U11.1")]
    cached = spark.createDataFrame([("U1",), ("U2.9",)], "uid string")
    assert C.missing(got, cached).count() == 10


def test_retries_and_rate():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert C.with_retries(flaky, sleep=waits.append) == 7 and waits == [0.5, 1.0]
    with pytest.raises(OSError):
        C.with_retries(lambda: open("/nonexistent/x"), tries=2, sleep=lambda s: None)
    slept = []
    limit = C.RateLimiter(2.0, clock=lambda: 10.0, sleep=slept.append)
    limit.wait()
    limit.wait()
    assert slept == [2.0]


def test_freshness(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.write_text("1")
    assert freshness.needs_rebuild(str(b), [str(a)])
    b.write_text("2")
    os.utime(a, (1, 1))
    assert not freshness.needs_rebuild(str(b), [str(a)]) and freshness.needs_rebuild(str(b), [str(a)], force=True)
    g = GRAMMARS["spcas9"]
    stored = {"spacer": 20, "pam": "NGG", "reference": "r", "genes": ["x", "y"]}
    assert freshness.same_configuration(stored, g, "r", ["x"]) and not freshness.same_configuration(stored, g, "r", ["z"])
    guides = spark.createDataFrame([("g1",), ("g2",)], "guide_id string")
    found = spark.createDataFrame([(1, "g1"), (2, "g2")], "seq_id long, guide_id string")
    assert freshness.guides_without_record(guides, found, 1) == 1
    t = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    assert freshness.close_to(t, t.where("k = 'a'"), "k", "v") == 1
