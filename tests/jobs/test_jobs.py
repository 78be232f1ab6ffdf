"""The two jobs: growing input, reruns, failures, and their queries against SQL."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import sequences as S
from corpusloom.functions.grammar import GRAMMARS
from corpusloom.operators import approx as A
from corpusloom.operators import presence as P
from jobs import common, offtarget_screen, presence_ledger, queries
from tests.test_queries import DATA, duck, plain  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def letters(rng, n):
    return "".join(rng.choice("acgt") for _ in range(n))


@pytest.fixture
def corpus():
    """Benchmark passages, and documents of which many hold parts of them, some with a base changed."""
    rng = random.Random(11)
    passages = [letters(rng, 240) for _ in range(6)]
    docs = []
    for i in range(60):
        part = list(passages[i % 6][20 * (i % 7) : 20 * (i % 7) + 110])
        if i % 3:
            part[rng.randrange(len(part))] = rng.choice("acgt")
        docs.append((i, letters(rng, 30) + "".join(part) + letters(rng, 30), "en", "ab"[i % 2], 1))
    return passages, docs


def written(spark, tmp_path, corpus):
    passages, docs = corpus
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark"))
    return {"documents": str(tmp_path / "documents"), "benchmark": str(tmp_path / "benchmark"), "out": str(tmp_path / "out"), "checkpoint": str(tmp_path / "checkpoint")}, docs


def add(spark, path, rows):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(path)


def counted(rows):
    return {r.guide_id: (r.n_present, r.n_total, r.conservation_fraction) for r in rows.collect()}


def from_scratch(spark, paths, rows):
    """The same by the library's operators over all records at once."""
    g = presence_ledger.site_table(spark.read.parquet(paths["benchmark"]), GRAMMARS["spcas9"])
    r = spark.createDataFrame(rows, DOCS).select(F.col("doc_id").alias("seq_id"), S.from_text(F.coalesce("text", F.lit(""))).alias("seq"))
    c = P.conservation(r, g, P.presence(r, g, GRAMMARS["spcas9"]))
    return {x.guide_id: (x.n_present, x.n_total, x.conservation_fraction) for x in c.collect()}


def test_ledger_takes_only_what_is_new(spark, tmp_path, corpus, caplog):
    paths, docs = written(spark, tmp_path, corpus)
    add(spark, paths["documents"], docs[:25])
    one = counted(presence_ledger.run(spark, **paths))
    assert one == from_scratch(spark, paths, docs[:25]) and any(v[0] for v in one.values())
    records = lambda: {(r.seq_id, r.batch) for r in spark.read.parquet(paths["out"] + "/records").collect()}
    assert records() == {(i, 0) for i in range(25)}
    add(spark, paths["documents"], docs[25:40])
    add(spark, paths["documents"], docs[40:])
    caplog.set_level("INFO", "jobs")
    two = counted(presence_ledger.run(spark, **paths, files_per_batch=1))
    assert two == from_scratch(spark, paths, docs) and two != one
    assert {i for i, b in records() if b > 0} == set(range(25, 60)) and max(b for _, b in records()) == 2
    assert "read 15 documents" in caplog.text and "read 20 documents" in caplog.text and "read 25 documents" not in caplog.text
    stamp = sorted((f.name, f.stat().st_mtime_ns) for f in Path(paths["out"], "presence").rglob("*.parquet"))
    assert counted(presence_ledger.run(spark, **paths)) == two
    assert stamp == sorted((f.name, f.stat().st_mtime_ns) for f in Path(paths["out"], "presence").rglob("*.parquet"))  # nothing scanned again


def test_ledger_replaces_records_and_replays_batches(spark, tmp_path, corpus):
    paths, docs = written(spark, tmp_path, corpus)
    add(spark, paths["documents"], docs + [(None, docs[0][1], "en", "a", 1), (99, None, None, None, None)])
    presence_ledger.run(spark, **paths)
    revised = [(i, docs[(i + 1) % 60][1], "en", "b", 1) for i in range(0, 60, 4)]
    add(spark, paths["documents"], revised)
    now = {d[0]: d for d in docs} | {d[0]: d for d in revised} | {99: (99, None, None, None, None)}
    got = counted(presence_ledger.run(spark, **paths))
    assert got == from_scratch(spark, paths, list(now.values()))
    # a batch that runs again writes the same rows
    guides = spark.read.parquet(paths["out"] + "/guides")
    before = sorted(map(tuple, spark.read.parquet(paths["out"] + "/presence").collect()))
    presence_ledger.take(spark.createDataFrame(revised, DOCS), 1, guides, GRAMMARS["spcas9"], paths["out"])
    assert sorted(map(tuple, spark.read.parquet(paths["out"] + "/presence").collect())) == before


def test_ledger_goes_on_after_a_failure(spark, tmp_path, corpus, monkeypatch):
    paths, docs = written(spark, tmp_path, corpus)
    add(spark, paths["documents"], docs[:30])
    add(spark, paths["documents"], docs[30:])
    take, calls = presence_ledger.take, []

    def failing(batch, number, *rest):
        take(batch, number, *rest)
        calls.append(number)
        if len(calls) == 2:
            raise RuntimeError("lost after writing")

    monkeypatch.setattr(presence_ledger, "take", failing)
    with pytest.raises(Exception, match="lost after writing"):
        presence_ledger.run(spark, **paths, files_per_batch=1)
    got = counted(presence_ledger.run(spark, **paths, files_per_batch=1))
    assert calls == [0, 1, 1] and got == from_scratch(spark, paths, docs)


def test_ledger_refuses_other_sites(spark, tmp_path, corpus):
    paths, docs = written(spark, tmp_path, corpus)
    add(spark, paths["documents"], docs[:5])
    presence_ledger.run(spark, **paths)
    with pytest.raises(ValueError, match="new folder"):
        presence_ledger.run(spark, **paths, grammar="sacas9_relaxed")


def test_ledger_of_no_documents(spark, tmp_path, corpus):
    paths, _ = written(spark, tmp_path, corpus)
    add(spark, paths["documents"], [])
    got = presence_ledger.run(spark, **paths).collect()
    assert got and all((r.n_present, r.n_total, r.conservation_fraction) == (0, 0, None) for r in got)


def test_screen_equals_comparing_everything(spark, tmp_path, corpus):
    paths, docs = written(spark, tmp_path, corpus)
    paths.pop("checkpoint")
    add(spark, paths["documents"], [*docs, (77, None, None, None, None)])
    told = {r.guide_id: r for r in offtarget_screen.run(spark, **paths).collect()}
    loose = GRAMMARS["sacas9_relaxed"]
    seqs = {d[0]: sequence(spark, d[1]) for d in docs[:12]}
    table = str.maketrans("ACGT", "TGCA")
    want = set()
    for i, s in seqs.items():
        for strand in "+-":
            t = s if strand == "+" else s.translate(table)[::-1]
            for at in range(len(t) - loose.length + 1):
                w = t[at : at + loose.length]
                if w[23] == "G" and w[24] in "AG" and w[25] in "AG":
                    start = at if strand == "+" else len(t) - at - loose.length
                    for g, r in told.items():
                        m = [k + 1 for k in range(21) if w[k] != r.protospacer[k]]
                        if len(m) <= 3:
                            want.add((g, i, start + 1, strand, len(m), sum(k > 9 for k in m), "strict" if w[26] == "T" else "relaxed"))
    hits = spark.read.parquet(paths["out"] + "/hits")
    got = {(h.guide_id, h.seq_id, h.start, h.strand, h.mismatches, h.seed_mismatches, h.pam_class) for h in hits.where("seq_id < 12").collect()}
    assert got == want and want
    all_hits = hits.collect()
    for g, r in told.items():
        mine = [h for h in all_hits if h.guide_id == g]
        assert (r.all_total, r.strict_total) == (len(mine), sum(h.pam_class == "strict" for h in mine))
        assert r.all_mm0 == sum(h.mismatches == 0 for h in mine) and r.all_le2 == sum(h.mismatches <= 2 for h in mine) and r.strict_seed_le1 == sum(h.pam_class == "strict" and h.seed_mismatches <= 1 for h in mine)
    again = {r.guide_id: r for r in offtarget_screen.run(spark, **paths).collect()}
    assert again == told


def sequence(spark, t):
    return spark.createDataFrame([(t,)], "t string").select(S.from_text("t")).first()[0]


def test_wrong_counts_fail(spark):
    hits = spark.createDataFrame([("a", "ACGTT", 1)], "guide_id string, target string, mismatches int")
    book = spark.createDataFrame([("a", "ACGA")], "guide_id string, spacer string")
    assert A.verified(hits, book, 4).count() == 1
    with pytest.raises(Exception, match="does not have its mismatches"):
        A.verified(hits.withColumn("mismatches", F.lit(0)), book, 4).collect()
    with pytest.raises(Exception, match="does not have its mismatches"):
        A.verified(hits.withColumn("guide_id", F.lit("z")), book, 4).collect()


def test_command_lines_and_settings(tmp_path):
    told, settings = common.options("presence_ledger", ["documents", "out"], ["--documents", "x", "--out", "y"])
    assert told == {"documents": "x", "out": "y"} and settings == {"grammar": "spcas9", "files_per_batch": 64}
    other = tmp_path / "c.json"
    other.write_text(json.dumps({"mismatches": 2}))
    assert common.options("offtarget_screen", ["out"], ["--out", "y", "--config", str(other)]) == ({"out": "y"}, {"mismatches": 2})


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.partitionOverwriteMode", "spark.sql.shuffle.partitions")}
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.execute(queries.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols and got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert before == {k: spark.conf.get(k, None) for k in before}
