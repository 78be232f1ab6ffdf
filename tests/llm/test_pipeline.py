"""The pipeline: its contract, clashing columns, and its stages against plain versions."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import bpe, decontaminate, pipeline, quality_model, secrets
from corpusloom.llm.queries import QUERIES, SQL, bucket, table, tokenizer_path

from .test_near_dedup import brute

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def tables():
    if not Path(DATA).exists():
        pytest.skip("no test tables here")


def test_names():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 13))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans", "BPE encoding and decoding"]


def test_stages_one_by_one(spark):
    docs = table(spark, DATA, "documents").withColumn("fp", F.lit(1)).withColumn("found", F.lit("x")).withColumn("score", F.lit(2)).withColumn("leaks", F.lit(3)).withColumn("k0", F.lit(4))
    cols = docs.columns
    model = quality_model.fit(docs, table(spark, DATA, "labels"), lambda k: bucket(k, 5) != 0)
    good = {r.doc_id for r in quality_model.classify(docs, model).collect() if r.predicted}
    one = pipeline.quality_stage(spark, docs, DATA).cache()
    assert one.columns == cols and {r.doc_id for r in one.collect()} == good
    first = brute([(r.doc_id, r.text) for r in one.collect()])
    two = pipeline.near_duplicate_stage(spark, one, DATA).cache()
    assert two.columns == cols and {r.doc_id for r in two.collect()} == first
    gone = {r.doc_id for r in decontaminate.leaked(two, table(spark, DATA, "benchmark")).collect()}
    three = pipeline.decontamination_stage(spark, two, DATA).cache()
    assert three.columns == cols and {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()} - gone
    assert {(r.fp, r.found, r.score, r.leaks, r.k0) for r in three.collect()} == {(1, "x", 2, 3, 4)}
    four = pipeline.secret_stage(spark, three, DATA).cache()
    assert four.columns == cols and four.count() == three.count()
    marks = {r.doc_id: len([s for s in r.spans.split(",") if s]) for r in secrets.detect(three).collect()}
    before = {r.doc_id: r.text for r in three.collect()}
    for r in four.collect():
        assert (r.text == before[r.doc_id]) == (marks[r.doc_id] == 0) and (marks[r.doc_id] == 0 or r.n_chars == len(r.text))
        assert not secrets.ACCESS.search(r.text) or all(len(m) < 20 for m in secrets.ACCESS.findall(r.text))
    five = {r.doc_id: r for r in pipeline.encoding_stage(spark, four, DATA).collect()}
    machine = bpe.load(tokenizer_path())
    assert all(machine.digest(r.text) == (five[r.doc_id].n_tokens, five[r.doc_id].ids_sha256, five[r.doc_id].decoded_sha256) for r in four.collect())


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and out.count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rel = con.execute(SQL[name])
    at = [[d[0] for d in rel.description].index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_stages_take_odd_rows(spark):
    """Null, empty and repeated rows, and an empty table, pass every stage."""
    cols = table(spark, DATA, "documents").columns
    prose = " ".join(r.text or "" for r in table(spark, DATA, "documents").orderBy("doc_id").limit(3).collect())
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "s", 0), (3, prose, "en", "s", 5), (3, prose, "en", "s", 5), (4, " ".join(reversed(prose.split())), "en", None, 6), (5, "token=abcdef99 x", None, None, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*cols)
    for docs in (odd, odd.where("doc_id < 0")):
        for _, stage in corpus_pipeline.STAGES[1:4]:
            docs = stage(spark, docs, DATA)
            assert docs.columns == cols
        ids = sorted((r.doc_id for r in docs.collect()), key=repr)
        assert ids in ([], [1, 3, 4, 5])  # null and empty texts are one class, of smallest key 1
        last = pipeline.encoding_stage(spark, docs, DATA)
        assert last.count() == len(ids)
    assert pipeline.quality_stage(spark, odd, DATA).count() <= len(rows)
    assert pipeline.quality_stage(spark, odd.where("doc_id < 0"), DATA).count() == 0
