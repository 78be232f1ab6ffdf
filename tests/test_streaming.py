import random

from corpusloom.functions.grammar import Grammar
from corpusloom.operators import presence as P
from corpusloom.streaming import presence as S
from tests.test_operators import corpus


def test_stream_equals_batch(spark, tmp_path):
    records, guides, _ = corpus(spark, random.Random(21), 30)
    g = Grammar("x", 6, "NGG")
    records.select("seq_id", "seq").repartition(3).write.parquet(str(tmp_path / "in"))
    q = S.start(S.presence_counts(S.read_records(spark, str(tmp_path / "in"), 1), guides, g), "counts", str(tmp_path / "cp"))
    q.processAllAvailable()
    got = {r.guide_id: r.n_present for r in spark.table("counts").collect()}
    q.stop()
    assert got == {r.guide_id: r["count"] for r in P.presence(records, guides, g).groupBy("guide_id").count().collect()}


def test_event_windows(spark, tmp_path):
    rows = [("2024-01-01 00:05:00", "a", 1, 1.0), ("2024-01-01 00:15:00", "a", 1, 2.0), ("2024-01-01 01:30:00", "b", 1, 4.0)]
    df = spark.createDataFrame(rows, "ts string, event_type string, user_id long, value double").selectExpr("cast(ts as timestamp) ts", "event_type", "user_id", "value")
    df.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    q = S.windowed_events(stream).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("w").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]
    q.stop()
    assert sorted(r.n for r in S.sessions(df).collect()) == [1, 2]
