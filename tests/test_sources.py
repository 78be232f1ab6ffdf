import pytest

from corpusloom.sources import texts


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first\nacg\nTTN\n>s2\n\n>s3 x\nGG\n")
    got = {r.seq_id: r.seq for r in texts.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"s1": "ACGTTN", "s2": "", "s3": "GG"}
    assert texts.load_sequence(spark, str(tmp_path / "a.fa")).first().seq == "ACGTTNGG"
    blob = spark.createDataFrame([(">a 1\nAC\n>b\nG\n>a 2\nTT",)], "t string")
    assert {r.seq_id: r.seq for r in texts.split_fasta(blob, "t").collect()} == {"a": "TT", "b": "G"}


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, n int, s string")
    texts.write_tsv(df, str(tmp_path / "t"), ["k"])
    back = texts.read_tsv(spark, str(tmp_path / "t"), "k string, n int, s string")
    assert sorted(map(tuple, back.collect())) == [("a", 1, None), ("b", 2, "x")]
    assert texts.markdown(df.orderBy("k")).splitlines()[2] == "| a | 1 |  |"
    with pytest.raises(ValueError, match="over 1 rows"):
        texts.markdown(df, 1)
    assert texts.namespaced("out/x.tsv", "t1") == "out/x.t1.tsv"


def test_checksums(spark):
    assert texts.rotating_sum(b"") == 0
    assert texts.rotating_sum(b"ab") == ((ord("a") >> 1) + ((ord("a") & 1) << 15) + ord("b")) & 0xFFFF
    lines = spark.createDataFrame([("12345 7 a.fa",), ("junk",), ("x y z",)], "value string")
    assert [tuple(r) for r in texts.parse_checksums(lines).collect()] == [("a.fa", 12345, 7)]


def test_segments(spark):
    rows = [("CDS", ["ul1", "RL2"], [(9, 20, "+"), (1, 5, "+")]), ("CDS", ["zz"], [(0, 3, "-")]), ("gene", ["RL2"], [(0, 1, "+")])]
    df = spark.createDataFrame(rows, "type string, names array<string>, parts array<struct<start0:int,end:int,strand:string>>")
    got, missing = texts.segments(df, ["RL2", "UL9"])
    assert [tuple(r) for r in got.collect()] == [("RL2", 1, 5, "+"), ("RL2", 9, 20, "+")]
    assert [r.gene for r in missing.collect()] == ["UL9"]


def test_chunks(spark):
    df = spark.createDataFrame([("c", "ACGTN" * 3)], "name string, seq string")
    got = sorted(tuple(r) for r in texts.chunked(df, "name", "seq", 6).collect())
    assert got == [("c", 0, 0, "0123N0"), ("c", 1, 6, "123N01"), ("c", 2, 12, "23N")]
    idx = spark.createDataFrame([("a", 5), ("b", 7)], "name string, n int")
    assert [r.start for r in texts.running_offsets(idx, "name", "n").orderBy("name").collect()] == [0, 5]
