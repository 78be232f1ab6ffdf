"""Every query with SQL against that SQL, over the smallest table set."""

import decimal
from pathlib import Path

import pytest

from corpusloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not Path(DATA).exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 7) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want


def test_checksums_equal_a_plain_sum(spark, duck):
    def rolled(raw):
        total = 0
        for b in raw:
            total = ((total >> 1) + ((total & 1) << 15) + b) & 0xFFFF
        return total, -(-len(raw) // 1024)

    want = {i: rolled((t or "").encode()) for i, t in duck.execute("SELECT item_id, text FROM benchmark").fetchall()}
    assert {r.item_id: (r["sum"], r.blocks) for r in catalogue.QUERIES["byte_checksums"](spark, DATA).collect()} == want


def test_searches_agree(spark, duck):
    curve = sorted(catalogue.QUERIES["greedy_kcurve"](spark, DATA).collect())
    values = [r.p_escape_best for r in curve]
    assert [r.k for r in curve] == list(range(1, len(curve) + 1)) and len(curve) == 4 and all(len(set(r.genes)) == r.k for r in curve)
    assert values == sorted(values, reverse=True) and all(0 <= v <= 1 for v in values)
    checked = catalogue.QUERIES["search_validation"](spark, DATA).first()
    assert checked.same and round(checked.exhaustive, 9) == catalogue.QUERIES["exhaustive_triple"](spark, DATA).first().p_escape
    drawn = catalogue.QUERIES["monte_carlo_check"](spark, DATA).first()
    assert abs(drawn.z) < 5 and round(drawn.exact, 9) == round(checked.heuristic, 9)


def test_redundancy_sweep_adds_up(spark, duck):
    n = duck.execute("SELECT count(*) FROM documents").fetchone()[0]
    rows = sorted(catalogue.QUERIES["redundancy_sweep"](spark, DATA).collect())
    assert all(r.n_clusters + r.n_collapsed == n and 1 <= r.largest <= n for r in rows)
    assert [r.n_clusters for r in rows] == sorted(r.n_clusters for r in rows)  # a higher threshold leaves more clusters


def test_contract(spark, duck):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
