"""Secrets: values copied into many repositories of few owners."""

import random
import re

from corpusloom.llm import secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_repositories_count(spark):
    value, narrow = "Ab3dE7gH1jK9mN2pQ5sT8vX4", "zY9xW7vU5tS3rQ1pO8nM6lK4"
    rows = [(i, f"token={value} end", "en", "hot", 1) for i in range(40)] + [(0, f"token={value} end", "en", "hot", 1)] * 5
    rows += [(100 + i, f"key {narrow}", "en", "small", 1) for i in range(10)] + [(200, f"token=quux77 {narrow}", "en", None, 1)] * 20
    rows += [(300 + i, "key Q1w2E3r4T5y6U7i8O9p0AsDf", "en", "hot", 1) for i in range(11)]
    got = {r.doc_id: r for r in secrets.detect(spark.createDataFrame(rows, DOCS)).collect()}
    assert (got[3].n_live, got[3].n_example, got[3].owners, got[3].repositories) == (0, 1, [1], [40])
    assert got[305].spans == ""  # vague, and in 11 repositories of one owner
    assert got[200].spans.startswith("assign:") and got[200].repositories == [1]  # repeated rows are one repository
    assert got[100].spans == ""  # 10 of one owner and one of another are 11
    masked = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(rows, DOCS)).collect()}
    assert masked[3] == "[EXAMPLE:assign] end" and masked[200].startswith("[SECRET:assign]")
    ten = secrets.detect(spark.createDataFrame(rows[45:55], DOCS)).collect()
    assert all(r.n_live == 1 and r.owners == [1] and r.repositories == [10] for r in ten)


def plain(rows, max_owners, max_repositories):
    """Spans, counts and verdicts by dictionaries of sets."""
    held, each = {}, []
    for doc, text, _, source, _ in rows:
        t = text or ""
        base = secrets.base_matches(t)
        more = [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t)]
        more = [m for m in more if all(e <= m[0] or m[2] <= s for s, _, e, _ in base) and re.search("[0-9]", m[3]) and re.search("[A-Za-z]", m[3]) and secrets.entropy(m[3]) >= 3.5]
        each.append(base + more)
        for *_, v in base + more:
            held.setdefault(v, set()).add((source, doc))
    out = []
    for r, spans in zip(rows, each, strict=True):
        said = []
        for s, k, e, v in sorted(spans):
            owners, repos = len({o for o, _ in held[v]}), len(held[v])
            live = owners <= max_owners and repos <= max_repositories
            if k < 3 or live:
                said.append((f"{secrets.KINDS[k]}:{s}:{e}", owners, repos, live))
        out.append((r[0], ",".join(x[0] for x in said), [x[1] for x in said], [x[2] for x in said], sum(x[3] for x in said), sum(not x[3] for x in said)))
    return sorted(out, key=repr)


def test_against_plain_sets(spark):
    rng = random.Random(4)
    vague = ["".join(rng.choice("Ab3dE7gH1jK9mN2pQ5sT8vX4") for _ in range(24)) for _ in range(12)]
    known = [f"password={'p' * i}q7" for i in range(5, 12)] + ["AKIA" + "Z9Q8" * 5, "0af3" * 8]
    rows = []
    for i in range(150):
        t = " ".join(rng.choice([*vague[: 1 + i % 12], *known, "plain", "words"]) for _ in range(rng.randint(0, 6)))
        rows.append((rng.choice([i, i, None, 7]), rng.choice([t, t, t, None, ""]), "en", rng.choice(["a", "b", "c", "", None]), 1))
    rows += rows[:10]
    df = spark.createDataFrame(rows, DOCS)
    for owners, repos in ((3, 10), (1, 1), (1, 200), (200, 2)):
        got = secrets.detect(df, max_owners=owners, max_repositories=repos).collect()
        assert sorted(((r.doc_id, r.spans, r.owners, r.repositories, r.n_live, r.n_example) for r in got), key=repr) == plain(rows, owners, repos)
    one = [(i, "key " + vague[0], "en", s, 1) for i, s in enumerate(["", None])]
    assert [r.n_live for r in secrets.detect(spark.createDataFrame(one, DOCS), max_owners=1).collect()] == [0, 0]  # null is no ""
