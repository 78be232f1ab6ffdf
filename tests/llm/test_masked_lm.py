"""The masked language model trains on the whole corpus."""

import numpy as np

from corpusloom.llm import masked_lm

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_ids(model, text):
    return [model.ids.get(w, masked_lm.OTHER) for w in (text or "").encode().lower().split()]


def plain_windows(ids):
    return [[x, *[ids[i + o] if 0 <= i + o < len(ids) else masked_lm.EDGE for o in masked_lm.OFFSETS]] for i, x in enumerate(ids)]


def test_every_token_is_trained_on_whatever_the_layout(spark):
    texts = ["a b c " * n for n in range(6)] + ["x y " * 700, None, "", "x y " * 700]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    model = masked_lm.WindowNetwork([b"a", b"b", b"x"])
    want = sorted(tuple(w) for t in texts for w in plain_windows(plain_ids(model, t)))
    total = sum(len(plain_ids(model, t)) for t in texts)
    for unit, shard in ((1 << 19, 1 << 20), (100, 300), (1, 50), (7, 10_000)):
        units = [masked_lm.training_units(d, model, "text", "doc_id", total, unit, shard).collect() for d in (df, df.repartition(3, "n_chars"), df.repartition(7))]
        got = [sorted(bytes(r.ids) for r in u) for u in units]
        assert got[0] == got[1] == got[2]
        assert sorted(tuple(w) for u in got[0] for w in masked_lm.windows(np.frombuffer(u, np.int16)).tolist()) == want


def test_steps_follow_the_slope():
    """One step against a plain version: the loss of each window by the definition, its slope by differences."""
    rng = np.random.default_rng(5)
    model = masked_lm.WindowNetwork([str(i).encode() for i in range(150)], hidden=3)
    part = rng.integers(0, 152, (40, 5)).astype(np.int16)
    model.weights = [(rng.standard_normal(s) * 0.3).astype(np.float64) for s in model.shapes]

    def loss(weights):
        tables, a, g, c, w, b = weights
        out = 0.0
        for x, *near in part.tolist():
            h = np.tanh(sum(tables[k][n] for k, n in enumerate(near)) + a)
            low = x // masked_lm.GROUP * masked_lm.GROUP
            for z, own in ((g @ h + c, x // masked_lm.GROUP), ((w @ h + b)[low : low + masked_lm.GROUP], x - low)):
                out -= z[own] - np.log(np.exp(z).sum())
        return out / len(part)

    before = [p.copy() for p in model.weights]
    assert abs(loss(before) + model.log_probability(part).mean()) < 1e-6
    state = [np.zeros_like(p) for p in before]
    model.step(part, state, 0.1)
    for k, p in enumerate(before):
        for _ in range(12):
            at = tuple(int(rng.integers(n)) for n in p.shape)
            if k == 0 and rng.random() < 0.7:
                r = int(rng.integers(len(part)))
                at = (at[0], int(part[r, 1 + at[0]]), at[2])
            up, down = ([q.copy() for q in before] for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            slope = (loss(up) - loss(down)) / 2e-5
            assert abs(state[k][at] - slope**2) < 1e-6
            assert abs(model.weights[k][at] - (p[at] - 0.1 * slope / (abs(slope) + 1e-6))) < 2e-2 or abs(slope) < 1e-5


def test_long_texts_in_blocks(monkeypatch):
    rng = np.random.default_rng(8)
    text = "".join(rng.choice(["a", "bc", " ", "\n", "\x0b", "\xa0é", "\t "]) for _ in range(3000))
    model = masked_lm.WindowNetwork([b"a", b"bc"])
    whole = plain_ids(model, text)
    assert model.read([text, None, "", " a", text])[0][4].tolist() == whole
    for size in (4, 50, 1000):
        monkeypatch.setattr(masked_lm, "BLOCK", size)
        assert "".join(masked_lm.blocks(text)) == text and model.read([text])[0][0].tolist() == whole
        assert np.concatenate([masked_lm.windows(s) for s in masked_lm.stretches(np.array(whole, np.int16), size)]).tolist() == plain_windows(whole)


def test_short_texts_leave_no_random_weights(spark):
    df = spark.createDataFrame([(i, "a b c d e", "en", "s", 1) for i in range(300)], DOCS)
    model = masked_lm.fit(df, vocab=10)
    fresh = masked_lm.WindowNetwork([w for w, _ in sorted(model.ids.items(), key=lambda x: x[1])])
    assert not np.allclose(model.flat(), fresh.flat(), atol=1e-3)
    good, bad = (r.pll_mean for r in masked_lm.score(spark.createDataFrame([(1, "a b c d e", None, None, 1), (2, "e d c b a", None, None, 1)], DOCS), model).orderBy("doc_id").collect())
    assert good > bad + 1


def test_every_word_has_a_probability_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "VOCAB", 12)
    rng = np.random.default_rng(2)
    many = [f"word{i}" for i in range(300)]
    texts = [" ".join(many[i] for i in np.minimum(rng.zipf(1.3, 60) - 1, 299)) + f" only{d}" for d in range(200)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    model = masked_lm.fit(df, rounds=1)
    known = set(model.open.share)
    assert len(known) > 100 and len(model.ids) == len(known) and "only3".encode() not in known
    # the known words of a class share it out, and each context's classes add up to 1
    for c in set(model.open.classes.values()):
        assert abs(sum(np.exp(model.open.share[w]) for w, k in model.open.classes.items() if k == c) - 1) < 1e-6
    assert (np.abs(np.exp(model.open.byte).sum(axis=1) - 1) < 1e-9).all()
    context = np.full((model.shapes[5][0], 5), 2, np.int16)
    context[:, 0] = np.arange(len(context))
    assert abs(np.exp(model.log_probability(context)).sum() - 1) < 1e-4
    said = [f"word0 word1 {w} word0 word1" for w in ("only3", "qzxv\u00e9qj##", "word150", "word151", "only")]
    got = {r.doc_id: r.pll for r in masked_lm.score(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(said)], DOCS), model).collect()}
    assert len(set(got.values())) == len(said) and got[1] < got[0] - 10


def test_ids_that_are_kept_give_the_same_scores_and_texts_are_looked_up_once(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "VOCAB", 12)
    monkeypatch.setattr(masked_lm, "UNIT", 400)  # the longest text is scored by stretches
    rng = np.random.default_rng(4)
    many = [f"Word{i}" for i in range(60)]
    texts = [" ".join(many[i] for i in np.minimum(rng.zipf(1.3, n) - 1, 59)) + f" only{d}" for d, n in enumerate([3, 40, 40, 900, 1, 7] * 8)] + [None, "", " \n", "same text", "same text"]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 7, 0.5) for i, t in enumerate(texts)], DOCS + ", h long, ids double")
    carry = ("doc_id", "h", "ids", "source")
    want = masked_lm.score(df, masked_lm.fit(df), carry=carry)
    passes, encoded = [], masked_lm.encoded
    monkeypatch.setattr(masked_lm, "encoded", lambda *a, **k: passes.append(a) or encoded(*a, **k))
    monkeypatch.setattr(masked_lm, "score", None)
    got = masked_lm.fit_and_score(df.repartition(3), carry=carry)
    assert len(passes) == 1 and got.columns == want.columns
    a, b = ({r.doc_id: r for r in x.collect()} for x in (want, got))
    assert a.keys() == b.keys() == set(range(len(texts)))
    for i, r in a.items():
        s = b[i]
        assert (r.h, r.ids, r.source, r.n_tokens, r.pll_mean is None) == (s.h, s.ids, s.source, s.n_tokens, s.pll_mean is None)
        assert abs(r.pll - s.pll) < 1e-3 * max(1, r.n_tokens)
    assert abs(b[len(texts) - 1].pll - b[len(texts) - 2].pll) < 1e-4 and b[len(texts) - 5].pll == 0.0


def test_saturated_and_lone_groups():
    """Values far out, one group only, an odd width and a last group with few classes: sums by the definition."""
    rng = np.random.default_rng(6)
    model = masked_lm.WindowNetwork([str(i).encode() for i in range(68)], hidden=5)
    model.weights = [(rng.standard_normal(s) * 60).astype(np.float32) for s in model.shapes]
    for low, high in ((0, 70), (64, 70), (3, 4)):
        part = rng.integers(0, 70, (50, 5)).astype(np.int16)
        part[:, 0] = rng.integers(low, high, 50)
        tables, a, g, c, w, b = (p.astype(np.float64) for p in model.weights)
        h = np.tanh(sum(tables[k][part[:, 1 + k]] for k in range(4)) + a)
        want = []
        for x, v in zip(part[:, 0].tolist(), h, strict=True):
            first = x // masked_lm.GROUP * masked_lm.GROUP
            zs = ((g @ v + c, x // masked_lm.GROUP), ((w @ v + b)[first : first + masked_lm.GROUP], x - first))
            want.append(sum(z[i] - z.max() - np.log(np.exp(z - z.max()).sum()) for z, i in zs))
        assert np.allclose(model.log_probability(part), want, rtol=1e-4, atol=1e-2)
        dh = rng.standard_normal((50, 5)).astype(np.float32)
        plain = np.zeros((4, 70, 5))
        for k in range(4):
            np.add.at(plain[k], part[:, 1 + k], dh)
        assert np.allclose(model.neighbours(part[:, 1:].T.astype(np.intp), dh), plain, atol=1e-5)


def test_fit_and_score_without_tokens(spark):
    none = spark.createDataFrame([(1, None, "en", "s", 1), (2, "", "en", "s", 1), (None, " \n", None, None, 1)], DOCS)
    assert masked_lm.fit_and_score(none.limit(0)).count() == 0
    assert sorted((r.doc_id or 0, r.n_tokens, r.pll, r.pll_mean) for r in masked_lm.fit_and_score(none).collect()) == [(k, 0, 0.0, None) for k in range(3)]
