"""Recall of decontamination where the basis rests on a sample and rare words were changed."""

import random
from collections import Counter

from corpusloom.llm import decontaminate

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_rare_words_changed_beyond_the_sample(spark):
    rng = random.Random(11)
    common = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 5))) for _ in range(400)]
    draw = lambda: common[min(int(rng.paretovariate(0.7)) - 1, 399)] if rng.random() < 0.8 else "r" + "".join(rng.choice("hijklmnop") for _ in range(6))
    prose = lambda n: [draw() for _ in range(n)]
    passages = [prose(rng.randint(20, 55)) for _ in range(40)]
    plain = [prose(rng.randint(20, 80)) for _ in range(decontaminate.FIT_DOCS + 300)]
    seen = Counter(w for t in plain for w in set(t))
    made = []
    for i, p in enumerate(passages):
        rare = sorted(range(len(p)), key=lambda k, p=p: seen[p[k]])
        for share in (0, 0.1, 0.2):
            text = list(p)
            for k in rare[: int(share * len(p))]:
                text[k] = f"other{rng.randrange(10**6)}"
            made.append((i, prose(30) + text + prose(30)))
    rows = [(k, " ".join(t), "en", "s", 1) for k, (_, t) in enumerate(made)] + [(1000 + k, " ".join(t), "en", "s", 1) for k, t in enumerate(plain)]
    bench = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaked(spark.createDataFrame(rows, DOCS), bench).collect()}
    assert {(k, i) for k, (i, _) in enumerate(made)} <= set(got)
    for r in got.values():
        assert -1.001 <= r.cosine <= 1.001
    # by plain longest common subsequences, all documents that have a leak
    each = [decontaminate.Passage(i, " ".join(p)) for i, p in enumerate(passages)]
    for k, t, *_ in rows[:320]:
        w = t.split()
        for p in each:
            n = len(p.words)
            if any(p.judged(w[i : i + n]) for i in range(max(1, len(w) - n + 1))):
                assert (k, p.item) in got
