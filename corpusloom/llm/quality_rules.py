"""Quality rules as a short-circuit cascade.

On a sample the cost of each rule and the share it rejects are measured; the rules then run in the order of rejections
per second, each only on the documents that all earlier ones let pass.  The verdict is the conjunction of all rules, so
it does not depend on the order, nor on the sample.

Cases: a null text has no words and fails the base rule; an empty table gives an empty result; repeated rows are judged
each for itself; very long texts are read whole (memory in proportion to one text).
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass
class Doc:
    """A text and what has been counted of it so far."""

    text: str
    words: list[bytes] = field(default_factory=list)

    def __post_init__(self):
        self.words = self.text.encode().split()  # splits at \\x20 and \\x09-\\x0D only

    @property
    def word_chars(self) -> int:
        return len(self.text) - sum(self.text.count(c) for c in SPACES)

    @property
    def symbols(self) -> int:
        return sum(self.text.count(c) for c in SYMBOLS)

    def lines(self) -> tuple[int, int]:
        """Lines with a word, and those among them that equal an earlier line."""
        lines = [x for x in self.text.encode().split(b"\n") if x and not x.isspace()]
        return len(lines), len(lines) - len(set(lines))

    def repeat_words(self) -> int:
        """Words inside 5-word windows that occur twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        times = Counter(windows)
        total = end = 0
        for i, x in enumerate(windows):
            if times[x] > 1:
                total += i + 5 - max(i, end)
                end = i + 5
        return total


def shouting(d: Doc) -> bool:
    letters = sum(map(str.isalpha, d.text))
    return letters >= 40 and sum(map(str.isupper, d.text)) > 0.7 * letters


def one_word(d: Doc) -> bool:
    return len(d.words) >= 20 and Counter(d.words).most_common(1)[0][1] > 0.5 * len(d.words)


def same_lines(d: Doc) -> bool:
    n, again = d.lines()
    return n >= 6 and again > 0.6 * n


#: name -> rejects(document).  Thresholds are wide: ordinary prose, lists and code pass.
RULES: dict[str, Callable[[Doc], bool]] = {
    "symbols": lambda d: d.symbols > 0.6 * len(d.words),
    "exclaiming": lambda d: d.text.count("!") > 0.6 * len(d.words),
    "word_length": lambda d: not 1.2 * len(d.words) <= d.word_chars <= 40 * len(d.words),
    "same_lines": same_lines,
    "one_word": one_word,
    "shouting": shouting,
}


def measure(docs: Sequence[str], rules: dict[str, Callable[[Doc], bool]]) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected) over the sample."""
    made = [Doc(t or "") for t in docs]
    out = []
    for name, rule in rules.items():
        began = time.perf_counter()
        hits = sum(map(rule, made))
        out.append((name, max(1e-9, (time.perf_counter() - began) / max(1, len(made))), hits / max(1, len(made))))
    return out


def plan(measured: list[tuple[str, float, float]]) -> list[str]:
    """Rules by rejections per second, the most first; ties by name."""
    return [n for n, _, _ in sorted(measured, key=lambda x: (-x[2] / x[1], x[1], x[0]))]


def ordered(docs: DataFrame, text: str, rules: dict, sample_rows: int, longest: int) -> list[str]:
    """The order for these documents; texts beyond `longest` characters are left out of the estimate only."""
    few = docs.select(F.col(f"`{text}`").alias("t")).where(F.length("t") <= longest).sample(0.2, seed=11).take(sample_rows)
    return plan(measure([r.t for r in few], rules))


FIELDS = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]


def judge(docs: DataFrame, text: str = "text", carry: Sequence[str] = ("doc_id",), rules: dict | None = None, sample_rows: int = 400, longest: int = 1_000_000) -> DataFrame:
    """carry columns plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    chosen = RULES if rules is None else rules
    order = ordered(docs, text, chosen, sample_rows, longest)

    def factory():
        cascade = [chosen[n] for n in order]

        def f(texts):
            base, alive = [], []
            for i, t in enumerate(texts):
                d = Doc(t or "")
                n, again = len(d.words), d.repeat_words()
                failed = n < 10 or 100 * again > 20 * n
                base.append((n, d.word_chars, d.symbols, d.lines()[1], again, failed))
                if not failed:
                    alive.append((i, d))
            for rule in cascade:
                alive = [x for x in alive if not rule(x[1])]
            kept = [False] * len(texts)
            for i, _ in alive:
                kept[i] = True
            return None, [*([r[k] for r in base] for k in range(6)), kept]

        return f

    return annotate(docs, text, FIELDS, factory, carry)
