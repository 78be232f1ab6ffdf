"""Language identification by rank-order profiles.

A profile is a language's most frequent character n-grams (1 to 3 letters, words padded by a boundary) in order of
frequency.  A document's own most frequent n-grams are compared to each profile by the out-of-place distance; the
smallest distance wins.

Cases: a null text, or one with no letter, is `und` with score 0; equal frequencies are ordered by the n-gram, equal
distances by the language name; a text with fewer n-grams than the profile is compared over those it has; rows with a
null language are never learned from; with nothing learned every text is `und`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate

BITS = 21  # of a code point; three fit a signed 64-bit integer
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)
    return _letters


def grams(text: str) -> np.ndarray:
    """All 1- to 3-grams of the lower-cased text as integers; anything but letters is one boundary.

    A boundary is 0, so an n-gram that begins with one has the number of its rest and is counted with it."""
    code = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    code = np.where(letters()[code], code, 0) if code.size else code
    code = np.concatenate(([0], code, [0]))
    code = code[np.concatenate(([True], (code[1:] != 0) | (code[:-1] != 0)))]
    if code.size < 3:
        return np.empty(0, np.int64)
    one = code[code != 0]
    two = (code[:-1] << BITS) | code[1:]
    three = ((code[:-2] << (2 * BITS)) | (code[1:-1] << BITS) | code[2:])[code[1:-1] != 0]
    return np.concatenate((one, two, three))


def top(keys: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent keys in order; ties by key.  keys come sorted."""
    if keys.size > 4 * n:
        least = np.partition(counts, counts.size - n)[counts.size - n]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.argsort(-counts, kind="stable")[:n]]


class Profiles:
    """Profiles of all languages as one table: sorted n-grams, and each one's rank in each language."""

    def __init__(self, ranked: dict[str, np.ndarray], size: int):
        self.names, self.size = sorted(ranked), size
        self.keys = np.unique(np.concatenate([ranked[n] for n in self.names])) if self.names else np.empty(0, np.int64)
        self.ranks = np.full((self.keys.size + 1, len(self.names)), size, np.int32)  # the last row: not in any profile
        for k, n in enumerate(self.names):
            self.ranks[np.searchsorted(self.keys, ranked[n]), k] = np.arange(ranked[n].size)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = grams(text) if text and self.names else np.empty(0, np.int64)
        if not found.size:
            return "und", 0.0
        mine = top(*np.unique(found, return_counts=True), self.size)
        at = np.searchsorted(self.keys, mine)
        at[at == self.keys.size] = 0
        at = np.where(self.keys[at] == mine, at, self.keys.size)
        ranks = self.ranks[at]
        away = np.where(ranks == self.size, self.size, np.abs(ranks - np.arange(mine.size, dtype=np.int32)[:, None])).sum(axis=0)
        best = int(np.argmin(away))
        return self.names[best], 1.0 - float(away[best]) / (self.size * mine.size)


def learn(docs: DataFrame, text: str, lang: str, key: str, size: int = 400, most_docs: int = 3000) -> Profiles:
    """Profiles from rows of docs with a language, at most about most_docs of each language, chosen by a hash of key.

    The n-grams are counted where the rows are; the driver gets `size` n-grams of each language.
    """
    known = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.col(key).alias("k"))
    counts = {r.l: r["count"] for r in known.groupBy("l").count().collect()}
    if not counts:
        return Profiles({}, size)
    cutoffs = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(1 << 31, int(most_docs / n * (1 << 31)) if n > most_docs else 1 << 31))])
    picked = F.pmod(F.xxhash64("k", F.lit(17)), F.lit(1 << 31)) < cutoffs[F.col("l")]
    schema = "l string, g long, n long"

    def run(batches):
        import pyarrow as pa

        got: dict[str, list] = {}
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t:
                    k, c = np.unique(grams(t), return_counts=True)
                    got.setdefault(name, []).append((k, c))
                    if len(got[name]) >= 64:
                        got[name] = [merged(got[name])]
        for name, parts in got.items():
            k, c = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * k.size, pa.string()), pa.array(k), pa.array(c.astype(np.int64))], names=["l", "g", "n"])

    summed = known.where(picked).select("l", "t").mapInArrow(run, schema).groupBy("l", "g").agg(F.sum("n").alias("n"))
    best = summed.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "g"))).where(F.col("r") <= size)
    ranked: dict[str, list[int]] = {}
    for r in best.orderBy("l", "r").collect():  # size rows of each language
        ranked.setdefault(r.l, []).append(r.g)
    return Profiles({k: np.array(v, np.int64) for k, v in ranked.items()}, size)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """carry columns plus lang_pred and score (1: the profile's own order; 0: nothing in common)."""

    def factory():
        def f(texts):
            out = [profiles.predict(t) for t in texts]
            return None, [[x[0] for x in out], [x[1] for x in out]]

        return f

    return annotate(docs, text, FIELDS, factory, carry)
