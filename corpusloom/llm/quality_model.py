"""Quality classifier by compression.

Two zstandard dictionaries are built, from text labelled good and from text labelled bad.  A document is compressed
with each; the difference of the two sizes, normalised by the document's length and by the sizes, is the evidence.  A
logistic calibration fitted on other labelled rows turns it into a score; it also knows how far the text compresses at all,
since the same difference says less of a text that hardly does (on held-out rows of 10,000 documents 5 of 122 bad ones are
accepted with it, 29 without).

The model is fitted on all labelled rows: by a hash of the key half of them give, with their whole texts, the dictionaries
and half the calibration; of a class that has rows in one of the halves only, all rows serve both.  Texts are dealt into units of
about `UNIT` bytes, each of which is trained to its share of the class's dictionary.  The calibration's sums run over the cluster.  A unit too small to train a dictionary on is one itself, as plain text.

Cases: a null text is scored as an empty one, and an empty text by the sizes of two empty frames; repeated rows are
scored alike and, of labels that disagree, a key has the lesser; labels for unknown documents, null labels and null keys are ignored;
without rows of both classes, or text in them, every score is the share of good labels (0.5 without labels); an empty table gives an empty
result; a carried column of a result's name is left out; very long texts are compressed whole, in one stream.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.presence import sized_broadcast
from .common import annotate, cut, shielded, slices, tidy, written


MOST_SENT = 500_000  # rows of two numbers that are broadcast; more are joined by shuffle
UNIT, LEAST, PIECE = 4 << 20, 256, 1000  # bytes: of a unit, of its share of a dictionary, of a sample


def all_pieces(text: bytes, size: int = PIECE) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def features(good: int, bad: int, n: int) -> tuple[float, float, float]:
    """The normalised difference, damped for short texts; the same relative to the compressed sizes; how far the text compresses at all."""
    return (bad - good) / (n + 64), (bad - good) / (good + bad), (good + bad) / (2 * n + 64)


class CompressionModel:
    def __init__(self, good: bytes, bad: bytes, weights: Sequence[float], prior: float, level: int = 3):
        self.good, self.bad, self.weights, self.prior, self.level = good, bad, list(weights), prior, level

    def compressors(self):
        out = []
        for raw in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)
            d.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def scorer(self):
        if not self.good or not self.bad:
            return lambda text: self.prior
        good, bad = self.compressors()
        w = self.weights

        def score(text: str | None) -> float:
            raw = (text or "").encode()
            z = w[0] + sum(a * b for a, b in zip(w[1:], features(len(good.compress(raw)), len(bad.compress(raw)), len(raw)), strict=True))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def logistic(seen: DataFrame, ridge: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, float] | None:
    """Weights with the intercept first, by Newton's method on scaled columns of seen(y, x), and the share of y; None without both classes."""

    def summed(f) -> np.ndarray:
        def run(batches):
            total = 0.0
            for b in batches:
                if b.num_rows:
                    x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    total = total + f(b.column(0).to_numpy(zero_copy_only=False).astype(float), x)
            if np.ndim(total):
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

        return np.sum([r.v for r in seen.select("y", "x").mapInArrow(run, "v array<double>").collect()], axis=0)  # a row of each task

    sums = summed(lambda y, x: np.concatenate(([len(y), y.sum()], x.sum(axis=0))))
    if not np.ndim(sums) or not 0 < sums[1] < sums[0]:
        return None
    n, mean = sums[0], sums[2:] / sums[0]
    scale = np.sqrt(summed(lambda y, x: ((x - mean) ** 2).sum(axis=0)) / n) + 1e-12
    w = np.zeros(1 + len(scale))
    for _ in range(rounds):

        def slopes(y, x, w=w):
            a = np.column_stack([np.ones(len(x)), x / scale])
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            return np.concatenate((a.T @ (p - y), ((a * (p * (1 - p))[:, None]).T @ a).ravel()))

        got = summed(slopes)
        h = got[len(w) :].reshape(len(w), -1) + ridge * np.eye(len(w)) * n**0.5
        step = np.linalg.solve(h, got[: len(w)] + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return np.round(np.concatenate([w[:1], w[1:] / scale]), 9), sums[1] / n  # rounded: sums come in any order


def dictionaries(rows: DataFrame, bytes_of: dict[int, int], size: int) -> dict[int, bytes]:
    """A dictionary of the whole texts of each class, from rows(k, y, t): each unit of texts is trained to its share of it.

    That is what the training does with one text, of which each stretch gives its best segments.
    """
    units = {y: max(1, min(size // LEAST, -(-n // UNIT))) for y, n in bytes_of.items()}
    h = F.xxhash64("k", "t")
    unit = F.pmod(h, F.create_map(*[F.lit(v) for x in units.items() for v in x])[F.col("y")]).cast("long")

    def trained(batches):
        def told(y, unit, part, held):
            return pa.RecordBatch.from_arrays([pa.array([y], pa.int32()), pa.array([unit], pa.int64()), pa.array([part], pa.int32()), pa.array([build(held, size // units[y])], pa.binary())], names=["y", "unit", "part", "d"])

        now, part, held, n = (None, None), 0, [], 0
        for whole in batches:
            for b in slices(whole, 2):
                for y, unit, raw in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                    if held and ((y, unit) != now or n >= 2 * UNIT):  # texts beyond what units were dealt for: one more part
                        yield told(*now, part, held)
                        part, held, n = part + 1 if (y, unit) == now else 0, [], 0
                    now = y, unit
                    held += all_pieces(raw or b"")
                    n += len(raw or b"")
        if held:
            yield told(*now, part, held)
        tidy()

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    dealt = rows.select("y", unit.alias("unit"), F.col("t").cast("binary").alias("t"), h.alias("h")).repartition(max(2, sum(units.values())), "y", "unit").sortWithinPartitions("y", "unit", "h")
    out = dict.fromkeys(bytes_of, b"")
    for r in sorted(dealt.select("y", "unit", "t").mapInArrow(trained, "y int, unit long, part int, d binary").collect(), key=lambda r: (r.y, r.unit, r.part)):  # about `size` bytes of each class
        out[r.y] += bytes(r.d)
    return out


def fit(docs: DataFrame, labels: DataFrame, allowed, key: str = "doc_id", text: str = "text", label: str = "quality", dictionary: int = 262_144) -> CompressionModel:
    """Learn from all labelled rows whose key satisfies allowed(column)."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & allowed(F.col("k"))).groupBy("k").agg(F.min("y").alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    if len(counts) < 2:
        return CompressionModel(b"", b"", [0.0], prior)
    side = F.pmod(F.xxhash64("k", F.lit(23)), F.lit(2))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(sized_broadcast(cut(known), MOST_SENT), "k").select("k", "y", "t", side.alias("side"))
    halves = {(r.y, r.side): r.n for r in rows.groupBy("y", "side").agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).collect()}
    alone = [y for y in (0, 1) if (y, 0) not in halves or (y, 1) not in halves]
    both = F.col("y").isin(*alone) if alone else F.lit(False)
    bytes_of = {y: sum(n for (c, s), n in halves.items() if c == y and (s == 0 or y in alone)) for y in (0, 1)}
    by = dictionaries(rows.where((F.col("side") == 0) | both), bytes_of, dictionary)
    made = [by.get(y, b"") for y in (1, 0)]
    if not all(made):
        return CompressionModel(b"", b"", [0.0], prior)
    model = CompressionModel(*made, [0.0], prior)

    def factory():
        good, bad = model.compressors()

        def f(ts):
            raw = [(t or "").encode() for t in ts]
            return None, [[list(features(len(good.compress(b)), len(bad.compress(b)), len(b))) for b in raw]]

        return f

    seen = written(annotate(rows.where((F.col("side") == 1) | both), "t", [T.StructField("x", T.ArrayType(T.DoubleType()))], factory, ["y"]), "quality-seen")
    found = logistic(seen)
    if found is None:
        return CompressionModel(b"", b"", [0.0], prior)
    w, mean = found
    # the halves hold the classes unequally: put the labels' own odds back
    w[0] += np.log(prior / (1 - prior)) - np.log(mean / (1 - mean))
    model.weights = list(w)
    return model


def build(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary, or, of too few samples, their plain text as one."""
    total = sum(map(len, samples))
    if not total:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 4)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[:size].ljust(8)  # the least that is taken as a dictionary


FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def classify(docs: DataFrame, model: CompressionModel, text: str = "text", carry: Sequence[str] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """carry columns plus score and predicted."""

    def factory():
        score = model.scorer()

        def f(texts):
            got = [score(t) for t in texts]
            return None, [got, [int(s >= threshold) for s in got]]

        return f

    return annotate(docs, text, FIELDS, factory, carry)


def accepted(docs: DataFrame, model: CompressionModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score threshold or more, with all their columns."""
    flat, cols, (body,) = shielded(docs, text)

    def factory():
        score = model.scorer()
        return lambda texts: ([score(t) >= threshold for t in texts], [])

    return annotate(flat, body, [], factory, cols).toDF(*docs.columns)
