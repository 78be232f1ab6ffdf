"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages and passages of a bounded sample of documents form a TF-IDF matrix over the benchmark's terms, with
document frequencies counted over all documents.  A randomised SVD, whose products are summed over the partitions, gives
a latent basis.  Every window of every document is then compared with every benchmark passage of about its length by
cosine in that space.  That alone would lose copies whose rare words were changed, and rests on the sample; so every
window that has enough of a passage's words, rare or not, to hold a leak of it is a candidate too, and none is lost before
the words are read.  The candidates are settled on their words: a longest common subsequence of most of the passage
is a leak; a shorter one (a paraphrase) is a leak if the passage's answer, its last clause, also stands in the window.

The benchmark is the query set: it is held on the driver and executors, in blocks of `BLOCK` passages with a basis of
their own, and each block meets all documents.  A basis is fitted on the block and on about `FIT_DOCS` documents;
everything else sees all rows.

Cases: null and empty texts have no leak; benchmark rows that are null or without a word are ignored, repeated ones are
reported with each id; repeated documents are judged each for itself; passages of under `SHORT` words must occur whole;
an empty benchmark leaks nowhere; documents of any length are read whole, window after window.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, shielded, slices, tidy, written

WORD = re.compile(r"\w+")
BLOCK = 256
FIT_DOCS = 2000
DIMS = 192
SHORT = 8
RARE = 4
PART = 1 << 16
COSINE, SHARE = 0.5, 0.5
LEAK, PARAPHRASE = 0.7, 0.5
GROWTH = 1.6


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def answer(text: str) -> list[str]:
    """The words of the last clause with at least three words, or of the last one."""
    clauses = [w for c in re.split(r"[.?!:;\n]", text) if (w := words(c))]
    return next((c for c in reversed(clauses) if len(c) >= 3), clauses[-1] if clauses else [])


def lcs(masks: dict[str, int], n: int, seen: Sequence[str]) -> int:
    """Length of the longest common subsequence; masks: the positions of each word among n."""
    full = (1 << n) - 1
    v = full
    for w in seen:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def holds(seen: Sequence[str], part: Sequence[str]) -> bool:
    return f" {' '.join(part)} " in f" {' '.join(seen)} "


class Passage:
    def __init__(self, item: int, text: str):
        self.item, self.words, self.answer = item, words(text), answer(text)
        self.masks: dict[str, int] = {}
        for i, w in enumerate(self.words):
            self.masks[w] = self.masks.get(w, 0) | 1 << i

    def judged(self, seen: Sequence[str]) -> float:
        """The share of the passage that `seen` has in order, or 0 where that is no leak."""
        n = len(self.words)
        if n < SHORT:
            return 1.0 if holds(seen, self.words) else 0.0
        share = lcs(self.masks, n, seen) / n
        if share >= LEAK or share >= PARAPHRASE and self.answer and holds(seen, self.answer):
            return share
        return 0.0


class LatentIndex:
    """Term vectors and passage vectors of one block of the benchmark."""

    def __init__(self, passages: list[Passage], vocab: dict[str, int], vectors: np.ndarray, weights: np.ndarray):
        self.passages, self.vocab = passages, vocab
        self.vectors = vectors.astype(np.float32)  # row 0: a word of no passage
        latent = np.array([self.vectors[[vocab[w] for w in p.words]].sum(axis=0) for p in passages], np.float32).reshape(len(passages), vectors.shape[1])
        self.norms = np.linalg.norm(latent, axis=1) + 1e-12
        parts = (self.vectors @ latent.T) / self.norms**2  # what one word adds to the share of each passage
        by: dict[int, list[int]] = {}
        for k, p in enumerate(passages):
            width = 8
            while width < len(p.words):
                width = int(width * GROWTH)
            by.setdefault(width, []).append(k)
        self.units = []  # (stride, width, passages, their bounds, their rare words, how many of those a leak has)
        self.classes = []  # (stride, width, passages, their parts, the most that a word adds to any of them)
        for width, own in sorted(by.items()):
            stride = max(2, width // 4)
            self.units.append((stride, width + stride, np.array(own), self.bounds(own), *self.rare(own, weights)))
            self.classes.append((stride, width + stride, np.array(own), np.ascontiguousarray(parts[:, own]), np.maximum(parts[:, own].max(axis=1), 0)))

    def rare(self, own: list[int], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A leak takes `needed` of a passage's words, so at least RARE of any len - needed + RARE of them: of the rarest.
        Here as the passages of each term, (first, passage), and how many a leak takes."""
        pairs, least = [], []
        for j, k in enumerate(own):
            p = self.passages[k]
            n = len(p.words)
            needed = n if n < SHORT else int(np.ceil(n * PARAPHRASE))
            least.append(min(RARE, needed))
            order = sorted(p.words, key=lambda w: (-weights[self.vocab[w]], w))
            pairs += [(self.vocab[w], j) for w in set(order[: n - needed + least[-1]])]
        term, j = (np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True))
        return np.searchsorted(term, np.arange(len(self.vectors) + 1)), j, np.array(least)

    def bounds(self, own: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For some passages: the place of each term among a passage's distinct words (from 1; 0: not its word), how often
        the passage and its answer have the word at each place, and each passage's length."""
        most = max(len(self.passages[k].masks) for k in own) + 1
        place = np.zeros((len(self.vectors), len(own)), np.int16)
        held, told = np.zeros((len(own), most), np.int16), np.zeros((len(own), most), np.int16)
        for j, k in enumerate(own):
            p = self.passages[k]
            at = {w: i + 1 for i, w in enumerate(p.masks)}
            for w, i in at.items():
                place[self.vocab[w], j] = i
                held[j, i] = p.masks[w].bit_count()
            for w, n in Counter(p.answer).items():
                told[j, at[w]] = n
        return place, held, told, np.array([len(self.passages[k].words) for k in own])

    def possible(self, ids: np.ndarray, starts: np.ndarray, width: int, own: np.ndarray, bounds) -> np.ndarray:
        """Whether what `judged` reads of each window can be a leak: a subsequence takes no word more often than window and
        passage both have it, and a paraphrase has all words of the answer."""
        place, held, told, sizes = bounds
        out = np.zeros(len(starts), bool)
        reach = width // 4
        for i in range(0, len(starts), 1024):
            s, k = starts[i : i + 1024], own[i : i + 1024]
            at = s[:, None] - reach + np.arange(width + 2 * reach)
            term = np.where((at >= 0) & (at < len(ids)), ids[np.clip(at, 0, len(ids) - 1)], 0)
            cell = place[term, k[:, None]] + np.arange(len(s))[:, None] * held.shape[1]
            seen = np.bincount(cell.ravel(), minlength=len(s) * held.shape[1]).reshape(len(s), -1)
            both = np.minimum(seen, held[k]).sum(axis=1) / sizes[k]
            least = np.where(sizes[k] < SHORT, 1.0, np.where((seen[:, 1:] >= told[k, 1:]).all(axis=1), PARAPHRASE, LEAK))
            out[i : i + 1024] = both >= least - 1e-9
        return out

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(start, end, passage, cosine) of windows over term ids whose projection on the passage is SHARE of it or more."""
        n = len(ids)
        for stride, width, own, parts, most in self.classes:
            bound = np.concatenate(([0.0], np.cumsum(most[ids], dtype=np.float64)))
            starts = np.arange(0, max(1, n - width + stride), stride)
            ends = np.minimum(starts + width, n)
            full = bound[ends] - bound[starts] >= SHARE - 1e-6  # no passage has more of this window
            starts, ends = starts[full], ends[full]
            for i in range(0, len(starts), 256):
                s, e = starts[i : i + 256], ends[i : i + 256]
                at = s[:, None] + np.arange(width)
                term = np.where(at < e[:, None], ids[np.minimum(at, n - 1)], 0)
                share = parts[term].sum(axis=1)
                some = (share >= SHARE).any(axis=1)
                s, e, share = s[some], e[some], share[some]
                size = np.linalg.norm(self.vectors[term[some]].sum(axis=1), axis=1)
                cosine = share * self.norms[own] / (size[:, None] + 1e-12)
                for r, c in zip(*np.nonzero((share >= SHARE) & (cosine >= COSINE)), strict=True):
                    yield int(s[r]), int(e[r]), int(own[c]), float(cosine[r, c])

    def overlaps(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start, end, passage) of windows that have the words for a leak of the passage."""
        n = len(ids)
        for stride, width, own, bounds, first, passages, least in self.units:
            reach = width // 4
            for low in range(0, n, PART):  # a part at a time, with what a window that starts in it reads beyond it
                part = ids[max(0, low - reach) : low + PART + width + reach]
                begin = max(0, low - reach)
                count = first[part + 1] - first[part]
                at = np.repeat(np.arange(len(part)), count)
                k = passages[np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[part], count)]
                order = np.argsort(k, kind="stable")
                k, at = k[order], at[order] + begin
                last = np.arange(len(k)) + least[k] - 1
                some = np.flatnonzero(last < len(k))
                some = some[(k[last[some]] == k[some]) & (at[last[some]] - at[some] < width + 2 * reach)]
                k, since, until = k[some], at[some], at[last[some]]
                lowest = np.maximum(low, until - width - reach + 1)  # windows whose reading has these words start from here to
                highest = np.minimum(min(low + PART, n) - 1, since + reach)
                lowest, highest = -(-lowest // stride), highest // stride
                found = []
                for step in range(int((highest - lowest).max(initial=-1)) + 1):
                    ok = lowest + step <= highest
                    found.append(np.unique(k[ok] * (n + 1) + lowest[ok] + step))
                every = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
                c, start = every // (n + 1), every % (n + 1) * stride
                good = self.possible(ids, start, width, c, bounds)
                for s, j in zip(start[good].tolist(), own[c[good]].tolist(), strict=True):
                    yield s, min(s + width, n), j

    def cosine(self, ids: np.ndarray, k: int) -> float:
        """The cosine of a window and a passage."""
        passage = self.vectors[[self.vocab[w] for w in self.passages[k].words]].sum(axis=0)
        window = self.vectors[ids].sum(axis=0)
        return float(window @ passage / (self.norms[k] * (np.linalg.norm(window) + 1e-12)))

    def leaks(self, each: Sequence[Sequence[str]]) -> list[list[dict]]:
        """For each text, given as words, the passages that it leaks."""
        found: list[dict[int, tuple[float, float]]] = [{} for _ in each]
        lengths = np.array([len(w) for w in each], np.int64)
        total = int(lengths.sum())
        if total and self.passages:
            offsets = np.concatenate(([0], np.cumsum(lengths)))
            ids = np.fromiter(map(self.vocab.get, chain.from_iterable(each), repeat(0)), np.int32, total)
            for start, end, k, cosine in chain(self.candidates(ids), ((*x, None) for x in self.overlaps(ids))):
                reach = (end - start) // 4
                first = int(np.searchsorted(offsets, start, "right")) - 1
                while first < len(each) and offsets[first] < end:  # a window may touch several short texts
                    if k not in found[first] or found[first][k][1] < 1:
                        lo, hi = max(0, start - reach - int(offsets[first])), end + reach - int(offsets[first])
                        share = self.passages[k].judged(each[first][lo:hi])
                        if share and share > found[first].get(k, (0, 0))[1]:
                            found[first][k] = (self.cosine(ids[start:end], k) if cosine is None else cosine, share)
                    first += 1
        return [[{"item_id": self.passages[k].item, "cosine": c, "lcs_share": s} for k, (c, s) in sorted(f.items())] for f in found]


def summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of matrices, one in each row (slot, matrix), added up on the executors first."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for slot, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                m = np.frombuffer(raw, np.float64)
                total[slot] = total[slot] + m if slot in total else m
        for slot, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["slot", "matrix"])

    rows = parts.repartition(2, "slot").mapInArrow(add, "slot int, matrix binary").collect()  # two rows
    return sum((np.frombuffer(r.matrix, np.float64) for r in sorted(rows, key=lambda r: r.slot)), np.zeros(shape[0] * shape[1])).reshape(shape)


def products(passages: DataFrame, weights: np.ndarray, basis: np.ndarray, gram: bool) -> np.ndarray:
    """Sum over all passages (rows of term ids) of A'(AX), or with gram of (AX)'(AX)."""
    k = basis.shape[1]
    scaled = weights[:, None] * basis

    def run(batches):
        out = np.zeros((k, k) if gram else basis.shape)
        for b in batches:
            for ids in b.column(0).to_pylist():
                term, times = np.unique(np.array(ids, np.int64), return_counts=True)
                y = times @ scaled[term]
                if gram:
                    out += np.outer(y, y)
                else:
                    out[term] += (weights[term] * times)[:, None] * y
        from pyspark import TaskContext

        tidy()
        slot = TaskContext.get().partitionId() % 2
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["slot", "matrix"])

    return summed(passages.mapInArrow(run, "slot int, matrix binary"), (k, k) if gram else basis.shape)


def randomised_svd(passages: DataFrame, weights: np.ndarray, dims: int, rounds: int = 1, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The leading right singular vectors (terms x dims) and values of the passages' TF-IDF matrix."""
    n = len(weights)
    q = np.random.default_rng(seed).standard_normal((n, min(n, dims + 10)))
    for _ in range(1 + rounds):
        q, _ = np.linalg.qr(products(passages, weights, q, gram=False))
    values, turn = np.linalg.eigh(products(passages, weights, q, gram=True))
    first = np.argsort(-values)[:dims]
    return (q @ turn)[:, first], np.sqrt(np.maximum(values[first], 1e-9 * values.max()))


def fit(docs: DataFrame, blocks: list[list[Passage]], text: str = "text", key: str = "doc_id", dims: int = DIMS, fit_docs: int = FIT_DOCS, window: int = 48) -> list[LatentIndex]:
    """An index for each block.  One scan counts document frequencies over all documents and cuts the sample to passages.

    A term weighs its squared inverse document frequency (once for the passage, once for the document), and the latent
    axes are scaled by their singular values, so that what all prose of a language shares does not count as likeness.
    """
    vocab = {w: i + 1 for i, w in enumerate(sorted({w for block in blocks for p in block for w in p.words}))}
    spark = docs.sparkSession
    total = docs.count()
    share = 1.0 if total <= fit_docs else fit_docs / total
    picked = F.pmod(F.xxhash64(key, F.lit(29)), F.lit(1 << 31)) < int(share * (1 << 31))

    def run(batches):
        counts: Counter = Counter()
        known = vocab.keys()
        for whole in batches:
            for b in slices(whole, 0):
                for t, take in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    w = words(t)
                    counts.update(known & set(w))
                    if take:
                        ids = [vocab.get(x, 0) for x in w]
                        parts = [ids[i : i + window] for i in range(0, len(ids), window)]
                        yield pa.RecordBatch.from_arrays([pa.nulls(len(parts), pa.string()), pa.nulls(len(parts), pa.int64()), pa.array(parts, pa.list_(pa.int32()))], names=["word", "n", "ids"])
        tidy()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64()), pa.nulls(len(counts), pa.list_(pa.int32()))], names=["word", "n", "ids"])

    scanned = written(docs.select(F.col(text).alias("t"), F.coalesce(picked, F.lit(False)).alias("s")).mapInArrow(run, "word string, n long, ids array<int>"), "latent-scan")
    # as many rows as the benchmark has terms
    df = {r.word: r.n for r in scanned.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    out = []
    for block in blocks:
        terms = sorted({w for p in block for w in p.words})
        local = {w: i + 1 for i, w in enumerate(terms)}
        weights = np.zeros(len(terms) + 1)
        for w, i in local.items():
            weights[i] = (np.log((1 + total) / (1 + df.get(w, 0))) + 0.05) ** 2
        place = np.zeros(len(vocab) + 1, np.int32)
        for w, i in local.items():
            place[vocab[w]] = i

        def localised(batches, place=place):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([place[x].tolist() for x in b.column(0).to_pylist()], pa.list_(pa.int32()))], names=["ids"])

        own = spark.createDataFrame([([local[w] for w in p.words],) for p in block], "ids array<int>")
        matrix = written(scanned.where("ids is not null").select("ids").repartition(8).mapInArrow(localised, "ids array<int>").unionByName(own), "latent-passages")
        basis, values = randomised_svd(matrix, weights, dims)
        out.append(LatentIndex(block, local, weights[:, None] * basis / values, weights))
    return out


LEAKS = T.StructField("leaks", T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("lcs_share", T.DoubleType())])))


def benchmark_passages(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[list[Passage]]:
    """The query set, block after block."""
    block: list[Passage] = []
    for r in benchmark.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null").orderBy("k", "t").toLocalIterator():
        p = Passage(r.k, r.t)
        if p.words:
            block.append(p)
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


def search(docs: DataFrame, indexes: list[LatentIndex], text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """carry columns plus leaks, an array of (item_id, cosine, lcs_share), for each row of docs."""
    return annotate(docs, text, [LEAKS], lambda: lambda ts: (None, [all_leaks(indexes, ts)]), carry)


def all_leaks(indexes: list[LatentIndex], texts: Sequence[str | None]) -> list[list[dict]]:
    each = [words(t) for t in texts]
    found = [index.leaks(each) for index in indexes]
    return [sorted((x for per in at for x in per), key=lambda x: x["item_id"]) for at in zip(*found, strict=True)] if found else [[] for _ in texts]


def leaked(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, item_id, cosine, lcs_share) for each leak of a passage into a document."""
    indexes = fit(docs, list(benchmark_passages(benchmark)), text, key)
    return search(docs, indexes, text, [key]).select(key, F.explode("leaks").alias("l")).select(key, "l.*")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the rows that leak a passage."""
    flat, cols, (body, ident) = shielded(docs, text, key)
    indexes = fit(flat, list(benchmark_passages(benchmark)), body, ident)
    return annotate(flat, body, [], lambda: lambda ts: ([not x for x in all_leaks(indexes, ts)], []), cols).toDF(*docs.columns)
