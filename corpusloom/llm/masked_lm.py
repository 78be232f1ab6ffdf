"""Masked pseudo-likelihood: a window network predicts each token from both sides.

The vocabulary is counted over all documents.  Every token of every document is trained on: documents are dealt by a hash
of key and text into shards of about `SHARD` tokens, which are packed into units; each unit runs mini-batches from the
common weights, the results are averaged by their number of tokens; with more `rounds` than one, again from there.  Neither files nor
partitions have a part in that, so the weights do not depend on the layout (but for the rounding of sums).  A document's
score is the sum of log p(token | two tokens before, two after).

The network's output is factored: the probability of a group of classes, times that of the class in its group.  The
vocabulary is open: words of at least a millionth of all tokens (and twice) are known.  The commonest are classes of
the network, the other known ones are hashed into `HASHED` classes, and the rest are one class.  A word has the
probability of its class in its context times its share of the class; a word of the last class has that of its spelling,
by a bigram model of bytes over the words counted there.  A caller's own `vocab` closes the vocabulary: that many
words, and all others one token.

Cases: null and empty texts have no token, the score 0 and a null mean; no word is without a probability of its own; ends
are padded by a boundary token; repeated rows are scored alike, and each is trained on; ties in a word's count are
ordered by the word; an empty corpus gives an empty result; a carried column of a result's name is left out, as the result
has that name; a long text is read in blocks, of which only two bytes a token stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from copy import copy
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, slices, tidy, written

OFFSETS = (-2, -1, 1, 2)
VOCAB, HASHED, HIDDEN, GROUP = 960, 64, 32, 64
FREQUENT = 1e-6  # of all tokens, for a known word
EDGE, OTHER = 0, 1  # token ids of a boundary and of a word outside the vocabulary
CHUNK = 8192
NEVER = -1e30  # the logit of what is no class
SHARD, UNIT = 1 << 20, 1 << 19  # tokens
BLOCK = 1 << 20  # bytes
SPACE = re.compile(r"[ \t-\r]")


def blocks(text: str | None) -> Iterator[str]:
    """A text in blocks of about BLOCK characters that cut no token."""
    text, at = text or "", 0
    while len(text) - at > BLOCK and (cut := SPACE.search(text, at + BLOCK)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def split(texts: Sequence[str | None] | pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts, and how many each has: what stands between ASCII white space, A-Z in lower case."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")))
    words = parts.flatten()
    full = pc.binary_length(words).to_numpy() > 0
    ends = np.concatenate(([0], np.cumsum(full)))[parts.offsets.to_numpy()]
    return words.filter(pa.array(full)).cast(pa.binary()), np.diff(ends)


def count_words(docs: DataFrame, text: str = "text", most: int = 8 << 20) -> DataFrame:
    """(word, n) over all documents; each task sends a word once for each `most` bytes, and they are summed before their shuffle."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, 0, most):
                col = b.column(0)
                for part in [col] if len(col) > 1 else ([x] for t in col.to_pylist() for x in blocks(t)):
                    found = split(part)[0].value_counts()
                    yield pa.RecordBatch.from_arrays([found.field(0), found.field(1)], names=["word", "n"])
        tidy()

    return docs.select(F.col(text).alias("t")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class OpenVocabulary:
    """The share of its class that each word has: known ones by count, all others by their spelling."""

    def __init__(self, own: list[bytes], others: list[tuple[bytes, int]], spelled: np.ndarray):
        first = len(own) + 2
        self.classes = {w: first + xxhash.xxh64_intdigest(w) % HASHED for w, _ in others}
        total = np.zeros(first + HASHED)
        for w, n in others:
            total[self.classes[w]] += n
        self.share = dict.fromkeys(own, 0.0) | {w: float(np.log(n / total[self.classes[w]])) for w, n in others}
        counts = spelled + 0.1
        counts[256, 256] = 0  # no word is empty
        counts /= counts.sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore"):
            self.byte = np.log(counts)

    def spelling(self, words: pa.Array) -> np.ndarray:
        """The sum of log p(its bytes and its end) of each word."""
        if not len(words):
            return np.zeros(0)
        at = np.frombuffer(b"".join(words.to_pylist()), np.uint8)
        size = pc.binary_length(words).to_numpy().astype(np.int64)
        ends = np.cumsum(size)
        before = np.empty(len(at), np.int64)
        before[1:] = at[:-1]
        before[ends - size] = 256
        return np.add.reduceat(self.byte[before, at], ends - size) + self.byte[at[ends - 1], 256]


def spellings(rare: DataFrame) -> np.ndarray:
    """Counts (257 x 257) of a byte after another in the words of rare(word, n), each as often as it occurs; 256 is an end."""

    def run(batches):
        out = np.zeros(257 * 257, np.int64)
        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = np.frombuffer(w, np.uint8).astype(np.int64)
                np.add.at(out, 257 * np.concatenate(([256], at)) + np.concatenate((at, [256])), n)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(out[some], pa.int64())], names=["at", "n"])

    out = np.zeros(257 * 257)
    for r in rare.select("word", "n").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most 66,049 rows
        out[r.at] = r.n
    return out.reshape(257, 257)


class WindowNetwork:
    """logits of groups and of the classes in a group, both linear in tanh(sum of one table row for each neighbour + a)."""

    def __init__(self, vocab: list[bytes], hidden: int = HIDDEN, seed: int = 3, open_to: OpenVocabulary | None = None):
        self.ids = {w: i + 2 for i, w in enumerate(vocab)}
        self.open = open_to
        self.known = None  # made where a text is first read
        size = len(vocab) + 2 + (HASHED if open_to else 0)
        if open_to:
            self.ids |= open_to.classes
        rng = np.random.default_rng(seed)
        groups = -(-size // GROUP)
        self.shapes = [(len(OFFSETS), size, hidden), (hidden,), (groups, hidden), (groups,), (size, hidden), (size,)]
        self.weights = [(rng.standard_normal(s) * 0.1).astype(np.float32) if len(s) > 1 else np.zeros(s, np.float32) for s in self.shapes]

    def read(self, texts: Sequence[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of the tokens of each text, and its sum of log p(token | its class)."""
        if len(texts) == 1 and texts[0] and len(texts[0]) > BLOCK:
            each = [self._read([part]) for part in blocks(texts[0])]
            return [np.concatenate([ids for (ids,), _ in each])], sum(inner for _, inner in each)
        return self._read(texts)

    def _read(self, texts: Sequence[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        if self.known is None:
            share = self.open.share if self.open else {}
            self.known = pa.array(list(self.ids), pa.binary()), np.array([*self.ids.values(), OTHER], np.int16), np.array([share.get(w, 0.0) for w in self.ids] + [0.0])
        words, lengths = split(texts)
        coded = words.dictionary_encode()
        at = coded.indices.to_numpy()
        row = pc.fill_null(pc.index_in(coded.dictionary, self.known[0]), len(self.ids)).to_numpy()
        inner = self.known[2][row]
        if self.open:
            rare = row == len(self.ids)
            inner[rare] = self.open.spelling(coded.dictionary.filter(pa.array(rare)))
        ends = np.cumsum([0, *lengths.tolist()])
        ids = self.known[1][row][at]
        sums = np.concatenate(([0.0], np.cumsum(inner[at])))[ends]
        return [ids[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], np.diff(sums)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """tanh of the sums, a row for each window of context (neighbours, windows)."""
        tables, a = self.weights[0], self.weights[1]
        h = tables[0].take(context[0], axis=0)
        for k in range(1, len(OFFSETS)):
            h += tables[k].take(context[k], axis=0)
        h += a
        h += h
        with np.errstate(over="ignore"):
            np.exp(h, out=h)  # tanh x = 1 - 2 / (exp 2x + 1): exp is the faster function
        h += 1
        np.divide(-2, h, out=h)
        h += 1
        return h

    def heads(self) -> np.ndarray:
        """(groups, groups + GROUP, hidden + 1): for each group the rows of all groups and of its own classes, with their biases."""
        _, _, g, c, w, b = self.weights
        n, size = len(g), len(w)
        classes = np.zeros((n * GROUP, w.shape[1] + 1), w.dtype)
        classes[:size, :-1], classes[:size, -1], classes[size:, -1] = w, b, NEVER
        out = np.empty((n, n + GROUP, w.shape[1] + 1), w.dtype)
        out[:, :n, :-1], out[:, :n, -1], out[:, n:] = g, c, classes.reshape(n, GROUP, -1)
        return out

    def logits(self, part: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], np.ndarray, np.ndarray]:
        """An order of the windows by the group of their own class, their ids (1 + neighbours, windows) in it, (group, begin, end)
        of each group, the hidden values, and (groups + GROUP, windows): the logits of all groups and of the classes in the own one.
        """
        which = part[:, 0] // GROUP
        order = np.argsort(which, kind="stable")
        which, ids = which[order], part[order].T.astype(np.intp)
        ends = [*(np.flatnonzero(np.diff(which)) + 1).tolist(), len(which)]
        groups = [(int(which[i]), i, j) for i, j in zip([0, *ends], ends, strict=False)]
        h = self.hidden(ids[1:])
        wide = np.ones((len(h), h.shape[1] + 1), h.dtype)
        wide[:, :-1] = h
        z = np.empty((heads.shape[1], len(h)), h.dtype)
        for k, i, j in groups:
            np.matmul(heads[k], wide[i:j].T, out=z[:, i:j])
        return order, ids, groups, h, z

    def log_probability(self, windows: np.ndarray) -> np.ndarray:
        """log p of each window's own token."""
        heads, out = self.heads(), np.empty(len(windows))
        n = len(heads)
        for i in range(0, len(windows), CHUNK):
            order, ids, _, _, z = self.logits(windows[i : i + CHUNK], heads)
            out[i + order] = chosen(z[:n], ids[0] // GROUP) + chosen(z[n:], ids[0] % GROUP)
        return out

    def step(self, part: np.ndarray, state: list[np.ndarray], rate: float) -> None:
        """One mini-batch of Adagrad on the cross entropy."""
        heads = self.heads()
        _, ids, groups, h, z = self.logits(part, heads)
        n, size, width = len(heads), self.shapes[5][0], h.shape[1]
        slope(z[:n], ids[0] // GROUP, len(h))
        slope(z[n:], ids[0] % GROUP, len(h))
        rows, biases = np.zeros((n, n + GROUP, width), h.dtype), np.zeros((n, n + GROUP), h.dtype)
        biases[[k for k, _, _ in groups]] = np.add.reduceat(z, [i for _, i, _ in groups], axis=1).T
        dh = np.empty_like(h)
        for k, i, j in groups:
            np.matmul(z[:, i:j], h[i:j], out=rows[k])
            np.matmul(z[:, i:j].T, heads[k, :, :-1], out=dh[i:j])
        h *= h
        np.subtract(1, h, out=h)
        dh *= h
        grads = [self.neighbours(ids[1:], dh), np.ones(len(dh), dh.dtype) @ dh]
        grads += [rows[:, :n].sum(axis=0), biases[:, :n].sum(axis=0), rows[:, n:].reshape(-1, width)[:size], biases[:, n:].reshape(-1)[:size]]
        for p, d, s in zip(self.weights, grads, state, strict=True):
            move = d * d
            s += move
            np.sqrt(s, out=move)
            move += 1e-6
            np.divide(d, move, out=move)
            move *= rate
            p -= move

    def neighbours(self, context: np.ndarray, dh: np.ndarray) -> np.ndarray:
        """The slopes of the tables: the sum of dh over the windows with each neighbour.  Two columns are added as one complex number."""
        width = dh.shape[1]
        if width % 2:
            dh = np.column_stack([dh, np.zeros_like(dh[:, 0])])
        pairs = dh.view(np.result_type(dh.dtype, np.complex64))
        out = np.zeros((len(OFFSETS), self.shapes[0][1] * pairs.shape[1]), pairs.dtype)
        places = np.arange(out.shape[1]).reshape(-1, pairs.shape[1])
        for sums, near in zip(out, context, strict=True):
            np.add.at(sums, places.take(near, axis=0).reshape(-1), pairs.reshape(-1))
        return out.view(dh.dtype).reshape(len(OFFSETS), -1, dh.shape[1])[:, :, :width]

    def train(self, windows: np.ndarray, batch: int = 2048, rate: float = 0.1, seed: int = 0) -> None:
        state = [np.zeros_like(p) for p in self.weights]
        order = np.random.default_rng(seed).permutation(len(windows))
        for i in range(0, len(order), batch):
            self.step(windows[order[i : i + batch]], state, rate)

    def bare(self) -> WindowNetwork:
        """The network without its words, for tasks that have ids."""
        out = copy(self)
        out.ids, out.open, out.known = {}, None, None
        return out

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.weights])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, s in enumerate(self.shapes):
            n = int(np.prod(s))
            self.weights[k] = flat[at : at + n].reshape(s).astype(np.float32)
            at += n


def chosen(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The log-softmax of each column of z at its own row (sums over the first axis are the fast ones)."""
    z -= z.max(axis=0)
    held = z.reshape(-1).take(own * z.shape[1] + np.arange(len(own)))
    return held - np.log(np.exp(z, out=z).sum(axis=0))


def slope(z: np.ndarray, own: np.ndarray, n: int) -> None:
    """z becomes the derivative of -log softmax at each column's own row, over n."""
    z -= z.max(axis=0)
    np.exp(z, out=z)
    z /= z.sum(axis=0) * np.float32(n)
    z.reshape(-1)[own * z.shape[1] + np.arange(len(own))] -= np.float32(1 / n)


def windows(stream: np.ndarray) -> np.ndarray:
    """(tokens, 5): each token of a stream of ids between pairs of EDGE, then its neighbours.  The first and last two are neighbours only."""
    at = np.flatnonzero(stream[2:-2] != EDGE) + 2
    return np.column_stack([stream[at], *[stream[at + o] for o in OFFSETS]]) if len(at) else np.empty((0, 1 + len(OFFSETS)), np.int16)


EDGES = np.full(2, EDGE, np.int16)


def streamed(texts: Sequence[np.ndarray]) -> np.ndarray:
    return np.concatenate([EDGES, *[x for ids in texts for x in (ids, EDGES)]]).astype(np.int16)


def stretches(ids: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A text's ids as streams of up to `most` tokens, each with the neighbours at its ends."""
    padded = streamed([ids])
    for i in range(0, len(ids), most):
        yield padded[i : min(i + most, len(ids)) + 4]


def packed(rows: Iterator[tuple[int, np.ndarray]], most: int) -> Iterator[np.ndarray]:
    """Units from (shard, ids), sorted by shard: streams of `most` tokens or little more, of one shard each; a longer text alone."""
    now, held, size = None, [], 0
    for shard, ids in rows:
        if held and (shard != now or size >= most):
            yield streamed(held)
            held, size = [], 0
        now = shard
        if len(ids) > most:
            yield from stretches(ids, most)
        elif len(ids):
            held.append(ids)
            size += len(ids)
    if held:
        yield streamed(held)


def encoded(docs: DataFrame, model: WindowNetwork, text: str, key: str, carry: Sequence[str] = ()) -> DataFrame:
    """(h, ids, inner) and the carried columns as c0, c1, ...: a hash of key and text, the ids of the tokens, the sum of log p(token | its class)."""
    safe = [f"c{i}" for i in range(len(carry))]
    named = docs.select(F.col(text).alias("t"), F.xxhash64(F.col(key), F.col(text)).alias("h"), *[F.col(c).alias(a) for c, a in zip(carry, safe, strict=True)])

    def factory():
        def f(texts):
            each, inner = model.read(texts)
            return None, [[ids.tobytes() for ids in each], inner]

        return f

    return annotate(named, "t", [T.StructField("ids", T.BinaryType()), T.StructField("inner", T.DoubleType())], factory, ["h", *safe])


def dealt(rows: DataFrame, total: int, unit: int = UNIT, shard: int = SHARD) -> DataFrame:
    """(ids): streams of all tokens of rows(h, ids), the same for any layout of the rows."""

    def pack(batches):
        each = ((s, np.frombuffer(x, np.int16)) for b in batches for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for u in packed(each, unit):
            yield pa.RecordBatch.from_arrays([pa.array([u.tobytes()], pa.binary())], names=["ids"])

    shards = F.pmod("h", F.lit(max(1, -(-total // shard)))).alias("shard")
    return rows.where(F.length("ids") > 0).select(shards, "ids", "h").repartition("shard").sortWithinPartitions("shard", "h").select("shard", "ids").mapInArrow(pack, "ids binary")


def training_units(docs: DataFrame, model: WindowNetwork, text: str, key: str, total: int, unit: int = UNIT, shard: int = SHARD) -> DataFrame:
    """(ids): streams of all tokens of all documents."""
    return dealt(encoded(docs, model, text, key), total, unit, shard)


def averaged(units: DataFrame, model: WindowNetwork, slots: int = 16) -> np.ndarray | None:
    """Weights trained on each unit from the model's, averaged by tokens: first in each task, then over `slots` rows."""
    model = model.bare()

    def local(batches):
        from pyspark import TaskContext

        n, total = 0, 0.0
        for b in batches:
            for raw in b.column(0):
                part = windows(np.frombuffer(raw.as_buffer(), np.int16))
                own = copy(model)
                own.weights = [p.copy() for p in model.weights]
                own.train(part, seed=len(part))
                n, total = n + len(part), total + own.flat().astype(np.float64) * len(part)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % slots], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slot", "n", "flat"])

    def add(batches):
        got: dict[int, list] = {}
        for b in batches:
            for slot, n, raw in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                old = got.get(slot, (0, 0.0))
                got[slot] = (old[0] + n, old[1] + np.frombuffer(raw, np.float64))
        for slot, (n, total) in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slot", "n", "flat"])

    schema = "slot int, n long, flat binary"
    sums = sorted(units.mapInArrow(local, schema).repartition(slots, "slot").mapInArrow(add, schema).collect(), key=lambda r: r.slot)
    n = sum(r.n for r in sums)
    return sum(np.frombuffer(r.flat, np.float64) for r in sums) / n if n else None


def vocabulary(docs: DataFrame, text: str, vocab: int | None) -> tuple[WindowNetwork, int]:
    """An untrained network of the words of docs, and the number of all tokens."""
    counted = written(count_words(docs, text), "lm-words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    if vocab is not None:
        return WindowNetwork([bytes(r.word) for r in counted.orderBy(F.desc("n"), "word").limit(vocab - 2).collect()]), total
    least = max(2, total * FREQUENT)
    known = [(bytes(r.word), r.n) for r in counted.where(F.col("n") >= least).collect()]  # under a million
    known.sort(key=lambda x: (-x[1], x[0]))
    words = [w for w, _ in known[: VOCAB - 2]]
    return WindowNetwork(words, open_to=OpenVocabulary(words, known[VOCAB - 2 :], spellings(counted.where(F.col("n") < least)))), total


def trained(model: WindowNetwork, units: DataFrame, rounds: int) -> WindowNetwork:
    units = written(units, "lm-units")
    for _ in range(rounds):
        flat = averaged(units, model)
        if flat is not None:
            model.load(flat)
    return model


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", vocab: int | None = None, rounds: int = 1) -> WindowNetwork:
    model, total = vocabulary(docs, text, vocab)
    return trained(model, training_units(docs, model, text, key, total), rounds)


FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("pll", T.DoubleType()), T.StructField("pll_mean", T.DoubleType())]


def sums(model: WindowNetwork, each: Sequence[np.ndarray], within: Sequence[float]) -> list[list]:
    """The columns FIELDS of texts by their ids and their sums of log p(token | its class)."""
    n = [*map(len, each)]
    short = [ids for ids in each if len(ids) <= UNIT]
    logs = model.log_probability(windows(streamed(short)))
    edges = iter(np.concatenate(([0.0], np.cumsum(logs)))[np.cumsum([0, *map(len, short)])].tolist())
    out, before = [], next(edges)
    for ids, inner in zip(each, within, strict=True):
        if len(ids) <= UNIT:
            after = next(edges)
            out.append(after - before + inner if len(ids) else 0.0)
            before = after
        else:
            out.append(sum(float(model.log_probability(windows(s)).sum()) for s in stretches(ids, UNIT)) + inner)
    return [n, out, [s / k if k else None for s, k in zip(out, n, strict=True)]]


def score(docs: DataFrame, model: WindowNetwork, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """carry columns plus n_tokens, pll (the sum of log-probabilities) and pll_mean (of a token)."""

    def factory():
        def f(texts):
            each, within = model.read(texts)
            return None, sums(model, each, within.tolist())

        return f

    return annotate(docs, text, FIELDS, factory, carry)


def fit_and_score(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: Sequence[str] = ("doc_id",), vocab: int | None = None, rounds: int = 1) -> DataFrame:
    """What score gives with a model fitted to the same docs; ids are looked up once and written, two bytes a token."""
    taken = {f.name.lower() for f in FIELDS}
    carry = [c for c in carry if c.lower() not in taken]
    model, total = vocabulary(docs, text, vocab)
    rows = written(encoded(docs, model, text, key, carry), "lm-ids")
    model = trained(model, dealt(rows, total), rounds).bare()

    def factory():
        def f(each, within):
            return None, sums(model, [np.frombuffer(x, np.int16) for x in each], within)

        return f

    safe = [f"c{i}" for i in range(len(carry))]
    return annotate(rows, "ids", FIELDS, factory, safe, ["inner"]).toDF(*carry, *[f.name for f in FIELDS])
