"""Product codes of vectors: Lloyd rounds over integer parts that rescan only what moved entries may have changed.

Components become integers floor(256 x) and a vector is cut into `PARTS` equal parts, each with a codebook of its own of up to `ENTRIES`
entries.  A block of vectors keeps, for each part and entry, a heap of its members keyed by slack: the distance to the second
nearest entry less that to the own one, plus the drift that the entry had gathered when the member came in.  A round adds to an
entry's drift how far it moved and how far any other entry of its codebook moved.  Members whose key is not above the
drift are popped and compared with all entries again; no other member can have changed its entry.  (A heap is kept as an array
sorted by key, which is one; popping cuts its head.)  Sums of entries change by what moved only.

Blocks are rows: vectors, codes, keys and heaps, written in the shared folder between rounds, so a lost executor costs a task.  The driver sees
codebooks and their sums alone, whose size is fixed by the length of a vector.

Cases: a vector that is null or has a null or non-finite component is dropped; equal keys start in the order of their vectors, null
keys come last; repeated rows are rows of their own; fewer rows than entries make a smaller codebook; a tie goes to the lower
index; null labels are one group; an empty table gives an empty result.  Vectors of several lengths, of one that `PARTS` does
not divide, or of components whose squares overflow raise ValueError.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.presence import sized_broadcast
from .common import SLICE_BYTES, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
ROWS = 1024  # vectors of a block
#: What sums and roots may lose to rounding, as parts of the distances and of the drift.
LOSS, DRIFT_LOSS = 1e-9, 1e-12


def integers(vectors, width: int | None = None) -> np.ndarray:
    """floor(256 x) of vectors, as an array [row, part, place]."""
    lengths = {len(v) for v in vectors} | ({width * PARTS} if width is not None else set())
    if len(lengths) > 1 or any(n % PARTS for n in lengths):
        raise ValueError(f"vectors need one length that {PARTS} divides, not {sorted(lengths)}")
    scaled = np.floor(np.array(vectors, np.float64) * SCALE).reshape(len(vectors), PARTS, -1)
    most = isqrt((1 << 60) // max(1, scaled.shape[2])) // 2
    if scaled.size and np.abs(scaled).max() > min(most, 1 << 30):
        raise ValueError("components are too large for exact squared distances")
    return scaled.astype(np.int64)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances [row, entry] of the rows of x and entries."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if x.shape[1] * (2 * largest) ** 2 < 1 << 52 else np.int64  # floats are exact there, and faster
    a, b = x.astype(kind), entries.astype(kind)
    out = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    return out.astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, ties to the lower index, and its slack."""
    d = squares(x, entries)
    at = d.argmin(1)
    rows = np.arange(len(x))
    best = np.sqrt(d[rows, at].astype(np.float64))
    if len(entries) == 1:
        return at, np.full(len(x), np.inf)
    d[rows, at] = np.iinfo(np.int64).max
    second = np.sqrt(d.min(1).astype(np.float64))
    return at, second - best - LOSS * (second + best)


def heaped(codes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Members by entry and key: the heaps of one part, one after another."""
    return np.lexsort((keys, codes)).astype(np.int32)


def popped(heaps: np.ndarray, codes: np.ndarray, keys: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """The members on top of each heap whose key the entry's drift has reached."""
    ends = np.searchsorted(codes[heaps], np.arange(len(drift) + 1))
    out = [heaps[a : a + np.searchsorted(keys[heaps[a:b]], drift[e], "right")] for e, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
    return np.concatenate(out) if out else np.empty(0, np.int32)


class Book:
    """The codebooks of all parts, [part, entry, place], with the sums of members and the drift gathered so far."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        parts, k, width = entries.shape
        self.totals = np.zeros((parts, k, width + 1), np.int64)
        self.drift = np.zeros((parts, k))

    def moved(self, change: np.ndarray) -> Book:
        """The book after its sums changed: entries are floors of means, those without members stay."""
        out = Book(self.entries.copy())
        out.totals = self.totals + change
        used = out.totals[:, :, -1] > 0
        out.entries[used] = out.totals[used][:, :-1] // out.totals[used][:, -1:]
        far = np.sqrt(((out.entries - self.entries).astype(np.float64) ** 2).sum(2))
        top = np.sort(far, axis=1)
        first = top[:, -1:]
        others = np.where(far == first, top[:, -2:-1] if far.shape[1] > 1 else 0.0, first)
        others = np.where((far == first).sum(1, keepdims=True) > 1, first, others)
        out.drift = (self.drift + far + others) * (1 + DRIFT_LOSS)
        return out

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


STATE = "ids array<{}>, labels array<{}>, x binary, codes binary, keys binary, heaps binary, change binary, rescanned long"


def _summed(changes, codes, x, sign) -> None:
    for p in range(x.shape[1]):
        np.add.at(changes[p, :, :-1], codes[:, p], sign * x[:, p])
        np.add.at(changes[p, :, -1], codes[:, p], sign)


def _first_block(x: np.ndarray, book: Book):
    n = len(x)
    codes, keys, heaps = np.zeros((n, PARTS), np.uint8), np.zeros((PARTS, n)), np.zeros((PARTS, n), np.int32)
    for p in range(PARTS):
        codes[:, p], keys[p] = nearest(x[:, p], book.entries[p])
        heaps[p] = heaped(codes[:, p], keys[p])
    change = np.zeros_like(book.totals)
    _summed(change, codes, x, 1)
    return codes, keys, heaps, change, n * PARTS


def _next_block(x, codes, keys, heaps, book: Book):
    """A block under moved entries: only popped members are compared again."""
    codes, keys, heaps = codes.copy(), keys.copy(), heaps.copy()
    change, count = np.zeros_like(book.totals), 0
    for p in range(PARTS):
        out = popped(heaps[p], codes[:, p], keys[p], book.drift[p])
        if not len(out):
            continue
        count += len(out)
        at, slack = nearest(x[out, p], book.entries[p])
        was = codes[out, p]
        left = at != was
        moved = x[out[left], p]
        np.add.at(change[p, :, :-1], was[left], -moved)
        np.add.at(change[p, :, -1], was[left], -1)
        np.add.at(change[p, :, :-1], at[left], moved)
        np.add.at(change[p, :, -1], at[left], 1)
        codes[out, p] = at
        keys[p, out] = slack + book.drift[p][at]
        heaps[p] = heaped(codes[:, p], keys[p])
    return codes, keys, heaps, change, count


def _row(schema: pa.Schema, ids, labels, x, codes, keys, heaps, change, count) -> pa.RecordBatch:
    raw = [x.astype(np.int32).tobytes(), codes.tobytes(), keys.tobytes(), heaps.tobytes(), change.tobytes(), count]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([ids, labels, *raw], schema, strict=True)], names=schema.names)


def _blocks(batch: pa.RecordBatch, width: int):
    """(ids, labels, x, codes, keys, heaps) of the rows of a state batch."""
    cols = [batch.column(k).to_pylist() for k in range(6)]
    for ids, labels, x, codes, keys, heaps in zip(*cols, strict=True):
        n = len(ids)
        ints = np.frombuffer(x, np.int32).astype(np.int64).reshape(n, PARTS, width)
        yield ids, labels, ints, np.frombuffer(codes, np.uint8).reshape(n, PARTS), np.frombuffer(keys).reshape(PARTS, n), np.frombuffer(heaps, np.int32).reshape(PARTS, n)


def _started(kept: DataFrame, book: Book, kinds: str) -> DataFrame:
    schema = T._parse_datatype_string(kinds)
    width = book.entries.shape[2]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids, labels, vectors = (batch.column(k).slice(at, ROWS).to_pylist() for k in range(3))
                x = integers(vectors, width)
                yield _row(target, ids, labels, x, *_first_block(x, book))

    return written(kept.mapInArrow(run, schema), "codes-state")


def _stepped(state: DataFrame, book: Book) -> DataFrame:
    schema, width = state.schema, book.entries.shape[2]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for ids, labels, x, codes, keys, heaps in _blocks(batch, width):
                yield _row(target, ids, labels, x, *_next_block(x, codes, keys, heaps, book))

    return written(state.mapInArrow(run, schema), "codes-state")


def _change(state: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The changes of all blocks added up, place by place, on the cluster: a row for each number of the codebooks."""

    def run(batches):
        total = np.zeros(int(np.prod(shape)), np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                total += np.frombuffer(raw, np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "v"])

    out = np.zeros(int(np.prod(shape)), np.int64)
    for r in state.select("change").mapInArrow(run, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r.v
    return out.reshape(shape)


def _coded(state: DataFrame, book: Book) -> DataFrame:
    """(id, label, code, error) of each vector."""
    kinds = {f.name: f.dataType.elementType for f in state.schema.fields[:2]}
    schema = T.StructType([T.StructField("id", kinds["ids"]), T.StructField("label", kinds["labels"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    width = book.entries.shape[2]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for ids, labels, x, codes, _, _ in _blocks(batch, width):
                own = book.entries[np.arange(PARTS)[None, :], codes]
                error = ((x - own) ** 2).sum((1, 2))
                made = [ids, labels, [c.tobytes().hex() for c in codes], error]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made, target, strict=True)], names=target.names)

    return state.select("ids", "labels", "x", "codes", "keys", "heaps").mapInArrow(run, schema)


def whole(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there, and all of its components finite."""
    v = F.col(f"`{vector}`")
    return df.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def encode(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, Book | None, list[DataFrame]]:
    """(key, code, error, label_error) for each kept row, the last codebooks, and the state after each pass (see rescans)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * SLICE_BYTES))  # rows of state are long
    kept = whole(df, vector).select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("v"))
    start = kept.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    types = {f.name: f.dataType for f in kept.schema.fields}
    if not start:
        empty = f"{key} {types['id'].simpleString()}, code string, error long, label_error long"
        return df.sparkSession.createDataFrame([], empty), None, []
    book = Book(integers([r.v for r in start]).transpose(1, 0, 2).copy())
    state = _started(kept, book, STATE.format(types["id"].simpleString(), types["label"].simpleString()))
    states = [state]
    for _ in range(rounds):
        book = book.moved(_change(states[-1], book.totals.shape))
        states.append(_stepped(states[-1], book))
    coded = written(_coded(states[-1], book), "codes")
    sums = sized_broadcast(coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("l"))).select(F.col("id").alias(key), "code", "error", "label_error")
    return out, book, states


def rescans(states: list[DataFrame]) -> list[int]:
    """How many parts each pass compared with all entries."""
    return [s.agg(F.sum("rescanned")).first()[0] for s in states]
