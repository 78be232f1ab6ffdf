"""SimHash near-duplicates by bit-sliced comparison.

64-bit fingerprints of 3-word shingles link at `RADIUS` or fewer differing bits.  Copies share a fingerprint, so only
distinct fingerprints are compared.  They are dealt into buckets by the values of two of four 16-bit blocks (of two
differing bits at most two blocks are touched, so two agree: every link falls into some bucket).  A bucket over
`BUCKET` is dealt again by two of the four bytes left, after which 48 bits are fixed and a bucket holds at most 65,536
fingerprints, whatever the corpus.  Inside a bucket the fingerprints stand as 64 bit planes; all pairs at one offset
are compared at once with carry-save counters, and blocks of 64 pairs are abandoned when all exceed the radius.  Each
bucket gives a star for each of its classes, never all pairs.

Cases: a null text has no words and the fingerprint zero, which links like any other; texts of one or two words are one
shingle; repeated rows share class and fingerprint; a null doc_id has no part in the smallest id (a class of null ids
alone has a null component_id); of ties for the smallest id any row is the same one; texts of any length are read whole, shingles counted in
slices; other columns are not read, so none can clash; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from .common import annotate, shielded, written

RADIUS = 2
BUCKET = 2048
PAIRS = list(combinations(range(4), 2))


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit fingerprint of some hashes; a bit is set if it is in over half of them."""
    n, counts = len(hashes), np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None) -> int:
    """The fingerprint of a text's shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    width = min(3, len(words))
    hash_of = xxhash.xxh64_intdigest
    return majority(np.array([hash_of(joined[s : e - 1], 42) for s, e in zip([0, *ends], ends[width - 1 :], strict=False)], np.uint64))


def fingerprints(docs: DataFrame, text: str = "text", carry=("doc_id",)) -> DataFrame:
    """carry columns plus fp."""
    return annotate(docs, text, [T.StructField("fp", T.LongType())], lambda: lambda ts: (None, [[fingerprint(t) for t in ts]]), carry)


class Forest:
    """Union-find over lanes."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.parent[a] != self.parent[b]
        if not apart.any():
            return
        for i, j in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            ri, rj = self.root(i), self.root(j)
            if ri != rj:
                self.parent[max(ri, rj)] = min(ri, rj)
        while True:  # flatten, so that later tests see most joined lanes at once
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return
            self.parent = up


def packed(bits: np.ndarray) -> np.ndarray:
    """(n, 64) booleans as n 64-bit words."""
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def beyond(counts: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose number, given as bit planes from the lowest, is more than radius."""
    more, same = np.zeros_like(counts[0]), ~np.zeros_like(counts[0])
    for k in range(len(counts) - 1, -1, -1):
        if radius >> k & 1:
            same = same & counts[k]
        else:
            more, same = more | same & counts[k], same & ~counts[k]
    return more


def close(run: np.ndarray, fp: np.ndarray, radius: int):
    """Pairs of lanes (a, b) of one run whose fingerprints differ in `radius` bits at most; equal run values stand together.

    All pairs at one offset are compared at once: each bit plane adds one to the counts of the lanes where it differs,
    with as many carry-save planes as the radius needs and one for what is over; blocks with no lane left are abandoned.
    """
    n = len(fp)
    if n < 2:
        return
    starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    ends = np.concatenate((starts[1:], [n]))
    left = np.repeat(ends, ends - starts) - np.arange(n) - 1  # further lanes of the same run
    blocks = -(-n // 64)
    left = np.concatenate((left, np.zeros(blocks * 64 - n, left.dtype))).reshape(blocks, 64)
    most = left.max(axis=1)
    words = np.zeros(blocks * 64, np.uint64)
    words[:n] = fp.view(np.uint64)
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # lanes x 64
    planes = np.zeros((64, blocks + int(most.max()) // 64 + 2), np.uint64)
    planes[:, :blocks] = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)
    for d in range(1, int(most.max()) + 1):
        at = np.flatnonzero(most >= d)
        alive = packed(left[at] >= d)
        q, r = divmod(d, 64)
        counts = [np.zeros_like(alive) for _ in range(radius.bit_length())]
        over = np.zeros_like(alive)
        for k in range(64):
            p = planes[k]
            far = p[at + q]
            if r:
                far = (far >> np.uint64(r)) | (p[at + q + 1] << np.uint64(64 - r))
            carry = p[at] ^ far
            for c in counts:
                was = c & carry
                c ^= carry
                carry = was
            over |= carry
            if k % 8 == 7 and k >= radius:
                live = (alive & ~(over | beyond(counts, radius))) != 0
                if not live.any():
                    at = at[:0]
                    break
                if 2 * live.sum() < len(at):
                    at, alive, over = at[live], alive[live], over[live]
                    counts = [c[live] for c in counts]
        if len(at):
            hit = alive & ~(over | beyond(counts, radius))
            block, lane = np.nonzero(np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a = at[block] * 64 + lane
            yield a, a + d


def links(run: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Lanes of classes, and their class's first lane: stars that span the classes of each run; equal run values stand together."""
    forest = Forest(len(fp))
    for a, b in close(run, fp, radius):
        forest.add(a, b)
    lanes = np.flatnonzero(forest.parent != np.arange(len(forest.parent)))
    return lanes, forest.parent[lanes]


def _link_partition(batches):
    """Edges from rows (b, key, fp) sorted by b and key; a run may go over several batches."""
    names = ["u", "v"]
    rest = None

    def solve(b, key, fp):
        same = np.concatenate(([False], (b[1:] == b[:-1]) & (key[1:] == key[:-1])))
        many = same | np.concatenate((same[1:], [False]))  # rows that are not alone in their bucket
        run = np.cumsum(~same)[many]
        f = fp[many]
        lanes, roots = links(run, f)
        if len(lanes):
            yield pa.RecordBatch.from_arrays([pa.array(f[lanes]), pa.array(f[roots])], names=names)

    for batch in batches:
        got = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        if rest is not None:
            got = [np.concatenate(x) for x in zip(rest, got, strict=True)]
        b, key, fp = got
        if not len(b):
            continue
        change = np.flatnonzero((b[1:] != b[:-1]) | (key[1:] != key[:-1]))
        last = int(change[-1]) + 1 if len(change) else 0
        if last:
            yield from solve(b[:last], key[:last], fp[:last])
        rest = [x[last:] for x in got]
    if rest is not None and len(rest[0]):
        yield from solve(*rest)


def _mask(blocks, width: int) -> int:
    m = sum(((1 << width) - 1) << (width * i) for i in blocks)
    return m - (1 << 64) if m >> 63 else m


def link_edges(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(u, v) edges that span the classes of the distinct fingerprints `fp`."""
    tagged = F.explode(F.array(*[F.struct(F.lit(i).alias("b"), F.col("fp").bitwiseAND(F.lit(_mask(p, 16))).alias("key")) for i, p in enumerate(PAIRS)]))
    first = distinct.select("fp", tagged.alias("t")).select("t.b", "t.key", "fp")
    hot = first.groupBy("b", "key").count().where(F.col("count") > bucket).select("b", "key", F.lit(True).alias("hot"))
    hot = written(hot, "simhash-hot")
    n = hot.count()
    rows = first
    if n:
        side = F.broadcast(hot) if n <= 100_000 else hot
        marked = first.join(side, ["b", "key"], "left")
        deeper = []
        for i, p in enumerate(PAIRS):
            free = [x for blk in range(4) if blk not in p for x in (2 * blk, 2 * blk + 1)]
            deeper.append(F.array(*[F.struct(F.lit(6 + 6 * i + k).alias("b"), F.col("fp").bitwiseAND(F.lit(_mask(p, 16) | _mask(c, 8))).alias("key")) for k, c in enumerate(combinations(free, 2))]))
        again = F.explode(F.element_at(F.array(*deeper), F.col("b") + 1))
        rows = marked.where(F.col("hot").isNull()).select("b", "key", "fp").unionByName(marked.where("hot").select("fp", again.alias("t")).select("t.b", "t.key", "fp"))
    dealt = rows.repartition("b", "key").sortWithinPartitions("b", "key", "fp")
    return dealt.mapInArrow(_link_partition, "u long, v long")


def classes(signed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(fp, component_id, rep_fp, rep_id): the class of each distinct fingerprint of signed(key, fp)."""
    distinct = written(signed.groupBy("fp").agg(F.min(key).alias("id")), "simhash-distinct")
    roots = components(link_edges(distinct.select("fp")))
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "id", "root")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "fp")
    best = member.groupBy("root").agg(F.min(order).alias("best"))
    joined = member.join(best, "root").select("fp", F.col("best.id").alias("c_id"), F.col("best.fp").alias("c_fp"))
    return distinct.join(joined, "fp", "left").select("fp", F.coalesce("c_id", "id").alias("component_id"), F.coalesce("c_fp", "fp").alias("rep_fp"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, fingerprint (16 hexadecimal digits) and component_id for each row."""
    signed = written(fingerprints(docs, text, [key]), "simhash-signed")
    out = signed.join(written(classes(signed, key), "simhash-classes"), "fp")  # written: a hot fingerprint can then be split
    return out.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
