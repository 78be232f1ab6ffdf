"""Removal of repeated 200-byte strings by a hash-compared suffix sort.

Every window of SPAN bytes is assigned its anchor, the GRAM bytes in it whose hash is least, so equal windows have equal
anchors at equal offsets, and neighbouring windows share one: a run.  A run is described by two 64-bit hashes, of its
anchor and of all its bytes (the context).

1. Anchors are counted over the corpus.  One that occurs once has no equal window anywhere.
2. An anchor that always has the same context repeats as a whole; so does a context that occurs twice.
3. What is left are contexts that share an anchor and differ around it: the ends of repeated passages.  Their bytes meet
   in one task for each anchor, where their windows are sorted as suffixes.  Prefix polynomial hashes and a binary search
   give the common extension of two suffixes, so that a comparison in the merge sort is logarithmic; neighbours that
   agree over SPAN bytes are verified byte for byte.  Anchors with more than GROUP contexts are settled by counting
   window hashes over the cluster instead, so no task holds a group of unbounded size.
Texts that occur as a whole more than once are known by their hash and need no runs.

Hashes that decide across tasks are pairs of independent 64-bit values.

Cases: null and empty texts have 0 bytes and nothing removed; texts under SPAN bytes have no window; repeated rows are
documents of their own, so all of a repeated text of SPAN bytes or more goes; windows may cut multi-byte characters and
never cross documents; of ties, equal windows all go; an empty table gives an empty result; other columns are not read, so
none can clash; long texts are scanned in segments.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy, written

SPAN, GRAM = 200, 64
GROUP = 50_000
SEGMENT = 1 << 18
KEY_BITS = 28
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
U = np.uint64


@lru_cache(4)
def byte_values(which: int) -> np.ndarray:
    return np.random.default_rng(77 + which).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i up to n at least."""
    if which not in _powers or len(_powers[which][0]) <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        both = []
        for b in (BASES[which], pow(BASES[which], -1, 1 << 64)):
            p = np.full(size, U(b))
            p[0] = U(1)
            both.append(np.multiply.accumulate(p))
        _powers[which] = (both[0], both[1])
    return _powers[which]


def prefix_hashes(data: np.ndarray, which: int) -> np.ndarray:
    """S with S[i] = sum over t < i of value(byte t) * base**t, modulo 2**64."""
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values(which)[data] * powers(which, len(data))[0][: len(data)], out=s[1:])
    return s


def substring_hash(s: np.ndarray, which: int, at: np.ndarray, size) -> np.ndarray:
    return (s[at + size] - s[at]) * powers(which, len(s))[1][at]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, from prefix and suffix minima of blocks of w."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, U(0xFFFFFFFFFFFFFFFF))
    padded[:n] = x
    cube = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(cube, axis=1).reshape(-1)
    back = np.minimum.accumulate(cube[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs(data: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor position, anchor hash, context hash) of the runs of data.

    room: the bytes from each position to its document's end; windows that lack room are none.
    """
    n = len(data) - SPAN + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none, none, none
    s1 = prefix_hashes(data, 0)
    gram = mixed(substring_hash(s1, 0, np.arange(len(data) - GRAM + 1), GRAM))
    key = (gram >> U(KEY_BITS) << U(KEY_BITS)) | np.arange(len(gram), dtype=np.uint64)
    anchor = (sliding_min(key, SPAN - GRAM + 1) & U((1 << KEY_BITS) - 1)).astype(np.int64)
    at = np.flatnonzero(room[:n] >= SPAN)
    if not len(at):
        return none, none, none, none, none
    a = anchor[at]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1))))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    start, end, pos = at[first], at[last], a[first]
    size = end + SPAN - start
    context = mixed(substring_hash(prefix_hashes(data, 1), 1, start, size) + size.astype(np.uint64))
    return start, end, pos, gram[pos].view(np.int64), context.view(np.int64)


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows."""
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def emitted(docs: DataFrame, light: bool) -> DataFrame:
    """Runs of docs(h1, h2, t) as (a, c) or, not light, (a, c, h1, h2, s, e, p); equal texts of a task once."""
    schema = "a long, c long" + ("" if light else ", h1 long, h2 long, s int, e int, p int")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for whole in batches:
            for b in slices(whole, 2, SEGMENT):
                h1, h2 = b.column(0).to_numpy(), b.column(1).to_numpy()
                fresh = np.zeros(len(h1), bool)
                for i, pair in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
                    if pair not in seen:
                        seen.add(pair)
                        fresh[i] = True
                data, offsets = string_bytes(b.column(2))
                sizes = np.diff(offsets)
                room = np.repeat(offsets[1:], sizes) - np.arange(len(data))
                room[~np.repeat(fresh, sizes)] = 0
                for low in range(0, max(1, len(data) - SPAN + 1), SEGMENT):
                    high = min(len(data), low + SEGMENT + SPAN - 1)
                    if high - low < SPAN:
                        continue
                    s, e, p, a, c = runs(data[low:high], room[low:high])
                    if not len(s):
                        continue
                    if light:
                        cols = [a, c]
                    else:
                        row = np.searchsorted(offsets, s + low, "right") - 1
                        off = low - offsets[row]
                        cols = [a, c, h1[row], h2[row], *((x + off).astype(np.int32) for x in (s, e, p))]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=names)
        tidy()

    return docs.select("h1", "h2", "t").mapInArrow(run, schema)


def covered(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of byte ranges [start, end), as maximal ranges."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.concatenate(([True], starts[1:] > reach[:-1])))
    return list(zip(starts[first].tolist(), reach[np.concatenate((first[1:] - 1, [len(starts) - 1]))].tolist(), strict=True))


def result(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    """(bytes, bytes removed, maximal removed ranges, sha256 of the rest)."""
    h, at, gone = sha256(), 0, 0
    for s, e in ranges:
        h.update(raw[at:s])
        gone += e - s
        at = e
    h.update(raw[at:])
    return len(raw), gone, len(ranges), h.hexdigest()


FOUND = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def first_pass(joined: DataFrame, key_type: str) -> DataFrame:
    """One row for each document: its result, or its text and sure ranges if some windows are open; and context bytes."""
    schema = f"doc_id {key_type}, h1 long, h2 long, {FOUND}, open binary, sure array<int>, contexts array<struct<a:long,c:long,s:int,p:int,single:boolean,raw:binary>>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        sent: set[tuple[int, int]] = set()
        for whole in batches:
            for b in slices(whole, 3, SEGMENT):
                out: list[list] = [[] for _ in range(7)]
                data, at = string_bytes(b.column(3))
                again = b.column(4).to_numpy(zero_copy_only=False)
                lists = b.column(5)
                low = lists.offsets.to_numpy()
                a, c, s, e, p, full, send = (lists.values.field(n).to_numpy(zero_copy_only=False) for n in ("a", "c", "s", "e", "p", "full", "send"))
                for i in range(b.num_rows):
                    raw = data[at[i] : at[i + 1]].tobytes()
                    own = low[i] + np.unique(s[low[i] : low[i + 1]], return_index=True)[1]
                    twice, sure, contexts = bool(again[i]), own[full[own]], []
                    for k in own[send[own]].tolist():
                        if (int(a[k]), int(c[k])) not in sent:
                            sent.add((int(a[k]), int(c[k])))
                            contexts.append({"a": a[k], "c": c[k], "s": s[k], "p": p[k], "single": not full[k] and not twice, "raw": raw[s[k] : e[k] + SPAN]})
                    pending = not twice and len(sure) < len(own)
                    if twice:
                        done = result(raw, [(0, len(raw))] if len(raw) >= SPAN else [])
                    elif pending:
                        done = (len(raw), None, None, None)
                    else:
                        done = result(raw, covered(s[sure], e[sure] + SPAN))
                    ranges = np.column_stack((s[sure], e[sure] + SPAN)).ravel() if pending else None
                    for col, v in zip(out, (*done, raw if pending else None, ranges, contexts or None), strict=True):
                        col.append(v)
                arrays = [b.column(k) for k in range(3)] + [pa.array(x, t.type) for x, t in zip(out, list(target)[3:], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=target.names)

    return joined.select("doc_id", "h1", "h2", "t", "again", "runs").mapInArrow(run, schema)


class Suffixes:
    """Suffixes of joined contexts, compared by prefix hashes over SPAN bytes."""

    def __init__(self, data: np.ndarray):
        self.data, self.s = data, prefix_hashes(data, 0)
        self.inverse = powers(0, len(data) + 1)[1]

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The common extension of suffixes i and j, at most SPAN, by binary search."""
        s, found = self.s, np.zeros(len(i), np.int64)
        ii, jj, si, sj = self.inverse[i], self.inverse[j], s[i], s[j]
        step = 128
        while step:
            size = found + step
            ok = size <= SPAN
            size = np.where(ok, size, 0)
            found = np.where(ok & ((s[i + size] - si) * ii == (s[j + size] - sj) * jj), size, found)
            step //= 2
        return found

    def before(self, i: np.ndarray, j: np.ndarray, or_equal: bool) -> np.ndarray:
        """Whether suffix i comes before j."""
        n = self.extension(i, j)
        same = n >= SPAN
        n = np.where(same, 0, n)
        return np.where(same, or_equal, self.data[i + n] < self.data[j + n])

    def merge_sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Window starts sorted inside each group (groups stand together): runs of 1, 2, 4, ... are merged, all at once."""
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.concatenate((first, [len(at)])))
        begin, length = np.repeat(first, size), np.repeat(size, size)
        at, local = at.copy(), np.arange(len(at)) - np.repeat(first, size)
        width, most = 1, int(size.max())
        while width < most:
            mine = local // width
            left = mine % 2 == 0
            other = np.where(left, mine + 1, mine - 1) * width
            low = np.minimum(other, length)
            high = np.minimum(other + width, length)
            base = low.copy()
            busy = np.flatnonzero(low < high)
            while len(busy):  # how many of the other run come before
                mid = (low[busy] + high[busy]) // 2
                rival, own = at[begin[busy] + mid], at[busy]
                l = left[busy]
                ahead = np.empty(len(busy), bool)
                ahead[l] = self.before(rival[l], own[l], False)
                ahead[~l] = self.before(rival[~l], own[~l], True)
                low[busy[ahead]] = mid[ahead] + 1
                high[busy[~ahead]] = mid[~ahead]
                busy = busy[low[busy] < high[busy]]
            place = begin + (mine // 2) * 2 * width + local % width + (low - base)
            sorted_at = np.empty_like(at)
            sorted_at[place] = at
            at = sorted_at
            width *= 2
        return at

    def repeated(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Of sorted windows, those that equal a neighbour of their group, byte for byte."""
        out = np.zeros(len(at), bool)
        if len(at) < 2:
            return out
        i = np.flatnonzero(group[1:] == group[:-1])
        i = i[self.extension(at[i], at[i + 1]) >= SPAN]
        for k in range(0, len(i), 4096):
            part = i[k : k + 4096]
            span = np.arange(SPAN)
            same = (self.data[at[part][:, None] + span] == self.data[at[part + 1][:, None] + span]).all(axis=1)
            out[part[same]] = True
            out[part[same] + 1] = True
        return out


def settled(rows: list[tuple]) -> list[tuple[int, int, int]]:
    """(h1, h2, window start) of repeated windows among contexts (a, c, h1, h2, s, p, single, raw), sorted by a."""
    seen: set[tuple[int, int]] = set()
    rows = [r for r in rows if not ((r[0], r[1]) in seen or seen.add((r[0], r[1])))]
    if len(rows) < 2:
        return []
    data = np.frombuffer(b"".join(r[7] for r in rows), np.uint8)
    sizes = np.array([len(r[7]) for r in rows], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    count = sizes - SPAN + 1
    which = np.repeat(np.arange(len(rows)), count)
    t = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    a = np.array([r[0] for r in rows], np.int64)[which]
    offset = np.array([r[5] - r[4] for r in rows], np.int64)[which] - t  # of the anchor in the window: equal for equal windows
    order = np.lexsort((offset, a))
    which, t, a, offset = which[order], t[order], a[order], offset[order]
    change = np.concatenate(([True], (a[1:] != a[:-1]) | (offset[1:] != offset[:-1])))
    group = np.cumsum(change)
    alone = change & np.concatenate((change[1:], [True]))
    which, t, group = which[~alone], t[~alone], group[~alone]
    if not len(which):
        return []
    at = begin[which] + t
    suffixes = Suffixes(data)
    done = suffixes.merge_sort(at, group)
    hit = done[suffixes.repeated(done, group)]
    row = np.searchsorted(begin, hit, "right") - 1
    return [(rows[r][2], rows[r][3], rows[r][4] + int(x - begin[r])) for r, x in zip(row.tolist(), hit.tolist(), strict=True) if rows[r][6]]


def as_ranges(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(h1, h2, first, last) of neighbouring windows."""
    out: list[list[int]] = []
    for h1, h2, s in sorted(set(found)):
        if out and out[-1][0] == h1 and out[-1][1] == h2 and out[-1][3] == s - 1:
            out[-1][3] = s
        else:
            out.append([h1, h2, s, s])
    return [tuple(x) for x in out]


RANGES = "h1 long, h2 long, lo int, hi int"


def _batch(found):
    cols = list(zip(*as_ranges(found), strict=True)) or [[], [], [], []]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["h1", "h2", "lo", "hi"])


def settle(contexts: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """Ranges of repeated windows; contexts of one anchor meet in a task, sorted, and are solved some anchors at a time."""

    def run(batches):
        held: list[tuple] = []
        size = 0
        for b in batches:
            for r in zip(*[b.column(k).to_pylist() for k in range(8)], strict=True):
                if size > chunk and held[-1][0] != r[0]:
                    yield _batch(settled(held))
                    held, size = [], 0
                held.append(r)
                size += len(r[7])
        if held:
            yield _batch(settled(held))
        held = []
        tidy()

    return contexts.repartition("a").sortWithinPartitions("a", "c").select("a", "c", "h1", "h2", "s", "p", "single", "raw").mapInArrow(run, RANGES)


def settle_hot(contexts: DataFrame) -> DataFrame:
    """The same for anchors of very many contexts: window hashes are counted over the cluster."""

    def run(batches):
        for b in batches:
            for h1, h2, s, single, raw in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True):
                data = np.frombuffer(raw, np.uint8)
                at = np.arange(len(data) - SPAN + 1)
                w = [mixed(substring_hash(prefix_hashes(data, k), k, at, SPAN)).view(np.int64) for k in (0, 1)]
                cols = [w[0], w[1], np.full(len(at), h1), np.full(len(at), h2), (at + s).astype(np.int32), np.full(len(at), single)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["w1", "w2", "h1", "h2", "at", "single"])

    windows = contexts.dropDuplicates(["a", "c"]).select("h1", "h2", "s", "single", "raw").mapInArrow(run, "w1 long, w2 long, h1 long, h2 long, at int, single boolean")
    twice = windows.groupBy("w1", "w2").count().where("count > 1").drop("count")
    return windows.where("single").join(twice, ["w1", "w2"]).select("h1", "h2", F.col("at").alias("lo"), F.col("at").alias("hi"))


def finish(joined: DataFrame, key_type: str) -> DataFrame:
    """Results of the documents that had open windows."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1, SEGMENT):
                out: list[list] = [[], [], [], []]
                for raw, sure, ranges in zip(*[b.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
                    starts = [*(sure or [])[::2], *(r["lo"] for r in ranges or [])]
                    ends = [*(sure or [])[1::2], *(r["hi"] + SPAN for r in ranges or [])]
                    for col, v in zip(out, result(raw, covered(np.array(starts, np.int64), np.array(ends, np.int64))), strict=True):
                        col.append(v)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.select("doc_id", "open", "sure", "ranges").mapInArrow(run, f"doc_id {key_type}, {FOUND}")


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    key_type = docs.schema[key].dataType.simpleString()
    t = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(key).alias("doc_id"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2"), t.alias("t"))
    anchors = emitted(texts, light=True).groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high"))
    # written, so that both sides of each join come from a shuffle of their own and a hot anchor or context can be split
    known = written(anchors.where("n > 1").select("a", (F.col("low") != F.col("high")).alias("differ")), "dedup-anchors")
    all_runs = written(emitted(texts, light=False).join(known, "a"), "dedup-runs")
    differ = all_runs.where("differ")
    kinds = written(differ.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("h1", "h2", "s")).alias("one")), "dedup-contexts")
    judged = differ.join(kinds, ["a", "c"]).withColumn("full", F.col("n") > 1).withColumn("send", F.col("one") == F.struct("h1", "h2", "s"))
    run = F.struct("a", "c", "s", "e", "p", "full", "send")
    same = all_runs.where("not differ").withColumn("full", F.lit(True)).withColumn("send", F.lit(False))
    each = same.select("h1", "h2", run.alias("run")).unionByName(judged.select("h1", "h2", run.alias("run")))
    twice = texts.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2", F.lit(None).cast(each.schema["run"].dataType).alias("run"), F.lit(True).alias("again"))
    by_text = each.withColumn("again", F.lit(False)).unionByName(twice).groupBy("h1", "h2").agg(F.collect_list("run").alias("runs"), F.max("again").alias("again"))
    passed = written(first_pass(texts.join(by_text, ["h1", "h2"], "left").withColumn("again", F.coalesce("again", F.lit(False))), key_type), "dedup-pass")
    contexts = passed.where("contexts is not null").select("h1", "h2", F.explode("contexts").alias("x")).select("h1", "h2", "x.*")
    hot = written(contexts.groupBy("a").agg(F.count_distinct("c").alias("n")).where(F.col("n") > group).select("a"), "dedup-hot")
    if hot.isEmpty():
        ranges = settle(contexts)
    else:
        ranges = settle(contexts.join(hot, "a", "left_anti")).unionByName(settle_hot(contexts.join(hot, "a", "left_semi")))
    by_open = ranges.groupBy("h1", "h2").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    later = passed.where("open is not null").join(by_open, ["h1", "h2"], "left")
    done = passed.where("open is null").select("doc_id", *[x.split()[0] for x in FOUND.split(", ")])
    return done.unionByName(finish(later, key_type))
