"""Exact Jaccard join of documents as sets of five-word shingles, as a metric-space join.

Distance 1 - J is a metric and a link is a distance of at most `RADIUS`.  Documents of equal sets are one node.

1. Pivots.  Of a set of n shingles, two linked sets share one among the first n - ceil(0.8 n) + 1 of each, in any order of all
   shingles; a rare-first order is taken from counts in `CELLS` hashed cells, summed over all documents.  The smallest node that
   holds a shared shingle is the pivot of all sets that hold it there: farther pivots are at a distance over the radius, and every
   link lies inside the region of a common pivot.
2. Regions of up to `LEAF` nodes are first sieved by profiles: the sizes of a set's parts in hashed cells.  The L1 distance of
   profiles never exceeds the symmetric difference, so a pair whose profiles are farther apart than a link allows is none; what
   stays connected goes on, without its text so far.  Those few are joined in one task: distances to a pivot are exact,
   and only pairs inside the window |d(x, p) - d(y, p)| <= r that the triangle inequality leaves are looked at.
3. Larger regions are divided again, around pivots that a hash draws from them: a node goes to its nearest pivot (its Voronoi
   cell) and is replicated to each cell with d(x, p) <= d(x, nearest) + 2r, so a link has both ends in the home of either.  Cells
   whose nodes are of one component already are done.  A cell that holds over half of its region (all sets about as
   far from each other as from any pivot) is compared as pairs of blocks of bounded weight, between different components only.

All distances are of whole sets; shingles are known by 64-bit hashes.  A group of copies, or a component, may hold any part of the rows: no task
holds more than two blocks, and a star of links to a pivot stands for all pairs of its ball.

Cases: a null text has no words; a text without words has the empty set, no links and its own id as component; up to four
words are one shingle; repeated rows are one node and each has its row; a null key has no part in the smallest key (of a
component of null keys alone it is null); an empty table gives an empty result; columns of docs other than text and key are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.alike import run_ends, shared_counts, spread
from ..operators.components import components
from ..operators.presence import sized_broadcast
from .common import SLICE_BYTES, slices, tidy, written

WIDTH, PERCENT = 5, 80
RADIUS = 1 - PERCENT / 100
CELLS, CELL_BLOCK = 1 << 18, 1 << 10
LEAF, BLOCK, WEIGHT = 256, 1024, 1 << 20  # nodes of a leaf and of a block, and shingles of either
PIVOTS = 24  # drawn from a region that is divided
DIVIDED = 0.5  # a cell of more than this part of its region is compared by blocks
MOST_SENT = 500_000
NEAR = 1e-12
#: One odd factor for each place in a shingle.
PLACE = np.random.default_rng(11).integers(0, 1 << 63, WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)  # fixed values: a public 64-bit finaliser
TURN = np.uint64(33)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 7)], np.uint64)
    w = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), np.dtype("<u8"))
    n = len(w) - WIDTH + 1
    h = w[:n] * PLACE[0]
    for k in range(1, WIDTH):
        h += w[k : n + k] * PLACE[k]
    h ^= h >> TURN
    h *= M1
    h ^= h >> TURN
    h *= M2
    h ^= h >> TURN
    return np.unique(h)


def first(held: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of a set, one of which any linked set has among its own: the rarest by counts, ties in the order of hashes."""
    n = len(held)
    if not n:
        return held
    order = np.argsort(counts[(held & np.uint64(CELLS - 1)).astype(np.int64)], kind="stable")
    return held[order[: n - -(-PERCENT * n // 100) + 1]]


def profile(held: np.ndarray) -> bytes:
    """How many shingles of a set fall into each of a power of two of cells, about a fifth of its size; 255 stands for more."""
    cells = 64
    while 5 * cells < len(held):
        cells *= 2
    return np.minimum(np.bincount((held & np.uint64(cells - 1)).astype(np.int64), minlength=cells), 255).astype(np.uint8).tobytes()


def folded(cells: np.ndarray, to: int) -> np.ndarray:
    """Profiles [row, cell] of fewer cells."""
    while cells.shape[1] > to:
        half = cells.shape[1] // 2
        cells = np.minimum(cells[:, :half] + cells[:, half:], 255)
    return cells


def sieved(nodes: list[int], sizes: list[int], profiles: list[bytes]) -> list[list[int]]:
    """Groups of two or more nodes, such that every link between these nodes is inside a group."""
    order = sorted(range(len(nodes)), key=lambda k: (sizes[k], nodes[k]))
    n = np.array([sizes[k] for k in order], np.int64)
    last = np.searchsorted(n, 100 * n // PERCENT, "right")
    classes, at = Classes(), 0
    while at < len(order):  # rows with profiles of one width, each against the following ones in reach of its size
        width = len(profiles[order[at]])
        stop = at
        while stop < len(order) and len(profiles[order[stop]]) == width:
            stop += 1
        end = int(last[stop - 1])
        held = np.vstack([folded(np.frombuffer(profiles[order[k]], np.uint8).astype(np.int16)[None, :], width) for k in range(at, end)])
        for i in range(at, stop):
            rest = slice(i + 1 - at, int(last[i]) - at)
            apart = np.abs(held[rest] - held[i - at]).sum(1, dtype=np.int64)
            # J >= c/100 means a symmetric difference of at most (a + b)(100 - c)/(100 + c)
            for k in np.flatnonzero(apart * (100 + PERCENT) <= (n[i] + n[i + 1 : last[i]]) * (100 - PERCENT)).tolist():
                classes.united(nodes[order[i]], nodes[order[i + 1 + k]])
        at = stop
    groups: dict[int, list[int]] = {}
    for x in nodes:
        groups.setdefault(classes.root(x), []).append(x)
    return [sorted(g) for g in groups.values() if len(g) > 1]


def linked(both: int, a: int, b: int) -> bool:
    return 100 * both >= PERCENT * (a + b - both) and both > 0


def shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of each pair: shingles that many sets hold by products of membership matrices, the others by their pairs of sets."""
    sides = []
    for sets in (left, right):
        held = np.concatenate(sets)
        order = np.argsort(held, kind="stable")
        held, own = held[order], np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])[order]
        sides.append((held, own, *run_ends(held)))
    (hx, ox, fx, tx), (hy, oy, fy, ty) = sides
    _, i, j = np.intersect1d(hx[fx], hy[fy], assume_unique=True, return_indices=True)
    number = np.arange(len(i))
    entries = [(np.repeat(number, times[at]), own[spread(first[at], times[at])]) for own, first, times, at in ((ox, fx, tx, i), (oy, fy, ty, j))]
    return shared_counts(*entries, len(i), len(left), len(right)).reshape(len(left), len(right)).astype(np.int64)


class Classes:
    """Components of what one task holds; united() says whether two were apart."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(p, p)
        return x

    def united(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def leaf_links(nodes: list[int], sets: list[np.ndarray], classes: list[int], pivot: int = 0) -> list[tuple[int, int]]:
    """Links that make the components of these nodes, given the classes known so far.

    Distances to the pivot come first; others are looked at by growing distance, inside the window of the triangle
    inequality, and only between different components.
    """
    sizes = np.array([len(s) for s in sets])
    known, made = Classes(), []
    to = np.array([shared(sets[pivot], s) for s in sets])
    far = 1 - to / (sizes + sizes[pivot] - to)
    for k, both in enumerate(to.tolist()):
        if k != pivot and linked(both, int(sizes[k]), int(sizes[pivot])) and known.united(classes[k], classes[pivot]):
            made.append((nodes[pivot], nodes[k]))
    order = np.argsort(far, kind="stable")
    last = np.searchsorted(far[order], far[order] + RADIUS + NEAR, "right")
    matrix = overlaps(sets, sets) if len(nodes) > 24 else None
    for i, x in enumerate(order.tolist()):
        for y in order[i + 1 : last[i]].tolist():
            if x == pivot or y == pivot or known.root(classes[x]) == known.root(classes[y]):
                continue
            a, b = int(sizes[x]), int(sizes[y])
            if 100 * min(a, b) < PERCENT * max(a, b):
                continue
            both = int(matrix[x, y]) if matrix is not None else shared(sets[x], sets[y])
            if linked(both, a, b):
                known.united(classes[x], classes[y])
                made.append((nodes[x], nodes[y]))
    return made


def block_links(left, right, same: bool) -> list[tuple[int, int]]:
    """Links between two blocks of (node, set, class), or inside one, that unite different classes."""
    sets_a, sets_b = [x[1] for x in left], [x[1] for x in right]
    a, b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    both = overlaps(sets_a, sets_b)
    good = (100 * both >= PERCENT * (a[:, None] + b[None, :] - both)) & (both > 0)
    if same:
        good = np.triu(good, 1)
    known, made = Classes(), []
    for x, y in np.argwhere(good).tolist():
        if known.united(left[x][2], right[y][2]):
            made.append((left[x][0], right[y][0]))
    return made


def _edges(pairs) -> pa.RecordBatch:
    u, v = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _runs(batches, width: int):
    """(key, rows) of each stretch of equal values in the first `width` columns of sorted rows."""
    now, held = None, []
    for batch in batches:
        for row in zip(*[batch.column(k).to_pylist() for k in range(batch.num_columns)], strict=True):
            if row[:width] != now and held:
                yield now, held
                held = []
            now = row[:width]
            held.append(row[width:])
    if held:
        yield now, held


def _sieve(batches):
    """(group, node) from rows (region, node, n, profile) sorted by region: equal groups of several regions have one name."""
    for _, rows in _runs(batches, 1):
        for group in sieved(*(list(c) for c in zip(*rows, strict=True))):
            raw = np.array(group, np.int64)
            name = int.from_bytes(xxhash.xxh64_digest(raw.tobytes()), "little", signed=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), name)), pa.array(raw)], names=["p", "node"])


def _leaves(batches):
    """Links from rows (region, node, class, text) sorted by region and node."""
    made = []
    for _, rows in _runs(batches, 1):
        if len({r[1] for r in rows}) > 1:
            made += leaf_links([r[0] for r in rows], [shingles(r[2]) for r in rows], [r[1] for r in rows])
        if len(made) > 10_000:
            yield _edges(made)
            made = []
    yield _edges(made)
    tidy()


def _blocks(batches):
    """Links from rows (cell, i, j, own, node, class, text) sorted by cell, i, j: those of blocks i and j."""
    for (_, i, j), rows in _runs(batches, 3):
        if len({r[2] for r in rows}) < 2:
            continue
        sides = {i: [], j: []}
        for own, node, cls, text in rows:
            sides[own].append((node, shingles(text), cls))
        if sides[i] and sides[j]:
            yield _edges(block_links(sides[i], sides[j], i == j))
    tidy()


def _divided(batches):
    """Rows (cell, salt, drawn, node, text), sorted with drawn rows first, to links with pivots and to places in cells.

    Out go (kind, cell, node, to): kind 0 a link of node and pivot `to`; kind 1 the node's place in the cell of pivot `to`.
    """
    names = ["kind", "cell", "node", "to"]
    for (cell, _), rows in _runs(batches, 2):
        pivots = [(node, shingles(text)) for drawn, node, text in rows if drawn == 0]
        out = []
        for drawn, node, text in rows:
            if drawn == 0:
                continue
            held = shingles(text)
            both = [shared(held, p) for _, p in pivots]
            far = [1 - o / (len(held) + len(p) - o) for o, (_, p) in zip(both, pivots, strict=True)]
            reach = min(far) + 2 * RADIUS + NEAR
            for d, o, (p, s) in zip(far, both, pivots, strict=True):
                if p != node and linked(o, len(held), len(s)):
                    out.append((0, cell, node, p))
                if d <= reach:
                    out.append((1, cell, node, p))
        if out:
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    tidy()


SIGNED = "key {}, th long, n long, sid long, low long, profile binary, block int, counts binary"


def _signed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """A row (key, th, n, sid, low, profile) for each document and, from each task, rows (block, counts) with its counts in hashed cells."""
    flat = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("t"))
    kind = flat.schema["key"].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        counts = np.zeros(CELLS, np.int64)
        fields = [to_arrow_type(kind), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]
        names = ["key", "th", "n", "sid", "low", "profile", "block", "counts"]
        for whole in batches:
            for batch in slices(whole, 2):
                sets = [shingles(t) for t in batch.column(2).to_pylist()]
                ends = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                if sets:
                    counts += np.bincount((np.concatenate(sets) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                made = [batch.column(0), batch.column(1), [len(s) for s in sets], ends[:, 0], ends[:, 1], [profile(s) for s in sets], [None] * len(sets), [None] * len(sets)]
                yield pa.RecordBatch.from_arrays([x.cast(t) if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, fields, strict=True)], names=names)
            tidy()
        used = [k for k in range(CELLS // CELL_BLOCK) if counts[k * CELL_BLOCK : (k + 1) * CELL_BLOCK].any()]
        made = [[None] * len(used)] * 6 + [used, [counts[k * CELL_BLOCK : (k + 1) * CELL_BLOCK].tobytes() for k in used]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, fields, strict=True)], names=names)

    return flat.select("key", "th", "t").mapInArrow(run, T._parse_datatype_string(SIGNED.format(kind.simpleString())))


def _summed(rows: DataFrame) -> np.ndarray:
    """The counts of all tasks, added up cell by cell on the cluster: `CELLS` numbers come to the driver."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = np.frombuffer(raw, np.int64)
                total[k] = total[k] + got if k in total else got
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])

    out = np.zeros(CELLS, np.int64)
    for r in rows.repartition("block").mapInArrow(run, "block int, counts binary").collect():
        out[r.block * CELL_BLOCK : (r.block + 1) * CELL_BLOCK] += np.frombuffer(r.counts, np.int64)
    return out


def _dealt(docs: DataFrame, text: str, counts: np.ndarray) -> DataFrame:
    """(shingle, sid) for the first shingles of each document."""
    held = docs.sparkSession.sparkContext.broadcast(counts.astype(np.uint32) if counts.max(initial=0) < 1 << 32 else counts)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 0):
                s, ids = [], []
                for t in batch.column(0).to_pylist():
                    full = shingles(t)
                    got = first(full, held.value)
                    s.append(got.view(np.int64))
                    ids.append(np.full(len(got), int.from_bytes(xxhash.xxh3_128_digest(full.tobytes())[:8], "little", signed=True), np.int64))
                if s:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(s)), pa.array(np.concatenate(ids))], names=["s", "sid"])
            tidy()

    return docs.select(F.col(f"`{text}`").alias("t")).where("t IS NOT NULL").mapInArrow(run, "s long, sid long")


def _links(least: DataFrame, dealt: DataFrame, texts_of) -> DataFrame | None:
    """Links (u, v) whose components are those of all links, from nodes least(sid, n, profile) and their first shingles."""
    pivots = dealt.groupBy("s").agg(F.min("sid").alias("p"), F.max("sid").alias("q")).where("p <> q").select("s", "p")
    members = written(dealt.join(pivots, "s").select("p", "sid").distinct().join(least.select("sid", "n"), "sid"), "join-members")
    regions = written(members.groupBy("p").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("weight"), F.min("n").alias("a"), F.max("n").alias("b")), "join-regions")
    fits = (F.col("many") <= LEAF) & (F.col("weight") <= WEIGHT)
    apart = (F.col("many") == 2) & (100 * F.col("a") < PERCENT * F.col("b"))  # two sets too unlike in size
    small = members.join(regions.where(fits & ~apart).select("p"), "p").join(least.select("sid", "profile"), "sid").select("p", F.col("sid").alias("node"), "n", "profile")
    groups = written(small.repartition("p").sortWithinPartitions("p", "node").mapInArrow(_sieve, "p long, node long"), "join-groups").distinct()
    large = members.join(regions.where(~fits).select("p"), "p")
    texts = written(texts_of(groups.select(F.col("node").alias("sid")).unionByName(large.select("sid")).distinct()), "join-texts")
    leaves = groups.join(texts.withColumnRenamed("sid", "node"), "node").select("p", "node", F.col("node").alias("class"), "t")
    found = written(leaves.repartition("p").sortWithinPartitions("p", "node").mapInArrow(_leaves, "u long, v long"), "join-links")
    cells = large.select(F.col("p").cast("string").alias("cell"), F.col("sid").alias("node"), "n")
    cells = written(cells, "join-cells")
    depth = 0
    while not cells.isEmpty():
        cells, more = _deeper(cells, texts, depth)
        found = found.unionByName(more)
        depth += 1
    return found


def _sized(cells: DataFrame) -> DataFrame:
    return cells.join(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("weight"), F.min("node").alias("least")), "cell")


def _deeper(cells: DataFrame, texts: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Divide cells(cell, node, n) once: the cells that are still too large, and the links found on the way."""
    sized = _sized(cells).withColumn("parts", F.ceil(F.greatest(F.col("many") / LEAF, F.col("weight") / WEIGHT)).cast("int"))
    chance = F.pmod(F.xxhash64("node", F.lit(depth)), F.lit(1 << 31)) < F.lit(PIVOTS * float(1 << 31)) / F.col("many")
    whole = written(sized.withColumn("drawn", chance | (F.col("node") == F.col("least"))).join(texts.withColumnRenamed("sid", "node"), "node"), "join-whole")
    pivots = whole.where("drawn").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("drawn", F.lit(0))
    rest = whole.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(-1)), F.col("parts")).cast("int")).withColumn("drawn", F.lit(1))
    cols = ["cell", "salt", "drawn", "node", "t"]
    dealt = pivots.select(*cols).unionByName(rest.select(*cols)).repartition("cell", "salt").sortWithinPartitions("cell", "salt", "drawn", "node")
    told = written(dealt.mapInArrow(_divided, "kind int, cell string, node long, to long"), "join-told")
    links = told.where("kind = 0").select(F.col("node").alias("u"), F.col("to").alias("v"))
    roots = components(links)
    placed = told.where("kind = 1").select("cell", "to", "node").join(whole.select("cell", "node", "n", F.col("many").alias("before")), ["cell", "node"])
    placed = placed.select(F.col("cell").alias("region"), F.concat_ws("/", "cell", F.col("to").cast("string")).alias("cell"), "node", "n", "before")
    classed = placed.join(roots, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")
    fits = (F.col("many") <= LEAF) & (F.col("weight") <= WEIGHT)
    stats = classed.groupBy("cell").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("weight"), F.first("before").alias("was"), F.first("region").alias("region"), F.min("class").alias("a"), F.max("class").alias("b"))
    stats = written(stats.where("a <> b").drop("a", "b").withColumn("stuck", ~fits & (F.col("many") > DIVIDED * F.col("was"))), "join-stats")
    undivided = stats.where("stuck").select("region").distinct()  # its cells hold much the same nodes: it is compared itself, once
    open_ = written(classed.drop("before", "region").join(stats.join(undivided, "region", "left_anti").select("cell", "many", "weight"), "cell"), "join-open")
    kept = whole.select("cell", "node", "many", "weight", "t").join(undivided.withColumnRenamed("region", "cell"), "cell").join(roots, "node", "left").withColumn("class", F.coalesce("root", "node"))
    with_text = texts.withColumnRenamed("sid", "node")
    small = open_.where(fits).join(with_text, "node").select("cell", "node", "class", "t").repartition("cell").sortWithinPartitions("cell", "node")
    blocks = F.ceil(F.greatest(F.col("many") / BLOCK, F.col("weight") / WEIGHT)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    tiled = kept.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    ends = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    tiles = tiled.select("cell", *ends, "own", "node", "class", "t").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "node")
    more = [written(x, "join-links") for x in (small.mapInArrow(_leaves, "u long, v long"), tiles.mapInArrow(_blocks, "u long, v long"))]
    return written(open_.where(~fits).select("cell", "node", "n"), "join-cells"), links.unionByName(more[0]).unionByName(more[1])


def linked_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """For each row of docs: its key, n_shingles and component_id, the smallest key that links reach."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * SLICE_BYTES))  # long texts come in small batches
    signed = written(_signed(docs, text, key), "join-signed")
    rows = signed.where("block IS NULL").select("key", "th", "n", "sid", "low", "profile")
    counts = _summed(signed.where("block IS NOT NULL").select("block", "counts"))
    order = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("id"), "th")
    least = rows.where("n > 0").groupBy("sid").agg(F.min(order).alias("one"), F.first("n").alias("n"), F.first("profile").alias("profile"), F.min("low").alias("a"), F.max("low").alias("b"))
    least = written(least.select("sid", "one.*", "n", "profile", "a", "b"), "join-nodes")
    if not least.where("a <> b").isEmpty():
        raise RuntimeError("two sets share a 64-bit digest")
    hashed = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("t"))

    def texts_of(sids):
        wanted = sized_broadcast(written(sids.join(least.select("sid", "id", F.col("th").alias("h")), "sid"), "join-wanted"), MOST_SENT)
        return hashed.join(wanted, F.col("th").eqNullSafe(F.col("h")) & F.col("key").eqNullSafe(F.col("id"))).select("sid", "t").dropDuplicates(["sid"])

    found = _links(least, written(_dealt(docs, text, counts), "join-first"), texts_of)
    roots = components(found).withColumnRenamed("node", "sid")
    member = least.select("sid", "id").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    named = member.join(member.groupBy("root").agg(F.min("id").alias("component")), "root").select("sid", "component")
    out = rows.join(named, "sid", "left").select("key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component_id"))
    return out.withColumnRenamed("key", key)
