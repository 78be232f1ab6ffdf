"""Records laid on a reference piece by piece, with their chains as rows: no task holds a record.

A record is read in pieces of bounded length; anchors leave as rows, are sorted by reference order and chained in one streaming pass, whose
state is the ends of the chains that can still grow.  What a chain says about a site follows from the nearest anchors before
and after it, which are as-of joins over bins of positions; nothing is sorted or buffered beyond a bin but one row for each bin.

The meaning is that of chains.laid(), which reads a whole record at once: the same anchors, chains, statuses and ties.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .chains import ABSENT, AMBIGUOUS, NOT_COVERED, WIDE, Reference, coded, turned
from .scan import PIECE

MOST_BASES = 1 << 27  # of a reference: its words go to every executor
BIN = 4096


def reference_of(parts: DataFrame, k: int = 25, most: int = 4) -> Reference:
    """The index of a reference given in parts (start, seq), in any order; what lies between parts is unknown.

    A reference beyond `MOST_BASES` is an error, as is a part that overlaps another.
    """
    size = parts.agg(F.max(F.col("start") + F.length("seq")).alias("n")).first().n or 0
    if size > MOST_BASES:
        raise ValueError(f"a reference of {size} bases is too long for the executors: divide it")
    raw, end = np.full(size, ord("N"), np.uint8), 0
    for r in parts.where("length(seq) > 0").select("start", "seq").orderBy("start").collect():
        if r.start < end:
            raise ValueError("parts of the reference overlap")
        end = r.start + len(r.seq)
        raw[r.start : end] = np.frombuffer(r.seq.encode("ascii", "replace"), np.uint8)
    return Reference(raw.tobytes().decode(), k, most)


_ANCHOR = T.ArrayType(T.StructType([T.StructField("ref", T.LongType()), T.StructField("qry", T.LongType())]))
_RUN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _pairs(names: Sequence[str], a: np.ndarray, b: np.ndarray) -> pa.Array:
    """One cell that holds all (a, b)."""
    each = pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=list(names))
    return pa.ListArray.from_arrays(pa.array([0, len(each)], pa.int32()), each)


def read_pieces(records: DataFrame, index: Reference, step: int = 4, piece: int = PIECE) -> DataFrame:
    """A row for each piece of each record (seq_id, seq): seq_id, length_bp (of the record), own and back (its anchors in
    either direction, in the coordinates of that direction) and doubts (stretches without a concrete base, in the record's own).

    A null or empty sequence has one piece without anchors.
    """
    k = index.k

    def run(batches):
        for b in batches:
            for row, text in enumerate(b.column(1).to_pylist()):
                code = np.frombuffer((text or "").encode("ascii", "replace"), np.uint8)
                n = len(code)
                for at in range(0, max(1, n), piece):
                    part = coded(code[at : at + piece + k - 1].tobytes().decode())
                    far = n - at - len(part)  # bases behind this piece
                    own = index.anchors(part[-at % step :], step)
                    back = index.anchors(turned(part)[-far % step :], step)
                    unknown = np.flatnonzero(np.diff(np.concatenate(([0], part[:piece] == 4, [0])).astype(np.int8)))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(row, 1), pa.array([n], pa.int64()), _pairs(("ref", "qry"), own[0], own[1] + (at + -at % step)), _pairs(("ref", "qry"), back[0], back[1] + (far + -far % step)),
                         _pairs(("start", "end"), unknown[::2] + at, unknown[1::2] + at)],
                        names=["seq_id", "length_bp", "own", "back", "doubts"])

    schema = T.StructType([records.schema["seq_id"], T.StructField("length_bp", T.LongType()), T.StructField("own", _ANCHOR), T.StructField("back", _ANCHOR), T.StructField("doubts", _RUN)])
    return records.select("seq_id", "seq").mapInArrow(run, schema)


def directions(pieces: DataFrame, oriented: int = 50) -> DataFrame:
    """seq_id, length_bp, n_ambiguous and turned: a record keeps its direction if that gives `oriented` anchors, or as many as the other."""
    doubtful = F.aggregate("doubts", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    own, back = F.sum(F.size("own")), F.sum(F.size("back"))
    return pieces.groupBy("seq_id").agg(F.first("length_bp").alias("length_bp"), F.sum(doubtful).alias("n_ambiguous"), ((own < oriented) & (back > own)).alias("turned"))


def anchors(pieces: DataFrame, told: DataFrame) -> DataFrame:
    """(seq_id, ref, qry) in the chosen direction."""
    both = pieces.join(told.select("seq_id", "turned"), "seq_id")
    return both.select("seq_id", F.explode(F.when(F.col("turned"), F.col("back")).otherwise(F.col("own"))).alias("x")).select("seq_id", "x.*")


def doubts(pieces: DataFrame, told: DataFrame) -> DataFrame:
    """(seq_id, start, end): stretches without a concrete base, in the chosen direction."""
    each = pieces.select("seq_id", F.explode("doubts").alias("x")).join(told.select("seq_id", "turned", "length_bp"), "seq_id")
    start, end, n = F.col("x.start"), F.col("x.end"), F.col("length_bp")
    return each.select("seq_id", F.when(F.col("turned"), n - end).otherwise(start).alias("start"), F.when(F.col("turned"), n - start).otherwise(end).alias("end"))


class Chainer:
    """Chains of one record, fed with anchors by reference and record position: chain_labels() with its state kept between calls."""

    def __init__(self, max_gap: int, max_drift: int):
        self.max_gap, self.max_drift, self.made = max_gap, max_drift, 0
        self.live: list[list[int]] = []  # chain, diagonal, record position and reference position of its last anchor; the oldest first

    def label(self, r: int, q: int) -> int:
        best = None
        if self.live and self.live[0][3] < r - self.max_gap or len(self.live) > 8:
            self.live = [c for c in self.live if c[3] >= r - self.max_gap]
        for c in self.live:
            if c[2] < q and c[3] >= r - self.max_gap:
                drift = abs(c[1] - (q - r))
                if best is None or drift < best[0]:
                    best = drift, c
        if best is not None and best[0] <= self.max_drift:
            to = best[1]
        else:
            to = [self.made, 0, 0, 0]
            self.made += 1
            self.live.append(to)
        to[1:] = q - r, q, r
        return to[0]


def chained(found: DataFrame, max_gap: int = 3000, max_drift: int = 60, least: int = 2) -> DataFrame:
    """found (seq_id, ref, qry) with `chain`, in chains of at least `least` anchors.

    Rows come sorted by record and reference position and are labelled as they pass; a record's anchors may be any number.
    """
    kind = found.schema["seq_id"]

    def run(batches):
        now, held = object(), None
        for b in batches:
            labels = []
            for s, r, q in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if s != now:
                    now, held = s, Chainer(max_gap, max_drift)
                labels.append(held.label(r, q))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(labels, pa.int64())], names=["seq_id", "ref", "qry", "chain"])

    rows = found.select("seq_id", "ref", "qry").repartition("seq_id").sortWithinPartitions("seq_id", "ref", "qry")
    schema = T.StructType([kind, *[T.StructField(c, T.LongType()) for c in ("ref", "qry", "chain")]])
    labelled = cut(rows.mapInArrow(run, schema))
    enough = labelled.groupBy("seq_id", "chain").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("seq_id", "chain")
    return labelled.join(enough, ["seq_id", "chain"], "left_semi")


def chain_ends(linked: DataFrame, k: int) -> DataFrame:
    """seq_id, chain, low and high (reference span), first and last: the record positions of its ends."""
    one = F.struct("ref", "qry")
    by = linked.groupBy("seq_id", "chain").agg(F.min(one).alias("a"), F.max(one).alias("z"))
    return by.select("seq_id", "chain", F.col("a.ref").alias("low"), (F.col("z.ref") + k).alias("high"), F.col("a.qry").alias("first"), F.col("z.qry").alias("last"))


def nearest(queries: DataFrame, points: DataFrame, keys: Sequence[str], at: str, forward: bool = False, width: int = BIN) -> DataFrame:
    """queries with `point`: of points (keys, pos, val) with its keys, the last at or before `at`, or the first at or after it if forward.

    Of points at one position it is the one of the greatest val (of the least, if forward); none gives null.  An as-of join by a union: inside
    bins of `width` positions by a window, beyond them by the ends of the nearest bin, of which there is one row each.
    """
    keys = list(keys)
    best, turn = (F.min, F.desc) if forward else (F.max, F.asc)
    bin_of = lambda c: F.floor(F.col(c) / width).alias("_bin")
    numbered = queries.withColumn("_row", F.struct(*queries.columns))
    asks = numbered.select(*keys, bin_of(at), F.col(at).cast("long").alias("_at"), F.lit(1).alias("_asks"), F.lit(None).cast(T.StructType([T.StructField("pos", T.LongType()), T.StructField("val", points.schema["val"].dataType)])).alias("_point"), "_row")
    said = points.select(*keys, bin_of("pos"), F.col("pos").cast("long").alias("_at"), F.lit(0).alias("_asks"), F.struct(F.col("pos").cast("long").alias("pos"), "val").alias("_point"), F.lit(None).cast(numbered.schema["_row"].dataType).alias("_row"))
    order = [turn("_at"), F.asc("_asks"), turn("_point")]
    inside = W.partitionBy(*keys, "_bin").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    here = said.unionByName(asks).withColumn("_here", F.last("_point", ignorenulls=True).over(inside)).where("_asks = 1")
    ends = said.select(*keys, "_bin", "_point").unionByName(asks.select(*keys, "_bin", "_point").distinct()).groupBy(*keys, "_bin").agg(best("_point").alias("_end"))
    over = W.partitionBy(*keys).orderBy(turn("_bin")).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(over)).select(*keys, "_bin", "_before")
    return here.join(carried, [*keys, "_bin"]).select("_row.*", F.coalesce("_here", "_before").alias("point"))


def _unclear(queries: DataFrame, unknown: DataFrame, width: int) -> DataFrame:
    """queries (seq_id, low, high, ...) with `unclear`: whether a stretch of unknown bases overlaps [low, high)."""
    points = unknown.select("seq_id", F.col("start").alias("pos"), F.col("end").alias("val"))
    told = nearest(queries.withColumn("_to", F.col("high") - 1), points, ["seq_id"], "_to", width=width)
    return told.withColumn("unclear", F.coalesce(F.col("point.val") > F.col("low"), F.lit(False)) & (F.col("high") > F.col("low"))).drop("point", "_to")


def statuses(linked: DataFrame, unknown: DataFrame, sites: DataFrame, k: int = 25, widest: int = 2000, slack: int = 25, width: int = BIN) -> DataFrame:
    """(seq_id, guide_id, status) of the sites whose first start lies at most `slack` outside what a record's chains reach.

    linked: seq_id, chain, ref, qry; unknown: seq_id, start, end; sites: guide_id, ref_start, ref_end (1-based inclusive), a row for each place.
    Of a site's places and a record's chains the most informative status counts.
    """
    ends = cut(chain_ends(linked, k))
    places = sites.select("guide_id", (F.col("ref_start") - 1).cast("long").alias("start"), F.col("ref_end").cast("long").alias("end")).distinct()
    near = places.groupBy("guide_id").agg(F.min("start").alias("first"))
    reach = ends.groupBy("seq_id").agg((F.min("low") - slack).alias("a"), (F.max("high") + slack).alias("z"))
    bins = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(z) / width))).alias("bin")
    pairs = reach.select("seq_id", "a", "z", bins("a", "z")).join(near.withColumn("bin", F.floor(F.col("first") / width)), "bin").where(F.col("first").between(F.col("a"), F.col("z")))
    asked = cut(pairs.select("seq_id", "guide_id").join(places, "guide_id"))
    covers = ends.select("seq_id", "chain", F.col("low").alias("from"), (F.col("high") - k).alias("to"), bins("low", "high"))
    inside = asked.withColumn("bin", F.floor(F.col("start") / width)).join(covers, ["seq_id", "bin"]).where((F.col("from") <= F.col("start") - k) & (F.col("to") >= F.col("end")))
    points = linked.select("seq_id", "chain", F.col("ref").alias("pos"), F.col("qry").alias("val"))
    left = inside.select("seq_id", "chain", "guide_id", "start", "end", (F.col("start") - k).alias("_left"))
    left = nearest(left, points, ["seq_id", "chain"], "_left", width=width).withColumn("low", F.col("point.val")).drop("point", "_left")
    both = nearest(left, points, ["seq_id", "chain"], "end", forward=True, width=width).withColumn("high", F.col("point.val") + k).where("high > low")
    clear = _unclear(both.select("seq_id", "guide_id", "low", "high"), unknown, width)
    says = F.when(F.col("high") - F.col("low") > widest, WIDE).when(F.col("unclear"), AMBIGUOUS).otherwise(ABSENT)
    one = cut(clear.groupBy("seq_id", "guide_id").agg(F.min(says).alias("status")))
    rest = asked.join(one, ["seq_id", "guide_id"], "left_anti")
    before = ends.select("seq_id", F.col("high").alias("pos"), F.struct((-F.col("low")).alias("x"), F.col("chain").alias("c"), F.col("last").alias("q")).alias("val"))
    after = ends.select("seq_id", F.col("low").alias("pos"), F.struct(F.col("high").alias("x"), F.col("chain").alias("c"), F.col("first").alias("q")).alias("val"))
    gap = nearest(rest, before, ["seq_id"], "start", width=width).withColumn("low", F.col("point.val.q")).drop("point")
    gap = nearest(gap, after, ["seq_id"], "end", forward=True, width=width).withColumn("high", F.col("point.val.q") + k).drop("point")
    held = _unclear(gap.where("low IS NOT NULL AND high IS NOT NULL").select("seq_id", "guide_id", "low", "high"), unknown, width)
    two = held.select("seq_id", "guide_id", F.when(F.col("unclear"), AMBIGUOUS).otherwise(WIDE).alias("status"))
    none = rest.select("seq_id", "guide_id", F.lit(NOT_COVERED).alias("status"))
    other = two.unionByName(none).groupBy("seq_id", "guide_id").agg(F.min("status").alias("status"))
    return one.select("seq_id", "guide_id", "status").unionByName(other)


class Laid:
    """What a corpus says of a reference: told (seq_id, length_bp, n_ambiguous, turned), linked anchors, spans and statuses."""

    def __init__(self, records: DataFrame, index: Reference, step: int = 4, oriented: int = 50, piece: int = PIECE, **limits):
        self.k = index.k
        pieces = cut(read_pieces(records, index, step, piece))
        self.told = cut(directions(pieces, oriented))
        self.anchors = cut(anchors(pieces, self.told))
        self.linked = cut(chained(self.anchors, **limits))
        self.unknown = cut(doubts(pieces, self.told))
        self.spans = chain_ends(self.linked, self.k).select("seq_id", "low", "high")

    def statuses(self, sites: DataFrame, **options) -> DataFrame:
        return statuses(self.linked, self.unknown, sites, self.k, **options)
