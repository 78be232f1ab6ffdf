"""Near-duplicate records: bottom sketches, their similarity, single-linkage clusters and representatives."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.sequences import mash_identity
from ..session import cut
from .components import components
from .scan import sketch_of, sketches


def sketch_rows(records: DataFrame, k: int, size: int) -> DataFrame:
    """(seq_id, h, rank): the `size` smallest distinct hashes of each record's canonical k-mers."""
    return sketches(records, k, size).select("seq_id", F.posexplode("sketch").alias("rank", "h")).select("seq_id", "h", (F.col("rank") + 1).alias("rank"))


def firsts(sketched: DataFrame) -> DataFrame:
    """(seq_id, sketch) of the first record of each distinct sketch, known by two 64-bit hashes."""
    g = sketched.withColumn("g", _digest())
    return g.join(g.groupBy("g").agg(F.min("seq_id").alias("m")), "g").where("seq_id = m").select("seq_id", "sketch")


def _digest():
    return F.struct(F.xxhash64(F.lit(1), "sketch").alias("x"), F.xxhash64(F.lit(2), "sketch").alias("y"))


def least_jaccard(identity: float, k: int) -> float:
    """The Jaccard similarity that an identity stands for."""
    t = math.exp(k * (identity - 1))
    return t / (2 - t)


def similar_pairs(sketched: DataFrame, k: int, size: int, least_identity: float = 0.0) -> DataFrame:
    """(a, b, jaccard, identity) with a < b, for records that share a hash and have at least that identity.

    Records with the same sketch stand for each other: only the first of them is paired, and copies() ties the rest to it.
    For a limit j on the similarity, the least hash that two sketches share stands among the smallest (1 - j) n + 1 of
    each (before it come only hashes that the other lacks), so only those are joined.  Of sketches that together stay
    under `size` hashes the number of shared ones gives the similarity; otherwise it is read from the two sketches.
    """
    first = cut(firsts(sketched).withColumn("n", F.size("sketch")))
    if least_identity > 0:
        near = least_jaccard(least_identity, k)
        head = F.slice("sketch", 1, F.floor((1 - near) * F.col("n") + 1e-9).cast("int") + 1)
        hashes = first.select("seq_id", "n", F.explode(head).alias("h"))
        sizes = F.least("x.n", "y.n") >= near * F.greatest("x.n", "y.n") - 1e-9
        met = hashes.alias("x").join(hashes.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.seq_id") < F.col("y.seq_id")) & sizes).select(F.col("x.seq_id").alias("a"), F.col("y.seq_id").alias("b")).distinct()
        out = _read_pairs(met, first, size)
    else:
        hashes = first.select("seq_id", "n", F.explode("sketch").alias("h"))
        met = hashes.alias("x").join(hashes.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.seq_id") < F.col("y.seq_id")))
        counted = cut(met.groupBy(F.col("x.seq_id").alias("a"), F.col("y.seq_id").alias("b")).agg(F.count(F.lit(1)).alias("both"), F.first(F.col("x.n") + F.col("y.n")).alias("n")))
        union = F.col("n") - F.col("both")
        out = counted.where(union <= size).select("a", "b", (F.col("both") / union).alias("j")).unionByName(_read_pairs(counted.where(union > size).select("a", "b"), first, size))
    told = out.select("a", "b", F.round("j", 6).alias("jaccard"), F.round(mash_identity(F.col("j"), k), 6).alias("identity"))
    return told.where(F.col("identity") >= least_identity) if least_identity > 0 else told


def _read_pairs(pairs: DataFrame, first: DataFrame, size: int) -> DataFrame:
    """(a, b, j) of pairs, from their sketches: sorted arrays, merged by the batch."""
    full = pairs.join(first.select(F.col("seq_id").alias("a"), F.col("sketch").alias("sa")), "a").join(first.select(F.col("seq_id").alias("b"), F.col("sketch").alias("sb")), "b")
    kinds = dict(full.dtypes)

    def run(batches):
        for batch in batches:
            sides = []
            for i in (2, 3):
                col = batch.column(i)
                sides.append((col.offsets.to_numpy(), col.values.to_numpy()))
            out = []
            for row in range(batch.num_rows):
                out.append(_jaccard(*(values[at[row] : at[row + 1]] for at, values in sides), size))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "j"])

    return full.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}, j double")


def _jaccard(x: np.ndarray, y: np.ndarray, size: int) -> float:
    """The similarity that two sketches, sorted arrays, tell."""
    union = np.union1d(x, y)[:size]
    return float((np.intersect1d(x, y, assume_unique=True) <= union[-1]).sum() / len(union)) if len(union) else 0.0


_MIXER, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def part_keys(least: np.ndarray, near: float, size: int) -> np.ndarray:
    """Keys of the parts of a sketch, of which two sketches whose similarity is `near` or more have at least one in common.

    Hashes are dealt to parts by their value, and a part's key tells all its hashes.  Sketches of such a similarity differ in
    d hashes at most, so of more than d parts one is the same in both (pigeonhole).  d follows the larger sketch: sizes are
    classed by powers of 1 / near, and a sketch has keys for its own class and the next, where one a little larger lies.
    """
    own = max(0, math.ceil(math.log(len(least)) / -math.log(near) - 1e-9))
    out = []
    for c in (own, own + 1):
        most = near**-c
        # a union beyond `size` is cut there, so the two may differ in more
        differ = 2 * (1 - near) / (1 + near) * most if most / near <= size else 2 * (1 - near) * min(most, size)
        n = int(differ + 1e-6) + 1
        sums = np.zeros(n, np.uint64)
        mixed = least.view(np.uint64) * _MIXER
        np.add.at(sums, least % n, mixed ^ mixed >> np.uint64(32))
        keys = (sums ^ sums >> np.uint64(29)) * _STEP + (np.arange(n, dtype=np.uint64) + np.uint64(c << 32)) * _MIXER
        out.append((keys ^ keys >> np.uint64(32)) * _MIXER)
    return np.concatenate(out).view(np.int64)


def _traces(records: DataFrame, k: int, size: int, near: float) -> DataFrame:
    """(seq_id, whole, keys): a digest of each record's sketch, and part_keys() of it; no row without a sketch."""

    def run(batches):
        for b in batches:
            rows, whole, keys = [], [], []
            for row, text in enumerate(b.column(1)):
                least = sketch_of(text.as_py(), k, size)
                if len(least):
                    rows.append(row)
                    whole.append(hashlib.blake2b(least.tobytes(), digest_size=16).digest())
                    keys.append(part_keys(least, near, size))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(whole, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["seq_id", "whole", "keys"])

    kind = records.schema["seq_id"].dataType.simpleString()
    return records.select("seq_id", "seq").mapInArrow(run, f"seq_id {kind}, whole binary, keys array<bigint>")


def _alike(pairs: DataFrame, records: DataFrame, k: int, size: int, least_identity: float) -> DataFrame:
    """The pairs (u, v) of at least that identity.  Sequences are sent, not their sketches, which are several times as large."""
    text = records.select("seq_id", "seq")
    full = pairs.join(text.withColumnRenamed("seq_id", "u"), "u").withColumnRenamed("seq", "su").join(text.withColumnRenamed("seq_id", "v"), "v")
    kinds = dict(full.dtypes)

    def run(batches):
        last, known = None, None
        for b in batches:
            out = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                y = y.as_py()
                if y != last:
                    last, known = y, sketch_of(y, k, size)
                out.append(_jaccard(sketch_of(x.as_py(), k, size), known, size))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["u", "v", "j"])

    read = full.select("u", "v", "su", "seq").mapInArrow(run, f"u {kinds['u']}, v {kinds['v']}, j double")
    return read.where(F.round(mash_identity(F.col("j"), k), 6) >= least_identity).select("u", "v")


def close_links(records: DataFrame, k: int, size: int, least_identity: float) -> DataFrame:
    """(u, v): links of at least that identity, copies among them, whose components are those of all such links.

    No sketch is kept or sent: records meet by part_keys(), and the sequences of those that meet are compared.  At first the
    records that share a key are compared with the first of them; then, for keys whose records are not yet of one
    component, all pairs of different components.  For limits near 1: the number of keys grows with the distance from it.
    """
    near = least_jaccard(least_identity - 1e-6, k)
    traced = cut(_traces(records, k, size, near))
    first = traced.groupBy("whole").agg(F.min("seq_id").alias("v"))
    same = traced.select("seq_id", "whole").join(first, "whole").where("seq_id <> v").select(F.col("seq_id").alias("u"), "v")
    keys = traced.join(first.select(F.col("v").alias("seq_id")), "seq_id", "left_semi").select("seq_id", F.explode("keys").alias("key"))
    w = W.partitionBy("key")
    met = cut(keys.withColumn("v", F.min("seq_id").over(w)).withColumn("z", F.max("seq_id").over(w)).where("v < z").drop("z"))
    stars = cut(met.where("seq_id <> v").select(F.col("seq_id").alias("u"), "v").distinct())
    links = cut(_alike(stars, records, k, size, least_identity))
    roots = components(links).withColumnRenamed("node", "seq_id")
    member = met.select("seq_id", "key").join(roots, "seq_id", "left").withColumn("root", F.coalesce("root", "seq_id"))
    mixed = member.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a < z").select("key")
    apart = cut(member.join(mixed, "key", "left_semi"))
    x, y = apart.alias("x"), apart.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & (F.col("x.seq_id") > F.col("y.seq_id"))).select(F.col("x.seq_id").alias("u"), F.col("y.seq_id").alias("v")).distinct()
    rest = cut(_alike(cut(pairs.join(stars, ["u", "v"], "left_anti")), records, k, size, least_identity))
    return links.unionByName(rest).unionByName(same)


def copies(sketched: DataFrame) -> DataFrame:
    """(u, v): each record with a sketch seen before, and the first that has it."""
    g = sketched.select("seq_id", _digest().alias("g"))
    return g.join(g.groupBy("g").agg(F.min("seq_id").alias("v")), "g").where("seq_id <> v").select(F.col("seq_id").alias("u"), "v")


def _twins(sketched: DataFrame) -> DataFrame:
    """nearest() of the records whose sketch others share."""
    return _twins_of(copies(sketched))


def _twins_of(tied: DataFrame) -> DataFrame:
    back = tied.groupBy("v").agg(F.min("u").alias("u"))
    return tied.unionByName(back.select(F.col("v").alias("u"), F.col("u").alias("v"))).select(F.col("u").alias("seq_id"), F.col("v").alias("nearest"), F.lit(1.0).alias("nearest_identity"), F.lit(1.0).alias("nearest_jaccard"))


def nearest(sketched: DataFrame, pairs: DataFrame) -> DataFrame:
    """(seq_id, nearest, nearest_identity, nearest_jaccard): each record's most similar other one, the smallest of equals.

    A record whose sketch others share is nearest to the first of them; pairs are those of similar_pairs().
    """
    same = _twins(sketched)
    both = pairs.select(F.col("a").alias("seq_id"), F.col("b").alias("other"), "identity", "jaccard").unionByName(pairs.select(F.col("b").alias("seq_id"), F.col("a").alias("other"), "identity", "jaccard"))
    best = both.groupBy("seq_id").agg(F.min_by(F.struct("other", "identity", "jaccard"), F.struct(-F.col("jaccard"), F.col("other"))).alias("m"))
    rest = best.join(same.select("seq_id"), "seq_id", "left_anti")
    return same.unionByName(rest.select("seq_id", F.col("m.other").alias("nearest"), F.col("m.identity").alias("nearest_identity"), F.col("m.jaccard").alias("nearest_jaccard")))


def nearest_by_rounds(sketched: DataFrame, k: int, size: int, limits: Sequence[float] = (0.8, 0.3)) -> tuple[DataFrame, list[dict]]:
    """nearest() without the pairs of all records that share a hash; and for each round the limit, records open and pairs read.

    In a total order of hashes, the rarest first, two sketches whose similarity is t or more share their first l hashes among the
    first (1 - t) n + l of each; l is a tenth of n, the lesser of the two where they differ.  A round joins the firsts of the records still open with those of all: open ones to their own t, the
    round's limit or the best they have seen, if that is more.  A record that has found its t is settled, for nothing beyond
    its firsts can reach it; the others go on to the next limit, and at last to all hashes that they share.
    """
    first = cut(firsts(sketched).withColumn("n", F.size("sketch")))
    spread = first.select("seq_id", "n", F.explode("sketch").alias("h"))
    held = spread.groupBy("h").agg(F.count(F.lit(1)).alias("held"))
    ranked = cut(spread.join(held, "h").withColumn("r", F.row_number().over(W.partitionBy("seq_id").orderBy("held", "h"))).where("held > 1").drop("held"))
    least = lambda n: F.ceil(n / 10)
    reach = lambda n, t: F.floor((1 - t) * n + 1e-9) + least(n)
    known = dict(first.dtypes)["seq_id"]
    best = first.select("seq_id", F.lit(None).cast(f"struct<other: {known}, jaccard: double, identity: double>").alias("m"))
    told, rounds = None, []
    for limit in (*limits, 0.0):
        # a similarity that rounds to the limit may lie below it; what is settled lies above by more than rounding moves it
        own = F.greatest(F.lit(limit), F.coalesce(F.col("m.jaccard") - 2e-6, F.lit(0.0)))
        x = ranked.join(best.withColumn("t", own).select("seq_id", "t"), "seq_id").where(F.col("r") <= reach(F.col("n"), F.col("t"))).alias("x")
        y = ranked.where(F.col("r") <= reach(F.col("n"), F.lit(limit))).alias("y")
        alike = F.least("x.n", "y.n") >= F.col("x.t") * F.greatest("x.n", "y.n") - 1e-9
        met = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.seq_id") != F.col("y.seq_id")) & alike)
        side = lambda c: F.first(F.col(c))
        by = met.groupBy(F.col("x.seq_id").alias("a"), F.col("y.seq_id").alias("b")).agg(F.count(F.lit(1)).alias("both"), side("x.n").alias("n"), side("y.n").alias("m"), side("x.t").alias("t"))
        if limit:
            pairs = cut(by.where(F.col("both") >= F.least(least(F.col("n")), least(F.col("m")))).select("a", "b"))
            read = _read_pairs(pairs, first, size)
        else:  # all hashes of the other side are here, so only those beyond a record's own firsts are not counted yet
            most = F.col("both") + F.greatest(F.col("n") - reach(F.col("n"), F.col("t")), F.lit(0))
            union = F.col("n") + F.col("m") - F.col("both")
            sure = (most == F.col("both")) & (union <= size)
            able = sure | (most >= (F.col("t") - 1e-6) * F.least(F.lit(size), F.col("n") + F.col("m") - most))
            pairs = cut(by.where(able).select("a", "b", F.when(sure, F.col("both") / union).alias("j")))
            read = pairs.where("j is not null").unionByName(_read_pairs(pairs.where("j is null").select("a", "b"), first, size))
        j = F.round("j", 6)
        read = read.select("a", F.struct((-j).alias("o"), F.col("b").alias("other"), j.alias("jaccard"), F.round(mash_identity(F.col("j"), k), 6).alias("identity")).alias("p"))
        got = read.groupBy(F.col("a").alias("seq_id")).agg(F.min("p").alias("p"))
        best = cut(best.withColumn("t", own).join(got, "seq_id", "left").select("seq_id", "t", F.when(F.col("p").isNotNull(), F.struct("p.other", "p.jaccard", "p.identity")).otherwise(F.col("m")).alias("m")))
        rounds.append({"limit": limit, "open": best.count(), "pairs": pairs.count()})
        done = best.where(F.col("m.jaccard") >= F.col("t") + 1e-6) if limit else best.where("m is not null")
        told = done.select("seq_id", "m") if told is None else told.unionByName(done.select("seq_id", "m"))
        best = best.where(~F.coalesce(F.col("m.jaccard") >= F.col("t") + 1e-6, F.lit(False))).drop("t")
        if best.isEmpty():
            break
    same = _twins(sketched)
    rest = told.join(same.select("seq_id"), "seq_id", "left_anti")
    return same.unionByName(rest.select("seq_id", F.col("m.other").alias("nearest"), F.col("m.identity").alias("nearest_identity"), F.col("m.jaccard").alias("nearest_jaccard"))), rounds


def clusters(records: DataFrame, edges: DataFrame) -> DataFrame:
    """records with cluster_id (its smallest id), cluster_size and is_representative.

    The representative has the least ambiguity, then the greatest length, is curated, and has the first accession.
    """
    roots = components(edges).withColumnRenamed("node", "seq_id")
    out = records.join(roots, "seq_id", "left").withColumn("cluster_id", F.coalesce("root", "seq_id")).drop("root")
    w = W.partitionBy("cluster_id")
    order = w.orderBy("ambiguous_fraction", F.desc("length_bp"), F.desc("is_refseq"), "accession")
    return out.withColumn("cluster_size", F.count(F.lit(1)).over(w)).withColumn("is_representative", F.row_number().over(order) == 1)


def threshold_sweep(records: DataFrame, pairs: DataFrame, same: DataFrame, found: DataFrame, n_guides: int, thresholds: Sequence[float]) -> DataFrame:
    """For each identity threshold: clusters, records collapsed, the largest, guides present in all representatives.

    A record is a node of its own under each threshold, so all thresholds are clustered by one run of components; pairs are
    (a, b, identity) and same (u, v) links whatever the threshold.  The representative is that of clusters().
    """
    spark, whole = records.sparkSession, dict(records.dtypes)["seq_id"] in ("tinyint", "smallint", "int", "bigint")
    limits = F.broadcast(spark.createDataFrame([(i, float(t)) for i, t in enumerate(thresholds)], "i int, threshold double"))
    node = lambda c: F.col(c).cast("long") * len(thresholds) + F.col("i") if whole else F.concat(F.format_string("%03d/", "i"), F.col(c))
    links = pairs.join(limits, F.col("identity") >= F.col("threshold")).select("i", F.col("a").alias("u"), F.col("b").alias("v")).unionByName(same.crossJoin(limits.select("i")).select("i", "u", "v"))
    roots = components(links.select(node("u").alias("u"), node("v").alias("v"))).withColumnRenamed("node", "_node")
    each = records.crossJoin(limits).withColumn("_node", node("seq_id")).join(roots, "_node", "left").withColumn("root", F.coalesce("root", "_node"))
    w = W.partitionBy("root")
    order = w.orderBy("ambiguous_fraction", F.desc("length_bp"), F.desc("is_refseq"), "accession")
    told = cut(each.select("threshold", "seq_id", F.count(F.lit(1)).over(w).alias("size"), (F.row_number().over(order) == 1).alias("first")))
    sums = told.groupBy("threshold").agg(F.count_if("first").alias("n_clusters"), F.count_if(~F.col("first")).alias("n_collapsed"), F.max("size").alias("largest"))
    kept = found.join(told.where("first").select("threshold", "seq_id"), "seq_id").groupBy("threshold", "guide_id").agg(F.count_distinct("seq_id").alias("n"))
    perfect = kept.join(F.broadcast(sums), "threshold").where(F.col("n") == F.col("n_clusters")).groupBy("threshold").agg(F.count(F.lit(1)).alias("n_perfect"))
    out = sums.join(perfect, "threshold", "left").withColumn("n_perfect", F.coalesce("n_perfect", F.lit(0)))
    return out.withColumn("pct_perfect", F.round(100.0 * F.col("n_perfect") / F.lit(max(n_guides, 1)), 3))


def identity_range(pairs: DataFrame, identity: str = "identity") -> DataFrame:
    """One row: n_pairs and the least, median and greatest identity, null without pairs."""
    return pairs.agg(F.count(identity).alias("n_pairs"), F.min(identity).alias("least"), F.median(identity).alias("median"), F.max(identity).alias("greatest"))
