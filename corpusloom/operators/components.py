"""Connected components by alternating large-star and small-star steps, all on the cluster."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _stars(pairs: DataFrame, keep) -> DataFrame:
    """For each u, the smallest of u and its neighbours v; the neighbours that keep() names are tied to it.

    The minimum is pre-aggregated before its shuffle, and the join back is one that Spark can split at a hot u.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return pairs.join(least, "u").where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _contracted(batches):
    """The edges of one partition, each node tied to the smallest that its batch-wise growing classes reach: few long paths are left."""
    parent: dict = {}

    def root(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        if len(parent) > 2_000_000:  # a bounded memory: what is known so far goes out
            yield _edges(parent, root, b.schema)
            parent.clear()
    if parent:
        yield _edges(parent, root, b.schema)


def _edges(parent, root, schema) -> pa.RecordBatch:
    ends = [root(x) for x in parent]
    return pa.RecordBatch.from_arrays([pa.array(list(parent), schema.field(0).type), pa.array(ends, schema.field(1).type)], names=["u", "v"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every end of edges (u, v); root is the smallest node that can be reached.

    Null ends and loops are ignored.  The edges of a partition are first contracted where they lie; then each round is written
    to the shared folder, so a lost executor costs one round.  Rounds grow with the logarithm of the longest path; a graph that
    needs over `most_rounds` is an error.
    """
    ends = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    kinds = dict(ends.dtypes)
    e = cut(ends.mapInArrow(_contracted, f"u {kinds['u']}, v {kinds['v']}").distinct())
    seen = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, F.col("v") > F.col("u")).select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct()
        # every edge now runs from the larger to the smaller end
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
