"""Selection by gates, skyline and lexicographic order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def gate(table: DataFrame, gates: Sequence[tuple[str, Column]]) -> DataFrame:
    """table with gates_failed, all failed labels in order ("-" if none), and survives.  A null verdict is a failure."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), label) for label, ok in gates]), lambda x: x.isNotNull())
    return table.withColumn("gates_failed", F.when(F.size(failed) == 0, "-").otherwise(F.array_join(failed, "; "))).withColumn("survives", F.size(failed) == 0)


def _dominates(higher: Sequence[str], lower: Sequence[str]) -> Column:
    weak = [F.col(f"a.{c}") >= F.col(f"b.{c}") for c in higher] + [F.col(f"a.{c}") <= F.col(f"b.{c}") for c in lower]
    strict = [F.col(f"a.{c}") > F.col(f"b.{c}") for c in higher] + [F.col(f"a.{c}") < F.col(f"b.{c}") for c in lower]
    return reduce(Column.__and__, weak) & reduce(Column.__or__, strict)


def dominance(table: DataFrame, key: str, higher: Sequence[str], lower: Sequence[str]) -> DataFrame:
    """(winner, loser): the winner is as good on every axis and better on one."""
    return table.alias("a").join(table.alias("b"), _dominates(higher, lower)).select(F.col(f"a.{key}").alias("winner"), F.col(f"b.{key}").alias("loser"))


def pareto_front(table: DataFrame, key: str, higher: Sequence[str], lower: Sequence[str], cells: int = 1024) -> DataFrame:
    """Rows that no other dominates.  A row with a null on an axis cannot be compared and stays; equal points stay together.  Axes
    are numbers.

    Distinct points are dealt to a grid of at most about `cells` cells by quantiles of each axis.  A point that others of its
    batch beat on every axis goes where it lies; so does a cell of which a filled cell is better on every axis.  The points left meet
    those of the cells that are nowhere worse than their own, joined by cell, so nothing is broadcast but the list of cells.
    """
    axes = [*higher, *lower]
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in axes])
    points = table.where(known).select(*axes).distinct()
    # strictly worse on all axes as doubles is strictly worse: rounding keeps the order
    alive = cut(points.mapInArrow(lambda batches: map(lambda b: _survivors(b, len(higher)), batches), points.schema))
    per = max(2, int(cells ** (1 / len(axes))))
    shares = F.array(*[F.lit(i / per) for i in range(1, per)])
    marks = alive.agg(*[F.percentile_approx(F.col(c).cast("double"), shares).alias(c) for c in axes]).first()
    step = lambda c: reduce(Column.__add__, [(F.col(c).cast("double") >= F.lit(m)).cast("int") for m in sorted(set(marks[c] or []))], F.lit(0))
    # on every axis a greater number is better or the same
    place = F.array(*[step(c) if c in higher else -step(c) for c in axes])
    placed = alive.withColumn("cell", place)
    filled = sorted(tuple(r.cell) for r in placed.select("cell").distinct().collect())  # at most per ** axes
    if not filled:
        return table
    at = np.array(filled, np.int64)
    kept = [i for i, c in enumerate(at) if not (at > c).all(axis=1).any()]
    at = at[kept]
    rivals = [(at[i].tolist(), at[j].tolist()) for i in range(len(at)) for j in np.flatnonzero((at >= at[i]).all(axis=1))]
    near = table.sparkSession.createDataFrame(rivals, "cell array<int>, rival array<int>")
    left = placed.join(F.broadcast(near), "cell").alias("b")
    beaten = left.join(placed.withColumnRenamed("cell", "rival").alias("a"), (F.col("a.rival") == F.col("b.rival")) & _dominates(higher, lower))
    worse = beaten.select(*[F.col(f"b.{c}").alias(c) for c in axes]).distinct()
    front = placed.join(F.broadcast(near.select("cell").distinct()), "cell", "left_semi").drop("cell").join(worse, axes, "left_anti")
    return table.where(~known).unionByName(table.join(front, axes, "left_semi"))


def _survivors(batch: pa.RecordBatch, n_higher: int) -> pa.RecordBatch:
    """The batch without points that another of it beats on every axis; axes to be low follow the first n_higher."""
    if batch.num_rows < 2:
        return batch
    v = np.column_stack([np.asarray(c.cast(pa.float64(), safe=False)) for c in batch.columns])
    v[:, n_higher:] *= -1
    alive = np.arange(len(v))
    for i in np.argsort(-np.argsort(np.argsort(v, axis=0), axis=0).sum(axis=1), kind="stable")[:64]:  # the best on average beat most
        alive = alive[~(v[i] > v[alive]).all(axis=1)]
    return batch.take(pa.array(alive))


def lexicographic(table: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The first row in the order."""
    return table.orderBy(*order).limit(1)


def as_clean(table: DataFrame, key: str, base, lower: Sequence[str]) -> DataFrame:
    """Rows, other than the base, that are at most the base on each axis."""
    b = table.where(F.col(key) == base).select(*[F.col(c).alias(f"_b_{c}") for c in lower])
    ok = reduce(Column.__and__, [F.col(c) <= F.col(f"_b_{c}") for c in lower])
    return table.crossJoin(F.broadcast(b)).where(ok & (F.col(key) != base)).drop(*[f"_b_{c}" for c in lower])


def first_of(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row for each key: a deterministic dropDuplicates."""
    from pyspark.sql import Window as W

    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def first_under(curve: DataFrame, by: Sequence[str], k: str, value: str, limits: Sequence[float]) -> DataFrame:
    """by, limit and minimum_k: the least k with a value under each limit, null where none is."""
    each = curve.withColumn("limit", F.explode(F.array(*[F.lit(x) for x in limits])))
    return each.groupBy(*by, "limit").agg(F.min(F.when(F.col(value) < F.col("limit"), F.col(k))).alias("minimum_k"))


def chosen_names(table: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Rows whose column is one of names (an `isin`, which prunes partitions); no such row is an error."""
    out = table.where(F.col(column).isin(*names))
    if out.isEmpty():
        raise ValueError(f"no row of {column} is one of {', '.join(names)}")
    return out


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, with `only_in`, repeats counted: none if both hold the same rows."""
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def checked(claims: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """claims (claim, expected, actual) with `holds`: both null, or within tolerance of each other."""
    return claims.withColumn("holds", F.col("expected").eqNullSafe(F.col("actual")) | F.coalesce(F.abs(F.col("expected") - F.col("actual")) <= tolerance, F.lit(False)))


def top_overlap(ranked: DataFrame, setting: str, key: str, order: Sequence[Column], baseline, top: int = 20) -> DataFrame:
    """setting and shared: how many of each setting's first `top` keys are among the baseline's; order ends with the key."""
    from pyspark.sql import Window as W

    first = ranked.withColumn("_n", F.row_number().over(W.partitionBy(setting).orderBy(*order))).where(F.col("_n") <= top).select(setting, key)
    held = first.where(F.col(setting) == baseline).select(key, F.lit(1).alias("_held")).distinct()
    return first.join(held, key, "left").groupBy(setting).agg(F.count("_held").alias("shared"))
