"""Comparing fractions over different denominators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LIMITS = (0.99, 0.95, 0.9, 0.7)


def class_counts(records: DataFrame, guides: DataFrame, found: DataFrame, column: str, classes: Sequence[str]) -> DataFrame:
    """Per guide and record class: records, records with the guide, and their ratio (null without records)."""
    size = {r[column]: r["count"] for r in records.groupBy(column).count().where(F.col(column).isin(*classes)).collect()}
    by = found.join(records.select("seq_id", column), "seq_id").groupBy("guide_id").agg(*[F.count_if(F.col(column) == c).alias(f"k_{c}") for c in classes])
    out = guides.select("guide_id").join(by, "guide_id", "left")
    cols = []
    for c in classes:
        n, k = size.get(c, 0), F.coalesce(f"k_{c}", F.lit(0))
        cols += [F.lit(n).cast("long").alias(f"n_{c}"), k.cast("long").alias(f"present_{c}"), (F.round(k / F.lit(n), 6) if n else F.lit(None).cast("double")).alias(f"conservation_{c}")]
    return out.select("guide_id", *cols)


def average_rank(column: str):
    """Rank with ties at their mean."""
    return F.rank().over(W.orderBy(column)) + (F.count(F.lit(1)).over(W.partitionBy(column)) - 1) / 2.0


def compare(rows: DataFrame, least_records: int = 10) -> DataFrame:
    """One row on fractions x and y of the same guides (rows: guide_id, x, y, records): correlations, counts below limits, moments.

    Correlations are null for fewer than two rows or without spread.  Ranks are over the dictionary, which is small.
    """
    used = rows.where(F.col("records") >= least_records)
    ranked = used.withColumn("rx", average_rank("x")).withColumn("ry", average_rank("y"))
    spread = (F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0)
    below = [F.count_if(F.col(c) < t).alias(f"{c}_below_{str(t).replace('.', '_')}") for c in "xy" for t in LIMITS]
    return ranked.agg(
        F.count(F.lit(1)).alias("n_guides"), F.when(spread, F.round(F.corr("x", "y"), 6)).alias("pearson"), F.when(spread, F.round(F.corr("rx", "ry"), 6)).alias("spearman"), *below,
        F.median("records").cast("int").alias("median_records"), F.round(F.avg("x"), 6).alias("mean_x"), F.round(F.avg("y"), 6).alias("mean_y"), F.round(F.min("x"), 6).alias("min_x"), F.round(F.min("y"), 6).alias("min_y"),
    )


def compare_sql(table: str) -> str:
    below = ", ".join(f"coalesce(count_if({c} < {t}), 0) AS {c}_below_{str(t).replace('.', '_')}" for c in "xy" for t in LIMITS)
    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r{c}" for c in "xy")
    return f"""SELECT count(*) AS n_guides, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round(corr(x, y), 6) END AS pearson, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round(corr(rx, ry), 6) END AS spearman, {below},
CAST(trunc(median(records)) AS INT) AS median_records, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(min(x), 6) AS min_x, round(min(y), 6) AS min_y FROM (SELECT *, {ranks} FROM {table} WHERE records >= 10)"""
