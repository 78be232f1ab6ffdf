"""Probabilistic product model over the presence relation.

A site i that is present in a record leaves a factor q_i, an absent one the factor 1; a set escapes a record with the
product of its factors, and P(escape) is the mean over records.  Only present pairs are rows: with f = 1 - (1 - q) x,
records without any site of a set contribute 1 without being listed.
"""

from __future__ import annotations

from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def geometric(spark: SparkSession, mean: float, low: int, high: int) -> DataFrame:
    """(length, p): a truncated geometric distribution over low..high, normalised; the mean is at least low + 0.5."""
    mean = max(mean, low + 0.5)
    r = 1 - 1 / (mean - low + 1)
    rows = spark.range(low, high + 1).select(F.col("id").cast("int").alias("length"), F.pow(F.lit(r), F.col("id") - low).alias("w"))
    return rows.select("length", (F.col("w") / F.sum("w").over(W.partitionBy())).alias("p"))


def parametric_spectrum(spark: SparkSession, p_wild: float = 0.2, p_insert: float = 0.3, mean_deletion: float = 8.0, longest: int = 30) -> DataFrame:
    """(length, p): no change, one-base insertions, and deletions (negative lengths) of geometric length."""
    gone = geometric(spark, mean_deletion, 1, longest).select((-F.col("length")).alias("length"), (F.col("p") * (1 - p_wild - p_insert)).alias("p"))
    return gone.unionByName(spark.createDataFrame([(0, p_wild), (1, p_insert)], "length int, p double"))


def normalised(rows: DataFrame, weight: str) -> DataFrame:
    """(length, p) of a histogram; zero rows go."""
    return rows.where(F.col(weight) > 0).select("length", (F.col(weight) / F.sum(weight).over(W.partitionBy())).alias("p"))


def conditional(spectrum: DataFrame) -> DataFrame:
    """The spectrum given that something changed."""
    return spectrum.where("length <> 0").select("length", (F.col("p") / F.sum("p").over(W.partitionBy())).alias("p"))


def in_frame() -> Column:
    return F.col("length") % 3 == 0


def spectrum_stats(spectrum: DataFrame) -> DataFrame:
    """One row: p_wild, share in frame among changes, mean deletion length."""
    change, gone = F.col("length") != 0, F.col("length") < 0
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col("p"))), F.lit(0.0))
    return spectrum.agg(
        F.round(s(F.col("length") == 0), 9).alias("p_wild"),
        F.round(s(change & in_frame()) / F.nullif(s(change), F.lit(0.0)), 9).alias("inframe_fraction"),
        F.round(F.sum(F.when(gone, -F.col("length") * F.col("p"))) / F.nullif(s(gone), F.lit(0.0)), 9).alias("mean_deletion"),
    )


def rescaled(spectrum: DataFrame, target: float) -> DataFrame:
    """The spectrum with the in-frame share of changes set to target, 0 < target < 1; no change keeps its mass."""
    if not 0 < target < 1:
        raise ValueError("the in-frame share must lie between 0 and 1")
    w = W.partitionBy()
    change = F.col("length") != 0
    total = F.sum(F.when(change, F.col("p")).otherwise(0.0)).over(w)
    mine = F.sum(F.when(change & in_frame(), F.col("p")).otherwise(0.0)).over(w)
    factor = F.when(~change, 1.0).when(in_frame(), target * total / mine).otherwise((1 - target) * total / (total - mine))
    return spectrum.select("length", (F.col("p") * factor).alias("p"))


def window_viability(tolerance: Column, codon: Column, width: Column) -> Column:
    """Mean, over the windows of `width` codons that hold the codon (0-based), of the product of their tolerances."""
    n, m = F.size(tolerance), F.greatest(width, F.lit(1))
    low, high = F.greatest(codon - m + 1, F.lit(0)), F.least(codon, n - m)
    edge = F.greatest(F.lit(0), F.least(codon, n - m))
    starts = F.when(low <= high, F.sequence(F.least(low, high), F.greatest(low, high))).otherwise(F.array(edge))
    product = lambda s: F.aggregate(F.slice(tolerance, s + 1, m), F.lit(1.0), lambda a, x: a * x)
    return F.when(n == 0, 0.0).otherwise(F.aggregate(F.transform(starts, product), F.lit(0.0), lambda a, x: a + x) / F.size(starts))


def tolerance(n_variant: Column, least: int, variable: float, invariant: float) -> Column:
    return F.when(n_variant >= least, variable).otherwise(invariant)


def site_escape(sites: DataFrame, spectrum: DataFrame, frameshift: float = 0.0, p_disrupt: float = 1.0, repeat_model: str = "redundant") -> DataFrame:
    """sites (guide_id, codon, tol, n_copies) with q_frameshift, q_inframe, q_single and q.

    Every site meets the few lengths of the spectrum, which is broadcast.
    """
    models = {"redundant": lambda q, c: 1 - F.pow(1 - q, c), "single": lambda q, c: q, "all-copies": lambda q, c: F.pow(q, c)}
    if repeat_model not in models:
        raise ValueError(f"no repeat model {repeat_model!r}")
    each = sites.crossJoin(F.broadcast(conditional(spectrum)))
    viable = window_viability(F.col("tol"), F.col("codon"), F.floor(F.abs("length") / 3).cast("int"))
    shift = F.sum(F.when(~in_frame(), F.col("p") * frameshift).otherwise(0.0))
    keep = F.sum(F.when(in_frame(), F.col("p") * viable).otherwise(0.0))
    out = each.groupBy("guide_id", "n_copies").agg(shift.alias("q_frameshift"), keep.alias("q_inframe"))
    single = F.least(F.lit(1.0), F.greatest(F.lit(0.0), p_disrupt * (F.col("q_frameshift") + F.col("q_inframe"))))
    out = out.withColumn("q_single", single)
    return out.withColumn("q", F.when(F.col("n_copies") <= 1, F.col("q_single")).otherwise(F.least(F.lit(1.0), models[repeat_model](F.col("q_single"), F.col("n_copies")))))


def set_escape(found: DataFrame, sets: DataFrame, q: DataFrame, n: int) -> DataFrame:
    """Per set (set_id, guide_id rows): k, joint (records with all sites), p_escape, p_independent.

    Products are taken in the order of guide_id, one factor after another, so no logarithm loses digits or meets q = 0.
    """
    members = sets.join(q.select("guide_id", "q"), "guide_id")
    size = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("k"))
    per = found.join(F.broadcast(members), "guide_id").groupBy("set_id", "seq_id").agg(F.count(F.lit(1)).alias("m"), F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("guide_id", "q"))), lambda x: x["q"]), F.lit(1.0), lambda a, x: a * x).alias("f"))
    total = per.join(F.broadcast(size), "set_id").groupBy("set_id").agg(F.sum("f").alias("f"), F.count(F.lit(1)).alias("c"), F.count_if(F.col("m") == F.col("k")).alias("all"))
    share = found.groupBy("guide_id").agg(F.count(F.lit(1)).alias("x"))
    alone = members.join(share, "guide_id", "left").withColumn("v", 1 - (1 - F.col("q")) * F.coalesce("x", F.lit(0)) / F.lit(max(n, 1)))
    alone = alone.groupBy("set_id").agg(F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("guide_id", "v"))), lambda x: x["v"]), F.lit(1.0), lambda a, x: a * x).alias("p_independent"))
    out = size.join(total, "set_id", "left").join(alone, "set_id")
    p = (F.coalesce("f", F.lit(0.0)) + F.lit(n) - F.coalesce("c", F.lit(0))) / F.lit(max(n, 1))
    return out.select("set_id", "k", F.round(F.coalesce("all", F.lit(0)) / F.lit(max(n, 1)), 6).alias("joint"), F.round(p, 9).alias("p_escape"), F.round("p_independent", 9).alias("p_independent"))


def pair_escape(found: DataFrame, q: DataFrame, n: int) -> DataFrame:
    """(a, b, n_both, p_escape) for the pairs a < b of sites that share a record; for all others p_escape follows from the two alone."""
    one = found.groupBy("guide_id").agg(F.count(F.lit(1)).alias("held")).join(q.select("guide_id", "q"), "guide_id").withColumn("u", 1 - F.col("q"))
    both = found.select("seq_id", F.col("guide_id").alias("a")).join(found.select("seq_id", F.col("guide_id").alias("b")), "seq_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    side = lambda s: one.select(F.col("guide_id").alias(s), F.col("held").alias("n" + s), F.col("u").alias("u" + s))
    p = 1 - (F.col("ua") * F.col("na") + F.col("ub") * F.col("nb") - F.col("ua") * F.col("ub") * F.col("n_both")) / F.lit(max(n, 1))
    return both.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_both", F.round(p, 9).alias("p_escape"))


def binomial_upper(x: int, n: int, alpha: float = 0.05) -> float:
    """The one-sided Clopper-Pearson upper limit, by bisection on the exact distribution function."""
    if n <= 0 or x >= n:
        return 1.0
    if x == 0:
        return 1 - alpha ** (1 / n)
    ways = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) for i in range(x + 1)]
    low, high = x / n, 1.0
    for _ in range(80):
        p = (low + high) / 2
        below = sum(exp(w + i * log(p) + (n - i) * log(1 - p)) for i, w in enumerate(ways)) if 0 < p < 1 else float(p <= 0)
        low, high = (p, high) if below > alpha else (low, p)
    return (low + high) / 2


def upper_bounds(spark: SparkSession, rows: DataFrame, x: str, n: str, alpha: float = 0.05) -> DataFrame:
    """rows with `upper`, worked out once for each distinct (x, n)."""
    pairs = rows.select(F.col(x).cast("long"), F.col(n).cast("long")).distinct()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            u = [binomial_upper(i, j, alpha) for i, j in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(u, pa.float64())], names=[x, n, "upper"])

    return rows.join(pairs.mapInArrow(run, f"{x} long, {n} long, upper double"), [x, n])
