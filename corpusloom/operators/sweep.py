"""The product model under many settings at once: spectra, settings and their sites' escapes as rows.

A codon is variable or not, so the product over a window of codons depends on how many of them are variable: windows are counted
once for each site, width and limit of variability, and every setting then is arithmetic on these counts.  Ranks, correlations and
shortlists are taken inside each setting by windows over it; no plan grows with the number of settings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The default spectrum (mass without a change, share of insertions, share of these that are of one base, mean and longest of the
# longer ones, mean and longest deletion), what the named spectra change in it, and the settings of the sweep.
DEFAULT = {"p_wild": 0.40, "p_insertion": 0.35, "one_base": 0.80, "insertion_mean": 3.0, "insertion_max": 20, "deletion_mean": 6.0, "deletion_max": 60}
NAMED = {
    "default": {},
    "deletion-heavy": {"p_insertion": 0.15, "deletion_mean": 12.0},
    "insertion-heavy": {"p_insertion": 0.65, "one_base": 0.90},
    "short-indels": {"deletion_mean": 2.5, "insertion_max": 6, "deletion_max": 20},
}
BASE = {"spectrum": "default", "variable": 0.50, "invariant": 0.05, "least": 1, "repeat_model": "redundant", "shift_gene": "", "shift": 0.0, "p_disrupt": 1.0}
VARIABLE, INVARIANT, LEAST = (0.10, 0.25, 0.50, 0.75, 1.00), (0.001, 0.01, 0.05, 0.15, 0.30, 0.50), (1, 2, 3, 5)
SPECTRA, IN_FRAME = ("default", "deletion-heavy", "insertion-heavy", "short-indels", "uniform-1to20", "measured"), (0.10, 0.20, 0.25, 0.33, 0.50)
REPEATS, SHIFTS, DISRUPTS = ("redundant", "single", "all-copies"), (0.0, 0.05, 0.25, 1.0), (0.8, 0.9, 1.0)
SETTING = "setting int, group string, label string, spectrum string, variable double, invariant double, least int, repeat_model string, shift_gene string, shift double, p_disrupt double"
DIGITS = 12  # values are compared and ranked after rounding: equal ones stay equal however they were summed


def one_at_a_time(shift_gene: str) -> list[tuple]:
    """The rows of SETTING: the baseline, then each parameter over its values, 37 in all."""
    made = [("baseline", "baseline", {})]
    made += [("variable", f"variable={v:g}", {"variable": v}) for v in VARIABLE] + [("invariant", f"invariant={v:g}", {"invariant": v}) for v in INVARIANT]
    made += [("least", f"least={v}", {"least": v}) for v in LEAST] + [("spectrum", f"spectrum={s}", {"spectrum": s}) for s in SPECTRA]
    made += [("inframe", f"inframe={v:g}", {"spectrum": f"default@{v:g}"}) for v in IN_FRAME] + [("repeat_model", f"repeat_model={m}", {"repeat_model": m}) for m in REPEATS]
    made += [("shift", f"shift={v:g}", {"shift_gene": shift_gene, "shift": v}) for v in SHIFTS] + [("p_disrupt", f"p_disrupt={v:g}", {"p_disrupt": v}) for v in DISRUPTS]
    return [(i, g, label, *(BASE | change).values()) for i, (g, label, change) in enumerate(made)]


def _geometric(n: Column, mean: Column, low: int, high: Column) -> Column:
    """The mass of n under a geometric distribution cut to low..high; a mean at or under low counts as low + 0.5."""
    r = 1 - 1 / (F.when(mean <= low, F.lit(low + 0.5)).otherwise(mean) - low + 1)
    return F.pow(r, n - low) * (1 - r) / (1 - F.pow(r, high - low + 1))


def spectra(spark: SparkSession, measured: DataFrame, targets: Sequence[float] = IN_FRAME) -> DataFrame:
    """(spectrum, length, p) given a change, for the named spectra, the even one, the default rescaled to each share in frame, and `measured`
    (length, weight): a histogram of lengths, of which 0 is no change."""
    params = spark.createDataFrame([(n, *map(float, (DEFAULT | c).values())) for n, c in NAMED.items()], "spectrum string, " + ", ".join(f"{c} double" for c in DEFAULT))
    each = params.withColumn("length", F.explode(F.sequence(-F.col("deletion_max").cast("int"), F.col("insertion_max").cast("int")))).where("length <> 0")
    n, inserted = F.col("length"), (1 - F.col("p_wild")) * F.col("p_insertion")
    p = F.when(n < 0, (1 - F.col("p_wild")) * (1 - F.col("p_insertion")) * _geometric(-n, F.col("deletion_mean"), 1, F.col("deletion_max")))
    p = p.when(n == 1, inserted * F.col("one_base")).otherwise(inserted * (1 - F.col("one_base")) * _geometric(n, F.col("insertion_mean"), 2, F.col("insertion_max")))
    even = spark.range(-20, 21).where("id <> 0").select(F.lit("uniform-1to20").alias("spectrum"), F.col("id").cast("int").alias("length"), F.lit(0.6 / 40).alias("p"))
    seen = measured.where("length <> 0 AND weight > 0").select(F.lit("measured").alias("spectrum"), F.col("length").cast("int").alias("length"), F.col("weight").cast("double").alias("p"))
    own = W.partitionBy("spectrum")
    raw = each.select("spectrum", "length", p.alias("p")).unionByName(even).unionByName(seen).withColumn("p", F.col("p") / F.sum("p").over(own))
    frame = F.col("length") % 3 == 0
    share = F.sum(F.when(frame, F.col("p")).otherwise(0.0)).over(own)
    goal = spark.createDataFrame([(f"default@{t:g}", float(t)) for t in targets], "name string, goal double")
    base = raw.where("spectrum = 'default'").withColumn("share", share)
    scaled = base.crossJoin(F.broadcast(goal)).select(F.col("name").alias("spectrum"), "length", F.when(frame, F.col("p") * F.col("goal") / F.col("share")).otherwise(F.col("p") * (1 - F.col("goal")) / (1 - F.col("share"))).alias("p"))
    return raw.unionByName(scaled)


def window_counts(sites: DataFrame, leasts: DataFrame, widths: DataFrame) -> DataFrame:
    """(guide_id, least, m, c, share): of the windows of m codons that hold a site's codon, the share with c variable ones.

    sites: guide_id, codon, variants (records that differ, for each codon of the gene); a codon is variable from `least` on.  Where no window fits, the
    one nearest to the codon counts.
    """
    n, codon, m = F.size("variants"), F.col("codon"), F.col("m")
    edge = F.greatest(F.lit(0), F.least(codon, n - m))
    low, high = F.greatest(codon - m + 1, F.lit(0)), F.least(codon, n - m)
    each = sites.select("guide_id", "codon", "variants").crossJoin(F.broadcast(leasts)).crossJoin(F.broadcast(widths))
    starts = F.when(low <= high, F.sequence(F.least(low, high), F.greatest(low, high))).otherwise(F.array(edge))
    told = each.select("guide_id", "least", "m", F.transform(starts, lambda s: F.size(F.filter(F.slice("variants", s + 1, m), lambda v: v >= F.col("least")))).alias("counts"))
    rows = told.select("guide_id", "least", "m", F.size("counts").alias("n"), F.explode("counts").alias("c"))
    return rows.groupBy("guide_id", "least", "m", "c").agg((F.count(F.lit(1)) / F.first("n")).alias("share"))


def settings_escape(sites: DataFrame, settings: DataFrame, lengths: DataFrame) -> DataFrame:
    """(setting, guide_id, gene, q_frameshift, q_inframe, q_single, q), q rounded to `DIGITS`; sites: guide_id, gene, codon, n_copies, variants."""
    frame = F.col("length") % 3 == 0
    width = F.greatest(F.lit(1), F.floor(F.abs("length") / 3).cast("int"))
    masses = lengths.where(frame).groupBy("spectrum", width.alias("m")).agg(F.sum("p").alias("p"))
    shifts = lengths.groupBy("spectrum").agg(F.sum(F.when(~frame, F.col("p")).otherwise(0.0)).alias("shifted"))
    counts = window_counts(sites, settings.select("least").distinct(), masses.select("m").distinct())
    told = counts.join(F.broadcast(settings.select("setting", "least", "spectrum", "variable", "invariant").join(masses, "spectrum")), ["least", "m"])
    kept = told.groupBy("setting", "guide_id").agg(F.sum(F.col("p") * F.col("share") * F.pow("variable", "c") * F.pow("invariant", F.col("m") - F.col("c"))).alias("q_inframe"))
    out = kept.join(F.broadcast(settings.join(shifts, "spectrum")), "setting").join(sites.select("guide_id", "gene", "n_copies"), "guide_id")
    lost = F.when(F.col("gene") == F.col("shift_gene"), F.col("shifted") * F.col("shift")).otherwise(0.0)
    single = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("p_disrupt") * (lost + F.col("q_inframe"))))
    out = out.withColumn("q_frameshift", lost).withColumn("q_single", single)
    many = F.when(F.col("repeat_model") == "redundant", 1 - F.pow(1 - F.col("q_single"), F.col("n_copies"))).when(F.col("repeat_model") == "all-copies", F.pow("q_single", "n_copies")).otherwise(F.col("q_single"))
    q = F.when(F.col("n_copies") <= 1, F.col("q_single")).otherwise(F.least(F.lit(1.0), many))
    return out.select("setting", "guide_id", "gene", "q_frameshift", "q_inframe", "q_single", F.round(q, DIGITS).alias("q"))


def ranked(q: DataFrame) -> DataFrame:
    """q (setting, guide_id, q) with `rank`, the mean place among equals, and `place`, by value and then by guide."""
    by, ties = W.partitionBy("setting").orderBy("q"), W.partitionBy("setting", "q")
    return q.withColumn("rank", F.rank().over(by) + (F.count(F.lit(1)).over(ties) - 1) / 2).withColumn("place", F.row_number().over(W.partitionBy("setting").orderBy("q", "guide_id")))


def compared(q: DataFrame, top: int = 20, baseline: int = 0) -> DataFrame:
    """Per setting: n_sites, q_min, q_median, q_max, the rank correlation with the baseline setting (null if either is constant), and the share of the
    baseline's first `top` sites that are among the first `top`."""
    each = ranked(q.select("setting", "guide_id", "q"))
    base = each.where(F.col("setting") == baseline).select("guide_id", F.col("rank").alias("base_rank"), F.col("place").alias("base_place"))
    both = each.join(base, "guide_id")
    rho = F.covar_pop("rank", "base_rank") / F.nullif(F.stddev_pop("rank") * F.stddev_pop("base_rank"), F.lit(0.0))
    kept = F.count_if((F.col("place") <= top) & (F.col("base_place") <= top)) / top
    return both.groupBy("setting").agg(F.count(F.lit(1)).alias("n_sites"), F.min("q").alias("q_min"), F.median("q").alias("q_median"), F.max("q").alias("q_max"), rho.alias("spearman"), kept.alias("top_overlap"))


def gene_variants(sizes: DataFrame, counts: DataFrame) -> DataFrame:
    """(gene, variants): for each codon of a gene (sizes: gene, n_codons) the records whose amino acid differs; counts: gene, codon, n_aa_variant."""
    every = sizes.where("n_codons > 0").select("gene", F.explode(F.sequence(F.lit(0), (F.col("n_codons") - 1).cast("int"))).alias("codon"))
    told = every.join(counts.select("gene", "codon", "n_aa_variant"), ["gene", "codon"], "left")
    by = told.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("codon", F.coalesce("n_aa_variant", F.lit(0)).cast("int").alias("v")))).alias("x"))
    return by.select("gene", F.transform("x", lambda x: x["v"]).alias("variants"))


def site_table(sites: DataFrame, codons: DataFrame, variants: DataFrame, lengths: DataFrame, setting: tuple, essential: Sequence[str] = (), reach: int = 5) -> DataFrame:
    """sites with the codon of their cut, what varies around it and what escapes a cut there.

    sites: guide_id, gene, n_copies and anything; codons: guide_id, codon; variants: gene, variants; lengths: spectra() rows; setting: a row of SETTING.
    Added are essential, cut_codon, codon_varies, local_variable_codons and local_tolerance over `reach` codons to either side (cut at the gene's
    ends), q_single_copy, q_site, q_from_frameshift and q_from_inframe.  A site of a gene without a profile is an error.
    """
    from .presence import require

    spark = sites.sparkSession
    told = require(sites.join(codons, "guide_id").join(variants, "gene", "left"), F.col("variants").isNotNull(), "a gene has no profile of its codons")
    row = spark.createDataFrame([setting], SETTING)
    q = settings_escape(told.select("guide_id", "gene", "codon", "n_copies", "variants"), row, lengths).drop("gene", "setting")
    least, variable, invariant = (F.lit(dict(zip(("setting", "group", "label", *BASE), setting, strict=True))[c]) for c in ("least", "variable", "invariant"))
    low = F.greatest(F.lit(0), F.col("codon") - reach)
    around = F.slice("variants", low + 1, F.greatest(F.lit(0), F.least(F.size("variants"), F.col("codon") + reach + 1) - low))
    held = F.size(F.filter(around, lambda v: v >= least))
    out = told.join(q, "guide_id").withColumn("essential", F.col("gene").isin(list(essential)))
    return out.select(
        *sites.columns, "essential", F.col("codon").alias("cut_codon"), F.coalesce(F.get("variants", F.col("codon")) >= least, F.lit(False)).alias("codon_varies"), held.alias("local_variable_codons"),
        F.when(F.size(around) > 0, (held * variable + (F.size(around) - held) * invariant) / F.size(around)).alias("local_tolerance"), F.col("q_single").alias("q_single_copy"), F.col("q").alias("q_site"), F.col("q_frameshift").alias("q_from_frameshift"), F.col("q_inframe").alias("q_from_inframe"),
    )
