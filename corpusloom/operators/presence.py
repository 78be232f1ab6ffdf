"""Which site occurs in which record, and what follows from it.  Presence is kept sparse: one row for each (record, site)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.grammar import Grammar
from ..functions.sequences import revcomp
from ..session import cut
from .scan import MOST_WORDS, held_strings, held_words
from .sites import distinct_sites

BROADCAST_ROWS = 200_000


def sized_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint while it has at most `most` rows; beyond that Catalyst joins by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def presence(records: DataFrame, guides: DataFrame, grammar: Grammar) -> DataFrame:
    """Distinct (seq_id, guide_id).  records: seq_id, seq; guides: guide_id, target.

    The records' windows are looked up in the dictionary of both orientations of each target: one pass over the records,
    whatever the number of targets, with the dictionary on each executor.  One over `MOST_WORDS` targets, or of longer ones than
    a packed word holds, is joined instead.
    """
    book = guides.select("guide_id", "target").where("target IS NOT NULL").limit(MOST_WORDS + 1).collect() if grammar.length <= 31 else None
    if book is None or len(book) > MOST_WORDS:
        both = guides.select("guide_id", F.explode(F.array(F.col("target"), revcomp(F.col("target")))).alias("kmer")).distinct()
        found = distinct_sites(records.select("seq_id", "seq"), "seq", grammar)
        return found.join(both, "kmer").select("seq_id", "guide_id").distinct()
    if not book:
        return records.select("seq_id", F.lit("").alias("guide_id")).limit(0)
    return held_words(records, [r.guide_id for r in book], [r.target for r in book]).distinct()


def presence_by_search(records: DataFrame, guides: DataFrame) -> DataFrame:
    """The same by searching every record for every target as a string: the check of presence().  Over `MOST_WORDS` targets are joined by their text."""
    book = guides.select("guide_id", "target", revcomp(F.col("target")).alias("turned")).where("target IS NOT NULL")
    rows = book.limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        return records.select("seq_id", "seq").join(book, F.contains("seq", "target") | F.contains("seq", "turned")).select("seq_id", "guide_id")
    return held_strings(records, [r.guide_id for r in rows], [(r.target, r.turned) for r in rows])


def numbered(ids: DataFrame, key: str) -> DataFrame:
    """ids with `rank`, 0-based in the order of key: a range sort and an offset for each partition, no single task."""
    part = F.shiftright(F.monotonically_increasing_id(), 33)
    fixed = cut(ids.select(key).orderBy(key).select(key, part.alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row")))
    before, offsets = 0, []
    for r in sorted(fixed.groupBy("part").count().collect()):  # a row for each partition
        offsets.append((r.part, before))
        before += r["count"]
    if not offsets:
        return fixed.select(key, F.col("row").alias("rank"))
    table = ids.sparkSession.createDataFrame(offsets, "part long, before long")
    return fixed.join(F.broadcast(table), "part").select(key, (F.col("row") + F.col("before")).alias("rank"))


def first_absent(ids: DataFrame, guides: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """(guide_id, absent_in): the first `most` ids, in order, of records without the guide, joined by ;.

    Absent ranks are the gaps between a guide's present ranks, so no record is paired with a guide that it lacks.
    """
    order = numbered(ids, "seq_id")
    n = order.count()
    present = found.join(order, "seq_id").select("guide_id", "rank")
    ends = guides.select("guide_id", F.lit(n).cast("long").alias("rank"))
    w = W.partitionBy("guide_id").orderBy("rank")
    gaps = present.unionByName(ends).withColumn("low", F.coalesce(F.lag("rank").over(w), F.lit(-1)) + 1).withColumn("size", F.col("rank") - F.col("low")).where("size > 0")
    gaps = gaps.withColumn("before", F.coalesce(F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < most)
    need = F.least(F.col("size"), F.lit(most) - F.col("before"))
    ranks = gaps.select("guide_id", F.explode(F.sequence(F.col("low"), F.col("low") + need - 1)).alias("rank"))
    return ranks.join(order, "rank").groupBy("guide_id").agg(F.array_join(F.array_sort(F.collect_list("seq_id")), ";").alias("absent_in"))


def conservation(records: DataFrame, guides: DataFrame, found: DataFrame, record_absences: int = 25) -> DataFrame:
    """guide_id, target, n_present, n_total, conservation_fraction, absent_in."""
    total = records.count()
    counts = found.groupBy("guide_id").agg(F.count(F.lit(1)).alias("n_present"))
    absent = first_absent(records.select("seq_id"), guides, found, record_absences)
    n = F.coalesce("n_present", F.lit(0)).cast("long")
    out = guides.select("guide_id", "target").join(counts, "guide_id", "left").join(absent, "guide_id", "left")
    return out.select("guide_id", "target", n.alias("n_present"), F.lit(total).cast("long").alias("n_total"), F.round(n / F.lit(max(total, 1)), 6).alias("conservation_fraction"), F.coalesce("absent_in", F.lit("")).alias("absent_in"))


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df, whose evaluation fails on a row where condition does not hold."""
    return df.where(F.coalesce(F.assert_true(condition, message).cast("string"), F.lit("")) == "")


def paired(left: DataFrame, right: DataFrame, key: str, needed: bool = True) -> DataFrame:
    """left joined to right by key, one row to one: a key that either side repeats fails the plan, and so does a row of left without one of right
    (unless not `needed`: it then drops out).  The keys are counted by the aggregates that bring each side to one row, so the check costs no shuffle of its own."""
    def side(df: DataFrame, n: int) -> DataFrame:
        one = df.groupBy(key).agg(F.count(F.lit(1)).alias(f"_n{n}"), F.first(F.struct(*[c for c in df.columns if c != key])).alias(f"_x{n}"))
        return require(one, F.col(f"_n{n}") == 1, "a key is repeated on one side of a one-to-one join")

    told = side(left, 1).join(side(right, 2), key, "left" if needed else "inner")
    if needed:
        told = require(told, F.col("_n2").isNotNull(), "a row has no partner in a one-to-one join")
    return told.select(*[key if c == key else F.col(f"_x1.{c}") for c in left.columns], *[F.col(f"_x2.{c}") for c in right.columns if c != key])


def passes(gc_min: float, gc_max: float, max_run: int, min_conservation: float | None = None) -> Column:
    """The standard filters; the conservation term only where a limit is given."""
    ok = ~F.col("has_polyt") & (F.col("max_homopolymer_run") <= max_run) & F.col("gc_fraction").between(gc_min, gc_max)
    return ok if min_conservation is None else (F.col("conservation_fraction") >= min_conservation) & ok


def ranked_report(guides: DataFrame, scored: DataFrame, gc_min: float = 0.35, gc_max: float = 0.75, max_run: int = 4, min_conservation: float = 1.0) -> DataFrame:
    """guides joined to their scores one to one, flagged and ranked.  A guide without a score, or a repeated one, is an error."""
    joined = paired(guides, scored.drop("target"), "guide_id")
    flagged = joined.withColumn("gc_in_range", F.col("gc_fraction").between(gc_min, gc_max)).withColumn("passes_filters", passes(gc_min, gc_max, max_run, min_conservation))
    away = F.abs(F.col("gc_fraction") - (gc_min + gc_max) / 2)
    order = [F.desc("conservation_fraction"), F.desc("passes_filters"), F.asc("has_polyt"), F.asc("max_homopolymer_run"), away.asc(), F.asc("gene"), F.asc("ref_start"), F.asc("strand"), F.asc("guide_id")]
    return flagged.withColumn("rank", F.row_number().over(W.orderBy(*order)))  # the dictionary is small


def report_summary(report: DataFrame) -> DataFrame:
    """One row of cumulative counts, moments and flags."""
    c = F.col("conservation_fraction")
    at_least = [F.count_if(c >= t).alias(f"n_ge_{str(t).replace('.', '_')}") for t in (1.0, 0.99, 0.95, 0.9, 0.5)]
    return report.agg(
        F.count(F.lit(1)).alias("n_guides"), F.coalesce(F.max("n_total"), F.lit(0)).alias("n_total"), *at_least, F.count_if(c <= 0).alias("n_zero"),
        F.coalesce(F.round(F.avg(c), 6), F.lit(0.0)).alias("mean"), F.coalesce(F.round(F.median(c), 6), F.lit(0.0)).alias("median"), F.coalesce(F.round(F.min(c), 6), F.lit(0.0)).alias("least"),
        F.count_if("has_polyt").alias("n_polyt"), F.count_if(~F.col("gc_in_range")).alias("n_gc_out"), F.count_if("passes_filters").alias("n_passing"),
    )


def subset_sweep(records: DataFrame, found: DataFrame, n_guides: int, thresholds: Sequence[float | None]) -> DataFrame:
    """For each limit of ambiguous_fraction (None: no limit) the records kept and the guides present in all of them."""
    spark = records.sparkSession
    limits = spark.createDataFrame([(i, t, "none" if t is None else f"{t:g}") for i, t in enumerate(thresholds)], "i int, t double, max_ambiguous string")
    total = records.count()
    kept = records.select("seq_id", "ambiguous_fraction").join(F.broadcast(limits), F.col("t").isNull() | (F.col("ambiguous_fraction") <= F.col("t")))
    sizes = kept.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    hits = kept.join(found, "seq_id").groupBy("i", "guide_id").agg(F.count(F.lit(1)).alias("k"))
    perfect = hits.join(F.broadcast(sizes), "i").where("k = n").groupBy("i").agg(F.count(F.lit(1)).alias("p"))
    n, p = F.coalesce("n", F.lit(0)), F.coalesce("p", F.lit(0))
    out = limits.join(sizes, "i", "left").join(perfect, "i", "left")
    return out.select("max_ambiguous", n.cast("long").alias("n_records"), (F.lit(total) - n).cast("long").alias("n_dropped"), p.cast("long").alias("n_perfect"), F.round(100.0 * p / F.lit(max(n_guides, 1)), 3).alias("pct_perfect"))


def status_counts(records: DataFrame, guides: DataFrame, found: DataFrame) -> DataFrame:
    """Per guide the records by status: present; else not covered (a short record), ambiguous (an N in it) or absent.

    Statuses of records without the guide come from the class totals less the present ones, not from pairs.
    """
    classes = ["not_covered", "ambiguous", "resolved"]
    totals = records.groupBy("record_class").count().collect()  # three rows
    size = {c: 0 for c in classes} | {r.record_class: r["count"] for r in totals}
    total = sum(size.values())
    by = found.join(records.select("seq_id", "record_class"), "seq_id").groupBy("guide_id").agg(F.count(F.lit(1)).alias("p"), *[F.count_if(F.col("record_class") == c).alias(c) for c in classes])
    v = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = guides.select("guide_id").join(by, "guide_id", "left")
    absent = F.lit(size["resolved"]) - v("resolved")
    return out.select(
        "guide_id", F.lit(total).cast("long").alias("n_total"), v("p").cast("long").alias("n_present"), absent.cast("long").alias("n_absent"),
        (F.lit(size["ambiguous"]) - v("ambiguous")).cast("long").alias("n_ambiguous"), (F.lit(size["not_covered"]) - v("not_covered")).cast("long").alias("n_not_covered"),
        F.round(v("p") / F.lit(max(total, 1)), 6).alias("conservation_strict"), F.round(v("p") / F.nullif(v("p") + absent, F.lit(0)), 6).alias("conservation_tolerant"),
    )


def ranked_pool(pool: DataFrame, leads: dict[str, float], gc_min: float = 0.35, gc_max: float = 0.75) -> DataFrame:
    """rank_in_gene, n_better_in_gene and beats_lead (strictly above the gene's lead threshold; false where it has none)."""
    away = F.abs(F.col("gc_fraction") - (gc_min + gc_max) / 2)
    w = W.partitionBy("gene")
    order = w.orderBy(F.desc("conservation_fraction"), F.desc("passes_filters"), F.asc("has_polyt"), F.asc("max_homopolymer_run"), away.asc(), F.asc("ref_start"), F.asc("strand"), F.asc("guide_id"))
    lead = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(leads.items()) for x in kv]), F.col("gene")), F.lit(1.1)) if leads else F.lit(1.1)
    return (
        pool.withColumn("rank_in_gene", F.row_number().over(order))
        .withColumn("n_better_in_gene", F.rank().over(w.orderBy(F.desc("conservation_fraction"))) - 1)
        .withColumn("beats_lead", F.col("conservation_fraction") > lead)
    )


def filter_cascade(pool: DataFrame, threshold: float) -> DataFrame:
    """Per gene the sites left after each further constraint, in one pass; the copy row only where a gene has copies."""
    steps = [
        ("all sites", F.lit(True)),
        ("conserved", F.col("conservation_fraction") > threshold),
        ("no poly-T", ~F.col("has_polyt")),
        ("short runs", F.col("max_homopolymer_run") <= 4),
        ("gc in range", F.col("gc_fraction").between(0.35, 0.75)),
        ("in several copies", F.col("n_copies") >= 2),
    ]
    aggs, so_far = [], F.lit(True)
    for i, (_, c) in enumerate(steps):
        so_far = so_far & c
        aggs.append(F.count_if(so_far).alias(f"s{i}"))
    wide = pool.groupBy("gene").agg(F.max("n_copies").alias("most"), *aggs)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("constraint"), F.col(f"s{i}").alias("n_sites")) for i, (n, _) in enumerate(steps)]))
    return wide.select("gene", "most", each.alias("x")).where((F.col("x.step") < 5) | (F.col("most") >= 2)).select("gene", "x.*")


def pair_counts(found: DataFrame, left: DataFrame, right: DataFrame, n: int) -> DataFrame:
    """All pairs of a left and a right guide: records with both, one at least, none.

    Only records that hold both make rows; the rest follows from the marginals.
    """
    mine = found.groupBy("guide_id").agg(F.count(F.lit(1)).alias("k"))
    l = left.select(F.col("guide_id").alias("left_id"), F.col("conservation_fraction").alias("left_c")).join(mine.select(F.col("guide_id").alias("left_id"), F.col("k").alias("a")), "left_id", "left")
    r = right.select(F.col("guide_id").alias("right_id"), F.col("conservation_fraction").alias("right_c")).join(mine.select(F.col("guide_id").alias("right_id"), F.col("k").alias("b")), "right_id", "left")
    fl = found.join(F.broadcast(left.select("guide_id")), "guide_id").select("seq_id", F.col("guide_id").alias("left_id"))
    fr = found.join(F.broadcast(right.select("guide_id")), "guide_id").select("seq_id", F.col("guide_id").alias("right_id"))
    both = fl.join(fr, "seq_id").groupBy("left_id", "right_id").agg(F.count(F.lit(1)).alias("both"))
    pairs = l.crossJoin(F.broadcast(r)).join(both, ["left_id", "right_id"], "left").fillna(0, ["a", "b", "both"])
    pairs = require(pairs, (F.col("both") <= F.least("a", "b")) & (F.col("both") >= F.greatest(F.lit(0), F.col("a") + F.col("b") - n)), "a pair count outside its bounds")
    any_ = F.col("a") + F.col("b") - F.col("both")
    out = pairs.select("left_id", "right_id", "left_c", "right_c", F.col("a").alias("n_left"), F.col("b").alias("n_right"), F.col("both").alias("n_both"), (F.lit(n) - any_).alias("n_neither"), any_.alias("n_any"), F.round(F.col("both") / F.lit(max(n, 1)), 6).alias("joint"))
    weaker = F.coalesce(F.least("left_c", "right_c"), F.lit(-1.0))
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.desc("joint"), weaker.desc(), F.desc("left_c"), F.desc("right_c"), "left_id", "right_id")))
