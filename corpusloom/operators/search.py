"""Search for small sets of sites that a record is least likely to escape, for many models at once and on the cluster.

A model gives each site a q; a set's value is the mean over records of the product of q over its sites that are present.  Sets are rows: all
models, starts and swaps of a round are worked out in the same few joins over the sparse presence relation, and the driver sees whether
a round changed anything.  A site's gain to a set comes from its own records, corrected where they hold a member already:

    value(S + i) = value(S) - (1 - q_i) / n * (n_i + sum over records of both of (product of S - 1))

Values are compared after rounding to `DIGITS`; ties go to the site that comes first by name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .presence import sized_broadcast

DIGITS = 12
MARGIN = 5 * 10.0**-DIGITS  # a swap has to gain more than rounding can


class Ground:
    """What a search runs over: presence (seq_id, guide_id), n records, sites (guide_id, gene, middle) and q (model, guide_id, q)."""

    def __init__(self, found: DataFrame, n: int, sites: DataFrame, q: DataFrame, min_apart: float = 150, per_gene: int = 0):
        self.n, self.min_apart, self.per_gene = n, min_apart, per_gene
        allowed = sites.select("guide_id", "gene", F.col("middle").cast("double").alias("middle"))
        names = sized_broadcast(allowed.select("guide_id"))
        held = cut(found.select("seq_id", "guide_id").distinct().join(names, "guide_id", "left_semi"))
        own = held.groupBy("guide_id").agg(F.count(F.lit(1)).alias("held"))
        self.found = sized_broadcast(held)
        self.sites = sized_broadcast(cut(allowed.join(own, "guide_id", "left").withColumn("held", F.coalesce("held", F.lit(0)))))
        self.q = sized_broadcast(cut(q.select("model", "guide_id", "q").join(names, "guide_id", "left_semi")))

    def products(self, sets: DataFrame, keys: Sequence[str]) -> DataFrame:
        """(keys, model, seq_id, f, m): the product and number of members in each record that holds one; sets: keys, model, members."""
        each = sets.select(*keys, "model", F.explode("members.guide_id").alias("guide_id")).join(self.q, ["model", "guide_id"])
        by = each.join(self.found, "guide_id").groupBy(*keys, "model", "seq_id").agg(F.array_sort(F.collect_list(F.struct("guide_id", "q"))).alias("x"))
        return by.select(*keys, "model", "seq_id", F.aggregate("x", F.lit(1.0), lambda a, x: a * x["q"]).alias("f"), F.size("x").alias("m"))

    def valued(self, sets: DataFrame, keys: Sequence[str]) -> DataFrame:
        """sets with `value` (not rounded), and `joint`: the share of records that hold every member."""
        by = self.products(sets, keys).join(sets.select(*keys, "model", F.size("members").alias("_size")), [*keys, "model"]).groupBy(*keys, "model")
        total = by.agg(F.sum(F.col("f") - 1).alias("lost"), F.count_if(F.col("m") == F.col("_size")).alias("all"))
        out = sets.join(total, [*keys, "model"], "left")
        share = lambda c: F.coalesce(c, F.lit(0)) / max(self.n, 1)
        return out.withColumn("value", 1 + share("lost")).withColumn("joint", share("all")).drop("lost", "all")

    def fits(self) -> Column:
        """Whether a site (guide_id, gene, middle) may join members: not one of them, not too near to one of its gene, within its gene's number."""
        far = F.forall("members", lambda m: (m["guide_id"] != F.col("guide_id")) & ((m["gene"] != F.col("gene")) | (F.abs(m["middle"] - F.col("middle")) >= self.min_apart)))
        if not self.per_gene:
            return far
        return far & (F.size(F.filter("members", lambda m: m["gene"] == F.col("gene"))) < self.per_gene)

    def additions(self, sets: DataFrame, keys: Sequence[str]) -> DataFrame:
        """For each set the best site to add: keys, model, members, added (a member) and value; sets without one have no row.

        Every set looks at every site: sets are bounded by models, starts and places, whatever the number of sites or records.
        """
        on = [*keys, "model"]
        sets = sets.select(*on, "members")
        products = cut(self.products(sets, keys))
        lost = products.groupBy(*on).agg(F.sum(F.col("f") - 1).alias("lost"))
        meets = products.join(self.found, "seq_id").groupBy(*on, "guide_id").agg(F.sum(F.col("f") - 1).alias("shared"))
        each = self.sites.join(F.broadcast(sets), self.fits()).join(self.q, ["model", "guide_id"]).join(meets, [*on, "guide_id"], "left").join(F.broadcast(lost), on, "left")
        gain = (1 - F.col("q")) * (F.col("held") + F.coalesce("shared", F.lit(0.0))) - F.coalesce("lost", F.lit(0.0))
        value = F.round(1 - gain / max(self.n, 1), DIGITS)
        best = each.select(*on, "members", value.alias("v"), F.struct("guide_id", "gene", "middle").alias("site")).groupBy(*on).agg(F.first("members").alias("members"), F.min(F.struct("v", "site")).alias("b"))
        return best.select(*on, "members", F.col("b.site").alias("added"), F.col("b.v").alias("value"))

    def grown(self, sets: DataFrame, keys: Sequence[str]) -> DataFrame:
        told = self.additions(sets, keys)
        return cut(told.select(*keys, "model", F.array_sort(F.concat("members", F.array("added"))).alias("members"), "value"))

    def singles(self) -> DataFrame:
        """(model, members, value) of each site alone."""
        one = self.sites.join(self.q, "guide_id")
        return one.select("model", F.array(F.struct("guide_id", "gene", "middle")).alias("members"), F.round(1 - (1 - F.col("q")) * F.col("held") / max(self.n, 1), DIGITS).alias("value"))

    def first(self, sets: DataFrame, most: int = 1) -> DataFrame:
        """The best `most` sets of each model, by value and then by members, with their place from 0 as `start`."""
        w = W.partitionBy("model").orderBy("value", F.col("members.guide_id"))
        return sets.withColumn("start", F.row_number().over(w) - 1).where(F.col("start") < most)

    def pairs(self) -> DataFrame:
        """(model, members, value): the best pair over all sites, exactly.

        A pair is worth at most the two sites' own shares.  The best partner of the best single site gives a value to beat, and only
        pairs whose shares together could do so are counted in the records.
        """
        w = (1 - F.col("q")) * F.col("held") / max(self.n, 1)
        shares = cut(self.sites.join(self.q, "guide_id").select("model", "guide_id", "gene", "middle", "q", w.alias("w")))
        bound = self.grown(self.first(self.singles()).select("model", "members"), []).select("model", (1 - F.col("value") - 10.0**-DIGITS).alias("need"))
        most = shares.groupBy("model").agg(F.max("w").alias("most"))
        alive = cut(shares.join(F.broadcast(most), "model").join(F.broadcast(bound), "model", "left").where(F.col("need").isNull() | (F.col("w") + F.col("most") >= F.col("need"))))
        named = lambda s: alive.select("model", *[F.col(c).alias(c + s) for c in ("guide_id", "gene", "middle", "q", "w")], *(["need"] if s == "1" else []))
        far = (F.col("gene1") != F.col("gene2")) | (F.abs(F.col("middle1") - F.col("middle2")) >= self.min_apart)
        if self.per_gene == 1:
            far = F.col("gene1") != F.col("gene2")
        able = named("1").join(named("2"), "model").where((F.col("guide_id1") < F.col("guide_id2")) & far & (F.col("need").isNull() | (F.col("w1") + F.col("w2") >= F.col("need"))))
        able = cut(able)
        asked = able.select("guide_id1", "guide_id2").distinct()
        one, two = self.found.select(F.col("guide_id").alias("guide_id1"), "seq_id"), self.found.select(F.col("guide_id").alias("guide_id2"), "seq_id")
        both = asked.join(one, "guide_id1").join(two, ["guide_id2", "seq_id"]).groupBy("guide_id1", "guide_id2").agg(F.count(F.lit(1)).alias("both"))
        value = F.round(1 - F.col("w1") - F.col("w2") + (1 - F.col("q1")) * (1 - F.col("q2")) * F.coalesce("both", F.lit(0)) / max(self.n, 1), DIGITS)
        member = lambda s: F.struct(F.col("guide_id" + s).alias("guide_id"), F.col("gene" + s).alias("gene"), F.col("middle" + s).alias("middle"))
        sets = able.join(both, ["guide_id1", "guide_id2"], "left").select("model", F.array(member("1"), member("2")).alias("members"), value.alias("value"))
        return self.first(sets).drop("start")

    def improved(self, sets: DataFrame, keys: Sequence[str], k: int, rounds: int = 25) -> DataFrame:
        """sets (keys, model, members, value), each place in turn given to the best site while that lowers the value, up to `rounds` rounds."""
        on = [*keys, "model"]
        for _ in range(rounds):
            before = sets
            for place in range(k):
                rest = sets.select(*on, F.filter("members", lambda m, i: i != place).alias("members"))
                told = self.additions(rest, keys).select(*on, F.array_sort(F.concat("members", F.array("added"))).alias("other"), F.col("value").alias("new"))
                better = F.coalesce(F.col("new") < F.col("value") - MARGIN, F.lit(False))
                sets = cut(sets.join(F.broadcast(told), on, "left").select(*on, F.when(better, F.col("other")).otherwise(F.col("members")).alias("members"), F.when(better, F.col("new")).otherwise(F.col("value")).alias("value")))
            if sets.join(before.select(*on, F.col("value").alias("was")), on).where(F.col("value") < F.col("was") - MARGIN / 2).isEmpty():
                break
        return sets

    def best(self, k: int, starts: int = 30) -> DataFrame:
        """(model, members, value): exact for one site, and for two unless a gene's number is bounded; else the best of `starts` searches, each from one
        of the best single sites, grown greedily and then improved.  A model without a set of k has no row."""
        if k == 1:
            return self.first(self.singles()).drop("start")
        if k == 2 and not self.per_gene:
            return self.pairs()
        sets = self.seeds(starts)
        for _ in range(k - 1):
            sets = self.grown(sets, ["start"])
        return self.settled(sets, k)

    def seeds(self, starts: int) -> DataFrame:
        return cut(self.first(self.singles(), starts))

    def settled(self, sets: DataFrame, k: int) -> DataFrame:
        """(model, members, value): the best of the starts' sets, each improved."""
        return self.first(self.improved(sets, ["start"], k).drop("start")).drop("start")

    def curve(self, most: int, starts: int = 30) -> DataFrame:
        """(model, k, members, value, joint, independent): best(k) of each size up to `most`, each start's sets grown from the smaller ones;
        independent: the value if sites were present independently."""
        out, sets = None, None
        for k in range(1, most + 1):
            if k > 1:
                sets = self.grown(self.seeds(starts) if sets is None else sets, ["start"])
            one = self.best(k, starts) if k == 1 or k == 2 and not self.per_gene else self.settled(sets, k)
            one = one.select("model", "members", "value").withColumn("k", F.lit(k))
            out = one if out is None else out.unionByName(one)
        sets = cut(self.valued(cut(out).drop("value"), ["k"]).withColumn("value", F.round("value", DIGITS)))
        each = sets.select("model", "k", F.explode("members.guide_id").alias("guide_id")).join(self.q, ["model", "guide_id"]).join(self.sites.select("guide_id", "held"), "guide_id")
        f = each.withColumn("v", 1 - (1 - F.col("q")) * F.col("held") / max(self.n, 1)).groupBy("model", "k").agg(F.array_sort(F.collect_list(F.struct("guide_id", "v"))).alias("x"))
        return sets.join(f.select("model", "k", F.aggregate("x", F.lit(1.0), lambda a, x: a * x["v"]).alias("independent")), ["model", "k"])

    def exhaustive(self, k: int, pool: int = 60) -> DataFrame:
        """(model, members, value, n_sets): the best of all sets of k among the `pool` sites that are best alone, near ones left out.

        Sets are enumerated over the bounded pool; what they share is counted once, from the distinct patterns of presence.
        """
        lead = cut(self.first(self.singles(), pool).select("model", F.col("start").alias("i"), F.col("members")[0].alias("s")))
        sets = lead.select("model", F.array("s").alias("members"), F.col("i").alias("last"))
        for _ in range(k - 1):
            more = sets.join(lead, "model").where(F.col("i") > F.col("last"))
            near = F.exists("members", lambda m: (m["gene"] == F.col("s.gene")) & (F.abs(m["middle"] - F.col("s.middle")) < self.min_apart))
            sets = more.where(~near).select("model", F.array_sort(F.concat("members", F.array("s"))).alias("members"), F.col("i").alias("last"))
        sets = cut(sets.select("model", "members", F.xxhash64("model", "members").alias("set")))
        lost = self.products(sets, ["set"]).groupBy("model", "set").agg(F.sum(F.col("f") - 1).alias("lost"))
        told = sets.join(lost, ["model", "set"], "left").select("model", "members", F.round(1 + F.coalesce("lost", F.lit(0.0)) / max(self.n, 1), DIGITS).alias("value"))
        return self.first(told).drop("start").join(told.groupBy("model").agg(F.count(F.lit(1)).alias("n_sets")), "model")


def minimum_k(curve: DataFrame, limits: Sequence[float], value: str = "value") -> DataFrame:
    """(model, limit, k, reached): the least k whose value is under each limit, and that value; null where none is."""
    spark = curve.sparkSession
    asked = curve.select("model").distinct().crossJoin(F.broadcast(spark.createDataFrame([(float(x),) for x in limits], "limit double")))
    ok = curve.select("model", "k", F.col(value).alias("v"))
    hit = asked.join(ok, "model").where(F.col("v") < F.col("limit")).groupBy("model", "limit").agg(F.min(F.struct("k", "v")).alias("h"))
    return asked.join(hit, ["model", "limit"], "left").select("model", "limit", F.col("h.k").alias("k"), F.col("h.v").alias("reached"))


def drawn(found: DataFrame, n: int, members: Sequence[tuple[str, float]], records: DataFrame, draws: int, seed: int) -> DataFrame:
    """(estimate, error) of a set's value from seeded draws of a record and of the fate of each member present in it.

    records: seq_id and rank, 0 to n - 1; members: (guide_id, q).  Draws meet records by rank, so the plan is one join.
    """
    spark = found.sparkSession
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), k), F.lit(1 << 52)) / float(1 << 52)
    held = found.join(F.broadcast(spark.createDataFrame([(g, float(q), i + 1) for i, (g, q) in enumerate(members)], "guide_id string, q double, i int")), "guide_id")
    per = held.join(records, "seq_id").groupBy("rank").agg(F.collect_list(F.struct("i", "q")).alias("x"))
    tries = spark.range(draws).withColumn("rank", F.floor(u(F.lit(0)) * n)).join(sized_broadcast(per), "rank", "left")
    alive = F.coalesce(F.forall("x", lambda x: u(x["i"]) < x["q"]), F.lit(True)).cast("double")
    p = F.avg(alive)
    return tries.agg(p.alias("estimate"), F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) / draws).alias("error"))
