"""Sets of sites under the product model: settings, searches, thresholds and alternatives.

Records are all documents and the damaged copies of chain_queries, so that many records hold several sites; every site of the segments is allowed.
A codon's variants follow from its number, so that SQL can hold the sweep.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import model as M
from ..operators import presence as P
from ..operators import search as Z
from ..operators import sweep as Y
from ..session import cut
from . import chain_queries
from . import prelude as p

QUERIES: dict = {}
SQL: dict[str, str] = {}
CODONS, PERIOD, SHIFTED = 60, 6, "g0"
LIMITS, POPULATIONS = (0.99, 0.9, 0.85, 1e-3, 1e-6), (1e5,)
LARGEST = 4


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- the same in SQL -----------------------------------------------------------------------------------------------------

GROUND = f"""kinds AS (SELECT segment, unnest([
    {{'k': 'turned', 's': {p.rc_sql("seq")}}}, {{'k': 'gap', 's': substring(seq, 1, 60) || repeat('N', 40) || substring(seq, 101)}}, {{'k': 'wide', 's': substring(seq, 1, 60) || repeat('ACGGT', 460) || substring(seq, 101)}},
    {{'k': 'cut', 's': substring(seq, 1, length(seq) // 2)}}, {{'k': 'changed', 's': substring(seq, 1, 80) || translate(substring(seq, 81, 1), 'ACGTN', 'CGTAA') || substring(seq, 82)}},
    {{'k': 'torn', 's': substring(seq, 1, 60) || repeat('N', 700) || substring(seq, 91)}}]) AS x FROM segments WHERE length(seq) >= {chain_queries.LEAST_COPY}),
ground AS (SELECT 'd' || seq_id AS seq_id, seq FROM records UNION ALL SELECT 'b' || segment || '-' || x.k, x.s FROM kinds),
held AS (SELECT seq_id, guide_id FROM ground, guides WHERE contains(seq, target) OR contains(seq, {p.rc_sql("target")})),
n AS (SELECT count(*) AS n FROM ground)"""
_SPECTRA = f"""measured AS (SELECT l_linenumber - 4 AS length, count(*) AS weight FROM lineitem GROUP BY ALL),
params(spectrum, p_wild, p_insertion, one_base, insertion_mean, insertion_max, deletion_mean, deletion_max) AS (VALUES {", ".join("(" + ", ".join([repr(n), *map(repr, (Y.DEFAULT | c).values())]) + ")" for n, c in Y.NAMED.items())}),
lengths AS (SELECT *, unnest(range(-deletion_max::INT, insertion_max::INT + 1)) AS length FROM params),
rates AS (SELECT *, 1 - 1 / (CASE WHEN deletion_mean <= 1 THEN 1.5 ELSE deletion_mean END) AS rd, 1 - 1 / (CASE WHEN insertion_mean <= 2 THEN 2.5 ELSE insertion_mean END - 1) AS ri FROM lengths WHERE length <> 0),
raw AS (SELECT spectrum, length, CASE WHEN length < 0 THEN (1 - p_wild) * (1 - p_insertion) * pow(rd, -length - 1) * (1 - rd) / (1 - pow(rd, deletion_max)) WHEN length = 1 THEN (1 - p_wild) * p_insertion * one_base
  ELSE (1 - p_wild) * p_insertion * (1 - one_base) * pow(ri, length - 2) * (1 - ri) / (1 - pow(ri, insertion_max - 1)) END AS p FROM rates
  UNION ALL SELECT 'uniform-1to20', i, 0.015 FROM range(-20, 21) r(i) WHERE i <> 0 UNION ALL SELECT 'measured', length, weight FROM measured WHERE length <> 0),
normed AS (SELECT spectrum, length, p / sum(p) OVER (PARTITION BY spectrum) AS p FROM raw),
base AS (SELECT length, p, sum(p) FILTER (length % 3 = 0) OVER () AS share FROM normed WHERE spectrum = 'default'),
spectra AS (SELECT * FROM normed UNION ALL SELECT printf('default@%g', goal), length, CASE WHEN length % 3 = 0 THEN p * goal / share ELSE p * (1 - goal) / (1 - share) END FROM base, (SELECT unnest([{", ".join(map(str, Y.IN_FRAME))}]::DOUBLE[]) AS goal))"""
_SWEEP = f"""settings(setting, grp, label, spectrum, variable, invariant, least, repeat_model, shift_gene, shift, p_disrupt) AS (VALUES {", ".join(repr(x) for x in Y.one_at_a_time(SHIFTED))}),
{_SPECTRA},
msites AS (SELECT guide_id, split_part(gene, '|', 1) AS gene, (ref_start % {CODONS})::INT AS codon, n_copies FROM guides),
masses AS (SELECT spectrum, greatest(1, abs(length) // 3) AS m, sum(p) AS p FROM spectra WHERE length % 3 = 0 GROUP BY ALL),
shifts AS (SELECT spectrum, sum(CASE WHEN length % 3 <> 0 THEN p ELSE 0 END) AS shifted FROM spectra GROUP BY ALL),
wide AS (SELECT guide_id, m, CASE WHEN greatest(codon - m + 1, 0) <= least(codon, {CODONS} - m) THEN range(greatest(codon - m + 1, 0), least(codon, {CODONS} - m) + 1) ELSE [greatest(0, least(codon, {CODONS} - m))] END AS starts FROM msites, (SELECT DISTINCT m FROM masses)),
counts AS (SELECT guide_id, least, m, len(starts) AS ns, unnest([len([i FOR i IN range(s, least(s + m, {CODONS})) IF (i * 7) % {PERIOD} >= l.least]) FOR s IN starts]) AS c FROM wide, (SELECT DISTINCT least FROM settings) l),
kept AS (SELECT setting, guide_id, sum(p / ns * pow(variable, c) * pow(invariant, m - c)) AS q_inframe FROM counts JOIN settings USING (least) JOIN masses USING (spectrum, m) GROUP BY ALL),
one AS (SELECT setting, guide_id, gene, n_copies, repeat_model, CASE WHEN gene = shift_gene THEN shifted * shift ELSE 0 END AS q_frameshift, q_inframe, least(1.0, greatest(0.0, p_disrupt * (CASE WHEN gene = shift_gene THEN shifted * shift ELSE 0 END + q_inframe))) AS q_single
  FROM kept JOIN settings USING (setting) JOIN shifts USING (spectrum) JOIN msites USING (guide_id)),
sq AS (SELECT setting, guide_id, q_single, round(CASE WHEN n_copies <= 1 OR repeat_model = 'single' THEN q_single WHEN repeat_model = 'redundant' THEN least(1.0, 1 - pow(1 - q_single, n_copies)) ELSE least(1.0, pow(q_single, n_copies)) END, {Y.DIGITS}) AS q FROM one),
placed AS (SELECT *, rank() OVER (PARTITION BY setting ORDER BY q) + (count(*) OVER (PARTITION BY setting, q) - 1) / 2 AS rank, row_number() OVER (PARTITION BY setting ORDER BY q, guide_id) AS place FROM sq),
told AS (SELECT x.setting, count(*) AS n_sites, min(x.q) AS q_min, median(x.q) AS q_median, max(x.q) AS q_max, CASE WHEN min(x.q) < max(x.q) AND min(b.rank) < max(b.rank) THEN corr(x.rank, b.rank) END AS spearman, count_if(x.place <= 20 AND b.place <= 20) / 20 AS top_overlap
  FROM placed x JOIN placed b ON b.setting = 0 AND b.guide_id = x.guide_id GROUP BY x.setting)"""
_PAIRS = f"""q AS (SELECT guide_id, q FROM sq WHERE setting = 0), f AS (SELECT g.guide_id, split_part(g.gene, '|', 1) AS gene, (ref_start + ref_end) / 2 + segment * 1000 AS middle, r.seq_id, CASE WHEN h.seq_id IS NULL THEN 1.0 ELSE q.q END AS f
  FROM guides g JOIN q USING (guide_id) CROSS JOIN (SELECT seq_id FROM ground) r LEFT JOIN held h ON h.guide_id = g.guide_id AND h.seq_id = r.seq_id)"""


# --- queries -----------------------------------------------------------------------------------------------------------


def _sites(spark, sf_dir):
    """guide_id, gene, codon, n_copies, variants and middle of all sites; segments lie 1000 bases apart."""
    variants = F.array(*[F.lit(i * 7 % PERIOD) for i in range(CODONS)])
    return p.guides(spark, sf_dir).select(
        "guide_id", F.split("gene", r"\|")[0].alias("gene"), (F.col("ref_start") % CODONS).cast("int").alias("codon"), "n_copies", variants.alias("variants"), ((F.col("ref_start") + F.col("ref_end")) / 2 + F.col("segment") * 1000).alias("middle"), "target",
    )


def _lengths(spark, sf_dir):
    h = p.table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") - 4).alias("length")).agg(F.count(F.lit(1)).alias("weight"))
    return Y.spectra(spark, h)


def _settings(spark):
    return spark.createDataFrame(Y.one_at_a_time(SHIFTED), Y.SETTING)


def _q(spark, sf_dir, sites, baseline: bool = False):
    s = _settings(spark)
    return Y.settings_escape(sites, s.where("setting = 0") if baseline else s, _lengths(spark, sf_dir))


def _ground(spark, sf_dir, baseline: bool = True, **options):
    """The search over every site and record, under the baseline or all settings."""
    sites = cut(_sites(spark, sf_dir))
    records = chain_queries.Ground(spark, sf_dir).records
    q = cut(_q(spark, sf_dir, sites, baseline)).select(F.col("setting").alias("model"), "guide_id", "q")
    return Z.Ground(P.presence(records, sites, p.CAS), records.count(), sites, q, **options)


@query(f"WITH {p.SEGMENTS}, {_SPECTRA} SELECT spectrum, CAST(length AS INT) AS length, round(p, 12) AS p FROM spectra")
def indel_spectra(spark, sf_dir):
    """All spectra of the sweep given a change, one of them measured (here line numbers of the order lines)."""
    return _lengths(spark, sf_dir).select("spectrum", "length", F.round("p", 12).alias("p"))


@query(f"WITH {p.guides_sql()}, {_SWEEP} SELECT setting, guide_id, round(q_single, 9) AS q_single, round(q, 9) AS q FROM sq")
def settings_escape(spark, sf_dir):
    """Each site's escape under each of the 37 settings."""
    return _q(spark, sf_dir, _sites(spark, sf_dir)).select("setting", "guide_id", F.round("q_single", 9).alias("q_single"), F.round("q", 9).alias("q"))


_ROUNDED = ", ".join(f"round({c}, 9) AS {c}" for c in ("q_min", "q_median", "q_max", "spearman", "top_overlap"))


@query(f"""WITH {p.guides_sql()}, {_SWEEP} SELECT setting, grp AS "group", label, n_sites, {_ROUNDED} FROM told JOIN settings USING (setting)""")
def sensitivity_settings(spark, sf_dir):
    """One row for each setting: the range of q, its rank correlation with the baseline, and what is left of the first twenty sites."""
    told = Y.compared(_q(spark, sf_dir, cut(_sites(spark, sf_dir))))
    return told.join(F.broadcast(_settings(spark)), "setting").select("setting", "group", "label", "n_sites", *[F.round(c, 9).alias(c) for c in ("q_min", "q_median", "q_max", "spearman", "top_overlap")])


@query(f"""WITH {p.guides_sql()}, {_SWEEP} SELECT grp AS "group", count(*) AS n_settings, round(min(q_max), 9) AS least_q_max, round(max(q_max), 9) AS most_q_max, round(log10(greatest(max(q_max), 1e-300) / greatest(min(q_max), 1e-300)), 6) AS orders,
round(min(spearman), 9) AS least_spearman, round(min(top_overlap), 9) AS least_overlap, coalesce(bool_and(top_overlap = 1), false) AS all_match FROM told JOIN settings USING (setting) GROUP BY grp""")
def sensitivity_groups(spark, sf_dir):
    """Groups of settings: their number, the span of the worst site's q, the least correlation and overlap, and whether no shortlist changes."""
    told = Y.compared(_q(spark, sf_dir, cut(_sites(spark, sf_dir)))).join(F.broadcast(_settings(spark)), "setting")
    least, most = F.greatest(F.min("q_max"), F.lit(1e-300)), F.greatest(F.max("q_max"), F.lit(1e-300))
    return told.groupBy("group").agg(
        F.count(F.lit(1)).alias("n_settings"), F.round(F.min("q_max"), 9).alias("least_q_max"), F.round(F.max("q_max"), 9).alias("most_q_max"), F.round(F.log10(most / least), 6).alias("orders"),
        F.round(F.min("spearman"), 9).alias("least_spearman"), F.round(F.min("top_overlap"), 9).alias("least_overlap"), F.bool_and(F.col("top_overlap") == 1).alias("all_match"),
    )


_UNDER = f"{p.RECORDS}, {p.guides_sql()}, {GROUND}, {_SWEEP}, {_PAIRS}"


@query(f"""WITH {_UNDER} SELECT x.guide_id AS a, y.guide_id AS b, count(*) FILTER (hx.seq_id IS NOT NULL AND hy.seq_id IS NOT NULL) AS n_both, round(avg(x.f * y.f), 9) AS p_escape
FROM f x JOIN f y ON x.seq_id = y.seq_id AND x.guide_id < y.guide_id LEFT JOIN held hx ON hx.guide_id = x.guide_id AND hx.seq_id = x.seq_id LEFT JOIN held hy ON hy.guide_id = y.guide_id AND hy.seq_id = y.seq_id GROUP BY ALL HAVING n_both > 0""")
def pair_escape(spark, sf_dir):
    """All pairs of sites that share a record, with what escapes both."""
    g = _ground(spark, sf_dir)
    return M.pair_escape(g.found, g.q.select("guide_id", "q"), g.n)


@query(f"""WITH {_UNDER}, v AS (SELECT x.guide_id AS a, y.guide_id AS b, round(avg(x.f * y.f), 9) AS p_escape FROM f x JOIN f y ON x.seq_id = y.seq_id AND x.guide_id < y.guide_id AND (x.gene <> y.gene OR abs(x.middle - y.middle) >= 150) GROUP BY ALL)
SELECT a, b, p_escape FROM v ORDER BY p_escape, a, b LIMIT 1""")
def best_pair(spark, sf_dir):
    """The best of all pairs of allowed sites, exactly."""
    best = _ground(spark, sf_dir).pairs()
    return best.select(F.col("members")[0]["guide_id"].alias("a"), F.col("members")[1]["guide_id"].alias("b"), F.round("value", 9).alias("p_escape"))


@query(f"""WITH {_UNDER}, single AS (SELECT guide_id, any_value(gene) AS gene, any_value(middle) AS middle, round(avg(f), 12) AS v FROM f GROUP BY guide_id), lead AS (SELECT *, row_number() OVER (ORDER BY v, guide_id) AS i FROM single QUALIFY i <= 60),
vec AS (SELECT seq_id, list(f ORDER BY i) AS v FROM lead JOIN f USING (guide_id) GROUP BY seq_id), pat AS (SELECT v, count(*) AS w FROM vec GROUP BY v),
far AS (SELECT a.i AS x, b.i AS y FROM lead a JOIN lead b ON a.i < b.i AND (a.gene <> b.gene OR abs(a.middle - b.middle) >= 150)),
trip AS (SELECT p.x, p.y, r.y AS z FROM far p JOIN far r ON r.x = p.y JOIN far t ON t.x = p.x AND t.y = r.y),
tr AS (SELECT x, y, z, sum(w * v[x] * v[y] * v[z]) / any_value(n) AS v FROM trip, pat, n GROUP BY ALL)
SELECT round(min(v), 9) AS p_escape, count(*) AS n_feasible FROM tr""")
def exhaustive_triple(spark, sf_dir):
    """The best of all feasible triples of the 60 best sites, and how many there are."""
    return _ground(spark, sf_dir).exhaustive(3).select(F.round("value", 9).alias("p_escape"), F.col("n_sets").alias("n_feasible"))


@query()
def search_validation(spark, sf_dir):
    """The heuristic for three sites against all triples of the 60 best."""
    g = _ground(spark, sf_dir)
    both = g.best(3).select("model", F.col("value").alias("heuristic")).join(g.exhaustive(3).select("model", F.col("value").alias("exhaustive")), "model")
    return both.select("heuristic", "exhaustive", (F.col("heuristic") <= F.col("exhaustive") * (1 + 1e-9)).alias("same"))


def _curve(spark, sf_dir, **options):
    return cut(_ground(spark, sf_dir, **options).curve(LARGEST))


@query()
def greedy_kcurve(spark, sf_dir):
    """The best set of each size with at most one site of a gene: value, records that hold all, value if sites were independent, and limits."""
    c = _curve(spark, sf_dir, per_gene=1)
    return c.select("k", F.col("value").alias("p_escape_best"), F.round("joint", 9).alias("joint"), F.round("independent", 9).alias("p_escape_if_independent"), F.col("members.guide_id").alias("guides"), F.col("members.gene").alias("genes"), *[(F.col("value") < x).alias(f"below_{x:g}") for x in LIMITS])


@query()
def minimum_k_table(spark, sf_dir):
    """The least number of sites under each limit, and under one escape in a population of the given size, by value and by what the records can certify."""
    g = _ground(spark, sf_dir)
    c = cut(g.curve(LARGEST))
    limits = [*LIMITS, *(1 / x for x in POPULATIONS)]
    each = c.select("model", "k", F.explode("members.guide_id").alias("guide_id")).join(g.q, ["model", "guide_id"]).join(g.sites.select("guide_id", (F.lit(g.n) - F.col("held")).alias("absent")), "guide_id").withColumn("n", F.lit(g.n).cast("long"))
    bound = M.upper_bounds(spark, each, "absent", "n").groupBy("model", "k").agg(F.array_sort(F.collect_list(F.struct("guide_id", (F.col("upper") + (1 - F.col("upper")) * F.col("q")).alias("v")))).alias("x"))
    sure = bound.select("model", "k", F.aggregate("x", F.lit(1.0), lambda a, x: a * x["v"]).alias("value"))
    two = Z.minimum_k(sure, limits).select("limit", F.col("k").alias("k_certified"), F.round("reached", 9).alias("certified"))
    return Z.minimum_k(c, limits).select("limit", F.col("k").alias("k_point"), "reached").join(two, "limit").withColumn("gap", F.col("k_certified") - F.col("k_point"))


@query()
def alternatives(spark, sf_dir):
    """The best sets of two to four, free and with one site of a gene, and the best pairs that keep the best site or its gene, each against the first pair."""
    g = _ground(spark, sf_dir)
    free = cut(g.curve(LARGEST)).where("k >= 2").select(F.concat(F.lit("best of "), F.col("k").cast("string")).alias("kind"), "k", "members", "value", "joint")
    g.per_gene = 1
    spread = cut(g.curve(LARGEST)).where("k >= 2").select(F.concat(F.lit("one of a gene, "), F.col("k").cast("string")).alias("kind"), "k", "members", "value", "joint")
    g.per_gene = 0
    first = g.first(g.singles()).select("model", "members")
    kept = g.valued(g.grown(first, []).select("model", "members"), []).select(F.lit("best site kept").alias("kind"), F.lit(2).alias("k"), "members", F.round("value", Z.DIGITS).alias("value"), "joint")
    rows = cut(free.unionByName(spread).unionByName(kept))
    lead = rows.where("kind = 'best of 2'").select(F.col("value").alias("lead"))
    return rows.crossJoin(F.broadcast(lead)).select("kind", "k", F.array_join("members.guide_id", ";").alias("guides"), F.array_join(F.array_sort(F.array_distinct("members.gene")), ";").alias("genes"), F.round("joint", 9).alias("joint"), F.round("value", 9).alias("p_escape"), F.round(F.col("lead") / F.greatest("value", F.lit(1e-300)), 6).alias("fold"))


@query()
def sensitivity_sets(spark, sf_dir):
    """The best single site and the best pair under every setting, and whether they are the baseline's: all settings in one search."""
    g = _ground(spark, sf_dir, baseline=False)
    sets = cut(g.best(1).withColumn("k", F.lit(1)).unionByName(g.best(2).withColumn("k", F.lit(2)))).select("model", "k", "value", F.col("members.guide_id").alias("guides"))
    base = sets.where("model = 0").select("k", F.col("guides").alias("base"))
    told = sets.join(F.broadcast(base), "k").join(F.broadcast(_settings(spark).withColumnRenamed("setting", "model")), "model")
    return told.select(F.col("model").alias("setting"), "group", "label", "k", F.round("value", 9).alias("p_escape"), F.array_join("guides", ";").alias("guides"), (F.col("guides") == F.col("base")).alias("matches_baseline"))


@query()
def monte_carlo_check(spark, sf_dir):
    """The best triple's value by seeded draws, its error, and its distance from the closed form in errors."""
    g = _ground(spark, sf_dir)
    best = g.best(3).first()
    if best is None:
        return spark.createDataFrame([], "estimate double, error double, exact double, z double")
    known = {r.guide_id: r.q for r in g.q.where(F.col("guide_id").isin([m.guide_id for m in best.members])).collect()}
    ids = P.numbered(chain_queries.Ground(spark, sf_dir).records, "seq_id")
    told = Z.drawn(g.found, g.n, sorted(known.items()), ids, 400_000, 20240814)
    return told.select("estimate", "error", F.lit(best.value).alias("exact"), ((F.col("estimate") - best.value) / F.nullif("error", F.lit(0.0))).alias("z"))
