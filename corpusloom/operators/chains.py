"""Laying records on a reference: anchors, colinear chains, what a record says about a site, and its codons.

The reference is one sequence.  Its index of packed k-mers goes to the executors, and each record is laid on it where it is
read: one Arrow pass, no shuffle, memory in proportion to the longest record.  What the pass returns is sparse: a site gets a
row only in records whose chains reach it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.sequences import CODON
from .scan import SPREAD, packed

# What a record says about a site, from the most to the least informative; of several spans and chains the first wins.
PRESENT, ABSENT, AMBIGUOUS, WIDE, NOT_COVERED = range(5)
STATUS_NAMES = ("present", "absent", "ambiguous", "wide", "not_covered")
MOST_SITES = 1_000_000
_CODE = np.full(256, 4, np.int8)
_CODE[[*b"ACGT"]] = range(4)
_AMINO = np.array([CODON[a + b + c] for a in "ACGT" for b in "ACGT" for c in "ACGT"])


def coded(seq: str) -> np.ndarray:
    """0 to 3 for A, C, G, T and 4 for anything else."""
    return _CODE[np.frombuffer(seq.encode(), np.uint8)]


def turned(code: np.ndarray) -> np.ndarray:
    """The reverse complement."""
    return np.where(code < 4, 3 - code, 4)[::-1]


def words(code: np.ndarray, k: int, step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The starts, multiples of step, of concrete k-mers (k up to 31), and the k-mers as numbers."""
    at = np.arange(0, max(0, len(code) - k + 1), step)
    doubts = np.concatenate(([0], np.cumsum(code == 4)))
    at = at[doubts[at + k] == doubts[at]]
    return at, packed(code, k)[at] if len(at) else np.empty(0, np.int64)


class Reference:
    """The k-mers of a reference that occur at most `most` times in it."""

    def __init__(self, seq: str, k: int = 25, most: int = 4):
        self.k, self.code = k, coded(seq)
        at, word = words(self.code, k)
        order = np.argsort(word, kind="stable")
        at, word = at[order], word[order]
        _, inverse, times = np.unique(word, return_inverse=True, return_counts=True)
        few = times[inverse] <= most
        self.at, self.word = at[few], word[few]
        self.bits = min(26, max(16, len(self.word).bit_length() + 3))
        self.marked = np.zeros(1 << self.bits, bool)
        self.marked[self.place(self.word)] = True

    def place(self, words: np.ndarray) -> np.ndarray:
        return (words * SPREAD).view(np.uint64) >> np.uint64(64 - self.bits)

    def anchors(self, code: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(reference position, record position) of each step-th k-mer of a record, by both; words that a bitmap lacks are not searched for."""
        qry, word = words(code, self.k, step)
        likely = self.marked[self.place(word)]
        qry, word = qry[likely], word[likely]
        low, high = np.searchsorted(self.word, word, "left"), np.searchsorted(self.word, word, "right")
        times = high - low
        place = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        ref, qry = self.at[place], np.repeat(qry, times)
        order = np.lexsort((qry, ref))
        return ref[order], qry[order]

    def lay(self, code: np.ndarray, step: int, oriented: int) -> tuple[bool, np.ndarray, np.ndarray, np.ndarray]:
        """(turned, the record in the direction of the reference, its anchors): its own direction if that gives `oriented` anchors, else the one with more."""
        own = self.anchors(code, step)
        if len(own[0]) >= oriented:
            return False, code, *own
        back = turned(code)
        other = self.anchors(back, step)
        return (True, back, *other) if len(other[0]) > len(own[0]) else (False, code, *own)


def chain_labels(ref: np.ndarray, qry: np.ndarray, max_gap: int = 3000, max_drift: int = 60, least: int = 2) -> np.ndarray:
    """A chain's number for each anchor (sorted by ref and qry); -1 in chains of under `least` anchors.

    An anchor goes to that chain, of those whose last anchor lies before it on the record and up to max_gap before it on
    the reference, whose diagonal is nearest, the oldest of equals; beyond max_drift it begins one.  So copies of a repeat chain apart.
    """
    labels = np.empty(len(ref), np.int64)
    last = np.empty((len(ref), 2), np.int64)  # of each chain: the diagonal and the record position of its last anchor
    reach = np.empty(len(ref), np.int64)  # and its reference position
    live, n = np.empty(0, np.int64), 0
    for i, (r, q) in enumerate(zip(ref.tolist(), qry.tolist(), strict=True)):
        live = live[reach[live] >= r - max_gap]
        fit = live[last[live, 1] < q]
        drift = np.abs(last[fit, 0] - (q - r))
        if len(fit) and drift.min() <= max_drift:
            to = fit[drift.argmin()]
        else:
            to, n = n, n + 1
            live = np.append(live, to)
        labels[i] = to
        last[to], reach[to] = (q - r, q), r
    few = np.bincount(labels, minlength=n) < least if n else np.empty(0, bool)
    return np.where(few[labels], -1, labels) if n else labels


class Chains:
    """The chains of a record, and the prefix count of its ambiguous bases."""

    def __init__(self, ref: np.ndarray, qry: np.ndarray, code: np.ndarray, k: int, **limits):
        labels = chain_labels(ref, qry, **limits)
        order = np.flatnonzero(labels >= 0)
        order = order[np.argsort(labels[order], kind="stable")]
        cuts = np.flatnonzero(np.diff(labels[order])) + 1
        self.parts = [(ref[x], qry[x]) for x in np.split(order, cuts)] if len(order) else []
        self.k, self.doubts = k, np.concatenate(([0], np.cumsum(code == 4)))

    def spans(self) -> list[tuple[int, int]]:
        """The reference from the first to the last anchor of each chain, in order."""
        return sorted((int(r[0]), int(r[-1]) + self.k) for r, _ in self.parts)

    def unclear(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.doubts[np.maximum(low, high)] > self.doubts[low]

    def bracketed(self, start: np.ndarray, end: np.ndarray, widest: int) -> np.ndarray:
        """The status of spans by chains with an anchor wholly before and one wholly after: the best over chains."""
        best = np.full(len(start), NOT_COVERED)
        for ref, qry in self.parts:
            before = np.searchsorted(ref, start - self.k, "right") - 1
            after = np.searchsorted(ref, end, "left")
            held = (before >= 0) & (after < len(ref))
            low = qry[np.maximum(before, 0)]
            high = qry[np.minimum(after, len(ref) - 1)] + self.k
            held &= high > low
            says = np.where(high - low > widest, WIDE, np.where(self.unclear(low, high), AMBIGUOUS, ABSENT))
            best = np.where(held, np.minimum(best, says), best)
        return best

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The status of spans that lie between two chains: a gap of the assembly is ambiguous, anything else too wide."""
        if not self.parts:
            return np.full(len(start), NOT_COVERED)
        first = np.array([[r[0], r[-1], q[0], q[-1]] for r, q in self.parts])
        by_end = first[np.lexsort((-first[:, 0], first[:, 1]))]
        by_start = first[np.lexsort((first[:, 1], first[:, 0]))]
        left = np.searchsorted(by_end[:, 1] + self.k, start, "right") - 1
        right = np.searchsorted(by_start[:, 0], end, "left")
        both = (left >= 0) & (right < len(first))
        low = by_end[np.maximum(left, 0), 3]
        high = by_start[np.minimum(right, len(first) - 1), 2] + self.k
        return np.where(both, np.where((high > low) & self.unclear(low, high), AMBIGUOUS, WIDE), NOT_COVERED)

    def statuses(self, site: np.ndarray, start: np.ndarray, end: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray]:
        """(site, status); site: sorted numbers, repeated for sites with several spans."""
        first = np.flatnonzero(np.concatenate(([True], site[1:] != site[:-1]))) if len(site) else np.empty(0, np.int64)
        if not len(first):
            return site, np.empty(0, np.int64)
        one = np.minimum.reduceat(self.bracketed(start, end, widest), first)
        two = np.minimum.reduceat(self.between(start, end), first)
        return site[first], np.where(one == NOT_COVERED, two, one)


def reference_text(reference: DataFrame) -> str:
    """The one sequence of reference(seq)."""
    rows = reference.select("seq").limit(2).collect()
    if len(rows) != 1:
        raise ValueError("the reference is one sequence")
    return rows[0].seq


_SPAN = T.StructType([T.StructField("low", T.IntegerType()), T.StructField("high", T.IntegerType())])
_SCORED = T.StructType([T.StructField("site", T.IntegerType()), T.StructField("status", T.IntegerType())])


def laid(records: DataFrame, reference: DataFrame | Reference, guides: DataFrame, k: int = 25, step: int = 4, widest: int = 2000, oriented: int = 50, slack: int = 25) -> DataFrame:
    """One row for each record: seq_id, turned, length_bp, n_ambiguous, chains (reference spans) and scored (guide_id, status).

    guides: guide_id, ref_start, ref_end (1-based inclusive), one row for each place of a site.  Scored are the sites whose
    first start lies at most `slack` outside what the chains reach; the rest are not covered.  A null sequence is an empty one.
    """
    places = guides.select("guide_id", "ref_start", "ref_end").orderBy("guide_id", "ref_start", "ref_end").limit(MOST_SITES + 1).collect()
    if len(places) > MOST_SITES:
        raise ValueError("the dictionary of sites is held by each executor: split it")
    names = sorted({r.guide_id for r in places})
    number = {n: i for i, n in enumerate(names)}
    site = np.array([number[r.guide_id] for r in places], np.int64)
    start, end = np.array([r.ref_start - 1 for r in places], np.int64), np.array([r.ref_end for r in places], np.int64)
    first = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(first, site, start)
    index = reference if isinstance(reference, Reference) else Reference(reference_text(reference), k)
    k = index.k
    key = records.schema["seq_id"].dataType.simpleString()
    schema = f"seq_id {key}, turned boolean, length_bp int, n_ambiguous int, chains array<struct<low:int,high:int>>, scored array<struct<site:int,status:int>>"

    def run(batches):
        for b in batches:
            out = [[], [], [], [], []]
            for seq in b.column(1).to_pylist():
                back, code, ref, qry = index.lay(coded(seq or ""), step, oriented)
                chains = Chains(ref, qry, code, k)
                spans = chains.spans()
                scored = []
                if spans:
                    near = (first >= spans[0][0] - slack) & (first <= max(h for _, h in spans) + slack)
                    mine = near[site]
                    scored = [{"site": s, "status": x} for s, x in zip(*(v.tolist() for v in chains.statuses(site[mine], start[mine], end[mine], widest)), strict=True)]
                for col, v in zip(out, (back, len(code), int((code == 4).sum()), [{"low": a, "high": z} for a, z in spans], scored), strict=True):
                    col.append(v)
            types = [pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())])), pa.list_(pa.struct([("site", pa.int32()), ("status", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], names=["seq_id", "turned", "length_bp", "n_ambiguous", "chains", "scored"])

    spelled = F.array(*[F.lit(n) for n in names]) if names and len(names) <= 1000 else None
    rows = records.select("seq_id", "seq").mapInArrow(run, schema)
    if spelled is not None:
        named = F.transform("scored", lambda x: F.struct(F.element_at(spelled, x["site"] + 1).alias("guide_id"), x["status"].alias("status")))
        return rows.withColumn("scored", named)
    table = records.sparkSession.createDataFrame(list(enumerate(names)), "site int, guide_id string")
    each = rows.select("seq_id", F.explode("scored").alias("x")).select("seq_id", "x.*").join(F.broadcast(table), "site")
    back = each.groupBy("seq_id").agg(F.collect_list(F.struct("guide_id", "status")).alias("scored"))
    empty = F.array().cast("array<struct<guide_id:string,status:int>>")
    return rows.drop("scored").join(back, "seq_id", "left").withColumn("scored", F.coalesce("scored", empty))


def with_hits(scored: DataFrame, hits: DataFrame) -> DataFrame:
    """scored (seq_id, guide_id, status) where exact hits (seq_id, guide_id) are present, and hits that nothing scored are added once."""
    held = hits.select("seq_id", "guide_id").distinct().withColumn("held", F.lit(True))
    both = scored.join(held, ["seq_id", "guide_id"], "full_outer")
    return both.select("seq_id", "guide_id", F.when(F.col("held"), PRESENT).otherwise(F.col("status")).alias("status"))


def classify(mapped: DataFrame, found: DataFrame) -> DataFrame:
    """(seq_id, guide_id, status) from laid() and presence (seq_id, guide_id).

    An exact hit is present wherever it lies, scored or not, and counts once.  Pairs without a row are not covered.
    """
    return with_hits(mapped.select("seq_id", F.explode("scored").alias("x")).select("seq_id", "x.guide_id", "x.status"), found)


def offset_runs(anchors: DataFrame, max_gap: int = 60) -> DataFrame:
    """(seq_id, run, low, high, shift, n): stretches of anchors on one diagonal with gaps up to max_gap."""
    w = W.partitionBy("seq_id").orderBy("ref", "qry")
    shift = F.col("qry") - F.col("ref")
    new = (F.lag(shift).over(w) != shift) | (F.col("ref") - F.lag("ref").over(w) > max_gap)
    runs = anchors.withColumn("shift", shift).withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("seq_id", "run").agg(F.min("ref").alias("low"), F.max("ref").alias("high"), F.first("shift").alias("shift"), F.count(F.lit(1)).alias("n"))


NOWHERE = np.iinfo(np.int64).min


def position_map(parts: Sequence[tuple[np.ndarray, np.ndarray]], size: int, k: int, max_gap: int = 60) -> np.ndarray:
    """For each reference position, the record position that the offset runs of chains (ref, qry) give it, or NOWHERE.

    A run goes on along one diagonal over gaps up to max_gap, so bases that differ between anchors are mapped too.  Of several runs
    at a position that of most anchors counts, of equals the last: chains in their given order, runs in the order of their chain.
    """
    at = np.full(size, NOWHERE)
    runs = []
    for ref, qry in parts:
        diagonal = qry - ref
        first = np.flatnonzero(np.concatenate(([True], (np.diff(diagonal) != 0) | (np.diff(ref) > max_gap))))
        last = np.concatenate((first[1:], [len(ref)])) - 1
        runs += [(int(z - a), int(ref[a]), int(ref[z]) + k, int(diagonal[a])) for a, z in zip(first, last, strict=True)]
    for _, low, high, shift in sorted(runs, key=lambda r: r[0]):  # a stable order: better and later runs are written last
        at[low:high] = np.arange(low, min(high, size)) + shift
    return at


def on_record(at: np.ndarray, code: np.ndarray) -> np.ndarray:
    return (at >= 0) & (at < len(code))


def codons_of(cds: np.ndarray, at: np.ndarray, code: np.ndarray, strand: int) -> tuple[np.ndarray, np.ndarray]:
    """(resolved, codon number) of a copy's codons in a record; at: the record position of each base of the copy."""
    known = on_record(at, code)
    base = np.where(known, code[np.clip(at, 0, max(0, len(code) - 1))] if len(code) else 4, 4)
    if strand < 0:
        base = np.where(base < 4, 3 - base, 4)
    each = base[: len(cds) // 3 * 3].reshape(-1, 3).astype(np.int64)
    return (each < 4).all(axis=1), each[:, 0] * 16 + each[:, 1] * 4 + each[:, 2]


def codon_profile(records: DataFrame, reference: DataFrame | Reference, copies: DataFrame, k: int = 25, step: int = 6, least: float = 0.95, stops: bool = True, every: bool = True) -> DataFrame:
    """One row for each record and gene: seq_id, gene, copy, turned, resolved_fraction, net_offset, verdict and codons (codon, nt, aa).

    copies: gene, copy, strand (1 or -1) and positions (0-based on the reference, in coding order).  A record is chained in both
    directions, and the copy and direction with most positions on the record are read, the first of equals.  A gene with under
    `least` of its positions on the record is `unresolved`; one with a stop that the reference lacks before its last codon is `stop`
    (unless stops is false); either gives no codons.  nt and aa say whether a codon without unknown bases, and its amino acid, differ from the reference.
    net_offset is the change of length over the gene.  Unless `every`, genes of which nothing lies on a record have no row.
    """
    rows = copies.select("gene", "copy", "strand", "positions").orderBy("gene", "copy").limit(MOST_SITES + 1).collect()
    if len(rows) > MOST_SITES:
        raise ValueError("the copies are held by each executor: split them")
    genes: dict[str, list] = {}
    for r in rows:
        genes.setdefault(r.gene, []).append((r.copy, r.strand, np.array(r.positions, np.int64)))
    index = reference if isinstance(reference, Reference) else Reference(reference_text(reference), k)
    k, size = index.k, len(index.code)
    key = records.schema["seq_id"].dataType.simpleString()
    schema = f"seq_id {key}, gene string, copy int, turned boolean, resolved_fraction double, net_offset int, verdict string, codons array<struct<codon:int,nt:boolean,aa:boolean>>"

    def read(code: np.ndarray) -> Iterator[tuple]:
        maps, seen = [], False
        for back in (False, True):
            own = turned(code) if back else code
            parts = sorted(Chains(*index.anchors(own, step), own, k).parts, key=lambda p: (int(p[0][0]), int(p[0][-1])))
            seen |= bool(parts)
            maps.append((back, own, position_map(parts, size, k)))
        for gene, each in genes.items() if seen or every else ():
            _, turn, copy = max((int(on_record(m[pos], own).sum()), (-c, not back), c) for c, (_, _, pos) in enumerate(each) for back, own, m in maps)
            name, strand, pos = each[copy]
            back, own, m = maps[0 if turn[1] else 1]
            at = m[pos]
            held = np.flatnonzero(on_record(at, own))
            if not len(held) and not every:
                continue
            resolved, codon = codons_of(pos, at, own, strand)
            _, was = codons_of(pos, pos, index.code, strand)
            fraction = round(len(held) / len(pos), 6) if len(pos) else 0.0
            net = int((at[held[-1]] - pos[held[-1]]) - (at[held[0]] - pos[held[0]])) if len(held) else 0
            amino, before = _AMINO[np.where(resolved, codon, 0)], _AMINO[was % 64]
            stop = stops and bool((resolved & (amino == "*") & (before != "*"))[:-1].any())
            verdict = "unresolved" if fraction < least else "stop" if stop else "used"
            told = [{"codon": int(c), "nt": bool(codon[c] != was[c]), "aa": bool(amino[c] != before[c])} for c in np.flatnonzero(resolved)] if verdict == "used" else []
            yield gene, name, back, fraction, abs(net), verdict, told

    def run(batches):
        types = [pa.string(), pa.int32(), pa.bool_(), pa.float64(), pa.int32(), pa.string(), pa.list_(pa.struct([("codon", pa.int32()), ("nt", pa.bool_()), ("aa", pa.bool_())]))]
        for b in batches:
            for i, seq in enumerate(b.column(1).to_pylist()):
                cols = list(zip(*read(coded(seq or "")), strict=True))
                if cols:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(0).slice(i, 1)] * len(cols[0])), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["seq_id", "gene", "copy", "turned", "resolved_fraction", "net_offset", "verdict", "codons"])

    return records.select("seq_id", "seq").mapInArrow(run, schema)


def codon_counts(profile: DataFrame) -> DataFrame:
    """(gene, codon, n_resolved, n_nt_variant, n_aa_variant) over the records of a profile that are used."""
    each = profile.select("gene", F.explode("codons").alias("c")).select("gene", "c.*")
    return each.groupBy("gene", "codon").agg(F.count(F.lit(1)).alias("n_resolved"), F.count_if("nt").alias("n_nt_variant"), F.count_if("aa").alias("n_aa_variant"))


def profile_quality(profile: DataFrame) -> DataFrame:
    """(gene, verdict, n_records, n_length_variants, n_in_frame): what was left out, and changes of length in what was used."""
    moved = F.col("net_offset") != 0
    return profile.groupBy("gene", "verdict").agg(F.count(F.lit(1)).alias("n_records"), F.count_if(moved).alias("n_length_variants"), F.count_if(moved & (F.col("net_offset") % 3 == 0)).alias("n_in_frame"))


def cds_copies(parts: DataFrame, reference: DataFrame, strict: bool = True) -> DataFrame:
    """gene, copy, strand, positions, cds, protein, valid from parts (gene, copy, strand, part, start, end; 0-based half-open).

    Parts follow each other in their given order; those of the minus strand are read backwards.  A copy is valid if it has
    whole codons, begins with M and ends with its only stop; strict: a copy that is not valid is an error.
    """
    one = F.struct("part", "start", "end")
    listed = parts.groupBy("gene", "copy", "strand").agg(F.array_sort(F.collect_list(one)).alias("parts"))
    walk = lambda p: F.when(p["end"] > p["start"], F.when(F.col("strand") < 0, F.sequence(p["end"] - 1, p["start"], F.lit(-1))).otherwise(F.sequence(p["start"], p["end"] - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    placed = listed.withColumn("positions", F.flatten(F.transform("parts", walk)))
    from .presence import require

    one_row = require(reference.agg(F.max("seq").alias("_seq"), F.count(F.lit(1)).alias("_n")), F.col("_n") <= 1, "the reference is one sequence")
    joined = placed.crossJoin(F.broadcast(one_row.where("_n >= 1").drop("_n")))  # one row
    base = F.array_join(F.transform("positions", lambda x: F.substring(F.col("_seq"), x + 1, F.lit(1))), "")
    from ..functions.sequences import IUPAC, IUPAC_COMPLEMENT, translate_codons

    cds = F.when(F.col("strand") < 0, F.translate(base, IUPAC, IUPAC_COMPLEMENT)).otherwise(base)
    out = joined.withColumn("cds", cds).withColumn("protein", translate_codons(F.col("cds")))
    stops = F.length("protein") - F.length(F.replace("protein", F.lit("*"), F.lit("")))
    valid = (F.length("cds") % 3 == 0) & F.col("protein").startswith("M") & F.col("protein").endswith("*") & (stops == 1)
    out = out.withColumn("valid", valid).select("gene", "copy", "strand", "positions", "cds", "protein", "valid")
    if strict:
        out = require(out, F.col("valid"), "a coding sequence does not translate cleanly")
    return out


def codon_places(copies: DataFrame) -> DataFrame:
    """(gene, pos, codon): the codon of each reference position; of several copies the last counts."""
    each = copies.select("gene", "copy", F.posexplode("positions").alias("i", "pos"))
    return each.groupBy("gene", "pos").agg(F.max_by(F.floor(F.col("i") / 3).cast("int"), F.struct("copy", "i")).alias("codon"))


def cut_codons(sites: DataFrame, places: DataFrame, pam: int, carry: Sequence[str] = ("guide_id",)) -> DataFrame:
    """carry and codon of each site (gene, strand, ref_start, ref_end): that of its cut, else of its middle, else of the
    first mapped position of its footprint, else 0.  Three left joins with the small map, in one pass over a site's positions."""
    cut = F.when(F.col("strand") == "+", F.col("ref_end") - pam - 3).otherwise(F.col("ref_start") - 1 + pam + 2)
    middle = F.floor((F.col("ref_start") - 1 + F.col("ref_end")) / 2).cast("int")
    tries = F.concat(F.array(cut.cast("int"), middle), F.sequence((F.col("ref_start") - 1).cast("int"), (F.col("ref_end") - 1).cast("int")))
    numbered = sites.withColumn("_row", F.monotonically_increasing_id())
    each = numbered.select(*carry, "gene", "_row", F.posexplode(tries).alias("turn", "pos")).join(places, ["gene", "pos"], "left")
    best = each.groupBy("_row", *carry).agg(F.min_by("codon", F.when(F.col("codon").isNotNull(), F.col("turn"))).alias("codon"))
    return best.select(*carry, F.coalesce("codon", F.lit(0)).alias("codon"))
