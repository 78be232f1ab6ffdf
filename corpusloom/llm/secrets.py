"""Secret scans with corpus-wide ownership frequency.

Every text is searched for credential shapes.  A candidate's value is hashed, hashes are counted by distinct owners and
repositories over the whole corpus, and both counts separate values that were copied widely, by many owners or into many
repositories (documentation examples), from owner-specific ones that look live.  Generic high-entropy strings, too vague to report on shape alone, are reported
(kind `owned`) exactly when their ownership is that narrow.

Cases: a null text is an empty text (no spans); a null owner is one owner of its own and a null repository one of its
owner's; repositories of the same name under two owners are two; repeated rows are separate
documents of the same owner; ties in position are ordered by kind; an empty table gives an empty result; other columns
are ignored unless carried.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Sequence
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, shielded, written

KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GENERIC = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("hash", T.StringType())])
SCANNED = [
    T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()),
    T.StructField("base_sha256", T.StringType()), T.StructField("candidates", T.ArrayType(CANDIDATE)),
]


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_matches(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the fixed shapes, by start and then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if max(map(len, text.split()), default=0) >= 20:  # both shapes lie inside one word of 20 or more
        if "AKIA" in text:
            found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def generic_matches(text: str, base: list[tuple[int, int, int, str]], least_entropy: float) -> list[tuple[int, int, int, str]]:
    """Long mixed strings outside the base spans."""
    if max(map(len, text.split()), default=0) < 20:
        return []
    out = []
    for m in GENERIC.finditer(text):
        v = m[0]
        if any(s < m.end() and m.start() < e for s, _, e, _ in base):
            continue
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and entropy(v) >= least_entropy:
            out.append((m.start(), 3, m.end(), v))
    return out


def spelled(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_factory(least_entropy: float):
    def factory():
        def f(texts):
            cols: list[list] = [[], [], [], [], []]
            for text in texts:
                text = text or ""
                base = base_matches(text)
                kinds = Counter(k for _, k, _, _ in base)
                cands = base + generic_matches(text, base, least_entropy)
                row = (kinds[0], kinds[1], kinds[2], sha256(spelled((s, k, e) for s, k, e, _ in base).encode()).hexdigest(), [{"kind": k, "start": s, "end": e, "hash": sha256(v.encode()).hexdigest()} for s, k, e, v in cands])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            return None, cols

        return f

    return factory


def ownership(candidates: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """(hash, owners, repositories, live) from (hash, owner, repository), counted exactly over the whole corpus.

    Distinct triples are formed first and counted for each owner, so that a value that a third of all rows hold is
    spread over its repositories, and then arrives as one row for each map task and owner.
    """
    each = candidates.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))  # groups keep null apart from ""
    counted = by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repositories"))
    return counted.withColumn("live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))


def detect(
    docs: DataFrame,
    text: str = "text",
    owner: str = "source",
    repository: str = "doc_id",
    carry: Sequence[str] = ("doc_id",),
    max_owners: int = 3,
    max_repositories: int = 10,
    least_entropy: float = 3.5,
) -> DataFrame:
    """carry columns plus n_assign, n_access, n_hex, base_sha256, spans, owners, repositories, n_live, n_example and found.

    found holds (start, kind, end, live, owners, repositories) of every reported span; owners and repositories hold the
    counts of its value in the order of spans.  A value is live-looking while at most max_owners distinct owners and at
    most max_repositories distinct repositories hold it.
    """
    rest, whole = _judged(docs, text, owner, repository, carry, max_owners, max_repositories, least_entropy)
    names = F.array(*[F.lit(k) for k in KINDS])
    say = F.array_join(F.transform("found", lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    out = rest.unionByName(whole)
    out = out.withColumn("owners", F.col("found.owners")).withColumn("repositories", F.col("found.repositories"))
    out = out.withColumn("spans", say).withColumn("n_live", F.size(F.filter("found", lambda x: x["live"])).cast("long")).withColumn("n_example", F.size(F.filter("found", lambda x: ~x["live"])).cast("long"))
    fields = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "owners", "repositories", "n_live", "n_example", "found"]
    return out.select(*[F.col(f"k_{c}").alias(c) for c in carry if c not in fields], *fields)


def _judged(docs: DataFrame, text: str, owner: str, repository: str, carry: Sequence[str], max_owners: int, max_repositories: int, least_entropy: float) -> tuple[DataFrame, DataFrame]:
    """Rows without a candidate, and rows with some: carry columns (k_ before their names), SCANNED without candidates, and found.

    The scan is written once with what is carried; what is counted and joined are values and row numbers, and a text
    moves only if it has a candidate.
    """
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"k_{c}") for c in carry], F.col(f"`{text}`").alias("t"), F.col(f"`{owner}`").cast("string").alias("o"), F.col(f"`{repository}`").cast("string").alias("r"))
    kept = [f"k_{c}" for c in carry]
    scanned = written(annotate(renamed, "t", SCANNED, scan_factory(least_entropy), [*kept, "o", "r"]).withColumn("row", F.monotonically_increasing_id()), "secrets")
    some = F.size("candidates") > 0
    each = scanned.where(some).select("row", F.col("o").alias("owner"), F.col("r").alias("repository"), F.explode("candidates").alias("c")).select("row", "owner", "repository", "c.*")
    owned = ownership(each, max_owners, max_repositories)
    judged = each.join(owned, "hash").where((F.col("kind") < 3) | F.col("live"))
    back = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live", "owners", "repositories"))).alias("found"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean,owners:bigint,repositories:bigint>>")
    columns = [*kept, *[x.name for x in SCANNED[:-1]], "found"]
    whole = scanned.where(some).join(back, "row", "left").withColumn("found", F.coalesce("found", none)).select(*columns)
    return scanned.where(~some).withColumn("found", none).select(*columns), whole


def redact(docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", length: str | None = "n_chars", **options) -> DataFrame:
    """docs with each reported span replaced by [SECRET:kind], or [EXAMPLE:kind] where many owners or repositories hold the value.

    All columns stay; `length`, if the table has it, is counted anew for rows that changed.
    """
    flat, cols, (body, own, repo) = shielded(docs, text, owner, repository)
    limits = {"max_owners": 3, "max_repositories": 10, "least_entropy": 3.5} | options
    rest, whole = (x.select(*[F.col(f"k_{c}").alias(c) for c in cols], "found") for x in _judged(flat, body, own, repo, cols, **limits))

    def factory():
        def f(texts, spans):
            out = []
            for t, ss in zip(texts, spans, strict=True):
                parts, at = [], 0
                for s in ss:
                    if s["start"] >= at:
                        parts += [t[at : s["start"]], f"[{'SECRET' if s['live'] else 'EXAMPLE'}:{KINDS[s['kind']]}]"]
                    at = max(at, s["end"])
                out.append("".join([*parts, t[at:]]))
            return None, [out]

        return f

    hit = annotate(whole, body, [T.StructField("redacted", T.StringType())], factory, cols, ["found"])
    if length in docs.columns:
        n = cols[docs.columns.index(length)]
        hit = hit.withColumn(n, F.when(F.col("redacted") == F.col(body), F.col(n)).otherwise(F.length("redacted").cast(docs.schema[length].dataType)))
    hit = hit.withColumn(body, F.col("redacted")).select(*cols)
    return rest.select(*cols).unionByName(hit).toDF(*docs.columns)
