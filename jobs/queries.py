"""The jobs as queries, each run twice into one new folder, with their SQL."""

from __future__ import annotations

import uuid

from corpusloom.functions.grammar import GRAMMARS
from corpusloom.plans import prelude as p
from corpusloom.session import shared_dir
from jobs import offtarget_screen, presence_ledger

_STRICT, _RELAXED, _MOST, _NEAR = GRAMMARS["sacas9"], GRAMMARS["sacas9_relaxed"], 3, 2


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def job1_presence_ledger(spark, sf_dir):
    """The ledger of all documents after two runs, the second of which finds nothing new."""
    at = _folder(spark, "job1")
    paths = {"documents": f"{sf_dir}/documents.parquet", "benchmark": f"{sf_dir}/benchmark.parquet", "out": f"{at}/out", "checkpoint": f"{at}/checkpoint"}
    presence_ledger.run(spark, **paths)
    return presence_ledger.run(spark, **paths)


def job2_offtarget_screen(spark, sf_dir):
    """The summary of all near matches after two runs, the second of which replaces the first's files."""
    paths = {"documents": f"{sf_dir}/documents.parquet", "benchmark": f"{sf_dir}/benchmark.parquet", "out": f"{_folder(spark, 'job2')}/out"}
    offtarget_screen.run(spark, **paths)
    return offtarget_screen.run(spark, **paths)


JOB1_SQL = f"""WITH {p.BASE}, counted AS (SELECT guide_id, count(DISTINCT seq_id) AS n FROM found GROUP BY guide_id), total AS (SELECT count(*) AS n_total FROM records)
SELECT g.guide_id, g.gene, coalesce(n, 0) AS n_present, n_total, round(coalesce(n, 0) / n_total, 6) AS conservation_fraction FROM guides g CROSS JOIN total LEFT JOIN counted c ON c.guide_id = g.guide_id"""


def _counts(name: str, of: str) -> str:
    each = [(f"{name}_mm{m}", f"mismatches = {m}") for m in range(_MOST + 1)]
    each += [(f"{name}_total", "true"), (f"{name}_le{_NEAR}", f"mismatches <= {_NEAR}"), (f"{name}_seed_le1", "seed <= 1")]
    return ", ".join(f"coalesce(count_if({of} AND {c}), 0) AS {n}" for n, c in each)


JOB2_SQL = f"""WITH {p.RECORDS}, {p.guides_sql(_STRICT)}, {p.sites_sql("doc_sites", "records", "seq_id", _RELAXED)},
spaced AS (SELECT seq_id, substring(target, 1, {_RELAXED.spacer}) AS spacer, substring(target, {_RELAXED.length}, 1) = 'T' AS strict FROM doc_sites),
hits AS (SELECT g.guide_id, strict, hamming(spacer, g.protospacer) AS mismatches, len([i FOR i IN range(1, {_RELAXED.spacer + 1}) IF i > {_RELAXED.spacer - 12} AND substring(spacer, i, 1) <> substring(g.protospacer, i, 1)]) AS seed
  FROM spaced, guides g WHERE hamming(spacer, g.protospacer) <= {_MOST})
SELECT g.guide_id, g.gene, g.protospacer, {_counts("strict", "strict")}, {_counts("all", "hits.guide_id IS NOT NULL")} FROM guides g LEFT JOIN hits ON hits.guide_id = g.guide_id GROUP BY g.guide_id, g.gene, g.protospacer"""

QUERIES = {q.__name__: q for q in (job1_presence_ledger, job2_offtarget_screen)}
SQL = {"job1_presence_ledger": JOB1_SQL, "job2_offtarget_screen": JOB2_SQL}
