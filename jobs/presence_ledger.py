"""Conservation of target sites over a growing corpus of records, taking only the files that are new.

    python jobs/presence_ledger.py --documents DIR --benchmark DIR --out DIR --checkpoint DIR [--config FILE]

A file stream reads the files of `documents` that its checkpoint has not seen and ends when there are none.  Each batch
is scanned for the sites of the annotated segments in `benchmark` and leaves two small tables, in a partition named for it:

    out/records/batch=N    seq_id, source, length_bp     the records read
    out/presence/batch=N   seq_id, guide_id              the sites they hold

A batch that runs again after a failure overwrites its own partitions.  After the stream, out/conservation (by gene) is written
from these: in how many records each site occurs.  A record that arrives again, in a later batch, replaces its earlier text.
The expensive scan is made once for each record; a run without new files only rewrites the report, with the same rows.
A record without an id cannot be kept and is counted in the log.  The sites are kept in out/guides: a run with others
is an error, as what was scanned before knows nothing of them.
"""

from __future__ import annotations

import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import sequences as S
from corpusloom.functions.grammar import GRAMMARS, Grammar
from corpusloom.operators import presence as P
from corpusloom.operators import sites as K
from jobs import common

LOG = common.log("presence_ledger")
RECORD, PRESENT, GUIDE = "seq_id long, source string, length_bp int, batch long", "seq_id long, guide_id string, batch long", "guide_id string, gene string, target string"


def watched(path: str) -> str:
    """path as a pattern that matches it alone: a file stream takes a table that is one file only by a pattern."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[{") else f"{path[:-1]}[{path[-1]}]"


def site_table(segments: DataFrame, grammar: Grammar) -> DataFrame:
    """guide_id, gene and target of the sites in annotated segments (item_id, text)."""
    genes = segments.select(F.col("item_id").alias("segment"), F.concat(F.lit("g"), (F.col("item_id") % 7).cast("string")).alias("gene"), S.from_text("text").alias("seq"))
    return K.guide_table(K.sites(genes, "seq", grammar), grammar).select("guide_id", "gene", "target")


def kept_sites(spark: SparkSession, guides: DataFrame, path: str) -> DataFrame:
    """The sites of earlier runs, which have to be the same; those of this run, written, if there were none."""
    try:
        kept = spark.read.schema(GUIDE).parquet(path)
    except AnalysisException:  # no such folder yet
        kept = None
    if kept is None or kept.isEmpty():
        guides.write.mode("overwrite").parquet(path)
        return spark.read.schema(GUIDE).parquet(path)
    now = guides.select(*kept.columns)
    if not now.exceptAll(kept).isEmpty() or not kept.exceptAll(now).isEmpty():
        raise ValueError(f"{path} holds other sites: a changed dictionary needs a new folder")
    return kept


def take(batch: DataFrame, number: int, guides: DataFrame, grammar: Grammar, out: str) -> None:
    """Scan one batch of documents and write its two partitions, replacing what an earlier try has left."""
    records = batch.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("seq_id"), "source", S.from_text(F.coalesce("text", F.lit(""))).alias("seq"))
    told = records.select("seq_id", "source", F.length("seq").alias("length_bp"), F.lit(number).cast("long").alias("batch"))
    held = P.presence(records, guides, grammar).withColumn("batch", F.lit(number).cast("long"))
    for name, df in (("records", told), ("presence", held)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/{name}")
    spark = batch.sparkSession
    n = [spark.read.schema(kind).parquet(f"{out}/{name}").where(F.col("batch") == number).count() for name, kind in (("records", RECORD), ("presence", PRESENT))]
    LOG.info("batch %d: read %d documents (%d without an id), wrote %d records and %d presences to %s", number, batch.count(), batch.where("doc_id IS NULL").count(), *n, out)


def report(spark: SparkSession, guides: DataFrame, out: str) -> DataFrame:
    """guide_id, gene, n_present, n_total and conservation_fraction over the latest state of every record."""
    records = spark.read.schema(RECORD).parquet(f"{out}/records")
    latest = records.groupBy("seq_id").agg(F.max("batch").alias("batch"))
    total = latest.count()
    held = spark.read.schema(PRESENT).parquet(f"{out}/presence").join(latest, ["seq_id", "batch"], "left_semi")
    n = guides.select("guide_id", "gene").join(held.groupBy("guide_id").agg(F.count_distinct("seq_id").alias("n")), "guide_id", "left")
    present = F.coalesce("n", F.lit(0))
    return n.select("guide_id", "gene", present.alias("n_present"), F.lit(total).cast("long").alias("n_total"), F.round(present / F.nullif(F.lit(total), F.lit(0)), 6).alias("conservation_fraction"))


def run(spark: SparkSession, documents: str, benchmark: str, out: str, checkpoint: str, grammar: str = "spcas9", files_per_batch: int = 64) -> DataFrame:
    """Take what is new in documents; returns the report read back."""
    shape = GRAMMARS[grammar]
    guides = kept_sites(spark, site_table(spark.read.parquet(benchmark), shape), f"{out}/guides")
    LOG.info("read %s: %d sites", benchmark, guides.count())
    kind = spark.read.parquet(documents).schema
    for name, schema in (("records", RECORD), ("presence", PRESENT)):  # the folders exist, however little arrives
        spark.createDataFrame([], schema).write.mode("append").partitionBy("batch").parquet(f"{out}/{name}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", files_per_batch).parquet(watched(documents)).select("doc_id", "text", "source")
    query = stream.writeStream.foreachBatch(lambda df, n: take(df, n, guides, shape, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("%s: %d new batches", documents, sum(1 for p in query.recentProgress if p["numInputRows"]))
    told = report(spark, guides, out)
    told.write.mode("overwrite").partitionBy("gene").parquet(f"{out}/conservation")
    back = spark.read.schema(told.schema).parquet(f"{out}/conservation")
    LOG.info("wrote %d rows to %s/conservation", back.count(), out)
    return back


if __name__ == "__main__":
    common.main("presence_ledger", ["documents", "benchmark", "out", "checkpoint"], run)
