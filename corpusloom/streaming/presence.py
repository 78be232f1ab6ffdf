"""Incremental presence: new records are looked up in a static dictionary as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.grammar import Grammar
from ..functions.sequences import revcomp
from ..operators.presence import sized_broadcast
from ..operators.sites import distinct_sites


def read_records(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of (seq_id, seq) from Parquet files that are added to a folder."""
    return spark.readStream.schema("seq_id long, seq string").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def presence_counts(records: DataFrame, guides: DataFrame, grammar: Grammar) -> DataFrame:
    """Running (guide_id, n_present) over a stream of records.

    A record is one row, and its windows are made distinct inside it; a palindromic target is one guide however it lies.  Counts of
    records are approximate (a relative deviation of about 0.01): a stream cannot count distinct ones exactly.  jobs/presence_ledger.py keeps exact ones.
    """
    both = guides.select("guide_id", F.explode(F.array(F.col("target"), revcomp(F.col("target")))).alias("kmer")).groupBy("kmer").agg(F.collect_set("guide_id").alias("ids"))
    found = distinct_sites(records.select("seq_id", "seq"), "seq", grammar).join(sized_broadcast(both), "kmer")
    each = found.select("seq_id", F.explode("ids").alias("guide_id"))
    return each.groupBy("guide_id").agg(F.approx_count_distinct("seq_id", 0.01).alias("n_present"))


def start(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the counts in a table in memory, with progress in a shared folder."""
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def windowed_events(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events by window and type; events later than the watermark are dropped, and old state with them."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: events no further apart than gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
