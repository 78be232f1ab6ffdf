"""A paged record catalogue as a Python data source, and the predicates that select from it.

The remote service is a folder of pages here (`page-<n>.json`, one record on each line); a service with the same paging
is read by giving another `fetch`.  Each page is an input partition, so pages are fetched by executors and a failed task
fetches its page again.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SCHEMA = "uid string, taxid long, length_bp long, title string, record_class string"


def selection(taxid: int, least: int, most: int, include_partial: bool = False) -> Column:
    """Records of a taxon in a length range, complete by title unless partial ones are wanted, patents left out."""
    title = F.lower("title")
    ok = (F.col("taxid") == taxid) & F.col("length_bp").between(least, most) & ~F.contains(title, F.lit("patent"))
    return ok if include_partial else ok & F.contains(title, F.lit("complete"))


def with_retries(call: Callable[[], object], tries: int = 4, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> object:
    """call(), again after wait, 2 wait, 4 wait, ... seconds on an OSError; the last error is raised."""
    for k in range(tries):
        try:
            return call()
        except OSError:
            if k == tries - 1:
                raise
            sleep(wait * 2**k)
    raise AssertionError("unreachable")


class RateLimiter:
    """Keeps calls at least `interval` seconds apart."""

    def __init__(self, interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep, self.next = interval, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(now, self.next) + self.interval


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.interval = options["path"], float(options.get("interval", "0"))

    def partitions(self):
        pages = sorted(f for f in os.listdir(self.path) if f.startswith("page-") and f.endswith(".json"))
        return [InputPartition(p) for p in pages] or [InputPartition("")]

    def read(self, partition) -> Iterator[tuple]:
        if not partition.value:
            return
        RateLimiter(self.interval).wait()
        path = os.path.join(self.path, partition.value)

        def lines():
            with open(path, encoding="utf-8") as f:
                return f.readlines()

        for line in with_retries(lines):
            r = json.loads(line)
            yield tuple(r.get(k) for k in ("uid", "taxid", "length_bp", "title", "record_class"))


class PagedCatalogue(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_catalogue"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue's records, each uid once."""
    spark.dataSource.register(PagedCatalogue)
    return spark.read.format("paged_catalogue").option("path", path).load().dropDuplicates(["uid"])


def tagged_corpus(catalogue: DataFrame, queries: list[tuple[str, Column]], limit: int | None = None) -> DataFrame:
    """The union of filtered scans with a class tag; at most `limit` records of each class, by uid."""
    from pyspark.sql import Window as W

    out = None
    for name, rule in queries:
        part = catalogue.where(rule).withColumn("record_class", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if limit is None:
        return out
    return out.withColumn("_n", F.row_number().over(W.partitionBy("record_class").orderBy("uid"))).where(F.col("_n") <= limit).drop("_n")


def missing(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Wanted uids that are not cached, with or without their version suffix."""
    bare = lambda c: F.regexp_replace(c, r"\.\d+$", "")
    return wanted.join(cached.select(bare("uid").alias("_b")).distinct(), bare(F.col("uid")) == F.col("_b"), "left_anti")


def fetch_by_id(ids: DataFrame, fetch: Callable[[list[str]], Iterable[dict]], schema: StructType, batch: int = 200, interval: float = 0.0) -> DataFrame:
    """Rows that a service returns for ids (uid), asked on executors for at most `batch` uids at a time.

    A null uid is not asked for and a repeated one only once; each task keeps its calls `interval` seconds apart.
    """
    layout = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        limit = RateLimiter(interval)
        for b in batches:
            uids = b.column(0).to_pylist()
            for at in range(0, len(uids), batch):
                limit.wait()
                some = uids[at : at + batch]
                yield pa.RecordBatch.from_pylist(with_retries(lambda some=some: list(fetch(some))), schema=layout)

    return ids.select("uid").where("uid IS NOT NULL").distinct().mapInArrow(run, schema)


def cached_records(manifest: DataFrame, folder: str, suffix: str = ".fasta") -> DataFrame:
    """Rows of a manifest (uid) whose file `<uid><suffix>` lies in the folder; files are listed, not read."""
    files = manifest.sparkSession.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    held = files.select(F.regexp_extract("path", r"([^/]+)" + re.escape(suffix) + "$", 1).alias("uid"))
    return manifest.join(held, "uid", "left_semi")
