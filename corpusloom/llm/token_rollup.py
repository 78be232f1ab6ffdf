"""Token-count rollups kept up to date by signed deltas.

A ledger in a shared folder holds, for each committed batch, signed rows (document, source, language, tokenizer version,
tokens, sign) and their sum by source, language and version.  An insert adds rows; a delete takes a document's present
rows back; a revision takes them back and adds the new ones.  Totals are the sum of the committed deltas.  A batch is
written under its own name and counts only once its commit marker, written last, is there: a batch that fails half-way
leaves nothing that is read, and one that is sent again does nothing.  `compact` sums the committed batches into a
snapshot, named by a marker that lists them and is written last; then their own files go, and their names stay committed.

Cases: nulls in the document key, source, language and version are values of their own (compared null-safe); null token
counts count as zero; an empty batch commits and changes nothing; a document inserted twice counts twice and is deleted
as a whole; texts of any length are counted by built-in functions where they are read; other columns are not read, so none
can clash; an empty table gives no totals; a delete or revision of an unknown document takes nothing back (a revision then inserts); in one batch, all
deletes and revisions see the state before the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = ["doc_id", "source", "lang", "version", "tokens"]
GROUP = ["source", "lang", "version"]


class TokenLedger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, sub: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{sub}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def committed(self) -> list[str]:
        fs, path = self._fs("commits")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """The last whole snapshot, and the batches that it holds."""
        fs, path = self._fs("snapshots")
        names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
        if not names:
            return None, set()
        return names[-1], {r.value for r in self.spark.read.text(f"{self.path}/snapshots/{names[-1]}").collect()}  # a line for each batch

    def _read(self, kind: str, schema: str) -> DataFrame:
        name, held = self._snapshot()
        parts = [f"{kind}-{name}"] if name else []
        parts += [f"{kind}/{b}" for b in self.committed() if b not in held]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in parts])

    def compact(self, key_type: str = "bigint") -> None:
        """Put the sums of all committed batches into one snapshot and delete what it replaces."""
        before, held = self._snapshot()
        batches = self.committed()
        if set(batches) <= held:
            return
        name = f"{len(batches):09d}"
        present = self.rows(key_type).withColumn("sign", F.col("copies").cast("int")).select(*ROW, "sign")
        present.write.mode("overwrite").parquet(f"{self.path}/log-{name}")
        self.totals().write.mode("overwrite").parquet(f"{self.path}/deltas-{name}")
        fs, marker = self._fs(f"snapshots/{name}")
        fs.mkdirs(marker.getParent())
        _, draft = self._fs(f"draft-{name}")
        out = fs.create(draft, True)
        out.write(bytearray("\n".join(batches).encode()))
        out.close()
        fs.rename(draft, marker)  # whole or not at all
        for old in [f"{k}/{b}" for k in ("log", "deltas") for b in batches] + [f"{k}-{before}" for k in ("log", "deltas") if before]:
            fs.delete(self._fs(old)[1], True)

    def rows(self, key_type: str = "bigint") -> DataFrame:
        """Present rows with their multiplicity `copies`."""
        log = self._read("log", f"doc_id {key_type}, source string, lang string, version string, tokens bigint, sign int")
        return log.groupBy(*ROW).agg(F.sum("sign").alias("copies")).where("copies > 0")

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens of all committed batches; groups that came to nothing are left out."""
        deltas = self._read("deltas", "source string, lang string, version string, docs bigint, tokens bigint")
        return deltas.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def apply(self, batch: str, events: DataFrame) -> bool:
        """Commit events (op, doc_id, source, lang, version, tokens) once; False if `batch` was committed before.

        op is insert, delete (version null: all versions) or revise.
        """
        if batch in self.committed():
            return False
        events = events.select("op", "doc_id", "source", "lang", "version", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
        added = events.where(F.col("op").isin("insert", "revise")).select(*ROW, F.lit(1).alias("sign"))
        signed = added
        if self.committed():
            gone = events.where(F.col("op").isin("delete", "revise")).select(F.col("doc_id").alias("d"), F.col("version").alias("v")).distinct()
            same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("v").isNull() | (F.col("version") == F.col("v")))
            present = self.rows(dict(events.dtypes)["doc_id"])
            taken = present.join(gone, same, "left_semi").select(*ROW, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("n"))
            signed = added.unionByName(taken.select(*ROW, F.lit(-1).alias("sign")))
        signed.write.mode("overwrite").parquet(f"{self.path}/log/{batch}")
        log = self.spark.read.schema(signed.schema).parquet(f"{self.path}/log/{batch}")
        delta = log.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("docs"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        delta.write.mode("overwrite").parquet(f"{self.path}/deltas/{batch}")
        fs, marker = self._fs(f"commits/{batch}")
        fs.mkdirs(marker.getParent())
        fs.create(marker, True).close()
        return True


#: version -> tokens of a text column; a null text has none.
COUNTERS: dict[str, str] = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-2": r"[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]"}


def counted(docs: DataFrame, text: Column, counters: dict[str, str] | None = None, key: str = "doc_id") -> DataFrame:
    """doc_id, source, lang, version, tokens: one row for each row of docs and version."""
    chosen = COUNTERS if counters is None else counters
    each = F.array(*[F.struct(F.lit(v).alias("version"), counter(text, p).alias("tokens")) for v, p in chosen.items()])
    return docs.select(F.col(key).alias("doc_id"), "source", "lang", F.explode(each).alias("c")).select("doc_id", "source", "lang", "c.version", "c.tokens")


def counter(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def events(op: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(op).alias("op"), *ROW)


def deletes(keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Delete events for all versions of the keys."""
    empty = F.lit(None).cast("string")
    return keys.select(F.lit("delete").alias("op"), F.col(key).alias("doc_id"), empty.alias("source"), empty.alias("lang"), empty.alias("version"), F.lit(0).cast("long").alias("tokens"))
