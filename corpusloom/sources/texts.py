"""Sources and sinks of sequence text: multi-record files, tables with tabs, annotation lines, checksums."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def split_fasta(blobs: DataFrame, text: str) -> DataFrame:
    """(seq_id, seq): the records of multi-record texts.  An id is the header's first word; of equal ids the last wins."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), "\n>")
    each = blobs.select(F.monotonically_increasing_id().alias("_b"), F.posexplode(parts).alias("_i", "part")).where("_i > 0")
    head = F.regexp_extract("part", r"^(\S*)", 1)
    body = F.upper(F.regexp_replace(F.regexp_replace("part", r"^[^\n]*(\n|$)", ""), r"(?m)^>.*$|\s", ""))
    rows = each.select("_b", "_i", head.alias("seq_id"), body.alias("seq"))
    return rows.groupBy("seq_id").agg(F.max_by("seq", F.struct("_b", "_i")).alias("seq"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, seq) of FASTA files, split at the record mark while reading, so a file need not fit a task."""
    lines = spark.read.text(path, lineSep="\n>")
    part = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(part, r"^(\S*)", 1)
    return lines.where(F.length("value") > 0).select(head.alias("seq_id"), F.upper(F.regexp_replace(F.regexp_replace(part, r"^[^\n]*(\n|$)", ""), r"\s", "")).alias("seq"))


def load_sequence(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq): each file as one sequence, headers dropped, records joined."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("path"), F.upper(F.regexp_replace("value", r"(?m)^>.*$|\s", "")).alias("seq"))


def completeness(title: Column) -> Column:
    low = F.lower(title)
    return F.when(F.contains(low, F.lit("complete")), "complete").when(F.contains(low, F.lit("partial")), "partial").otherwise("unstated")


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with tabs and a header; an empty field is null."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, nullValue="")


def write_tsv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """One file with tabs and a header; for result tables, which are small."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown text; one of over `most` rows is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of over {most} rows is none to print")
    show = lambda v: "" if v is None else f"{v:g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)])


def namespaced(path: str, tag: str) -> str:
    """A path of its own for a configuration."""
    stem, dot, end = path.rpartition(".")
    return f"{stem}.{tag}.{end}" if dot and "/" not in end else f"{path}.{tag}"


def read_annotation(spark: SparkSession, path: str, features: Sequence[str] = ("gene", "exon", "CDS")) -> DataFrame:
    """(feature, chrom, start, end, strand, name) of GTF lines; the name is gene_name, else gene_id."""
    schema = "chrom string, origin string, feature string, start long, end long, score string, strand string, frame string, attributes string"
    lines = spark.read.csv(path, sep="\t", comment="#", schema=schema, quote="")
    return annotation_rows(lines).where(F.col("feature").isin(*features))


def annotation_rows(lines: DataFrame) -> DataFrame:
    from ..functions.sequences import gtf_attribute

    name = F.coalesce(F.nullif(gtf_attribute(F.col("attributes"), "gene_name"), F.lit("")), gtf_attribute(F.col("attributes"), "gene_id"))
    return lines.select("feature", "chrom", "start", "end", "strand", name.alias("name"))


def parse_checksums(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, sum, blocks) of lines `sum blocks name`; other lines are skipped."""
    p = F.split(F.trim(F.col(column)), r"\s+")
    return lines.where(F.size(p) == 3).select(p[2].alias("name"), p[0].try_cast("int").alias("sum"), p[1].try_cast("long").alias("blocks")).where("sum is not null and blocks is not null")


def rotating_sum(data: bytes) -> int:
    """The 16-bit checksum that rotates right by one before each byte is added."""
    total = 0
    for b in data:
        total = ((total >> 1) + ((total & 1) << 15) + b) & 0xFFFF
    return total


def checksums(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, sum, blocks of 1024 bytes) of binary contents; the sum is sequential, so it runs in an Arrow pass."""
    schema = T.StructType([files.schema[key], T.StructField("sum", T.IntegerType()), T.StructField("blocks", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            raw = [x or b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([rotating_sum(x) for x in raw], pa.int32()), pa.array([-(-len(x) // 1024) for x in raw], pa.int64())], names=[key, "sum", "blocks"])

    return files.select(key, content).mapInArrow(run, schema)


def segments(features: DataFrame, wanted: Sequence[str], feature: str = "CDS") -> tuple[DataFrame, DataFrame]:
    """Rows of the wanted genes and the wanted names that were not found.

    features: type, names (array, gene first, then synonyms), parts (array of start0, end, strand).  The first name
    that is wanted counts, in any case; each part is a row, in the order of gene, start and end.
    """
    low = features.sparkSession.createDataFrame([(w.lower(), w) for w in wanted], "low string, gene string")
    table = F.create_map(*[F.lit(x) for w in wanted for x in (w.lower(), w)])
    hit = F.filter(F.transform("names", lambda n: F.try_element_at(table, F.lower(n))), lambda x: x.isNotNull())
    rows = features.where(F.col("type") == feature).withColumn("gene", F.try_element_at(hit, F.lit(1))).where("gene is not null")
    out = rows.select("gene", F.explode("parts").alias("p")).select("gene", "p.*").orderBy("gene", "start0", "end")
    return out, low.select("gene").join(out.select("gene"), "gene", "left_anti")


def chunked(cache: DataFrame, name: str, seq: str, size: int = 1 << 20) -> DataFrame:
    """(name, chunk, offset, codes): long sequences as rows of bounded size, to be written with partitionBy("name")."""
    at = cache.withColumn("offset", F.explode(F.sequence(F.lit(0), F.greatest(F.length(seq) - 1, F.lit(0)), F.lit(size))))
    return at.select(name, (F.col("offset") / size).cast("int").alias("chunk"), F.col("offset").cast("long").alias("offset"), F.translate(F.upper(F.substring(F.col(seq), F.col("offset") + 1, F.lit(size))), "ACGT", "0123").alias("codes"))


def running_offsets(index: DataFrame, order: str, length: str) -> DataFrame:
    """index with the start of each sequence in their concatenation (the index is small)."""
    w = W.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return index.withColumn("start", F.sum(length).over(w) - F.col(length))


def cached_text(spark: SparkSession, path: str, fetch: Callable[[], str], valid: Callable[[str], bool], refresh: bool = False) -> DataFrame:
    """One row (value): a record's text as stored whole at `path`, else as fetched and stored there; an invalid one is an error and not stored."""
    done = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if refresh or not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        text = fetch()
        if not valid(text):
            raise ValueError(f"unexpected content for {path}")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.schema("value string").parquet(path)
