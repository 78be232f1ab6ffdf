"""Plumbing shared by the text operators: table reading, Arrow batches, lineage cuts."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, shared_dir

__all__ = ["annotate", "cut", "shared_dir", "shielded", "slices", "table", "threshold_sample", "tidy", "written"]
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again (columnar, so columns are pruned on rereading)."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/loom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the strings of one column stay near `most` bytes; a longer row comes alone."""
    col = batch.column(column)
    n = batch.num_rows
    if n == 0:
        return
    if col.nbytes <= most:
        yield batch
        return
    if not (pa.types.is_string(col.type) or pa.types.is_binary(col.type) or pa.types.is_large_string(col.type)):
        step = max(1, int(n * most / col.nbytes))
        yield from (batch.slice(i, step) for i in range(0, n, step))
        return
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    yield batch.slice(start)


def tidy() -> None:
    """Give freed memory back to the system, so that what a worker keeps between tasks stays small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # there on glibc only
    if trim:
        trim(0)


def annotate(
    df: DataFrame,
    text: str,
    fields: Sequence[T.StructField],
    factory: Callable[[], Callable],
    carry: Sequence[str] = (),
    inputs: Sequence[str] = (),
) -> DataFrame:
    """carry columns plus new fields for each row of df, computed over Arrow batches.

    factory() is called once in each task and returns f(texts, *inputs) -> (mask or None, list of arrays or lists);
    a mask drops rows, and the lists then hold the kept rows only.  fields may be empty: a filter.  f.close(), if there
    is one, is called when the task ends: what a reused worker keeps between tasks is then small.  Of carried columns one with
    a new field's name is left out.  The session's limit on the bytes of an Arrow batch is lowered and stays so: plans read
    it when they run.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * SLICE_BYTES))  # long texts come in small batches
    clash = {f.name.lower() for f in fields}
    carried = [c for c in carry if c.lower() not in clash]
    used = [text, *inputs]
    chosen = df.select(*[F.col(f"`{c}`").alias(f"i{k}") for k, c in enumerate(used)], *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carried)])
    schema = T.StructType([T.StructField(c, df.schema[c].dataType, True) for c in carried] + list(fields))
    n = len(used)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        f = factory()
        try:
            for whole in batches:
                for batch in slices(whole, 0):
                    mask, made = f(*[batch.column(k).to_pylist() for k in range(n)])
                    kept = [batch.column(n + k) for k in range(len(carried))]
                    if mask is not None:
                        m = pa.array(mask, pa.bool_())
                        kept = [x.filter(m) for x in kept]
                    arrays = [x if x.type == t.type else x.cast(t.type) for x, t in zip(kept, target, strict=False)]
                    arrays += [pa.array(x, t.type) for x, t in zip(made, list(target)[len(carried):], strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=target.names)
                tidy()
        finally:
            getattr(f, "close", lambda: None)()
            tidy()

    return chosen.mapInArrow(run, schema)


def shielded(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str], list[str]]:
    """docs with its columns named k0, k1, ..., those names, and the new names of `names`: no column can clash."""
    safe = [f"k{i}" for i in range(len(docs.columns))]
    return docs.toDF(*safe), safe, [safe[docs.columns.index(n)] for n in names]


def threshold_sample(df: DataFrame, key: str, bound: int, count: int) -> DataFrame:
    """About `bound` of the `count` rows of df, chosen by a hash of key, so the same rows each time."""
    if count <= bound:
        return df
    top = int(bound / count * (1 << 31))
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 31)) < top)
