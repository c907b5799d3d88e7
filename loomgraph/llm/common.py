"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: str.translate table that lower-cases A-Z alone.
TO_LOWER = str.maketrans(UPPER, LOWER)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; lower() is faster and gives the same where all characters are one byte."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. The cluster names it in spark.checkpoint.dir; a temporary one is
    made only where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not found.isDefined():
            sc.setCheckpointDir(named)
        return named
    if found.isDefined():
        return found.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="loomgraph-")
    sc.setCheckpointDir(made)
    return made


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table through the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write a table once as Parquet in the shared folder and read it again: later branches read only the
    columns they need, and a lost executor costs no recomputation. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.parquet(path)


#: Rows of ids or keys that may be broadcast, a few million bytes; more of them are shuffled.
MOST_SENT = 100_000


def few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A table of narrow rows, marked for a broadcast if it is small enough."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= MOST_SENT else df


def free(spark: SparkSession) -> None:
    """Shuffle files of finished jobs stay on the executors until the driver collects its garbage; it does so now.
    For use after a phase that shuffles much."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:  # stopped before
        return
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds about `most` bytes of text, or one row."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        size = batch.column(batch.schema.get_field_index(column)).nbytes
        step = max(1, rows * most // max(size, 1))
        for at in range(0, rows, step):
            yield batch.slice(at, step)


def aside(docs: DataFrame) -> DataFrame:
    """text, and all other columns in one row under names of their own: what an operator adds cannot clash with them, and
    no name (with dots, blanks, quotes, or twins in another case) is ever read."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    others = [f"c{i}" for i, c in enumerate(names) if c != "text"]
    return plain.select(F.struct(*others, F.lit(None).cast("boolean").alias("none")).alias("row"), F.col(f"c{names.index('text')}").alias("text"))


def restored(df: DataFrame, columns: list[str], text: Column | str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """The columns that aside() put away, with a text, and `more` columns of df."""
    text = F.col(text) if isinstance(text, str) else text
    return df.select(*[text.alias(c) if c == "text" else F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(columns)], *more)


_trim = None


#: Bytes of a batch that goes to a Python worker; a longer row goes alone.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound the bytes of the session's Arrow batches, unless a smaller bound is set."""
    found = spark.conf.get(_BATCH).rstrip("b")
    if found.isdigit() and int(found) > most:
        spark.conf.set(_BATCH, str(most))


def map_batches(df: DataFrame, find: Callable, schema: str | StructType, *caches: dict) -> DataFrame:
    """mapInArrow with batches bounded by bytes, not by rows alone, and workers that give their memory back.

    Workers are kept from stage to stage; what one operator has cached is of no use to the next one, so the caches
    are cleared when a task ends. A session with a smaller bound keeps it; otherwise the bound is set for the session and
    stays, as plans read it when they run.
    """
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from find(batches)
        finally:
            for c in caches:
                c.clear()
            release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Return freed memory to the system."""
    global _trim
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is None:
        _trim = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)
    _trim(0)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Whole texts, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
