"""Session settings, shared storage and row numbering used by several operators."""

from __future__ import annotations

import ctypes
import math
import re
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session in one process (tests) gets a new local folder; on a cluster it is an error, as executors
    would write to their own disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        path = sc.getCheckpointDir()
        if not path and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = path or f"file://{tempfile.mkdtemp(prefix='agrolith-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder: survives the loss of executors and cuts lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, whatever store it is in."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of passage in the shared folder, for a ``with`` block; at its end their files go.

    What leaves the block must not read them any more: checkpoint it first.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.path)

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        """Like checkpoint, as Parquet: later readers take single columns."""
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Let the session hand Python at most 8 MB at once, unless it was told otherwise: texts differ much in length, and a task
    holds a batch several times over, outside the JVM's heap.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if (spark.conf.get(name, None) or "").rstrip("b") == str(64 << 20):  # Spark's own
        spark.conf.set(name, str(8 << 20))


def bounded_batches(batches: Iterable[pa.RecordBatch], max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that none holds many more bytes than asked for, whatever the rows' sizes."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, batch.num_rows * max_bytes // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)


def drop_caches() -> None:
    """Let go of what tasks of other operators remember in this Python worker, which Spark uses again for later stages."""
    encode = sys.modules.get("agrolith.llm.encode")
    if encode is not None:
        encode.encoder.cache_clear()
    pa.default_memory_pool().release_unused()


def trimmed(run):
    """A task's function that gives free memory back to the system at its end: Python workers stay, idle, beside later stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim is not None:
                trim(0)

    return task


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of passage, with underscores until no column of the input has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


class RangeBuckets:
    """Ranges of a numeric key with near equal row counts; cuts are values that occur, at most ``n - 1`` of them.

    The cuts come from one pass over the key column. A null key sorts below every value, into bucket 0.
    """

    def __init__(self, df: DataFrame, key: str, n: int):
        n = max(1, n)
        share = [i / n for i in range(1, n)]
        found = df.agg(F.percentile_approx(key, share or [0.5], max(10_000, 20 * n)).alias("cuts"), F.max(key).alias("top")).first()
        self.key, self.top = key, found["top"]
        self.cuts = sorted({c for c in (found["cuts"] or []) if share and c != found["top"]})

    @property
    def count(self) -> int:
        return len(self.cuts) + 1

    def expr(self, key: Column) -> Column:
        """Number of cuts below the key, found by a two-level search over literal arrays."""
        if not self.cuts:
            return F.lit(0)
        width = math.isqrt(len(self.cuts)) + 1
        blocks = [self.cuts[i : i + width] for i in range(0, len(self.cuts), width)]
        ends = F.array(*[F.lit(b[-1]).cast("bigint") for b in blocks])
        inner = F.array(*[F.array(*[F.lit(c).cast("bigint") for c in b]) for b in blocks])
        block = F.size(F.filter(ends, lambda c: c < key))
        rest = F.size(F.filter(F.coalesce(F.get(inner, block), F.array().cast("array<bigint>")), lambda c: c < key))
        return F.when(key.isNull(), 0).otherwise(F.least(block * width + rest, F.lit(len(self.cuts)))).cast("int")
