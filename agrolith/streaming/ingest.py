"""Exactly-once ingest: a stream of rows upserts a table by key, with a ledger of batches.

The table is a folder in shared storage. A batch writes new versions of the partitions it touches, and no others, under its own
number, and then commits by renaming one small file into the ledger. A reader takes, of each partition, the version of the
last committed batch that wrote it. So a crash before the rename leaves nothing that is read, and the batch, run again, writes over what
it left; a batch whose number is in the ledger is skipped.

Of rows with equal keys the one with the greatest ``order`` stays (a correction is a later one), whatever order files arrive in; a row without
an order counts as the earliest, and rows equal in it are compared by their values. Rows with a null in the key are a key of their own. One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PARTITION = "_partition"


@dataclass(frozen=True)
class Ingested:
    """A table below ``path``: its columns as DDL, its key, the column that orders versions of a row, and what rows are partitioned by.

    ``partition`` is an SQL expression over the key; what a batch touches of its values is listed on the driver, so it should be
    coarse, such as a month and a hash of the environment.
    """

    spark: SparkSession
    path: str
    schema: str
    key: tuple[str, ...]
    order: str
    partition: str

    # ---- shared storage

    def _fs(self, path: str):
        sc = self.spark.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(sc._jsc.hadoopConfiguration()), target

    def _names(self, path: str) -> list[str]:
        store, target = self._fs(path)
        return [s.getPath().getName() for s in store.listStatus(target)] if store.exists(target) else []

    def _text(self, path: str) -> str:
        store, target = self._fs(path)
        stream = store.open(target)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def committed(self) -> dict[int, list[str]]:
        """Batch numbers of the ledger, and the partitions each wrote."""
        names = [n for n in self._names(f"{self.path}/ledger") if n.endswith(".json")]
        return {int(n.removesuffix(".json")): json.loads(self._text(f"{self.path}/ledger/{n}")) for n in sorted(names)}

    def _commit(self, batch: int, partitions: Sequence[str]) -> None:
        store, tmp = self._fs(f"{self.path}/ledger/_{batch}")
        _, name = self._fs(f"{self.path}/ledger/{batch}.json")
        out = store.create(tmp, True)
        try:
            out.write(bytearray(json.dumps(sorted(partitions)).encode()))
        finally:
            out.close()
        if not store.rename(tmp, name):
            raise RuntimeError(f"batch {batch} could not be committed: another writer?")

    def versions(self) -> dict[str, int]:
        """The batch that holds the current version of each partition."""
        return {p: batch for batch, own in sorted(self.committed().items()) for p in own}

    # ---- reading and writing

    def _of(self, versions: dict[str, int]) -> DataFrame:
        paths = [f"{self.path}/data/{batch}/{_PARTITION}={p}" for p, batch in sorted(versions.items())]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def table(self) -> DataFrame:
        """All rows as the last committed batch left them."""
        return self._of(self.versions())

    def _latest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.key]
        newest = F.max(F.struct(F.col(self.order).isNotNull().alias("_known"), F.col(self.order).alias("_order"), *[F.col(c) for c in rest])).alias("_newest")
        return rows.groupBy(*self.key).agg(newest).select(*self.key, *[F.col(f"_newest.{c}").alias(c) for c in rest])

    def _named(self) -> Column:
        return F.coalesce(F.expr(self.partition).cast("string"), F.lit("none"))

    def upsert(self, rows: DataFrame, batch: int) -> bool:
        """Merge a batch; False if the ledger has it already."""
        if batch in self.committed():
            return False
        columns = [c.split()[0].strip("`") for c in self.schema.split(",")]
        rows = rows.select(*columns).persist()
        try:
            touched = [r[0] for r in rows.select(self._named()).distinct().collect()]
            versions = self.versions()
            old = self._of({p: versions[p] for p in touched if p in versions})
            merged = self._latest(old.unionByName(rows)).select(*columns).withColumn(_PARTITION, self._named())
            merged.repartition(_PARTITION, *self.key[:1]).write.mode("overwrite").partitionBy(_PARTITION).parquet(f"{self.path}/data/{batch}")
        finally:
            rows.unpersist()
        self._commit(batch, touched)
        return True

    def run(self, stream: DataFrame) -> None:
        """All that the stream has for now; a later call goes on from there."""
        query = stream.writeStream.foreachBatch(lambda rows, batch: self.upsert(rows, batch) and None).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    def vacuum(self) -> int:
        """Remove versions that no reader of the current ledger takes; how many batches' folders or partitions went."""
        versions, gone = self.versions(), 0
        committed = self.committed()
        for name in self._names(f"{self.path}/data"):
            if int(name) not in committed:
                continue  # a batch at work, or one that will be written over
            for p in committed[int(name)]:
                if versions[p] != int(name):
                    store, target = self._fs(f"{self.path}/data/{name}/{_PARTITION}={p}")
                    gone += bool(store.delete(target, True))
        return gone
