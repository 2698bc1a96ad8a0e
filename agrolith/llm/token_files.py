"""Token-ID files: flat unsigned integers and 64-bit document offsets, read back through memory maps.

A dataset is a folder of shards. Shard ``k`` holds documents of one range of ids in ascending order:

* ``k.bin``: the ids of all its documents, end ids included, little-endian, 16 bits each where the vocabulary
  has at most 65,536 entries and else 32;
* ``k.idx``: one more 64-bit offset than documents, counted in ids from the shard's start;
* ``k.doc``: the 64-bit document ids (the least 64-bit integer stands for a null id);
* ``bases.json``: the ids before each shard, prefix sums over the shards' totals.

The folder must be reachable by file path from every executor (a shared mount), as memory maps need one.

Defined results: a null or empty text has the end id alone; a null document id sorts first; repeated ids and
rows keep a row each, ties in id ordered by a hash of the text, so an id that many texts share is cut into ranges as well; an
empty table gives a dataset without shards. Columns other than id and text are ignored.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolith.llm.common import bounded_batches, shared_dir, shuffle_partitions, trimmed
from agrolith.llm.encode import encoder

NULL_ID = -(2**63)
_FLUSH = 8 << 20


@dataclass(frozen=True)
class TokenDataset:
    path: str
    dtype: str
    #: (shard, documents, ids, ids before it), in order; one entry for each write task.
    shards: list[tuple[int, int, int, int]]


def local_path(uri: str) -> str:
    """The file path of a folder given as a path or file:// URI."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"token files are memory-mapped and need a mounted folder, not {uri}")
    return unquote(parts.path)


def new_folder(spark: SparkSession) -> str:
    return os.path.join(local_path(shared_dir(spark)), f"tokens-{uuid.uuid4().hex}")


def write_tokens(df: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> TokenDataset:
    """Encode and write a dataset. Each task writes under names of its own attempt and renames them, so a repeated task leaves one shard."""
    from tokenizers import Tokenizer

    spark = df.sparkSession
    dtype = "<u2" if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    os.makedirs(path, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, encode, end = task.partitionId(), encoder(tokenizer_path).encode, np.array([end_id], dtype=dtype).tobytes()
        attempt = os.path.join(path, f"_{shard:06d}-{task.taskAttemptId()}")
        docs = total = 0
        with open(f"{attempt}.bin", "wb") as ids_file, open(f"{attempt}.idx", "wb") as idx, open(f"{attempt}.doc", "wb") as doc_file:
            idx.write(np.zeros(1, "<i8").tobytes())
            for batch in bounded_batches(batches):
                own = encode(batch.column(1).to_pylist())
                ends = total + np.cumsum(np.fromiter((len(x) // 4 + 1 for x in own), "<i8", len(own)))
                for x in own:
                    ids_file.write(np.frombuffer(x, "<u4").astype(dtype).tobytes())
                    ids_file.write(end)
                idx.write(ends.astype("<i8").tobytes())
                doc_file.write(np.array([NULL_ID if x is None else x for x in batch.column(0).to_pylist()], "<i8").tobytes())
                docs, total = docs + len(own), int(ends[-1])
        for kind in ("bin", "idx", "doc"):
            os.replace(f"{attempt}.{kind}", os.path.join(path, f"{shard:06d}.{kind}"))
        yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [docs], "ids": [total]})

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    order = (F.col("id").asc_nulls_first(), F.col("tie"))
    ordered = rows.repartitionByRange(shards or shuffle_partitions(spark), *order).sortWithinPartitions(*order).drop("tie")
    found = sorted(tuple(r) for r in ordered.mapInArrow(trimmed(write), "shard long, docs long, ids long").collect())
    for name in os.listdir(path):
        if name.startswith("_"):  # of a task that failed or came second
            os.remove(os.path.join(path, name))
    base, out = 0, []
    for shard, docs, ids in found:
        if docs:
            out.append((shard, docs, ids, base))
            base += ids
    with open(os.path.join(path, "bases.json"), "w") as f:
        json.dump({"dtype": dtype, "end_id": end_id, "shards": out}, f)
    return TokenDataset(path, dtype, out)


def open_tokens(path: str) -> TokenDataset:
    with open(os.path.join(path, "bases.json")) as f:
        kept = json.load(f)
    return TokenDataset(path, kept["dtype"], [tuple(x) for x in kept["shards"]])


def read_tokens(spark: SparkSession, data: TokenDataset) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit), a row for each document."""
    path, dtype = data.path, data.dtype
    schema = "doc_id long, start long, n_tokens long, ids binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                name = os.path.join(path, f"{x['shard']:06d}")
                ids, at, docs = (np.memmap(f"{name}.{kind}", t, "r") for kind, t in (("bin", dtype), ("idx", "<i8"), ("doc", "<i8")))
                first = 0
                while first < len(docs):
                    last = max(first + 1, int(np.searchsorted(at, at[first] + _FLUSH // 4, "right")) - 1)
                    last = min(last, len(docs))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([None if d == NULL_ID else d for d in docs[first:last].tolist()], pa.int64()),
                            "start": pa.array(x["base"] + at[first:last]),
                            "n_tokens": pa.array(np.diff(at[first : last + 1])),
                            "ids": pa.array([ids[at[i] : at[i + 1]].astype("<u4").tobytes() for i in range(first, last)], pa.binary()),
                        }
                    )
                    first = last

    if not data.shards:
        return spark.createDataFrame([], schema)
    shards = spark.createDataFrame(data.shards, "shard long, docs long, n long, base long")
    return shards.repartitionByRange(len(data.shards), "shard").mapInArrow(read, schema)
