"""Sharding by a keyed permutation of global row numbers, with SQL expressions alone.

Rows are numbered from 0 by id. A Feistel network over pairs (number div b, number mod b) permutes 0 .. a*b - 1, where
a*b is a little more than the number of rows n; numbers that land at n or beyond go through the network again until
they land below (cycle walking), which keeps it a permutation of 0 .. n - 1. The permuted number gives shard (mod the
number of shards) and slot (div), so shard sizes differ by one row at most, and both can be computed for any row number.

Defined results: null ids come first; rows with equal ids are ordered by text checksum and size, and rows equal in
these too are interchangeable; a null text has checksum and size of an empty one; an empty table gives no rows.
"""

from __future__ import annotations

import math
from struct import pack

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from agrolith.llm.common import RangeBuckets, shuffle_partitions

ROUNDS = 6


def domain(n: int) -> tuple[int, int]:
    """Factors (a, b), both near the root of n, with the least product from n on among some hundred choices."""
    root = max(1, math.isqrt(n))
    return min(((a, -(-n // a)) for a in range(max(1, root - 50), root + 51)), key=lambda ab: (ab[0] * ab[1], abs(ab[0] - ab[1])))


def _hashed(x: int, seed: int, i: int) -> int:
    """Spark's xxhash64 of the row (x, round key), signed."""
    h = xxh64_intdigest(pack("<q", seed * ROUNDS + i), xxh64_intdigest(pack("<q", x), 42))
    return h - (1 << 64) if h >> 63 else h


def feistel(x: int, a: int, b: int, seed: int) -> int:
    """The network for one number, in Python: for lookups and tests."""
    left, right = divmod(x, b)
    for i in range(ROUNDS):
        if i % 2 == 0:
            left = (left + _hashed(right, seed, i) % a) % a
        else:
            right = (right + _hashed(left, seed, i) % b) % b
    return left * b + right


def permuted(x: int, n: int, seed: int) -> int:
    a, b = domain(n)
    x = feistel(x, a, b, seed)
    while x >= n:
        x = feistel(x, a, b, seed)
    return x


def feistel_expr(x: Column, a: int, b: int, seed: int) -> Column:
    """The network as an expression, for numbers below 2^53. Each round refers to either half once, so it stays small."""
    left, right = ((x - x % b) / b).cast("bigint"), (x % b).cast("bigint")
    for i in range(ROUNDS):
        key = F.lit(seed * ROUNDS + i).cast("bigint")
        if i % 2 == 0:
            left = (left + F.pmod(F.xxhash64(right, key), F.lit(a))) % a
        else:
            right = (right + F.pmod(F.xxhash64(left, key), F.lit(b))) % b
    return left * b + right


def permuted_expr(x: Column, n: int, seed: int) -> Column:
    """Cycle walking: at most a*b - n further steps, as many numbers as lie outside; only rows outside take any."""
    a, b = domain(n)
    y = feistel_expr(x, a, b, seed)
    if a * b == n:
        return y
    steps = F.sequence(F.lit(1), F.lit(a * b - n))
    return F.when(y < n, y).otherwise(F.aggregate(steps, y, lambda z, _: F.when(z < n, z).otherwise(feistel_expr(z, a, b, seed))))


def numbered(df: DataFrame, key: str, ties: list[str]) -> tuple[DataFrame, int]:
    """The rows with ``row_number`` from 0 by key, and how many there are.

    Ranges of the key are numbered one by one from the sum of the counts before them; only ranges and counts come to the driver.
    """
    ranges = RangeBuckets(df, key, 2 * shuffle_partitions(df.sparkSession))
    bucket = ranges.expr(F.col(key))
    counts = {r["b"]: r["count"] for r in df.select(bucket.alias("b")).groupBy("b").count().collect()}
    bases, n = [], 0
    for b in range(ranges.count):
        bases.append(n)
        n += counts.get(b, 0)
    order = Window.partitionBy("_bucket").orderBy(F.col(key).asc_nulls_first(), *ties)
    base = F.get(F.array(*[F.lit(x).cast("bigint") for x in bases]), F.col("_bucket"))
    return df.withColumn("_bucket", bucket).withColumn("row_number", base + F.row_number().over(order) - 1).drop("_bucket"), n


def shard(df: DataFrame, shards: int, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, row_number, shard, slot of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, n = numbered(slim, "doc_id", ["text_crc32", "size"])
    if not n:
        return rows.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    rows = rows.withColumn("_p", permuted_expr(F.col("row_number"), n, seed))
    return rows.select("doc_id", "size", "text_crc32", "row_number", (F.col("_p") % shards).cast("int").alias("shard"), F.floor(F.col("_p") / shards).cast("long").alias("slot"))
