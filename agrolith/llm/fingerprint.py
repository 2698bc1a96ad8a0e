"""Document fingerprints by one-permutation MinHash, with SQL expressions alone.

The shingles (five words) of a text are hashed once. The leading bits of a hash name a bin, and each bin keeps its least
hash. An empty bin takes the value of a bin that is not empty: every bin has an order of all bins of its own, some drawn
bins and then all by a universal hash with factors of its own, and the first filled one lends (optimal densification). Of each bin's value the low bits are
packed. The share of equal bins, corrected for equality by chance, estimates the Jaccard similarity of the shingle sets.

Words are what white space separates, in lower case. Defined results: a text of fewer words than a shingle has one
shingle of all its words; a null, empty or blank text has one reserved shingle; equal texts have equal fingerprints;
repeated rows keep a row each; an empty table gives no rows.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolith.llm.common import RangeBuckets, fresh, shuffle_partitions

#: Modulus of the hash that gives each empty bin its order of bins.
_PRIME = 65_537
#: So many bins an empty bin tries first, one by one; few need the rest of their order.
_TRIES = 8


@dataclass(frozen=True)
class Settings:
    #: The base-2 logarithm of the number of bins.
    bin_bits: int = 7
    #: Low-order bits kept of each bin, packed as hexadecimal digits: 4, 8, 12 or 16.
    kept_bits: int = 8
    words: int = 5

    @property
    def bins(self) -> int:
        return 1 << self.bin_bits


def with_fingerprint(df: DataFrame, text: Column, name: str, settings: Settings = Settings()) -> DataFrame:
    """All columns of the input and the packed fingerprint of a text, as hexadecimal digits.

    Steps are separate projections: what is used more than once is then computed once for each row.
    """
    w, bins, digits = settings.words, settings.bins, settings.kept_bits // 4
    shift, low = 64 - settings.bin_bits, (1 << 64 - settings.bin_bits) - 1
    kept = [c for c in df.columns if c != name]
    h, s, f, g, filled = fresh(df, "_hashes", "_sorted", "_first", "_bins", "_filled")
    words = F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r")), r"\s+")
    df = df.select(*kept, F.transform(words, lambda x: F.xxhash64(x)).alias(h))
    windows = F.transform(F.sequence(F.lit(0), F.size(h) - w), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(w)]))
    shingles = F.when(F.size(h) < w, F.array(F.xxhash64(h))).otherwise(windows)
    # The greatest hash of each bin stands for an empty one, so the first of each bin in sorted order are all bins in order.
    greatest = F.array(*[F.lit((((b << shift) | low) ^ 1 << 63) - (1 << 63)).cast("bigint") for b in range(bins)])
    df = df.select(*kept, F.sort_array(F.concat(shingles, greatest)).alias(s))
    first = F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, shift) != F.shiftright(F.get(s, i - 1), shift)))
    df = df.select(*kept, first.alias(f))
    df = df.select(*kept, F.transform(f, lambda x: F.when(x.bitwiseAND(low) != low, x)).alias(g))
    df = df.select(*kept, g, F.array_compact(F.transform(g, lambda x, i: F.when(x.isNotNull(), i.cast("bigint")))).alias(filled))
    rng = random.Random(bins)
    drawn = lambda most, kind: F.array(*[F.lit(rng.randrange(1, most)).cast(kind) for _ in range(bins)])
    factor, offset, tries = drawn(_PRIME, "bigint"), drawn(_PRIME, "bigint"), [drawn(bins, "int") for _ in range(_TRIES)]
    hexes = F.split(F.lit(",".join(f"{x:0{digits}x}" for x in range(1 << settings.kept_bits))), ",")

    def lender(i: Column) -> Column:
        order = F.transform(filled, lambda c: ((c + 1) * F.get(factor, i) + F.get(offset, i)) % _PRIME * bins + c)
        return F.get(g, (F.array_min(order) % bins).cast("int"))

    def value(x: Column, i: Column) -> Column:
        own = F.coalesce(x, *[F.get(g, (i + F.get(t, i)) % bins) for t in tries], lender(i), F.lit(0))
        return F.get(hexes, own.bitwiseAND((1 << settings.kept_bits) - 1).cast("int"))

    return df.select(*kept, F.array_join(F.transform(g, value), "").alias(name))


def likeness(a: Column, b: Column, settings: Settings = Settings()) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1; null if either is null."""
    n, digits = settings.bins, settings.kept_bits // 4
    at = F.array(*[F.lit(1 + digits * i) for i in range(n)])
    same = F.aggregate(F.transform(at, lambda i: (F.substring(a, i, F.lit(digits)) == F.substring(b, i, F.lit(digits))).cast("int")), F.lit(0), lambda x, y: x + y)
    chance = 2.0**-settings.kept_bits
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), (same / n - chance) / (1 - chance)))


def with_next(df: DataFrame, key: str, columns: list[str], parts: int | None = None) -> DataFrame:
    """Columns ``next_<name>`` of the next row by descending key, after the last those of the first.

    Rows are dealt into key ranges; the top row of each range is also sent to the range above, where it follows the
    last, so no task sees more than its range. Null keys come last; ties are ordered by the named columns. A table of
    one row is its own next.
    """
    ranges = RangeBuckets(df, key, parts or 2 * shuffle_partitions(df.sparkSession))
    home, bucket_name, guest_name = fresh(df, "_home", "_bucket", "_guest")
    bucket, k, last = ranges.expr(F.col(key)), F.col(key), ranges.count - 1
    above = F.when(F.coalesce(k == ranges.top, F.lit(ranges.top is None)), 0).when(F.coalesce(k.isin(ranges.cuts), F.lit(False)), bucket + 1)
    homes = F.array_compact(F.array(F.struct(bucket.alias("bucket"), F.lit(0).alias("guest")), F.when(above.isNotNull(), F.struct(above.cast("int").alias("bucket"), F.lit(1).alias("guest")))))
    if last == 0 and ranges.top is None:
        # All keys are null: ties by the columns alone decide, and every row is a guest as well.
        homes = F.array(*[F.struct(F.lit(0).alias("bucket"), F.lit(g).alias("guest")) for g in (0, 1)])
    dealt = df.withColumn(home, F.explode(homes)).select(*df.columns, F.col(home)["bucket"].alias(bucket_name), F.col(home)["guest"].alias(guest_name))
    order = Window.partitionBy(bucket_name).orderBy(guest_name, F.col(key).desc_nulls_last(), *columns)
    following = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return following.where(F.col(guest_name) == 0).drop(bucket_name, guest_name)
