"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with SQL expressions alone.

A source's target is a number of words. Whole copies of the source (epochs) come first; what remains of its target is
filled with documents in the order of their sampling keys, exponential variates divided by the documents' quality
weights, least first, to the prefix sum of sizes nearest the rest. Keys come from a hash of id and text, so reruns agree.

No source is sorted whole: keys are cut into fixed ranges, the words of each range of a source are summed, and only
the range in which the target falls is ordered row by row.

Defined results: a null or empty text has size 0 and takes part with 0 words; a null source is a source of its own,
after the others; ties of keys are ordered by id and text hash. Rows equal in these are counted as one group before they are
ordered; where the target falls inside a group, as many of its rows are taken as come nearest, whichever: nothing tells them
apart. An empty table gives no rows. Columns that the result adds replace columns of those names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolith.llm.common import checkpoint

_BLANK = r"\x20\x09-\x0D"
#: Characters that are rare in prose.
_SYMBOLS = "#$%&*+/<=>@[\\]^_`{|}~"


@dataclass(frozen=True)
class Settings:
    #: Weights of the sources in the order of their names, repeating.
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    #: The mix's size as a share of all words.
    budget: float = 1.5
    #: A source is taken at most so many times.
    most: float = 2.0
    ranges: int = 4096
    seed: int = 29


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{_BLANK}]+")), F.lit(0)).cast("long")


def quality(text: Column, words: Column) -> Column:
    """A document's sampling weight, 0.25 to 1: highest where words are about as long as those of prose, symbols few and lines distinct."""
    text = F.coalesce(text, F.lit(""))
    n, lines = F.length(text), F.split(text, "\n")
    length = F.exp(-F.pow((n / F.greatest(words, F.lit(1)) - 6.0) / 4.0, F.lit(2.0)))
    symbols = (n - F.length(F.translate(text, _SYMBOLS, ""))) / F.greatest(n, F.lit(1))
    return 0.25 + 0.75 * length * F.exp(-10.0 * symbols) * F.size(F.array_distinct(lines)) / F.size(lines)


def source_targets(totals: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """source, source_size, target, from source and source_size: one row for each source.

    The budget is shared by weight, no source above ``most`` times its size, the excess going to the others by weight.
    Sources fill up in the order of their cap's share of weight, so the level of those that do not is a prefix sum away.
    """
    by_name, all_ = Window.orderBy(F.col("source").asc_nulls_last()), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weights = F.array(*[F.lit(float(w)) for w in settings.weights])
    t = totals.select("source", "source_size", F.get(weights, (F.row_number().over(by_name) - 1) % len(settings.weights)).alias("w"))
    t = t.withColumn("cap", settings.most * F.col("source_size")).withColumn("budget", settings.budget * F.sum("source_size").over(all_))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    full, heavy = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    t = t.withColumn("level", (F.col("budget") - full) / heavy).withColumn("open", F.col("level") * F.col("w") < F.col("cap"))
    level = F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("w")).alias("ratio"), F.col("level").alias("level")))).over(all_)["level"]
    return t.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def keyed(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of the input, and size, quality, row_hash, key and range. The key is that of exponential order sampling."""
    new = ("size", "quality", "row_hash", "key", "range")
    text, kept = F.col(text_col), [c for c in df.columns if c not in new]
    rows = df.select(*kept, word_count(text).alias("size"), F.xxhash64(text, F.lit(settings.seed)).alias("row_hash"))
    rows = rows.withColumn("quality", quality(text, F.col("size")))
    u = (F.pmod(F.xxhash64(F.col(id_col), "row_hash", F.lit(settings.seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = rows.withColumn("key", -F.ln(u) / F.col("quality"))
    return rows.withColumn("range", F.least(F.floor((1 - F.exp(-F.col("key"))) * settings.ranges), F.lit(settings.ranges - 1)).cast("int"))


def make_plan(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each source: p_source, source_size, target, epochs, cut_range and, if any is picked there, the greatest
    (key, doc_id, row_hash) ``in_cut``, of whose ``cut_of`` equal rows ``cut_n`` are.

    ``rows`` has doc_id, source, size, row_hash, key and range.
    """
    sums = checkpoint(rows.groupBy("source", "range").agg(F.sum("size").alias("words")))
    targets = source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), settings)
    targets = targets.withColumn("epochs", F.floor(F.col("target") / F.greatest("source_size", F.lit(1)) + 1e-12).cast("int")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("range")
    cut = sums.withColumn("before", F.sum("words").over(upto) - F.col("words")).alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    # The first range whose words reach the rest; the ranges before it are taken whole.
    cut = cut.where((F.col("before") + F.col("words") >= F.col("rest")) & (F.col("rest") > 0)).groupBy("s.source").agg(F.min(F.struct("range", "before", "rest")).alias("at"))
    cut = cut.select(F.col("source").alias("c_source"), "at.range", "at.before", "at.rest")
    edge = rows.alias("r").join(few(cut).alias("c"), F.col("r.source").eqNullSafe(F.col("c.c_source")) & (F.col("r.range") == F.col("c.range"))).select("r.*", "before", "rest")
    equal = ("source", "range", "key", "doc_id", "row_hash", "size", "before", "rest")
    groups = edge.groupBy(*equal).agg(F.count("*").alias("n"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0))
    taken = F.when(F.col("size") > 0, F.least(F.floor(F.col("room") / F.col("size") + 0.5), F.col("n"))).otherwise(F.when(F.col("room") > 0, F.col("n")))
    groups = groups.withColumn("room", room).withColumn("m", taken.cast("long")).where("m > 0")
    last = groups.groupBy("source").agg(F.max(F.struct("key", "doc_id", "row_hash", "m", "n")).alias("last"))
    plan = targets.alias("t").join(cut.alias("c"), F.col("t.source").eqNullSafe(F.col("c_source")), "left").join(last.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left")
    in_cut = F.when(F.col("last").isNotNull(), F.struct("last.key", "last.doc_id", "last.row_hash")).alias("in_cut")
    return plan.select(F.col("t.source").alias("p_source"), "source_size", "target", "epochs", F.coalesce("range", F.lit(-1)).alias("cut_range"), in_cut, F.col("last.m").alias("cut_n"), F.col("last.n").alias("cut_of"))


def few(plan: DataFrame, most: int = 10_000) -> DataFrame:
    """The plan with a broadcast hint if it has few rows; else a join shuffles, and adaptive execution splits hot sources."""
    plan = checkpoint(plan)
    return F.broadcast(plan) if plan.limit(most + 1).count() <= most else plan


def _copies() -> Column:
    """Epochs, and one more for the rows that are picked, but for those of a group of equal rows that is picked in part."""
    at = F.struct("key", "doc_id", "row_hash")
    inside = (at < F.col("in_cut")) | ((at == F.col("in_cut")) & (F.col("cut_n") == F.col("cut_of")))
    picked = (F.col("range") < F.col("cut_range")) | ((F.col("range") == F.col("cut_range")) & F.coalesce(inside, F.lit(False)))
    return (F.col("epochs") + picked.cast("int")).alias("copies")


def _in_part() -> Column:
    """Whether a row is of a group of equal rows of which only some are picked."""
    return F.coalesce((F.struct("key", "doc_id", "row_hash") == F.col("in_cut")) & (F.col("cut_n") < F.col("cut_of")), F.lit(False))


def _last_numbers(ties: DataFrame) -> DataFrame:
    """n_source and last_no, the ``cut_n``-th row number of each source's ties: from counts by partition, and one partition's rows."""
    part = F.shiftright("row_no", 33)
    counts = checkpoint(ties.groupBy("source", "cut_n", part.alias("part")).agg(F.count("*").alias("c")))
    upto = F.sum("c").over(Window.partitionBy("source").orderBy("part"))
    at = counts.withColumn("skip", upto - F.col("c")).where((F.col("skip") < F.col("cut_n")) & (F.col("skip") + F.col("c") >= F.col("cut_n")))
    at = few(at.select(F.col("source").alias("n_source"), F.col("part").alias("n_part"), (F.col("cut_n") - F.col("skip")).alias("nth")))
    inside = ties.join(at, F.col("source").eqNullSafe(F.col("n_source")) & (part == F.col("n_part")))
    number = F.row_number().over(Window.partitionBy("n_source").orderBy("row_no"))
    return inside.withColumn("number", number).where("number = nth").select("n_source", F.col("row_no").alias("last_no"))


def mix(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, quality, source_size, target, copies and taken (copies times size) of each row."""
    slim = keyed(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")), settings)
    rows = checkpoint(slim.drop("text").withColumn("row_no", F.monotonically_increasing_id()))  # the texts are read once; what follows works on some tens of bytes a row
    plan = few(make_plan(rows, settings))
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    copies = _copies()
    if not plan.where("cut_n < cut_of").isEmpty():
        numbers = few(_last_numbers(joined.where(_in_part()).select("source", "row_no", "cut_n")))
        joined = joined.join(numbers, F.col("source").eqNullSafe(F.col("n_source")), "left")
        copies = (copies + F.coalesce(_in_part() & (F.col("row_no") <= F.col("last_no")), F.lit(False)).cast("int")).alias("copies")
    joined = joined.select("doc_id", "source", "size", "quality", "source_size", "target", copies)
    return joined.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def _repeated(df: DataFrame, times: str, block: int = 4096) -> DataFrame:
    """Each row as often as a column says, dealt out in blocks."""
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / block))))
    size = F.least(F.col(times) - F.col("_block") * block, F.lit(block)).cast("int")
    return blocks.withColumn("_size", size).repartition(F.col("_block"), F.col(times)).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_size"))))


def mixed(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The mix itself: the rows of ``df`` (with doc_id, source and text) that it takes, as often as it takes them, with the columns of ``df``.

    Of rows equal in id and text that are taken in part, equal ones are counted on the map side before any are picked.
    """
    rows = checkpoint(keyed(df.select("doc_id", F.col("source").cast("string").alias("source"), "text"), settings).drop("text"))
    plan = few(make_plan(rows, settings))
    work = keyed(df.select(F.struct(*df.columns).alias("row"), "doc_id", F.col("source").cast("string").alias("source"), "text"), settings)
    joined = work.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    out = joined.select("row", _copies()).where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
    if plan.where("cut_n < cut_of").isEmpty():
        return out
    ties = joined.where(_in_part()).groupBy("p_source", "row", "cut_n").agg(F.count("*").alias("n"))
    before = Window.partitionBy("p_source").orderBy(F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("cut_n") - F.coalesce(F.sum("n").over(before), F.lit(0))
    ties = ties.withColumn("times", F.least(left, F.col("n"))).where("times > 0")
    return out.unionByName(_repeated(ties, "times").select("row.*"))
