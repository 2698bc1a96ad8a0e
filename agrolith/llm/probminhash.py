"""Near-duplicate documents: ProbMinHash signatures of weighted shingles, banding, verification, connected classes.

A document is the set of its word shingles, weighted by 1 + ln(times it occurs). Every shingle is a Poisson process
whose rate is its weight: its arrivals, drawn from its hash, fall at exponential intervals on random registers, and each
register keeps the shingle that arrived first. Rounds of arrivals end for a shingle when its time passes the latest of
the registers (early termination). Two registers agree with the probability Jaccard similarity of the documents.

Steps, all over DataFrames:

1. equal word sequences are grouped first, by a 128-bit digest; the number of one row of each stands for the text in all
   that follows, so ids may be null or repeated;
2. signatures are cut into bands; texts with an equal band share a bucket;
3. in each bucket all are compared with its least member (the leader), never with one another. Those that are not
   similar to it stay for another round with another leader, and so do those similar ones that can still be similar to
   one that stays: one less the similarity is a metric, so a link needs distances to the leader that differ by no more
   than a link's own. A bucket of a third of all rows is a join with one row on one side, which can be split;
4. what rounds leave in buckets of more than one class is cut into blocks of some ``block`` members, and every two blocks
   of a bucket meet in a cell of their own, so a task holds two blocks, however large the bucket. A cell compares members
   of different classes, in the first of the buckets that a pair shares alone: estimates from the signatures first, and
   those within ``slack`` of the threshold by their shingles; no pair but a link leaves the task. So a link between texts
   that share a bucket is lost only where the estimate is off by more than ``slack``;
5. pairs are verified by the exact similarity of their shingles;
6. verified links become classes by repeated minima over neighbours, with short cuts; nothing is collected.

Defined results: the least id of a class names it, a null only where all its ids are null; one row of each class leads it,
one with the least id. A document with fewer words than a shingle has one shingle of all its words; null, empty and blank
texts are alike and form one class. Repeated rows, and rows with equal ids, each keep a row and get the class of their
text. Columns other than those named are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from agrolith.llm.common import Scratch, bounded_batches, checkpoint, drop_caches, shuffle_partitions, trimmed


_EPS = 1e-9


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    bands: int = 32
    #: Registers in a band.
    rows: int = 6
    #: Rounds of leaders before the rest of a bucket is compared in blocks.
    rounds: int = 2
    #: Members and shingles of a block.
    block: int = 256
    block_shingles: int = 4_000_000
    #: So much below the threshold an estimate still leads to an exact comparison (over five standard errors).
    slack: float = 0.16

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (xor-shifts and odd multipliers)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_list(text: str | None) -> list[str]:
    return (text or "").lower().split()


def shingles(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 32-bit hashes of the distinct shingles, and how often each occurs."""
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(n, len(h))
    if not n:
        return np.zeros(1, np.uint64), np.ones(1, np.int64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = _mixed(out + h[i : len(h) - n + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(out >> np.uint64(32), return_counts=True)


def weights(counts: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(counts)


def signatures(hashes: list[np.ndarray], counts: list[np.ndarray], registers: int) -> np.ndarray:
    """A row of registers for each document: the hash of the shingle that came first to each."""
    docs = len(hashes)
    owner = np.repeat(np.arange(docs), [len(h) for h in hashes])
    item, rate = np.concatenate(hashes), weights(np.concatenate(counts))
    first = np.full(docs * registers, np.inf)
    holder = np.zeros(docs * registers, np.uint64)
    state, time = _mixed(item ^ np.uint64(0xD6E8FEB86659FD93)), np.zeros(len(item))
    while len(owner):
        state = _mixed(state + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(((state >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        at = owner * registers + (_mixed(state ^ item) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, time)
        won = first[at] == time
        holder[at[won]] = item[won]
        latest = first.reshape(docs, registers).max(axis=1)
        on = time < latest[owner]
        owner, item, rate, state, time = owner[on], item[on], rate[on], state[on], time[on]
    return holder.reshape(docs, registers)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two weighted sets, exactly.

    Over the shared elements, the sum of 1 / sum_j max(w_j / w_i, v_j / v_i). With ratio r_j = w_j / v_j, the inner sum takes
    w_j / w_i where r_j exceeds r_i and v_j / v_i elsewhere: prefix sums in the order of the ratios give all of them.
    """
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    wa, wb = weights(a[1]), weights(b[1])
    w, v = wa[ia], wb[ib]
    only_a, only_b = wa.sum() - w.sum(), wb.sum() - v.sum()
    order = np.argsort(w / v, kind="stable")
    w, v = w[order], v[order]
    below_v, above_w = np.cumsum(v), w.sum() - np.cumsum(w)
    return float((1.0 / (only_a / w + only_b / v + above_w / w + below_v / v)).sum())


_SKETCH = "row long, id long, key binary, bands array<long>, size long, hashes binary, counts binary, firsts binary"
_SET = ("size", "hashes", "counts", "firsts")


def _least_type(most: int) -> str:
    return "u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4"


def buckets_of(sig: np.ndarray, settings: Settings) -> np.ndarray:
    """A number for each band of each signature; its low bits say which band."""
    sig = sig.reshape(-1, settings.bands, settings.rows)
    at = np.arange(settings.bands, dtype=np.uint64)
    band = np.broadcast_to(at, sig.shape[:2])
    for i in range(settings.rows):
        band = _mixed(band * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, i])
    mask = np.uint64((1 << (settings.bands - 1).bit_length()) - 1)
    return (band & ~mask | at).view(np.int64)


def _sketch(settings: Settings, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for batch in bounded_batches(batches, 1 << 20):
            lists = [word_list(t) for t in batch.column(2).to_pylist()]
            sets = [shingles(w, settings.words) for w in lists]
            sig = signatures([h for h, _ in sets], [c for _, c in sets], settings.registers)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([xxh3_128_digest(" ".join(w)) for w in lists], pa.binary()),
                    pa.array(list(buckets_of(sig, settings)), pa.list_(pa.int64())),
                    pa.array([len(h) for h, _ in sets], pa.int64()),
                    pa.array([h.astype("<u4").tobytes() for h, _ in sets], pa.binary()),
                    pa.array([c.astype(_least_type(c.max())).tobytes() if c.max() > 1 else b"" for _, c in sets], pa.binary()),
                    pa.array([np.searchsorted(h, s).astype(_least_type(len(h))).tobytes() for (h, _), s in zip(sets, sig, strict=True)], pa.binary()),
                    *batch.columns[3:],
                ],
                ["row", "id", "key", "bands", *_SET, *kept],
            )

    return run


def _numbers(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: "u1", 2: "<u2", 4: "<u4"}[len(data) // n]).astype(np.int64)


def _unpacked(hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(hashes, "<u4").astype(np.uint64)
    return h, _numbers(counts, len(h)) if counts else np.ones(len(h), np.int64)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in bounded_batches(batches, 4 << 20):
        a, b, ah, ac, bh, bc = (batch.column(i).to_pylist() for i in range(6))
        out, last, right = [], None, None
        for i in range(len(a)):
            if b[i] != last:
                last, right = b[i], _unpacked(bh[i], bc[i])
            out.append(similarity(_unpacked(ah[i], ac[i]), right))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "similarity"])


def _compare(settings: Settings):
    """Links (a, b) between classes in each cell (bucket, low, high); rows come sorted by cell."""
    near_enough = settings.similarity - settings.slack
    mask = (1 << (settings.bands - 1).bit_length()) - 1

    def links(cell: tuple[int, int, int], members: list[tuple]) -> Iterator[tuple[int, int]]:
        band = cell[0] & mask
        sets = [_unpacked(h, c) for _, _, h, c, _ in members]
        sig = np.array([h[_numbers(f, settings.registers)] for (h, _), (*_, f) in zip(sets, members, strict=True)], np.uint32)
        block, label = np.array([m[0] for m in members]), np.array([m[1] for m in members])
        right = np.flatnonzero(block == cell[2])
        for i in np.flatnonzero(block == cell[1]):
            near = right[label[right] != label[i]]
            near = near if cell[1] < cell[2] else near[near > i]
            same = sig[near] == sig[i]
            first = same.reshape(len(near), settings.bands, settings.rows).all(axis=2).argmax(axis=1)
            for k in near[(first == band) & (same.mean(axis=1) >= near_enough)]:
                if label[k] != label[i] and similarity(sets[i], sets[k]) >= settings.similarity - _EPS:
                    yield int(label[i]), int(label[k])
                    label[label == max(label[i], label[k])] = min(label[i], label[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, members = None, []

        def done() -> Iterator[pa.RecordBatch]:
            found = list(links(cell, members)) if len(members) > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

        for batch in bounded_batches(batches, 4 << 20):
            for *k, block, label, hashes, counts, firsts in zip(*(batch.column(j).to_pylist() for j in range(8)), strict=True):
                if k != cell:
                    yield from done()
                    cell, members = k, []
                members.append((block, label, hashes, counts, firsts))
        yield from done()

    return run


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of each connected class of links (a, b). Nodes without links are left out.

    Each round takes the least label among neighbours and then the label of that label; labels only fall, and the rounds
    end when none does. Links never go to one task: a node's neighbours meet in a minimum that is summed up before the shuffle.
    """
    both = checkpoint(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("j_node"), F.col("label").alias("j_label"))
        new = checkpoint(new.join(jump, F.col("label") == F.col("j_node"), "left").select("node", "was", F.least("label", F.coalesce("j_label", "label")).alias("label")))
        if new.where("label <> was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def _leaders(members: DataFrame) -> DataFrame:
    return checkpoint(members.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n"))


def _round(members: DataFrame, sets: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Links of members to their bucket's leader, and the members that stay."""
    least = settings.similarity - _EPS
    pairs = members.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    left = pairs.join(sets, F.col("a") == F.col("s_node")).select("a", "b", F.col("hashes").alias("ah"), F.col("counts").alias("ac"))
    both = left.join(sets, F.col("b") == F.col("s_node")).select("a", "b", "ah", "ac", "hashes", "counts")
    verdicts = checkpoint(both.mapInArrow(trimmed(_verify), "a long, b long, similarity double"))
    judged = checkpoint(members.join(verdicts, (F.col("node") == F.col("a")) & (F.col("leader") == F.col("b"))).select("node", "bucket", "similarity"))
    # Buckets without an unlike member are done. A like member stays if an unlike one can be near it.
    nearest = checkpoint(judged.where(F.col("similarity") < least).groupBy(F.col("bucket").alias("b_bucket")).agg(F.max("similarity").alias("nearest")))
    stays = (F.col("similarity") < least) | (F.col("similarity") <= F.col("nearest") + (1 - settings.similarity) + _EPS)
    left = checkpoint(judged.join(nearest, F.col("bucket") == F.col("b_bucket")).where(stays).select("node", "bucket"))
    return verdicts.where(F.col("similarity") >= least).select("a", "b"), left


def _cells(members: DataFrame, sets: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """Links between classes among what is left of the buckets: blocks of members, every two in a cell."""
    classed = checkpoint(members.join(labels, F.col("node") == F.col("l_node"), "left").select("node", "bucket", F.coalesce("label", "node").alias("class")))
    sized = classed.join(sets.select("s_node", "size"), F.col("node") == F.col("s_node"))
    blocks = F.ceil(F.greatest(F.count("*") / settings.block, F.sum("size") / settings.block_shingles)).cast("int")
    split = sized.groupBy(F.col("bucket").alias("b_bucket")).agg(F.min("class").alias("low"), F.max("class").alias("high"), blocks.alias("blocks"))
    split = checkpoint(split.where("low < high").select("b_bucket", "blocks"))
    rest = classed.join(split, F.col("bucket") == F.col("b_bucket")).join(sets, F.col("node") == F.col("s_node"))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = rest.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "class", "hashes", "counts", "firsts")
    dealt = cells.repartition(shuffle_partitions(members.sparkSession), "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    return checkpoint(dealt.mapInArrow(trimmed(_compare(settings)), "a long, b long"))


def classes(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, class_id, text_id (the least id with the same words), leads and the columns ``keep`` of each row.

    ``leads`` is true for one row of each class. The result is a table in the checkpoint folder: it reads nothing else.
    """
    last = F.lit(2**63 - 1)  # a null id comes last
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    kept = [f"kept_{c}" for c in keep]
    schema = ", ".join([_SKETCH, *[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[3:]]])
    with Scratch(df.sparkSession) as scratch:
        sketches = scratch.saved(docs.mapInArrow(trimmed(_sketch(settings, kept)), schema), "sketches")
        texts = checkpoint(sketches.groupBy("key").agg(F.min("id").alias("text_id"), F.min_by("row", F.coalesce("id", last)).alias("node")))
        chosen = sketches.join(texts.select("node"), F.col("row") == F.col("node"), "left_semi")
        members = chosen.select(F.col("row").alias("node"), F.explode("bands").alias("bucket"))
        sets, links = None, df.sparkSession.createDataFrame([], "a long, b long")
        for _ in range(settings.rounds):
            led = checkpoint(members.join(_leaders(members), "bucket").where("node <> leader"))
            if sets is None:  # the sets of the texts that share a bucket: what later joins move
                needed = led.select("node").union(led.select("leader")).distinct()
                sets = scratch.saved(sketches.join(needed, F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("s_node"), *_SET), "sets")
            new, members = _round(led, sets, settings)
            links = links.union(new)
        if sets is None:
            sets = chosen.select(F.col("row").alias("s_node"), *_SET)
        first = components(links).withColumnRenamed("node", "l_node")
        second = components(_cells(members, sets, first, settings)).select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        labels = first.join(second, F.col("label") == F.col("n2"), "left").select("l_node", F.coalesce("l2", "label").alias("label"))
        alone = second.join(first, F.col("n2") == F.col("l_node"), "left_anti").select(F.col("n2").alias("l_node"), F.col("l2").alias("label"))
        labels = checkpoint(texts.join(labels.union(alone), F.col("node") == F.col("l_node")).select("node", "text_id", "label"))
        least = checkpoint(labels.groupBy("label").agg(F.min("text_id").alias("least"), F.min_by("node", F.coalesce("text_id", last)).alias("lead")))
        named = labels.join(least, "label").select(F.col("node").alias("l_node"), "least", "lead")
        named = texts.join(named, F.col("node") == F.col("l_node"), "left")
        named = checkpoint(named.select("key", "text_id", F.when(F.col("lead").isNull(), F.col("text_id")).otherwise(F.col("least")).alias("class_id"), F.coalesce("lead", "node").alias("lead")))
        out = sketches.select("row", "id", "key", *kept).join(named, "key")
        return checkpoint(out.select(F.col("id").alias("doc_id"), "class_id", "text_id", (F.col("row") == F.col("lead")).alias("leads"), *[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)]))
