"""Ranked lexical search by Block-Max WAND over an index of compressed posting blocks.

``build`` writes the index: each task cuts its documents into segments of bounded size and inverts each alone, so nothing
is shuffled and no word's postings meet in one place. A word's postings in a segment stand in blocks of fixed size, bit-packed: gaps
of document numbers and impacts, an impact being what a document's count of the word is worth before the word's weight. Of each
block a head tells its first and last document, its greatest impact and where its bits are.

``search`` joins the heads and blocks of the words that are asked with blocks of queries, and takes every segment of a block of
queries in turn. Pointers first move over heads alone: between two edges of blocks the sum of weight times greatest impact
bounds every score. The pivot is the next stretch whose bound reaches the threshold, the tenth best score so far; others are
skipped, and a block that no pivot needs is never decompressed. The stretches of greatest bound come first, to raise the threshold; thresholds go on from
segment to segment of a task.

Defined results: a null text has no words; null and repeated ids of documents keep a row each (null ids come last, among equal ids the
row's place decides); items of equal id are one item with the words of all; an item without words gets no rows; an empty table gives
no rows; texts are read in slices, so their length is not limited by memory for words. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agrolith.llm.common import bounded_batches, drop_caches, trimmed
from agrolith.llm.mixing import few


@dataclass(frozen=True)
class Settings:
    top: int = 10
    #: Postings of a block, words and documents of a segment, queries of a block of queries.
    block: int = 128
    segment_words: int = 2_000_000
    segment_docs: int = 8192
    queries: int = 256


_WORD = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum())
#: A to Z in lower case, every other byte that is in no word as a space.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c in _WORD else 32 for c in range(256))
_SLICE = 1 << 20
#: What the head of a block holds, without reading its bits.
HEAD = np.dtype([("first", "<u4"), ("last", "<u4"), ("most", "<u4"), ("least", "<u4"), ("gap_bits", "u1"), ("impact_bits", "u1"), ("at", "<u4")])


def words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, a slice at a time."""
    data = (text or "").encode().translate(_PLAIN)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + _SLICE) if len(data) - at > _SLICE else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = total = 0
    for batch in bounded_batches(batches, 4 << 20):
        for text in batch.column(0).to_pylist():
            n = sum(map(len, words(text)))
            docs, total = docs + (n > 0), total + n
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([total], pa.int64())], ["docs", "words"])


def _widths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(float))[1].astype(np.int64)


def _pack(out: np.ndarray, at: np.ndarray, values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> None:
    """Write each block's values, ``bits`` of each, from byte ``at`` on; a block takes bits bytes for every eight values begun."""
    eights = -(-sizes // 8)
    for key in np.unique(eights << 8 | bits).tolist():
        n, width = (key >> 8) * 8, key & 255
        if not width:
            continue
        own = np.flatnonzero((eights << 8 | bits) == key)
        place = starts[own][:, None] + np.arange(n)
        inside = np.arange(n) < sizes[own][:, None]
        padded = np.where(inside, values[np.minimum(place, len(values) - 1)], 0)
        packed = np.packbits((padded[:, :, None] >> np.arange(width) & 1).astype(np.uint8).reshape(len(own), -1), axis=1, bitorder="little")
        out[at[own][:, None] + np.arange(packed.shape[1])] = packed


def _unpack(data: bytes, at: int, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.int64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8) * width, at), bitorder="little")
    return bits.reshape(-1, width)[:n] @ (1 << np.arange(width))


def inverted(terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(postings of each term, heads, blocks of each term, bits of all blocks) from postings by term and document."""
    first_of_term = np.flatnonzero(np.diff(terms, prepend=-1))
    n = np.diff(first_of_term, append=len(terms))
    blocks = -(-n // block)
    inner = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    starts = np.repeat(first_of_term, blocks) + inner * block
    sizes = np.diff(starts, append=len(terms))
    gaps = np.diff(docs, prepend=0) - 1
    gaps[starts] = 0  # the head has the first document
    most, least = np.maximum.reduceat(impacts, starts), np.minimum.reduceat(impacts, starts)
    over = impacts - np.repeat(least, sizes)
    heads = np.zeros(len(starts), HEAD)
    heads["first"], heads["last"], heads["most"], heads["least"] = docs[starts], docs[starts + sizes - 1], most, least
    gap_bits, impact_bits = _widths(np.maximum.reduceat(gaps, starts)), _widths(most - least)
    heads["gap_bits"], heads["impact_bits"] = gap_bits, impact_bits
    length = -(-sizes // 8) * (gap_bits + impact_bits)
    ends = np.cumsum(length)
    bits = np.zeros(int(ends[-1]), np.uint8)
    _pack(bits, ends - length, gaps, starts, sizes, gap_bits)
    _pack(bits, ends - length + -(-sizes // 8) * gap_bits, over, starts, sizes, impact_bits)
    first_block = np.cumsum(blocks) - blocks
    heads["at"] = ends - length - np.repeat((ends - length)[first_block], blocks)
    return n, heads, blocks, bits


_INDEX = "segment long, term string, df int, heads binary, bits binary, number int, doc_id long"


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype("<i4").tobytes()), pa.py_buffer(data.tobytes())])


def _inverter(n_docs: int, n_words: int, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        numbers: dict[bytes, int] = {}
        ids: list[int | None] = []
        lengths: list[int] = []
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        names = _INDEX.replace(",", "").split()[::2]
        segment, size = TaskContext.get().partitionId() << 32, 0

        def close() -> Iterator[pa.RecordBatch]:
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            m = (10 + 90 * np.array(lengths, np.int64) * n_docs // max(n_words, 1))[order]
            none = lambda k, n: pa.nulls(n, k)
            at = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(at, segment)), none(pa.string(), at), none(pa.int32(), at), none(pa.binary(), at), none(pa.binary(), at), pa.array(np.arange(at, dtype=np.int32)), pa.array([ids[i] for i in order], pa.int64())], names)
            if not keys:  # no text of the segment has a word
                return
            key, count = np.concatenate(keys), np.concatenate(counts)
            key = key >> 32 << 32 | place[key & 0xFFFFFFFF]
            by = np.argsort(key, kind="stable")
            key = key[by]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            tf, key = np.add.reduceat(count[by], starts), key[starts]
            terms, docs = key >> 32, key & 0xFFFFFFFF
            n, heads, blocks, bits = inverted(terms, docs, 1_000_000_000 * tf // (1000 * tf + 8 * m[docs]), s.block)
            texts = list(numbers)  # in the order of their numbers
            own = np.unique(terms)
            ends = np.cumsum(blocks)
            head_ends = np.concatenate([[0], ends * HEAD.itemsize])
            block_n = np.minimum(s.block, np.repeat(n, blocks) - s.block * (np.arange(ends[-1]) - np.repeat(ends - blocks, blocks)))
            length = -(-block_n // 8) * (heads["gap_bits"].astype(np.int64) + heads["impact_bits"])
            bit_ends = np.concatenate([[0], np.cumsum(length)[ends - 1]])
            for a in range(0, len(own), 20_000):
                b = min(a + 20_000, len(own))
                heads_of = _binary(head_ends[a : b + 1] - head_ends[a], np.frombuffer(heads.tobytes(), np.uint8)[head_ends[a] : head_ends[b]])
                bits_of = _binary(bit_ends[a : b + 1] - bit_ends[a], bits[bit_ends[a] : bit_ends[b]])
                texts_of = pa.array([texts[i].decode() for i in own[a:b].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, segment)), texts_of, pa.array(n[a:b].astype(np.int32)), heads_of, bits_of, none(pa.int32(), b - a), none(pa.int64(), b - a)], names)

        for batch in bounded_batches(batches, 4 << 20):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                number, n = len(ids), 0
                for own in filter(None, words(text)):
                    found = np.fromiter((numbers.setdefault(w, len(numbers)) for w in own), np.int64, len(own))
                    n += len(own)
                    weight = np.ones(len(own), np.int64)
                    if len(own) > 50_000:
                        found, weight = np.unique(found, return_counts=True)
                    keys.append(found << 32 | number)
                    counts.append(weight)
                    size += len(found)
                ids.append(doc)
                lengths.append(n)
                if size >= s.segment_words or len(ids) >= s.segment_docs:
                    yield from close()
                    numbers, ids, lengths, keys, counts = {}, [], [], [], []
                    segment, size = segment + 1, 0
        if ids:
            yield from close()

    return trimmed(run)


def build(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> str:
    """Write the index of all rows to a new folder that driver and executors share; returns it."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sums = docs.select("text").mapInArrow(_sizes, "docs long, words long").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    sums.write.parquet(f"{folder}/sums")
    n_docs, n_words = df.sparkSession.read.parquet(f"{folder}/sums").first()
    docs.mapInArrow(_inverter(n_docs, n_words, settings), _INDEX).write.parquet(f"{folder}/index")
    return folder


class Postings:
    """A word's blocks in a segment; bits are read when a block is first needed."""

    def __init__(self, df: int, heads: bytes, bits: bytes, block: int):
        self.heads, self.bits, self.df, self.block, self.read = np.frombuffer(heads, HEAD), bits, df, block, {}
        self.first, self.last, self.most = (self.heads[k].astype(np.int64) for k in ("first", "last", "most"))

    def decoded(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        if k not in self.read:
            h, n = self.heads[k], min(self.block, self.df - k * self.block)
            at, gap_bits, impact_bits = int(h["at"]), int(h["gap_bits"]), int(h["impact_bits"])
            gaps = _unpack(self.bits, at, n, gap_bits)
            gaps[0] = int(h["first"])
            gaps[1:] += 1
            self.read[k] = np.cumsum(gaps), _unpack(self.bits, at + -(-n // 8) * gap_bits, n, impact_bits) + int(h["least"])
        return self.read[k]


class Best:
    """The best scores of an item so far, with all that tie with the last of them."""

    def __init__(self, top: int):
        self.top, self.rows, self.threshold = top, [], 1

    def add(self, scores: np.ndarray, segment: int, docs: np.ndarray) -> None:
        """Documents of a segment in ascending order of id; of equal scores in one segment the first ``top`` are enough."""
        use = np.flatnonzero(scores >= self.threshold)
        use = use[np.argsort(-scores[use], kind="stable")][: self.top]
        if len(use):
            self.rows += [(v, segment, d) for v, d in zip(scores[use].tolist(), docs[use].tolist(), strict=True)]
            self.rows.sort(key=lambda r: (-r[0], r[1:]))
            if len(self.rows) >= self.top:
                self.threshold = max(1, self.rows[self.top - 1][0])
                self.rows = [r for r in self.rows if r[0] >= self.threshold]


def walk(found: list[tuple[Postings, int]], segment: int, best: Best, pivots: int = 64) -> None:
    """Block-Max WAND over one segment for one item: (postings, weight) of its words."""
    edges = np.unique(np.concatenate([x for p, _ in found for x in (p.first, p.last + 1)]))
    starts, ends = edges[:-1], edges[1:]
    blocks, bound = [], np.zeros(len(starts), np.int64)
    for p, weight in found:  # shallow moves: heads alone
        k = np.searchsorted(p.last, starts)
        inside = k < len(p.last)
        inside[inside] = p.first[k[inside]] <= starts[inside]
        bound[inside] += weight * p.most[k[inside]]
        blocks.append(np.where(inside, k, -1))
    seed = np.argsort(-bound, kind="stable")[:pivots]
    seeded = np.zeros(len(starts), bool)
    seeded[seed] = True
    order = np.concatenate([seed, np.flatnonzero(~seeded)])
    at = 0
    while at < len(order):
        some = order[at:]
        live = np.flatnonzero(bound[some] >= best.threshold)[:pivots]
        if not len(live):
            return
        chosen = np.sort(some[live])
        at += int(live[-1]) + 1
        width = ends[chosen] - starts[chosen]
        offset = np.cumsum(width) - width
        scores = np.zeros(int(width.sum()), np.int64)
        docs = np.repeat(starts[chosen] - offset, width) + np.arange(len(scores))
        for (p, weight), own in zip(found, blocks, strict=True):
            need = own[chosen]
            for k in np.unique(need[need >= 0]).tolist():
                d, impact = p.decoded(k)
                s = np.searchsorted(starts[chosen], d, "right") - 1
                hit = (s >= 0) & (d < ends[chosen][s])
                scores[offset[s[hit]] + d[hit] - starts[chosen][s[hit]]] += weight * impact[hit]
        best.add(scores, segment, docs)


_FOUND = "item int, asked_block long, score long, segment long, number int"


def _searcher(s: Settings):
    """Rows by block of queries and segment: those of a segment together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        best: dict[int, Best] = {}
        block = segment = None
        items: dict[int, list] = {}

        def score() -> None:
            for item, found in items.items():
                walk(found, segment, best.setdefault(item, Best(s.top)))
            items.clear()

        def done() -> Iterator[pa.RecordBatch]:
            rows = [(item, block, *r) for item, b in best.items() for r in b.rows]
            best.clear()
            if rows:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds, strict=True)], _FOUND.replace(",", "").split()[::2])

        for batch in bounded_batches(batches, 4 << 20):
            for b, g, df, heads, bits, weight, asked in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if (b, g) != (block, segment):
                    if block is not None:
                        score()
                    if b != block:
                        yield from done()
                    block, segment = b, g
                postings = Postings(df, heads, bits, s.block)
                for item in asked:
                    items.setdefault(item, []).append((postings, weight))
        if block is not None:
            score()
            yield from done()

    return trimmed(run)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, found = [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            own = set().union(*words(text))
            at += [i] * len(own)
            found += [w.decode() for w in own]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(found, pa.string())], ["item_id", "term"])


def weight(df: Column, n_docs: Column) -> Column:
    """floor(1000 ln((2 N + 2) / (2 df + 1))), in doubles."""
    return F.floor(1000 * F.log((2 * n_docs + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


def search(spark: SparkSession, folder: str, queries: DataFrame, item_col: str = "item_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """item_id, rank, doc_id, score: of each item the documents with the greatest scores above 0."""
    index, n_docs = spark.read.parquet(f"{folder}/index"), spark.read.parquet(f"{folder}/sums").first()["docs"]
    asked = queries.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(_terms, "item_id long, term string").distinct()
    held = index.where("term is not null")
    df = held.select("term", "df").join(few(asked.select("term").distinct(), 100_000), "term").groupBy("term").agg(weight(F.sum("df"), F.lit(n_docs)).alias("weight"))
    items = asked.select("item_id").distinct().withColumn("hashed", F.xxhash64("item_id"))
    blocks = F.floor(F.lit(items.count()) / settings.queries).cast("long") + 1
    items = items.withColumn("asked_block", F.pmod("hashed", blocks)).withColumn("item", F.row_number().over(Window.partitionBy("asked_block").orderBy("hashed", "item_id")))
    items = items.select("item_id", "asked_block", "item")
    known = asked.join(items, asked["item_id"].eqNullSafe(items["item_id"])).join(df, "term")
    known = known.groupBy("term", "asked_block").agg(F.first("weight").alias("weight"), F.collect_list("item").alias("asked"))  # at most as many as a block has queries
    rows = held.join(few(known, 100_000), "term").select("asked_block", "segment", "df", "heads", "bits", "weight", "asked")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartition(n, "asked_block", "segment").sortWithinPartitions("asked_block", "segment").mapInArrow(_searcher(settings), _FOUND)
    docs = index.where("term is null").select("segment", "number", "doc_id")
    named = found.join(docs, ["segment", "number"]).join(items, ["asked_block", "item"])
    order = Window.partitionBy("asked_block", "item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "segment", "number")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.top).select("item_id", "rank", "doc_id", "score")
