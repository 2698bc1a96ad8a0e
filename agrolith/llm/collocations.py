"""Collocations: frequent phrases of two to four words, mined with hashed buckets (PCY, DHP) and Apriori pruning.

A pass over the texts for each length counts its candidates exactly and, in the same pass, counts the phrases of the next
length in hashed buckets. Before a length is counted, two bit sets reach every task: the buckets that hold enough phrases of
that length, and where the frequent phrases of the length before hash to. A phrase is counted only if its bucket is in the
first and both phrases that lack its first or last word are in the second. Bit sets only rule out: what passes is counted by
its words, so the counts are exact.

Buckets saturate at the least count that matters, one byte each: whether a sum reaches it stays the same. Tasks count before
anything is shuffled, so a word in every text is one row a task. The bit sets have at most 2^``most_bits`` bits, whatever the
input; beyond that, more of them are set, and more phrases that are rare get counted.

Defined results: A to Z become lower case; a null text has no words; a null language counts as ``und``; repeated rows and ids count each; an empty
table gives no rows; texts are split in blocks of bounded size, a phrase across a cut counts once; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agrolith.llm.common import Scratch, bounded_batches, checkpoint, drop_caches, trimmed


@dataclass(frozen=True)
class Settings:
    min_count: int = 30
    longest: int = 4
    #: Rows of each language in the result.
    top: int = 2000
    #: A candidate goes if a longer one that holds it has at least this percentage of its count.
    inside_percent: int = 80
    #: Buckets for each occurrence of a word, and the most bits of a bucket's number.
    buckets_a_word: float = 0.25
    most_bits: int = 26


#: A to Z in lower case, the marks between pieces as line feeds, tabs as spaces.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
_BREAK = re.compile(rb"[ \n]")
_BLOCK = 1 << 20
_PART = 1 << 16
_MOST_WORDS, _MOST_PHRASES = 400_000, 400_000
_FOUND = "lang string, phrase string, n long, part int, counts binary"


def _blocks(texts: list[str | None]) -> Iterator[tuple[bytes, bool]]:
    """Texts in blocks of about 1 MB, and whether a block goes on where the one before was cut, always beside a word."""
    waiting, size = [], 0
    for text in texts:
        data = (text or "").encode().translate(_PLAIN)
        if len(data) > _BLOCK:
            at = 0
            while at < len(data):
                cut = _BREAK.search(data, min(at + _BLOCK, len(data)))
                end = cut.start() if cut else len(data)
                yield data[at:end], at > 0
                at = end
            continue
        waiting.append(data)
        size += len(data) + 1
        if size >= _BLOCK:
            yield b"\n".join(waiting), False
            waiting, size = [], 0
    if waiting:
        yield b"\n".join(waiting), False


class _Words(dict):
    """Numbers of the words of one language in a task, and their hashes. 0 is the end of a piece, 1 no word."""

    def __init__(self, lang: str):
        super().__init__({b"\n": 0, b"": 1})
        self.names, self.hashes = [b"\n", b""], np.zeros(2, np.uint64)
        self.seed = xxhash.xxh3_64_intdigest(lang)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.names)
        self.names.append(word)
        return n

    def numbers(self, data: bytes) -> np.ndarray:
        words = data.replace(b"\n", b" \n ").split(b" ")
        out = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self.names) > len(self.hashes):
            new = [xxhash.xxh3_64_intdigest(w, self.seed) for w in self.names[len(self.hashes) :]]
            self.hashes = np.concatenate([self.hashes, np.array(new, np.uint64)])
        return out[out != 1]


def _hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Of every n words in a row, from those of the words."""
    size = max(0, len(h) - n + 1)
    out = h[:size].copy()
    for j in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : j + size]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


@dataclass(frozen=True)
class Bits:
    """A set of hashes by their first bits; may hold more than was put in."""

    bits: int
    data: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _unique_runs(ids: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n numbers in a row from each start: a start of each distinct run and its count."""
    key = ids[starts] << 32 | ids[starts + 1]
    if n > 2:
        pairs = key if n == 3 else np.concatenate([key, ids[starts + 2] << 32 | ids[starts + 3]])
        number = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        key = number << 32 | ids[starts + 2] if n == 3 else number[: len(starts)] << 32 | number[len(starts) :]
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return starts[first], count


def _parts(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The parts of bucket counts that aren't empty: whole, or as (position, count) of three bytes where that is shorter."""
    for part in range(-(-len(counts) // _PART)):
        own = counts[part * _PART : (part + 1) * _PART]
        at = np.flatnonzero(own)
        if 3 * len(at) >= len(own):
            yield part, b"d" + own.tobytes()
        elif len(at):
            yield part, b"s" + at.astype("<u2").tobytes() + own[at].tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray | slice, np.ndarray]:
    if data[:1] == b"d":
        return slice(0, len(data) - 1), np.frombuffer(data, np.uint8, offset=1)
    n = (len(data) - 1) // 3
    return np.frombuffer(data, "<u2", n, 1), np.frombuffer(data, np.uint8, n, 1 + 2 * n)


def _rows(phrases: list[tuple], parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    names = _FOUND.replace(",", "").split()[::2]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary())
    rows = [(*p, None, None) for p in phrases] + [(None, None, None, *p) for p in parts]
    for at in range(0, len(rows), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[at : at + 20_000]), kinds, strict=True)], names)


def _counted(n: int, buckets: int, s: Settings, shorter: Bits | None, allowed: Bits | None):
    """A task that counts candidates of n words and, in 2^``buckets`` buckets, phrases of one word more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        tables: dict[str, _Words] = {}
        words: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(0, np.int64))
        phrases: Counter = Counter()
        next_counts = np.zeros(1 << buckets if n < s.longest else 0, np.uint8)
        context = s.longest - 1

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(lang, p.decode(), c) for (lang, p), c in phrases.items()]
            for lang, counts in words.items():
                rows += [(lang, tables[lang].names[i].decode(), int(counts[i])) for i in np.flatnonzero(counts)]
            yield from _rows(rows, [])
            phrases.clear()
            words.clear()
            if sum(map(len, tables.values())) > _MOST_WORDS:
                tables.clear()

        def count(lang: str, table: _Words, ids: np.ndarray) -> None:
            known, own = ids > 0, table.hashes[ids]

            def whole(k: int) -> np.ndarray:
                size = max(0, len(ids) - k + 1)
                out = np.arange(size) >= context - k + 1
                for j in range(k):
                    out &= known[j : j + size]
                return out

            if n == 1:
                new = np.bincount(ids[context:][ids[context:] > 0], minlength=len(table.names))
                new[: len(words[lang])] += words[lang]
                words[lang] = new
                going = whole(2)
            else:
                short = shorter.has(_hashes(own, n - 1))
                here = np.flatnonzero(short[:-1] & short[1:]) if len(short) else np.zeros(0, np.int64)
                inside = np.ones(len(here), bool)
                for j in range(n):
                    inside &= known[here + j]
                here = here[inside]
                here = here[allowed.has(_hashes(own, n)[here])]
                starts = here[here >= context - n + 1]
                if len(starts):
                    for at, c in zip(*(x.tolist() for x in _unique_runs(ids, starts, n)), strict=True):
                        phrases[lang, b" ".join([table.names[w] for w in ids[at : at + n].tolist()])] += c
                if n == s.longest:
                    return
                on = np.zeros(len(ids), bool)
                on[here] = True
                going = (on[:-1] & on[1:])[: max(0, len(ids) - n)]
                going = going & (np.arange(len(going)) >= context - n)
            chosen = _hashes(own, n + 1)[going] >> np.uint64(64 - buckets)
            at, c = np.unique(chosen, return_counts=True)
            next_counts[at] = np.minimum(next_counts[at] + c, s.min_count)

        for batch in bounded_batches(batches, 4 << 20):
            rows = sorted(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), key=lambda r: r[0])
            for lang, own in groupby(rows, key=lambda r: r[0]):
                before = np.zeros(context, np.int64)
                for data, goes_on in _blocks([t for _, t in own]):
                    if lang not in tables:
                        tables[lang] = _Words(lang)
                        goes_on = False
                    ids = np.concatenate([before if goes_on else np.zeros(context, np.int64), tables[lang].numbers(data)])
                    count(lang, tables[lang], ids)
                    before = ids[-context:]
            if len(phrases) > _MOST_PHRASES or sum(map(len, tables.values())) > _MOST_WORDS:
                yield from flush()
        yield from flush()
        yield from _rows([], list(_parts(next_counts)))

    return trimmed(run)


def _hashed(bits: int):
    """A task that marks where phrases hash to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seed = xxhash.xxh3_64_intdigest(lang)
                own = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in phrase.encode().split(b" ")], np.uint64)
                marks[_hashes(own, len(own)) >> np.uint64(64 - bits)] = 1
        yield from _rows([], list(_parts(marks)))

    return trimmed(run)


def _summed(least: int):
    """A task that adds up the parts it meets one after another; bits say which buckets have enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, np.zeros(_PART, np.uint16)

        def done() -> pa.RecordBatch:
            bits = np.packbits(total >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits], pa.binary())], ["part", "bits"])

        for batch in batches:
            for own, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != part:
                    if part is not None:
                        yield done()
                    part = own
                    total[:] = 0
                at, c = _unpacked(data)
                total[at] = np.minimum(total[at] + c, least)
        if part is not None:
            yield done()

    return run


def _collected(parts: DataFrame, bits: int, least: int) -> Bits:
    """At most 2^bits bits reach the driver, whatever the input's size."""
    data = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    dealt = parts.select("part", "counts").repartition("part").sortWithinPartitions("part")
    for row in dealt.mapInArrow(_summed(least), "part int, bits binary").collect():
        own = np.frombuffer(row["bits"], np.uint8)
        at = row["part"] * _PART // 8
        data[at : at + len(own)] = own[: len(data) - at]
    return Bits(bits, data)


def _bits_for(n: float, most: int) -> int:
    return min(most, max(16, int(np.ceil(np.log2(max(n, 1))))))


def frequent(df: DataFrame, scratch: Scratch, lang: Column, text: Column, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f, words) of all words and phrases that are frequent enough, and (lang, n) of all words; in the scratch folder."""
    texts = df.select(F.coalesce(lang, F.lit("und")).alias("lang"), text.alias("text")).where("text is not null")
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = _bits_for(size / 6 * s.buckets_a_word, s.most_bits)
    shorter = allowed = None
    tables, totals = [], None
    for n in range(1, s.longest + 1):
        found = scratch.saved(texts.mapInArrow(_counted(n, buckets, s, shorter, allowed), _FOUND), f"counted-{n}")
        counts = found.where("part is null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if n == 1:
            totals = scratch.saved(found.where("part is null").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        tables.append(scratch.saved(counts.where(F.col("f") >= s.min_count).withColumn("words", F.lit(n)), f"frequent-{n}"))
        if n < s.longest:
            rows = tables[-1].count()
            bits = _bits_for(16 * rows, s.most_bits)
            shorter = _collected(tables[-1].select("lang", "phrase").mapInArrow(_hashed(bits), _FOUND), bits, 1)
            allowed = _collected(found.where("part is not null"), buckets, s.min_count)
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out, totals


def collocations(df: DataFrame, lang_col: str = "lang", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language, without those that longer ones account for."""
    s = settings
    with Scratch(df.sparkSession) as scratch:
        known, totals = frequent(df, scratch, F.col(lang_col), F.col(text_col), s)
        many = known.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("parts"))
        joined = lambda first, size: F.array_join(F.slice("parts", first, size), " ")
        cuts = many.select("*", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("k"))
        cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("first"), joined(F.col("k") + 1, F.size("parts") - F.col("k")).alias("rest"))
        part = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
        score = F.expr("(2000000 * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
        scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).withColumn("score", score)
        best = scored.groupBy("lang", "phrase").agg(F.min("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        lengths = F.sequence(F.lit(2), F.size("parts") - 1)
        spans = F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), F.size("parts") - m + 1), lambda i: F.array_join(F.slice("parts", i, m), " "))))
        inside = many.where(F.size("parts") > 2).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), F.col("a").alias("longer"))
        inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        whole = lambda x: F.col(x).cast("decimal(19,0)")
        kept = best.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * whole("longer") < s.inside_percent * whole("a")))
        order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
        ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.top).join(totals, "lang")
        return checkpoint(ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
