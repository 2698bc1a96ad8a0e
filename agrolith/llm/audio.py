"""Chroma audio fingerprints in media columns, and the alignment of recordings by them.

A recording (16-bit PCM WAV bytes) becomes frames of twelve pitch-class energies. Sixteen filters, differences of
rectangle sums over a window of frames, are taken at every frame through an integral image; each is quantised to two
Gray-coded bits, the sign and whether it is near zero, which gives one 32-bit integer a frame.

Recordings with equal fingerprints form a class, and search works on classes, by numbers of their own: ids may be null or
repeated. Queries meet the others where keys are equal; a histogram of the differences of their positions shows the offsets
at which two recordings may align, and the share of differing bits over the overlap confirms one, where it is at most
``max_error``. A key is made of the signs in two integers a window apart, which share no frame. Signs differ less often than
the other bits, and of the integers' other bits few may differ; a query also looks up what comes of flipping the ``flips`` least certain signs of either integer. So most
of what differs by up to ``max_error`` is found: tests measure the share against brute force. Recordings of up to two windows
are looked up, and look up, by their integers as they are, where one equal integer makes a candidate.

A key in very many recordings is looked up in parts of bounded size, all of them.

Of equal keys in a row only the first and the last are kept, so a hum has few.

Defined results: null, empty, silent or too short recordings have a fingerprint without integers and match nothing, and
are one class; bytes that are no 16-bit WAV count as such; stereo is mixed down; repeated rows keep a row each; rows with equal
ids and other sounds are classes of their own, and may match one another; a class is named by its least id, null where all its ids are; of offsets
that pass, the one with the least error wins, then the least absolute, then the least; an empty table gives no rows.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrolith.llm.common import bounded_batches, checkpoint
from agrolith.llm.mixing import few


@dataclass(frozen=True)
class Settings:
    frame_s: float = 0.256
    hop_s: float = 0.064
    low_hz: float = 100.0
    high_hz: float = 1800.0
    #: A filter's window in frames.
    window: int = 16
    max_error: float = 0.25
    #: Equal keys at the same offset that make a candidate; a pair of integers with more differing bits than this (of 64) is no hit.
    min_hits: int = 2
    hit_bits: int = 11
    #: Least certain signs of an integer that a query flips.
    flips: int = 3
    min_overlap: float = 0.5
    #: Postings of a key that one task may hold; those of more frequent keys are dealt over several.
    dealt: int = 256


def wav(samples: np.ndarray, rate: int) -> bytes:
    """16-bit mono WAV bytes of samples in -1 .. 1."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def samples_of(data: bytes | None) -> tuple[np.ndarray, int]:
    try:
        with wave.open(io.BytesIO(data or b"")) as f:
            if f.getsampwidth() != 2:
                return np.zeros(0), 1
            x = np.frombuffer(f.readframes(f.getnframes()), "<i2").astype(float) / 32768
            return x[: len(x) // f.getnchannels() * f.getnchannels()].reshape(-1, f.getnchannels()).mean(axis=1), f.getframerate()
    except (wave.Error, EOFError):
        return np.zeros(0), 1


def chroma(x: np.ndarray, rate: int, s: Settings) -> np.ndarray:
    """Frames of twelve pitch-class energies, each of unit length where it is not silent."""
    size, hop = max(2, int(s.frame_s * rate)), max(1, int(s.hop_s * rate))
    if len(x) < size:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    hz = np.fft.rfftfreq(size, 1 / rate)
    use = np.flatnonzero((hz >= s.low_hz) & (hz <= s.high_hz))
    classes = np.rint(12 * np.log2(hz[use] / 440.0)).astype(int) % 12
    onto = np.zeros((len(use), 12))
    onto[np.arange(len(use)), classes] = 1
    shape, out = np.hanning(size), []
    for i in range(0, len(frames), 256):
        out.append(np.abs(np.fft.rfft(frames[i : i + 256] * shape, axis=1)[:, use]) ** 2 @ onto)
    energy = np.concatenate(out)
    length = np.linalg.norm(energy, axis=1, keepdims=True)
    return np.divide(energy, length, out=np.zeros_like(energy), where=length > 1e-9)


def filters(window: int) -> list[tuple[int, int, int, int]]:
    """Sixteen filters (kind, first pitch class, height, width), by rule.

    Kind 0 takes the sum of a rectangle, 1 its upper less its lower half, 2 its later less its earlier half, 3 the two
    diagonal quarters less the others.
    """
    return [(i % 4, 3 * i % (12 - h + 1), h, w) for i in range(16) for h, w in [(2 + 2 * (i // 4), max(2, window >> (i // 4) % 3))]]


def values(energy: np.ndarray, s: Settings) -> np.ndarray:
    """A row for each window of frames and a column for each filter; no rows for silence throughout."""
    n = len(energy) - s.window + 1
    if n <= 0 or not energy.any():
        return np.zeros((0, 16))
    image = np.zeros((len(energy) + 1, 13))
    image[1:, 1:] = energy.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return image[at + t1, c1] - image[at + t0, c1] - image[at + t1, c0] + image[at + t0, c0]

    out = []
    for kind, c, h, w in filters(s.window):
        ch, tw, total = c + h // 2, w // 2, area(0, w, c, c + h)
        if kind == 0:
            out.append(total / (area(0, w, 0, 12) + 1e-9) - h / 12)
        elif kind == 1:
            out.append((area(0, w, ch, c + h) - area(0, w, c, ch)) / (total + 1e-9))
        elif kind == 2:
            out.append((area(tw, w, c, c + h) - area(0, tw, c, c + h)) / (total + 1e-9))
        else:
            out.append((area(0, tw, c, ch) + area(tw, w, ch, c + h) - area(0, tw, ch, c + h) - area(tw, w, c, ch)) / (total + 1e-9))
    return np.stack(out, axis=1)


def packed(v: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each row of filters' values: two Gray-coded bits each, the first filter's highest."""
    out = np.zeros(len(v), np.uint32)
    for column in v.T:
        level = np.digitize(column, (-0.15, 0.0, 0.15)).astype(np.uint32)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1))
    return out


def items(energy: np.ndarray, s: Settings) -> np.ndarray:
    return packed(values(energy, s))


def signs(x: np.ndarray) -> np.ndarray:
    """The sixteen sign bits of integers."""
    return sum((x >> np.uint32(2 * i + 1) & np.uint32(1)) << np.uint32(i) for i in range(16)).astype(np.uint32)


def uncertain(v: np.ndarray, n: int) -> np.ndarray:
    """For each row of filters' values the n filters nearest to zero, as positions of their sign bits, four bits each."""
    nearest = np.argsort(np.abs(v), axis=1, kind="stable")[:, :n]
    return sum(((15 - nearest[:, i]).astype(np.uint16) << np.uint16(4 * i) for i in range(n)), np.zeros(len(v), np.uint16)).astype(np.uint16)


def fingerprints(df: DataFrame, id_col: str, audio_col: str, settings: Settings = Settings()) -> DataFrame:
    """id_col, items (little-endian unsigned 32-bit integers) and weak (16 bits for each: its least certain signs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, 8 << 20):
            own = [values(chroma(*samples_of(x), settings), settings) for x in batch.column(1).to_pylist()]
            columns = [[packed(v).astype("<u4").tobytes() for v in own], [uncertain(v, settings.flips).astype("<u2").tobytes() for v in own]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.binary()) for c in columns]], [id_col, "items", "weak"])

    return df.select(F.col(id_col).cast("long"), audio_col).mapInArrow(run, f"{id_col} long, items binary, weak binary")


_POSTING = "node long, item long, at int, bits long"
#: Key spaces: signs of two integers; single integers of all recordings; those of short ones.
_PAIRS, _ALL, _SHORT = 0, 1 << 33, 2 << 33


def _ends(keys: np.ndarray) -> np.ndarray:
    """Positions of the first and the last of equal keys in a row."""
    change = np.flatnonzero(np.diff(keys)) + 1
    return np.unique(np.concatenate([[0], change, change - 1, [len(keys) - 1]])) if len(keys) else np.zeros(0, np.int64)


def _variants(x: np.ndarray, weak: np.ndarray, flips: int) -> np.ndarray:
    """Signs of integers, a column for each choice of flips."""
    out = signs(x)[:, None]
    for i in range(flips):
        out = np.concatenate([out, out ^ (np.uint32(1) << (weak >> np.uint16(4 * i) & np.uint16(15)).astype(np.uint32))[:, None]], axis=1)
    return out.astype(np.int64)


def _both(x: np.ndarray, at: np.ndarray, gap: int) -> np.ndarray:
    """The two integers of a key, whole."""
    return (x[at].astype(np.int64) << 32) | x[at + gap].astype(np.int64)


def stored_keys(x: np.ndarray, gap: int, singles: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, positions, integers) by which a recording is found."""
    pair = signs(x[:-gap]).astype(np.int64) << 16 | signs(x[gap:]) if len(x) > gap else np.zeros(0, np.int64)
    at = _ends(pair)
    keys, places, whole = [pair[at] | _PAIRS], [at], [_both(x, at, gap)]
    if singles:
        one = x.astype(np.int64)
        own = _ends(one)
        for space in (_ALL, _SHORT) if len(x) <= 2 * gap else (_ALL,):
            keys.append(one[own] | space)
            places.append(own)
            whole.append(np.zeros(len(own), np.int64))  # equal keys are equal integers
    return np.concatenate(keys), np.concatenate(places).astype(np.int32), np.concatenate(whole)


def asked_keys(x: np.ndarray, weak: np.ndarray, gap: int, flips: int, singles: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, positions, integers) that a query looks up."""
    keys, places, whole = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(x) > gap:
        pair = signs(x[:-gap]).astype(np.int64) << 16 | signs(x[gap:])
        at = _ends(pair)
        first, second = _variants(x[at], weak[at], flips), _variants(x[at + gap], weak[at + gap], flips)
        keys.append((first[:, :, None] << 16 | second[:, None, :] | _PAIRS).ravel())
        places.append(np.repeat(at, first.shape[1] ** 2))
        whole.append(np.repeat(_both(x, at, gap), first.shape[1] ** 2))
    if singles:
        one = x.astype(np.int64)
        own = _ends(one)
        keys.append(one[own] | (_ALL if len(x) <= 2 * gap else _SHORT))
        places.append(own)
        whole.append(np.zeros(len(own), np.int64))
    return np.concatenate(keys), np.concatenate(places).astype(np.int32), np.concatenate(whole)


def _postings(keys_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, 1 << 16):
            nodes, keys, places, whole = [], [], [], []
            for node, data, weak in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                x = np.frombuffer(data, "<u4")
                key, at, bits = keys_of(x, np.frombuffer(weak, "<u2") if weak else np.zeros(len(x), np.uint16))
                nodes.append(np.full(len(key), node, np.int64))
                keys.append(key)
                places.append(at)
                whole.append(bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (nodes, keys, places, whole)], ["node", "item", "at", "bits"])

    return run


def _aligned(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, 8 << 20):
            rows = []
            for q, c, shifts, qi, ci in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                a, b, best = np.frombuffer(qi, "<u4"), np.frombuffer(ci, "<u4"), None
                for off in shifts:
                    first, last = max(0, -off), min(len(a), len(b) - off)
                    if last - first >= settings.min_overlap * min(len(a), len(b)):
                        error = float(np.bitwise_count(a[first:last] ^ b[first + off : last + off]).mean() / 32)
                        if error <= settings.max_error:
                            best = min(best or (2.0, 0, 0), (error, abs(off), off))
                if best:
                    rows.append((q, c, best[2], best[0]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)], ["query", "found", "shift", "bit_error"])

    return run


def _met(asked: DataFrame, post: DataFrame, most: int) -> DataFrame:
    """Queries' keys beside the postings of equal keys. A key with more postings than ``most`` (a jingle in many recordings) has
    them dealt over as many parts as that takes, and a query's key goes to each: no task holds all of them."""
    post = checkpoint(post)
    counts = post.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") > most)
    hot = few(counts.select("item", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    post = post.join(hot, "item", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("node", "at"), F.col("parts")).cast("int"))).drop("parts")
    asked = asked.join(hot, "item", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return asked.join(post, ["item", "part"])


def search(prints: DataFrame, id_col: str, is_query: Column, settings: Settings = Settings()) -> DataFrame:
    """id_col, n_items, class_id and, for classes that hold a query, the other classes that align with it.

    ``matches`` is an array of (match, offset, bit_error) by match; it is empty where nothing aligns and null where the row
    is no query. An offset counts frames from the query's position to the match's. Without a column ``weak`` nothing is flipped.
    """
    gap, flips = settings.window, settings.flips if "weak" in prints.columns else 0
    weak = F.col("weak") if flips else F.lit(None).cast("binary").alias("weak")
    rows = checkpoint(prints.select(F.col(id_col).alias("id"), "items", weak, F.md5("items").alias("key"), is_query.alias("is_query")))
    own = rows.groupBy("key").agg(F.min("id").alias("class_id"), F.max("is_query").alias("asked"), F.first(F.struct("items", "weak")).alias("print"))
    own = checkpoint(own.select("key", "class_id", "asked", "print.items", "print.weak", F.monotonically_increasing_id().alias("node")))
    kept = own.select("node", "items", "weak")
    singles = not own.where((F.length("items") > 0) & (F.length("items") <= 8 * gap)).isEmpty()
    post = kept.mapInArrow(_postings(lambda x, _: stored_keys(x, gap, singles)), _POSTING)
    asked = own.where("asked").select("node", "items", "weak").mapInArrow(_postings(lambda x, w: asked_keys(x, w, gap, flips, singles)), _POSTING)
    asked = asked.select(F.col("node").alias("q"), "item", F.col("at").alias("q_at"), F.col("bits").alias("q_bits"))
    enough = F.count("*") >= F.min(F.when(F.col("item") >= _ALL, 1).otherwise(settings.min_hits))
    alike = F.bit_count(F.col("bits").bitwiseXOR(F.col("q_bits"))) <= settings.hit_bits
    hits = _met(asked, post, settings.dealt).where(F.col("q") != F.col("node")).where(alike).groupBy("q", "node", (F.col("at") - F.col("q_at")).alias("shift")).agg(enough.alias("enough")).where("enough")
    near = hits.groupBy("q", "node").agg(F.collect_list("shift").alias("shifts"))  # at most as many as there are offsets of two recordings
    pairs = near.join(kept.select(F.col("node").alias("q"), F.col("items").alias("q_items")), "q").join(kept.select("node", "items"), "node").select("q", "node", "shifts", "q_items", "items")
    found = pairs.mapInArrow(_aligned(settings), "query long, found long, shift int, bit_error double")
    found = found.join(own.select("node", F.col("class_id").alias("match")), F.col("found") == F.col("node"))
    lists = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("match", F.col("shift").alias("offset"), "bit_error"))).alias("found"))
    named = own.join(lists, F.col("node") == F.col("query"), "left").select("key", "class_id", "found")
    empty = F.array().cast("array<struct<match:bigint,offset:int,bit_error:double>>")
    out = rows.join(named, "key")
    return out.select(F.col("id").alias(id_col), (F.length("items") / 4).cast("long").alias("n_items"), "class_id", F.when(F.col("is_query"), F.coalesce("found", empty)).alias("matches"))


def with_copies(df: DataFrame, id_col: str, vector_col: str, every: int = 4) -> DataFrame:
    """id_col, vector_col, noise and copy_of: all vectors, and of each whose id ``every`` divides a copy by a stated rule.

    The copy of id i has id -(i + 1), lacks the first 4 + i % 8 and the last 4 elements, and is to be played under noise of
    0.05 (1 + i / every % 6). Rows without an id have no copy.
    """
    i = F.col(id_col).cast("long")
    rows = df.select(i.alias(id_col), vector_col, F.lit(0.0).alias("noise"), F.lit(None).cast("long").alias("copy_of"))
    first = 5 + F.pmod(i, F.lit(8)).cast("int")
    cut = F.slice(vector_col, first, F.greatest(F.size(vector_col) - 4 - first + 1, F.lit(0)))
    copies = df.where(i % every == 0).select((-(i + 1)).alias(id_col), cut.alias(vector_col), (0.05 * (1 + F.pmod(F.floor(i / every), F.lit(6)))).cast("double").alias("noise"), i.alias("copy_of"))
    return rows.unionByName(copies)


def tones(df: DataFrame, id_col: str, vector_col: str, noise_col: str | None = None, rate: int = 4000, note_s: float = 0.125) -> DataFrame:
    """id_col and audio: a recording for each vector of numbers, one note an element. For tests and tables without media.

    Noise is as loud as its column says, and the same whenever a row is played again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors, noise = (batch.column(k).to_pylist() for k in range(3))
            for first in range(0, len(ids), 64):
                own = []
                for i, v, loud in zip(ids[first : first + 64], vectors[first : first + 64], noise[first : first + 64], strict=True):
                    x = np.nan_to_num(np.array([0.0 if e is None else e for e in v or []], float))
                    hz = 220.0 * 2 ** (np.floor(18 * np.tanh(4 * x)) / 12)
                    played = 0.5 * np.sin(np.cumsum(np.repeat(2 * np.pi * hz / rate, int(note_s * rate))))
                    if loud:
                        played += loud * np.random.default_rng(abs(i or 0)).normal(size=len(played))
                    own.append(wav(played, rate) if len(x) else None)
                yield pa.RecordBatch.from_arrays([pa.array(ids[first : first + 64], pa.int64()), pa.array(own, pa.binary())], [id_col, "audio"])

    noise = F.col(noise_col).cast("double") if noise_col else F.lit(0.0)
    return df.select(F.col(id_col).cast("long"), vector_col, noise).mapInArrow(run, f"{id_col} long, audio binary")
