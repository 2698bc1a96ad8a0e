"""Packing by vector bins: pieces fill sequences under limits on tokens, segments and loss-bearing tokens.

A bin is filled by the dot-product rule: of the pieces that fit, the one whose demand (tokens, one segment, loss
tokens, each as a share of its limit) has the largest inner product with what the bin has left goes in next.

Packing runs inside each input partition over a window of documents; what a window leaves goes on to the next,
so a task holds a bounded number of ids, and no shuffle is needed. A partition's rows come in the same order when
a lost task is run again, so the result is the same.

Defined results: a null or empty text has the end id alone; null and repeated ids keep a row each; ties of the
rule fall to the piece that came first; the rows with a null conversation id are one conversation; an empty table gives no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolith.llm.chat import END, Template, format_conversations
from agrolith.llm.common import bounded_batches, checkpoint, trimmed
from agrolith.llm.encode import encoder


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


@dataclass
class Packer:
    """Bins over pieces (tag, start, tokens, loss, segments). With ``cut`` a piece may be divided anywhere; its loss tokens are then its last ones."""

    limits: Limits
    cut: bool
    #: Pieces that wait: parallel lists of tags and rows of [start, tokens, loss, segments].
    tags: list = field(default_factory=list)
    rows: list = field(default_factory=list)

    def add(self, tag, tokens: int, loss: int, segments: int = 1) -> list[list[tuple]]:
        """Take a document; bins that its own tokens fill at once are returned."""
        most, start, out = self.limits, 0, []
        if not self.cut and (tokens > most.tokens or loss > most.loss or segments > most.segments):
            raise ValueError(f"an example of {tokens} tokens and {loss} loss tokens does not fit a sequence; allow cutting or filter it out")
        while self.cut and tokens - start >= most.tokens and most.loss >= most.tokens:
            out.append([(tag, start, most.tokens)])
            start += most.tokens
        if tokens > start:
            self.tags.append(tag)
            self.rows.append([start, tokens - start, min(loss, tokens - start), segments])
        return out

    def fill(self, final: bool) -> Iterator[list[tuple]]:
        """Bins of waiting pieces. Unless final, pieces stay that would not fill a bin."""
        if not self.rows:
            return
        top = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        start, need = np.array([r[0] for r in self.rows]), np.array([[r[1], r[3], r[2]] for r in self.rows])
        share, live = need / top, np.ones(len(need), bool)
        while live.any() and (final or need[live, 0].sum() >= self.limits.tokens):
            left, chosen = np.array([self.limits.tokens, self.limits.segments, self.limits.loss]), []
            while left.min() > 0:
                fits = live & (need <= left).all(axis=1)
                if fits.any():
                    k = int(np.where(fits, share @ (left / top), -1.0).argmax())
                    size = int(need[k, 0])
                elif self.cut and live.any():
                    k = int(np.where(live, share @ (left / top), -1.0).argmax())
                    # The cut piece keeps its first tokens; those bear loss only beyond its leading tokens without loss.
                    size = int(min(left[0], need[k, 0], need[k, 0] - need[k, 2] + left[2]))
                else:
                    break
                chosen.append((self.tags[k], int(start[k]), size))
                loss = max(0, size - int(need[k, 0] - need[k, 2]))
                left = left - (size, need[k, 1], loss)
                start[k] += size
                need[k] -= (size, 0, loss)
                share[k] = need[k] / top
                live[k] = need[k, 0] > 0
            yield chosen
        self.tags = [t for t, on in zip(self.tags, live, strict=True) if on]
        self.rows = [[int(s), int(n[0]), int(n[2]), int(n[1])] for s, n, on in zip(start, need, live, strict=True) if on]


def powers_of_two(bin_: list[tuple], full: int) -> list[list[tuple]]:
    """A bin that is not full, as bins whose sizes are powers of two, largest first: those need no padding."""
    total = sum(p[2] for p in bin_)
    if total == full:
        return [bin_]
    out, rest = [], [list(p) for p in bin_]
    while total:
        room = size = 1 << (total.bit_length() - 1)
        own = []
        while room:
            tag, start, n = rest[0]
            take = min(n, room)
            own.append((tag, start, take))
            room -= take
            rest[0][1:] = start + take, n - take
            if take == n:
                rest.pop(0)
        out.append(own)
        total -= size
    return out


_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_documents(df: DataFrame, tokenizer_path: str, end_id: int, limits: Limits = Limits(), window: int = 1024, id_col: str = "doc_id", text_col: str = "text", remembered: int = 500_000) -> DataFrame:
    """Encode documents and pack them, cutting freely. A row for each piece: its place in the document and in its sequence, and its ids (little-endian unsigned 32-bit).

    All tokens of a document bear loss. A sequence's id is its partition times 2^32 plus its number there. The few
    tokens that a partition's last pieces leave become sequences of a power of two each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path, remembered).encode, np.array([end_id], "<u4").tobytes()
        packer, number = Packer(limits, cut=True), TaskContext.get().partitionId() << 32
        out: list[tuple] = []

        def emit(bins):
            nonlocal number
            for own in bins:
                at = 0
                for (doc, total, base, ids), start, size in own:
                    out.append((doc, start, size, total, number, at, ids[4 * (start - base) : 4 * (start - base + size)]))
                    at += size
                number += 1

        def flush():
            names = _SCHEMA.replace(",", "").split()[::2]
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds, strict=True)], names)
            out.clear()

        for batch in bounded_batches(batches, 2 << 20):
            texts = batch.column(1).to_pylist()
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                ids += end
                n = len(ids) // 4
                waiting = len(packer.rows)
                emit(packer.add((doc, n, 0, ids), n, n))
                if len(packer.rows) > waiting:  # of a long document only what its full sequences left is kept
                    base = packer.rows[-1][0]
                    packer.tags[-1] = (doc, n, base, ids[4 * base :])
                if len(packer.rows) >= window:
                    emit(packer.fill(final=False))
            if out:
                yield from flush()
        emit(p for own in packer.fill(final=True) for p in powers_of_two(own, limits.tokens))
        if out:
            yield from flush()

    if limits.loss < limits.tokens:
        raise ValueError("all tokens of a document bear loss: its limit can't be below that of tokens")
    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(trimmed(run), _SCHEMA)


def pack_examples(df: DataFrame, limits: Limits, id_col: str, tokens_col: str, loss_col: str, segments_col: str | None = None, window: int = 1024) -> DataFrame:
    """Place whole examples of instruction data, of which the tokens and loss-bearing tokens are known: id_col, sequence_id, offset.

    Without ``segments_col`` an example is one segment. A null count is 0; an example without tokens has no place and gets no row. One that
    exceeds a limit alone raises an error.
    """
    schema = df.select(F.col(id_col).alias("example"), F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, number = Packer(limits, cut=False), TaskContext.get().partitionId() << 32

        def place(final: bool):
            nonlocal number
            rows = []
            for own in packer.fill(final):
                at = 0
                for tag, _, size in own:
                    rows.append((tag, number, at))
                    at += size
                number += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds, strict=True)], ["example", "sequence_id", "offset"])

        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64()]
            for tag, tokens, loss, segments in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                packer.add(tag, tokens, min(loss, tokens), segments)
                if len(packer.rows) >= window:
                    yield from place(False)
        yield from place(True)

    counts = [F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in (tokens_col, loss_col)]
    segments = F.coalesce(F.col(segments_col).cast("long"), F.lit(0)) if segments_col else F.lit(1).cast("long")
    rows = df.select(F.col(id_col).alias("example"), counts[0].alias("tokens"), counts[1].alias("loss"), segments.alias("segments"))
    return rows.mapInArrow(run, schema).withColumnRenamed("example", id_col)


def conversation_demands(segments: DataFrame) -> DataFrame:
    """(conv_id, tokens, turns, loss) of conversations as ``chat.format_conversations`` gives them; no text can hold the end marker."""
    marked = F.hex("loss")
    ones = F.length(marked) - F.length(F.replace(marked, F.lit("1"), F.lit("")))
    turns = (F.length("formatted") - F.length(F.replace("formatted", F.lit(END), F.lit("")))) / len(END)
    return segments.groupBy("conv_id").agg(F.sum(F.length("ids") / 4).cast("long").alias("tokens"), F.sum(turns).cast("long").alias("turns"), F.sum(ones).cast("long").alias("loss"))


def pack_conversations(df: DataFrame, template: Template, limits: Limits, window: int = 1024) -> DataFrame:
    """(conv_id, sequence_id, offset, tokens, turns, loss, fits): whole conversations in sequences under all three limits.

    A conversation that exceeds a limit by itself has a sequence of its own and ``fits`` false.
    """
    demands = checkpoint(conversation_demands(format_conversations(df, template)).withColumn("key", F.monotonically_increasing_id()))
    fits = (F.col("tokens") <= limits.tokens) & (F.col("turns") <= limits.segments) & (F.col("loss") <= limits.loss)
    places = pack_examples(demands.where(fits), limits, "key", "tokens", "loss", "turns", window)
    placed = demands.where(fits).join(places, "key").withColumn("fits", F.lit(True))
    alone = demands.where(~fits).withColumns({"sequence_id": F.lit(1 << 60) + F.col("key"), "offset": F.lit(0).cast("long"), "fits": F.lit(False)})
    names = ("conv_id", "sequence_id", "offset", "tokens", "turns", "loss", "fits")
    return placed.select(*names).unionByName(alone.select(*names))
