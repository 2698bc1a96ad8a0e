"""Chat formatting: conversations as one marked text, token ids, and a loss mask aligned by offsets.

A turn is rendered as start marker, role, separator, text, end marker. Inside roles and texts the opening ``<|`` gets an
escape sign, so no text can hold a marker; the escape is reversible. A rendered conversation is encoded once, with the
markers as single tokens and with the code-point offsets of every token. The sorted spans of the trained turns are then
intersected with the sorted token spans by binary search: tokens inside a trained text bear loss, all others do not.

Rows are dealt by conversation and block of turns, so that one long conversation is spread over tasks, and a task
renders at most ``segment_turns`` turns at once, or as many as take ``segment_chars`` code points: a conversation's result is one
or more segments, in order. Markers are hard boundaries of the encoding, so segments joined are the encoding of the whole.

Defined results: rows of a conversation are ordered by turn (nulls first), then role and text; repeated rows are turns
of their own; null role or text is an empty one; the rows with a null conversation id form one conversation; an empty
table gives no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from agrolith.llm.common import bounded_batches, shuffle_partitions

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escaped(text: str | None) -> str:
    """``<|`` becomes ``<!|``, ``<!|`` becomes ``<!!|``, and so on."""
    return re.sub(r"<(!*)\|", r"<!\1|", text or "")


def unescaped(text: str) -> str:
    return re.sub(r"<!(!*)\|", r"<\1|", text)


@dataclass(frozen=True)
class Template:
    tokenizer_path: str
    trained_roles: tuple[str, ...] = ("assistant",)
    segment_turns: int = 256
    #: A segment ends with the turn that takes its texts beyond so many code points.
    segment_chars: int = 4 << 20


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    tok = Tokenizer.from_file(path)
    tok.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in (START, SEP, END)])
    return tok


def render(turns: list[tuple[str | None, str | None]], trained_roles: tuple[str, ...]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered text and the spans of trained texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escaped(role)}{SEP}", escaped(text)
        parts += [head, body, END]
        if (role or "") in trained_roles and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token shares a code point with a span; both are sorted and spans are disjoint."""
    mask = np.zeros(len(starts), bool)
    if spans:
        s = np.array(spans)
        for i, j in zip(np.searchsorted(ends, s[:, 0], "right"), np.searchsorted(starts, s[:, 1], "left"), strict=True):
            mask[i:j] = True
    return mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered text, unescaped."""
    out = []
    for turn in formatted.split(START)[1:]:
        role, rest = turn.split(SEP, 1)
        out.append((unescaped(role), unescaped(rest.removesuffix(END))))
    return out


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The text under each run of loss-bearing tokens, unescaped."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [unescaped(formatted[starts[i] : ends[j - 1]]) for i, j in edges.reshape(-1, 2)]


_SEGMENT = "conv_id long, block long, segment long, formatted string, ids binary, starts binary, ends binary, loss binary"


def format_conversations(df: DataFrame, template: Template) -> DataFrame:
    """Segments (conv_id, block, segment, formatted, ids, starts, ends, loss): in order, a conversation's rendered text, its
    token ids and their offsets (little-endian unsigned 32-bit), and a byte of 0 or 1 for each token's loss.
    """
    most = template.segment_turns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(template.tokenizer_path)
        key, number, turns, size = None, 0, [], 0
        waiting, held = [], 0  # rendered segments, and their code points

        def close() -> None:
            nonlocal number, turns, size, held
            waiting.append((*key, number, *render(turns, template.trained_roles)))
            held += len(waiting[-1][3])
            number, turns, size = number + 1, [], 0

        def segments() -> Iterator[pa.RecordBatch]:
            nonlocal held
            rows = []
            for (conv, block, at, text, spans), found in zip(waiting, tok.encode_batch([w[3] for w in waiting], add_special_tokens=False), strict=True):
                pairs = np.fromiter(chain.from_iterable(found.offsets), "<u4", 2 * len(found)).reshape(-1, 2)
                mask = loss_mask(pairs[:, 0], pairs[:, 1], spans)
                rows.append((conv, block, at, text, np.array(found.ids, "<u4").tobytes(), pairs[:, 0].tobytes(), pairs[:, 1].tobytes(), mask.astype(np.uint8).tobytes()))
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds, strict=True)], _SEGMENT.replace(",", "").split()[::2])
            waiting.clear()
            held = 0

        for batch in bounded_batches(batches):
            for conv, block, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if turns and (key != (conv, block) or len(turns) == most or size > template.segment_chars):
                    close()
                    if held > template.segment_chars // 8:
                        yield from segments()
                if key != (conv, block):
                    key, number = (conv, block), 0
                turns.append((role, text))
                size += len(text or "")
        if turns:
            close()
        if waiting:
            yield from segments()

    block = F.coalesce(F.floor(F.col("turn") / most), F.lit(-(2**62))).cast("long")
    rows = df.select(F.col("conv_id").cast("long"), block.alias("block"), F.col("role").cast("string"), F.col("text").cast("string"), "turn")
    dealt = rows.repartition(shuffle_partitions(df.sparkSession), "conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text").drop("turn")
    return dealt.mapInArrow(run, _SEGMENT)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(segments: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its segments.

    A digest needs its conversation's segments one after another; the task reads them as a stream and keeps the state of the hashes only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = _DIGEST.replace(",", "").split()[::2], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out, state, key = [], None, None

        def close():
            out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in bounded_batches(batches):
            for x in batch.to_pylist():
                if state is None or x["conv_id"] != key:
                    if state is not None:
                        close()
                    key, state = x["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(x["formatted"]):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                starts, ends, mask = np.frombuffer(x["starts"], "<u4"), np.frombuffer(x["ends"], "<u4"), np.frombuffer(x["loss"], np.uint8)
                for text in masked_texts(x["formatted"], starts, ends, mask):
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(x["formatted"])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names)
                out.clear()
        if state is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names)

    n = shuffle_partitions(segments.sparkSession)
    kept = segments.select("conv_id", "block", "segment", "formatted", "starts", "ends", "loss")
    return kept.repartition(n, "conv_id").sortWithinPartitions("conv_id", "block", "segment").mapInArrow(run, _DIGEST)
