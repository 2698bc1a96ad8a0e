"""Best-fit packing by linear grouping: whole documents in as few sequences as can be found.

Large lengths, sorted, form groups of equal cardinality, and each counts as the largest of its group, so there are few sizes. How
often each combination of sizes that fits a sequence is used solves a linear programme, by column generation with a knapsack
for the next combination, rounded down. Actual documents then take the places of their group, and what is left, with all small
ones, goes largest first where it leaves the least room.

The plan is made from how many pieces have each length: at most as many numbers as a sequence has tokens, whatever the input. It says which
positions in the order of lengths go to which sequences, as ranges. Everything of documents is numbered, joined and summed
by Spark. Numbers of one length are dealt by task, so a length that a third of all pieces share is nothing special.

Defined results: a null or empty text has the end id alone; null and repeated ids keep a row each; an empty table gives no
rows; longer documents are cut into full pieces, the first piece may be shorter; ties in length fall to the row that was
read first. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agrolith.llm.common import Scratch, bounded_batches, checkpoint, trimmed
from agrolith.llm.encode import encoder


@dataclass(frozen=True)
class Settings:
    tokens: int = 1024
    #: Lengths above a share of the limit are grouped, the others fill what is left: of these shares, the one that needs the fewest sequences.
    shares: tuple[float, ...] = (1 / 8, 1 / 4, 1 / 3, 1 / 2)
    groups: int = 64
    #: The linear programme is solved to this share of its value.
    gap: float = 2e-4
    rounds: int = 1500


@dataclass
class Plan:
    """Positions [lo, lo + n), each ``per`` of which go to one sequence, from number ``to`` on; ``bins`` sequences; ``room[r]``: ranges of those with room for r tokens."""

    tokens: int
    rows: list[tuple[int, int, int, int]] = field(default_factory=list)
    bins: int = 0
    room: list[list[tuple[int, int]]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.room = [[] for _ in range(self.tokens + 1)]

    def arrays(self) -> np.ndarray:
        return np.array(sorted(self.rows), np.int64).reshape(-1, 4)


class Lengths:
    """The pieces' lengths in descending order, by position, from how many there are of each."""

    def __init__(self, counts: np.ndarray):
        self.values = np.flatnonzero(counts)[::-1]
        self.n = counts[self.values].astype(np.int64)
        self.ends = np.cumsum(self.n)
        self.starts = self.ends - self.n

    def at(self, position: np.ndarray) -> np.ndarray:
        return self.values[np.searchsorted(self.ends, position, "right")]


def grouped(lengths: Lengths, above: int, groups: int) -> list[tuple[int, int, int]]:
    """(size, first position, pieces) of the groups of lengths above a bound, largest first."""
    large = lengths.values > above
    values, ends, n = lengths.values[large], lengths.ends[large], lengths.n[large]
    if len(values) <= groups:
        return [(int(k), int(e - c), int(c)) for k, e, c in zip(values, ends, n, strict=True)]
    cuts = [int(ends[-1]) * g // groups for g in range(groups + 1)]
    out: list[tuple[int, int, int]] = []
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            size = int(lengths.at(lo))
            if out and out[-1][0] == size:
                out[-1] = (size, out[-1][1], out[-1][2] + hi - lo)
            else:
                out.append((size, lo, hi - lo))
    return out


def _best_combination(sizes: np.ndarray, worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Sizes, each as often as wanted, of the greatest worth that fit."""
    value, last = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(sizes)
    ascending, gain = sizes[order], worth[order]
    for c in range(int(ascending[0]), room + 1):
        fit = np.searchsorted(ascending, c, "right")
        all_ = value[c - ascending[:fit]] + gain[:fit]
        k = int(all_.argmax())
        if all_[k] > value[c - 1] + 1e-12:
            value[c], last[c] = all_[k], order[k]
        else:
            value[c] = value[c - 1]
    out, c = np.zeros(len(sizes)), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            out[last[c]] += 1
            c -= int(sizes[last[c]])
    return float(value[room]), out


def combinations(sizes: np.ndarray, need: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Combinations (columns) and how often each is used, near the least total that covers the need; not whole numbers."""
    k = len(sizes)
    basis, cost = np.diag(s.tokens // sizes).astype(float), np.ones(k)
    inverse = np.diag(1 / np.diag(basis))
    used = inverse @ need
    for i in range(s.rounds):
        worth = cost @ inverse
        if worth.min() < -1e-9:  # more places than pieces are allowed
            column, own = np.zeros(k), 0.0
            column[worth.argmin()] = -1
        else:
            value, column = _best_combination(sizes, np.maximum(worth, 0), s.tokens)
            own = 1.0
            if value <= 1 + s.gap:  # the least total is at least the present one by value
                break
        change = inverse @ column
        steps = np.full(k, np.inf)
        np.divide(np.maximum(used, 0), change, out=steps, where=change > 1e-9)
        out = int(steps.argmin())
        basis[:, out], cost[out] = column, own
        if i % 50 == 49:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[out] / change[out]
            inverse = inverse - np.outer(change, row)
            inverse[out] = row
        used = inverse @ need
    return basis[:, cost > 0], np.maximum(used[cost > 0], 0)


def place_large(plan: Plan, lengths: Lengths, above: int, s: Settings) -> list[tuple[int, int]]:
    """Give large pieces their places; what has none is returned: (first position, pieces)."""
    groups = grouped(lengths, above, s.groups)
    if not groups:
        return []
    columns, used = combinations(np.array([g[0] for g in groups]), np.array([g[2] for g in groups], float), s)
    taken = [0] * len(groups)
    for column, times in zip(columns.T.astype(int), np.floor(used + 1e-6).astype(int).tolist(), strict=True):
        slots = []
        for g in np.flatnonzero(column).tolist() if times else ():
            lo, per = groups[g][1] + taken[g], int(column[g])
            n = min(times * per, groups[g][2] - taken[g])
            if n > 0:
                plan.rows.append((lo, n, per, plan.bins))
                taken[g] += n
                slots += [(lo + k, -(-(n - k) // per), per) for k in range(min(per, n))]
        if slots:
            _note_rooms(plan, lengths, slots, times)
            plan.bins += times
    return [(lo + t, n - t) for (_, lo, n), t in zip(groups, taken, strict=True) if t < n]


def _note_rooms(plan: Plan, lengths: Lengths, slots: list[tuple[int, int, int]], times: int) -> None:
    """What the next ``times`` sequences have left: slot (lo, n, per) puts position lo + b * per in the b-th, for the first n."""
    cuts = {0, times}
    for lo, n, per in slots:
        inner = -((lo - lengths.starts) // per)  # the first sequence whose piece has the next length
        cuts.update(inner[(inner > 0) & (inner < n)].tolist(), [min(n, times)])
    at = np.array(sorted(cuts))
    room = np.full(len(at) - 1, plan.tokens)
    for lo, n, per in slots:
        here = at[:-1] < n
        room[here] -= lengths.at(lo + at[:-1][here] * per)
    for r, first, end in zip(room.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
        if r:
            plan.room[r].append((plan.bins + first, end - first))


def place_rest(plan: Plan, lengths: Lengths, above: int, left: list[tuple[int, int]]) -> None:
    """Best fit, largest first, of all pieces without a place."""
    waiting: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k, start, n in zip(lengths.values.tolist(), lengths.starts.tolist(), lengths.n.tolist(), strict=True):
        if k <= above:
            waiting[k].append((start, n))
        for lo, m in left:
            a, b = max(lo, start), min(lo + m, start + n)
            if a < b and k > above:
                waiting[k].append((a, b - a))
    for k in sorted(waiting, reverse=True):
        for lo, n in waiting[k]:
            while n:
                r = next((r for r in range(k, plan.tokens + 1) if plan.room[r]), None)
                if r is None:
                    r = plan.tokens
                    more = -(-n // (r // k))
                    plan.room[r].append((plan.bins, more))
                    plan.bins += more
                to, bins = plan.room[r].pop()
                per = min(r // k, n)
                whole = min(bins, n // per)
                plan.rows.append((lo, whole * per, per, to))
                plan.room[r - per * k].append((to, whole))
                if bins > whole:
                    plan.room[r].append((to + whole, bins - whole))
                lo, n = lo + whole * per, n - whole * per


def planned(counts: np.ndarray, s: Settings) -> Plan:
    """The plan with the fewest sequences for pieces of which ``counts[i]`` have length i."""
    lengths, best = Lengths(counts), None
    for share in s.shares:
        plan, above = Plan(s.tokens), int(s.tokens * share)
        place_rest(plan, lengths, above, place_large(plan, lengths, above, s))
        if best is None or plan.bins < best.bins:
            best = plan
    return best


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, no long, nth long"


def pieces_of(df: DataFrame, tokenizer_path: str, end_id: int, s: Settings, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """A row for each piece; ``part`` and ``no`` name it, ``nth`` counts those of its length in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path).encode, np.array([end_id], "<u4").tobytes()
        part, no, seen = TaskContext.get().partitionId(), 0, [0] * (s.tokens + 1)
        names = _PIECES.replace(",", "").split()[::2]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64())
        for batch in bounded_batches(batches, 2 << 20):
            out = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                total = len(ids) // 4
                at, piece = 0, 0
                while at < total:
                    size = (total - at) % s.tokens or s.tokens
                    own = ids[4 * at : 4 * (at + size)]
                    out.append((doc, piece, at, size, zlib.crc32(own), own if with_ids else None, part, no, seen[size]))
                    seen[size] += 1
                    at, piece, no = at + size, piece + 1, no + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds, strict=True)], names)

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(trimmed(run), _PIECES)


def _dealt(df: DataFrame, plan: Plan) -> DataFrame:
    """With sequence_id, from the column ``position``. The plan's size depends on the limit alone."""
    lo, _, per, to = plan.arrays().T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position = batch.column("position").to_numpy(zero_copy_only=False)
            k = np.searchsorted(lo, position, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to[k] + (position - lo[k]) // per[k], pa.int64())], [*batch.schema.names, "sequence_id"])

    return df.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema)}, sequence_id long")


def pack(df: DataFrame, tokenizer_path: str, end_id: int, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; with ``with_ids`` also the ids (little-endian unsigned 32-bit).

    Full pieces are sequences of their own, numbered from 2^60 on by task. In a sequence longer pieces come first.
    """
    s = settings
    with Scratch(df.sparkSession) as scratch:
        pieces = scratch.saved(pieces_of(df, tokenizer_path, end_id, s, id_col, text_col, with_ids), "pieces")
        short = pieces.where(F.col("length") < s.tokens)
        deals = scratch.saved(short.groupBy("length", "part").agg(F.count("*").alias("n")), "deals")
        counts = np.zeros(s.tokens, np.int64)
        for row in deals.groupBy("length").agg(F.sum("n").alias("n")).collect():  # fewer rows than a sequence has tokens
            counts[row["length"]] = row["n"]
        lengths, plan = Lengths(counts), planned(counts, s)
        starts = np.zeros(s.tokens, np.int64)
        starts[lengths.values] = lengths.starts
        start = F.array(*[F.lit(int(x)) for x in starts]).cast("array<bigint>")
        before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
        firsts = deals.select("length", "part", (F.get(start, F.col("length").cast("int")) + before).alias("first"))
        ordered = short.join(firsts, ["length", "part"]).withColumn("position", F.col("first") + F.col("nth"))
        earlier = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "part", "no").rowsBetween(Window.unboundedPreceding, -1)
        packed = _dealt(ordered.drop("first", "nth"), plan).withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
        full = pieces.where(F.col("length") == s.tokens).withColumn("sequence_id", F.lit(1 << 60) + F.shiftleft(F.col("part").cast("long"), 32) + F.col("no")).withColumn("offset", F.lit(0).cast("long"))
        columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
        return checkpoint(packed.select(*columns).unionByName(full.select(*columns)))
