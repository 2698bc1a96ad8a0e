"""Work on all pairs of environments (or covariables) by tiles: dense products and bit sets instead of a join of pairs.

A tile has about ``width`` rows, dealt by a hash of their names, and a block about ``depth`` columns; a task holds two blocks and what has been
summed for one pair of tiles. Every block goes to as many pairs as there are tiles, so a shuffle moves rows times tiles, not rows times rows.

Defined results: cells of equal names are averaged; NaN counts as null; an absent or null cell takes part in no product. Only pairs that share a
column, with values or without, have a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolith.session import checkpointed


@dataclass
class Block:
    """Rows of a tile by columns of a block: values with 0 for what is missing, what is known, and which cells exist."""

    rows: list[str]
    columns: list[str]
    values: np.ndarray
    known: np.ndarray
    exists: np.ndarray

    @classmethod
    def of(cls, rows: list[str], columns: list[str], cells: dict) -> Block:
        shape = len(rows), len(columns)
        at = np.array(cells["row"]), np.array(cells["column"])
        value = np.array([np.nan if v is None else v for v in cells["value"]], float)
        good = ~np.isnan(value)
        sums, n, exists = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        np.add.at(sums, (at[0][good], at[1][good]), value[good])
        np.add.at(n, (at[0][good], at[1][good]), 1)
        exists[at] = 1
        return cls(rows, columns, sums / np.maximum(n, 1), (n > 0).astype(float), exists)

    def on(self, columns: list[str]) -> Block:
        """With other columns, in their order."""
        index = {c: i for i, c in enumerate(self.columns)}
        out = Block(self.rows, columns, *(np.zeros((len(self.rows), len(columns))) for _ in range(3)))
        here = [(i, index[c]) for i, c in enumerate(columns) if c in index]
        if here:
            new, old = map(list, zip(*here))
            for name in ("values", "known", "exists"):
                getattr(out, name)[:, new] = getattr(self, name)[:, old]
        return out


def paired(w: DataFrame, row: str, column: str, width: int = 256, depth: int = 512, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., a, b, block, first, cells): blocks of tiles by pairs a <= b of them; ``first`` says whether it is that of a. Sorted for ``streamed``."""
    cells = w.where(F.col(row).isNotNull() & F.col(column).isNotNull()).select(*keys, F.col(row).cast("string").alias("row"), F.col(column).cast("string").alias("column"), F.col("value").cast("double").alias("value"))
    cells = checkpointed(cells)  # what it takes to make them is done once
    n_rows, n_columns = cells.agg(F.approx_count_distinct("row"), F.approx_count_distinct("column")).first()
    tiles, blocks = max(1, -(-n_rows // width)), max(1, -(-n_columns // depth))
    dealt = cells.withColumns({"tile": F.pmod(F.xxhash64("row"), F.lit(tiles)).cast("int"), "block": F.pmod(F.xxhash64("column"), F.lit(blocks)).cast("int")})
    packed = dealt.groupBy(*keys, "tile", "block").agg(F.collect_list(F.struct("row", "column", "value")).alias("cells"))  # width times depth of them
    other = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    named = other.select(*keys, F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "block", (F.col("tile") <= F.col("other")).alias("first"), "cells")
    return named.repartition(*keys, "a", "b").sortWithinPartitions(*keys, "a", "b", "block", F.desc("first"))


def _blocks_of(cells: list[pa.Array], rows: dict[str, int]) -> Block:
    table = {k: cells.field(k).to_pylist() for k in ("row", "column", "value")}
    columns: dict[str, int] = {}
    table["row"] = [rows.setdefault(r, len(rows)) for r in table["row"]]
    table["column"] = [columns.setdefault(c, len(columns)) for c in table["column"]]
    return Block.of(list(rows), list(columns), table)


def streamed(make: Callable[[], object], n_keys: int) -> Callable:
    """A task over ``paired`` rows: for each pair of tiles, an object of ``make`` is given the two blocks of each block number by ``add(x, y)``, and
    its ``rows(key, same)`` come out at the end. A tile's rows keep their places from block to block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, made, sides, held = None, None, ({}, {}), None

        def single() -> None:
            """A block whose columns the other tile lacks still counts for its own rows."""
            nonlocal held
            if held is not None:
                block, first = held
                if pair[-2] == pair[-1]:
                    made.add(block, block)
                else:
                    empty = Block(list(sides[first]), [], *(np.zeros((len(sides[first]), 0)) for _ in range(3))).on(block.columns)
                    made.add(*((block, empty) if first else (empty, block)))
                held = None

        for batch in batches:
            for i in range(batch.num_rows):
                key = tuple(batch.column(k)[i].as_py() for k in range(n_keys + 2))
                number, first = batch.column(n_keys + 2)[i].as_py(), batch.column(n_keys + 3)[i].as_py()
                if key != pair:
                    if pair is not None:
                        single()
                        yield from made.rows(pair)
                    pair, made, sides, last = key, make(), ({}, {}), None
                cells = batch.column(n_keys + 4)[i].values
                if held is not None and (number != last or key[-2] == key[-1]):
                    single()
                block = _blocks_of(cells, sides[0 if first else 1])
                if held is None:
                    held, last = (block, 1 if first else 0), number
                else:
                    x, y = held[0], block
                    columns = list(dict.fromkeys([*x.columns, *y.columns]))
                    made.add(x.on(columns), y.on(columns))
                    held = None
        if pair is not None:
            single()
            yield from made.rows(pair)

    return run


def _grown(old: np.ndarray | None, shape: tuple[int, ...]) -> np.ndarray:
    """An array with room for rows that a later block brought."""
    out = np.zeros(shape)
    if old is not None:
        out[tuple(slice(0, k) for k in old.shape)] = old
    return out


class Moments:
    """Sums over shared columns of each pair of rows, and each row's own sum of squares."""

    names = ("shared", "n", "x", "y", "xx", "yy", "xy")

    def __init__(self) -> None:
        self.sums: dict[str, np.ndarray] = {}
        self.own: list[np.ndarray | None] = [None, None]
        self.sides: list[list[str]] = [[], []]

    def add(self, x: Block, y: Block) -> None:
        self.sides = [x.rows if len(x.rows) > len(self.sides[0]) else self.sides[0], y.rows if len(y.rows) > len(self.sides[1]) else self.sides[1]]
        shape = len(self.sides[0]), len(self.sides[1])
        x2, y2 = x.values**2, y.values**2
        products = (x.exists @ y.exists.T, x.known @ y.known.T, x.values @ y.known.T, x.known @ y.values.T, x2 @ y.known.T, x.known @ y2.T, x.values @ y.values.T)
        for name, p in zip(self.names, products, strict=True):
            self.sums[name] = _grown(self.sums.get(name), shape)
            self.sums[name][: p.shape[0], : p.shape[1]] += p
        for i, own in enumerate((x2.sum(axis=1), y2.sum(axis=1))):
            self.own[i] = _grown(self.own[i], (shape[i],))
            self.own[i][: len(own)] += own

    def rows(self, key: tuple) -> Iterator[pa.RecordBatch]:
        left, right = (np.array(s, object) for s in self.sides)
        for start in range(0, len(left), 64):
            i, j = np.nonzero(self.sums["shared"][start : start + 64])
            i = i + start
            if not len(i):
                continue
            stats = {n: self.sums[n][i, j] for n in self.names}
            yield self._batch(left[i], right[j], self.own[0][i], self.own[1][j], stats)
            if key[-2] != key[-1]:
                turned = stats | {"x": stats["y"], "y": stats["x"], "xx": stats["yy"], "yy": stats["xx"]}
                yield self._batch(right[j], left[i], self.own[1][j], self.own[0][i], turned)

    def _batch(self, i, j, own_i, own_j, stats) -> pa.RecordBatch:
        columns = [pa.array(i, pa.string()), pa.array(j, pa.string()), *[pa.array(v, pa.float64()) for v in (own_i, own_j, *[stats[n] for n in self.names])]]
        return pa.RecordBatch.from_arrays(columns, ["i", "j", "own_i", "own_j", *self.names])


_MOMENTS = "i string, j string, own_i double, own_j double, " + ", ".join(f"{n} double" for n in Moments.names)


def moments(w: DataFrame, row: str = "env", column: str = "covariable", width: int = 256, depth: int = 512) -> DataFrame:
    """(i, j, own_i, own_j, shared, n, x, y, xx, yy, xy) of all ordered pairs of rows that share a column.

    ``shared`` counts common columns, ``n`` those where both have values; x .. xy sum values, squares and products over these; own_i and own_j
    are the rows' sums of squares over all their columns.
    """
    kind = w.schema[row].dataType
    found = paired(w, row, column, width, depth).mapInArrow(streamed(Moments, 0), _MOMENTS)
    return found.withColumns({c: F.col(c).cast(kind) for c in "ij"})


class Dominance:
    """For each row of either tile, how many rows of the other share a column with it, and how many of these lie on one side in all shared ones.

    Of each column, the other tile's rows in order give a bit set for every prefix; a row's rank in that order picks one, and the picks of all
    columns are intersected.
    """

    def __init__(self, below: bool):
        self.below, self.sets, self.met, self.sides = below, [None, None], [None, None], [[], []]

    def _of(self, which: int, e: Block, o: Block) -> None:
        n, m = len(e.rows), len(o.rows)
        words = -(-m // 8)
        ones = np.full((n, words), 255, np.uint8)
        sets, met = self.sets[which], self.met[which]
        own, seen = ones.copy(), np.zeros((n, words), np.uint8)
        if sets is not None:
            own[: sets.shape[0], : sets.shape[1]] = sets
            seen[: met.shape[0], : met.shape[1]] = met
        for k in range(len(e.columns)):
            here, there = np.flatnonzero(e.known[:, k]), np.flatnonzero(o.known[:, k])
            if not len(here) or not len(there):
                continue
            values = o.values[there, k] if self.below else -o.values[there, k]
            order = np.argsort(values, kind="stable")
            flags = np.zeros((len(there) + 1, words * 8), np.uint8)
            flags[:, np.flatnonzero(o.known[:, k] == 0)] = 1  # a row without this column is not ruled out by it,
            flags[:, m:] = 1  # nor is one that a later block brings
            for step, r in enumerate(there[order]):
                flags[step + 1 :, r] = 1
            prefixes = np.packbits(flags, axis=1, bitorder="little")
            rank = np.searchsorted(values[order], e.values[here, k] if self.below else -e.values[here, k], "right")
            own[here] &= prefixes[rank]
            present = np.zeros(words * 8, np.uint8)
            present[there] = 1
            seen[here] |= np.packbits(present, bitorder="little")
        self.sets[which], self.met[which] = own, seen

    def add(self, x: Block, y: Block) -> None:
        self.sides = [x.rows if len(x.rows) > len(self.sides[0]) else self.sides[0], y.rows if len(y.rows) > len(self.sides[1]) else self.sides[1]]
        self._of(0, x, y)
        self._of(1, y, x)

    def rows(self, key: tuple) -> Iterator[pa.RecordBatch]:
        for which in (0, 1) if key[-2] != key[-1] else (0,):
            own, seen = self.sets[which], self.met[which]
            on = np.bitwise_count(own & seen).sum(axis=1, dtype=np.int64)
            met = np.bitwise_count(seen).sum(axis=1, dtype=np.int64)
            names = self.sides[which]
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(on), pa.array(met)], ["key", "row", "on_side", "met"])


def dominance(w: DataFrame, key: str, below: bool, row: str = "env", column: str = "covariable", width: int = 1024, depth: int = 256) -> DataFrame:
    """(key, row, on_side, met): of the rows that share a column with it under the same key, itself included, how many there are and how many
    are at most (below) or at least as great as it in all shared columns.
    """
    pairs = paired(w.withColumn("_key", F.col(key).cast("string")), row, column, width, depth, ("_key",))
    found = pairs.mapInArrow(streamed(lambda: Dominance(below), 1), "key string, row string, on_side long, met long")
    kinds = {"key": w.schema[key].dataType, "row": w.schema[row].dataType}
    return found.groupBy("key", "row").agg(F.sum("on_side").alias("on_side"), F.sum("met").alias("met")).withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})
