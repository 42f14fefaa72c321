"""Batches sealed by rows, bytes or time, whichever comes first: a running sum that starts anew at every seal.

Where a batch that begins at a row ends depends on that row alone: after ``max_rows``, once its bytes reach ``max_bytes``, or
before the first row ``linger_ms`` or more after it. So every row has a jump to the row behind its batch, and the
batches of a key are the path of jumps from its first row. Rows are cut into blocks of consecutive places. A block finds
its rows' jumps at once, with the next block's first rows beside it, and composes them by doubling into a table: for each
place a path may enter at, which are the first ``max_rows`` alone, where it leaves the block and after how many
batches. Only these tables are read in order, one at a time; then each block walks its own part of the path.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanout.operators.ordering import rank_within
from fanout.session import kept

BLOCK = 1 << 20

# workers get these functions by value: they need not find the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Budget:
    """What seals a batch; each is 1 or more."""

    max_rows: int
    max_bytes: int
    linger_ms: int


REASONS = np.array(["rows", "bytes", "time", "end"])


def jumps(sizes: np.ndarray, times: np.ndarray, budget: Budget) -> tuple[np.ndarray, np.ndarray]:
    """For every row the row behind its batch and what seals it (a place in REASONS), within the rows given."""
    n = len(sizes)
    filled = np.concatenate(([0], np.cumsum(sizes)))
    ends = np.stack(
        [
            np.arange(n) + budget.max_rows,
            np.searchsorted(filled, filled[:-1] + budget.max_bytes, "left"),
            np.searchsorted(times, times + budget.linger_ms, "left"),
            np.full(n, n),
        ]
    )
    # bytes that are never reached and times that never come lie past the end
    ends[1][ends[1] > n] = n + 1
    ends[2][ends[2] >= n] = n + 1
    reason = ends.argmin(axis=0)
    return np.minimum(ends.min(axis=0), n), reason


def composed(jump: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For every row of a block of ``size``, the first row of its path past the block and the batches until then."""
    to = np.concatenate((jump[:size], np.arange(size, len(jump) + 1)))
    steps = np.concatenate((np.ones(size, np.int64), np.zeros(len(to) - size, np.int64)))
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to[:size], steps[:size]
        steps, to = steps + steps[to], further


def _blocks(batches: Iterable[pa.RecordBatch], more: str | None = None) -> Iterator[tuple]:
    """(key, block, own rows, sizes, times, extra) of each block, whose rows come together and in order."""

    def pieces() -> Iterator[tuple]:
        for batch in batches:
            named = {n: batch.column(n) for n in batch.schema.names}
            blocks, keys = named["_block"].to_numpy(zero_copy_only=False), named["_key"].to_pylist()
            edge = [0, *[i for i in range(1, len(batch)) if keys[i] != keys[i - 1] or blocks[i] != blocks[i - 1]], len(batch)]
            for a, z in zip(edge, edge[1:], strict=False):
                if a < z:
                    part = {n: c.slice(a, z - a).to_numpy(zero_copy_only=False) for n, c in named.items() if n != "_key"}
                    yield (keys[a], int(blocks[a])), part

    for (key, block), parts in groupby(pieces(), lambda p: p[0]):
        held = [p for _, p in parts]
        joined = {n: np.concatenate([p[n] for p in held]) for n in ("_own", "_size", "_time")}
        yield key, block, int(joined["_own"].sum()), joined["_size"], joined["_time"], held[0].get(more) if more else None


def _tables(budget: Budget):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, block, own, sizes, times, _ in _blocks(batches):
            to, steps = composed(jumps(sizes, times, budget)[0], own)
            entries = min(own, budget.max_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key], pa.string()),
                    pa.array([block], pa.int64()),
                    pa.array([to[:entries] - own], pa.list_(pa.int64())),
                    pa.array([steps[:entries]], pa.list_(pa.int64())),
                ],
                ["_key", "_block", "leaves", "batches"],
            )

    return run


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the path enters each block of a key and which batch begins there; one table is held at a time."""
    key, entry, number = None, 0, 0
    for batch in batches:
        out = []
        for i in range(len(batch)):
            own_key, block = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            if own_key != key:
                key, entry, number = own_key, 0, 0
            out.append((key, block, entry, number))
            leaves, steps = batch.column(2)[i].values, batch.column(3)[i].values
            if entry < len(leaves):  # else a key's last rows were all in a batch from before
                number, entry = number + steps[entry].as_py(), leaves[entry].as_py()
        columns = list(zip(*out, strict=True)) or [()] * 4
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["_key", "_block", "entry", "number"]
        )


def _walked(budget: Budget, size: int):
    names = ["_key", "batch", "first_row", "rows", "bytes", "from_ms", "to_ms", "sealed_by"]
    types = [pa.string(), *[pa.int64()] * 6, pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, block, own, sizes, times, entry in _blocks(batches, "entry"):
            jump, reason = jumps(sizes, times, budget)
            starts, at = [], int(entry[0][0])
            while at < own:
                starts.append(at)
                at = int(jump[at])
            if not starts:
                continue
            first = np.array(starts)
            behind, filled = jump[first], np.concatenate(([0], np.cumsum(sizes)))
            numbers = int(entry[0][1]) + np.arange(len(first))
            columns = [
                [key] * len(first), numbers, block * size + first, behind - first, filled[behind] - filled[first],
                times[first], times[behind - 1], REASONS[reason[first]].tolist(),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def sealed_batches(
    rows: DataFrame, key: Column, time_ms: Column, size: Column, ties: list[Column], budget: Budget, block: int = BLOCK
) -> DataFrame:
    """One row a batch: key, batch (from 0 within the key), first_row, rows, bytes, from_ms, to_ms, sealed_by.

    Rows of a key stand by ``time_ms``, then by ``ties``; none of the three may be null. A row that fills the bytes is the
    last of its batch; ``end`` marks a key's last batch if nothing else sealed it. Runs when called, in tables that are kept.
    """
    if min(budget.max_rows, budget.max_bytes, budget.linger_ms) < 1:
        raise ValueError("a budget must let one row in")
    block = max(block, 2 * budget.max_rows)  # a batch reaches into the next block, never past it
    narrow = rows.select(
        key.cast("string").alias("_key"),
        time_ms.cast("long").alias("_time"),
        size.cast("long").alias("_size"),
        *[t.alias(f"_by{i}") for i, t in enumerate(ties)],
    )
    ranked = rank_within(narrow, ["_key"], F.col("_time"), [F.col(f"_by{i}") for i in range(len(ties))], "_rank")
    place = F.col("_rank") - 1
    own = F.call_function("div", place, F.lit(block))
    ahead = (place % block < budget.max_rows) & (place >= block)
    # the first rows of a block are seen by the one before it, too
    seen = F.when(ahead, F.array(own, own - 1)).otherwise(F.array(own))
    cut = kept(
        ranked.select("_key", place.alias("_place"), "_time", "_size", F.explode(seen).alias("_block")).withColumn(
            "_own", (F.col("_block") == F.call_function("div", "_place", F.lit(block))).cast("long")
        )
    )
    def together(frame: DataFrame) -> DataFrame:
        return frame.repartition("_key", "_block").sortWithinPartitions("_key", "_block", "_place")

    tables = together(cut).mapInArrow(
        _tables(budget), "_key string, _block bigint, leaves array<bigint>, batches array<bigint>"
    )
    ordered = kept(tables).repartition("_key").sortWithinPartitions("_key", "_block")
    entries = kept(ordered.mapInArrow(_entries, "_key string, _block bigint, entry bigint, number bigint"))
    met = cut.join(entries.select("_key", "_block", F.array("entry", "number").alias("entry")), ["_key", "_block"])
    walked = together(met).mapInArrow(
        _walked(budget, block),
        "_key string, batch bigint, first_row bigint, rows bigint, bytes bigint, from_ms bigint, to_ms bigint, sealed_by string",
    )
    return walked.withColumnRenamed("_key", "key")
