"""A count sketch of fixed size over 64-bit hashes, and the salting that it allows; a filter of bits over such hashes.

A cell counts all hashes with the same leading bits, so a key occurs at most as often as its cell says.
Keys of heavy cells are dealt to several tasks by a second hash; the others meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS = 17
CELLS = 1 << BITS
BLOCK = 1 << 13
#: Rows of a cell that one task takes before its keys are salted, if that is over HEAVY times the mean cell.
PER_TASK = 50_000
HEAVY = 8

#: Bits of a filter for each of its hashes, the most bits of one (32 MB), and as a power of two the bits that are made together.
PER_HASH = 16
MOST_BITS = 1 << 28
CHUNK = 19

FIELDS = [pa.field("block", pa.int32()), pa.field("cells", pa.binary())]
COLUMNS = "block int, cells binary"


def cell_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def added(cells: np.ndarray, hashes: np.ndarray) -> None:
    if len(hashes):
        cells += np.bincount(cell_of(hashes), minlength=CELLS)


def rows_of(cells: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """A task's counters as rows (block, cells) of a table whose other columns are null."""
    parts = [(i, cells[i * BLOCK : (i + 1) * BLOCK].tobytes()) for i in range(CELLS // BLOCK) if cells[i * BLOCK : (i + 1) * BLOCK].any()]
    made = {"block": pa.array([i for i, _ in parts], pa.int32()), "cells": pa.array([c for _, c in parts], pa.binary())}
    return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.nulls(len(parts), f.type) for f in schema], schema=schema)


def merged(parts: DataFrame) -> np.ndarray:
    """The sum of all tasks' counters; what reaches the driver has the sketch's fixed size."""
    schema = pa.schema(FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_pydict({"block": list(sums), "cells": [c.tobytes() for c in sums.values()]}, schema=schema)

    cells = np.zeros(CELLS, np.int64)
    for row in parts.select("block", "cells").repartition("block").mapInArrow(run, COLUMNS).collect():
        cells[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["cells"], np.int64)
    return cells


def salts_of(cells: np.ndarray) -> np.ndarray:
    """Per cell, over how many tasks its keys' rows are dealt (1: those of a key meet)."""
    limit = max(PER_TASK, HEAVY * cells.mean())
    return np.where(cells > limit, -(-cells // int(limit)), 1)


def bits_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """The two bits of each hash in a filter of `size` bits, a power of two."""
    return np.concatenate([hashes & np.uint64(size - 1), hashes >> np.uint64(64 - size.bit_length() + 1)]).astype(np.int64)


def filter_of(hashes: DataFrame, n: int) -> np.ndarray:
    """n hashes (one column of well mixed 64-bit numbers) as a filter; beyond MOST_BITS / PER_HASH of them it lets more others pass."""
    size = min(max(1 << (PER_HASH * n - 1).bit_length(), 1 << CHUNK), MOST_BITS)
    schema = pa.schema([("chunk", pa.int32()), ("bit", pa.int32())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = bits_of(batch.column(0).to_numpy().astype(np.uint64), size)
            yield pa.RecordBatch.from_arrays([pa.array((at >> CHUNK).astype(np.int32)), pa.array((at & ((1 << CHUNK) - 1)).astype(np.int32))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        set_: dict[int, np.ndarray] = {}
        for batch in batches:
            chunk, bit = (batch.column(i).to_numpy() for i in range(2))
            for c in np.unique(chunk).tolist():
                set_.setdefault(c, np.zeros(1 << CHUNK, bool))[bit[chunk == c]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(set_), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in set_.values()], pa.binary())], schema=pa.schema([("chunk", pa.int32()), ("bits", pa.binary())]))

    out = np.zeros(size >> 3, np.uint8)
    for row in hashes.mapInArrow(spread, "chunk int, bit int").repartition("chunk").mapInArrow(run, "chunk int, bits binary").collect():
        lo = row["chunk"] << (CHUNK - 3)
        out[lo : lo + (1 << (CHUNK - 3))] = np.frombuffer(row["bits"], np.uint8)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True of all hashes of the filter, and of few others."""
    at = bits_of(hashes, len(bits) << 3)
    found = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return found[: len(hashes)] & found[len(hashes) :]
