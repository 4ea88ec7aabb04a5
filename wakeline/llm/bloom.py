"""Blocked Bloom filters of what is seen once and what is seen twice, built without moving the items.

Memory is fixed by `blocks`: each block has 2^21 bits. A fuller filter only lets more items pass
that occur once; every item that occurs twice passes at any fill.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import mix, slices

BLOCK_BITS = 1 << 21
ROWS = pa.schema([("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
BITS = pa.schema([("block", pa.int32()), ("bits", pa.binary())])


def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block number and the 32 bits that place an item within its block."""
    return ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int32), h.astype(np.uint32)


def _bits(sub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint32(BLOCK_BITS - 1)
    return sub & mask, ((sub * np.uint32(2654435761)) >> np.uint32(7)) & mask


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter of items seen twice of each block, from rows in the order of blocks: one block is held at a time."""
    block, once, twice = None, np.empty(0, bool), np.empty(0, bool)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], schema=BITS
        )

    for batch in batches:
        for b, first, again in zip(*batch.columns):
            if b.as_py() != block:
                if block is not None:
                    yield done()
                block, once, twice = b.as_py(), np.zeros(BLOCK_BITS, bool), np.zeros(BLOCK_BITS, bool)
            p, q = _bits(np.frombuffer(first.as_buffer(), np.uint32))
            seen = once[p] & once[q]
            twice[p[seen]] = twice[q[seen]] = True
            once[p] = once[q] = True
            p, q = _bits(np.frombuffer(again.as_buffer(), np.uint32))
            twice[p] = twice[q] = True
    if block is not None:
        yield done()


def twice_filter(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], blocks: int) -> np.ndarray:
    """Bits of the filter of items seen at least twice.

    `hashes` gives the 64-bit item hashes of a part of a batch. Each task sends 4 bytes per distinct item to the
    item's block; a block's task holds the two filters and reads these bytes as a stream. A task that gets
    several blocks reads them one after the other. The result, `blocks` * 256 KiB, goes to the driver: a fixed size.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found, counts = np.unique(np.concatenate([hashes(part) for part in slices(batch)]), return_counts=True)
            block, sub = _places(found, blocks)
            order = np.argsort(block, kind="stable")
            block, sub, again = block[order], sub[order], counts[order] > 1
            cuts = np.searchsorted(block, np.arange(blocks + 1))
            some = [b for b in range(blocks) if cuts[b] < cuts[b + 1]]
            spans = [slice(cuts[b], cuts[b + 1]) for b in some]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int32()),
                    pa.array([sub[s].tobytes() for s in spans], pa.binary()),
                    pa.array([sub[s][again[s]].tobytes() for s in spans], pa.binary()),
                ],
                schema=ROWS,
            )

    rows = (
        df.mapInArrow(parts, "block int, once binary, twice binary")
        .repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(merge, "block int, bits binary")
        .collect()
    )
    out = np.zeros((blocks, BLOCK_BITS // 8), np.uint8)
    for row in rows:
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def may_hold(ids: DataFrame, blocks: int = 64):
    """A column function: whether an id may be among the ids of a one-column frame; false for null.

    The filter has a fixed size; a fuller one only says yes to more ids.
    """

    def twice(batch: pa.RecordBatch) -> np.ndarray:
        return np.repeat(mix(np.unique(batch.column(0).drop_null().to_numpy()).view(np.uint64)), 2)

    bits = ids.sparkSession.sparkContext.broadcast(twice_filter(ids, twice, blocks))

    @F.pandas_udf("boolean")
    def held(values: pd.Series) -> pd.Series:
        known = values.notna()
        found = suspected(bits.value, mix(values.fillna(0).to_numpy(np.int64).view(np.uint64)))
        return known & found

    return held


def suspected(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each item may occur twice."""
    blocks = len(bits) * 8 // BLOCK_BITS
    block, sub = _places(h, blocks)
    at = block.astype(np.int64) * BLOCK_BITS

    def read(p: np.ndarray) -> np.ndarray:
        g = at + p
        return (bits[g >> 3] >> (7 - (g & 7)).astype(np.uint8)) & 1 == 1

    p, q = _bits(sub)
    return read(p) & read(q)
