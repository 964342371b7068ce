"""Long vectors of counts summed over all rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Numbers that are moved together; blocks of zeros aren't moved.
BLOCK = 1024


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Partitioned by ``keys`` over at least all cores, so that what is distinct by them needs no further exchange."""
    session = rows.sparkSession
    return rows.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism), *keys)


def summed(rows: DataFrame, size: int, add: Callable[[pa.RecordBatch, np.ndarray], None]) -> np.ndarray:
    """The sum over all rows of what ``add`` puts into a vector of whole numbers, batch by batch.

    A task holds one vector and passes on its blocks; they are summed where they meet, so the driver gets one vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                if total is None:
                    total = np.zeros(-(-size // BLOCK) * BLOCK, np.int64)
                add(batch, total[:size])
        if total is not None:
            blocks = total.reshape(-1, BLOCK)
            yield from _rows((int(b), blocks[b]) for b in np.flatnonzero(blocks.any(axis=1)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(data, np.int64)
                if block in held:
                    held[block] += x
                else:
                    held[block] = x.copy()
        yield from _rows(held.items())

    merged = rows.mapInArrow(run, "block int, total binary").repartition("block").mapInArrow(merge, "block int, total binary")
    out = np.zeros(-(-size // BLOCK) * BLOCK, np.int64)
    for batch in merged.toArrow().to_batches():
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(data, np.int64)
    return out[:size]


def _rows(blocks) -> Iterator[pa.RecordBatch]:
    names, parts = [], []
    for block, x in blocks:
        names.append(block)
        parts.append(x.tobytes())
        if len(parts) == 500:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(parts, pa.binary())], names=["block", "total"])
            names, parts = [], []
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(parts, pa.binary())], names=["block", "total"])
