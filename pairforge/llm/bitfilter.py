"""A filter of 64-bit values in one bit each, made by the executors and broadcast.

It has about eight bits for each value, from 2**LEAST to 2**MOST bits (32 MB), so its size is bounded whatever the
input. A value may pass that was not put in, none that was put in fails: what passes is compared or joined afterwards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairforge.llm.vectext import mix

LEAST, MOST = 20, 28
#: Bits of a page, the unit that executors put together.
PAGE = 1 << 15


def slots(values: np.ndarray, bits: int) -> np.ndarray:
    return (mix(values.view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def passes(held: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is, or may be, in the filter."""
    at = slots(values, 8 * len(held))
    return (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def made(values: DataFrame, n: int):
    """Broadcasts the filter of a table of one long column without nulls, of about n values."""
    spark = values.sparkSession
    bits = 1 << min(MOST, max(LEAST, (8 * n).bit_length()))
    most = max(1, bits // PAGE)

    def pages(batches):
        kept = np.zeros(0, np.int64)
        for batch in batches:
            kept = np.union1d(kept, slots(batch.column(0).to_numpy(zero_copy_only=False), bits))
        cut = np.searchsorted(kept, np.arange(most + 1) * PAGE)
        for i in np.flatnonzero(np.diff(cut)).tolist():
            page = np.zeros(PAGE, bool)
            page[kept[cut[i] : cut[i + 1]] - i * PAGE] = True
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(page, bitorder="little").tobytes()], pa.binary())], names=["page", "bits"])

    def merged(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for page, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(data, np.uint8)
                found[page] = found[page] | got if page in found else got
        for page, got in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([got.tobytes()], pa.binary())], names=["page", "bits"])

    held = np.zeros(bits // 8, np.uint8)
    schema = "page int, bits binary"
    for r in values.mapInArrow(pages, schema).repartition(8, "page").mapInArrow(merged, schema).collect():  # at most 2**(MOST - 3) bytes
        held[r.page * PAGE // 8 : (r.page + 1) * PAGE // 8] = np.frombuffer(r.bits, np.uint8)
    return spark.sparkContext.broadcast(held)
