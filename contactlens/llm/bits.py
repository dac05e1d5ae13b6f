"""A bit array of fixed size over hashed ids: a filter in front of an exact join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from contactlens.llm.textkernel import mix

#: 2**BITS bits in slices of 2**SLICE bytes: 4 MB whatever the input's size
BITS, SLICE = 25, 13


def _place(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def bit_array(ids: DataFrame) -> np.ndarray:
    """Bits of the ids in the one long column of ``ids``; tasks send only the slices that they touch.

    The array has the same size for any input; as it fills, more ids pass
    that are not in it, which the exact join behind it removes.
    """
    def mark(batches):
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            at = np.unique(_place(batch.column(0).to_numpy(zero_copy_only=False)))
            part = at >> (SLICE + 3)
            for p in np.unique(part):
                own = seen.setdefault(int(p), np.zeros(8 << SLICE, bool))
                own[at[part == p] & ((8 << SLICE) - 1)] = True
        for p, own in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())],
                                             names=["slice", "bits"])

    def union(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()]
        return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([np.bitwise_or.reduce(rows).tobytes()], pa.binary())})

    out = np.zeros(1 << (BITS - 3), np.uint8)
    got = ids.where(f"`{ids.columns[0]}` is not null").mapInArrow(mark, "slice int, bits binary")
    for r in got.groupBy("slice").applyInArrow(union, "slice int, bits binary").collect():
        out[r["slice"] << SLICE:(r["slice"] + 1) << SLICE] = np.frombuffer(r["bits"], np.uint8)
    return out


def contains(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _place(ids)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
