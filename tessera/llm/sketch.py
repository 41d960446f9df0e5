"""Count sketches of fixed size, added up over all tasks without any task seeing all data."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE = 1 << 16


def slices(sketch: np.ndarray) -> list[tuple[int, bytes]]:
    """(slice number, compressed 32-bit counts) of the slices that hold anything."""
    found = []
    for at in range(0, len(sketch), SLICE):
        part = sketch[at : at + SLICE]
        if part.any():
            found.append((at // SLICE, zlib.compress(np.minimum(part, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)))
    return found


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(SLICE, dtype=np.int64)
    for blob in table.column("counts").to_pylist():
        part = np.frombuffer(zlib.decompress(blob), dtype=np.uint32)
        total[: len(part)] += part
    return pa.table(
        {
            "slice": pa.array([table.column("slice")[0].as_py()], pa.int32()),
            "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary()),
        }
    )


def gather(parts: DataFrame, cells: int) -> np.ndarray:
    """The sum of all tasks' slices (columns slice, counts): ``cells`` counts, whatever the data."""
    sketch = np.zeros(cells, dtype=np.uint32)
    for row in parts.groupBy("slice").applyInArrow(_add, "slice int, counts binary").collect():
        part = np.frombuffer(row["counts"], dtype=np.uint32)
        at = row["slice"] * SLICE
        sketch[at : at + SLICE] = part[: cells - at]
    return sketch
