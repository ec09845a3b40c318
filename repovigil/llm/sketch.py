"""A count sketch of fixed size over 64-bit keys: one counter for each of 2^22 hash buckets.

Tasks count their own keys and hand on the counters in compressed slices; tasks that add up one
slice of the counters each follow. The result is 16 MB, whatever the size of the data, and may be
broadcast. A bucket's count is at least the count of each of its keys; keys that are frequent stand
out from the even load of the others, so the sketch tells frequent from rare keys at every scale.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS = 22
BUCKETS = 1 << BITS
SLICES = 64
WIDTH = BUCKETS // SLICES


def bucket_of(keys: np.ndarray) -> np.ndarray:
    """Keys must be well mixed: the top bits choose the bucket."""
    return (keys >> np.uint64(64 - BITS)).astype(np.int64)


def to_slices(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Compressed slices of the counters; slices without a count are left out."""
    for k in range(SLICES):
        part = counts[k * WIDTH : (k + 1) * WIDTH]
        if part.any():
            yield k, zlib.compress(part.astype(np.uint32).tobytes(), 1)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}  # at most SLICES arrays
    for batch in batches:
        for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total = sums.setdefault(k, np.zeros(WIDTH, np.uint64))
            total += np.frombuffer(zlib.decompress(data), np.uint32)
    # saturating: a bucket beyond 2^32 - 1 is frequent enough
    packed = [zlib.compress(np.minimum(s, 2**32 - 1).astype(np.uint32).tobytes(), 1) for s in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int32()), pa.array(packed, pa.binary())], ["slice", "counts"])


def merged(parts: DataFrame) -> np.ndarray:
    """The sum of sketches given as rows (slice, counts): 2^22 counters."""
    out = np.zeros(BUCKETS, np.uint32)
    narrow = parts.select("slice", "counts").repartition(SLICES, "slice").mapInArrow(_add, "slice int, counts binary")
    for k, data in narrow.collect():  # SLICES rows of at most 256 KB
        out[k * WIDTH : (k + 1) * WIDTH] = np.frombuffer(zlib.decompress(data), np.uint32)
    return out
