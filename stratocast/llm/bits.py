"""A filter of fixed size over 64-bit hashes: it never misses one, and lets a few others through."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BITS = 1 << 27  # bound of what is broadcast: 16 MB; twice that is collected


def _packed(batches):
    """One row per batch: the places and the bits of its words, as bytes."""
    for batch in batches:
        both = [batch.column(c).to_numpy().astype(np.uint32).tobytes() for c in ("word", "bits")]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in both], ["word", "bits"])


def bit_filter(hashes: DataFrame, column: str, count: int) -> np.ndarray:
    """The filter as packed bytes, with 16 bits or more for each of `count` hashes while it is below its bound.

    Its words (4 million at most) come to the driver as bytes; as rows they would take some 2 GB there.
    """
    size = 1 << 12
    while size < min(MAX_BITS, 16 * count):
        size *= 2
    place = F.col(column).bitwiseAND(size - 1)
    words = (
        hashes.groupBy(F.shiftright(place, 5).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{column}` & 31 AS int))")).alias("bits"))
        .mapInArrow(_packed, "word binary, bits binary")
    )
    packed = np.zeros(size // 32, np.uint32)
    for r in words.collect():
        packed[np.frombuffer(r["word"], np.uint32)] = np.frombuffer(r["bits"], np.uint32)
    return packed.view(np.uint8)


def holds(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the filter lets each hash (int64 or uint64) through."""
    place = hashes.astype(np.int64) & (8 * len(packed) - 1)
    return (packed[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
