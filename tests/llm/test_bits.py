"""The bit filter against plain setting of bits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocast.llm import bits


def test_filter_comes_as_bytes_of_many_words(spark, monkeypatch):
    """Its words reach the driver packed by the tasks, not as a row for each word."""
    hashes = spark.range(20_000).select(F.xxhash64("id").alias("h")).repartition(3)
    rows = []
    kind = type(hashes)
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: [rows.append(r) or r for r in collect(df)])
    packed = bits.bit_filter(hashes, "h", 20_000)
    assert 0 < len(rows) < 100
    monkeypatch.undo()
    h = np.array([r["h"] for r in hashes.collect()], np.int64)
    size = 1 << 19
    want = np.zeros(size, np.uint8)
    want[h & (size - 1)] = 1
    assert (packed == np.packbits(want, bitorder="little")).all() and bits.holds(packed, h).all()


@pytest.mark.parametrize("ids", [[], [7], [7, 7, 8]])
def test_small_filters(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "a bigint")
    packed = bits.bit_filter(df, "a", len(ids))
    assert len(packed) == 512 and np.flatnonzero(np.unpackbits(packed, bitorder="little")).tolist() == sorted(set(ids))
