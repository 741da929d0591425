"""Shards by jump consistent hashing.

A row's shard follows from its key and the number of shards alone, so no table
of a ring is kept and any job can work it out again. With one more shard a row
either stays or goes to the new shard, so growing from n to n + 1 moves about
one row in n + 1. The key is the column given, or a text to hold equal texts
together; it is hashed by md5 of its text form, so shards agree between engines
and runs.

Slots number the rows of a shard from 0. Rows are dealt to partitions by range
of (shard, key), a shard of any size is many partitions, and a row's slot is its
place in its partition plus the counts of the partitions before; only keys and
sizes move, texts stay where they are.

Edge cases: a null or empty text has no bytes, so size 8 and crc32 0; rows
without a key share one shard, as equal keys do; repeated rows have slots of
their own; an empty table gives an empty result; columns of the input that carry
the name of a result column are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratocast.storage import stored

ROW_BYTES = 8  # what a row takes besides its text
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
_STEP = np.uint64(2862933555777941757)
_INDEX_BITS = 33  # of monotonically_increasing_id: the row's place within its partition


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to shards - 1, of every key (unsigned 64 bits).

    A key jumps from shard to shard; the next one is drawn from a generator that
    the key seeds, and the last one below `shards` counts. About ln(shards) jumps.
    """
    at = np.zeros(len(keys), np.int64)
    moving, state, to = np.arange(len(keys)), keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    while len(moving):
        at[moving] = to
        state = state * _STEP + np.uint64(1)
        drawn = ((state >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        far = (to + 1).astype(np.float64) * (float(1 << 31) / drawn)
        on = far < shards
        moving, state, to = moving[on], state[on], far[on].astype(np.int64)
    return at


def key_hash(key: str) -> Column:
    """60 bits of the key's md5 as a number; a null key counts as an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint")


def shard_of(key: str, shards: int) -> Column:
    """The shard of a row as a column."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.arrow_udf("int")
    def jumped(hashed: pa.Array) -> pa.Array:
        return pa.array(jump(hashed.to_numpy(zero_copy_only=False), shards), pa.int32())

    return jumped(key_hash(key))


def shard(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns `carry`, and size, text_crc32, law, shard, slot, grown_shard of every row of `docs`."""
    kept = [c for c in dict.fromkeys([key, *carry]) if c not in ADDED]
    whole = F.coalesce(F.col(text), F.lit(""))
    one_more = stored(
        docs.select(
            *[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)],
            (F.octet_length(whole) + ROW_BYTES).cast("bigint").alias("size"),
            F.crc32(whole).alias("text_crc32"),
            shard_of(key, shards).alias("shard"),
            shard_of(key, shards + 1).alias("grown_shard"),
            F.monotonically_increasing_id().alias("row"),  # parts equal rows, so that they spread
        )
    )
    order = ["shard", f"k{kept.index(key)}", "size", "text_crc32", "row"]
    dealt = stored(
        one_more.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    )
    part = F.shiftright("at", _INDEX_BITS)
    parts = dealt.groupBy("shard", part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.select(  # one row per shard and partition
        F.col("shard").alias("of"), "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift")
    )
    return dealt.join(begins, (F.col("shard") == F.col("of")) & (part == F.col("part"))).select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)],
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("at") + F.col("shift")).alias("slot"),
        "grown_shard",
    )


def moved(docs: DataFrame, shards: int, more: int = 1, key: str = "doc_id") -> DataFrame:
    """The rows of `docs` that `more` shards take from `shards` old ones, with `from_shard` and `to_shard`.

    All of them go to new shards; the files of rows that stay need no change.
    """
    placed = docs.withColumns({"from_shard": shard_of(key, shards), "to_shard": shard_of(key, shards + more)})
    return placed.where("from_shard <> to_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 24, key: str = "doc_id", pieces: int = 8, mode: str = "errorifexists") -> None:
    """Write whole rows as Parquet, one folder `shard=n` for each shard.

    A shard is dealt to `pieces` tasks by a hash of the row, so one large shard
    or one repeated key is not one task.
    """
    placed = docs.withColumn("shard", shard_of(key, shards))
    piece = F.pmod(F.monotonically_increasing_id(), F.lit(pieces))
    placed.withColumn("_piece", piece).repartition(shards * pieces, "shard", "_piece").drop("_piece").write.mode(
        mode
    ).partitionBy("shard").parquet(path)
