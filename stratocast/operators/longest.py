"""ROUGE-L of token arrays of any length: longest common subsequences in blocks that meet along a front.

The table of a pair's comparison is cut into strips (of the left tokens) and
columns (of the right ones) of `block` tokens. A block needs two things of its
neighbours: the state of its strip after the columns before (a bit per left
token) and the carries that the strip above sent on (a bit per right token). So
all blocks of one diagonal, of all pairs, are worked on at once, as rows dealt by
(pair, strip), and each diagonal is a written table. A task holds the positions of
one strip's tokens only; memory is linear in the block, whatever the text.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratocast.functions import text
from stratocast.storage import stored

BLOCK = 4096
LONG = 4 * BLOCK  # tokens of the longer side from which a pair is cut into blocks


def advance(a: list, b: list, state: bytes | None, carries: bytes | None) -> tuple[bytes, bytes]:
    """State of strip `a` and the carries to the strip below, after the tokens `b`.

    A zero bit of the state is a row in which the subsequence grew. Without a
    state nothing was read yet; without carries there is no strip above.
    """
    full = (1 << len(a)) - 1
    where: dict = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    bits = full if state is None else int.from_bytes(state, "little")
    above = [0] * len(b) if carries is None else np.unpackbits(np.frombuffer(carries, np.uint8))[: len(b)].tolist()
    below = np.zeros(len(b), np.uint8)
    for k, token in enumerate(b):
        hits = bits & where.get(token, 0)
        total = bits + hits + above[k]
        below[k] = total >> len(a)
        bits = (total | (bits - hits)) & full
    return bits.to_bytes((len(a) + 7) // 8, "little"), np.packbits(below).tobytes()


def _met(batches):
    for batch in batches:
        rows = []
        for k in range(batch.num_rows):
            a, b, state, carries = (batch.column(c)[k].as_py() for c in ("_a", "_b", "_state", "_carries"))
            state, carries = advance(a, b, state, carries)
            rows.append((state, carries, len(a) - int.from_bytes(state, "little").bit_count()))
        arrays = [batch.column(c) for c in ("_row", "_strip", "_ends")]
        arrays += [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["_row", "_strip", "_ends", "_state", "_carries", "_grown"])


def _pieces(pairs: DataFrame, side: str, other: str, place: str, tokens: str, block: int) -> DataFrame:
    """The blocks of one side: pair, place, tokens, whether it is the last, and the pair's last diagonal."""

    def count(c: str) -> Column:
        return F.ceil(F.size(c) / block).cast("int")

    cut = F.transform(
        F.sequence(F.lit(0), count(side) - 1),
        lambda k: F.struct(k.alias(place), F.slice(side, k * block + 1, F.lit(block)).alias(tokens)),
    )
    last = (count(side) + count(other) - 2).alias("_last")
    return (
        pairs.select("_row", last, (count(side) - 1).alias("_of"), F.explode(cut).alias("_p"))
        .select("_row", "_last", f"_p.{place}", f"_p.{tokens}", (F.col(f"_p.{place}") == F.col("_of")).alias("_ends"))
        .sortWithinPartitions("_last")  # finished pairs are skipped by the statistics of the row groups
    )


def _numbered(batches):
    """Tokens as numbers, equal where tokens are equal; they hold within a batch, so within a pair."""
    for batch in batches:
        sides = [batch.column(c) for c in ("_left", "_right")]
        flat = [side.flatten() for side in sides]
        numbers = pa.concat_arrays(flat).dictionary_encode(null_encoding="encode").indices
        out, at = {"_identity": batch.column("_identity")}, 0
        for name, side, own in zip(("_left", "_right"), sides, flat):
            sizes = np.concatenate([[0], pc.list_value_length(side).to_numpy(zero_copy_only=False)])
            out[name] = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), numbers.slice(at, len(own)))
            at += len(own)
        yield pa.RecordBatch.from_pydict({**out, "_row": batch.column("_row")})


def lcs_lengths(pairs: DataFrame, left: str, right: str, row: str, block: int = BLOCK) -> DataFrame:
    """`row` and `lcs`, for the pairs that have tokens on both sides; `row` tells pairs apart."""
    full = pairs.where((F.size(left) > 0) & (F.size(right) > 0)).select(F.col(row).alias("_row"), left, right)
    strips = stored(_pieces(full, left, right, "_strip", "_a", block)).drop("_ends")
    columns = stored(_pieces(full, right, left, "_column", "_b", block))
    diagonals = strips.agg(F.max("_last")).first()[0]
    schema = "_row bigint, _strip int, _ends boolean, _state binary, _carries binary, _grown bigint"
    fronts: list[DataFrame] = []
    for d in range(0 if diagonals is None else diagonals + 1):
        now = strips.where((F.col("_last") >= d) & (F.col("_strip") <= d)).drop("_last")
        facing = columns.where((F.col("_last") >= d) & (F.col("_column") <= d)).select(
            "_row", (F.lit(d) - F.col("_column")).alias("_strip"), "_b", "_ends"
        )
        met = now.join(facing, ["_row", "_strip"])
        if fronts:
            before = fronts[-1].select("_row", "_strip", "_state")
            above = fronts[-1].select("_row", (F.col("_strip") + 1).alias("_strip"), "_carries")
            met = met.join(before, ["_row", "_strip"], "left").join(above, ["_row", "_strip"], "left")
        else:
            met = met.withColumns({c: F.lit(None).cast("binary") for c in ("_state", "_carries")})
        fronts.append(stored(met.mapInArrow(_met, schema)))
    if not fronts:
        return full.select(F.col("_row").alias(row), F.lit(0).cast("bigint").alias("lcs"))
    ended = reduce(DataFrame.unionByName, [f.where("_ends").select("_row", "_grown") for f in fronts])
    return ended.groupBy(F.col("_row").alias(row)).agg(F.sum("_grown").alias("lcs"))


def rouge_l_long(
    pairs: DataFrame, identity: Sequence[str], left: str, right: str, block: int = BLOCK, name: str = "rouge_l"
) -> DataFrame:
    """F-measure of the longest common subsequence of two token arrays; equal to `text.rouge_l_lcs`.

    Null arrays count as empty, pairs without tokens on a side score 0, repeated
    rows each get their score, an empty table gives an empty result.
    """

    def tokens(c: str) -> Column:
        return F.coalesce(F.col(c), F.array().cast("array<string>"))

    texts = pairs.select(
        F.struct(*identity).alias("_identity"),
        tokens(left).alias("_left"),
        tokens(right).alias("_right"),
        F.monotonically_increasing_id().alias("_row"),
    )
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType(
        [texts.schema["_identity"], T.StructField("_left", numbers), T.StructField("_right", numbers), texts.schema["_row"]]
    )
    rows = stored(texts.mapInArrow(_numbered, schema))  # all later steps carry numbers in place of tokens
    lengths = lcs_lengths(rows, "_left", "_right", "_row", block)
    sized = rows.select("_identity", "_row", (F.size("_left") + F.size("_right")).alias("_size"))
    score = F.coalesce(2.0 * F.col("lcs") / F.col("_size"), F.lit(0.0))
    return sized.join(lengths, "_row", "left").select("_identity.*", score.alias(name))


def rouge_l_any(
    pairs: DataFrame,
    identity: Sequence[str],
    left: str,
    right: str,
    long_tokens: int = LONG,
    block: int = BLOCK,
    name: str = "rouge_l",
) -> DataFrame:
    """ROUGE-L of each pair in its row where both sides are short, and in blocks where one is longer than `long_tokens`."""
    longest = F.greatest(F.size(left), F.size(right))  # of a null array -1 or null
    short = pairs.where(F.coalesce(longest, F.lit(0)) <= long_tokens)
    both = F.col(left).isNotNull() & F.col(right).isNotNull()
    empty = F.array().cast("array<string>")
    sides = [F.when(both, F.col(c)).otherwise(empty) for c in (left, right)]
    return short.select(*identity, text.rouge_l_lcs(*sides).alias(name)).unionByName(
        rouge_l_long(pairs.where(longest > long_tokens), identity, left, right, block, name)
    )
