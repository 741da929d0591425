"""Training records, splits, statistics and token arrays."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratocast.functions.render import prompt_time, render_prompt
from stratocast.functions.text import word_count, words
from stratocast.operators import scale
from stratocast.operators.sequences import SERIES

# Fixed value: label of a position that is not trained on.
IGNORED = -100

# Characters of the rows whose different words are looked up together.
CHUNK_CHARS = 4_000_000


def training_records(seq: DataFrame, location: str = "location_name", time: str = "datetime", keep: Sequence[str] = ()):
    """Six text columns per window; prompt repeats input and response repeats target."""
    when = F.col(time) if dict(seq.dtypes)[time] == "string" else prompt_time(F.col(time))
    staged = seq.withColumn("_when", when).withColumn(
        "_prompt", render_prompt(F.col(location), F.col("_when"), *[F.col(c) for c in SERIES])
    )
    return staged.select(
        *keep,
        F.col("_prompt").alias("input"),
        F.col("target"),
        F.col("_prompt").alias("prompt"),
        F.col("target").alias("response"),
        F.col(location).alias("location"),
        F.col("_when").alias("datetime"),
    )


def exact_split(
    df: DataFrame, identity: Sequence[str], train: float = 0.8, val: float = 0.1, seed: int = 42, name: str = "split"
) -> DataFrame:
    """Shuffled train / val / test with exact sizes floor(n*train), floor(n*val), rest.

    The shuffle order is a seeded hash of the unique `identity`. Only the two
    keys at the cuts are searched for, so no row is moved to be split.
    """
    key = scale.hash_key(seed, *identity)
    cuts = scale.rank_cuts(df, key, [train, val])
    return df.withColumn(
        name, F.when(key <= cuts["c0"], "train").when(key <= cuts["c1"], "val").otherwise("test")
    )


def shuffled_batches(df: DataFrame, identity: Sequence[str], size: int, seed: int = 42, epoch: int = 0) -> DataFrame:
    """Epoch shuffle into mini-batches of `size`; the last one may be short."""
    order = scale.hash_key(seed + epoch, *identity)
    return scale.global_rank(df, order, "position").withColumn(
        "batch", F.floor((F.col("position") - 1) / F.lit(size))
    )


def corpus_stats(df: DataFrame, by: Sequence[str] = (), response: str = "response", location: str = "location"):
    """Sample count, locations and word statistics of the responses, per group; nothing for no rows."""
    n = word_count(F.col(response))
    return (
        df.withColumn("_words", n)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("total_samples"),
            F.count_distinct(location).alias("unique_locations"),
            F.avg("_words").alias("avg_response_length"),
            F.stddev_pop("_words").alias("response_length_std"),
            F.min("_words").alias("min_response_length"),
            F.max("_words").alias("max_response_length"),
        )
        .where(F.col("total_samples") > 0)
    )


def corpus_locations(df: DataFrame, by: Sequence[str] = (), location: str = "location") -> DataFrame:
    """The set of locations as rows, per group; a set of any size stays distributed."""
    return df.select(*by, location).distinct()


def take_first(df: DataFrame, n: int | None, order: Sequence[str]) -> DataFrame:
    """The first n rows of a total order; all rows for no n."""
    return df if not n else df.orderBy(*order).limit(n)


def concat_example(df: DataFrame, eos: str = "</s>", name: str = "text") -> DataFrame:
    return df.withColumn(name, F.concat(F.col("input"), F.lit("\n"), F.col("target"), F.lit(eos)))


def _fit(ids: Column, length: int, filler: Column) -> Column:
    """Cut to `length` and fill up on the right."""
    kept = F.slice(ids, 1, length)
    return F.concat(kept, F.array_repeat(filler.cast("int"), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def response_only_arrays(
    df: DataFrame, max_length: int, pad_id: int, prompt: str = "prompt_ids", response: str = "response_ids"
) -> DataFrame:
    """input_ids, attention_mask and labels; the prompt and the padding carry no label."""
    ids = F.concat(F.col(prompt), F.col(response))
    masked = F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt)), F.col(response))
    real = F.array_repeat(F.lit(1), F.size(ids))
    return df.select(
        *[c for c in df.columns if c not in (prompt, response)],
        _fit(ids, max_length, F.lit(pad_id)).alias("input_ids"),
        _fit(real, max_length, F.lit(0)).alias("attention_mask"),
        _fit(masked, max_length, F.lit(IGNORED)).alias("labels"),
    )


def full_sequence_arrays(df: DataFrame, max_length: int, pad_id: int, ids: str = "ids") -> DataFrame:
    """input_ids, attention_mask and labels; labels repeat input_ids, padding included."""
    padded = _fit(F.col(ids), max_length, F.lit(pad_id))
    return df.select(
        *[c for c in df.columns if c != ids],
        padded.alias("input_ids"),
        _fit(F.array_repeat(F.lit(1), F.size(ids)), max_length, F.lit(0)).alias("attention_mask"),
        padded.alias("labels"),
    )


def build_vocab(df: DataFrame, columns: Sequence[str], seed: int = 0, first_id: int = 1) -> DataFrame:
    """token, uses, id: every distinct word of the columns, with dense ids in hashed order.

    Words are counted before they shuffle, so a frequent word costs one row
    per task.
    """
    every = F.flatten(F.array(*[words(F.coalesce(F.col(c), F.lit(""))) for c in columns]))
    counts = df.select(F.explode(every).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    ranked = scale.global_rank(counts, scale.hash_key(seed, "token"), "_rank")
    return ranked.select("token", "uses", (F.col("_rank") - 1 + F.lit(first_id)).cast("int").alias("id"))


def _codes(rows: pa.Table, known: pa.Table, names: Sequence[str], fields: int, unknown_id: int) -> pa.Table:
    """The words of one chunk of rows looked up in the chunk's own part of the vocabulary."""
    tokens, codes = known.column("_token").combine_chunks(), known.column("_code").combine_chunks()
    out = {c: rows.column(c) for c in names}
    for i in range(fields):
        lists = rows.column(f"_words{i}").combine_chunks()
        found = codes.take(pc.index_in(lists.flatten(), value_set=tokens)).fill_null(unknown_id)
        ends = pc.cumulative_sum(pc.list_value_length(lists))
        starts = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
        out[f"_ids{i}"] = pa.ListArray.from_arrays(starts, found)
    return pa.table(out)


def encode_vocab(
    df: DataFrame,
    identity: Sequence[str],
    columns: dict[str, str],
    vocab: DataFrame,
    unknown_id: int = 0,
    min_rows: int = scale.HEAVY_ROWS,
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """Add ARRAY<INT> word ids, `columns` maps a text column to its id column.

    Rows are dealt to chunks of about `chunk_chars` characters by a hash of their
    identity. Only the different words of a chunk travel to the vocabulary and
    back, so a frequent word is as many rows as there are chunks, and no word
    travels by itself. Texts are measured first, which is a job of its own.
    `min_rows` has no use any more: no word is heavy.
    """
    fields = list(columns)
    texts = [F.coalesce(F.col(c), F.lit("")) for c in fields]
    chars = df.agg(*[F.coalesce(F.sum(F.char_length(t)), F.lit(0)) for t in texts]).first()
    chunk = F.pmod(F.xxhash64(*identity), F.lit(sum(chars) // chunk_chars + 1))
    named = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in identity])  # the others have no ids
    rows = df.where(named).select(
        *identity, chunk.alias("_chunk"), *[words(t).alias(f"_words{i}") for i, t in enumerate(texts)]
    )
    own = rows.repartition("_chunk").select(F.col("_chunk").alias("_of"), F.explode(F.concat(*[f"_words{i}" for i in range(len(fields))])).alias("_token"))
    known = vocab.select(F.col("token").alias("_token"), F.col("id").cast("int").alias("_code"))
    parts = own.distinct().join(known, "_token").select("_of", "_token", "_code")
    names, count = list(identity), len(fields)
    schema = T.StructType(
        [df.schema[c] for c in names] + [T.StructField(f"_ids{i}", T.ArrayType(T.IntegerType())) for i in range(count)]
    )
    coded = (
        rows.groupBy("_chunk").cogroup(parts.groupBy("_of"))
        .applyInArrow(lambda texts, part: _codes(texts, part, names, count, unknown_id), schema)
    )
    # Rows of equal identity share their words, by place.
    lists = coded.groupBy(*identity).agg(F.collect_list(F.struct(*[f"_ids{i}" for i in range(count)])).alias("_lists"))

    def ids(i: int) -> Column:
        placed = F.flatten(
            F.transform("_lists", lambda one: F.transform(one[f"_ids{i}"], lambda code, at: F.struct(at.alias("at"), code.alias("code"))))
        )
        own = F.when(F.size("_lists") == 1, F.col("_lists")[0][f"_ids{i}"]).otherwise(F.array_sort(placed)["code"])
        return F.coalesce(own, F.array().cast("array<int>"))

    joined = df.join(lists, names, "left")
    return joined.select(*df.columns, *[ids(i).alias(columns[c]) for i, c in enumerate(fields)])
