"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words. A document's expected number of
copies is its source's target over its source's size. Within a source the
expected copies are summed in order of size, one offset is added, and a
document is emitted once for each whole number its stretch of the sum crosses.
Equal-sized documents lie next to each other, so the words taken follow the
target closely.

Edge cases: a null or empty text has size 0 and takes nothing; a null source is
a source of its own, last in order; repeated rows are mixed one by one; an empty
table gives an empty result; columns of the input that carry the name of a
result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratocast.llm.names import renamed, set_apart
from stratocast.storage import stored

WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("size", "source_size", "target", "copies", "taken")
_INDEX_BITS = 33  # of monotonically_increasing_id: the row's place within its partition


def source_targets(sized: DataFrame, source: str, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row per source: source_size and target.

    The budget, `share` of all words, is dealt by weight. A source is full at
    `most` times its size; what it cannot take goes to the others by weight.
    Sources fill up in order of size per weight, so one running sum finds the
    level at which the budget is used up.
    """
    wheel = F.array(*[F.lit(float(w)) for w in weights])
    named = Window.orderBy(F.col(source).asc_nulls_last())  # one row per source
    filling = Window.orderBy("_fills", "_place").rowsBetween(Window.unboundedPreceding, 0)
    everywhere = Window.partitionBy()
    return (
        sized.groupBy(source)
        .agg(F.sum("size").alias("source_size"))
        .withColumn("_place", F.row_number().over(named) - 1)
        .withColumn("_w", F.element_at(wheel, (F.col("_place") % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("_fills", F.col("_cap") / F.col("_w"))
        .withColumn("_budget", F.lit(float(share)) * F.sum("source_size").over(everywhere))
        .withColumn("_all", F.sum("_w").over(everywhere))
        .withColumn("_caps", F.sum("_cap").over(filling))
        .withColumn("_ws", F.sum("_w").over(filling))
        .withColumn("_full", F.col("_caps") + F.col("_fills") * (F.col("_all") - F.col("_ws")) <= F.col("_budget"))
        .withColumn("_used", F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(everywhere))
        .withColumn("_left", F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(everywhere))
        .select(
            source,
            "source_size",
            F.when(F.col("_full"), F.col("_cap"))
            .otherwise((F.col("_budget") - F.col("_used")) * F.col("_w") / F.col("_left"))
            .alias("target"),
        )
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    carry_text: bool = True,
) -> DataFrame:
    """All rows of `docs` with size, source_size, target, copies (0 to ceil(most)) and taken = copies * size.

    Rows are dealt to partitions by range of (source, size, key), so a source of
    any share of the rows is spread. A row's rank in its source is its place in
    its partition, shifted by the counts of the partitions before: the shift
    table has a row per partition and source. Only the three columns that order
    the rows are sorted; the texts, written once with a number for each row, are
    streamed to the figures found for them, so no task sorts or buffers texts.
    Without `carry_text` the other columns move as they are, texts not at all.
    """
    docs, own = set_apart(docs)
    text, source, key = renamed(own, text, source, key)
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    kept = [c for c in docs.columns if c not in ADDED and (carry_text or c != text)]
    sized = docs.withColumn("_size", words).select(*kept, F.col("_size").alias("size"))
    order = [F.col(source).asc_nulls_last(), F.col("size"), F.col(key)]
    if carry_text:
        whole = stored(sized.withColumn("_row", F.monotonically_increasing_id()))
        found = _mixed(whole.select("_row", *dict.fromkeys((source, key)), "size"), ["_row"], order, weights, share, most, seed, source)
        mixed = whole.drop("size").join(found.hint("shuffle_hash"), "_row").select(*kept, *ADDED)
    else:
        mixed = _mixed(sized, kept, order, weights, share, most, seed, source)
    return mixed.withColumnsRenamed(own)


def _mixed(sized, kept, order, weights, share, most, seed, source) -> DataFrame:
    dealt = stored(
        sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", _INDEX_BITS)
    parts = (
        dealt.groupBy(source, part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"), F.sum("size").alias("size"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_rows").over(
                    Window.partitionBy(source).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
    )
    targets = source_targets(parts.select(source, "size"), source, weights, share, most)
    offset = F.conv(
        F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(source).cast("string"), F.lit("")))), 1, 8), 16, 10
    ).cast("double") / F.lit(4294967296.0)
    p, t = parts.alias("p"), targets.alias("t")
    plan = p.join(t, F.col(f"p.{source}").eqNullSafe(F.col(f"t.{source}"))).select(
        F.col(f"p.{source}").alias("_source"),
        F.col("_part").alias("_in"),
        F.col("p._first").alias("_first"),
        F.col("p._before").alias("_before"),
        F.col("t.source_size").alias("source_size"),
        F.col("t.target").alias("target"),
        F.when(F.col("t.source_size") > 0, F.col("t.target") / F.col("t.source_size")).otherwise(0.0).alias("_rate"),
    )
    rank = F.col("_before") + F.col("_at") - F.col("_first")  # ranks before this row
    upto = F.floor((rank + 1) * F.col("_rate") + F.col("_offset"))
    before = F.floor(rank * F.col("_rate") + F.col("_offset"))
    return (
        dealt.join(plan, (part == F.col("_in")) & F.col(source).eqNullSafe(F.col("_source")))
        .withColumn("_offset", offset)
        .withColumn("copies", F.least(upto - before, F.lit(int(-(-most // 1)))).cast("long"))
        .select(
            *kept, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
        )
    )


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as its `copies` say, numbered by `copy` from 1."""
    repeats = F.expr("sequence(1, cast(copies as int))")
    return mixed.where("copies > 0").drop("copy").withColumn("copy", F.explode(repeats))
