"""Choice among candidate texts of a prompt, and their agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratocast.functions.text import word_count, words
from stratocast.operators.scale import skew_join

# Longest text that still scores, clamp and neutral confidence.
LONGEST = 50
LOWEST, HIGHEST, NEUTRAL = 0.1, 1.0, 0.5
# Distinct word sets compared within one group.
BLOCK = 32


def _length_score(text: Column) -> Column:
    n = word_count(text)
    return F.when(n <= LONGEST, n).otherwise(F.lit(0))


def best_candidate(cands: DataFrame, prompt: str = "prompt_id", idx: str = "idx", text: str = "text") -> DataFrame:
    """Per prompt the longest text of at most 50 words; longer ones count as 0, the first wins ties.

    A minimum over (score, position, text), so every task keeps one row per
    prompt before the shuffle.
    """
    rank = F.struct((-_length_score(F.col(text))).alias("score"), F.col(idx).alias("idx"), F.col(text).alias("text"))
    return cands.groupBy(prompt).agg(F.min(rank).alias("_best")).select(
        prompt, F.col("_best.idx").alias(idx), F.col("_best.text").alias(text)
    )


def best_of(texts: Column) -> Column:
    """The same choice within an array of candidates of one row."""
    ranked = F.transform(texts, lambda t, i: F.struct((-_length_score(t)).alias("score"), i.alias("idx"), t.alias("text")))
    return F.array_min(ranked)["text"]


def word_set(text: Column) -> Column:
    return F.sort_array(F.array_distinct(words(F.lower(text))))


def _jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / F.nullif(F.size(a) + F.size(b) - shared, F.lit(0)).cast("double")


def _clamp(mean: Column) -> Column:
    # greatest and least pass over NULL, so "no pair" is asked first.
    return F.when(mean.isNull(), F.lit(NEUTRAL)).otherwise(F.least(F.lit(HIGHEST), F.greatest(F.lit(LOWEST), mean)))


def agreement_of(texts: Column) -> Column:
    """Mean pairwise Jaccard of the word sets in one row's array of candidates, clamped."""
    sets = F.transform(texts, word_set)
    pairs = F.flatten(
        F.transform(sets, lambda a, i: F.transform(F.slice(sets, i + 2, F.size(sets)), lambda b: _jaccard(a, b)))
    )
    scored = F.filter(pairs, lambda j: j.isNotNull())
    return _clamp(F.aggregate(scored, F.lit(0.0), lambda t, j: t + j) / F.nullif(F.size(scored), F.lit(0)))


def consistency_confidence(
    cands: DataFrame, prompt: str = "prompt_id", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """Mean pairwise Jaccard of lower-case word sets per prompt, clamped to [0.1, 1].

    One candidate, or no pair with a word in it, gives 0.5. Equal word sets
    are merged into one with a weight first, so copies cost nothing. Sets meet
    in groups of about 2 * `block`: a prompt with more sets is cut into hashed
    blocks, and every pair of blocks adds its own sum. No pairs are emitted.
    """
    sets = (
        cands.select(prompt, word_set(F.coalesce(F.col(text), F.lit(""))).alias("_set"))
        .groupBy(prompt, "_set")
        .agg(F.count(F.lit(1)).alias("_m"))
    )
    m, empty = F.col("_m"), F.size("_set") == 0
    choose2 = m * (m - 1) / 2
    stats = sets.groupBy(prompt).agg(
        F.count(F.lit(1)).alias("_sets"),
        F.sum("_m").alias("_n"),
        F.sum(F.when(empty, F.lit(0.0)).otherwise(choose2)).alias("_same"),
        F.sum(F.when(empty, choose2).otherwise(F.lit(0.0))).alias("_blank"),
    )
    crowded = stats.where(F.col("_sets") > block).select(prompt, F.ceil(F.col("_sets") / block).alias("_blocks"))
    blocks = F.coalesce(F.col("_blocks"), F.lit(1))
    own = F.pmod(F.xxhash64("_set"), F.col("_blocks"))
    spread = (
        skew_join(sets, crowded, prompt)
        .withColumn("_blocks", blocks)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
        .withColumn("_p", F.least("_own", "_other"))
        .withColumn("_q", F.greatest("_own", "_other"))
    )
    met = spread.groupBy(prompt, "_p", "_q").agg(F.collect_list(F.struct("_own", "_set", "_m")).alias("_items"))
    items, p, q = F.col("_items"), F.col("_p"), F.col("_q")

    def against(x: Column) -> Column:
        partners = F.filter(
            items, lambda y: F.when(p == q, x["_set"] < y["_set"]).otherwise((x["_own"] == p) & (y["_own"] == q))
        )
        return F.aggregate(
            partners, F.lit(0.0), lambda t, y: t + _jaccard(x["_set"], y["_set"]) * (x["_m"] * y["_m"]).cast("double")
        )

    cross = (
        met.select(prompt, F.aggregate(items, F.lit(0.0), lambda t, x: t + against(x)).alias("_cross"))
        .groupBy(prompt)
        .agg(F.sum("_cross").alias("_cross"))
    )
    n = F.col("_n").cast("double")
    pairs = n * (n - 1) / 2 - F.col("_blank")
    mean = (F.col("_same") + F.col("_cross")) / F.nullif(pairs, F.lit(0.0))
    return stats.join(cross, prompt).select(
        prompt, F.col("_n").alias("candidates"), _clamp(mean).alias("confidence_score")
    )
