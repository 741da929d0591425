"""Reward scoring of tables of forecast texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratocast.functions import extract, reward


def composite_reward(
    df: DataFrame, text: str, observed: str | None = None, weights: dict[str, float] | None = None
) -> DataFrame:
    """Add the four components and total_reward; features are read once per text.

    `observed` names a STRUCT<rain, temperature> column; a NULL or empty one
    gives the neutral accuracy. No shuffle, so it runs on streams as well.
    """
    out = df.withColumn("_features", extract.reward_features(F.coalesce(F.col(text), F.lit(""))))
    parts = reward.composite_reward(
        F.coalesce(F.col(text), F.lit("")), F.col("_features"), F.col(observed) if observed else None, weights
    )
    return out.withColumn("_reward", parts).select(*df.columns, "_reward.*")


def join_observed(df: DataFrame, observed: DataFrame, key: Sequence[str], name: str = "observed") -> DataFrame:
    """Attach observed weather (columns rain, temperature; unique on `key`) where there is any."""
    seen = observed.select(*key, F.struct("rain", "temperature").alias(name))
    return df.join(seen, list(key), "left")


def first_text(*columns: str) -> Column:
    """The first column that is not empty, else ''."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(""))


def mean_reward(
    df: DataFrame,
    n: int | None,
    order: Sequence[str],
    by: Sequence[str] = (),
    prefer: Sequence[str] = ("target", "response"),
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Average total reward of the first n texts in a total order, per group; 0.0 for none."""
    rows = df.withColumn("_text", first_text(*prefer))
    if n and by:
        rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
        rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= n)
    elif n:
        rows = rows.orderBy(*order).limit(n)
    scored = composite_reward(rows, "_text", weights=weights)
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), F.coalesce(F.avg("total_reward"), F.lit(0.0)).alias("avg_reward")
    )


def _not_finite(value: Column) -> Column:
    return value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))


def training_guards(
    df: DataFrame, batch: str = "batch", tokens: str = "tokens", score: str = "total_reward", minimum: int = 2
) -> DataFrame:
    """Accept or reject every batch: no response under two tokens, no non-finite reward."""
    return (
        df.groupBy(batch)
        .agg(
            F.count(F.lit(1)).alias("responses"),
            F.min(tokens).alias("shortest"),
            F.count_if(_not_finite(F.col(score))).alias("non_finite"),
        )
        .withColumn(
            "reason",
            F.when(F.col("shortest") < minimum, "too-short response").when(
                F.col("non_finite") > 0, "non-finite reward"
            ),
        )
        .withColumn("accepted", F.col("reason").isNull())
    )


def reward_range_check(df: DataFrame, score: str = "total_reward") -> DataFrame:
    """How many rewards there are and how many lie outside [0, 1]."""
    value = F.col(score)
    return df.agg(
        F.count(F.lit(1)).alias("rewards"),
        F.count_if(value.isNull() | F.isnan(value) | (value < 0) | (value > 1)).alias("violations"),
    )
