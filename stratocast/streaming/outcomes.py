"""Forecasts meet their observations while both arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocast.operators.outcomes import RAIN_FROM


def _micros(span: str):
    """An interval as microseconds; months and years have no fixed length."""
    zero = F.timestamp_micros(F.lit(0))
    return F.unix_micros(zero + F.expr(f"INTERVAL {span}"))


def verify_stream(
    forecasts: DataFrame,
    obs: DataFrame,
    key: str,
    longest: str = "12 hours",
    late: str = "1 hour",
    rain_from: float = RAIN_FROM,
    location: str = "location_name",
    spread: str = "1 hour",
) -> DataFrame:
    """`verify_outcomes` on two streams: `key`, generated_at, valid_until and observed STRUCT<rain, temperature>.

    Rows of either stream may come `late`. A forecast reaches `longest` ahead at
    most, one that reaches further fails the query; so both sides know how long
    they must keep a row. Its verdict is given once, when no observation that
    could count can come any more. Both sides meet by location and by stretches
    of time (`spread`), so a hot location is many keys.

    A forecast without a location or a time, or whose time is empty, is left out.
    """
    width = _micros(spread)
    far = F.unix_micros("valid_until") - F.unix_micros("generated_at") > _micros(longest)
    made = (
        forecasts.where(F.col(location).isNotNull() & (F.col("generated_at") < F.col("valid_until")))
        .select(F.col(key).alias("_id"), F.col(location).alias("_at"), "generated_at", "valid_until")
        .withWatermark("generated_at", late)
        .withColumn("_until", F.when(far, F.raise_error(F.lit(f"a forecast reaches further than {longest}"))).otherwise(F.col("valid_until")))
        .withColumn("_part", F.explode(F.sequence(F.floor(F.unix_micros("generated_at") / width), F.floor(F.unix_micros("_until") / width))))
    )
    seen = (
        obs.where(F.col(location).isNotNull())
        .select(
            F.col(location).alias("_place"),
            "datetime",
            F.nanvl("temperature_c", F.lit(None)).alias("_t"),
            F.nanvl("precipitation_probability", F.lit(None)).alias("_p"),
        )
        .withWatermark("datetime", late)
        .withColumn("_of", F.floor(F.unix_micros("datetime") / width))
    )
    inside = (
        (F.col("_at") == F.col("_place"))
        & (F.col("_part") == F.col("_of"))
        & (F.col("datetime") > F.col("generated_at"))
        & (F.col("datetime") <= F.col("_until"))
        & (F.col("datetime") <= F.col("generated_at") + F.expr(f"INTERVAL {longest}"))  # what lets Spark forget rows
    )
    return (
        made.join(seen, inside, "leftOuter")
        .groupBy("_id", "generated_at", "valid_until")
        .agg((F.max("_p") >= rain_from).alias("rain"), F.avg("_t").alias("temperature"))
        .select(F.col("_id").alias(key), "generated_at", "valid_until", F.struct("rain", "temperature").alias("observed"))
    )
