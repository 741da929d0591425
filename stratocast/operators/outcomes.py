"""What became of forecasts: observed outcomes, calibration, bands, ranges, drift, tolerances, run comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratocast.operators.ranges import range_summary

# Edges of the declared bands.
BANDS = {
    "temperature_c": [-10.0, 0.0, 10.0, 20.0, 30.0, 40.0],
    "humidity_pct": [0.0, 30.0, 60.0, 80.0, 100.0],
    "wind_speed_kph": [0.0, 10.0, 20.0, 40.0, 60.0],
    "pressure_hpa": [980.0, 1000.0, 1020.0, 1040.0],
    "precipitation_probability": [0.0, 0.2, 0.5, 0.8, 1.0],
}
# Values outside of these are physically impossible near the ground.
RANGES = {
    "temperature_c": (-90.0, 60.0),
    "humidity_pct": (0.0, 100.0),
    "wind_speed_kph": (0.0, 410.0),
    "pressure_hpa": (850.0, 1090.0),
    "precipitation_probability": (0.0, 1.0),
}
TEMPERATURE_TOLERANCE, WIND_TOLERANCE = 3.0, 5.0
RAIN_FROM = 0.5


def verify_outcomes(
    forecasts: DataFrame, obs: DataFrame, key: str, rain_from: float = RAIN_FROM, location: str = "location_name"
) -> DataFrame:
    """`key` and observed STRUCT<rain, temperature> over (generated_at, valid_until] at each forecast's location.

    Observations are summed up by location and time, and each different range of
    time is answered by its two bounds (`ranges.range_summary`): no forecast
    meets a single observation, and a hot location is spread by time. Nothing
    observed gives NULL fields; the struct feeds `rewards.join_observed`.
    """
    asked = forecasts.select(F.col(key).alias("_id"), F.col(location).alias("at"), F.col("generated_at").alias("since"), F.col("valid_until").alias("until"))
    temperature = F.nanvl("temperature_c", F.lit(None))
    seen = (
        obs.where(F.col(location).isNotNull() & F.col("datetime").isNotNull())
        .groupBy(F.col(location).alias("at"), F.col("datetime").alias("time"))
        .agg(
            F.coalesce(F.sum(temperature), F.lit(0.0)).alias("total"),
            F.count(temperature).alias("n"),
            F.max(F.nanvl("precipitation_probability", F.lit(None))).alias("top"),
        )
    )
    found = range_summary(asked.select("at", "since", "until"), seen)
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    return asked.join(found, ["at", "since", "until"], "left").select(
        F.col("_id").alias(key), F.struct((F.col("top") >= rain_from).alias("rain"), mean.alias("temperature")).alias("observed")
    )


def _bin(p: Column, bins: int) -> Column:
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def reliability_bins(df: DataFrame, p: str, outcome: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Per bin of the forecast probability: rows, mean probability and observed rate."""
    rows = df.where(F.col(p).isNotNull() & F.col(outcome).isNotNull())
    return rows.groupBy(*by, _bin(F.col(p), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(p).alias("mean_p"), F.avg(outcome).alias("rate")
    )


def brier_decomposition(df: DataFrame, p: str, outcome: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Per group: reliability, resolution and uncertainty of binned probabilities."""
    table = reliability_bins(df, p, outcome, by, bins)
    n, hits = F.sum("rows"), F.sum(F.col("rows") * F.col("rate"))
    squares = F.sum(F.col("rows") * F.col("rate") * F.col("rate"))
    base = hits / n
    return table.groupBy(*by).agg(
        n.alias("rows"),
        (F.sum(F.col("rows") * (F.col("mean_p") - F.col("rate")) ** 2) / n).alias("reliability"),
        (squares / n - base * base).alias("resolution"),
        (base * (1 - base)).alias("uncertainty"),
    )


def band_of(value: Column, edges: Sequence[float]) -> Column:
    """How many edges the value reaches; NULL for a missing value."""
    reached = sum(((value >= e).cast("int") for e in edges[1:]), (value >= edges[0]).cast("int"))
    return F.when(value.isNotNull() & ~F.isnan(value), reached)


def band_features(obs: DataFrame, bands: Mapping[str, Sequence[float]] = BANDS) -> DataFrame:
    """`obs` with one band column per measure, named <measure>_band."""
    return obs.withColumns({f"{c}_band": band_of(F.col(c), edges) for c, edges in bands.items()})


def _long(columns: Mapping[str, Column]) -> Column:
    """One row per measure: (measure, value)."""
    cells = [F.struct(F.lit(c).alias("measure"), v.alias("value")) for c, v in columns.items()]
    return F.inline(F.array(*cells))


def band_counts(obs: DataFrame, by: Sequence[str] = (), bands: Mapping[str, Sequence[float]] = BANDS) -> DataFrame:
    """Rows per measure and band."""
    cells = _long({c: band_of(F.col(c), edges) for c, edges in bands.items()})
    return obs.select(*by, cells).groupBy(*by, "measure", F.col("value").alias("band")).agg(F.count(F.lit(1)).alias("rows"))


def range_violations(
    obs: DataFrame, by: Sequence[str] = (), ranges: Mapping[str, tuple[float, float]] = RANGES
) -> DataFrame:
    """Per measure: rows below and above its range, and missing ones (NULL or NaN)."""
    value = F.col("value")
    limits = {c: F.struct(F.col(c).alias("v"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for c, (lo, hi) in ranges.items()}
    rows = obs.select(*by, _long(limits)).select(*by, "measure", "value.*")
    value = F.col("v")
    bad = value.isNull() | F.isnan(value)
    return rows.groupBy(*by, "measure").agg(
        F.count_if(~bad & (value < F.col("lo"))).alias("below"),
        F.count_if(~bad & (value > F.col("hi"))).alias("above"),
        F.count_if(bad).alias("missing"),
    )


def tolerance_accuracy(
    df: DataFrame,
    generated: Column,
    reference: Column,
    by: Sequence[str] = (),
    temperature: float = TEMPERATURE_TOLERANCE,
    wind: float = WIND_TOLERANCE,
) -> DataFrame:
    """Shares of extracted temperatures and winds that lie within tolerance of the reference's.

    `generated` and `reference` are structs of `extract_conditions`; pairs of
    which one side is missing do not count, and a group without pairs has NULL.
    """

    def middle(c: Column) -> Column:
        return (c["temperature_range"]["lo"] + c["temperature_range"]["hi"]) / 2.0

    def within(error: Column, limit: float) -> Column:
        return F.avg(F.when(error.isNotNull(), (error <= limit).cast("double")))

    rows = df.select(
        *by,
        F.abs(middle(generated) - middle(reference)).alias("_t"),
        F.abs(generated["wind_speed"] - reference["wind_speed"]).alias("_w"),
    )
    return rows.groupBy(*by).agg(
        F.count("_t").alias("temperature_pairs"),
        within(F.col("_t"), temperature).alias("temperature_accuracy"),
        F.count("_w").alias("wind_pairs"),
        within(F.col("_w"), wind).alias("wind_accuracy"),
    )


def compare_runs(log: DataFrame, first: str, second: str, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Mean finite value of every metric in two runs, and second minus first. `log` has run, value and the keys."""
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    rows = log.where(F.col("run").isin(first, second) & finite)
    mean = {n: F.avg(F.when(F.col("run") == r, F.col("value"))) for n, r in (("first", first), ("second", second))}
    out = rows.groupBy(*keys).agg(*[m.alias(n) for n, m in mean.items()])
    return out.withColumn("delta", F.col("second") - F.col("first"))


def weekly_drift(df: DataFrame, time: Column, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Weekly means of metrics per group, and their change from the group's week before.

    The rows are summed up by week first, so the window sees one row a week.
    """
    weeks = df.groupBy(*by, F.date_trunc("week", time).alias("week")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.avg(m).alias(m) for m in metrics]
    )
    order = Window.partitionBy(*by).orderBy("week")
    return weeks.withColumns({f"{m}_change": F.col(m) - F.lag(m).over(order) for m in metrics})


def windowed_observations(obs: DataFrame, width: str = "6 hours", late: str | None = "1 day") -> DataFrame:
    """Per location and tumbling window: rows, mean temperature and the highest rain probability.

    Works on a stream, where windows close `late` after their end, and on a table.
    """
    rows = obs.withWatermark("datetime", late) if obs.isStreaming else obs
    span = F.window("datetime", width)
    return (
        rows.groupBy(span, "location_name")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg("temperature_c").alias("temperature"),
            F.max("precipitation_probability").alias("rain"),
        )
        .select("location_name", F.col("window.start").alias("start"), "rows", "temperature", "rain")
    )
