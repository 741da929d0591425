"""Landed blocks to the flat observation table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocast.operators.scale import skew_join
from stratocast.schemas import BLOCK_ARRAYS, MEASURES, OBSERVATION

# The city dimension, in order; training takes the first five.
CITIES = [
    ("New York", 40.7128, -74.0060, "USA"),
    ("London", 51.5074, -0.1278, "UK"),
    ("Tokyo", 35.6762, 139.6503, "Japan"),
    ("Paris", 48.8566, 2.3522, "France"),
    ("Sydney", -33.8688, 151.2093, "Australia"),
    ("Berlin", 52.5200, 13.4050, "Germany"),
    ("Toronto", 43.6532, -79.3832, "Canada"),
    ("Mumbai", 19.0760, 72.8777, "India"),
    ("São Paulo", -23.5505, -46.6333, "Brazil"),
    ("Cairo", 30.0444, 31.2357, "Egypt"),
]
TRAINING_CITIES = 5
KPH_PER_MPS = 3.6


def block_fault(arrays: list[str]) -> Column:
    """Why a block cannot be read, or NULL."""
    steps = _steps()
    short = reduce(lambda a, b: a | b, [F.col(c).isNotNull() & (F.size(c) < steps) for c in arrays])
    return (
        F.when(F.col("location.name").isNull(), "no location")
        .when(F.col("start").isNull() | F.col("end").isNull(), "no time range")
        .when(F.coalesce(F.col("interval_s"), F.lit(0)) <= 0, "bad interval")
        .when(F.col("temperature_c").isNull(), "no temperature")
        .when(short, "short array")
    )


def quarantine_blocks(blocks: DataFrame, arrays: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(readable, rejected with `reason`): one bad location does not stop the others."""
    tagged = blocks.withColumn("reason", block_fault(arrays or _present(blocks)))
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def _present(blocks: DataFrame) -> list[str]:
    return [c for c in BLOCK_ARRAYS if c in blocks.columns]


def _steps() -> Column:
    # Steps of [start, end): none unless start < end.
    span = F.unix_micros(F.col("end")) - F.unix_micros(F.col("start"))
    return F.when(span > 0, F.ceil(span / (F.col("interval_s") * F.lit(1_000_000)))).otherwise(F.lit(0)).cast("int")


def flatten_hourly(blocks: DataFrame) -> DataFrame:
    """One row per step of [start, end); a narrow operation.

    Arrays are read by step number. A step past the end of an array is an
    error of the block: quarantine such blocks first, here it reads NULL.
    """
    arrays = _present(blocks)
    last = F.unix_micros(F.col("start")) + (F.col("_steps") - 1) * F.col("interval_s") * F.lit(1_000_000)
    times = F.when(
        F.col("_steps") > 0,
        F.sequence(F.unix_micros(F.col("start")), last, F.col("interval_s") * F.lit(1_000_000)),
    )
    kept = [c for c in blocks.columns if c not in (*arrays, "start", "end", "interval_s")]
    return (
        blocks.withColumn("_steps", _steps())
        .select(*kept, *arrays, F.posexplode(times).alias("_step", "_micros"))
        .select(
            *kept,
            F.timestamp_micros(F.col("_micros")).alias("datetime"),
            *[F.get(F.col(c), F.col("_step")).alias(c) for c in arrays],
        )
    )


def union_current_hourly(current: DataFrame, hourly: DataFrame) -> DataFrame:
    """The 'current' rows with the hourly rows; columns one side lacks are NULL."""
    return current.unionByName(hourly, allowMissingColumns=True)


def normalize_units(df: DataFrame, wind_factor: float = KPH_PER_MPS) -> DataFrame:
    """Wind speed to km/h and precipitation probability to a fraction."""
    out = df
    if "wind_speed" in df.columns:
        out = out.withColumn("wind_speed_kph", F.col("wind_speed") * F.lit(wind_factor)).drop("wind_speed")
    if "precipitation_probability" in df.columns:
        out = out.withColumn("precipitation_probability", F.col("precipitation_probability") / F.lit(100.0))
    return out


def observations_table(df: DataFrame, ordered: bool = False) -> DataFrame:
    """The flat 14-column table.

    Three measures fill NULL with 0.0 and keep NaN; visibility and weather
    code stay NULL. `ordered` sorts by location and time over range
    partitions, which splits a hot location by time.
    """
    filled = ("precipitation_mm", "precipitation_probability", "cloud_cover_pct")

    def measure(name: str) -> Column:
        kind = OBSERVATION[name].dataType
        value = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        return (F.coalesce(value, F.lit(0.0)) if name in filled else value).alias(name)

    flat = df.select(
        F.col("location.name").alias("location_name"),
        F.col("location.latitude").cast("double").alias("latitude"),
        F.col("location.longitude").cast("double").alias("longitude"),
        F.col("datetime").cast("timestamp").alias("datetime"),
        *[measure(m) for m in MEASURES],
    )
    return flat.orderBy("location_name", "datetime") if ordered else flat


def ingest_blocks(
    blocks: DataFrame, current: DataFrame | None = None, wind_factor: float = KPH_PER_MPS
) -> tuple[DataFrame, DataFrame]:
    """Blocks (and current rows) to (observations, rejected blocks)."""
    good, rejected = quarantine_blocks(blocks)
    rows = flatten_hourly(good)
    if current is not None:
        rows = union_current_hourly(current, rows)
    return observations_table(normalize_units(rows, wind_factor)), rejected


def profile_observations(df: DataFrame) -> DataFrame:
    """Row count, time range and number of locations, in one row."""
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.min("datetime").alias("first_datetime"),
        F.max("datetime").alias("last_datetime"),
        F.count_distinct("location_name").alias("locations"),
    )


def observed_locations(df: DataFrame) -> DataFrame:
    """The distinct location names, as rows."""
    return df.select("location_name").where(F.col("location_name").isNotNull()).distinct()


def location_dim(spark: SparkSession, training_only: bool = False) -> DataFrame:
    rows = CITIES[:TRAINING_CITIES] if training_only else CITIES
    return spark.createDataFrame(rows, "name string, latitude double, longitude double, country string")


def enrich_locations(df: DataFrame, dim: DataFrame | None = None, name: str = "location_name") -> DataFrame:
    """Add the country and coordinates of known cities.

    Without `dim` the fixed ten-city table is broadcast; a given dimension
    (unique on `name`) is looked up safely for locations with many rows.
    """
    known = location_dim(df.sparkSession) if dim is None else dim
    known = known.withColumnRenamed("name", name)
    facts = df.drop(*[c for c in known.columns if c != name])
    if dim is None:
        return facts.join(F.broadcast(known), name, "left")
    return skew_join(facts, known, name)


def readiness_report(df: DataFrame, minimums: dict[str, int], split: str = "split") -> DataFrame:
    """Per required split: rows, rows without input or target, and whether it is usable.

    All rows are checked for both fields.
    """
    required = df.sparkSession.createDataFrame(list(minimums.items()), "split string, minimum bigint")
    seen = df.groupBy(F.col(split).alias("split")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("input").isNull() | F.col("target").isNull()).alias("incomplete"),
    )
    rows, incomplete = F.coalesce(F.col("rows"), F.lit(0)), F.coalesce(F.col("incomplete"), F.lit(0))
    return required.join(seen, "split", "left").select(
        "split",
        "minimum",
        rows.alias("rows"),
        incomplete.alias("incomplete"),
        ((rows >= F.col("minimum")) & (incomplete == 0)).alias("ready"),
    )
