"""Table schemas shared by readers, operators and tests."""

from __future__ import annotations

from pyspark.sql import types as T

LOCATION = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("elevation", T.DoubleType()),
        T.StructField("timezone", T.StringType()),
        T.StructField("country", T.StringType()),
    ]
)

# The flat observation row, in output column order.
OBSERVATION = T.StructType(
    [
        T.StructField("location_name", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("datetime", T.TimestampType()),
        T.StructField("temperature_c", T.DoubleType()),
        T.StructField("humidity_pct", T.DoubleType()),
        T.StructField("pressure_hpa", T.DoubleType()),
        T.StructField("wind_speed_kph", T.DoubleType()),
        T.StructField("wind_direction_deg", T.DoubleType()),
        T.StructField("precipitation_mm", T.DoubleType()),
        T.StructField("precipitation_probability", T.DoubleType()),
        T.StructField("cloud_cover_pct", T.DoubleType()),
        T.StructField("visibility_km", T.DoubleType()),
        T.StructField("weather_code", T.IntegerType()),
    ]
)

MEASURES = [f.name for f in OBSERVATION.fields if f.name not in ("location_name", "latitude", "longitude", "datetime")]

# Parallel arrays of one landed block.
BLOCK_ARRAYS = [
    "temperature_c",
    "humidity_pct",
    "pressure_hpa",
    "wind_speed",
    "wind_direction_deg",
    "precipitation_probability",
    "precipitation_mm",
    "cloud_cover_pct",
]

HOURLY_BLOCK = T.StructType(
    [
        T.StructField("location", LOCATION),
        T.StructField("start", T.TimestampType()),
        T.StructField("end", T.TimestampType()),
        T.StructField("interval_s", T.LongType()),
    ]
    + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in BLOCK_ARRAYS]
)

TRAINING_RECORD = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("input", "target", "prompt", "response", "location", "datetime")]
)

OBSERVED = T.StructType([T.StructField("rain", T.BooleanType()), T.StructField("temperature", T.DoubleType())])

QUALITY_CASE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("reference_forecast", T.StringType()),
        T.StructField("required_terms", T.ArrayType(T.StringType())),
        T.StructField("forbidden_patterns", T.ArrayType(T.StringType())),
        T.StructField("observed_weather", OBSERVED),
    ]
)

REQUEST = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("forecast_horizon", T.IntegerType()),
        T.StructField("include_confidence", T.BooleanType()),
    ]
)
