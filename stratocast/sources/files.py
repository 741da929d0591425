"""Readers and writers; a path's suffix picks the format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratocast.schemas import HOURLY_BLOCK, OBSERVATION, QUALITY_CASE, TRAINING_RECORD
from stratocast.sources.json_split import array_records, first_characters, map_entries

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS"
_PLAIN = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _suffix(path: str, *allowed: str) -> str:
    for suffix in allowed:
        if path.rstrip("/").endswith(f".{suffix}"):
            return suffix
    raise ValueError("Unsupported file format. Use " + " or ".join(f".{s}" for s in allowed))


def write_observations(df: DataFrame, path: str, mode: str = "error", by_date: bool = False) -> None:
    """Write by suffix: .csv (with header), .parquet or .json (ISO dates), as a directory of part files.

    `by_date` adds a `date` partition column, so that readers prune by day.
    """
    kind = _suffix(path, "csv", "parquet", "json")
    out = df.withColumn("date", F.to_date("datetime")) if by_date else df
    writer = out.write.mode(mode)
    if by_date:
        writer = writer.partitionBy("date")
    if kind == "csv":
        writer.option("header", True).option("timestampFormat", _PLAIN).csv(path)
    elif kind == "json":
        writer.option("timestampFormat", _ISO).json(path)
    else:
        writer.parquet(path)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Read .csv, .parquet or .json observations with the flat schema; nothing is inferred."""
    kind = _suffix(path, "csv", "parquet", "json")
    if kind == "parquet":
        return spark.read.schema(OBSERVATION).parquet(path)
    texts = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name == "datetime" else f.dataType) for f in OBSERVATION.fields]
    )
    if kind == "csv":
        # Columns go by header name, in whatever order the file has them.
        raw = spark.read.option("header", True).option("enforceSchema", False).schema(texts).csv(path)
    else:
        raw = _read_json(spark, path, texts)
    return raw.withColumn("datetime", F.to_timestamp("datetime"))


def _read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, or arrays of records, whichever each file holds; an array of any size is many tasks."""
    arrays = first_characters(spark, path).where("first = '['")
    if arrays.isEmpty():
        return spark.read.schema(schema).json(path)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).join(arrays, "file", "left_anti")
    texts = lines.where(F.trim("value") != "").select(F.col("value").alias("text"))
    return array_records(spark, path, arrays).select("text").union(texts).select(F.from_json("text", schema).alias("r")).select("r.*")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Landed hourly blocks, one JSON object per line or Parquet."""
    if _suffix(path, "parquet", "json", "jsonl") == "parquet":
        return spark.read.schema(HOURLY_BLOCK).parquet(path)
    return _read_json(spark, path, HOURLY_BLOCK)


def write_dataset(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write records as JSON lines under a .json or .jsonl directory."""
    _suffix(path, "json", "jsonl")
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_dataset(spark: SparkSession, path: str, schema: T.StructType = TRAINING_RECORD) -> DataFrame:
    """Read .jsonl lines, or .json as lines or as one array of records."""
    if _suffix(path, "json", "jsonl") == "jsonl":
        return spark.read.schema(schema).json(path)
    return _read_json(spark, path, schema)


def read_quality_cases(spark: SparkSession, path: str) -> DataFrame:
    """A non-empty list of quality cases."""
    cases = _read_json(spark, path, QUALITY_CASE)
    if cases.isEmpty():
        raise ValueError(f"Eval set must be a non-empty list: {path}")
    return cases


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(id, generated_forecast) from files of JSON maps {id: text} or lists of records; of equal ids the last wins, by file and place."""
    heads = first_characters(spark, path)
    record = "id string, generated_forecast string, forecast string"
    listed = array_records(spark, path, heads.where("first = '['")).select(F.from_json("text", record).alias("r"), "file", "position")
    place = F.struct("file", "position")
    text = F.coalesce(F.nullif("r.generated_forecast", F.lit("")), F.nullif("r.forecast", F.lit("")))
    mapped = map_entries(spark, path, heads.where("first = '{'")).select(
        F.col("key").alias("id"), F.coalesce("value", F.lit("None")).alias("text"), place.alias("place")
    )
    named = listed.select(F.nullif("r.id", F.lit("")).alias("id"), text.alias("text"), place.alias("place"))
    both = named.where("id IS NOT NULL AND text IS NOT NULL").union(mapped)
    return both.groupBy("id").agg(F.max_by("text", "place").alias("generated_forecast"))


def normalize_predictions(df: DataFrame, position: Column) -> DataFrame:
    """List shape: `generated_forecast`, else `forecast`; no id or no text drops out, the last duplicate wins.

    The winner is a maximum, so duplicates are reduced before the shuffle.
    """
    other = F.nullif(F.col("forecast"), F.lit("")) if "forecast" in df.columns else F.lit(None).cast("string")
    text = F.coalesce(F.nullif(F.col("generated_forecast"), F.lit("")), other)
    return (
        df.select(F.nullif(F.col("id").cast("string"), F.lit("")).alias("id"), text.alias("_text"), position.alias("_at"))
        .where(F.col("id").isNotNull() & F.col("_text").isNotNull())
        .groupBy("id")
        .agg(F.max_by("_text", "_at").alias("generated_forecast"))
    )


def normalize_prediction_maps(df: DataFrame, predictions: str = "predictions", place: Column | None = None) -> DataFrame:
    """Map shape: one row per id, the last of equal ones by (place of the map, place in it); a null text reads 'None'."""
    at = F.lit(0) if place is None else place
    entries = df.select(at.alias("_map"), F.posexplode(F.map_entries(predictions)).alias("_at", "_entry"))
    text = F.coalesce(F.col("_entry.value").cast("string"), F.lit("None"))
    last = F.max_by(text, F.struct("_map", "_at"))
    return entries.groupBy(F.col("_entry.key").alias("id")).agg(last.alias("generated_forecast"))
