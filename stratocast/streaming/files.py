"""The ingest and scoring operators on file streams.

Both are free of shuffles and state: every landed file is handled once, and a
restart from the same checkpoint goes on where the last run stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stratocast.operators.ingest import KPH_PER_MPS, flatten_hourly, normalize_units, observations_table, quarantine_blocks
from stratocast.operators.rewards import composite_reward, join_observed
from stratocast.schemas import HOURLY_BLOCK


def checkpoint_location(spark: SparkSession, name: str, given: str | None = None) -> str:
    """A folder for a query's progress: the given one, else one in the session's shared checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not root:
        raise ValueError("no checkpoint folder: give one or set spark.checkpoint.dir")
    return given or f"{root.rstrip('/')}/{name}"


def read_block_stream(spark: SparkSession, path: str) -> DataFrame:
    """Landed block files, one JSON object per line, as a stream."""
    return spark.readStream.schema(HOURLY_BLOCK).json(path)


def start_ingest(
    blocks: DataFrame,
    observations_path: str,
    rejected_path: str,
    checkpoint: str | None = None,
    wind_factor: float = KPH_PER_MPS,
) -> tuple[StreamingQuery, StreamingQuery]:
    """Append new blocks to the observation table and unreadable ones to the rejects."""
    spark = blocks.sparkSession
    good, bad = quarantine_blocks(blocks)
    flat = observations_table(normalize_units(flatten_hourly(good), wind_factor))

    def start(df: DataFrame, path: str, name: str) -> StreamingQuery:
        at = checkpoint_location(spark, name, checkpoint and f"{checkpoint}/{name}")
        writer = df.writeStream.format("parquet").option("checkpointLocation", at).outputMode("append")
        return writer.trigger(availableNow=True).start(path)

    return start(flat, observations_path, "observations"), start(bad, rejected_path, "rejected_blocks")


def start_scoring(
    texts: DataFrame,
    path: str,
    text: str = "generated_forecast",
    observed: DataFrame | None = None,
    key: Sequence[str] = ("sample_id",),
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Append the reward components of every new text; `observed` is a static table."""
    rows = texts if observed is None else join_observed(texts, observed, key)
    scored = composite_reward(rows, text, None if observed is None else "observed")
    at = checkpoint_location(texts.sparkSession, "reward_scores", checkpoint)
    writer = scored.writeStream.format("parquet").option("checkpointLocation", at).outputMode("append")
    return writer.trigger(availableNow=True).start(path)
