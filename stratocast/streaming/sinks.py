"""Sinks that hold every batch once, whatever fails in between.

A batch has a folder of its own, named by its number, and is written by
overwriting that folder. Spark gives a batch that did not finish the same number
and the same rows after a restart, so a replay replaces what a failed run left.
Readers see the folder's number as the column `batch`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stratocast.streaming.files import checkpoint_location


def write_batch(df: DataFrame, batch: int, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Replace the folder of one batch; an empty batch leaves an empty folder."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path.rstrip('/')}/batch={batch}")


def start_exactly_once(
    stream: DataFrame,
    path: str,
    name: str,
    checkpoint: str | None = None,
    mode: str = "append",
    partition_by: tuple[str, ...] = (),
    also: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Write what is available to `path`, batch by batch; `also` gets each batch after it is written, and may get it again."""

    def each(df: DataFrame, batch: int) -> None:
        write_batch(df, batch, path, partition_by)
        if also is not None:
            also(df, batch)

    at = checkpoint_location(stream.sparkSession, name, checkpoint)
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", at).outputMode(mode)
    return writer.trigger(availableNow=True).start()


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches written so far, with their number."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option("basePath", path).parquet(path)
