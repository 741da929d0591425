"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


# A static setting, so it belongs where a session is made: no stack trace per column call while planning.
_TRACES = "spark.python.sql.dataFrameDebugging.enabled"

# Generated methods above this size are not compiled by the JVM; split projections instead.
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and the bench; on a cluster use the session that is given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stratocast")
        .config("spark.ui.enabled", "false")
        .config(_TRACES, "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Small data, many operations per row: keep all cores busy after a shuffle.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.driver.memory", extra.pop("driver_memory", "8g"))
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """All times are UTC, and wide projections stay compiled; for a session that was made elsewhere."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set(_METHOD_LIMIT, "8000")
    return spark
