"""One rule for intermediates that are used more than once: a table in the shared folder.

The folder is spark.checkpoint.dir of the session. Where that is unset, a local
session takes a folder below its warehouse, and a cluster is told to set it: its
executors need not share a warehouse. What is written is the same on a laptop
and on a cluster. Everything a session wrote lies in one folder of its own,
which `clear` deletes; it is also called when the program ends.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_SEEN: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """This session's own folder in the shared one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    return f"{root.rstrip('/')}/stratocast-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    """A path in the session's folder that nothing has been written to."""
    folder = shared_folder(spark)
    if folder not in _SEEN:
        _SEEN.add(folder)
        atexit.register(clear, spark)
    return f"{folder}/{uuid.uuid4().hex}"


def stored(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write `df` as Parquet to the shared folder and return a reader of it.

    The copy outlives lost executors, ends the lineage, and each use reads only
    its own columns. The write is a job, so it runs when this is called.
    """
    spark = df.sparkSession
    path = new_path(spark)
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all that this session stored; for after its results were consumed."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may have ended before the program
        return
