"""JSON arrays and JSON maps as many tasks, whatever the size of one file.

A file is read as text that ends at every `}` (arrays) or `,` (maps), so Spark
cuts it by byte ranges like any text. Whether such a character really ends a
record depends on all that stands before it: it does outside of strings and at
the right depth only. Both are sums over the pieces before (quotes, and opened
less closed braces), so they are added up within each run of pieces of a byte range,
and the runs of a file are shifted by the totals of the runs before. A record that spans
pieces or ranges is put together from them; all others stay where they are.

Files are taken to be valid UTF-8 JSON; a last record that is not closed is read
as if it were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratocast.storage import stored

RUN_BITS = 12  # 4,096 pieces in a run at most
TASK_PIECES = 200_000  # pieces that one task sorts, about
_BLANK = " \t\r\n﻿"


def _pieces(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """file, begin (of the byte range), at (order within it) and the text up to the next `mark`."""
    return spark.read.option("lineSep", mark).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("begin"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )


def first_characters(spark: SparkSession, path: str) -> DataFrame:
    """file, first: the first character of every file that is no blank."""
    lines = _pieces(spark, path, "\n").withColumn("value", F.ltrim(F.col("value"), F.lit(_BLANK))).where("value <> ''")
    return lines.groupBy("file").agg(F.min_by(F.substring("value", 1, 1), F.struct("begin", "at")).alias("first"))


def _before(pieces: DataFrame, column: str, name: str, tasks: int) -> DataFrame:
    """Add the sum of `column` over all earlier pieces of the file; a task sorts a `tasks`-th of the pieces."""
    runs = pieces.withColumn("run", F.shiftright("at", RUN_BITS))  # consecutive pieces of a byte range
    earlier = Window.partitionBy("file").orderBy("begin", "run").rowsBetween(Window.unboundedPreceding, -1)
    totals = runs.groupBy("file", "begin", "run").agg(F.sum(column).alias("_own"))  # one row per run
    shift = totals.select("file", "begin", "run", F.coalesce(F.sum("_own").over(earlier), F.lit(0)).alias("_shift"))
    within = Window.partitionBy("file", "begin", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.sum(column).over(within), F.lit(0))
    dealt = runs.repartition(tasks, "file", "begin", "run").withColumn("_here", here)
    return dealt.join(shift, ["file", "begin", "run"]).withColumn(name, F.col("_shift") + F.col("_here")).drop("_shift", "_here", "run")


def _times(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _split(pieces: DataFrame, mark: str, opening: str, closing: str, level: int) -> DataFrame:
    """file, position, text and ends of every record; one ends at a mark outside of strings where the depth is `level`.

    What follows the last mark of a file has ends = 0.
    """
    tasks = pieces.count() // TASK_PIECES + 1
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # without escaped characters
    quoted = stored(_before(pieces.withColumn("quotes", _times(plain, '"')), "quotes", "quotes_before", tasks))
    inside = F.col("quotes_before") % 2 == 1
    rest = F.when(inside, F.regexp_replace(plain, '^[^"]*("|$)', "")).otherwise(plain)
    outside = F.regexp_replace(rest, '"[^"]*("|$)', "")
    counts = (F.col("quotes_before") + F.col("quotes")) % 2 == 0  # the mark stands outside of strings
    deeper = _times(outside, opening) - _times(outside, closing) - F.when(counts & F.lit(mark in closing), 1).otherwise(0)
    nested = stored(
        _before(quoted.select("file", "begin", "at", "value", inside.alias("inside"), counts.alias("counts"), deeper.alias("deeper")), "deeper", "depth", tasks)
    )
    ends = F.col("counts") & (F.col("depth") + F.col("deeper") == level)
    marked = _before(nested.withColumn("ends", ends.cast("int")), "ends", "position", tasks)
    # Of a position that ends in its first piece nothing else is left to find: nearly all of them.
    alone = ~F.col("inside") & (F.col("depth") == level) & (F.col("ends") == 1) & (F.col("position") > 0)
    parts = F.array_sort(F.collect_list(F.struct("begin", "at", "value")))
    several = marked.where(~alone).repartition(tasks, "file", "position").groupBy("file", "position")
    joined = several.agg(F.array_join(F.transform(parts, lambda p: p["value"]), mark).alias("text"), F.max("ends").alias("ends"))
    return marked.where(alone).select("file", "position", F.col("value").alias("text"), "ends").unionByName(joined)


def array_records(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """file, position and JSON text of every object of arrays of objects; `files` (column file) narrows the files of `path`."""
    pieces = _pieces(spark, path, "}")
    if files is not None:
        pieces = pieces.join(files.select("file"), "file", "left_semi")
    found = _split(pieces, "}", "{", "}", 0).where("ends = 1")
    whole = F.concat(F.ltrim(F.col("text"), F.lit(_BLANK + "[],")), F.lit("}"))
    return found.select("file", "position", whole.alias("text"))


def map_entries(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """file, position, key and value of every entry of maps of plain values; null values stay NULL."""
    pieces = _pieces(spark, path, ",")
    if files is not None:
        pieces = pieces.join(files.select("file"), "file", "left_semi")
    found = _split(pieces, ",", "{[", "}]", 1).withColumn("text", F.trim(F.col("text"), F.lit(_BLANK)))
    # The first entry still has the map's opening brace, the last one its closing one.
    body = F.when(F.col("text").startswith("{"), F.col("text").substr(F.lit(2), F.length("text"))).otherwise(F.col("text"))
    ends = found.groupBy("file").agg(F.max("position").alias("_last"))
    closed = found.join(ends, "file").withColumn("body", body)
    body = F.when(F.col("position") == F.col("_last"), F.regexp_replace("body", r"\}\s*$", "")).otherwise(F.col("body"))
    entry = F.from_json(F.concat(F.lit("{"), body, F.lit("}")), "map<string,string>")
    return closed.select("file", "position", F.explode(F.map_entries(entry)).alias("e")).select("file", "position", "e.key", "e.value")
