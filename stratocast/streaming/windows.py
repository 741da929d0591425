"""Sliding windows per location while observations arrive.

Each location keeps the rows that may still get earlier ones before them, and
its last rows in final order. A timer of event time wakes it when the watermark
has passed its earliest open row: rows before the watermark are final, and every
final row that has enough final rows after it starts a window. The state of a
location is one window and the rows of the time allowed for late ones.

State lives in Spark's RocksDB store, which `with_rocksdb` turns on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stratocast.operators.sequences import SERIES, features

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """Keep the state of this session's new queries in RocksDB."""
    spark.conf.set(PROVIDER, _ROCKSDB)
    return spark


class _Windows(StatefulProcessor):
    """Rows of one location have the columns of `schema`; the first is the time in microseconds, then come tie breakers."""

    def __init__(self, schema: T.StructType, out: T.StructType, ahead: int, keys: int):
        self._fields, self._schema, self._ahead, self._keys = schema.fieldNames(), schema, ahead, keys
        self._row = Row(*out.fieldNames())

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getListState("open", self._schema)
        self._final = handle.getListState("final", self._schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        edge = timerValues.getCurrentWatermarkInMs() * 1000
        fresh = [t for t in (tuple(r[f] for f in self._fields) for r in rows) if t[0] >= edge]  # the others came too late
        if fresh:
            self._open.appendList(fresh)
            self._wake(min(t[0] for t in fresh))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        edge = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((tuple(r) for r in self._open.get()), key=lambda t: t[: self._keys])
        final = [t for t in held if t[0] < edge]
        left = held[len(final) :]
        if left:
            self._open.put(left)
            self._wake(left[0][0])
        else:
            self._open.clear()
        if not final:
            return
        known = [tuple(r) for r in self._final.get()] + final
        for i in range(len(known) - self._ahead):
            rows = known[i : i + self._ahead]
            values = [[r[c] for r in rows] for c in range(self._keys, len(self._fields))]
            yield self._row(*key, *known[i][: self._keys], *values)
        self._final.put(known[-self._ahead :])

    def _wake(self, micros: int) -> None:
        self._handle.registerTimer(micros // 1000 + 1)

    def close(self) -> None:
        pass


def stream_windows(
    obs: DataFrame,
    length: int = 4,
    horizon: int = 6,
    location: str = "location_name",
    order: Sequence[str] = ("datetime",),
    late: str = "1 hour",
) -> DataFrame:
    """`sequences.window_features` on a stream: each window comes once, when its last row is final.

    `order` is the time and the columns that break ties; rows may come `late`,
    later ones are left out, as are rows without a location or a time. The last
    windows of a location stay open until later rows arrive, at any location.
    """
    time, *ties = order
    kinds = {f.name: f.dataType for f in obs.schema.fields}
    keys = [T.StructField("_us", T.LongType()), *[T.StructField(c, kinds[c]) for c in ties]]
    measures = [T.StructField(c, T.DoubleType()) for c in SERIES.values()]
    state = T.StructType([*keys, *measures])
    arrays = [T.StructField(f"_{c}", T.ArrayType(T.DoubleType())) for c in SERIES.values()]
    out = T.StructType([T.StructField(location, kinds[location]), *keys, *arrays])
    ahead = length + horizon
    rows = (
        obs.where(F.col(location).isNotNull() & F.col(time).isNotNull())
        .withWatermark(time, late)
        .select(location, time, F.unix_micros(time).alias("_us"), *ties, *[F.col(c).cast("double").alias(c) for c in SERIES.values()])
    )
    processor = _Windows(state, out, ahead, len(keys))
    found = rows.groupBy(location).transformWithState(processor, out, "Append", "EventTime")
    step = "named_struct(" + ", ".join(f"'{c}', _{c}[{{k}}]" for c in SERIES.values()) + ")"
    carried = [location, f"timestamp_micros(_us) AS {time}", *ties]
    steps = [f"{step.format(k=k)} AS _s{k}" for k in range(ahead)]
    return found.selectExpr(*carried, *steps).selectExpr(location, time, *ties, *features(length, horizon))
