"""Sliding input windows and horizon aggregates per location."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratocast.functions import labels
from stratocast.functions.render import prompt_time, render_prompt
from stratocast.operators.scale import heavy_keys
from stratocast.storage import stored

# Sequence column -> observation column.
SERIES = {
    "temperature": "temperature_c",
    "humidity": "humidity_pct",
    "wind_speed": "wind_speed_kph",
    "pressure": "pressure_hpa",
    "precipitation_probability": "precipitation_probability",
}
HORIZON = ["avg_temp", "max_temp", "min_temp", "avg_humidity", "max_wind", "avg_precip"]

# A location above HOT_ROWS rows is cut into chunks of CHUNK_ROWS starts.
HOT_ROWS = 2_000_000
CHUNK_ROWS = 500_000


def _future(column: str, length: int, horizon: int) -> list[str]:
    # Means and extremes skip NaN as they skip NULL.
    return [f"nanvl(_s{k}.{column}, NULL)" for k in range(length, length + horizon)]


def _mean(values: list[str]) -> str:
    total = " + ".join(f"coalesce({v}, 0D)" for v in values)
    n = " + ".join(f"int({v} IS NOT NULL)" for v in values)
    return f"({total}) / nullif({n}, 0)"


def _extreme(values: list[str], pick: str) -> str:
    return f"{pick}({', '.join(values)})" if len(values) > 1 else values[0]


def features(length: int, horizon: int) -> list[str]:
    """Input arrays and horizon aggregates from the structs _s0, _s1, ... of length + horizon consecutive rows."""
    temp, humidity, wind, precip = (
        _future(c, length, horizon)
        for c in ("temperature_c", "humidity_pct", "wind_speed_kph", "precipitation_probability")
    )
    return [
        *["array(" + ", ".join(f"_s{k}.{column}" for k in range(length)) + f") AS {name}" for name, column in SERIES.items()],
        f"{_mean(temp)} AS avg_temp",
        f"{_extreme(temp, 'greatest')} AS max_temp",
        f"{_extreme(temp, 'least')} AS min_temp",
        f"{_mean(humidity)} AS avg_humidity",
        f"{_extreme(wind, 'greatest')} AS max_wind",
        f"{_mean(precip)} AS avg_precip",
    ]


def _windows(rows: DataFrame, partition: str, order: str, length: int, horizon: int, keep: str = "true") -> DataFrame:
    """Every start with its input arrays and horizon aggregates.

    All look-aheads are offsets in one window, so the rows are shuffled and
    sorted once and no frame is re-aggregated per row. A start needs
    length + horizon rows *after* it, which leaves out the last full window on
    purpose.
    """
    step = "named_struct(" + ", ".join(f"'{c}', {c}" for c in SERIES.values()) + ")"
    ahead = length + horizon
    over = f"OVER (PARTITION BY {partition} ORDER BY {order})"
    steps = [f"{step} AS _s0", *[f"lead({step}, {k}) {over} AS _s{k}" for k in range(1, ahead)]]
    carried = [c for c in rows.columns if c not in SERIES.values() and not c.startswith("_")]
    helpers = [c for c in ("_member", "_chunk") if c in rows.columns]
    return (
        rows.selectExpr(*carried, *helpers, *steps, f"lead(true, {ahead}) {over} AS _complete")
        .where(f"_complete AND {keep}")
        .selectExpr(*carried, *features(length, horizon))
    )


def window_features(
    obs: DataFrame,
    length: int = 4,
    horizon: int = 6,
    location: str = "location_name",
    order: Sequence[str] = ("datetime",),
    hot_rows: int | None = HOT_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per window start: input arrays plus aggregates over the horizon.

    `order` must be a total order inside a location: its first column is the
    time, further columns break ties. Rows without location or time are left
    out. Locations above `hot_rows` rows are processed in chunks that carry
    the next length + horizon rows, so a hot location spreads over many tasks;
    rows are counted by location first, which hot_rows=None saves.
    """
    time = order[0]
    rows = obs.where(F.col(location).isNotNull() & F.col(time).isNotNull()).select(
        location, *order, *SERIES.values()
    )
    by_time = ", ".join(order)
    if hot_rows is None:
        return _windows(rows, location, by_time, length, horizon)

    counts = heavy_keys(rows, location, hot_rows)
    found = counts.collect()  # HEAVY_LIMIT rows at most
    if not found:
        return _windows(rows, location, by_time, length, horizon)
    chunk_rows = max(chunk_rows, length + horizon)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, counts.schema).select(F.col(location).alias("_hot")))
    on_hot = F.col(location) == F.col("_hot")
    cold = _windows(rows.join(hot, on_hot, "left_anti"), location, by_time, length, horizon)
    chunked = _chunk(rows.join(hot, on_hot, "left_semi"), length + horizon, location, order, chunk_rows)
    warm = _windows(chunked, f"{location}, _member", "_position", length, horizon, keep="_member = _chunk")
    return cold.unionByName(warm)


def placed(rows: DataFrame, location: str, order: Sequence[str]) -> DataFrame:
    """`rows` with _position, the exact place of each within its location.

    Rows are dealt to partitions by range of (location, *order), so neither an
    outlying time nor equal times can put a location into one task. A row's
    position is its place in its partition, shifted by the counts of the
    location's partitions before.
    """
    keys = [F.col(location), *[F.col(c) for c in order]]
    dealt = stored(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)  # the upper bits are the partition, the lower ones the place in it
    earlier = W.partitionBy(location).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = (
        dealt.groupBy(location, part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    return (
        dealt.withColumn("_part", part)
        .join(parts, [location, "_part"])
        .withColumn("_position", F.col("_before") + F.col("_at") - F.col("_first"))
        .drop("_at", "_part", "_first", "_before")
    )


def _chunk(rows: DataFrame, halo: int, location: str, order: Sequence[str], chunk_rows: int) -> DataFrame:
    """Rows of hot locations with their position, copied into every chunk that reads them."""
    chunk = F.floor(F.col("_position") / F.lit(chunk_rows))
    shared = (F.col("_position") % chunk_rows < halo) & (F.col("_chunk") > 0)
    members = F.when(shared, F.array(F.col("_chunk") - 1, F.col("_chunk"))).otherwise(F.array(F.col("_chunk")))
    return placed(rows, location, order).withColumn("_chunk", chunk).withColumn("_member", F.explode(members))


def sliding_sequences(obs: DataFrame, length: int = 4, horizon: int = 6, **options) -> DataFrame:
    """The five input arrays of every window start."""
    return window_features(obs, length, horizon, **options).drop(*HORIZON)


def horizon_aggregates(obs: DataFrame, length: int = 4, horizon: int = 6, **options) -> DataFrame:
    """Mean, max and min over the rows each window has to forecast."""
    return window_features(obs, length, horizon, **options).drop(*SERIES)


def first_l_per_location(
    obs: DataFrame,
    n: int = 4,
    location: str = "location_name",
    order: Sequence[str] = ("datetime",),
    descending: bool = False,
) -> DataFrame:
    """The first `n` rows of every location as arrays, the model input at serving time.

    Rows without a time are left out, as in windows; a missing precipitation
    probability is 0.

    The row limit is applied before the shuffle as well, so a hot location
    sends at most `n` rows per task.
    """
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    step = F.struct(F.col("_rn"), *[F.col(c) for c in SERIES.values()], F.col(order[0]).alias("_time"))
    steps = F.array_sort(F.collect_list(step))
    served = {c: F.col(c) for c in SERIES.values()}
    served["precipitation_probability"] = F.coalesce("precipitation_probability", F.lit(0.0))
    picked = (
        obs.where(F.col(location).isNotNull() & F.col(order[0]).isNotNull())
        .withColumns(served)
        .withColumn("_rn", F.row_number().over(W.partitionBy(location).orderBy(*keys)))
        .where(F.col("_rn") <= n)
        .groupBy(location)
        .agg(steps.alias("_steps"))
    )
    return picked.select(
        location,
        F.col("_steps")[0]["_time"].alias(order[0]),
        *[F.col("_steps")[column].alias(name) for name, column in SERIES.items()],
    )


def with_prompt(seq: DataFrame, location: str = "location_name", time: str = "datetime", name: str = "prompt"):
    """Add the rendered prompt; `time` may be a timestamp or text."""
    when = F.col(time) if dict(seq.dtypes)[time] == "string" else prompt_time(F.col(time))
    return seq.withColumn(name, render_prompt(F.col(location), when, *[F.col(c) for c in SERIES]))


def with_templated_bulletin(
    seq: DataFrame, location: str = "location_name", order: Sequence[str] = ("datetime",), seed: int = 42,
    name: str = "target",
) -> DataFrame:
    """Add the templated bulletin of the horizon."""
    identity = [
        F.col(c).cast("string") if t != "timestamp" else F.unix_micros(F.col(c)).cast("string")
        for c, t in seq.dtypes
        if c == location or c in order
    ]
    horizon = {c: F.col(c) for c in HORIZON}
    parts = {f"_{k}": v for k, v in labels.bulletin_parts(**horizon, identity=identity, seed=seed).items()}
    text = labels.templated_bulletin({k[1:]: F.col(k) for k in parts})
    return seq.withColumns(parts).withColumn(name, text).drop(*parts)


def with_bulletin(seq: DataFrame, name: str = "target") -> DataFrame:
    """Add the deterministic bulletin of the horizon."""
    return seq.withColumn(
        name,
        labels.deterministic_bulletin(
            F.col("min_temp"), F.col("max_temp"), F.col("avg_humidity"), F.col("max_wind"), F.col("avg_precip")
        ),
    )


def with_persistence_bulletin(seq: DataFrame, name: str = "generated_forecast") -> DataFrame:
    """Add the bulletin of the input rows: the forecast that nothing changes."""

    def kept(column: str) -> Column:
        return F.filter(F.col(column), lambda v: v.isNotNull() & ~F.isnan(v))

    def mean(column: str) -> Column:
        total = F.aggregate(kept(column), F.lit(0.0), lambda a, v: a + v)
        return total / F.nullif(F.size(kept(column)), F.lit(0))

    inputs = {
        "_low": F.array_min(kept("temperature")),
        "_high": F.array_max(kept("temperature")),
        "_damp": mean("humidity"),
        "_gust": F.array_max(kept("wind_speed")),
        "_wet": mean("precipitation_probability"),
    }
    text = labels.deterministic_bulletin(*[F.col(c) for c in inputs])
    return seq.withColumns(inputs).withColumn(name, text).drop(*inputs)
