"""Streams against their batch forms: joins of two streams, keyed state with timers, exactly-once sinks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stratocast.operators import outcomes, sequences
from stratocast.plans import extensions
from stratocast.streaming import sinks, windows
from stratocast.streaming.outcomes import verify_stream
from tests.test_outcomes import MADE, OBS, T0, at, made, verdicts, weather


def land(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def rounds(rows, time, n, seed, late=40):
    """`rows` in n parts in order of time, each row up to `late` minutes late."""
    rng = random.Random(seed)
    by = sorted(rows, key=lambda r: time(r) + dt.timedelta(minutes=rng.randrange(late)))
    return [by[i * len(by) // n : (i + 1) * len(by) // n] for i in range(n)]


@pytest.fixture(scope="module")
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_verified_stream_equals_batch(spark, tmp_path, few_partitions):
    """Late rows, restarts between rounds, forecasts without any observation; rows after the end close everything."""
    obs = weather(300, 3)
    asked = made(120, 4, longest=180, span=300)
    closing = [(10_000 + i, "end", at(5000 + 500 * i), at(5001 + 500 * i)) for i in range(2)]
    parts = zip(rounds(asked, lambda r: r[2], 2, 5), rounds(obs, lambda r: r[1], 2, 6), strict=True)

    def run():
        found = verify_stream(stream(spark, MADE, tmp_path / "made"), stream(spark, OBS, tmp_path / "obs"), "id", longest="3 hours", late="1 hour")
        sinks.start_exactly_once(found, str(tmp_path / "out"), "verified", str(tmp_path / "state")).awaitTermination()
        return found.schema

    for some_made, some_obs in parts:
        land(spark, some_made, MADE, tmp_path / "made")
        land(spark, some_obs, OBS, tmp_path / "obs")
        schema = run()
    for row in closing:
        land(spark, [row], MADE, tmp_path / "made")
        land(spark, [("end", row[2], 1.0, 0.1)], OBS, tmp_path / "obs")
    run()
    got = sinks.read_batches(spark, str(tmp_path / "out"), schema).where("id < 10000")
    frames = spark.createDataFrame(asked, MADE).where("generated_at < valid_until"), spark.createDataFrame(obs, OBS)
    assert verdicts(got) == verdicts(outcomes.verify_outcomes(*frames, "id")) and got.count() == frames[0].count()
    assert got.select("batch").distinct().count() > 1


def test_forecast_beyond_the_longest_fails(spark, tmp_path, few_partitions):
    land(spark, [(1, "h", at(0), at(999))], MADE, tmp_path / "made")
    land(spark, weather(5, 1), OBS, tmp_path / "obs")
    found = verify_stream(stream(spark, MADE, tmp_path / "made"), stream(spark, OBS, tmp_path / "obs"), "id", longest="3 hours")
    with pytest.raises(Exception, match="further than 3 hours"):
        sinks.start_exactly_once(found, str(tmp_path / "out"), "v", str(tmp_path / "state")).awaitTermination()


FULL = OBS + ", humidity_pct double, wind_speed_kph double, pressure_hpa double, tie int"


def test_stream_windows_equal_batch(spark, tmp_path, few_partitions):
    """Rows out of order and at equal times, NULL and NaN measures, restarts; each window comes once."""
    windows.with_rocksdb(spark)
    rng = random.Random(9)
    nan = float("nan")
    rows = [(*o, rng.choice([None, nan, 50.0, 61.0]), rng.choice([None, 3.0, 9.5]), 1000.0 + i, i) for i, o in enumerate(weather(150, 8, "hhhhab"))]
    asked = {"length": 2, "horizon": 3, "order": ("datetime", "tie")}

    def run():
        found = windows.stream_windows(stream(spark, FULL, tmp_path / "in"), late="1 hour", **asked)
        sinks.start_exactly_once(found, str(tmp_path / "out"), "w", str(tmp_path / "state")).awaitTermination()
        return found.schema

    for some in rounds(rows, lambda r: r[1], 3, 10):
        land(spark, some, FULL, tmp_path / "in")
        schema = run()
    too_late = ("h", at(0), 1.0, 1.0, 1.0, 1.0, 1.0, 999)  # far behind the watermark by now
    land(spark, [too_late, (None, at(400), 1.0, 1.0, 1.0, 1.0, 1.0, 7), ("h", None, 1.0, 1.0, 1.0, 1.0, 1.0, 8)], FULL, tmp_path / "in")
    run()
    for minutes in (9000, 9500):
        land(spark, [("end", T0 + dt.timedelta(minutes=minutes), 1.0, 1.0, 1.0, 1.0, 1.0, 0)], FULL, tmp_path / "in")
    run()
    got = sinks.read_batches(spark, str(tmp_path / "out"), schema).drop("batch")
    want = sequences.window_features(spark.createDataFrame(rows, FULL), **asked).select(got.columns)
    assert want.count() > 100 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_sink_survives_a_death_after_the_write(spark, tmp_path):
    """A run that dies between the write and the commit, and a write that dies half way, leave each row once."""
    schema = "id bigint, day string"
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    for k in range(3):
        land(spark, [(10 * k + i, f"d{i % 2}") for i in range(5)], schema, source)

    def run(also=None):
        start = sinks.start_exactly_once(stream(spark, schema, source), out, "s", state, partition_by=("day",), also=also)
        start.awaitTermination()

    def dies(df, batch):
        if batch == 1:
            raise RuntimeError("killed after the write")

    for _ in range(2):
        with pytest.raises(Exception, match="killed after the write"):
            run(dies)
        done = {p.name for p in (tmp_path / "out").iterdir()}
        assert {"batch=0", "batch=1"} <= done
    # What a half-written batch leaves: a stray file in its folder.
    stray = next((tmp_path / "out" / "batch=1" / "day=d0").glob("*.parquet"))
    (tmp_path / "out" / "batch=2" / "day=d0").mkdir(parents=True)
    (tmp_path / "out" / "batch=2" / "day=d0" / "part-00000-dead.parquet").write_bytes(stray.read_bytes())
    run()
    run()
    rows = sinks.read_batches(spark, out, spark.createDataFrame([], schema).schema)
    assert sorted(r["id"] for r in rows.collect()) == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14, 20, 21, 22, 23, 24]
    assert rows.groupBy("batch").agg(F.count("id").alias("n")).where("n <> 5").isEmpty()


def test_slices_land_in_order_and_bound_the_state(spark, tmp_path, few_partitions):
    """One file a trigger, in order of time: state is kept for some slices and not for the table; no row is late or lost."""
    n = 3000
    seen = spark.createDataFrame(weather(n, 5, "habc"), OBS).withColumn("event_id", F.lit(0).cast("bigint"))
    asked = spark.createDataFrame([*made(n, 6, longest=60), (9_000, "h", None, at(9))], MADE).withColumnRenamed("id", "event_id")
    cuts = extensions._slices(asked, "generated_at", 300)
    assert len(cuts) == 10
    streams = extensions._arriving(asked, cuts, "generated_at", valid_until="1 MINUTE"), extensions._arriving(seen, cuts, "datetime")
    found = verify_stream(*streams, "event_id", longest="1 hour")
    query = sinks.start_exactly_once(found, str(tmp_path / "out"), "v", str(tmp_path / "state"))
    query.awaitTermination()
    progress = [p["stateOperators"] for p in query.recentProgress]
    held = max(sum(o["numRowsTotal"] for o in operators) for operators in progress)
    assert held < n and sum(o["numRowsDroppedByWatermark"] for operators in progress for o in operators) == 0
    got = sinks.read_batches(spark, str(tmp_path / "out"), found.schema).where("event_id >= 0").withColumnRenamed("event_id", "id")
    want = outcomes.verify_outcomes(asked.where("generated_at < valid_until"), seen, "event_id").withColumnRenamed("event_id", "id")
    assert verdicts(got) == verdicts(want) and got.count() == want.count()
