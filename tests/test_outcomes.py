"""Outcomes of forecasts: range index and streams against brute force."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from stratocast.operators import outcomes, ranges

T0 = dt.datetime(2024, 3, 1)
OBS = "location_name string, datetime timestamp, temperature_c double, precipitation_probability double"
MADE = "id bigint, location_name string, generated_at timestamp, valid_until timestamp"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def weather(n, seed, places="hhhhhhhhab"):
    """Observations of one hot and two other places, many at equal times, with gaps."""
    rng = random.Random(seed)
    gaps = [None, float("nan")]
    return [
        (rng.choice(places), at(rng.randrange(n)), rng.choice([*gaps, *[rng.randrange(-80, 380) / 10] * 6]), rng.choice([*gaps, *[rng.randrange(101) / 100] * 6]))
        for _ in range(n)
    ]


def made(n, seed, longest=None, span=None, places="hhhhhhhhabc"):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = rng.randrange(span or n)
        rows.append((i, rng.choice(places), at(g), at(g + rng.randrange(longest or n))))
    return rows


def plain(forecasts, obs):
    out = {}
    for key, place, since, until in forecasts:
        inside = [o for o in obs if place is not None and since and until and o[0] == place and o[1] is not None and since < o[1] <= until]
        ts = [o[2] for o in inside if o[2] is not None and not math.isnan(o[2])]
        ps = [o[3] for o in inside if o[3] is not None and not math.isnan(o[3])]
        out[key] = (max(ps) >= 0.5 if ps else None, round(sum(ts) / len(ts), 9) if ts else None)
    return out


def verdicts(df):
    rows = [(r["id"], r["observed"]) for r in df.collect()]
    return {i: (o["rain"], None if o["temperature"] is None else round(o["temperature"], 9)) for i, o in rows}


@pytest.mark.parametrize("run", [4, 256])
def test_ranges_equal_brute_force(spark, run, monkeypatch):
    """Several levels of the index, ranges of any length, one place with most of the rows."""
    obs = weather(400, 1) + [("h", at(50), 1.0, 0.2)] * 40
    asked = made(200, 2) + [(1000 + i, "h", at(10), at(390)) for i in range(50)]
    asked += [(2000, None, at(1), at(9)), (2001, "h", None, at(9)), (2002, "h", at(9), None), (2003, "h", at(9), at(9)), (2004, "h", at(9), at(3))]
    dirty = obs + [(None, at(3), 1.0, 1.0), ("h", None, 1.0, 1.0)]
    monkeypatch.setattr(ranges.range_summary, "__defaults__", (run,))
    frames = spark.createDataFrame(asked, MADE).repartition(3), spark.createDataFrame(dirty, OBS).repartition(3)
    assert verdicts(outcomes.verify_outcomes(*frames, "id")) == plain(asked, obs)
    none = spark.createDataFrame([], OBS)
    assert set(verdicts(outcomes.verify_outcomes(frames[0], none, "id")).values()) == {(None, None)}
    with pytest.raises(ValueError):
        ranges.range_summary(frames[0], frames[1], run=6)


def test_hot_station_over_everything(spark):
    """Each of many forecasts covers most observations of one station: 9 million pairs, none of which is a row."""
    n = 3000
    minute = F.timestamp_seconds(F.col("id") * 60)
    obs = spark.range(n).select(F.lit("h").alias("location_name"), minute.alias("datetime"), (F.col("id") * 1.0).alias("temperature_c"), (F.col("id") / n).alias("precipitation_probability"))
    asked = spark.range(n).select("id", F.lit("h").alias("location_name"), F.timestamp_seconds(F.col("id")).alias("generated_at"), F.timestamp_seconds(F.col("id") + 60 * (n - 100)).alias("valid_until"))
    got = verdicts(outcomes.verify_outcomes(asked, obs, "id"))
    for i, (rain, mean) in got.items():
        first, last = i // 60 + 1, min(n - 1, (i + 60 * (n - 100)) // 60)
        assert rain and mean == round((first + last) / 2, 9)
