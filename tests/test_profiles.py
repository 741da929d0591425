"""Stored profiles of days: merged figures against all rows."""

from pyspark.sql import functions as F

from stratocast.operators import profiles


def test_merged_days_equal_all_rows(spark, tmp_path):
    path = str(tmp_path / "profiles")
    nan = F.lit(float("nan"))
    obs = spark.range(20_000).select(
        F.concat(F.lit("l"), F.col("id") % 1500).alias("location_name"),
        F.when(F.col("id") % 997 != 0, F.timestamp_seconds(F.col("id") * 60)).alias("datetime"),
        F.when(F.col("id") % 7 == 0, nan).when(F.col("id") % 5 != 0, (F.col("id") * 7919 % 1000) / 10).alias("temperature_c"),
        F.lit(None).cast("double").alias("humidity_pct"),
    )
    measures = ("temperature_c", "humidity_pct")
    early = F.col("datetime") < "1970-01-08"
    profiles.store_profiles(obs.where(early), path, measures=measures)
    profiles.store_profiles(obs.where(~early | early.isNull()), path, measures=measures)
    profiles.store_profiles(obs.where(early), path, measures=measures)  # a replay replaces its days
    stored = profiles.read_profiles(spark, path)
    r = profiles.merge_profiles(stored).first()
    rows = [x["temperature_c"] for x in obs.collect()]
    known = sorted(x for x in rows if x is not None and x == x)
    assert (r["records"], r["temperature_c_n"], r["humidity_pct_n"]) == (20_000, len(known), 0)
    assert abs(r["temperature_c_mean"] - sum(known) / len(known)) < 1e-9
    assert (r["temperature_c_low"], r["temperature_c_high"]) == (known[0], known[-1])
    assert r["humidity_pct_mean"] is None and r["humidity_pct_median"] is None
    assert abs(r["locations"] - 1500) < 75
    for q, share in profiles.QUARTILES.items():
        below = sum(x < r[f"temperature_c_{q}"] for x in known) / len(known)
        upto = sum(x <= r[f"temperature_c_{q}"] for x in known) / len(known)
        assert below - 0.03 <= share <= upto + 0.03
    weeks = profiles.merge_profiles(stored, [F.date_trunc("week", "day").alias("week")])
    assert weeks.agg(F.sum("records")).first()[0] == 20_000 and weeks.count() == stored.select(F.date_trunc("week", "day")).distinct().count()
    assert profiles.daily_profiles(obs.where("false"), measures).count() == 0
