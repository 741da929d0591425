"""Weather-shaped views of the test tables.

Everything is a projection or an equi-join over whole tables; arithmetic stays
in integers until the last step, so every engine sees the same doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocast.functions import labels
from stratocast.functions.render import prompt_time
from stratocast.operators import corpus as C
from stratocast.operators import scale
from stratocast.operators import sequences as S
from stratocast.schemas import BLOCK_ARRAYS
from stratocast.session import prepare

ORDER = ("datetime", "event_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scaled(expression: Column, divisor: int) -> Column:
    return expression.cast("double") / F.lit(float(divisor))


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per event; precipitation probability has gaps."""
    e = table(spark, sf_dir, "events")
    c = F.round(F.col("value") * 100).cast("bigint")
    i = F.col("event_id")
    return e.select(
        F.concat(F.lit("loc_"), F.col("user_id").cast("string")).alias("location_name"),
        F.col("ts").cast("timestamp").alias("datetime"),
        i,
        _scaled((i * 37 + c) % 460 - 80, 10).alias("temperature_c"),
        (F.lit(20) + (i * 13 + c) % 79).cast("double").alias("humidity_pct"),
        _scaled((i * 29 + c * 7) % 500, 10).alias("wind_speed_kph"),
        _scaled(F.lit(9850) + (i * 17 + c) % 500, 10).alias("pressure_hpa"),
        F.when(i % 17 != 0, _scaled((i * 11 + c * 3) % 101, 100)).alias("precipitation_probability"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with the null fill that the flat table applies."""
    return raw_observations(spark, sf_dir).withColumn(
        "precipitation_probability", F.coalesce(F.col("precipitation_probability"), F.lit(0.0))
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input arrays and horizon aggregates of every window."""
    return S.window_features(observations(spark, sf_dir), order=ORDER)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per window: persistence text against horizon text, with what was observed."""
    w = S.with_persistence_bulletin(S.with_bulletin(windows(spark, sf_dir), "reference_forecast"))
    return w.select(
        F.col("event_id").alias("sample_id"),
        F.col("location_name").alias("location"),
        prompt_time(F.col("datetime")).alias("datetime"),
        "generated_forecast",
        "reference_forecast",
        F.struct(
            (labels.steady(F.col("avg_precip")) >= 0.5).alias("rain"), F.round("avg_temp", 4).alias("temperature")
        ).alias("observed"),
        labels.temp_band((F.col("min_temp") + F.col("max_temp")) / 2, top="hot").alias("band"),
        F.when(F.col("max_wind") >= 28, "gusts").otherwise("winds").alias("wind_term"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records of every window, with the row identity sample_id."""
    w = S.with_bulletin(windows(spark, sf_dir)).withColumn("sample_id", F.col("event_id"))
    return C.training_records(w, keep=["sample_id"])


def split_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with its split, which needs the row identities only."""
    obs = observations(spark, sf_dir)
    ids = S.window_features(obs, order=ORDER).select(F.col("event_id").alias("sample_id"))
    key = scale.hash_key(42, "sample_id")
    cuts = scale.rank_cuts(ids, key, [0.8, 0.1])
    split = F.when(key <= cuts["c0"], "train").when(key <= cuts["c1"], "val").otherwise("test")
    return corpus(spark, sf_dir).withColumn("split", split)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed block per embedding; some labels stand for faulty landings."""
    e = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    label = F.col("label")

    def series(factor: float, shift: float) -> Column:
        values = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100) * factor + F.lit(shift))
        return F.when(label == 8, F.slice(values, 1, 60)).otherwise(values)

    start = F.lit(1_704_067_200) + v * 3600
    interval = F.lit(3600) * (1 + label % 3)
    span = (
        F.when(label == 9, F.lit(-3600))
        .when(label == 7, interval * 63 + 1800)
        .otherwise(interval * F.size("embedding"))
    )
    return e.select(
        F.struct(
            F.when(label != 6, F.concat(F.lit("stn_"), v.cast("string"))).alias("name"),
            (label * 7 - 30).cast("double").alias("latitude"),
            (v % 360 - 180).cast("double").alias("longitude"),
            F.lit(None).cast("double").alias("elevation"),
            F.lit(None).cast("string").alias("timezone"),
            F.lit(None).cast("string").alias("country"),
        ).alias("location"),
        F.timestamp_seconds(start).alias("start"),
        F.timestamp_seconds(start + span).alias("end"),
        interval.cast("bigint").alias("interval_s"),
        series(0.5, 10.0).alias("temperature_c"),
        series(0.25, 60.0).alias("humidity_pct"),
        series(0.5, 1010.0).alias("pressure_hpa"),
        series(0.125, 8.0).alias("wind_speed"),
        series(1.0, 180.0).alias("wind_direction_deg"),
        F.when(label == 5, F.lit(None)).otherwise(series(0.5, 50.0)).alias("precipitation_probability"),
        series(0.25, 5.0).alias("precipitation_mm"),
        series(0.5, 40.0).alias("cloud_cover_pct"),
    )


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 'current' row of every named block: five measures only."""
    b = blocks(spark, sf_dir).where(F.col("location.name").isNotNull())
    return b.select(
        "location",
        F.col("start").alias("datetime"),
        *[F.col(c)[0].alias(c) for c in BLOCK_ARRAYS[:5]],
    )


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn after it."""
    t = table(spark, sf_dir, "conversations")
    asked = t.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    said = t.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(said, ["conv_id", "turn"])


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one of the next id."""
    scan = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = scale.spread(scan, "doc_id")
    following = scan.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next_text"))
    return d.join(following, "doc_id")


def candidate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant turns of a conversation as candidates for one prompt."""
    t = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return t.select(F.col("conv_id").alias("prompt_id"), F.col("turn").alias("idx"), "text")


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "labels")
    return t.select(
        "doc_id", _scaled(F.col("doc_id") * 37 % 101, 100).alias("p"), F.col("quality").alias("outcome"), "toxic"
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as forecast requests: unknown places, missing fields and defaults included."""
    t = table(spark, sf_dir, "customer")
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")

    def number(n: Column) -> Column:
        return n.cast("string")

    payload = F.map_filter(
        F.create_map(
            F.lit("temperature"), number(k % 41),
            F.lit("humidity"), number(k % 97),
            F.lit("wind_speed"), F.when(segment != "MACHINERY", number(k % 53)),
            F.lit("pressure"), number(F.lit(980) + k % 60),
            F.lit("datetime"), F.when(segment != "BUILDING", F.lit("2024-05-01 06:00 UTC")),
            F.lit("precipitation_probability"), F.when(F.col("c_nationkey") != 3, number(k % 2)),
        ),
        lambda _, v: v.isNotNull(),
    )
    return t.select(
        k.alias("request_id"),
        F.concat(F.lit("loc_"), (k % 160).cast("string")).alias("name"),
        F.when(F.col("c_nationkey") != 7, (k % 90).cast("double")).alias("latitude"),
        (k % 180).cast("double").alias("longitude"),
        F.when(segment != "BUILDING", k % 12 + 1).cast("int").alias("forecast_horizon"),
        F.when(F.col("c_acctbal") <= 8000, F.col("c_acctbal") >= 0).alias("include_confidence"),
        F.when(F.col("c_nationkey") == 24, " New York ")
        .when(F.col("c_nationkey") == 5, F.concat(F.lit("Town "), (k % 7).cast("string")))
        .otherwise(F.concat(F.lit(" LOC_"), (k % 160).cast("string")))
        .alias("city"),
        F.when(segment != "AUTOMOBILE", payload).alias("weather_data"),
    )


def metric_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log call per event: run, step and a map of metrics."""
    e = table(spark, sf_dir, "events")
    i, v = F.col("event_id"), F.round(F.col("value"), 2)
    value = F.when(i % 101 == 0, F.lit(float("nan"))).when(i % 103 == 0, F.lit(float("inf"))).otherwise(v)
    return e.select(
        F.col("event_type").alias("run"),
        (i % 50).alias("step"),
        i.alias("event_id"),
        F.create_map(
            F.lit("loss"), value,
            F.lit("eval_loss"), v + 1.0,
            F.lit("eval_pre_eval_mae"), v + 2.0,
        ).alias("logs"),
    )


def attempted_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    error = (
        F.when(i % 97 == 0, "CUDA error: device-side assert triggered")
        .when(i % 31 == 0, "shape mismatch")
        .when(F.col("event_type") == "error", "value is NaN")
    )
    return e.select(F.col("event_type").alias("run"), i.alias("step"), error.alias("error"))


def quality_cases(p: DataFrame) -> DataFrame:
    """Every prediction as a quality case of its horizon text."""
    return p.select(
        F.col("sample_id").cast("string").alias("id"),
        "location",
        F.lit("Weather data").alias("input"),
        "reference_forecast",
        F.array(F.col("band"), F.lit("Conditions"), F.col("wind_term")).alias("required_terms"),
        F.array(F.lit(r"\|"), F.lit(r"generate a forecast"), F.lit(r"GUSTS near 4[5-9]")).alias("forbidden_patterns"),
        F.col("observed").alias("observed_weather"),
    )


def prediction_records(p: DataFrame) -> DataFrame:
    """Two list entries per prediction; empty texts and duplicates included."""
    cloudy = F.col("generated_forecast").startswith("Cloudy")
    none = F.lit(None).cast("string")
    first = F.struct(
        (F.col("sample_id") * 2).alias("position"),
        F.when(cloudy, F.lit("")).otherwise(F.col("generated_forecast")).alias("generated_forecast"),
        none.alias("forecast"),
    )
    second = F.struct(
        (F.col("sample_id") * 2 + 1).alias("position"),
        F.lit("").alias("generated_forecast"),
        F.when(F.col("wind_term") == "gusts", F.col("reference_forecast")).otherwise("").alias("forecast"),
    )
    return p.select(F.col("sample_id").alias("id"), F.explode(F.array(first, second)).alias("r")).select("id", "r.*")
