"""Queries on outcomes, gaps in the data and round trips through files, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratocast.functions import extract, stemming, text
from stratocast.operators import evaluate, inference, outcomes, profiles, rewards, scale
from stratocast.operators import sequences as seq
from stratocast.plans import oracle as O
from stratocast.plans import views as V
from stratocast.plans.catalog import query, rounded
from stratocast.sources import files
from stratocast.storage import new_path
from stratocast.streaming import outcomes as stream_outcomes
from stratocast.streaming import sinks
from stratocast.streaming import windows as stream_state

NBSP = "\u00a0"
SLICE_ROWS = 500_000  # rows of one file of a stream, which is what a trigger of `verify_stream` takes


def gappy_observations(spark: SparkSession, sf: str) -> DataFrame:
    """Observations with missing and NaN measures, impossible values, and rows without a time."""
    i = F.col("event_id")
    none = F.lit(None).cast("double")
    nan = F.lit(float("nan"))
    return V.raw_observations(spark, sf).withColumns(
        {
            "datetime": F.when(i % 41 != 0, F.col("datetime")),
            "temperature_c": F.when(i % 7 == 0, none).when(i % 11 == 0, nan).when(i % 97 == 0, 1000.0).otherwise(F.col("temperature_c")),
            "humidity_pct": F.when(i % 5 == 0, none).when(i % 89 == 0, 150.0).otherwise(F.col("humidity_pct")),
            "pressure_hpa": F.when(i % 3 == 0, nan).when(i % 83 == 0, -100.0).otherwise(F.col("pressure_hpa")),
        }
    )


def forecasts_made(spark: SparkSession, sf: str) -> DataFrame:
    """A forecast at every observation, for 1 to 12 hours."""
    obs = V.observations(spark, sf)
    until = F.timestamp_micros(F.unix_micros("datetime") + (F.col("event_id") % 12 + 1) * 3_600_000_000)
    return obs.select("event_id", "location_name", F.col("datetime").alias("generated_at"), until.alias("valid_until"))


@query
def verify_outcomes(spark, sf):
    seen = outcomes.verify_outcomes(forecasts_made(spark, sf), V.observations(spark, sf), "event_id")
    return rounded(seen.select("event_id", "observed.rain", "observed.temperature"))


@query
def reliability_bins(spark, sf):
    return rounded(outcomes.reliability_bins(V.probabilities(spark, sf), "p", "outcome", ["toxic"]))


@query
def brier_decomposition(spark, sf):
    return rounded(outcomes.brier_decomposition(V.probabilities(spark, sf), "p", "outcome", ["toxic"]))


@query
def band_counts(spark, sf):
    return outcomes.band_counts(gappy_observations(spark, sf))


@query
def range_violations(spark, sf):
    return outcomes.range_violations(gappy_observations(spark, sf))


@query
def tolerance_accuracy(spark, sf):
    p = V.predictions(spark, sf).withColumns(
        {"_g": extract.extract_conditions(F.col("generated_forecast")), "_r": extract.extract_conditions(F.col("reference_forecast"))}
    )
    return rounded(outcomes.tolerance_accuracy(p, F.col("_g"), F.col("_r"), ["band"]))


@query
def compare_runs(spark, sf):
    logs = V.metric_maps(spark, sf).select("run", F.explode("logs").alias("key", "value"))
    return rounded(outcomes.compare_runs(logs, "click", "view"))


@query
def weekly_drift(spark, sf):
    scored = rewards.composite_reward(V.predictions(spark, sf), "generated_forecast", "observed")
    time = F.to_timestamp("datetime", "yyyy-MM-dd HH:mm 'UTC'")
    drift = outcomes.weekly_drift(scored, time, ["accuracy_reward", "style_reward", "calibration_reward"])
    return rounded(drift)


@query
def windowed_observations(spark, sf):
    return rounded(outcomes.windowed_observations(V.observations(spark, sf)))


def _gappy_windows(spark: SparkSession, sf: str) -> DataFrame:
    return seq.window_features(gappy_observations(spark, sf), order=V.ORDER)


@query
def render_prompt_gaps(spark, sf):
    return seq.with_prompt(_gappy_windows(spark, sf)).select("event_id", "prompt")


@query
def bulletin_gaps(spark, sf):
    return seq.with_bulletin(_gappy_windows(spark, sf)).select("event_id", "target")


@query
def first_l_gaps(spark, sf):
    return seq.with_prompt(seq.first_l_per_location(gappy_observations(spark, sf), 4, order=V.ORDER)).select(
        "location_name", "prompt"
    )


@query
def extract_conditions_nbsp(spark, sf):
    w = seq.with_bulletin(V.windows(spark, sf)).withColumn("target", F.replace(F.col("target"), F.lit(" "), F.lit(NBSP)))
    c = extract.extract_conditions(F.col("target"))
    return w.withColumn("_c", c).select(
        "event_id", "_c.rain", F.col("_c.temperature_range.lo").alias("lo"), F.col("_c.temperature_range.hi").alias("hi"), "_c.wind_speed"
    )


@query
def normalize_prediction_maps(spark, sf):
    p = V.predictions(spark, sf)
    row = F.col("sample_id").cast("string")
    text = F.concat(F.lit('{"'), row, F.lit('":"first","n'), row, F.lit('":null,"'), row, F.lit('":"'), F.col("band"), F.lit('"}'))
    maps = p.select(F.from_json(text, "map<string,string>").alias("predictions"))
    # Ids are unique across the maps, so each map's last entry is the id's last.
    return files.normalize_prediction_maps(maps)


@query
def observations_round_trip(spark, sf):
    path = new_path(spark) + ".parquet"
    obs = V.observations(spark, sf).withColumns(
        {c: F.lit(None).cast("double") for c in ("latitude", "longitude", "wind_direction_deg", "precipitation_mm", "cloud_cover_pct", "visibility_km")}
    )
    files.write_observations(obs.withColumn("weather_code", F.lit(None).cast("int")), path)
    return rounded(files.read_observations(spark, path).select("location_name", "datetime", "temperature_c", "humidity_pct"))


@query
def dataset_round_trip(spark, sf):
    path = new_path(spark) + ".jsonl"
    files.write_dataset(V.corpus(spark, sf).drop("sample_id"), path)
    return files.read_dataset(spark, path).groupBy("location").agg(
        F.count(F.lit(1)).alias("rows"), F.max("input").alias("last_input"), F.min("target").alias("first_target")
    )


@query
def evaluate_pinned(spark, sf):
    """The evaluation with BLEU-4 and the library's ROUGE."""
    return rounded(evaluate.evaluate(V.predictions(spark, sf), by=["band"], bleu="bleu4", rouge="library"))


@query
def bootstrap_interval(spark, sf):
    """The overall score with its resampled interval."""
    p = V.predictions(spark, sf)
    return rounded(inference.evaluate_with_bootstrap(p, "sample_id", ["band"]).select("band", "predictions", "overall_score", "bootstrap_low", "bootstrap_high"))


@query
def calibration_curve(spark, sf):
    return rounded(inference.calibration_curve(V.probabilities(spark, sf), "p", "outcome", ["toxic"]))


@query
def paired_significance(spark, sf):
    """Do the two texts of a prediction earn different rewards?"""
    p = V.predictions(spark, sf)
    both = [
        rewards.composite_reward(p, text, "observed").select("sample_id", "band", F.col("total_reward").alias(name))
        for text, name in (("generated_forecast", "one"), ("reference_forecast", "two"))
    ]
    pairs = both[0].join(both[1].drop("band"), "sample_id")
    return rounded(inference.sign_flip_test(pairs, "one", "two", "sample_id", ["band"]))


@query
def change_points(spark, sf):
    """Levels of the daily mean temperature of each group of stations."""
    obs = V.observations(spark, sf).withColumns({"station_group": F.substring("location_name", -1, 1), "day": F.to_date("datetime")})
    days = obs.groupBy("station_group", "day").agg(F.avg("temperature_c").alias("mean"))
    found = inference.change_points(days, "mean", "day", ["station_group"], slack=0.25, limit=2.0)
    dates = {c: F.date_format(c, "yyyy-MM-dd") for c in ("day", "up_since", "down_since")}
    return rounded(found.withColumns(dates))


@query
def token_stems(spark, sf):
    """Every different token of the documents with its stem."""
    d = scale.spread(V.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    tokens = d.select(F.explode(text.rouge_tokens(F.col("text"))).alias("token"))
    return stemming.with_stem(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("uses")), "token")


@query
def evaluate_stemmed(spark, sf):
    """The evaluation as the pinned environment does it: BLEU-4, and ROUGE over stems."""
    p = V.predictions(spark, sf)
    return rounded(evaluate.evaluate(p, by=["band"], bleu="bleu4", rouge="stemmed", identity=["sample_id"]))


@query
def merged_profile(spark, sf):
    """Profiles of days, stored and merged: exact figures, and whether the sketched ones lie within their error."""
    obs = gappy_observations(spark, sf)
    path = new_path(spark)
    profiles.store_profiles(obs, path)
    merged = profiles.merge_profiles(profiles.read_profiles(spark, path))
    c = "temperature_c"
    t, clean = F.nanvl(c, F.lit(None)), ["records", "first_datetime", "last_datetime", f"{c}_n", f"{c}_mean", f"{c}_low", f"{c}_high"]
    below = {q: F.col(f"{c}_{q}") for q in profiles.QUARTILES}
    both = obs.crossJoin(merged.select(*clean, F.col("locations").alias("_guess"), *[v.alias(f"_{q}") for q, v in below.items()]))  # one row
    ranks = [F.abs(F.avg(F.when(t.isNotNull(), (t < F.col(f"_{q}")).cast("double"))) - share) for q, share in profiles.QUARTILES.items()]
    ties = [F.avg(F.when(t.isNotNull(), (t == F.col(f"_{q}")).cast("double"))) for q in profiles.QUARTILES]
    close = [r <= 0.03 + e for r, e in zip(ranks, ties)]
    exact = F.count_distinct("location_name")
    checked = both.groupBy(*clean).agg(
        (F.abs(F.first("_guess") - exact) <= F.ceil(exact * 0.05)).alias("locations_close"), (close[0] & close[1] & close[2]).alias("quartiles_close")
    )
    return rounded(checked)


def _closed(df: DataFrame, path: str, time: str, **later: str) -> DataFrame:
    """The rows of `df` written as a stream's files, with two rows at a place of their own that end the stream.

    `later`: other times of these rows, as an interval from `time`.
    """
    df.write.parquet(path)
    _end(df, path, time, **later)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def _end(df: DataFrame, path: str, time: str, **later: str) -> None:
    """Land the two rows that end a stream, one file each."""
    for days in (30, 60):
        end = F.max(time) + F.expr(f"INTERVAL {days} DAYS")
        filled = {time: end, "location_name": F.lit("end of stream"), "event_id": F.lit(-days)}
        filled |= {c: end + F.expr(f"INTERVAL {span}") for c, span in later.items()}
        row = df.agg(*[filled.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
        row.write.mode("append").parquet(path)


def _slices(df: DataFrame, time: str, rows: int = SLICE_ROWS) -> list[int]:
    """Times (in microseconds) that cut `df` into stretches of about `rows` rows; the rows of one time stay together."""
    n = -(-df.count() // rows)
    if n < 2:
        return []
    shares = [i / n for i in range(1, n)]
    found = df.select(F.percentile_approx(F.unix_micros(time), shares, 100 * n)).first()[0]
    return sorted(set(found or []))


def _arriving(df: DataFrame, cuts: list[int], time: str, **later: str) -> DataFrame:
    """`_closed` as files that land one after the other in order of time, each the rows between two cuts.

    A trigger takes one file, so the watermark moves with the files, and state is
    kept for the open stretch of time and not for the whole table. A file has
    small row groups, which many tasks read. Rows without a time come first.
    """
    sliced, landed = new_path(spark := df.sparkSession), new_path(spark)
    at = F.unix_micros(time)
    before = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= at)) if cuts else F.lit(0)
    place = F.when(at.isNull(), 0).otherwise(before)
    df.withColumn("_slice", place).repartition(len(cuts) + 1, "_slice").write.partitionBy("_slice").parquet(sliced)
    whole = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_slice", T.IntegerType())])).parquet(sliced)
    for i in range(len(cuts) + 1):
        part = whole.where(F.col("_slice") == i).drop("_slice")
        part.coalesce(1).write.mode("append").option("parquet.block.size", 1 << 20).parquet(landed)
    _end(df, landed, time, **later)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(landed)


@query
def verify_stream(spark, sf):
    """Forecasts and observations as two streams: the outcomes that `verify_outcomes` finds in tables.

    Both land in slices with the same cuts, so that both watermarks move together.
    """
    made, seen = forecasts_made(spark, sf), V.observations(spark, sf)
    cuts = _slices(made, "generated_at")
    forecasts = _arriving(made, cuts, "generated_at", valid_until="1 HOUR")
    obs = _arriving(seen, cuts, "datetime")
    found = stream_outcomes.verify_stream(forecasts, obs, "event_id", longest="12 hours")
    out = new_path(spark)
    sinks.start_exactly_once(found, out, "verify", new_path(spark)).awaitTermination()
    rows = sinks.read_batches(spark, out, found.schema).where("event_id >= 0")
    return rounded(rows.select("event_id", "observed.rain", "observed.temperature"))


@query
def stream_windows(spark, sf):
    """Sliding windows from keyed state: the horizon aggregates that `horizon_aggregates` finds in a table."""
    before = spark.conf.get(stream_state.PROVIDER, None)
    stream_state.with_rocksdb(spark)
    try:
        obs = _closed(V.observations(spark, sf), new_path(spark), "datetime")
        found = stream_state.stream_windows(obs, order=V.ORDER)
        out = new_path(spark)
        sinks.start_exactly_once(found, out, "windows", new_path(spark)).awaitTermination()
    finally:
        spark.conf.unset(stream_state.PROVIDER) if before is None else spark.conf.set(stream_state.PROVIDER, before)
    return rounded(sinks.read_batches(spark, out, found.schema).select("location_name", "datetime", "event_id", *seq.HORIZON))


@query
def quality_case_files(spark, sf):
    """Quality cases written as JSON arrays, read back by many tasks."""
    cases = V.quality_cases(V.predictions(spark, sf))
    folder = new_path(spark) + ".json"
    arrays = cases.groupBy(F.floor(F.col("id").cast("bigint") / 50)).agg(F.to_json(F.collect_list(F.struct(*cases.columns))).alias("value"))
    arrays.select("value").write.text(folder)
    c = files.read_quality_cases(spark, folder)
    return rounded(
        c.select(
            "id", "location", "input", "reference_forecast", F.col("required_terms"), F.array_join("forbidden_patterns", " ").alias("patterns"),
            "observed_weather.rain", "observed_weather.temperature",
        )
    )


_GAPPY = """gappy AS (SELECT location_name, CASE WHEN event_id % 41 <> 0 THEN datetime END AS datetime, event_id,
 CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 97 = 0 THEN 1000.0 ELSE temperature_c END AS temperature_c,
 CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 150.0 ELSE humidity_pct END AS humidity_pct, wind_speed_kph,
 CASE WHEN event_id % 3 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 83 = 0 THEN -100.0 ELSE pressure_hpa END AS pressure_hpa,
 precipitation_probability FROM obs_raw)"""


def _num(value: str, digits: int) -> str:
    return f"CASE WHEN {value} IS NULL OR isnan({value}) THEN 'nan' ELSE printf('%.{digits}f', {value}) END"


def _list(array: str, digits: int) -> str:
    return f"array_to_string(list_transform({array}, lambda x: {_num('x', digits)}), ', ')"


def _clean(column: str) -> str:
    return f"CASE WHEN NOT isnan({column}) THEN {column} END"


_SERIES = {"temperature": "temperature_c", "humidity": "humidity_pct", "wind_speed": "wind_speed_kph", "pressure": "pressure_hpa"}


def _gappy_window(fill: bool, rows: str) -> str:
    precip = "coalesce(precipitation_probability, 0.0)" if fill else "precipitation_probability"
    return ", ".join([*[f"list({c}) OVER a AS {n}" for n, c in _SERIES.items()], f"list({precip}) OVER a AS precipitation_probability"]) + rows


# Longest common subsequence of g and r: one row of the table of lengths per token of r.
_LCS = """(list_reduce(list_transform(range(1, len(r) + 1), lambda i: [i]), lambda above, i: list_reduce(
 list_transform(range(1, len(g) + 1), lambda j: [j]), lambda acc, j: acc || [greatest(acc[len(acc)], above[j[1] + 1],
 above[j[1]] + CAST(g[j[1]] = r[i[1]] AS BIGINT))], [0::BIGINT]), list_transform(range(0, len(g) + 1), lambda x: 0::BIGINT)))[len(g) + 1]"""
_ROUGE_L = f"CASE WHEN len(g) + len(r) > 0 THEN 2.0::DOUBLE * {_LCS} / (len(g) + len(r)) ELSE 0.0::DOUBLE END"


def _rouge_tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


def _pinned() -> str:
    """Scores as in `scored`, but BLEU-4 and ROUGE over tokens with stopwords."""
    bleu = O.bleu4_expression()
    staged = ", ".join(f"{O.grams(a, n)} AS {a}{n}" for a in "gr" for n in (2, 3, 4))
    return f"""b AS (SELECT sample_id, {bleu} AS bleu FROM (SELECT *, {staged} FROM pred_tokens)),
 l AS (SELECT sample_id, {O.f1(O.overlap('g', 'r'), 'g', 'r')} AS one, {O.f1(O.overlap('g2', 'r2'), 'g2', 'r2')} AS two, {_ROUGE_L} AS longest
  FROM (SELECT *, {O.grams('g', 2)} AS g2, {O.grams('r', 2)} AS r2 FROM (SELECT sample_id, {_rouge_tokens('generated_forecast')} AS g,
  {_rouge_tokens('reference_forecast')} AS r FROM pred))),
 pinned AS (SELECT s.* EXCLUDE (rouge_1, rouge_2), b.bleu, l.one AS rouge_1, l.two AS rouge_2, l.longest FROM scored s
  JOIN b ON b.sample_id = s.sample_id JOIN l ON l.sample_id = s.sample_id)"""


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["rouge_l_lcs"] = O.with_ctes(
        f"""SELECT conv_id, turn, round({_ROUGE_L}, 6) AS rouge_l FROM (SELECT conv_id, turn, {_rouge_tokens('answer')} AS g,
 {_rouge_tokens('question')} AS r FROM text_pairs)""",
        "text_pairs",
    )
    q["rouge_l_long"] = q["rouge_l_lcs"]
    scores = O.evaluation_rounded(["band"], bleu="bleu", rouge_l="longest", source="pinned")
    q["evaluate_pinned"] = O.with_ctes(f", {_pinned()} {scores}", "scored")
    made = "(SELECT *, datetime + (event_id % 12 + 1) * INTERVAL 1 HOUR AS until FROM obs)"
    q["verify_outcomes"] = O.with_ctes(
        f"""SELECT f.event_id, max(o.precipitation_probability) >= 0.5 AS rain, round(avg(o.temperature_c), 6) AS temperature
 FROM {made} f LEFT JOIN obs o ON o.location_name = f.location_name AND o.datetime > f.datetime AND o.datetime <= f.until GROUP BY 1""",
        "obs",
    )
    p = "(doc_id * 37 % 101)::DOUBLE / 100"
    bins = f"""SELECT toxic, least(floor({p} * 10), 9)::INT AS bin, count(*) AS "rows", avg({p}) AS mean_p, avg(quality) AS rate FROM labels GROUP BY 1, 2"""
    q["reliability_bins"] = f'SELECT toxic, bin, "rows", round(mean_p, 6) AS mean_p, round(rate, 6) AS rate FROM ({bins})'
    q["brier_decomposition"] = f"""SELECT toxic, sum("rows")::BIGINT AS "rows", round(sum("rows" * (mean_p - rate) ** 2) / sum("rows"), 6) AS reliability,
 round(sum("rows" * (rate - base) ** 2) / sum("rows"), 6) AS resolution, round(min(base * (1 - base)), 6) AS uncertainty
 FROM (SELECT *, sum("rows" * rate) OVER (PARTITION BY toxic) / sum("rows") OVER (PARTITION BY toxic) AS base FROM ({bins})) GROUP BY 1"""
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS measure, {c} AS v, {list(map(float, e))!r} AS edges, {outcomes.RANGES[c][0]!r} AS lo, {outcomes.RANGES[c][1]!r} AS hi FROM gappy"
        for c, e in outcomes.BANDS.items()
    )
    head = "WITH " + O.OBS + ", " + _GAPPY
    q["band_counts"] = (
        f"""{head} SELECT measure, CASE WHEN v IS NOT NULL AND NOT isnan(v) THEN len(list_filter(edges, lambda e: v >= e))::INT END AS band,
 count(*) AS "rows" FROM ({long}) GROUP BY 1, 2"""
    )
    q["range_violations"] = f"""{head} SELECT measure, count(*) FILTER (NOT isnan(v) AND v < lo) AS below,
 count(*) FILTER (NOT isnan(v) AND v > hi) AS above, count(*) FILTER (v IS NULL OR isnan(v)) AS missing FROM ({long}) GROUP BY 1"""
    both = []
    for side in ("generated_forecast", "reference_forecast"):
        lo, hi = (O.bound(side, extract.TEMPERATURE, h) for h in (False, True))
        both += [f"(({lo}) + ({hi})) / 2.0::DOUBLE", O.wind(side)]
    q["tolerance_accuracy"] = O.with_ctes(
        f"""SELECT band, count(t) AS temperature_pairs, round(avg((t <= 3.0)::INT), 6) AS temperature_accuracy, count(w) AS wind_pairs,
 round(avg((w <= 5.0)::INT), 6) AS wind_accuracy FROM (SELECT band, abs({both[0]} - {both[2]}) AS t, abs({both[1]} - {both[3]}) AS w FROM pred) GROUP BY 1""",
        "pred",
    )
    value = "CASE WHEN event_id % 101 = 0 OR event_id % 103 = 0 THEN NULL ELSE round(value, 2) END"
    metrics = f"""SELECT event_type AS run, 'loss' AS key, {value} AS v FROM events UNION ALL SELECT event_type, 'eval_loss', round(value, 2) + 1 FROM events
 UNION ALL SELECT event_type, 'eval_pre_eval_mae', round(value, 2) + 2 FROM events"""
    q["compare_runs"] = f"""SELECT key, round(a, 6) AS "first", round(b, 6) AS second, round(b - a, 6) AS delta FROM (
 SELECT key, avg(v) FILTER (run = 'click') AS a, avg(v) FILTER (run = 'view') AS b FROM ({metrics}) GROUP BY 1)"""
    parts = ["accuracy_reward", "style_reward", "calibration_reward"]
    q["weekly_drift"] = O.with_ctes(
        "SELECT epoch_us(week) AS week, \"rows\", " + ", ".join(f"round({c}, 6) AS {c}, round({c} - lag({c}) OVER (ORDER BY week), 6) AS {c}_change" for c in parts)
        + " FROM (SELECT date_trunc('week', strptime(r.datetime, '%Y-%m-%d %H:%M UTC'))::TIMESTAMP AS week, count(*) AS \"rows\", "
        + ", ".join(f"avg({c}) AS {c}" for c in parts) + " FROM rewarded r GROUP BY 1)",
        "rewarded",
    )
    q["windowed_observations"] = O.with_ctes(
        """SELECT location_name, epoch_us(time_bucket(INTERVAL 6 HOUR, datetime, TIMESTAMP '1970-01-01')) AS start, count(*) AS "rows",
 round(avg(temperature_c), 6) AS temperature, round(max(precipitation_probability), 6) AS rain FROM obs GROUP BY 1, 2""",
        "obs",
    )
    windows = "WINDOW a AS (PARTITION BY location_name ORDER BY datetime, event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), "
    windows += "h AS (PARTITION BY location_name ORDER BY datetime, event_id ROWS BETWEEN 4 FOLLOWING AND 9 FOLLOWING)"
    gappy = f"""{head}, timed AS (SELECT * FROM gappy WHERE datetime IS NOT NULL), win AS (SELECT location_name, datetime, event_id,
 {_gappy_window(False, '')}, max({_clean('temperature_c')}) OVER h AS max_temp, min({_clean('temperature_c')}) OVER h AS min_temp,
 avg({_clean('humidity_pct')}) OVER h AS avg_humidity, max(wind_speed_kph) OVER h AS max_wind, avg(precipitation_probability) OVER h AS avg_precip,
 row_number() OVER (PARTITION BY location_name ORDER BY datetime, event_id) AS rn, count(*) OVER (PARTITION BY location_name) AS n FROM timed {windows})"""
    text = O.prompt("location_name", O.minute("datetime"), {n: _list(n, d) for n, d in O.DIGITS.items()})
    q["render_prompt_gaps"] = f"{gappy} SELECT event_id, {text} AS prompt FROM win WHERE rn <= n - 10"
    target = O.bulletin("min_temp", "max_temp", "avg_humidity", "max_wind", "avg_precip")
    for c in ("min_temp", "max_temp", "max_wind"):
        target = target.replace(f"printf('%.0f', {c})", f"({_num(c, 0)})")
    q["bulletin_gaps"] = f"{gappy} SELECT event_id, {target} AS target FROM win WHERE rn <= n - 10"
    first = ", ".join(
        [*[f"list({c} ORDER BY rn) AS {n}" for n, c in _SERIES.items()], "list(coalesce(precipitation_probability, 0.0) ORDER BY rn) AS precipitation_probability"]
    )
    q["first_l_gaps"] = f"""{head}, firsts AS (SELECT location_name, min(datetime) AS datetime, {first} FROM (SELECT *,
 row_number() OVER (PARTITION BY location_name ORDER BY datetime, event_id) AS rn FROM gappy WHERE datetime IS NOT NULL) WHERE rn <= 4 GROUP BY 1)
 SELECT location_name, {text} AS prompt FROM firsts"""
    plain = O.bulletin("min_temp", "max_temp", "avg_humidity", "max_wind", "avg_precip")
    q["extract_conditions_nbsp"] = O.with_ctes(
        f"""SELECT event_id, {O.rain_signal('t')} AS rain, {O.bound('t', extract.TEMPERATURE, False)} AS lo, {O.bound('t', extract.TEMPERATURE, True)} AS hi,
 {O.wind('t')} AS wind_speed FROM (SELECT event_id, {plain} AS t FROM win)""",
        "win",
    )
    q["normalize_prediction_maps"] = O.with_ctes(
        """SELECT CAST(sample_id AS VARCHAR) AS id, band AS generated_forecast FROM pred UNION ALL SELECT 'n' || sample_id, 'None' FROM pred""", "pred"
    )
    q["observations_round_trip"] = O.with_ctes(
        "SELECT location_name, epoch_us(datetime) AS datetime, round(temperature_c, 6) AS temperature_c, round(humidity_pct, 6) AS humidity_pct FROM obs", "obs"
    )
    q["dataset_round_trip"] = O.with_ctes(
        'SELECT location, count(*) AS "rows", max(input) AS last_input, min(target) AS first_target FROM corpus GROUP BY 1', "corpus"
    )
    t = _clean("temperature_c")
    q["merged_profile"] = f"""{head} SELECT count(*) AS records, epoch_us(min(datetime)) AS first_datetime, epoch_us(max(datetime)) AS last_datetime,
 count({t}) AS temperature_c_n, round(avg({t}), 6) AS temperature_c_mean, round(min({t}), 6) AS temperature_c_low, round(max({t}), 6) AS temperature_c_high,
 true AS locations_close, true AS quartiles_close FROM gappy"""
    q["verify_stream"] = q["verify_outcomes"]
    q["stream_windows"] = O.oracle()["horizon_aggregates"]
    q.update(_inference_sql())
    q["quality_case_files"] = O.with_ctes(
        """SELECT CAST(sample_id AS VARCHAR) AS id, location, 'Weather data' AS input, reference_forecast, band || '|Conditions|' || wind_term AS required_terms,
 '\\| generate a forecast GUSTS near 4[5-9]' AS patterns, obs_rain AS rain, round(obs_temp, 6) AS temperature FROM pred""", "pred"
    )
    return q


def _lanes_sql(key: str, draws: int) -> str:
    """(lane, draw) of every row, as a list of structs."""
    lanes = inference.LANES
    return f"""list_transform(range({draws}), lambda nth: struct_pack(lane := nth,
 draw := ('0x' || substr(md5('0:' || {key} || ':' || (nth // {lanes})), ((nth % {lanes}) * 4 + 1)::INT, 4))::INT))"""


def _inference_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    w, weights = inference, evaluate.OVERALL
    poisson = " + ".join(f"(x.draw >= {int(65536 * sum(1 / (2.718281828459045 * _factorial(i)) for i in range(k + 1)))})::INT" for k in range(8))
    names = {"bleu": "rouge_1", "rouge_1": "rouge_1", "categorical": "categorical", "length": "length_sim", "readability": "read_score"}
    score = " + ".join(f"{weights[n]}::DOUBLE * coalesce({c}, 0)" for n, c in names.items())
    q["bootstrap_interval"] = O.with_ctes(
        f""", drawn AS (SELECT band, score, hit, pair, x.lane, {poisson} AS w FROM (SELECT band, {score} AS score, rain_hit AS hit, rain_pair AS pair,
 unnest({_lanes_sql('sample_id', w.REPLICATES)}) AS x FROM scored)),
 means AS (SELECT band, sum(w * score) / sum(w) + {weights['rain']}::DOUBLE * sum(w * hit) / greatest(sum(w * pair), 1) AS m FROM drawn GROUP BY band, lane HAVING sum(w) > 0),
 ends AS (SELECT band, list_sort(list(m)) AS l FROM means GROUP BY band)
 SELECT e.band, predictions, {O.r6('overall_score')} AS overall_score, round(l[floor((len(l) - 1) * 0.025 + 1e-9)::INT + 1], 6) AS bootstrap_low,
 round(l[ceil((len(l) - 1) * 0.975 - 1e-9)::INT + 1], 6) AS bootstrap_high FROM ({O.evaluation(['band'])}) e JOIN ends ON ends.band = e.band""",
        "scored",
    )
    p = "(doc_id * 37 % 101)::DOUBLE / 100"
    # The isotonic fit of a bin is the largest, over starts up to it, of the smallest mean up to any end from it on.
    q["calibration_curve"] = f"""WITH bins AS (SELECT toxic, least(floor({p} * 100), 99)::INT AS bin, count(*) AS n, avg({p}) AS mean_p, avg(quality) AS rate
 FROM labels GROUP BY 1, 2),
 spans AS (SELECT a.toxic, a.bin AS lo, b.bin AS hi, (SELECT sum(c.n * c.rate) / sum(c.n) FROM bins c WHERE c.toxic = a.toxic AND c.bin BETWEEN a.bin AND b.bin) AS mean
  FROM bins a JOIN bins b ON a.toxic = b.toxic AND a.bin <= b.bin),
 least_of AS (SELECT x.toxic, x.bin, s.lo, min(s.mean) AS m FROM bins x JOIN spans s ON s.toxic = x.toxic AND s.lo <= x.bin AND s.hi >= x.bin GROUP BY 1, 2, 3)
 SELECT x.toxic, x.bin, x.n AS "rows", round(x.mean_p, 6) AS mean_p, round(x.rate, 6) AS rate, round(max(l.m), 6) AS fitted
 FROM bins x JOIN least_of l ON l.toxic = x.toxic AND l.bin = x.bin GROUP BY x.toxic, x.bin, x.n, x.mean_p, x.rate"""
    two = O.rewarded("reference_forecast", "obs_rain", "obs_temp", O.W_DEFAULT) % "pred"
    signed = ", ".join(f"sum(CASE WHEN (x.draw >> {k}) & 1 = 1 THEN d ELSE -d END) AS s{k}" for k in range(16))
    far = " + ".join(f"(abs(s{k}) >= abs(s) - 1e-9 * size)::INT" for k in range(16))
    q["paired_significance"] = O.with_ctes(
        f""", two AS ({two}), d AS (SELECT r.sample_id, r.band, two.total_reward - r.total_reward AS d FROM rewarded r JOIN two ON two.sample_id = r.sample_id),
 drawn AS (SELECT band, d, unnest({_lanes_sql('sample_id', w.FLIPS // 16)}) AS x FROM d),
 sums AS (SELECT band, x.lane, count(*) AS n, sum(d) AS s, sum(abs(d)) AS size, {signed} FROM drawn GROUP BY band, x.lane)
 SELECT band, max(n) AS pairs, round(first(s) / max(n), 6) AS delta, round((sum({far}) + 1) / {w.FLIPS + 1}.0::DOUBLE, 6) AS p_value FROM sums GROUP BY band""",
        "rewarded",
    )
    sums = {"up": "z - 0.25", "down": "-z - 0.25"}
    first = ", ".join(f"greatest(0.0::DOUBLE, {e}) AS {c}, CASE WHEN {e} <= 0 THEN day END AS {c}_zero" for c, e in sums.items())
    following = ", ".join(
        f"greatest(0.0::DOUBLE, r.{c} + {e}), CASE WHEN r.{c} + {e} <= 0 THEN d.day ELSE r.{c}_zero END"
        for c, e in (("up", "d.z - 0.25"), ("down", "-d.z - 0.25"))
    )
    q["change_points"] = O.with_ctes(
        f""", days AS (SELECT right(location_name, 1) AS station_group, CAST(datetime AS DATE) AS day, avg(temperature_c) AS mean FROM obs GROUP BY 1, 2),
 z AS (SELECT *, coalesce((mean - avg(mean) OVER w) / nullif(stddev_pop(mean) OVER w, 0), 0) AS z,
 row_number() OVER (PARTITION BY station_group ORDER BY day) AS rn FROM days WINDOW w AS (PARTITION BY station_group)),
 run AS (SELECT station_group, rn, day, mean, {first} FROM z WHERE rn = 1
 UNION ALL SELECT d.station_group, d.rn, d.day, d.mean, {following} FROM run r JOIN z d ON d.station_group = r.station_group AND d.rn = r.rn + 1)
 SELECT station_group, CAST(day AS VARCHAR) AS day, round(mean, 6) AS mean, round(up, 6) AS up, round(down, 6) AS down,
 CASE WHEN up > 2 THEN CAST(up_zero AS VARCHAR) END AS up_since, CASE WHEN down > 2 THEN CAST(down_zero AS VARCHAR) END AS down_since,
 up > 2 OR down > 2 AS changed FROM run""",
        "obs",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    return q


def _factorial(n: int) -> int:
    return 1 if n < 2 else n * _factorial(n - 1)
