import datetime as dt
import itertools
import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from stratocast.operators import candidates, evaluate, forecasts, ingest, metriclog
from stratocast.schemas import HOURLY_BLOCK, OBSERVATION
from stratocast.sources import files
from stratocast.streaming import files as streams

T0 = dt.datetime(2024, 1, 1)


def block(name, steps=3, size=3, interval=3600, span=None):
    values = [float(i) for i in range(size)]
    end = T0 + dt.timedelta(seconds=interval * steps if span is None else span)
    return ((name, 1.0, 2.0, None, None, None), T0, end, interval, values, values, values, values, values, values, None, None)


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [block("ok"), block("empty", span=0), block("backwards", span=-3600), block(None), block("short", size=2),
            block("partial", span=3600 * 2 + 60), block("bad", interval=0, span=100)]
    return spark.createDataFrame(rows, HOURLY_BLOCK)


def test_flatten_and_quarantine(blocks):
    good, bad = ingest.quarantine_blocks(blocks)
    assert {(r["location"]["name"], r["reason"]) for r in bad.collect()} == {
        (None, "no location"), ("short", "short array"), ("bad", "bad interval"),
    }
    rows = ingest.flatten_hourly(good)
    counts = {r[0]: r[1] for r in rows.groupBy("location.name").count().collect()}
    assert counts == {"ok": 3, "partial": 3}
    last = rows.where("location.name = 'ok'").orderBy(F.desc("datetime")).first()
    assert last["datetime"] == T0 + dt.timedelta(hours=2) and last["temperature_c"] == 2.0


def test_ingest_table(blocks):
    current = blocks.where("location.name = 'ok'").select("location", F.col("start").alias("datetime"), F.lit(9.0).alias("temperature_c"), F.lit(10.0).alias("wind_speed"))
    obs, rejected = ingest.ingest_blocks(blocks, current)
    assert obs.schema.names == OBSERVATION.names and rejected.count() == 3
    rows = obs.where("location_name = 'ok'").orderBy("datetime", F.desc("temperature_c")).collect()
    assert len(rows) == 4 and rows[0]["wind_speed_kph"] == 36.0 and rows[0]["precipitation_probability"] == 0.0
    assert rows[2]["wind_speed_kph"] == 3.6 and rows[2]["precipitation_probability"] == 0.01
    assert rows[0]["visibility_km"] is None and rows[0]["precipitation_mm"] == 0.0
    p = ingest.profile_observations(obs).first()
    assert (p["records"], p["locations"], p["first_datetime"]) == (7, 2, T0)


def test_fill_keeps_nan(spark):
    df = spark.createDataFrame([Row(location=Row(name="a", latitude=1.0, longitude=1.0), datetime=T0, precipitation_probability=float("nan"), cloud_cover_pct=0.0)])
    row = ingest.observations_table(df).first()
    assert row["precipitation_probability"] != row["precipitation_probability"] and row["cloud_cover_pct"] == 0.0


def test_locations(spark):
    assert ingest.location_dim(spark).count() == 10 and ingest.location_dim(spark, training_only=True).count() == 5
    got = ingest.enrich_locations(spark.createDataFrame([("Cairo",), ("X",)], "location_name string")).orderBy("location_name").collect()
    assert got[0]["country"] == "Egypt" and got[1]["country"] is None
    dim = spark.createDataFrame([("X", "Nowhere")], "name string, country string")
    own = ingest.enrich_locations(spark.createDataFrame([("Cairo",), ("X",)], "location_name string"), dim)
    assert {tuple(r) for r in own.collect()} == {("Cairo", None), ("X", "Nowhere")}


def test_readiness(spark):
    df = spark.createDataFrame([("train", "a", "b"), ("train", "a", None), ("val", "a", "b")], "split string, input string, target string")
    got = {r["split"]: tuple(r)[1:] for r in ingest.readiness_report(df, {"train": 1, "val": 2, "test": 1}).collect()}
    assert got == {"train": (1, 2, 1, False), "val": (2, 1, 0, False), "test": (1, 0, 0, False)}


@pytest.mark.parametrize("suffix", ["csv", "parquet", "json"])
def test_observation_round_trip(blocks, spark, tmp_path, suffix):
    obs, _ = ingest.ingest_blocks(blocks)
    path = str(tmp_path / f"obs.{suffix}")
    files.write_observations(obs, path)
    back = files.read_observations(spark, path)
    assert back.schema.names == OBSERVATION.names
    assert sorted(map(str, back.collect())) == sorted(map(str, obs.collect()))
    with pytest.raises(ValueError):
        files.write_observations(obs, str(tmp_path / "obs.xls"))


def test_partitioned_write_prunes(blocks, spark, tmp_path):
    obs, _ = ingest.ingest_blocks(blocks)
    path = str(tmp_path / "by_date.parquet")
    files.write_observations(obs, path, by_date=True)
    day = spark.read.parquet(path).where("date = date'2024-01-01' and location_name = 'ok'").select("temperature_c")
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert day.count() == 3 and "PartitionFilters: [isnotnull(date" in plan and "PushedFilters: [IsNotNull(location_name)" in plan


def test_dataset_files(spark, tmp_path):
    records = [{"input": "i1", "target": "t1", "prompt": "i1", "response": "t1", "location": "a", "datetime": "d"},
               {"input": "i2", "target": "t2", "prompt": "i2", "response": "t2", "location": "b", "datetime": "d"}]
    (tmp_path / "a.json").write_text(json.dumps(records, indent=2))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, records)))
    a, b = files.read_dataset(spark, str(tmp_path / "a.json")), files.read_dataset(spark, str(tmp_path / "b.jsonl"))
    assert [r.asDict() for r in a.orderBy("input").collect()] == records == [r.asDict() for r in b.orderBy("input").collect()]
    files.write_dataset(a, str(tmp_path / "c.json"))
    assert files.read_dataset(spark, str(tmp_path / "c.json")).count() == 2
    with pytest.raises(ValueError):
        files.read_dataset(spark, str(tmp_path / "a.txt"))


def test_prediction_files(spark, tmp_path):
    listed = [{"id": "a", "generated_forecast": "x"}, {"id": "a", "forecast": "y"}, {"id": "b", "generated_forecast": ""},
              {"id": "", "forecast": "z"}, {"id": "c", "generated_forecast": "", "forecast": "w"}]
    (tmp_path / "list.json").write_text(json.dumps(listed))
    (tmp_path / "map.json").write_text(json.dumps({"a": "x", "b": ""}))
    got = {r["id"]: r["generated_forecast"] for r in files.read_predictions(spark, str(tmp_path / "list.json")).collect()}
    assert got == {"a": "y", "c": "w"}
    mapped = {r["id"]: r["generated_forecast"] for r in files.read_predictions(spark, str(tmp_path / "map.json")).collect()}
    assert mapped == {"a": "x", "b": ""}
    (tmp_path / "none.json").write_text("[]")
    with pytest.raises(ValueError):
        files.read_quality_cases(spark, str(tmp_path / "none.json"))
    case = {"id": "q", "location": "L", "input": "i", "reference_forecast": "r", "required_terms": ["dry"], "observed_weather": {"rain": False}}
    (tmp_path / "cases.json").write_text(json.dumps([case]))
    row = files.read_quality_cases(spark, str(tmp_path / "cases.json")).first()
    assert row["observed_weather"]["rain"] is False and row["observed_weather"]["temperature"] is None


def py_confidence(texts):
    sets = [set(t.lower().split()) for t in texts]
    js = [len(a & b) / len(a | b) for a, b in itertools.combinations(sets, 2) if a | b]
    return min(1.0, max(0.1, sum(js) / len(js))) if js else 0.5


@pytest.mark.parametrize("block_size", [2, 5, 32])
def test_confidence_against_brute_force(spark, block_size):
    rng = random.Random(11)
    groups = {0: ["one text"], 1: ["", ""], 2: ["a b", "A  b"], 3: ["x", "y"], 4: ["", "x"]}
    for k in range(5, 20):
        groups[k] = [" ".join(rng.choice("abcdEF") for _ in range(rng.randrange(0, 5))) for _ in range(rng.randrange(2, 30))]
    groups[20] = ["same words here"] * 200 + ["other words"] * 3
    rows = [(k, i, t) for k, texts in groups.items() for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "prompt_id int, idx int, text string")
    got = {r["prompt_id"]: r for r in candidates.consistency_confidence(df, block=block_size).collect()}
    assert set(got) == set(groups)
    for k, texts in groups.items():
        assert got[k]["candidates"] == len(texts)
        assert got[k]["confidence_score"] == pytest.approx(py_confidence(texts)), k
    arrays = df.groupBy("prompt_id").agg(F.collect_list("text").alias("t")).select("prompt_id", candidates.agreement_of(F.col("t")).alias("c"))
    assert {r["prompt_id"]: r["c"] for r in arrays.collect()} == pytest.approx({k: py_confidence(t) for k, t in groups.items()})


def test_best_candidate(spark):
    long = " ".join(["w"] * 51)
    groups = {1: ["a b", "c d", "e"], 2: [long, "x"], 3: [long, long + " z"], 4: ["only"]}
    best = {1: "a b", 2: "x", 3: long, 4: "only"}
    df = spark.createDataFrame([(k, i, t) for k, ts in groups.items() for i, t in enumerate(ts)], "prompt_id int, idx int, text string")
    assert {r["prompt_id"]: r["text"] for r in candidates.best_candidate(df).collect()} == best
    arrays = spark.createDataFrame(list(groups.items()), "prompt_id int, t array<string>")
    assert {r[0]: r[1] for r in arrays.select("prompt_id", candidates.best_of(F.col("t"))).collect()} == best


OBS_ROWS = [(name, T0 + dt.timedelta(hours=h), 10.0 + h, 50.0, 5.0, 1000.0, 0.1) for name in ("A", "B") for h in range(6)]
OBS_SCHEMA = "location_name string, datetime timestamp, temperature_c double, humidity_pct double, wind_speed_kph double, pressure_hpa double, precipitation_probability double"


def test_requests_and_batch(spark):
    raw = spark.createDataFrame(
        [(1, "A", 1.0, 2.0, None, None), (2, "B", 1.0, 2.0, 12, False), (3, "C", 1.0, 2.0, 3, True), (4, None, 1.0, 2.0, 3, True), (5, "A", None, 2.0, 3, True)],
        "request_id bigint, name string, latitude double, longitude double, forecast_horizon int, include_confidence boolean",
    )
    good, bad = forecasts.parse_requests(raw)
    assert {(r["request_id"], r["reason"]) for r in bad.collect()} == {(4, "missing name"), (5, "missing latitude")}
    obs = spark.createDataFrame(OBS_ROWS, OBS_SCHEMA)
    at = F.lit(T0)
    got = {r["request_id"]: r for r in forecasts.batch_forecast(good, obs, at).collect()}
    assert got[1]["forecast"].startswith("Mainly dry conditions expected with cool temperatures around 10-13C")
    assert got[1]["confidence"] == 0.5 and got[1]["valid_until"] == "2024-01-01T06:00:00"
    assert got[2]["confidence"] is None and got[2]["valid_until"] == "2024-01-01T12:00:00"
    assert got[3]["forecast"] == "Error generating forecast: No weather data available for C"
    assert (got[3]["status"], got[3]["confidence"], got[3]["valid_until"]) == ("error", 0.0, "2024-01-01T00:00:00")

    def generator(prompts):
        if any(" B " in p for p in prompts):
            raise RuntimeError("boom")
        return [["wet day", "wet day ahead", " dry "] for _ in prompts]

    made = {r["request_id"]: r for r in forecasts.batch_forecast(good, obs, at, generator=generator).collect()}
    assert made[1]["forecast"] == "wet day ahead" and made[1]["confidence"] == pytest.approx((2 / 3) / 3)
    assert made[2]["forecast"] == "Error generating forecast: boom" and made[2]["confidence"] == 0.0
    assert made[3]["status"] == "error"


def test_prompt_lookup_and_payload(spark):
    corpus = spark.createDataFrame([(2, " Paris ", "second"), (1, "PARIS", "first"), (0, "paris", ""), (3, "", "x")], "n int, location string, input string")
    requests = spark.createDataFrame([(" paris",), ("New York",), ("Oslo ",)], "city string")
    got = {r["city"]: r["prompt"] for r in forecasts.lookup_prompt(requests, corpus, ["n"]).collect()}
    assert got[" paris"].startswith("<|user|>\nfirst\n\nWrite only a concise") and got[" paris"].endswith("</s>\n<|assistant|>\n")
    assert "Weather data for New York on current local conditions:\n- Temperature (°C): 18.3, 18.0, 17.7, 17.6\n- Humidity (%): 66, 75, 79, 79" in got["New York"]
    assert "for Oslo on" in got["Oslo "] and "0.10, 0.15, 0.20, 0.25" in got["Oslo "]
    data = spark.createDataFrame(
        [("Nairobi", {"temperature": "23-25", "wind_speed": "10-15", "precipitation_probability": "0.10"}), ("X", None), ("Y", {}), ("Z", {"humidity": "3"})],
        "city string, weather_data map<string,string>",
    )
    rows = {r["city"]: r for r in forecasts.payload_forecast(data).collect()}
    assert rows["Nairobi"]["forecast"] == "Nairobi should see temperatures near 23-25C, winds around 10-15 km/h, and precipitation probability near 0.10."
    assert "- Temperature (C): 23-25\n- Humidity (%): unknown" in rows["Nairobi"]["input_prompt"]
    assert rows["Nairobi"]["input_prompt"].startswith("Weather data for Nairobi on current time:")
    assert rows["X"]["forecast"] == rows["Y"]["forecast"].replace("Y", "X", 1) and "unavailable" in rows["X"]["forecast"]
    assert rows["Z"]["forecast"] == "Z should see temperatures near the current rangeC, winds around local km/h, and precipitation probability near unknown."


def test_metric_tables(spark):
    wide = spark.createDataFrame([(1, 0.5, None, 2.0)], "step int, loss double, grad_norm double, `train/x` double")
    got = {(r["key"], r["value"]) for r in metriclog.namespace_metrics(wide, "train").collect()}
    assert got == {("train/loss", 0.5), ("train/x", 2.0)}
    assert {r["key"] for r in metriclog.namespace_metrics(wide.select("step", "`train/x`"), "eval").collect()} == {"eval/train/x"}
    logs = spark.createDataFrame([(1, {"eval_loss": 1.0, "eval_a_eval_b": 2.0, "loss": 3.0, "my_eval_x": 4.0})], "step int, logs map<string,double>")
    assert {r["key"] for r in metriclog.route_log_rows(logs).collect()} == {"eval/loss", "eval/a_b", "train/loss", "train/my_eval_x"}
    log = spark.createDataFrame([("r", "k", float("nan")), ("r", "k", 1.0), ("s", "k", float("inf"))], "run string, key string, value double")
    steps = spark.createDataFrame([("r", None), ("r", "Info: step"), ("s", "CUDA error"), ("s", "bad shape")], "run string, error string")
    health = {r["run"]: tuple(r)[1:] for r in metriclog.run_health(log, steps).collect()}
    assert health == {"r": (2, 1, 1, 1, 1, False), "s": (1, 1, 0, 2, 1, True)}
    assert {tuple(r) for r in metriclog.non_finite_by_key(log).collect()} == {("r", "k", 1), ("s", "k", 1)}
    assert [r["id"] for r in metriclog.every_nth(spark.range(25), 10, "id").orderBy("id").collect()] == [0, 10, 20]


def test_evaluation_log_and_samples(pairs):
    metrics = evaluate.evaluate(pairs).withColumn("step", F.lit(3))
    log = {r["key"]: r["value"] for r in metriclog.evaluation_log(metrics).collect()}
    assert len(log) == 15 and log["weather/temperature_accuracy"] == log["weather/categorical_accuracy"] == 0.5
    assert log["eval/overall_score"] == pytest.approx(0.506469, abs=1e-6) and "nlg/rouge_l_f" in log
    test = pairs.select(F.col("id").alias("sample_id"), F.lit("p").alias("input"), F.col("reference_forecast").alias("target"))
    made = pairs.select(F.col("id").alias("sample_id"), F.when(F.col("id") == 1, F.col("generated_forecast")).alias("generated_forecast"))
    table = evaluate.prediction_table(test, made)
    assert [tuple(r)[4:] for r in table.collect()] == [("Unknown", "Unknown")]
    assert metriclog.sample_table(table, ["sample_id"], 10).columns == ["Input", "Prediction", "Reference"]


def test_streams_equal_batch_and_restart(spark, blocks, pairs, tmp_path):
    landing, out, bad, state = (str(tmp_path / d) for d in ("landing", "out", "bad", "state"))
    blocks.where("location.name = 'ok'").write.json(landing)

    def run():
        for q in streams.start_ingest(streams.read_block_stream(spark, landing), out, bad, state):
            q.awaitTermination()

    run()
    assert spark.read.parquet(out).count() == 3
    blocks.where("location.name <> 'ok' or location.name is null").write.mode("append").json(landing)
    run()
    run()
    expected, rejected = ingest.ingest_blocks(blocks)
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, expected.collect()))
    assert spark.read.parquet(bad).count() == rejected.count() == 3

    texts = str(tmp_path / "texts")
    pairs.select(F.col("id").alias("sample_id"), "generated_forecast").write.parquet(texts)
    stream = spark.readStream.schema("sample_id int, generated_forecast string").parquet(texts)
    seen = spark.createDataFrame([(1, True, 23.0)], "sample_id int, rain boolean, temperature double")
    streams.start_scoring(stream, str(tmp_path / "scores"), observed=seen, checkpoint=str(tmp_path / "s2")).awaitTermination()
    scores = {r["sample_id"]: r["accuracy_reward"] for r in spark.read.parquet(str(tmp_path / "scores")).collect()}
    assert scores[2] == 0.5 and set(scores) == {1, 2}
    assert streams.checkpoint_location(spark, "x", "/given") == "/given"
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        with pytest.raises(ValueError):
            streams.checkpoint_location(spark, "x")
    else:
        assert streams.checkpoint_location(spark, "x") == f"{shared.rstrip('/')}/x"


def test_windowed_stream_equals_batch(spark, tmp_path):
    """The stream's closed windows are those of the table; a second run from the same checkpoint adds nothing twice."""
    from stratocast.operators.outcomes import windowed_observations

    rows = spark.range(400).selectExpr(
        "concat('l', id % 3) AS location_name", "timestamp_seconds(id * 1800) AS datetime", "id * 0.5D AS temperature_c",
        "(id % 7) / 7D AS precipitation_probability",
    )
    rows.where("temperature_c < 120").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = windowed_observations(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), late="1 hour")
        writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").outputMode("append")
        writer.trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()

    run()
    rows.where("temperature_c >= 120").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    run()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {tuple(r) for r in windowed_observations(rows).collect()}
    assert got <= want and len(got) == spark.read.parquet(f"{tmp_path}/out").count() and len(want) - len(got) <= 6
