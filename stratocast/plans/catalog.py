"""The queries by name: each takes (spark, sf_dir) and returns a DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocast.functions import extract, labels, render, reward, text
from stratocast.operators import candidates, corpus, evaluate, forecasts, gate, ingest, longest, metriclog, rewards, scale
from stratocast.operators import sequences as seq
from stratocast.storage import stored
from stratocast.plans import views as V
from stratocast.session import prepare
from stratocast.sources import files

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}

MADE_AT = "2024-02-01 06:30:00"
MINIMUMS = {"train": 240, "val": 30, "test": 30, "extra": 1}


def query(function: Query) -> Query:
    @wraps(function)
    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(prepare(spark), sf_dir)

    CATALOG[function.__name__] = prepared
    return prepared


def r6(value: Column) -> Column:
    return F.round(value, 6)


def us(ts: Column) -> Column:
    return F.unix_micros(ts)


def joined(array: str) -> Column:
    return F.array_join(F.col(array), "|")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places and timestamps to microseconds, names kept."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "double":
            c = r6(c)
        elif kind == "timestamp":
            c = us(c)
        elif kind == "array<string>":
            c = F.array_join(c, "|")
        elif kind == "array<int>":
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(name))
    return df.select(*out)


# Ingest ------------------------------------------------------------------


@query
def flatten_hourly(spark, sf):
    good, _ = ingest.quarantine_blocks(V.blocks(spark, sf))
    rows = ingest.flatten_hourly(good)
    return rounded(rows.withColumn("location_name", F.col("location.name")).drop("location"))


@query
def normalize_units(spark, sf):
    good, _ = ingest.quarantine_blocks(V.blocks(spark, sf))
    rows = ingest.normalize_units(ingest.flatten_hourly(good))
    return rounded(rows.select(F.col("location.name").alias("location_name"), "datetime", "wind_speed_kph", "precipitation_probability"))


@query
def union_current_hourly(spark, sf):
    good, _ = ingest.quarantine_blocks(V.blocks(spark, sf))
    rows = ingest.union_current_hourly(V.current(spark, sf), ingest.flatten_hourly(good))
    return (
        rows.groupBy(F.col("location.name").alias("location_name"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("precipitation_mm").alias("with_precipitation"),
            r6(F.sum("temperature_c")).alias("sum_temperature"),
        )
    )


@query
def quarantine_blocks(spark, sf):
    good, bad = ingest.quarantine_blocks(V.blocks(spark, sf))
    kept = good.withColumn("reason", F.lit(None).cast("string"))
    return kept.unionByName(bad).groupBy("reason").agg(F.count(F.lit(1)).alias("blocks"))


@query
def observations_table(spark, sf):
    table, _ = ingest.ingest_blocks(V.blocks(spark, sf), V.current(spark, sf))
    return rounded(table)


@query
def profile_observations(spark, sf):
    return rounded(ingest.profile_observations(V.raw_observations(spark, sf)))


@query
def observed_locations(spark, sf):
    return ingest.observed_locations(V.raw_observations(spark, sf))


@query
def enrich_locations(spark, sf):
    # Customers' nations stand for cities; the last ones are unknown.
    names = F.array(*[F.lit(c[0]) for c in ingest.CITIES])
    t = V.table(spark, sf, "customer").select(
        "c_custkey", F.coalesce(F.get(names, F.col("c_nationkey")), F.lit("Elsewhere")).alias("location_name")
    )
    return ingest.enrich_locations(t)


@query
def readiness_report(spark, sf):
    return ingest.readiness_report(V.split_corpus(spark, sf), MINIMUMS)


# Sequences and labels -------------------------------------------------------


def _texts(df: DataFrame) -> DataFrame:
    digits = {"temperature": 1, "humidity": 0, "wind_speed": 1, "pressure": 1, "precipitation_probability": 2}
    return df.withColumns({name: render.number_list(F.col(name), d) for name, d in digits.items()})


@query
def sliding_sequences(spark, sf):
    return rounded(_texts(seq.sliding_sequences(V.observations(spark, sf), order=V.ORDER)))


@query
def horizon_aggregates(spark, sf):
    return rounded(seq.horizon_aggregates(V.observations(spark, sf), order=V.ORDER))


@query
def first_l_per_location(spark, sf):
    return rounded(_texts(seq.first_l_per_location(V.observations(spark, sf), 4, order=V.ORDER)))


@query
def render_prompt(spark, sf):
    w = seq.with_prompt(seq.sliding_sequences(V.observations(spark, sf), order=V.ORDER))
    return w.select("event_id", "prompt")


@query
def render_payload_prompt(spark, sf):
    made = forecasts.payload_forecast(
        V.requests(spark, sf), corpus=V.corpus(spark, sf), position=["datetime", "sample_id"]
    )
    return made.select("request_id", "input_prompt")


@query
def wrap_chat(spark, sf):
    c = V.corpus(spark, sf)
    return c.select(
        "sample_id",
        F.md5(render.chat_serving(F.col("input"))).alias("serving"),
        F.md5(render.chat_training_prompt(F.col("input"))).alias("training_prompt"),
        render.chat_training_response(F.col("target")).alias("training_response"),
    )


@query
def lookup_prompt(spark, sf):
    found = forecasts.lookup_prompt(V.requests(spark, sf), V.corpus(spark, sf), ["datetime", "sample_id"])
    return found.select("request_id", "prompt")


@query
def condition_mix(spark, sf):
    w = seq.with_bulletin(V.windows(spark, sf)).withColumn(
        "condition", labels.condition_class(F.col("avg_precip"), F.col("max_wind"), F.col("avg_humidity"))
    )
    return w.groupBy("condition").agg(
        F.count(F.lit(1)).alias("windows"), r6(F.avg(text.word_count(F.col("target")))).alias("mean_words")
    )


@query
def label_bands(spark, sf):
    w = V.windows(spark, sf)
    return (
        w.withColumns(
            {
                "temp_band": labels.temp_band(F.col("avg_temp")),
                "precip_band": labels.precip_band(F.col("avg_precip")),
                "condition": labels.condition_class(F.col("avg_precip"), F.col("max_wind"), F.col("avg_humidity")),
            }
        )
        .groupBy("temp_band", "precip_band", "condition")
        .agg(F.count(F.lit(1)).alias("windows"))
    )


@query
def templated_bulletin(spark, sf):
    w = seq.with_templated_bulletin(V.windows(spark, sf), order=V.ORDER)
    return w.select("event_id", "target")


@query
def deterministic_bulletin(spark, sf):
    return seq.with_bulletin(V.windows(spark, sf)).select("event_id", "target")


@query
def fallback_sentence(spark, sf):
    made = forecasts.payload_forecast(V.requests(spark, sf))
    return made.select("request_id", "forecast")


# Corpus ---------------------------------------------------------------------


@query
def exact_split(spark, sf):
    return V.split_corpus(spark, sf).select("sample_id", "split")


@query
def training_records(spark, sf):
    return V.corpus(spark, sf)


@query
def corpus_stats(spark, sf):
    return rounded(corpus.corpus_stats(V.split_corpus(spark, sf), by=["split"]))


@query
def corpus_locations(spark, sf):
    return corpus.corpus_locations(V.corpus(spark, sf))


@query
def take_first(spark, sf):
    return corpus.take_first(V.corpus(spark, sf), 25, ["location", "datetime", "sample_id"]).select("sample_id", "target")


@query
def shuffled_batches(spark, sf):
    ids = V.windows(spark, sf).select(F.col("event_id").alias("sample_id"))
    return corpus.shuffled_batches(ids, ["sample_id"], 16)


@query
def concat_example(spark, sf):
    return corpus.concat_example(V.corpus(spark, sf)).select("sample_id", F.md5("text").alias("text_md5"))


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    c = stored(V.corpus(spark, sf).select("sample_id", "prompt", "response"))
    vocab = corpus.build_vocab(c, ["prompt", "response"])
    return corpus.encode_vocab(c, ["sample_id"], {"prompt": "prompt_ids", "response": "response_ids"}, vocab)


@query
def build_vocab(spark, sf):
    return corpus.build_vocab(V.corpus(spark, sf), ["prompt", "response"])


@query
def encode_vocab(spark, sf):
    d = scale.spread(V.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    coded = corpus.encode_vocab(d, ["doc_id"], {"text": "ids"}, corpus.build_vocab(d, ["text"]))
    return coded.select("doc_id", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_md5"))


@query
def response_only_arrays(spark, sf):
    made = corpus.response_only_arrays(_encoded(spark, sf).drop("prompt", "response"), 512, 0)
    return rounded(made.withColumn("trained", F.size(F.filter("labels", lambda x: x != -100))))


@query
def full_sequence_arrays(spark, sf):
    both = _encoded(spark, sf).select("sample_id", F.concat("prompt_ids", "response_ids").alias("ids"))
    return rounded(corpus.full_sequence_arrays(both, 512, 0))


# Text -----------------------------------------------------------------------


@query
def extract_conditions(spark, sf):
    def flat(c: Column, tag: str) -> list[Column]:
        return [
            c["rain"].alias(f"{tag}_rain"),
            c["temperature_range"]["lo"].alias(f"{tag}_lo"),
            c["temperature_range"]["hi"].alias(f"{tag}_hi"),
            c["wind_speed"].alias(f"{tag}_wind"),
        ]

    p = seq.with_templated_bulletin(V.windows(spark, sf), order=V.ORDER)
    p = seq.with_bulletin(p, "plain").withColumns(
        {"_a": extract.extract_conditions(F.col("target")), "_b": extract.extract_conditions(F.col("plain"))}
    )
    return p.select("event_id", *flat(F.col("_a"), "templated"), *flat(F.col("_b"), "plain"))


@query
def reward_features(spark, sf):
    p = seq.with_templated_bulletin(V.windows(spark, sf), order=V.ORDER)
    f = F.col("_f")
    return p.withColumn("_f", extract.reward_features(F.col("target"))).select(
        "event_id",
        f["rain_prediction"].alias("rain"),
        f["temperature_range"]["lo"].alias("lo"),
        f["temperature_range"]["hi"].alias("hi"),
        f["confidence_score"].alias("hedges"),
        f["text_length"].alias("words"),
        f["has_specifics"].alias("specific"),
    )


def _pair_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return V.text_pairs(spark, sf).withColumns(
        {"_g": text.metric_tokens(F.col("answer")), "_r": text.metric_tokens(F.col("question"))}
    )


@query
def overlap_f1(spark, sf):
    p = _pair_tokens(spark, sf)
    return p.select("conv_id", "turn", F.size("_g").alias("tokens"), r6(text.overlap_f1(F.col("_g"), F.col("_r"))).alias("f1"))


@query
def overlap_f1_long(spark, sf):
    return rounded(evaluate.overlap_f1_long(V.document_pairs(spark, sf), ["doc_id"], "text", "next_text"))


@query
def overlap_f1_any(spark, sf):
    return rounded(evaluate.overlap_f1_any(V.document_pairs(spark, sf), ["doc_id"], "text", "next_text", long_words=400))


@query
def rouge_fallback(spark, sf):
    p = _pair_tokens(spark, sf).withColumn("_rouge", text.rouge_fallback(F.col("_g"), F.col("_r")))
    return rounded(p.select("conv_id", "turn", "_rouge.*"))


@query
def rouge_l_lcs(spark, sf):
    g, r = text.rouge_tokens(F.col("answer")), text.rouge_tokens(F.col("question"))
    return V.text_pairs(spark, sf).select("conv_id", "turn", r6(text.rouge_l_lcs(g, r)).alias("rouge_l"))


@query
def rouge_l_long(spark, sf):
    """Every pair in blocks of 16 tokens, so that all of them meet along the front."""
    g, r = text.rouge_tokens(F.col("answer")), text.rouge_tokens(F.col("question"))
    pairs = V.text_pairs(spark, sf).select("conv_id", "turn", g.alias("_g"), r.alias("_r"))
    return rounded(longest.rouge_l_long(pairs, ["conv_id", "turn"], "_g", "_r", block=16))


@query
def bleu4(spark, sf):
    return rounded(evaluate.bleu4_long(_pair_tokens(spark, sf), ["conv_id", "turn"], "_g", "_r"))


@query
def style_metrics(spark, sf):
    p = V.text_pairs(spark, sf)
    g, r = F.col("answer"), F.col("question")
    return p.select(
        "conv_id",
        "turn",
        r6(text.length_similarity(g, r)).alias("length_similarity"),
        r6(text.vocabulary_diversity(g)).alias("vocabulary_diversity"),
        r6(text.readability(g)).alias("readability"),
    )


# Evaluation -----------------------------------------------------------------


@query
def prediction_table(spark, sf):
    made = V.predictions(spark, sf).select("sample_id", "generated_forecast", "wind_term")
    made = made.select(
        "sample_id", F.when(F.col("wind_term") == "winds", F.col("generated_forecast")).alias("generated_forecast")
    )
    test = V.corpus(spark, sf).withColumn(
        "location", F.when(F.col("sample_id") % 5 != 0, F.col("location"))
    )
    return evaluate.prediction_table(test, made).drop("input_prompt")


@query
def evaluate_global(spark, sf):
    return rounded(evaluate.evaluate(V.predictions(spark, sf)))


@query
def evaluate_by_location(spark, sf):
    return rounded(evaluate.evaluate(V.predictions(spark, sf), by=["location"]))


@query
def evaluate_rollup(spark, sf):
    return rounded(evaluate.evaluate(V.predictions(spark, sf), by=["wind_term", "band"], rollup=True))


@query
def brier_score(spark, sf):
    return rounded(evaluate.brier_score(V.probabilities(spark, sf), by=["toxic"]))


@query
def recommendations(spark, sf):
    m = evaluate.evaluate(V.predictions(spark, sf), by=["band"])
    return rounded(evaluate.recommendations(m).select("band", "verdict", "flags"))


@query
def evaluation_report(spark, sf):
    m = evaluate.evaluate(V.predictions(spark, sf), by=["band"])
    return evaluate.render_report(m, "2024-02-01 00:00:00").select("band", "report")


# Reward ---------------------------------------------------------------------


@query
def reward_components(spark, sf):
    scored = rewards.composite_reward(V.predictions(spark, sf), "generated_forecast", "observed")
    return rounded(
        scored.select(
            "sample_id", "accuracy_reward", "style_reward", "calibration_reward", "factual_consistency", "total_reward"
        )
    )


@query
def weighted_reward(spark, sf):
    p = V.predictions(spark, sf)
    seen = p.where("observed.rain").select("sample_id", "observed.*")
    weights = {"accuracy": 2.0, "style": 1.0, "calibration": 1.0, "consistency": 4.0}
    scored = rewards.composite_reward(
        rewards.join_observed(p.drop("observed"), seen, ["sample_id"]), "generated_forecast", "observed", weights
    )
    return scored.groupBy("location").agg(r6(F.avg("total_reward")).alias("mean_total"))


@query
def mean_reward(spark, sf):
    return rounded(rewards.mean_reward(V.corpus(spark, sf), None, ["sample_id"], by=["location"]))


@query
def mean_reward_first(spark, sf):
    return rounded(rewards.mean_reward(V.corpus(spark, sf), 16, ["location", "datetime", "sample_id"]))


@query
def training_guards(spark, sf):
    p = V.predictions(spark, sf).withColumn("tokens", text.word_count(F.col("generated_forecast")))
    scored = rewards.composite_reward(p, "generated_forecast", "observed").select(
        F.floor(F.col("sample_id") / 16).alias("batch"),
        F.when(F.col("sample_id") % 211 == 0, 1).otherwise(F.col("tokens")).alias("tokens"),
        F.when(F.col("sample_id") % 199 == 0, float("nan")).otherwise(F.col("total_reward")).alias("total_reward"),
    )
    return rewards.training_guards(scored)


@query
def reward_range_check(spark, sf):
    return rewards.reward_range_check(
        rewards.composite_reward(V.predictions(spark, sf), "generated_forecast", "observed")
    )


# Candidates and forecasts -----------------------------------------------------


@query
def best_candidate(spark, sf):
    return candidates.best_candidate(V.candidate_texts(spark, sf))


@query
def consistency_confidence(spark, sf):
    return rounded(candidates.consistency_confidence(V.candidate_texts(spark, sf)))


@query
def parse_requests(spark, sf):
    good, bad = forecasts.parse_requests(V.requests(spark, sf))
    both = good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)
    return both.select("request_id", "forecast_horizon", "include_confidence", "reason")


@query
def batch_forecast(spark, sf):
    good, bad = forecasts.parse_requests(V.requests(spark, sf))
    made_at = F.to_timestamp(F.lit(MADE_AT))
    return rounded(forecasts.batch_forecast(good, V.observations(spark, sf), made_at, order=V.ORDER, rejected=bad))


def echo_generator(prompts: list[str]) -> list[list[str]]:
    """Three texts per prompt from its first lines; one kind of prompt fails."""
    out = []
    for p in prompts:
        lines = p.split("\n")
        if lines[0].startswith("Weather data for loc_13 "):
            raise ValueError("station is down")
        out.append([lines[1], lines[1] + " " + lines[2], lines[3]])
    return out


@query
def batch_forecast_python(spark, sf):
    good, bad = forecasts.parse_requests(V.requests(spark, sf))
    made_at = F.to_timestamp(F.lit(MADE_AT))
    return rounded(
        forecasts.batch_forecast(
            good, V.observations(spark, sf), made_at, generator=echo_generator, order=V.ORDER, rejected=bad
        )
    )


@query
def response_table(spark, sf):
    good, bad = forecasts.parse_requests(V.requests(spark, sf))
    both = good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)
    made = both.select(
        "request_id",
        "name",
        "forecast_horizon",
        "include_confidence",
        render.fallback_sentence(F.col("city"), F.col("weather_data")).alias("forecast_text"),
        ((F.col("request_id") % 10).cast("double") / 10.0).alias("confidence_score"),
        F.coalesce("reason", F.when(F.col("weather_data").isNull(), F.lit("no payload"))).alias("error"),
    )
    made_at = F.timestamp_micros(F.lit(1_706_769_000_000_000) + F.col("request_id") * 500_000)
    return rounded(forecasts.response_table(made, made_at))


# Gate -----------------------------------------------------------------------


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    p = stored(V.predictions(spark, sf))
    made = files.normalize_predictions(V.prediction_records(p), F.col("position"))
    return gate.gate_rows(gate.attach_predictions(V.quality_cases(p), made))


@query
def normalize_predictions(spark, sf):
    return files.normalize_predictions(V.prediction_records(V.predictions(spark, sf)), F.col("position"))


@query
def gate_rows(spark, sf):
    return rounded(_gated(spark, sf).drop("required_terms", "forbidden_patterns", "observed_weather"))


@query
def gate_report(spark, sf):
    return rounded(gate.gate_report(_gated(spark, sf), by=["location"]))


# Metric tables ----------------------------------------------------------------


@query
def namespace_metrics(spark, sf):
    logs = V.metric_maps(spark, sf)
    wide = logs.select(
        "event_id",
        "step",
        F.col("logs")["eval_loss"].alias("loss"),
        F.when(F.col("step") != 7, F.col("logs")["eval_pre_eval_mae"]).alias("grad_norm"),
        F.col("step").alias("train/epoch"),
    )
    return rounded(metriclog.namespace_metrics(wide, "train", ["event_id", "step"]))


@query
def route_log_rows(spark, sf):
    logs = V.metric_maps(spark, sf).withColumn("logs", F.map_filter("logs", lambda k, v: ~F.isnan(v)))
    finite = logs.withColumn("logs", F.map_filter("logs", lambda k, v: v < 1e300))
    return rounded(metriclog.route_log_rows(finite, ["event_id", "run", "step"]))


@query
def sample_table(spark, sf):
    p = V.predictions(spark, sf).withColumn("input_prompt", F.concat_ws(" ", "location", "datetime"))
    return metriclog.sample_table(p, ["sample_id"], 10)


@query
def evaluation_log(spark, sf):
    m = evaluate.evaluate(V.predictions(spark, sf), by=["band"])
    return rounded(metriclog.evaluation_log(m, ["band"]))


@query
def every_nth(spark, sf):
    routed = metriclog.route_log_rows(V.metric_maps(spark, sf), ["event_id", "run", "step"])
    return metriclog.every_nth(routed, 10).groupBy("run", "step", "key").agg(F.count(F.lit(1)).alias("rows"))


@query
def non_finite_by_key(spark, sf):
    return metriclog.non_finite_by_key(metriclog.route_log_rows(V.metric_maps(spark, sf), ["run", "step"]))


@query
def run_health(spark, sf):
    log = metriclog.route_log_rows(V.metric_maps(spark, sf), ["run", "step"])
    return metriclog.run_health(log, V.attempted_steps(spark, sf))
