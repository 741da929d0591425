"""Requests to forecasts: parsing, prompt lookup, generation, responses."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratocast.functions.render import (
    PROMPT_HEAD,
    chat_serving,
    fallback_sentence,
    has_payload,
    render_payload_prompt,
    render_prompt,
)
from stratocast.functions.text import SPACE_CLASS as SPACE
from stratocast.operators import candidates
from stratocast.operators.scale import skew_join
from stratocast.operators.sequences import SERIES, first_l_per_location, with_persistence_bulletin

# Request defaults, error text and the fallback weather profiles.
HORIZON_HOURS = 6
ERROR_PREFIX = "Error generating forecast: "
NO_DATA = "No weather data available for "
PROFILES = {
    "nairobi": {
        "temperature": [24.0, 25.3, 24.8, 23.6],
        "humidity": [56.0, 60.0, 64.0, 68.0],
        "wind_speed": [11.0, 13.5, 15.0, 12.2],
        "pressure": [1015.0, 1014.6, 1014.2, 1014.5],
        "precipitation_probability": [0.10, 0.15, 0.20, 0.25],
    },
    "new york": {
        "temperature": [18.3, 18.0, 17.7, 17.6],
        "humidity": [66.0, 75.0, 79.0, 79.0],
        "wind_speed": [14.8, 5.2, 10.4, 13.0],
        "pressure": [1020.0, 1019.4, 1019.4, 1019.5],
        "precipitation_probability": [0.00, 0.00, 0.00, 0.00],
    },
}
DEFAULT_PROFILE = "nairobi"
LOCAL_TIME = "current local conditions"

Generator = Callable[[list[str]], Iterable[Sequence[str]]]


def profile_table(spark: SparkSession) -> DataFrame:
    rows = [(key, *[values[name] for name in SERIES]) for key, values in PROFILES.items()]
    return spark.createDataFrame(rows, "key string, " + ", ".join(f"{name} array<double>" for name in SERIES))


def parse_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with `reason`); horizon and confidence get their defaults."""
    reason = F.coalesce(
        *[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in ("name", "latitude", "longitude")]
    )

    def given(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)

    tagged = df.withColumns(
        {
            "reason": reason,
            "forecast_horizon": given("forecast_horizon", HORIZON_HOURS),
            "include_confidence": given("include_confidence", True),
        }
    )
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def _stripped(city: Column) -> Column:
    return F.regexp_replace(city, f"^{SPACE}+|{SPACE}+$", "")


def _city_key(city: Column) -> Column:
    return F.lower(_stripped(city))


def first_prompts(corpus: DataFrame, position: Sequence[str], location: str = "location", prompt: str = "input"):
    """The first prompt of every location in corpus order, keyed by the trimmed lower-case name."""
    order = F.struct(*position)
    return (
        corpus.where(F.col(prompt) != "")
        .withColumn("city_key", _city_key(F.col(location)))
        .where(F.col("city_key") != "")
        .groupBy("city_key")
        .agg(F.min_by(prompt, order).alias("known_prompt"))
    )


def lookup_prompt(
    requests: DataFrame,
    corpus: DataFrame,
    position: Sequence[str],
    city: str = "city",
    name: str = "prompt",
    chat: bool = True,
) -> DataFrame:
    """Prompt of a city: its first corpus prompt, else its profile, else the default profile.

    Popular cities meet their prompt by broadcast, the others by a shuffle.
    The two-row profile table is inlined.
    """
    keyed = requests.withColumn("city_key", _city_key(F.col(city)))
    known = skew_join(keyed, first_prompts(corpus, position), "city_key")

    def from_profile(key: str) -> Column:
        series = [F.array(*[F.lit(v) for v in PROFILES[key][s]]) for s in SERIES]
        return render_prompt(_stripped(F.col(city)), F.lit(LOCAL_TIME), *series)

    profile = F.lit(None).cast("string")
    for key in PROFILES:
        if key != DEFAULT_PROFILE:
            profile = F.when(F.col("city_key") == key, from_profile(key)).otherwise(profile)
    prompt = F.coalesce(F.col("known_prompt"), profile, from_profile(DEFAULT_PROFILE))
    return known.withColumn(name, chat_serving(prompt) if chat else prompt).select(*requests.columns, name)


def payload_forecast(
    requests: DataFrame,
    city: str = "city",
    payload: str = "weather_data",
    corpus: DataFrame | None = None,
    position: Sequence[str] = (),
) -> DataFrame:
    """Prompt and one-sentence forecast from the payload of each request.

    With a `corpus`, a request without payload gets the prompt of its city.
    """
    data = F.col(payload)
    prompt = F.when(has_payload(data), render_payload_prompt(F.col(city), data))
    known = requests if corpus is None else lookup_prompt(requests, corpus, position, city, "_known")
    return known.withColumns(
        {
            "input_prompt": prompt if corpus is None else F.coalesce(prompt, F.col("_known")),
            "forecast": fallback_sentence(F.col(city), data),
        }
    ).drop("_known")


def generate(df: DataFrame, generator: Generator, prompt: str = "prompt") -> DataFrame:
    """Add `candidates` (texts per prompt) and `error` from a caller's batch function.

    The function gets a list of prompts and returns one sequence of texts per
    prompt. It runs on Arrow batches; when a batch fails, its rows are tried
    one by one, so only the failing rows carry an error.
    """
    schema = T.StructType(
        [*df.schema.fields, T.StructField("candidates", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())]
    )

    def attempt(prompts: list[str]) -> list[tuple[list[str] | None, str | None]]:
        try:
            made = [list(texts) for texts in generator(prompts)]
            if len(made) != len(prompts):
                raise ValueError(f"{len(made)} results for {len(prompts)} prompts")
            return [(texts, None) for texts in made]
        except Exception as failure:  # the caller's code may raise anything
            if len(prompts) == 1:
                return [(None, str(failure))]
            return [attempt([p])[0] for p in prompts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ready = batch[prompt].notna()
            results: list = [(None, None)] * len(batch)
            made = iter(attempt(batch.loc[ready, prompt].tolist()) if ready.any() else [])
            for i, ok in enumerate(ready):
                if ok:
                    results[i] = next(made)
            yield batch.assign(
                candidates=pd.Series([r[0] for r in results], index=batch.index, dtype=object),
                error=pd.Series([r[1] for r in results], index=batch.index, dtype=object),
            )

    return df.mapInPandas(run, schema)


def batch_forecast(
    requests: DataFrame,
    obs: DataFrame,
    generated_at: Column,
    generator: Generator | None = None,
    order: Sequence[str] = ("datetime",),
    length: int = 4,
    model_version: str = "latest",
    rejected: DataFrame | None = None,
) -> DataFrame:
    """One response per request; a failing request becomes an error row.

    So do `rejected` ones (see `parse_requests`), with their reason.

    Inputs are the first rows of the request's location. Without a generator
    the text is the bulletin that the inputs persist. `requests` must be
    parsed; `generated_at` is a parameter so that a rerun gives the same rows.
    """
    inputs = first_l_per_location(obs, length, order=order).drop(order[0])
    when = F.date_format(generated_at, "yyyy-MM-dd HH:mm 'UTC'")
    joined = skew_join(requests, inputs.withColumnRenamed("location_name", "name"), "name")
    missing = F.col("temperature").isNull()
    prompted = joined.withColumn(
        "prompt", F.when(~missing, render_prompt(F.col("name"), when, *[F.col(c) for c in SERIES]))
    )
    if generator is None:
        made = with_persistence_bulletin(prompted, "_text").withColumns(
            {
                "candidates": F.when(~missing, F.array("_text")),
                "error": F.lit(None).cast("string"),
            }
        )
    else:
        made = generate(prompted.drop(*SERIES), generator)
    no_data = F.when(F.col("prompt").isNull(), F.concat(F.lit(NO_DATA), F.col("name")))
    no_text = F.when(F.coalesce(F.size("candidates"), F.lit(0)) <= 0, F.lit("no text generated"))
    chosen = made.withColumns(
        {
            "error": F.coalesce(no_data, F.col("error"), no_text),
            "forecast_text": candidates.best_of(F.transform("candidates", lambda t: F.trim(t))),
            "confidence_score": candidates.agreement_of(F.col("candidates")),
        }
    )
    carried = [c for c in requests.columns if c == "request_id"]
    out = response_table(chosen, generated_at, model_version, carried)
    return out if rejected is None else out.unionByName(rejected_responses(rejected, generated_at, model_version, carried))


def rejected_responses(
    rejected: DataFrame, generated_at: Column, model_version: str = "latest", carried: Sequence[str] = ("request_id",)
) -> DataFrame:
    """An error row for each request that could not be parsed."""
    none = F.lit(None)
    made = rejected.withColumns(
        {"error": F.col("reason"), "forecast_text": none.cast("string"), "confidence_score": none.cast("double")}
    )
    return response_table(made, generated_at, model_version, carried)


def iso_time(ts: Column) -> Column:
    """ISO text; the fraction only when there is one."""
    fraction = F.when(F.unix_micros(ts) % 1_000_000 != 0, F.date_format(ts, ".SSSSSS")).otherwise("")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction)


def response_table(
    df: DataFrame, generated_at: Column, model_version: str = "latest", carried: Sequence[str] = ("request_id",)
) -> DataFrame:
    """Responses from name, forecast_horizon, include_confidence, forecast_text, confidence_score, error.

    Confidence is NULL unless requested; an error row has confidence 0 and is
    valid until it was made.
    """
    failed = F.col("error").isNotNull()
    made = generated_at.cast("timestamp")
    until = F.timestamp_micros(
        F.unix_micros(made)
        + F.when(failed, F.lit(0)).otherwise(F.col("forecast_horizon")).cast("bigint") * F.lit(3_600_000_000)
    )
    return df.select(
        *carried,
        F.when(failed, "error").otherwise("success").alias("status"),
        F.when(failed, F.concat(F.lit(ERROR_PREFIX), F.col("error"))).otherwise(F.col("forecast_text")).alias("forecast"),
        F.when(failed, F.lit(0.0))
        .when(F.coalesce(F.col("include_confidence"), F.lit(True)), F.col("confidence_score"))
        .alias("confidence"),
        F.col("name").alias("location"),
        iso_time(made).alias("generated_at"),
        iso_time(until).alias("valid_until"),
        F.lit(model_version).alias("model_version"),
    )
