"""Experiment metrics as long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratocast.operators.corpus import take_first

# Message parts of errors that end a run.
FATAL_MARKERS = ["device-side assert", "cuda error", "probability tensor contains", "nan", "inf", "non-finite"]
# Metrics of each family.
NLG = ["bleu_score", "rouge_1_f", "rouge_2_f", "rouge_l_f"]
EVAL = [
    "readability_score",
    "length_similarity",
    "vocabulary_diversity",
    "overall_score",
    "confidence_interval_low",
    "confidence_interval_high",
]
WEATHER = {
    "temperature_mae": "temperature_mae",
    "temperature_accuracy": "categorical_accuracy",
    "wind_speed_mae": "wind_speed_mae",
    "precipitation_accuracy": "rain_accuracy",
    "categorical_accuracy": "categorical_accuracy",
}


def namespace_metrics(
    wide: DataFrame, namespace: str, keys: Sequence[str] = ("step",), always_prefix: bool | None = None
) -> DataFrame:
    """Wide metrics to rows (keys, key, value) under 'namespace/'; NULL metrics are left out.

    A metric that already has the prefix keeps it, except in the 'eval'
    family, where the prefix is always added.
    """
    always = namespace == "eval" if always_prefix is None else always_prefix
    prefix = f"{namespace}/"
    metrics = [c for c in wide.columns if c not in keys]
    named = wide.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in metrics])
    long = named.unpivot(list(keys), [F.col(f"`{c}`") for c in metrics], "key", "value")
    full = F.concat(F.lit(prefix), F.col("key"))
    if not always:
        full = F.when(F.col("key").startswith(prefix), F.col("key")).otherwise(full)
    return long.withColumn("key", full).where(F.col("value").isNotNull())


def route_log_rows(logs: DataFrame, keys: Sequence[str] = ("step",), logged: str = "logs") -> DataFrame:
    """Map entries to rows: keys starting 'eval_' go to eval/ without any 'eval_', others to train/."""
    entries = logs.select(*keys, F.explode(logged).alias("_key", "value"))
    routed = F.when(
        F.col("_key").startswith("eval_"), F.concat(F.lit("eval/"), F.replace("_key", F.lit("eval_"), F.lit("")))
    ).otherwise(F.concat(F.lit("train/"), F.col("_key")))
    return entries.select(*keys, routed.alias("key"), "value")


def sample_table(pred: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """The first n rows as Input / Prediction / Reference."""
    return take_first(pred, n, order).select(
        F.col("input_prompt").alias("Input"),
        F.col("generated_forecast").alias("Prediction"),
        F.col("reference_forecast").alias("Reference"),
    )


def evaluation_log(metrics: DataFrame, keys: Sequence[str] = ("step",)) -> DataFrame:
    """Evaluation rows to nlg/, weather/ and eval/ metric rows."""
    nlg = namespace_metrics(metrics.select(*keys, *NLG), "nlg", keys)
    weather = namespace_metrics(
        metrics.select(*keys, *[F.col(c).alias(name) for name, c in WEATHER.items()]), "weather", keys
    )
    evaluation = namespace_metrics(metrics.select(*keys, *EVAL), "eval", keys)
    return nlg.unionByName(weather).unionByName(evaluation)


def every_nth(log: DataFrame, n: int = 10, step: str = "step") -> DataFrame:
    return log.where(F.col(step) % n == 0)


def _not_finite(value: Column) -> Column:
    return F.isnan(value) | (F.abs(value) == F.lit(float("inf")))


def non_finite_by_key(log: DataFrame, run: str = "run") -> DataFrame:
    """Non-finite values per run and metric."""
    return (
        log.where(_not_finite(F.col("value"))).groupBy(run, "key").agg(F.count(F.lit(1)).alias("non_finite"))
    )


def is_fatal(message: Column) -> Column:
    low = F.lower(message)
    hits = [F.contains(low, F.lit(m)) for m in FATAL_MARKERS]
    found = hits[0]
    for h in hits[1:]:
        found = found | h
    return F.coalesce(found, F.lit(False))


def run_health(log: DataFrame, steps: DataFrame, run: str = "run", error: str = "error") -> DataFrame:
    """Per run: non-finite values, ok and failed steps, fatal errors; no ok step is a failed run.

    `log` has (run, key, value), `steps` one row per attempted step with its
    error message or NULL.
    """
    values = log.groupBy(run).agg(
        F.count(F.lit(1)).alias("values"), F.count_if(_not_finite(F.col("value"))).alias("non_finite")
    )
    attempts = steps.groupBy(run).agg(
        F.count_if(F.col(error).isNull()).alias("ok_steps"),
        F.count_if(F.col(error).isNotNull()).alias("failed_steps"),
        F.count_if(is_fatal(F.col(error))).alias("fatal_errors"),
    )
    counts = ["values", "non_finite", "ok_steps", "failed_steps", "fatal_errors"]
    joined = values.join(attempts, run, "full_outer").na.fill(0, counts)
    return joined.withColumn("failed", F.col("ok_steps") == 0)
