"""The quality gate over pinned cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratocast.functions.text import word_count
from stratocast.operators.evaluate import row_overall, score_rows
from stratocast.operators.rewards import composite_reward

# What a case needs to pass.
MIN_OVERALL = 0.35
MIN_REWARD = 0.55
WORDS = (8, 55)


def attach_predictions(cases: DataFrame, predictions: DataFrame | None = None) -> DataFrame:
    """The prediction of each case, else its reference text."""
    reference = F.col("reference_forecast")
    if predictions is None:
        return cases.withColumn("generated_forecast", reference)
    made = predictions.select("id", F.col("generated_forecast").alias("_made"))
    return cases.join(made, "id", "left").withColumn("generated_forecast", F.coalesce("_made", reference)).drop("_made")


def _terms(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def required_terms_found(text: Column, terms: Column) -> Column:
    low = F.lower(text)
    return F.filter(terms, lambda term: F.contains(low, F.lower(term)))


def forbidden_found(text: Column, patterns: Column) -> Column:
    """Patterns found in the text, whatever its case.

    Patterns are data in regular expression syntax and must stay in the part
    that Java and other engines share.
    """
    return F.filter(patterns, lambda p: F.regexp_like(text, F.concat(F.lit("(?i)"), p)))


def gate_rows(cases: DataFrame) -> DataFrame:
    """Score every case with a generated text and decide whether it passes.

    A case without required terms never passes.
    """
    text = F.col("generated_forecast")
    scored = score_rows(cases).withColumn("overall_score", row_overall())
    rewarded = composite_reward(scored, "generated_forecast", "observed_weather")
    found = rewarded.withColumns(
        {
            "required_terms_found": required_terms_found(text, _terms("required_terms")),
            "forbidden_patterns_found": forbidden_found(text, _terms("forbidden_patterns")),
            "word_count": word_count(text),
        }
    )
    needed = F.greatest(F.lit(1), F.size(_terms("required_terms")) - 1)
    passed = (
        (F.col("overall_score") >= MIN_OVERALL)
        & (F.col("total_reward") >= MIN_REWARD)
        & (F.size("required_terms_found") >= needed)
        & (F.size("forbidden_patterns_found") == 0)
        & F.col("word_count").between(*WORDS)
    )
    return found.select(
        *[c for c in cases.columns if c not in ("generated_forecast", "reference_forecast", "input")],
        passed.alias("passed"),
        "overall_score",
        F.col("total_reward").alias("reward"),
        "required_terms_found",
        "forbidden_patterns_found",
        "word_count",
    )


def gate_report(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cases, passed and pass rate per group."""
    passed = F.count_if(F.col("passed"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"),
        passed.alias("passed"),
        (passed / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("pass_rate"),
    )


def failing_cases(rows: DataFrame) -> DataFrame:
    """The cases that do not pass, as rows."""
    return rows.where(~F.col("passed"))


def require_pass(report: DataFrame) -> None:
    """Raise unless every group passed in full."""
    bad = report.where((F.col("cases") == 0) | (F.col("passed") < F.col("cases"))).limit(1).collect()
    if bad:
        raise RuntimeError(f"quality gate failed: {bad[0].asDict()}")
