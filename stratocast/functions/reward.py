"""Row-level reward components of a forecast text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratocast.functions.text import even_space, word_count

# Default weights and the terms of professional style.
WEIGHTS = {"accuracy": 0.4, "style": 0.2, "calibration": 0.2, "consistency": 0.2}
STYLE_TERMS = [
    "temperature",
    "humidity",
    "wind",
    "pressure",
    "precipitation",
    "showers",
    "conditions",
    "forecast",
    "expected",
    "likely",
]


def normalize_weights(
    accuracy: float = WEIGHTS["accuracy"],
    style: float = WEIGHTS["style"],
    calibration: float = WEIGHTS["calibration"],
    consistency: float = WEIGHTS["consistency"],
) -> dict[str, float]:
    """The four weights divided by their sum."""
    total = accuracy + style + calibration + consistency
    return {
        "accuracy": accuracy / total,
        "style": style / total,
        "calibration": calibration / total,
        "consistency": consistency / total,
    }


def accuracy_reward(features: Column, observed: Column) -> Column:
    """Mean over the checks both sides allow; 0.5 when there is none.

    `observed` is STRUCT<rain, temperature> with NULL for an absent field.
    """
    rain_check = F.when(
        features["rain_prediction"].isNotNull() & observed["rain"].isNotNull(),
        F.when(features["rain_prediction"] == observed["rain"], F.lit(1.0)).otherwise(F.lit(-0.5)),
    )
    lo, hi = features["temperature_range"]["lo"], features["temperature_range"]["hi"]
    seen = observed["temperature"]
    error = F.abs(seen - (lo + hi) / 2.0)
    temp_check = F.when(
        lo.isNotNull() & seen.isNotNull(),
        F.when((lo <= seen) & (seen <= hi), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.nanvl(F.lit(1.0) - error / 10.0, F.lit(0.0)))),
    )
    checks = rain_check.isNotNull().cast("int") + temp_check.isNotNull().cast("int")
    total = F.coalesce(rain_check, F.lit(0.0)) + F.coalesce(temp_check, F.lit(0.0))
    return F.when(checks > 0, F.greatest(F.lit(0.0), total / F.nullif(checks, F.lit(0)))).otherwise(F.lit(0.5))


def style_reward(text: Column, n: Column | None = None) -> Column:
    n = word_count(text) if n is None else n
    length = (
        F.when(n < 10, n / 10.0)
        .when(n > 50, F.greatest(F.lit(0.0), F.lit(1.0) - (n - 50) / 50.0))
        .otherwise(F.lit(1.0))
    )
    low = F.lower(text)
    hits = [F.contains(low, F.lit(t)).cast("int") for t in STYLE_TERMS]
    terms = F.least(F.lit(1.0), sum(hits[1:], hits[0]) / 5.0)
    tail = F.right(F.rtrim(even_space(text)), F.lit(1))
    closed = tail.isin(".", "!", "?")
    structure = (
        F.lit(1.0)
        - F.when(closed, F.lit(0.0)).otherwise(F.lit(0.2))
        - F.when(F.contains(text, F.lit(".")), F.lit(0.0)).otherwise(F.lit(0.3))
    )
    score = F.lit(0.4) * length + F.lit(0.4) * terms + F.lit(0.2) * structure
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def calibration_reward(features: Column) -> Column:
    c = features["confidence_score"]
    return (
        F.when((c >= 1) & (c <= 3), F.lit(1.0))
        .when(c == 0, F.lit(0.7))
        .otherwise(F.greatest(F.lit(0.3), F.lit(1.0) - (c - 3) * F.lit(0.2)))
    )


def consistency_reward(features: Column) -> Column:
    """1.0 with specifics, else 0.5; one text never holds both rain verdicts."""
    return F.when(features["has_specifics"], F.lit(1.0)).otherwise(F.lit(0.5))


def composite_reward(
    text: Column, features: Column, observed: Column | None = None, weights: dict[str, float] | None = None
) -> Column:
    """Struct of the four components and the weighted total.

    Accuracy is 0.5 when nothing was observed.
    """
    w = normalize_weights(**(weights or {}))
    accuracy = F.lit(0.5) if observed is None else F.coalesce(accuracy_reward(features, observed), F.lit(0.5))
    style = style_reward(text, features["text_length"])
    calibration, consistency = calibration_reward(features), consistency_reward(features)
    total = (
        F.lit(w["accuracy"]) * accuracy
        + F.lit(w["style"]) * style
        + F.lit(w["calibration"]) * calibration
        + F.lit(w["consistency"]) * consistency
    )
    return F.struct(
        accuracy.alias("accuracy_reward"),
        style.alias("style_reward"),
        calibration.alias("calibration_reward"),
        consistency.alias("factual_consistency"),
        total.alias("total_reward"),
    )
