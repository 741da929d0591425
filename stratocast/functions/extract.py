"""Rain, temperature and wind read out of forecast prose.

Two rule sets live here on purpose: the evaluation rules and the reward rules
differ in their pattern lists and must stay apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratocast.functions.text import bind, even_space, word_count

# Evaluation patterns.
RAIN = [
    r"\b(?:rain|showers?|precipitation|wet|drizzle)\b",
    r"\b(?:stormy?|thunderstorms?)\b",
    r"\b(?:downpours?|cloudbursts?)\b",
]
CLEAR = [
    r"\b(?:clear|sunny|bright|fair)\b",
    r"\b(?:no rain|dry|arid)\b",
]
CHANCE = r"(\d+)%\s*(?:chance|probability|likelihood)"
TEMPERATURE = [
    r"(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)\s*°?[CF]",
    r"(?:around|near|about)\s+(\d+(?:\.\d+)?)\s*°?[CF]",
    r"(?:highs?|temperatures?)\s+(?:of\s+)?(\d+(?:\.\d+)?)\s*°?[CF]",
    r"(\d+(?:\.\d+)?)\s*°?[CF]",
]
WIND = [
    r"(?:winds?|gusts?)\s+(?:up\s+to\s+|reaching\s+)?(\d+(?:\.\d+)?)\s*(?:km/h|mph|kph)",
    r"(\d+(?:\.\d+)?)\s*(?:km/h|mph|kph)\s+winds?",
    r"windy\s+with\s+(?:speeds?\s+)?(?:up\s+to\s+)?(\d+(?:\.\d+)?)",
]

# Reward patterns.
REWARD_RAIN = [
    r"\b(?:rain|showers?|precipitation|wet|drizzle|storms?)\b",
    r"\b(?:cloudy|overcast|grey|gray)\b",
]
REWARD_CLEAR = [
    r"\b(?:clear|sunny|bright|fair|dry)\b",
    r"\b(?:no rain|cloudless)\b",
]
REWARD_TEMPERATURE = TEMPERATURE[:2]
# A text without any of a pattern's literals cannot match it, and a search for literals costs a fraction of a regex.
# \s is a plain blank in these texts, as they went through even_space.
LITERALS = {
    RAIN[0]: ["rain", "shower", "precipitation", "wet", "drizzle"],
    RAIN[1]: ["storm"],
    RAIN[2]: ["downpour", "cloudburst"],
    CLEAR[0]: ["clear", "sunny", "bright", "fair"],
    CLEAR[1]: ["no rain", "dry", "arid"],
    CHANCE: ["%"],
    TEMPERATURE[0]: ["-", "–"],
    TEMPERATURE[1]: ["around ", "near ", "about "],
    TEMPERATURE[2]: ["high", "temperature"],
    WIND[0]: ["km/h", "mph", "kph"],
    WIND[1]: ["km/h ", "mph ", "kph "],
    WIND[2]: ["windy "],
    REWARD_RAIN[0]: ["rain", "shower", "precipitation", "wet", "drizzle", "storm"],
    REWARD_RAIN[1]: ["cloudy", "overcast", "grey", "gray"],
    REWARD_CLEAR[0]: ["clear", "sunny", "bright", "fair", "dry"],
    REWARD_CLEAR[1]: ["no rain", "cloudless"],
}
HEDGES = ["likely", "expected", "probable", "certain", "possible", "may", "might", "could"]


def _may_match(text: Column, pattern: str) -> Column:
    """False where `text` holds none of the pattern's literals."""
    found = [F.contains(text, F.lit(literal)) for literal in LITERALS.get(pattern, [""])]
    return reduce(Column.__or__, found)


def _score(text: Column, patterns: list[str]) -> Column:
    # (?U): word boundaries follow Unicode letters, whatever the Java version.
    hits = [(_may_match(text, p) & F.rlike(text, F.lit("(?U)" + p))).cast("int") for p in patterns]
    return sum(hits[1:], hits[0])


def _verdict(rain: Column, clear: Column) -> Column:
    # Looked up by sign, so that both scores are computed once.
    outcomes = F.array(F.lit(False), F.lit(None).cast("boolean"), F.lit(True))
    return F.get(outcomes, F.signum(rain - clear).cast("int") + 1)


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.when(_may_match(text, pattern), F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))).cast("double")


def rain_signal(text: Column) -> Column:
    """True for rain, False for clear, NULL when the text does not decide."""
    low = F.lower(even_space(text))
    # Any digit count: compare as double, an overlong number is simply large.
    chance = _number(low, CHANCE)
    wet = F.when(chance >= 50, F.lit(2)).otherwise(F.lit(0))
    dry = F.when(chance <= 20, F.lit(2)).otherwise(F.lit(0))
    return _verdict(_score(low, RAIN) + wet, _score(low, CLEAR) + dry)


def _range(text: Column, patterns: list[str]) -> Column:
    low, high = (F.regexp_extract(text, patterns[0], group).cast("double") for group in (1, 2))  # never empty in a match
    first = F.when(
        _may_match(text, patterns[0]) & F.rlike(text, F.lit(patterns[0])), F.struct(low.alias("lo"), high.alias("hi"))
    )
    single = F.coalesce(*[_number(text, p) for p in patterns[1:]])
    around = bind(
        single, lambda t: F.when(t.isNotNull(), F.struct((t - 2.0).alias("lo"), (t + 2.0).alias("hi")))
    )
    return F.coalesce(first, around)


def temperature_range(text: Column) -> Column:
    """STRUCT<lo, hi> as written, or two degrees around a single value.

    Signs are not read and the bounds may be in either order.
    """
    return _range(even_space(text), TEMPERATURE)


def wind_speed(text: Column) -> Column:
    """First wind number; the unit is kept as written."""
    low = F.lower(even_space(text))
    return F.coalesce(*[_number(low, p) for p in WIND])


def extract_conditions(text: Column) -> Column:
    return F.struct(
        rain_signal(text).alias("rain"),
        temperature_range(text).alias("temperature_range"),
        wind_speed(text).alias("wind_speed"),
    )


def midpoint(bounds: Column) -> Column:
    return (bounds["lo"] + bounds["hi"]) / 2.0


def reward_features(text: Column) -> Column:
    """Struct of the features the reward rules read."""
    text = even_space(text)
    low = F.lower(text)
    rain = _verdict(_score(low, REWARD_RAIN), _score(low, REWARD_CLEAR))
    bounds = _range(text, REWARD_TEMPERATURE)
    hedges = [F.contains(low, F.lit(h)).cast("int") for h in HEDGES]
    return F.struct(
        rain.alias("rain_prediction"),
        bounds.alias("temperature_range"),
        sum(hedges[1:], hedges[0]).alias("confidence_score"),
        word_count(text).alias("text_length"),
        ((bounds.isNotNull().cast("int") + rain.isNotNull().cast("int")) > 0).alias("has_specifics"),
    )
