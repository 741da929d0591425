"""Numbers as text, prompts and chat markup."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prompt lines.
PROMPT_HEAD = "Weather data for "
PROMPT_LINES = [
    ("\n- Temperature (°C): ", "temperature", 1),
    ("\n- Humidity (%): ", "humidity", 0),
    ("\n- Wind speed (km/h): ", "wind_speed", 1),
    ("\n- Pressure (hPa): ", "pressure", 1),
    ("\n- Precipitation probability: ", "precipitation_probability", 2),
]
PROMPT_TAIL = "\n\nGenerate a forecast bulletin:"
CHAT_OPEN = "<|user|>\n"
CHAT_TURN = "</s>\n<|assistant|>\n"
CHAT_END = "</s>"
SERVING_INSTRUCTION = (
    "\n\nWrite only a concise natural-language forecast bulletin. Do not repeat the input weather variables."
)
PROMPT_TIME = "yyyy-MM-dd HH:mm 'UTC'"

# 2**27 + 1 splits a double into two halves whose products are exact.
_SPLIT = 134217729.0


def fixed_text(value: Column, digits: int) -> Column:
    """A double with a fixed number of decimals, rounded as printf rounds.

    format_string rounds the shortest decimal text half up, so 0.25 and 0.35
    come out wrong at one digit. Here the scaled value is compared with the
    half exactly: the product's rounding error is recovered and decides what
    looks like a tie; true ties go to even.
    """
    x = value.cast("double")
    size = F.abs(x)
    scale = 10**digits
    scaled = size * F.lit(float(scale))
    whole = F.floor(scaled)
    part = scaled - whole.cast("double")
    if digits:
        high = F.lit(_SPLIT) * size
        high = high - (high - size)
        residue = (high * F.lit(float(scale)) - scaled) + (size - high) * F.lit(float(scale))
        odd_half = (residue > 0) | ((residue == 0) & (whole % 2 == 1))
    else:
        odd_half = whole % 2 == 1
    rounded = whole + F.when((part > 0.5) | ((part == 0.5) & odd_half), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    sign = (
        F.when(x < 0, F.lit("-"))
        .when((x == 0) & x.cast("string").startswith("-"), F.lit("-"))
        .otherwise(F.lit(""))
    )
    # A decimal with `digits` places prints itself in full.
    magnitude = rounded.cast("decimal(18,0)") * F.lit(Decimal(1).scaleb(-digits)) if digits else rounded
    text = F.concat(sign, magnitude.cast("string"))
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(size >= 1e13, F.regexp_replace(F.format_string(f"%.{digits}f", x), "^(-?)Infinity$", "$1inf"))
        .otherwise(text)
    )


def shown(value: Column, digits: int) -> Column:
    """`fixed_text`, and 'nan' for a missing number, as in the corpus."""
    return F.coalesce(fixed_text(value, digits), F.lit("nan"))


def number_list(values: Column, digits: int) -> Column:
    """An array of numbers as comma-separated fixed text; a missing one reads 'nan'."""
    return F.array_join(F.transform(values, lambda v: shown(v, digits)), ", ")


def render_prompt(
    location: Column,
    when: Column,
    temperature: Column,
    humidity: Column,
    wind_speed: Column,
    pressure: Column,
    precipitation_probability: Column,
) -> Column:
    """The seven-line prompt; `when` is text, see `prompt_time`."""
    series = {
        "temperature": temperature,
        "humidity": humidity,
        "wind_speed": wind_speed,
        "pressure": pressure,
        "precipitation_probability": precipitation_probability,
    }
    parts = [F.lit(PROMPT_HEAD), location, F.lit(" on "), when, F.lit(":")]
    for label, name, digits in PROMPT_LINES:
        parts += [F.lit(label), number_list(series[name], digits)]
    return F.concat(*parts, F.lit(PROMPT_TAIL))


def prompt_time(ts: Column) -> Column:
    return F.date_format(ts, PROMPT_TIME)


def render_payload_prompt(city: Column, payload: Column) -> Column:
    """The prompt from a free MAP<STRING,STRING>; missing fields read 'unknown'."""

    def field(name: str, default: str = "unknown") -> Column:
        return F.coalesce(F.try_element_at(payload, F.lit(name)), F.lit(default))

    parts = [F.lit(PROMPT_HEAD), city, F.lit(" on "), field("datetime", "current time"), F.lit(":")]
    for label, name, _ in PROMPT_LINES:
        parts += [F.lit(label.replace("°C", "C")), field(name)]
    return F.concat(*parts, F.lit(PROMPT_TAIL))


def has_payload(payload: Column) -> Column:
    return F.coalesce(F.size(payload) > 0, F.lit(False))


def fallback_sentence(city: Column, payload: Column) -> Column:
    """A one-sentence forecast read off the payload, or an 'unavailable' text."""

    def field(name: str, default: str) -> Column:
        return F.coalesce(F.try_element_at(payload, F.lit(name)), F.lit(default))

    return F.when(
        has_payload(payload),
        F.concat(
            city,
            F.lit(" should see temperatures near "),
            field("temperature", "the current range"),
            F.lit("C, winds around "),
            field("wind_speed", "local"),
            F.lit(" km/h, and precipitation probability near "),
            field("precipitation_probability", "unknown"),
            F.lit("."),
        ),
    ).otherwise(
        F.concat(
            city,
            F.lit(
                " forecast is unavailable until a llama.cpp server or explicit weather_data payload is provided."
            ),
        )
    )


def chat_serving(prompt: Column) -> Column:
    """Chat markup with the instruction that asks for the bulletin only."""
    return F.concat(F.lit(CHAT_OPEN), prompt, F.lit(SERVING_INSTRUCTION + CHAT_TURN))


def chat_training_prompt(prompt: Column) -> Column:
    return F.concat(F.lit(CHAT_OPEN), prompt, F.lit(CHAT_TURN))


def chat_training_response(response: Column) -> Column:
    return F.concat(response, F.lit(CHAT_END))
