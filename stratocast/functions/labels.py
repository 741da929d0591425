"""Bands, conditions and bulletins from horizon aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratocast.functions.render import shown

# The bulletin sentences per condition, timing and wind.
TEMPLATES = {
    "clear": [
        "Clear skies with {temp_desc} temperatures around {temp_range}°C.",
        "Sunny conditions expected with temperatures reaching {temp_range}°C.",
        "Bright and clear weather with {temp_desc} temperatures near {temp_range}°C.",
    ],
    "cloudy": [
        "Partly cloudy skies with temperatures around {temp_range}°C.",
        "Overcast conditions with {temp_desc} temperatures near {temp_range}°C.",
        "Cloudy weather expected with temperatures reaching {temp_range}°C.",
    ],
    "rainy": [
        "Showers expected with temperatures around {temp_range}°C. Precipitation chances {precip_desc}.",
        "Rain likely with {temp_desc} temperatures near {temp_range}°C. {precip_desc} chance of precipitation.",
        "Wet conditions forecast with temperatures reaching {temp_range}°C. {precip_desc} probability of rain.",
    ],
    "windy": [
        "Breezy conditions with winds up to {wind_speed} km/h. Temperatures around {temp_range}°C.",
        "Windy weather expected with gusts reaching {wind_speed} km/h. {temp_desc} temperatures near {temp_range}°C.",
        "Strong winds up to {wind_speed} km/h forecast. Temperatures around {temp_range}°C.",
    ],
}
TIMING = [
    "Showers expected by afternoon.",
    "Rain likely by evening.",
    "Precipitation chances increase later.",
    "Wet conditions developing.",
]
WIND = [
    "Winds increasing to {wind_speed} km/h.",
    "Breezy conditions with gusts up to {wind_speed} km/h.",
    "Windy with speeds reaching {wind_speed} km/h.",
]


def steady(value: Column) -> Column:
    """A mean without the last-bit noise of its summation order, for thresholds."""
    return F.round(value, 9)


def temp_band(mean: Column, top: str = "warm") -> Column:
    x = steady(mean)
    return (
        F.when(x < 0, "very cold").when(x < 10, "cold").when(x < 20, "cool").when(x < 30, "mild").otherwise(top)
    )


def precip_band(mean: Column) -> Column:
    x = steady(mean)
    return F.when(x < 0.2, "low").when(x < 0.5, "moderate").when(x < 0.8, "high").otherwise("very high")


def condition_class(precip: Column, max_wind: Column, humidity: Column) -> Column:
    return (
        F.when(steady(precip) > 0.5, "rainy")
        .when(max_wind > 30, "windy")
        .when(steady(humidity) > 80, "cloudy")
        .otherwise("clear")
    )


def seeded_pick(n: int, seed: int, slot: str, *identity: Column) -> Column:
    """A repeatable choice out of n for one row, the same in every run."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(slot), *[c.cast("string") for c in identity]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.lit(n)


def _fill(template: str, values: dict[str, Column]) -> Column:
    parts: list[Column] = []
    rest = template
    while rest:
        before, brace, after = rest.partition("{")
        if before:
            parts.append(F.lit(before))
        if not brace:
            break
        name, _, rest = after.partition("}")
        parts.append(values[name])
    return F.concat(*parts)


def _choose(templates: list[str], pick: Column, values: dict[str, Column]) -> Column:
    chosen = F.when(pick == 0, _fill(templates[0], values))
    for i, template in enumerate(templates[1:-1], start=1):
        chosen = chosen.when(pick == i, _fill(template, values))
    return chosen.otherwise(_fill(templates[-1], values))


def bulletin_parts(
    *,
    avg_temp: Column,
    min_temp: Column,
    max_temp: Column,
    avg_humidity: Column,
    max_wind: Column,
    avg_precip: Column,
    identity: list[Column],
    seed: int = 42,
) -> dict[str, Column]:
    """What a templated bulletin is made of; add these columns first, then `templated_bulletin`.

    The choices hash (seed, identity), where an unseeded draw would change
    from run to run. A choice of NULL leaves its sentence out.
    """
    return {
        "temp_desc": temp_band(avg_temp),
        "temp_range": F.concat(shown(min_temp, 0), F.lit("-"), shown(max_temp, 0)),
        "wind_speed": shown(max_wind, 0),
        "precip_desc": precip_band(avg_precip),
        "condition": condition_class(avg_precip, max_wind, avg_humidity),
        "main": seeded_pick(3, seed, "main", *identity),
        "timing": F.when(steady(avg_precip) > 0.3, seeded_pick(4, seed, "timing", *identity)),
        "wind": F.when(max_wind > 20, seeded_pick(3, seed, "wind", *identity)),
    }


def templated_bulletin(parts: dict[str, Column]) -> Column:
    """One of the condition's sentences, then the chosen timing and wind sentences."""
    main = None
    for name, templates in TEMPLATES.items():
        text = _choose(templates, parts["main"], parts)
        here = parts["condition"] == name
        main = F.when(here, text) if main is None else main.when(here, text)

    def sentence(name: str, templates: list[str]) -> Column:
        chosen = F.concat(F.lit(" "), _choose(templates, parts[name], parts))
        return F.when(parts[name].isNotNull(), chosen).otherwise("")

    return F.concat(main, sentence("timing", TIMING), sentence("wind", WIND))


def deterministic_bulletin(
    min_temp: Column, max_temp: Column, humidity: Column, max_wind: Column, precip: Column
) -> Column:
    """One fixed sentence from horizon aggregates."""
    band = temp_band((min_temp + max_temp) / 2, top="hot")
    condition = (
        F.when(steady(precip) >= 0.55, "Rain likely")
        .when(steady(precip) >= 0.30, "Showers possible")
        .when(steady(humidity) >= 80, "Cloudy")
        .otherwise("Mainly dry")
    )
    speed = shown(max_wind, 0)
    wind = (
        F.when(max_wind >= 28, F.concat(F.lit("windy with gusts near "), speed))
        .when(max_wind >= 18, F.concat(F.lit("breezy with winds around "), speed))
        .otherwise(F.concat(F.lit("light winds near "), speed))
    )
    return F.concat(
        condition,
        F.lit(" conditions expected with "),
        band,
        F.lit(" temperatures around "),
        shown(min_temp, 0),
        F.lit("-"),
        shown(max_temp, 0),
        F.lit("C and "),
        wind,
        F.lit(" km/h."),
    )
