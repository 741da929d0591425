"""The same queries as plain SQL for an independent engine."""

from __future__ import annotations

from stratocast.functions import extract, labels, render, reward
from stratocast.functions.text import SPACE, STOPWORDS
from stratocast.operators import forecasts, gate, ingest, metriclog
from stratocast.operators.evaluate import FLAGS, OVERALL, VERDICTS
from stratocast.plans.catalog import MADE_AT, MINIMUMS

WORD = f"[^{SPACE}]+"


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def r6(expression: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6)"


def hits(expression: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({expression}, {lit(p)}) AS INT)" for p in patterns) + ")"


def contains(expression: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({expression}, {lit(t)}) AS INT)" for t in terms) + ")"


def number(expression: str, pattern: str, group: int = 1) -> str:
    return f"CAST(nullif(regexp_extract({expression}, {lit(pattern)}, {group}), '') AS DOUBLE)"


def count_words(expression: str) -> str:
    return f"len(regexp_extract_all({expression}, {lit(WORD)}))"


def words(expression: str) -> str:
    return f"regexp_extract_all({expression}, {lit(WORD)})"


def tokens(expression: str) -> str:
    stop = ", ".join(lit(w) for w in STOPWORDS)
    return f"list_filter(regexp_extract_all(lower({expression}), '[a-z0-9]+'), lambda x: x NOT IN ({stop}))"


def grams(array: str, n: int) -> str:
    if n == 1:
        return array
    parts = " || ' ' || ".join(f"{array}[i + {k}]" if k else f"{array}[i]" for k in range(n))
    return f"list_transform(range(1, len({array}) - {n - 2}), lambda i: {parts})"


def overlap(a: str, b: str) -> str:
    return (
        f"coalesce(list_sum(list_transform(list_distinct({a}), lambda t: least("
        f"len(list_filter({a}, lambda y: y = t)), len(list_filter({b}, lambda y: y = t))))), 0)"
    )


def f1(shared: str, a: str, b: str) -> str:
    return f"CASE WHEN {shared} > 0 THEN 2.0::DOUBLE * {shared} / (len({a}) + len({b})) ELSE 0.0::DOUBLE END"


# Labels ----------------------------------------------------------------------


def temp_band(mean: str, top: str = "warm") -> str:
    x = f"round({mean}, 9)"
    return (
        f"CASE WHEN {x} < 0 THEN 'very cold' WHEN {x} < 10 THEN 'cold' WHEN {x} < 20 THEN 'cool' "
        f"WHEN {x} < 30 THEN 'mild' ELSE '{top}' END"
    )


def precip_band(mean: str) -> str:
    x = f"round({mean}, 9)"
    return f"CASE WHEN {x} < 0.2 THEN 'low' WHEN {x} < 0.5 THEN 'moderate' WHEN {x} < 0.8 THEN 'high' ELSE 'very high' END"


def condition(precip: str, wind: str, humidity: str) -> str:
    return (
        f"CASE WHEN round({precip}, 9) > 0.5 THEN 'rainy' WHEN {wind} > 30 THEN 'windy' "
        f"WHEN round({humidity}, 9) > 80 THEN 'cloudy' ELSE 'clear' END"
    )


def bulletin(low: str, high: str, humidity: str, wind: str, precip: str) -> str:
    p, h, speed = f"round({precip}, 9)", f"round({humidity}, 9)", f"printf('%.0f', {wind})"
    return (
        f"(CASE WHEN {p} >= 0.55 THEN 'Rain likely' WHEN {p} >= 0.30 THEN 'Showers possible' "
        f"WHEN {h} >= 80 THEN 'Cloudy' ELSE 'Mainly dry' END"
        f" || ' conditions expected with ' || {temp_band(f'(({low} + {high}) / 2)', 'hot')}"
        f" || ' temperatures around ' || printf('%.0f', {low}) || '-' || printf('%.0f', {high}) || 'C and '"
        f" || CASE WHEN {wind} >= 28 THEN 'windy with gusts near ' WHEN {wind} >= 18 THEN 'breezy with winds around ' "
        f"ELSE 'light winds near ' END || {speed} || ' km/h.')"
    )


def _pick(templates: list[str], slot: str, n: int) -> str:
    digest = f"md5('42:{slot}:' || location_name || ':' || epoch_us(datetime) || ':' || event_id)"
    index = f"CAST('0x' || substr({digest}, 1, 8) AS BIGINT) % {n}"
    values = {
        "temp_desc": temp_band("avg_temp"),
        "temp_range": "printf('%.0f', min_temp) || '-' || printf('%.0f', max_temp)",
        "wind_speed": "printf('%.0f', max_wind)",
        "precip_desc": precip_band("avg_precip"),
    }
    cases = []
    for i, template in enumerate(templates):
        text = lit(template)
        for name, value in values.items():
            text = f"replace({text}, '{{{name}}}', {value})" if "{" + name + "}" in template else text
        cases.append(f"WHEN {i} THEN {text}")
    return f"CASE {index} " + " ".join(cases) + " END"


def templated() -> str:
    main = " ".join(
        f"WHEN '{name}' THEN {_pick(texts, 'main', 3)}" for name, texts in labels.TEMPLATES.items()
    )
    return (
        f"(CASE {condition('avg_precip', 'max_wind', 'avg_humidity')} {main} END"
        f" || CASE WHEN round(avg_precip, 9) > 0.3 THEN ' ' || {_pick(labels.TIMING, 'timing', 4)} ELSE '' END"
        f" || CASE WHEN max_wind > 20 THEN ' ' || {_pick(labels.WIND, 'wind', 3)} ELSE '' END)"
    )


# Prompts ---------------------------------------------------------------------

DIGITS = {name: digits for _, name, digits in render.PROMPT_LINES}


def number_list(array: str, digits: int) -> str:
    return f"array_to_string(list_transform({array}, lambda x: printf('%.{digits}f', x)), ', ')"


def prompt(location: str, when: str, series: dict[str, str] | None = None) -> str:
    parts = [lit(render.PROMPT_HEAD), location, "' on '", when, "':'"]
    for label, name, digits in render.PROMPT_LINES:
        value = series[name] if series else number_list(name, digits)
        parts += [lit(label), value]
    return "(" + " || ".join([*parts, lit(render.PROMPT_TAIL)]) + ")"


def minute(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M UTC')"


# Extraction and scores ----------------------------------------------------------


def verdict(rain: str, clear: str) -> str:
    return f"CASE WHEN {rain} > {clear} THEN true WHEN {clear} > {rain} THEN false END"


def rain_signal(t: str) -> str:
    low, chance = f"lower({t})", number(f"lower({t})", extract.CHANCE)
    wet = f"({hits(low, extract.RAIN)} + CASE WHEN {chance} >= 50 THEN 2 ELSE 0 END)"
    dry = f"({hits(low, extract.CLEAR)} + CASE WHEN {chance} <= 20 THEN 2 ELSE 0 END)"
    return verdict(wet, dry)


def bound(t: str, patterns: list[str], hi: bool) -> str:
    single = "coalesce(" + ", ".join(number(t, p) for p in patterns[1:]) + ", NULL)"
    shift = "+ 2.0::DOUBLE" if hi else "- 2.0::DOUBLE"
    return f"coalesce({number(t, patterns[0], 2 if hi else 1)}, {single} {shift})"


def wind(t: str) -> str:
    return "coalesce(" + ", ".join(number(f"lower({t})", p) for p in extract.WIND) + ")"


def length_similarity(g: str, r: str) -> str:
    a, b = count_words(g), count_words(r)
    return f"1.0::DOUBLE - abs({a} - {b}) / greatest({a}, {b}, 1)::DOUBLE"


def diversity(g: str) -> str:
    return f"len(list_distinct({words(f'lower({g})')})) / greatest({count_words(g)}, 1)::DOUBLE"


def readability(g: str) -> str:
    pieces = f"list_filter(list_transform(string_split({g}, '.'), lambda s: {count_words('s')}), lambda n: n > 0)"
    return f"coalesce(greatest(0.0, 1.0 - abs(list_avg({pieces}) - 15.0) / 15.0), 0.0)"


OBS = """obs_raw AS (
 SELECT 'loc_' || user_id AS location_name, ts AS datetime, event_id,
  CAST((event_id * 37 + c) % 460 - 80 AS DOUBLE) / 10 AS temperature_c,
  CAST(20 + (event_id * 13 + c) % 79 AS DOUBLE) AS humidity_pct,
  CAST((event_id * 29 + c * 7) % 500 AS DOUBLE) / 10 AS wind_speed_kph,
  CAST(9850 + (event_id * 17 + c) % 500 AS DOUBLE) / 10 AS pressure_hpa,
  CASE WHEN event_id % 17 <> 0 THEN CAST((event_id * 11 + c * 3) % 101 AS DOUBLE) / 100 END AS precipitation_probability
 FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events))"""

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], body: str) -> None:
    CTES[name] = (needs, body)


cte("obs_raw", [], OBS)
cte(
    "obs",
    ["obs_raw"],
    "obs AS (SELECT * REPLACE (coalesce(precipitation_probability, 0.0) AS precipitation_probability) FROM obs_raw)",
)
cte(
    "win",
    ["obs"],
    """win AS (SELECT * EXCLUDE (rn, n) FROM (
 SELECT location_name, datetime, event_id,
  list(temperature_c) OVER a AS temperature, list(humidity_pct) OVER a AS humidity,
  list(wind_speed_kph) OVER a AS wind_speed, list(pressure_hpa) OVER a AS pressure,
  list(precipitation_probability) OVER a AS precipitation_probability,
  avg(temperature_c) OVER h AS avg_temp, max(temperature_c) OVER h AS max_temp, min(temperature_c) OVER h AS min_temp,
  avg(humidity_pct) OVER h AS avg_humidity, max(wind_speed_kph) OVER h AS max_wind,
  avg(precipitation_probability) OVER h AS avg_precip,
  row_number() OVER (PARTITION BY location_name ORDER BY datetime, event_id) AS rn,
  count(*) OVER (PARTITION BY location_name) AS n
 FROM obs
 WINDOW a AS (PARTITION BY location_name ORDER BY datetime, event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING),
  h AS (PARTITION BY location_name ORDER BY datetime, event_id ROWS BETWEEN 4 FOLLOWING AND 9 FOLLOWING))
 WHERE rn <= n - 10)""",
)
_HORIZON = bulletin("min_temp", "max_temp", "avg_humidity", "max_wind", "avg_precip")
_PERSIST = bulletin(
    "list_min(temperature)", "list_max(temperature)", "list_avg(humidity)", "list_max(wind_speed)",
    "list_avg(precipitation_probability)",
)
cte(
    "pred",
    ["win"],
    f"""pred AS (SELECT event_id AS sample_id, location_name AS location, {minute('datetime')} AS datetime,
 {_PERSIST} AS generated_forecast, {_HORIZON} AS reference_forecast,
 round(avg_precip, 9) >= 0.5 AS obs_rain, round(avg_temp, 4) AS obs_temp,
 {temp_band('((min_temp + max_temp) / 2)', 'hot')} AS band,
 CASE WHEN max_wind >= 28 THEN 'gusts' ELSE 'winds' END AS wind_term FROM win)""",
)
cte(
    "corpus",
    ["win"],
    f"""corpus AS (SELECT sample_id, p AS input, t AS target, p AS prompt, t AS response, location, datetime FROM (
 SELECT event_id AS sample_id, {prompt('location_name', minute('datetime'))} AS p, {_HORIZON} AS t,
 location_name AS location, {minute('datetime')} AS datetime FROM win))""",
)
cte(
    "split_corpus",
    ["corpus"],
    """split_corpus AS (SELECT * EXCLUDE (k, n), CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train'
 WHEN k <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM (
 SELECT *, row_number() OVER (ORDER BY md5('42:' || sample_id)) AS k, count(*) OVER () AS n FROM corpus))""",
)


def _series(factor: str, shift: str) -> str:
    values = f"list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 100) * {factor}::DOUBLE + {shift}::DOUBLE)"
    return f"CASE WHEN label = 8 THEN ({values})[1:60] ELSE {values} END"


_ARRAYS = {
    "temperature_c": ("0.5", "10.0"),
    "humidity_pct": ("0.25", "60.0"),
    "pressure_hpa": ("0.5", "1010.0"),
    "wind_speed": ("0.125", "8.0"),
    "wind_direction_deg": ("1.0", "180.0"),
    "precipitation_probability": ("0.5", "50.0"),
    "precipitation_mm": ("0.25", "5.0"),
    "cloud_cover_pct": ("0.5", "40.0"),
}
cte(
    "blocks",
    [],
    "blocks AS (SELECT *, start_s + CASE WHEN label = 9 THEN -3600 WHEN label = 7 THEN interval_s * 63 + 1800 "
    "ELSE interval_s * len(embedding) END AS end_s FROM (SELECT vec_id, label, embedding, "
    "CASE WHEN label <> 6 THEN 'stn_' || vec_id END AS location_name, CAST(label * 7 - 30 AS DOUBLE) AS latitude, "
    "CAST(vec_id % 360 - 180 AS DOUBLE) AS longitude, 1704067200 + vec_id * 3600 AS start_s, "
    "3600 * (1 + label % 3) AS interval_s, "
    + ", ".join(
        ("CASE WHEN label = 5 THEN NULL ELSE " if c == "precipitation_probability" else "")
        + _series(*v)
        + (" END" if c == "precipitation_probability" else "")
        + f" AS {c}"
        for c, v in _ARRAYS.items()
    )
    + " FROM embeddings))",
)
cte(
    "good_steps",
    ["blocks"],
    "good_steps AS (SELECT b.location_name, b.latitude, b.longitude, make_timestamp((b.start_s + k * b.interval_s) * 1000000) AS datetime, "
    + ", ".join(f"b.{c}[k + 1] AS {c}" for c in _ARRAYS)
    + " FROM blocks b, LATERAL (SELECT unnest(range(0, CAST(greatest(ceil((b.end_s - b.start_s) / b.interval_s::DOUBLE), 0) AS BIGINT))) AS k)"
    " WHERE b.location_name IS NOT NULL AND b.label <> 8)",
)
cte(
    "text_pairs",
    [],
    """text_pairs AS (SELECT q.conv_id, q.turn, q.text AS question, s.text AS answer FROM conversations q
 JOIN conversations s ON s.conv_id = q.conv_id AND s.turn = q.turn + 1 WHERE q.role = 'user' AND s.role = 'assistant')""",
)
cte(
    "pair_tokens",
    ["text_pairs"],
    f"pair_tokens AS (SELECT *, {tokens('answer')} AS g, {tokens('question')} AS r FROM text_pairs)",
)
cte(
    "reqs",
    [],
    """reqs AS (SELECT c_custkey AS request_id, 'loc_' || (c_custkey % 160) AS name,
 CASE WHEN c_nationkey <> 7 THEN c_custkey % 90 END AS latitude,
 CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(c_custkey % 12 + 1 AS INT) END AS forecast_horizon,
 CASE WHEN c_acctbal <= 8000 THEN c_acctbal >= 0 END AS include_confidence,
 CASE WHEN c_nationkey = 24 THEN ' New York ' WHEN c_nationkey = 5 THEN 'Town ' || (c_custkey % 7)
  ELSE ' LOC_' || (c_custkey % 160) END AS city,
 c_mktsegment <> 'AUTOMOBILE' AS has_payload,
 CAST(c_custkey % 41 AS VARCHAR) AS p_temperature, CAST(c_custkey % 97 AS VARCHAR) AS p_humidity,
 CASE WHEN c_mktsegment <> 'MACHINERY' THEN CAST(c_custkey % 53 AS VARCHAR) END AS p_wind_speed,
 CAST(980 + c_custkey % 60 AS VARCHAR) AS p_pressure,
 CASE WHEN c_mktsegment <> 'BUILDING' THEN '2024-05-01 06:00 UTC' END AS p_datetime,
 CASE WHEN c_nationkey <> 3 THEN CAST(c_custkey % 2 AS VARCHAR) END AS p_precipitation_probability
 FROM customer)""",
)
_G1, _R1 = "g", "r"
cte(
    "pred_tokens",
    ["pred"],
    f"""pred_tokens AS (SELECT *, {tokens('generated_forecast')} AS g, {tokens('reference_forecast')} AS r,
 {rain_signal('generated_forecast')} AS g_rain, {rain_signal('reference_forecast')} AS r_rain,
 ({bound('generated_forecast', extract.TEMPERATURE, False)} + {bound('generated_forecast', extract.TEMPERATURE, True)}) / 2 AS g_mid,
 ({bound('reference_forecast', extract.TEMPERATURE, False)} + {bound('reference_forecast', extract.TEMPERATURE, True)}) / 2 AS r_mid,
 {wind('generated_forecast')} AS g_wind, {wind('reference_forecast')} AS r_wind FROM pred)""",
)


def _score_columns() -> str:
    g2, r2 = grams("g", 2), grams("r", 2)
    shared1, shared2 = overlap("g", "r"), overlap("g2", "r2")
    return f"""SELECT *, {f1(shared2, 'g2', 'r2')} AS rouge_2, {f1(shared1, 'g', 'r')} AS rouge_1,
 {length_similarity('generated_forecast', 'reference_forecast')} AS length_sim,
 {diversity('generated_forecast')} AS diversity, {readability('generated_forecast')} AS read_score,
 CAST(g_rain IS NOT NULL AND r_rain IS NOT NULL AS INT) AS rain_pair,
 CAST(coalesce(g_rain = r_rain, false) AS INT) AS rain_hit,
 abs(g_mid - r_mid) AS temp_error, abs(g_wind - r_wind) AS wind_error,
 CAST(g_rain IS NOT DISTINCT FROM r_rain AND (g_mid IS NULL OR r_mid IS NULL OR abs(g_mid - r_mid) <= 3) AS DOUBLE) AS categorical
 FROM (SELECT *, {g2} AS g2, {r2} AS r2 FROM pred_tokens)"""


cte("scored", ["pred_tokens"], f"scored AS ({_score_columns()})")


def _overall(bleu: str, rouge: str, categorical: str, length: str, read: str, rain: str) -> str:
    terms = {
        "bleu": bleu, "rouge_1": rouge, "categorical": categorical, "length": length, "readability": read, "rain": rain,
    }
    return "(" + " + ".join(f"{OVERALL[k]}::DOUBLE * {v}" for k, v in terms.items()) + ")"


def evaluation(by: list[str], rollup: bool = False, bleu: str = "rouge_1", rouge_l: str = "rouge_1", source: str = "scored") -> str:
    keys = ", ".join(by)
    group = "" if not by else f"GROUP BY ROLLUP ({keys})" if rollup else f"GROUP BY {keys}"
    lead = (keys + ", " if by else "") + (f"grouping_id({keys}) AS level, " if rollup else "")
    agg = f"""SELECT {lead}count(*) AS predictions, avg({bleu}) AS bleu_score, avg(rouge_1) AS rouge_1_f,
 avg(rouge_2) AS rouge_2_f, avg({rouge_l}) AS rouge_l_f,
 CAST(sum(rain_hit) AS DOUBLE) / greatest(sum(rain_pair), 1) AS rain_accuracy,
 coalesce(avg(temp_error), 0) AS temperature_mae, coalesce(avg(wind_error), 0) AS wind_speed_mae,
 avg(categorical) AS categorical_accuracy, 0.0::DOUBLE AS brier_score, 0.0::DOUBLE AS reliability,
 0.0::DOUBLE AS resolution, avg(read_score) AS readability_score, avg(length_sim) AS length_similarity,
 avg(diversity) AS vocabulary_diversity FROM {source} {group}"""
    overall = _overall("bleu_score", "rouge_1_f", "categorical_accuracy", "length_similarity", "readability_score", "rain_accuracy")
    margin = "CASE WHEN predictions > 10 THEN 0.05::DOUBLE ELSE 0.10::DOUBLE END"
    return f"""SELECT *, greatest(0.0, overall_score - {margin}) AS confidence_interval_low,
 least(1.0, overall_score + {margin}) AS confidence_interval_high FROM (SELECT *, {overall} AS overall_score FROM ({agg}))"""


EVALUATED = [
    "bleu_score", "rouge_1_f", "rouge_2_f", "rouge_l_f", "rain_accuracy", "temperature_mae", "wind_speed_mae",
    "categorical_accuracy", "brier_score", "reliability", "resolution", "readability_score", "length_similarity",
    "vocabulary_diversity", "overall_score", "confidence_interval_low", "confidence_interval_high",
]


def evaluation_rounded(by: list[str], rollup: bool = False, **scores: str) -> str:
    columns = ", ".join(f"{r6(c)} AS {c}" for c in EVALUATED)
    return f"SELECT {''.join(b + ', ' for b in by)}{'level, ' if rollup else ''}predictions, {columns} FROM ({evaluation(by, rollup, **scores)})"


def rewarded(t: str, rain: str, temp: str, w: dict[str, float]) -> str:
    """Reward columns over a relation with the text `t` and observed columns."""
    low = f"lower({t})"
    f_rain = verdict(hits(low, extract.REWARD_RAIN), hits(low, extract.REWARD_CLEAR))
    lo, hi = bound(t, extract.REWARD_TEMPERATURE, False), bound(t, extract.REWARD_TEMPERATURE, True)
    n = "w"
    length = f"CASE WHEN {n} < 10 THEN {n} / 10.0::DOUBLE WHEN {n} > 50 THEN greatest(0.0, 1.0 - ({n} - 50) / 50.0::DOUBLE) ELSE 1.0 END"
    terms = f"least(1.0, {contains(low, reward.STYLE_TERMS)} / 5.0::DOUBLE)"
    structure = (
        f"(1.0 - CASE WHEN regexp_matches({t}, {lit('[.!?][' + SPACE + ']*$')}) THEN 0.0 ELSE 0.2 END"
        f" - CASE WHEN contains({t}, '.') THEN 0.0 ELSE 0.3 END)"
    )
    inner = f"""SELECT *, {f_rain} AS f_rain, {lo} AS f_lo, {hi} AS f_hi, {contains(low, extract.HEDGES)} AS hedges,
 {count_words(t)} AS w"""
    rain_check = f"CASE WHEN f_rain IS NOT NULL AND {rain} IS NOT NULL THEN CASE WHEN f_rain = {rain} THEN 1.0 ELSE -0.5 END END"
    temp_check = (
        f"CASE WHEN f_lo IS NOT NULL AND {temp} IS NOT NULL THEN CASE WHEN f_lo <= {temp} AND {temp} <= f_hi THEN 1.0::DOUBLE "
        f"ELSE greatest(0.0, 1.0 - abs({temp} - (f_lo + f_hi) / 2) / 10) END END"
    )
    middle = f"""SELECT *, {rain_check} AS rain_check, {temp_check} AS temp_check,
 0.4::DOUBLE * {length} + 0.4::DOUBLE * {terms} + 0.2::DOUBLE * {structure} AS style_raw,
 CASE WHEN hedges BETWEEN 1 AND 3 THEN 1.0 WHEN hedges = 0 THEN 0.7 ELSE greatest(0.3, 1.0 - (hedges - 3) * 0.2) END AS calibration_reward,
 CASE WHEN f_lo IS NOT NULL OR f_rain IS NOT NULL THEN 1.0 ELSE 0.5 END AS factual_consistency FROM ({inner} FROM %s)"""
    outer = f"""SELECT *, CASE WHEN rain_check IS NULL AND temp_check IS NULL THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE,
 (coalesce(rain_check, 0.0)::DOUBLE + coalesce(temp_check, 0.0)) / (CAST(rain_check IS NOT NULL AS INT) + CAST(temp_check IS NOT NULL AS INT))) END AS accuracy_reward,
 greatest(0.0, least(1.0, style_raw)) AS style_reward FROM ({middle})"""
    return f"""SELECT *, {w['accuracy']}::DOUBLE * accuracy_reward + {w['style']}::DOUBLE * style_reward
 + {w['calibration']}::DOUBLE * calibration_reward + {w['consistency']}::DOUBLE * factual_consistency AS total_reward FROM ({outer})"""


W_DEFAULT = reward.normalize_weights()
W_OTHER = reward.normalize_weights(2.0, 1.0, 1.0, 4.0)
REWARDED = rewarded("generated_forecast", "obs_rain", "obs_temp", W_DEFAULT)
cte("rewarded", ["pred"], "rewarded AS (" + REWARDED % "pred" + ")")

_PRED_RECORDS = """preds AS (SELECT id, arg_max(txt, pos) AS generated_forecast FROM (
 SELECT CAST(sample_id AS VARCHAR) AS id, sample_id * 2 AS pos,
  CASE WHEN NOT starts_with(generated_forecast, 'Cloudy') THEN generated_forecast END AS txt FROM pred
 UNION ALL SELECT CAST(sample_id AS VARCHAR), sample_id * 2 + 1, CASE WHEN wind_term = 'gusts' THEN reference_forecast END FROM pred)
 WHERE txt IS NOT NULL GROUP BY id)"""
cte("preds", ["pred"], _PRED_RECORDS)


def _gate() -> str:
    base = """cases AS (SELECT p.* REPLACE (coalesce(m.generated_forecast, p.reference_forecast) AS generated_forecast)
 FROM pred p LEFT JOIN preds m ON m.id = CAST(p.sample_id AS VARCHAR))"""
    toks = CTES["pred_tokens"][1].replace("pred_tokens AS", "case_tokens AS").replace("FROM pred)", "FROM cases)")
    scores = "case_scores AS (" + _score_columns().replace("FROM pred_tokens", "FROM case_tokens") + ")"
    gated = "gated AS (" + REWARDED % "case_scores" + ")"
    overall = _overall("rouge_1", "rouge_1", "categorical", "length_sim", "read_score", "rain_hit")
    patterns = r"['\|', 'generate a forecast', 'GUSTS near 4[5-9]']"
    rows = f"""gate_out AS (SELECT id, location, overall_score >= {gate.MIN_OVERALL} AND reward >= {gate.MIN_REWARD}
 AND len(rt) >= greatest(1, 3 - 1) AND len(fp) = 0 AND word_count BETWEEN 8 AND 55 AS passed,
 overall_score, reward, array_to_string(rt, '|') AS required_terms_found,
 array_to_string(fp, '|') AS forbidden_patterns_found, word_count FROM (
 SELECT CAST(sample_id AS VARCHAR) AS id, location, {overall} AS overall_score, total_reward AS reward,
 list_filter([band, 'Conditions', wind_term], lambda t: contains(lower(generated_forecast), lower(t))) AS rt,
 list_filter({patterns}, lambda p: regexp_matches(generated_forecast, '(?i)' || p)) AS fp,
 {count_words('generated_forecast')} AS word_count FROM gated))"""
    return ", ".join([base, toks, scores, gated, rows])


cte("gate_out", ["preds"], _gate())

_VALUE = "CASE WHEN event_id % 101 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 103 = 0 THEN 'Infinity'::DOUBLE ELSE round(value, 2) END"
cte(
    "routed",
    [],
    f"""routed AS (SELECT event_type AS run, event_id % 50 AS step, event_id, 'train/loss' AS key, {_VALUE} AS value FROM events
 UNION ALL SELECT event_type, event_id % 50, event_id, 'eval/loss', round(value, 2) + 1 FROM events
 UNION ALL SELECT event_type, event_id % 50, event_id, 'eval/pre_mae', round(value, 2) + 2 FROM events)""",
)
_NOT_FINITE = "(isnan(value) OR isinf(value))"
_FATAL = "(" + " OR ".join(f"contains(lower(error), {lit(m)})" for m in metriclog.FATAL_MARKERS) + ")"


def with_ctes(select: str, *names: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in CTES[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        add(n)
    return ("WITH " + ",\n".join(CTES[n][1] for n in ordered) + "\n" if ordered else "") + select


def _vocab(source: str, columns: list[str]) -> str:
    every = " UNION ALL ".join(f"SELECT unnest({words(c)}) AS token FROM {source}" for c in columns)
    return (
        "vocab AS (SELECT token, count(*) AS uses, CAST(row_number() OVER (ORDER BY md5('0:' || token)) AS INT) AS id "
        f"FROM ({every}) GROUP BY token)"
    )


def _encoded() -> str:
    parts = {}
    for column in ("prompt", "response"):
        parts[column] = (
            f"{column}_ids AS (SELECT t.sample_id, list(v.id ORDER BY t.pos) AS ids FROM (SELECT sample_id, "
            f"unnest({words(column)}) AS token, unnest(range(1, {count_words(column)} + 1)) AS pos FROM corpus) t "
            "JOIN vocab v ON v.token = t.token GROUP BY t.sample_id)"
        )
    return (
        _vocab("corpus", ["prompt", "response"]) + ", " + parts["prompt"] + ", " + parts["response"]
        + ", encoded AS (SELECT p.sample_id, p.ids AS p, r.ids AS r FROM prompt_ids p JOIN response_ids r ON r.sample_id = p.sample_id)"
    )


cte("encoded", ["corpus"], _encoded())


def _fit(array: str, length: int, filler: int) -> str:
    padded = f"(({array})[1:{length}] || list_transform(range(0, greatest({length} - len({array}), 0)), lambda z: {filler}))"
    return f"array_to_string({padded}, ',')"


def _iso(ts: str) -> str:
    return (
        f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({ts}) % 1000000 <> 0 THEN strftime({ts}, '.%f') ELSE '' END)"
    )


def _responses(relation: str, made_at: str) -> str:
    """Response columns of a relation with error, forecast_text, confidence_score."""
    until = f"(made_at + CASE WHEN error IS NULL THEN forecast_horizon ELSE 0 END * INTERVAL 1 HOUR)"
    return f"""SELECT request_id, CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status,
 CASE WHEN error IS NULL THEN forecast_text ELSE {lit(forecasts.ERROR_PREFIX)} || error END AS forecast,
 round(CASE WHEN error IS NOT NULL THEN 0.0::DOUBLE WHEN include_confidence THEN confidence_score END, 6) AS confidence,
 name AS location, {_iso('made_at')} AS generated_at, {_iso(until)} AS valid_until, 'latest' AS model_version
 FROM (SELECT *, {made_at} AS made_at FROM ({relation}))"""


_PARSED = """SELECT request_id, name, latitude, coalesce(forecast_horizon, 6) AS forecast_horizon,
 coalesce(include_confidence, true) AS include_confidence, city, has_payload,
 CASE WHEN latitude IS NULL THEN 'missing latitude' END AS reason FROM reqs"""
cte("parsed", ["reqs"], f"parsed AS ({_PARSED})")
_FIRST = ", ".join(
    f"list({c} ORDER BY rn) AS {n}"
    for n, c in {
        "temperature": "temperature_c", "humidity": "humidity_pct", "wind_speed": "wind_speed_kph",
        "pressure": "pressure_hpa", "precipitation_probability": "precipitation_probability",
    }.items()
)
cte(
    "firsts",
    ["obs"],
    f"""firsts AS (SELECT location_name, min(datetime) AS datetime, {_FIRST} FROM (
 SELECT *, row_number() OVER (PARTITION BY location_name ORDER BY datetime, event_id) AS rn FROM obs) WHERE rn <= 4 GROUP BY location_name)""",
)
_MADE = f"TIMESTAMP '{MADE_AT}'"


def _payload_prompt() -> str:
    series = {n: f"coalesce(p_{n}, 'unknown')" for n in DIGITS}
    text = prompt("city", "coalesce(p_datetime, 'current time')", series).replace("(°C)", "(C)")
    return f"CASE WHEN has_payload THEN {text} END"


def _city_prompt() -> str:
    return _serving(
        "coalesce(k.known, CASE WHEN lower(trim(city)) = 'new york' THEN " + _profile("new york") + " END, " + _profile("nairobi") + ")"
    )


_CITY_JOIN = """LEFT JOIN (SELECT lower(trim(location)) AS key, arg_min(input, (datetime, sample_id)) AS known FROM corpus GROUP BY 1) k
 ON k.key = lower(trim(r.city))"""


def _fallback() -> str:
    return (
        "CASE WHEN has_payload THEN city || ' should see temperatures near ' || coalesce(p_temperature, 'the current range')"
        " || 'C, winds around ' || coalesce(p_wind_speed, 'local') || ' km/h, and precipitation probability near '"
        " || coalesce(p_precipitation_probability, 'unknown') || '.' ELSE city || ' forecast is unavailable until a "
        "llama.cpp server or explicit weather_data payload is provided.' END"
    )


def _profile(key: str) -> str:
    series = {n: number_list(str(forecasts.PROFILES[key][n]) + "::DOUBLE[]", d) for n, d in DIGITS.items()}
    return prompt("trim(city)", lit(forecasts.LOCAL_TIME), series)


def _serving(text: str) -> str:
    return f"({lit(render.CHAT_OPEN)} || {text} || {lit(render.SERVING_INSTRUCTION + render.CHAT_TURN)})"


def _jaccard_sql() -> str:
    sets = f"list_distinct({words('lower(text)')})"
    return f"""SELECT s.prompt_id, s.candidates,
 round(CASE WHEN p.mean IS NULL THEN 0.5 ELSE least(1.0, greatest(0.1, p.mean)) END, 6) AS confidence_score FROM
 (SELECT conv_id AS prompt_id, count(*) AS candidates FROM conversations WHERE role = 'assistant' GROUP BY 1) s LEFT JOIN
 (SELECT a.conv_id AS prompt_id, avg(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(a.w || b.w)), 0)::DOUBLE) AS mean
  FROM (SELECT conv_id, turn, {sets} AS w FROM conversations WHERE role = 'assistant') a
  JOIN (SELECT conv_id, turn, {sets} AS w FROM conversations WHERE role = 'assistant') b ON a.conv_id = b.conv_id AND a.turn < b.turn
  GROUP BY 1) p ON p.prompt_id = s.prompt_id"""


def _echo(relation: str) -> str:
    """The echo generator's three texts: lines of the prompt."""
    l1, l2, l3 = (f"string_split(p, chr(10))[{i}]" for i in (2, 3, 4))
    texts = f"[{l1}, {l1} || ' ' || {l2}, {l3}]"
    best = (
        f"list_sort(list_transform(range(1, 4), lambda i: {{'s': -CASE WHEN {count_words('(texts[i])')} <= 50 THEN {count_words('(texts[i])')} ELSE 0 END, "
        "'i': i, 't': texts[i]}))[1].t"
    )

    def w(i: int) -> str:
        return f"list_distinct({words(f'lower(texts[{i}])')})"

    def j(a: int, b: int) -> str:
        return f"len(list_intersect({w(a)}, {w(b)})) / len(list_distinct({w(a)} || {w(b)}))::DOUBLE"

    mean = f"(({j(1, 2)}) + ({j(1, 3)}) + ({j(2, 3)})) / 3"
    return f"""SELECT *, {best} AS forecast_text, least(1.0, greatest(0.1, {mean})) AS confidence_score FROM (
 SELECT *, {texts} AS texts FROM ({relation}))"""


def bleu4_expression() -> str:
    """BLEU-4 over token lists g, r and their n-grams g2, r2, ..."""

    def log_precision(n: int) -> str:
        a, b = ("g", "r") if n == 1 else (f"g{n}", f"r{n}")
        shared = overlap(a, b)
        return f"ln(CASE WHEN {shared} > 0 THEN {shared} ELSE 0.1 END::DOUBLE / greatest(len(g) - {n - 1}, 1))"

    mean = " + ".join(log_precision(n) for n in (1, 2, 3, 4))
    return f"""CASE WHEN len(list_intersect(g, r)) > 0 THEN exp(0.25::DOUBLE * ({mean})
 + CASE WHEN len(g) > len(r) THEN 0.0 ELSE 1.0 - len(r)::DOUBLE / greatest(len(g), 1) END) ELSE 0.0 END"""


def _bleu4() -> str:
    staged = ", ".join(f"{grams(a, n)} AS {a}{n}" for a in "gr" for n in (2, 3, 4))
    return f"SELECT conv_id, turn, round({bleu4_expression()}, 6) AS bleu4 FROM (SELECT *, {staged} FROM pair_tokens)"


def _doc_counts() -> str:
    toks = tokens("text")
    return f"""WITH t AS (SELECT doc_id, unnest({toks}) AS w FROM documents),
 c AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY 1, 2), s AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY 1),
 o AS (SELECT a.doc_id, sum(least(a.n, b.n)) AS o FROM c a JOIN c b ON b.doc_id = a.doc_id + 1 AND b.w = a.w GROUP BY 1)
 SELECT d.doc_id, round(coalesce(2.0::DOUBLE * o.o / (s1.n + s2.n), 0.0), 6) AS f1 FROM documents d
 JOIN documents e ON e.doc_id = d.doc_id + 1 LEFT JOIN o ON o.doc_id = d.doc_id LEFT JOIN s s1 ON s1.doc_id = d.doc_id
 LEFT JOIN s s2 ON s2.doc_id = d.doc_id + 1"""


def _report() -> str:
    def line(label: str, column: str, digits: int = 4, unit: str = "") -> str:
        return f"{lit(f'- **{label}**: ')} || printf('%.{digits}f', {column}) || {lit(unit)}"

    body = [
        lit("\n# Weather Forecasting Model Evaluation Report"),
        lit("Generated on: 2024-02-01 00:00:00\n"),
        lit("## Text Similarity Metrics"),
        line("BLEU Score", "bleu_score"),
        line("ROUGE-1 F1", "rouge_1_f"),
        line("ROUGE-2 F1", "rouge_2_f"),
        line("ROUGE-L F1", "rouge_l_f"),
        lit("\n## Meteorological Accuracy"),
        line("Rain Prediction Accuracy", "rain_accuracy"),
        line("Temperature MAE", "temperature_mae", 2, "°C"),
        line("Wind Speed MAE", "wind_speed_mae", 2, " km/h"),
        line("Categorical Accuracy", "categorical_accuracy"),
        lit("\n## Style and Fluency"),
        line("Readability Score", "readability_score"),
        line("Length Similarity", "length_similarity"),
        line("Vocabulary Diversity", "vocabulary_diversity"),
        lit("\n## Overall Performance"),
        line("Overall Score", "overall_score"),
        "'- **95% Confidence Interval**: [' || printf('%.4f', confidence_interval_low) || ', ' || printf('%.4f', confidence_interval_high) || ']'",
        lit("\n## Interpretation"),
        lit("- BLEU/ROUGE scores measure text similarity to reference forecasts"),
        lit("- Meteorological accuracy measures factual correctness of predictions"),
        lit("- Style metrics assess human-like forecast characteristics"),
        lit("- Overall score combines all metrics with domain-appropriate weights"),
        lit("\n## Recommendations"),
        f"CASE WHEN overall_score > 0.7 THEN '- ✅ {VERDICTS[0][1]}' WHEN overall_score > 0.5 THEN '- ✅ {VERDICTS[1][1]}' "
        f"ELSE '- ⚠️ {VERDICTS[2][1]}' END || CASE WHEN rain_accuracy < 0.7 THEN chr(10) || '- 🌧️ {FLAGS['rain']}' ELSE '' END"
        f" || CASE WHEN temperature_mae > 3.0 THEN chr(10) || '- 🌡️ {FLAGS['temperature']}' ELSE '' END"
        f" || CASE WHEN readability_score < 0.6 THEN chr(10) || '- 📝 {FLAGS['readability']}' ELSE '' END",
        "''",
    ]
    return "(" + " || chr(10) || ".join(f"({b})" for b in body) + ")"


_FLAG_SQL = f"""array_to_string(list_filter([CASE WHEN rain_accuracy < 0.7 THEN '{FLAGS['rain']}' END,
 CASE WHEN temperature_mae > 3.0 THEN '{FLAGS['temperature']}' END,
 CASE WHEN readability_score < 0.6 THEN '{FLAGS['readability']}' END], lambda x: x IS NOT NULL), '|')"""
_VERDICT_SQL = (
    f"CASE WHEN overall_score > 0.7 THEN '{VERDICTS[0][1]}' WHEN overall_score > 0.5 THEN '{VERDICTS[1][1]}' ELSE '{VERDICTS[2][1]}' END"
)


def _evaluation_log() -> str:
    pairs = [(f"nlg/{m}", m) for m in metriclog.NLG]
    pairs += [(f"weather/{name}", column) for name, column in metriclog.WEATHER.items()]
    pairs += [(f"eval/{m}", m) for m in metriclog.EVAL]
    rows = " UNION ALL ".join(f"SELECT band, '{key}' AS key, {r6(column)} AS value FROM e" for key, column in pairs)
    return f"SELECT * FROM (WITH e AS ({evaluation(['band'])}) {rows})"


_NUMBER_TEXTS = ", ".join(f"{number_list(n, d)} AS {n}" for n, d in DIGITS.items())
_CITY_ROWS = ", ".join(f"({i}, {lit(n)}, {lat}::DOUBLE, {lon}::DOUBLE, {lit(c)})" for i, (n, lat, lon, c) in enumerate(ingest.CITIES))
_STEP_COLUMNS = [
    "latitude", "longitude", "temperature_c", "humidity_pct", "pressure_hpa", "wind_speed", "wind_direction_deg",
    "precipitation_probability", "precipitation_mm", "cloud_cover_pct",
]


def oracle() -> dict[str, str]:
    q: dict[str, str] = {}
    arrays = ", ".join(f"{r6(c)} AS {c}" for c in _ARRAYS)
    q["flatten_hourly"] = with_ctes(
        f"SELECT location_name, epoch_us(datetime) AS datetime, {arrays} FROM good_steps", "good_steps"
    )
    q["normalize_units"] = with_ctes(
        f"SELECT location_name, epoch_us(datetime) AS datetime, {r6('wind_speed * 3.6::DOUBLE')} AS wind_speed_kph, "
        f"{r6('precipitation_probability / 100.0')} AS precipitation_probability FROM good_steps",
        "good_steps",
    )
    q["union_current_hourly"] = with_ctes(
        f"""SELECT location_name, count(*) AS "rows", count(precipitation_mm) AS with_precipitation,
 {r6('sum(temperature_c)')} AS sum_temperature FROM (
 SELECT location_name, temperature_c, precipitation_mm FROM good_steps UNION ALL
 SELECT location_name, temperature_c[1], NULL FROM blocks WHERE location_name IS NOT NULL) GROUP BY 1""",
        "good_steps",
    )
    q["quarantine_blocks"] = with_ctes(
        "SELECT CASE WHEN location_name IS NULL THEN 'no location' WHEN label = 8 THEN 'short array' END AS reason, "
        "count(*) AS blocks FROM blocks GROUP BY 1",
        "blocks",
    )
    q["observations_table"] = with_ctes(
        f"""SELECT location_name, {r6('latitude')} AS latitude, {r6('longitude')} AS longitude, epoch_us(datetime) AS datetime,
 {r6('temperature_c')} AS temperature_c, {r6('humidity_pct')} AS humidity_pct, {r6('pressure_hpa')} AS pressure_hpa,
 {r6('wind_speed * 3.6::DOUBLE')} AS wind_speed_kph, {r6('wind_direction_deg')} AS wind_direction_deg,
 {r6('coalesce(precipitation_mm, 0)')} AS precipitation_mm,
 {r6('coalesce(precipitation_probability / 100.0, 0)')} AS precipitation_probability,
 {r6('coalesce(cloud_cover_pct, 0)')} AS cloud_cover_pct, CAST(NULL AS DOUBLE) AS visibility_km, CAST(NULL AS INT) AS weather_code
 FROM (SELECT location_name, latitude, longitude, datetime, temperature_c, humidity_pct, pressure_hpa, wind_speed,
  wind_direction_deg, precipitation_mm, precipitation_probability, cloud_cover_pct FROM good_steps UNION ALL
 SELECT location_name, latitude, longitude, make_timestamp(start_s * 1000000), temperature_c[1], humidity_pct[1], pressure_hpa[1],
  wind_speed[1], wind_direction_deg[1], NULL, NULL, NULL FROM blocks WHERE location_name IS NOT NULL)""",
        "good_steps",
    )
    q["profile_observations"] = with_ctes(
        "SELECT count(*) AS records, epoch_us(min(datetime)) AS first_datetime, epoch_us(max(datetime)) AS last_datetime, "
        "count(DISTINCT location_name) AS locations FROM obs_raw",
        "obs_raw",
    )
    q["observed_locations"] = with_ctes("SELECT DISTINCT location_name FROM obs_raw", "obs_raw")
    q["enrich_locations"] = (
        f"""SELECT coalesce(d.name, 'Elsewhere') AS location_name, c.c_custkey, d.latitude, d.longitude, d.country FROM customer c
 LEFT JOIN (VALUES {_CITY_ROWS}) AS d(i, name, latitude, longitude, country) ON d.i = c.c_nationkey"""
    )
    minimums = ", ".join(f"('{k}', {v}::BIGINT)" for k, v in MINIMUMS.items())
    q["readiness_report"] = with_ctes(
        f"""SELECT m.split, m.minimum, coalesce(s.n, 0) AS "rows", coalesce(s.bad, 0) AS incomplete,
 coalesce(s.n, 0) >= m.minimum AND coalesce(s.bad, 0) = 0 AS ready FROM (VALUES {minimums}) AS m(split, minimum)
 LEFT JOIN (SELECT split, count(*) AS n, count(*) FILTER (input IS NULL OR target IS NULL) AS bad FROM split_corpus GROUP BY 1) s
 ON s.split = m.split""",
        "split_corpus",
    )

    q["sliding_sequences"] = with_ctes(
        f"SELECT location_name, epoch_us(datetime) AS datetime, event_id, {_NUMBER_TEXTS} FROM win", "win"
    )
    aggregates = ", ".join(
        f"{r6(c)} AS {c}" for c in ("avg_temp", "max_temp", "min_temp", "avg_humidity", "max_wind", "avg_precip")
    )
    q["horizon_aggregates"] = with_ctes(
        f"SELECT location_name, epoch_us(datetime) AS datetime, event_id, {aggregates} FROM win", "win"
    )
    q["first_l_per_location"] = with_ctes(
        f"SELECT location_name, epoch_us(datetime) AS datetime, {_NUMBER_TEXTS} FROM firsts", "firsts"
    )
    q["render_prompt"] = with_ctes(
        f"SELECT event_id, {prompt('location_name', minute('datetime'))} AS prompt FROM win", "win"
    )
    q["render_payload_prompt"] = with_ctes(
        f"SELECT r.request_id, coalesce({_payload_prompt()}, {_city_prompt()}) AS input_prompt FROM reqs r {_CITY_JOIN}", "reqs", "corpus"
    )
    q["wrap_chat"] = with_ctes(
        f"""SELECT sample_id, md5({_serving('input')}) AS serving,
 md5({lit(render.CHAT_OPEN)} || input || {lit(render.CHAT_TURN)}) AS training_prompt, target || '</s>' AS training_response FROM corpus""",
        "corpus",
    )
    q["lookup_prompt"] = with_ctes(f"SELECT r.request_id, {_city_prompt()} AS prompt FROM reqs r {_CITY_JOIN}", "reqs", "corpus")
    q["condition_mix"] = with_ctes(
        f"""SELECT {condition('avg_precip', 'max_wind', 'avg_humidity')} AS condition, count(*) AS windows,
 {r6('avg(' + count_words(_HORIZON) + ')')} AS mean_words FROM win GROUP BY 1""",
        "win",
    )
    q["label_bands"] = with_ctes(
        f"""SELECT {temp_band('avg_temp')} AS temp_band, {precip_band('avg_precip')} AS precip_band,
 {condition('avg_precip', 'max_wind', 'avg_humidity')} AS condition, count(*) AS windows FROM win GROUP BY 1, 2, 3""",
        "win",
    )
    q["templated_bulletin"] = with_ctes(f"SELECT event_id, {templated()} AS target FROM win", "win")
    q["deterministic_bulletin"] = with_ctes(f"SELECT event_id, {_HORIZON} AS target FROM win", "win")
    q["fallback_sentence"] = with_ctes(f"SELECT request_id, {_fallback()} AS forecast FROM reqs", "reqs")

    q["exact_split"] = with_ctes("SELECT sample_id, split FROM split_corpus", "split_corpus")
    q["training_records"] = with_ctes("SELECT * FROM corpus", "corpus")
    n = count_words("response")
    q["corpus_stats"] = with_ctes(
        f"""SELECT split, count(*) AS total_samples, count(DISTINCT location) AS unique_locations,
 {r6(f'avg({n})')} AS avg_response_length, {r6(f'stddev_pop({n})')} AS response_length_std,
 min({n}) AS min_response_length, max({n}) AS max_response_length FROM split_corpus GROUP BY 1""",
        "split_corpus",
    )
    q["corpus_locations"] = with_ctes("SELECT DISTINCT location FROM corpus", "corpus")
    q["take_first"] = with_ctes(
        "SELECT sample_id, target FROM (SELECT * FROM corpus ORDER BY location, datetime, sample_id LIMIT 25)", "corpus"
    )
    q["shuffled_batches"] = with_ctes(
        """SELECT sample_id, position, CAST(floor((position - 1) / 16) AS BIGINT) AS batch FROM (
 SELECT event_id AS sample_id, row_number() OVER (ORDER BY md5('42:' || event_id)) AS position FROM win)""",
        "win",
    )
    q["concat_example"] = with_ctes(
        "SELECT sample_id, md5(input || chr(10) || target || '</s>') AS text_md5 FROM corpus", "corpus"
    )
    q["build_vocab"] = with_ctes("SELECT token, uses, id FROM vocab", "encoded")
    q["encode_vocab"] = (
        "WITH " + _vocab("documents", ["text"]) + f""" SELECT d.doc_id, md5(coalesce(x.s, '')) AS ids_md5 FROM documents d LEFT JOIN (
 SELECT t.doc_id, string_agg(CAST(v.id AS VARCHAR), ',' ORDER BY t.pos) AS s FROM (SELECT doc_id, unnest({words('text')}) AS token,
 unnest(range(1, {count_words('text')} + 1)) AS pos FROM documents) t JOIN vocab v ON v.token = t.token GROUP BY 1) x ON x.doc_id = d.doc_id"""
    )
    ones = "list_transform(p || r, lambda z: 1)"
    masked = "(list_transform(p, lambda z: -100) || r)"
    q["response_only_arrays"] = with_ctes(
        f"""SELECT sample_id, {_fit('p || r', 512, 0)} AS input_ids, {_fit(ones, 512, 0)} AS attention_mask,
 {_fit(masked, 512, -100)} AS labels, least(512, len(p) + len(r)) - least(512, len(p)) AS trained FROM encoded""",
        "encoded",
    )
    q["full_sequence_arrays"] = with_ctes(
        f"""SELECT sample_id, {_fit('p || r', 512, 0)} AS input_ids, {_fit(ones, 512, 0)} AS attention_mask,
 {_fit('p || r', 512, 0)} AS labels FROM encoded""",
        "encoded",
    )

    def conditions(t: str, tag: str) -> str:
        return (
            f"{rain_signal(t)} AS {tag}_rain, {bound(t, extract.TEMPERATURE, False)} AS {tag}_lo, "
            f"{bound(t, extract.TEMPERATURE, True)} AS {tag}_hi, {wind(t)} AS {tag}_wind"
        )

    both = f"(SELECT event_id, {templated()} AS target, {_HORIZON} AS plain FROM win)"
    q["extract_conditions"] = with_ctes(
        f"SELECT event_id, {conditions('target', 'templated')}, {conditions('plain', 'plain')} FROM {both}", "win"
    )
    low = "lower(target)"
    f_rain = verdict(hits(low, extract.REWARD_RAIN), hits(low, extract.REWARD_CLEAR))
    lo, hi = (bound("target", extract.REWARD_TEMPERATURE, h) for h in (False, True))
    q["reward_features"] = with_ctes(
        f"""SELECT event_id, {f_rain} AS rain, {lo} AS lo, {hi} AS hi, {contains(low, extract.HEDGES)} AS hedges,
 {count_words('target')} AS words, ({lo}) IS NOT NULL OR ({f_rain}) IS NOT NULL AS specific FROM {both}""",
        "win",
    )
    uni = r6(f1(overlap("g", "r"), "g", "r"))
    q["overlap_f1"] = with_ctes(f"SELECT conv_id, turn, len(g) AS tokens, {uni} AS f1 FROM pair_tokens", "pair_tokens")
    q["overlap_f1_long"] = _doc_counts()
    q["overlap_f1_any"] = _doc_counts()
    q["rouge_fallback"] = with_ctes(
        f"""SELECT conv_id, turn, {uni} AS rouge_1, {r6(f1(overlap('g2', 'r2'), 'g2', 'r2'))} AS rouge_2, {uni} AS rouge_l
 FROM (SELECT *, {grams('g', 2)} AS g2, {grams('r', 2)} AS r2 FROM pair_tokens)""",
        "pair_tokens",
    )
    q["bleu4"] = with_ctes(_bleu4(), "pair_tokens")
    q["style_metrics"] = with_ctes(
        f"""SELECT conv_id, turn, {r6(length_similarity('answer', 'question'))} AS length_similarity,
 {r6(diversity('answer'))} AS vocabulary_diversity, {r6(readability('answer'))} AS readability FROM text_pairs""",
        "text_pairs",
    )

    q["prediction_table"] = with_ctes(
        """SELECT p.sample_id, p.generated_forecast, p.reference_forecast,
 CASE WHEN p.sample_id % 5 <> 0 THEN p.location ELSE 'Unknown' END AS location, p.datetime FROM pred p WHERE wind_term = 'winds'""",
        "pred",
    )
    q["evaluate_global"] = with_ctes(evaluation_rounded([]), "scored")
    q["evaluate_by_location"] = with_ctes(evaluation_rounded(["location"]), "scored")
    q["evaluate_rollup"] = with_ctes(evaluation_rounded(["wind_term", "band"], rollup=True), "scored")
    q["brier_score"] = (
        "SELECT toxic, round(coalesce(avg(((doc_id * 37 % 101)::DOUBLE / 100 - quality) ** 2), 1.0), 6) AS brier_score FROM labels GROUP BY 1"
    )
    q["recommendations"] = with_ctes(
        f"SELECT band, {_VERDICT_SQL} AS verdict, {_FLAG_SQL} AS flags FROM ({evaluation(['band'])})", "scored"
    )
    q["evaluation_report"] = with_ctes(f"SELECT band, {_report()} AS report FROM ({evaluation(['band'])})", "scored")

    parts = ["accuracy_reward", "style_reward", "calibration_reward", "factual_consistency", "total_reward"]
    q["reward_components"] = with_ctes(
        "SELECT sample_id, " + ", ".join(f"{r6(p)} AS {p}" for p in parts) + " FROM rewarded", "rewarded"
    )
    other = rewarded("generated_forecast", "rain_seen", "temp_seen", W_OTHER) % (
        "(SELECT *, CASE WHEN obs_rain THEN obs_rain END AS rain_seen, CASE WHEN obs_rain THEN obs_temp END AS temp_seen FROM pred)"
    )
    q["weighted_reward"] = with_ctes(
        f"SELECT location, {r6('avg(total_reward)')} AS mean_total FROM ({other}) GROUP BY 1", "pred"
    )

    def unseen(source: str) -> str:
        return rewarded("target", "no_rain", "no_temp", W_DEFAULT) % (
            f"(SELECT *, CAST(NULL AS BOOLEAN) AS no_rain, CAST(NULL AS DOUBLE) AS no_temp FROM {source})"
        )

    q["mean_reward"] = with_ctes(
        f"SELECT location, count(*) AS samples, {r6('avg(total_reward)')} AS avg_reward FROM ({unseen('corpus')}) GROUP BY 1",
        "corpus",
    )
    first16 = "(SELECT * FROM corpus ORDER BY location, datetime, sample_id LIMIT 16)"
    q["mean_reward_first"] = with_ctes(
        f"SELECT count(*) AS samples, {r6('avg(total_reward)')} AS avg_reward FROM ({unseen(first16)})", "corpus"
    )
    q["training_guards"] = with_ctes(
        f"""SELECT *, reason IS NULL AS accepted FROM (SELECT *, CASE WHEN shortest < 2 THEN 'too-short response'
 WHEN non_finite > 0 THEN 'non-finite reward' END AS reason FROM (SELECT sample_id // 16 AS batch, count(*) AS responses,
 min(CASE WHEN sample_id % 211 = 0 THEN 1 ELSE {count_words('generated_forecast')} END) AS shortest,
 count(*) FILTER (sample_id % 199 = 0) AS non_finite FROM pred GROUP BY 1))""",
        "pred",
    )
    q["reward_range_check"] = with_ctes(
        "SELECT count(*) AS rewards, count(*) FILTER (total_reward IS NULL OR total_reward < 0 OR total_reward > 1) AS violations FROM rewarded",
        "rewarded",
    )

    score = f"CASE WHEN {count_words('text')} <= 50 THEN {count_words('text')} ELSE 0 END"
    q["best_candidate"] = (
        f"""SELECT conv_id AS prompt_id, turn AS idx, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id
 ORDER BY {score} DESC, turn) AS k FROM conversations WHERE role = 'assistant') WHERE k = 1"""
    )
    q["consistency_confidence"] = _jaccard_sql()
    q["parse_requests"] = with_ctes(
        "SELECT request_id, forecast_horizon, include_confidence, reason FROM parsed", "parsed"
    )
    joined = f"""SELECT q.*, f.* EXCLUDE (location_name, datetime), CASE WHEN q.reason IS NOT NULL THEN q.reason WHEN f.location_name IS NULL THEN {lit(forecasts.NO_DATA)} || q.name END AS missing,
 {prompt('q.name', minute(_MADE), {c: number_list('f.' + c, d) for c, d in DIGITS.items()})} AS p
 FROM parsed q LEFT JOIN firsts f ON f.location_name = q.name"""
    q["batch_forecast"] = with_ctes(
        _responses(
            f"SELECT *, missing AS error, {_PERSIST} AS forecast_text, 0.5::DOUBLE AS confidence_score FROM ({joined})", _MADE
        ),
        "parsed",
        "firsts",
    )
    q["batch_forecast_python"] = with_ctes(
        _responses(
            f"SELECT *, coalesce(missing, CASE WHEN name = 'loc_13' THEN 'station is down' END) AS error FROM ({_echo(joined)})",
            _MADE,
        ),
        "parsed",
        "firsts",
    )
    q["response_table"] = with_ctes(
        _responses(
            f"""SELECT p.*, {_fallback().replace('has_payload', 'p.has_payload').replace('city', 'p.city')} AS forecast_text,
 (p.request_id % 10)::DOUBLE / 10 AS confidence_score, coalesce(p.reason, CASE WHEN NOT p.has_payload THEN 'no payload' END) AS error
 FROM parsed p JOIN reqs r ON r.request_id = p.request_id""",
            "make_timestamp(1706769000000000 + request_id * 500000)",
        ),
        "parsed",
    )

    q["normalize_predictions"] = with_ctes("SELECT id, generated_forecast FROM preds", "preds")
    q["gate_rows"] = with_ctes(
        f"""SELECT id, location, passed, {r6('overall_score')} AS overall_score, {r6('reward')} AS reward, required_terms_found,
 forbidden_patterns_found, word_count FROM gate_out""",
        "gate_out",
    )
    q["gate_report"] = with_ctes(
        f"""SELECT location, count(*) AS cases, count(*) FILTER (passed) AS passed,
 {r6('count(*) FILTER (passed) / count(*)::DOUBLE')} AS pass_rate FROM gate_out GROUP BY 1""",
        "gate_out",
    )

    q["namespace_metrics"] = (
        """SELECT event_id, event_id % 50 AS step, 'train/loss' AS key, round(round(value, 2) + 1, 6) AS value FROM events
 UNION ALL SELECT event_id, event_id % 50, 'train/grad_norm', round(round(value, 2) + 2, 6) FROM events WHERE event_id % 50 <> 7
 UNION ALL SELECT event_id, event_id % 50, 'train/epoch', CAST(event_id % 50 AS DOUBLE) FROM events"""
    )
    q["route_log_rows"] = with_ctes(
        f"SELECT event_id, run, step, key, round(value, 6) AS value FROM routed WHERE NOT {_NOT_FINITE}", "routed"
    )
    q["sample_table"] = with_ctes(
        """SELECT location || ' ' || datetime AS "Input", generated_forecast AS "Prediction", reference_forecast AS "Reference"
 FROM (SELECT * FROM pred ORDER BY sample_id LIMIT 10)""",
        "pred",
    )
    q["evaluation_log"] = with_ctes(_evaluation_log(), "scored")
    q["every_nth"] = with_ctes(
        'SELECT run, step, key, count(*) AS "rows" FROM routed WHERE step % 10 = 0 GROUP BY 1, 2, 3', "routed"
    )
    q["non_finite_by_key"] = with_ctes(
        f"SELECT run, key, count(*) AS non_finite FROM routed WHERE {_NOT_FINITE} GROUP BY 1, 2", "routed"
    )
    q["run_health"] = with_ctes(
        f"""SELECT v.*, a.ok_steps, a.failed_steps, a.fatal_errors, a.ok_steps = 0 AS failed FROM
 (SELECT run, count(*) AS "values", count(*) FILTER ({_NOT_FINITE}) AS non_finite FROM routed GROUP BY 1) v JOIN
 (SELECT run, count(*) FILTER (error IS NULL) AS ok_steps, count(*) FILTER (error IS NOT NULL) AS failed_steps,
  count(*) FILTER (coalesce({_FATAL}, false)) AS fatal_errors FROM (SELECT event_type AS run, CASE WHEN event_id % 97 = 0
  THEN 'CUDA error: device-side assert triggered' WHEN event_id % 31 = 0 THEN 'shape mismatch' WHEN event_type = 'error'
  THEN 'value is NaN' END AS error FROM events) GROUP BY 1) a ON a.run = v.run""",
        "routed",
    )
    return q
