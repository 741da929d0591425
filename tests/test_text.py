import re
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratocast.functions import extract, text
from stratocast.functions.render import fixed_text
from stratocast.operators import evaluate


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


def test_extraction_golden(pairs):
    rows = pairs.select(
        "id",
        extract.extract_conditions(F.col("generated_forecast")).alias("g"),
        extract.extract_conditions(F.col("reference_forecast")).alias("r"),
    ).orderBy("id").collect()
    assert rows[0]["g"]["rain"] is None and tuple(rows[0]["g"]["temperature_range"]) == (22, 25)
    assert rows[0]["g"]["wind_speed"] == 15
    assert rows[0]["r"]["rain"] is False and tuple(rows[0]["r"]["temperature_range"]) == (22, 26)
    assert rows[0]["r"]["wind_speed"] is None
    assert rows[1]["g"]["rain"] is True and tuple(rows[1]["g"]["temperature_range"]) == (18, 20)
    assert rows[1]["g"]["wind_speed"] is None
    assert rows[1]["r"]["rain"] is True and tuple(rows[1]["r"]["temperature_range"]) == (17, 21)


@pytest.mark.parametrize(
    "text_, expected",
    [
        ("near -6 to -4C", (2, 6)),
        ("-5-3°C", (5, 3)),
        ("Highs of 25.5 C", (23.5, 27.5)),
        ("nothing", None),
        ("about 7F then 8-9C", (8, 9)),
    ],
)
def test_temperature_range(spark, text_, expected):
    got = one(spark, extract.temperature_range(F.col("t")), t=text_)
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize(
    "text_, expected",
    [
        ("80% chance", True),
        ("20% chance", False),
        ("30% chance", None),
        ("éclear", None),
        ("clear", False),
        ("Rain and thunderstorms, bright", True),
        ("no rain", None),
        ("", None),
        ("99999999999999999999% probability", True),
    ],
)
def test_rain_signal(spark, text_, expected):
    assert one(spark, extract.rain_signal(F.col("t")), t=text_) is expected


@pytest.mark.parametrize(
    "text_, expected",
    [("gusts reaching 30.5 mph", 30.5), ("12 kph wind", 12.0), ("Windy with speeds up to 9", 9.0), ("windless", None)],
)
def test_wind_speed(spark, text_, expected):
    assert one(spark, extract.wind_speed(F.col("t")), t=text_) == expected


def test_reward_features_differ_from_evaluation(spark):
    got = one(spark, extract.reward_features(F.col("t")), t="Cloudy, unlikely to be highs of 20C")
    assert got["rain_prediction"] is True and got["temperature_range"] is None
    assert got["confidence_score"] == 1 and got["text_length"] == 7 and got["has_specifics"]


def py_f1(a, b):
    overlap = sum((Counter(a) & Counter(b)).values())
    return 2 * overlap / (len(a) + len(b)) if overlap else 0.0


def test_similarity_golden(pairs):
    rows = (
        pairs.withColumns(
            {"g": text.metric_tokens(F.col("generated_forecast")), "r": text.metric_tokens(F.col("reference_forecast"))}
        )
        .select(
            text.bleu_overlap(F.col("g"), F.col("r")).alias("bleu"),
            text.rouge_fallback(F.col("g"), F.col("r")).alias("rouge"),
            text.length_similarity(F.col("generated_forecast"), F.col("reference_forecast")).alias("len"),
            text.vocabulary_diversity(F.col("generated_forecast")).alias("div"),
            text.readability(F.col("generated_forecast")).alias("read"),
        )
        .collect()
    )
    expected = [(12 / 31, 4 / 29, 0.9375, 1.0, 1 / 3), (8 / 25, 2 / 23, 0.785714, 1.0, 0.244444)]
    for row, (uni, bi, length, div, read) in zip(rows, expected):
        assert row["bleu"] == pytest.approx(uni)
        assert row["rouge"]["rouge_1"] == row["rouge"]["rouge_l"] == row["bleu"]
        assert row["rouge"]["rouge_2"] == pytest.approx(bi)
        assert row["len"] == pytest.approx(length, abs=1e-6)
        assert row["div"] == div
        assert row["read"] == pytest.approx(read, abs=1e-6)


def test_tokens_and_edges(spark):
    assert one(spark, text.metric_tokens(F.col("t")), t="The rain's IN-land, and 3 by-ways: an a1 théa") == [
        "rain", "s", "land", "3", "ways", "a1", "th",
    ]
    assert one(spark, text.metric_tokens(F.col("t")), t="") == []
    assert one(spark, text.length_similarity(F.col("t"), F.col("t")), t="") == 1.0
    assert one(spark, text.readability(F.col("t")), t="") == 0.0
    assert one(spark, text.readability(F.col("t")), t=" . .. ") == 0.0
    assert one(spark, text.words(F.col("t")), t="a\u00a0b\u2003c\x1fd  e\n") == list("abcde")
    assert one(spark, text.ngrams(F.split("t", ""), 2), t="a") == []


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def ngram(t, n):
    return [tuple(t[i : i + n]) for i in range(len(t) - n + 1)]


def py_bleu4(g, r):
    hits = [sum((Counter(ngram(g, n)) & Counter(ngram(r, n))).values()) for n in range(1, 5)]
    if not hits[0]:
        return 0.0
    ps = [(h or 0.1) / max(len(ngram(g, n)), 1) for n, h in enumerate(hits, 1)]
    bp = 1.0 if len(g) > len(r) else math.exp(1 - len(r) / len(g))
    return bp * math.exp(sum(math.log(p) / 4 for p in ps))


def test_token_metrics_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        g = [rng.choice("uvwxyz") for _ in range(rng.randrange(0, 12))]
        r = [rng.choice("uvwxyz") for _ in range(rng.randrange(0, 90 if i % 10 == 0 else 12))]
        rows.append((i, g, r))
    df = spark.createDataFrame(rows, "id int, g array<string>, r array<string>")
    got = df.select(
        "id",
        text.overlap_f1(F.col("g"), F.col("r")).alias("f1"),
        text.rouge_n(F.col("g"), F.col("r"), 2).alias("r2"),
        text.rouge_n(F.col("g"), F.col("r"), 3).alias("r3"),
        text.bleu4(F.col("g"), F.col("r")).alias("bleu4"),
        text.rouge_l_lcs(F.col("g"), F.col("r")).alias("lcs"),
    ).collect()
    by_id = {r["id"]: r for r in got}
    for i, g, r in rows:
        row = by_id[i]
        assert row["f1"] == pytest.approx(py_f1(g, r))
        assert row["r2"] == pytest.approx(py_f1(ngram(g, 2), ngram(r, 2)))
        assert row["r3"] == pytest.approx(py_f1(ngram(g, 3), ngram(r, 3)))
        assert row["bleu4"] == pytest.approx(py_bleu4(g, r))
        n = lcs(g, r)
        assert row["lcs"] == pytest.approx(2 * n / (len(g) + len(r)) if n else 0.0)


def test_bleu4_of_long_texts(spark):
    many = [f"t{i * i % 701}" for i in range(20_000)]
    rows = [(0, ["a", "b"], ["a"]), (1, [], ["a"]), (2, ["a"], []), (3, list("abcabc"), list("abcab"))]
    many = [f"t{i * i % 701}" for i in range(20_000)]
    rows += [(100, many, many[5_000:] + many[:4_000]), (101, many, ["none"])]
    df = spark.createDataFrame(rows, "id int, g array<string>, r array<string>")
    long = {r["id"]: r["bleu4"] for r in evaluate.bleu4_long(df, ["id"], "g", "r").collect()}
    for i, g, r in rows:
        assert long[i] == pytest.approx(py_bleu4(g, r))


def test_exploded_overlap_equals_array_form(spark):
    rng = random.Random(7)
    make = lambda n: " ".join(rng.choice(["rain", "sun", "the", "Wind.", "dry", "fog"]) for _ in range(n))
    rows = [(i, make(rng.randrange(0, 40)), make(rng.randrange(0, 40))) for i in range(60)] + [(99, "", ""), (98, None, "sun")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    for n in (1, 2):
        short = {
            r["id"]: r["f1"]
            for r in df.select(
                "id",
                text.rouge_n(text.metric_tokens(F.col("a")), text.metric_tokens(F.col("b")), n).alias("f1"),
            ).collect()
        }
        long = {r["id"]: r["f1"] for r in evaluate.overlap_f1_long(df, ["id"], "a", "b", n=n).collect()}
        assert long == pytest.approx(short) and len(long) == len(rows)
    mixed = {r["id"]: r["f1"] for r in evaluate.overlap_f1_any(df, ["id"], "a", "b", long_words=15).collect()}
    plain = {r["id"]: r["f1"] for r in evaluate.overlap_f1_any(df, ["id"], "a", "b").collect()}
    assert mixed == pytest.approx(plain)


def test_fixed_text_equals_printf(spark):
    rng = random.Random(3)
    values = [0.25, 0.35, 0.05, 0.15, -0.25, -0.3, -0.04, 0.0, -0.0, 0.5, 1.5, 2.5, -0.5, 1e-9, 1005.85, 2.675, 0.005, 0.125]
    values += [rng.randrange(-5000, 5000) / 10 for _ in range(300)] + [rng.randrange(-5000, 5000) / 100 for _ in range(300)]
    values += [rng.randrange(-99999, 99999) / 1000 for _ in range(600)] + [rng.uniform(-1e6, 1e6) for _ in range(300)]
    values += [rng.randrange(-999, 999) + 0.5 for _ in range(50)] + [999999999.95, 0.95, 9.995, float("nan"), 1e14]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 4):
        got = [r[0] for r in df.select(fixed_text(F.col("v"), digits)).collect()]
        assert got == [f"{v:.{digits}f}" for v in values]


def test_counts_of_a_task_do_not_grow_with_the_table(spark, monkeypatch):
    """The n-grams are dealt by the measured size of the texts, also where the rows come dealt by their identity."""
    monkeypatch.setattr(evaluate, "TASK_CHARS", 20)
    df = spark.createDataFrame([(i, "rain wind rain", "wind dry") for i in range(10)] + [(10, None, "x")], "id int, a string, b string")
    out = evaluate.overlap_f1_long(df.repartition(2, "id"), ["id"], "a", "b")
    assert next(line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in line and "_gram" in line).endswith(", 12")
    assert {r["id"]: round(r["f1"], 6) for r in out.collect()} == {**dict.fromkeys(range(10), 0.4), 10: 0.0}


@pytest.mark.parametrize("task_chars", [8_000_000, 400, 8])
def test_exploded_overlap_of_repeated_and_missing_identities(spark, monkeypatch, task_chars):
    """Rows of one identity are one text together, wherever they are counted."""
    monkeypatch.setattr(evaluate, "TASK_CHARS", task_chars)
    rng = random.Random(8)
    make = lambda: " ".join(rng.choice(["rain", "sun", "the", "Wind.", "dry", "fog"]) for _ in range(rng.randrange(0, 20)))
    rows = [(i, "x", make(), make()) for i in range(20)] + [(3, "x", make(), make())] * 2 + [(3, None, make(), None), (None, None, "", "sun")]
    rows += [(None, "x", make(), make()) for _ in range(3)] + [(30, "x", None, None), (31, "x", "", "the"), (32, "x", "sun sun dry", "dry sun sun")]
    df = spark.createDataFrame(rows, "id int, kind string, a string, b string").repartition(3)
    tokens = lambda s: [t for t in re.findall("[a-z0-9]+", (s or "").lower()) if t not in text.STOPWORDS]
    for n in (1, 2, 3):
        sides = {}
        for i, kind, a, b in rows:
            for side, words in zip(sides.setdefault((i, kind), (Counter(), Counter())), (tokens(a), tokens(b))):
                side.update(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
        want = {k: 2 * (a & b).total() / max((a + b).total(), 1) for k, (a, b) in sides.items()}
        got = evaluate.overlap_f1_long(df, ["id", "kind"], "a", "b", n=n).collect()
        assert len(got) == len(want) and {(r["id"], r["kind"]): r["f1"] for r in got} == pytest.approx(want)


def test_ngrams_of_short_texts_are_not_shuffled(spark):
    """Only long texts, and those that share an identity, meet by n-gram; then each n-gram of a text goes once."""
    df = spark.createDataFrame([(i, "rain wind rain", "wind dry") for i in range(10)], "id int, a string, b string")
    out = evaluate.overlap_f1_long(df, ["id"], "a", "b")
    assert "_gram" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [round(r["f1"], 6) for r in out.collect()] == [0.4] * 10
    runs = df.limit(1).select(text.runs(text.metric_tokens(F.col("a"))).alias("r")).first()["r"]
    assert [tuple(r) for r in runs] == [("rain", 2), ("wind", 1)]


def test_extraction_scans_a_text_without_the_literals_by_no_regex(spark):
    """Every pattern with a regex of its own has literals, each of its matches holds one, and blanks are not rebuilt."""
    patterns = [*extract.RAIN, *extract.CLEAR, extract.CHANCE, *extract.TEMPERATURE[:3], *extract.WIND, *extract.REWARD_RAIN, *extract.REWARD_CLEAR]
    assert set(patterns) == set(extract.LITERALS)
    samples = [
        "rain", "showers", "shower", "precipitation", "wet", "drizzle", "stormy", "storm", "thunderstorms", "downpour", "cloudbursts", "clear", "sunny",
        "bright", "fair", "no rain", "dry", "arid", "cloudy", "overcast", "grey", "gray", "cloudless", "storms", "30% chance", "5%likelihood", "3-5C", "3 \u2013 5 F",
        "around 4C", "near 3.5 F", "about  7\u00b0C", "highs of 8C", "high 9F", "temperature 3C", "temperatures of 4F", "wind 5 km/h", "gusts up to 6mph",
        "winds reaching 7 kph", "8 km/h wind", "9mph  winds", "10 kph wind", "windy with 11", "windy  with speeds up to 12",
    ]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    for pattern in patterns:
        rows = df.select(F.rlike("t", F.lit("(?U)" + pattern)).alias("hit"), extract._may_match(F.col("t"), pattern).alias("may")).collect()
        assert any(r["hit"] for r in rows) and all(r["may"] for r in rows if r["hit"]) and not all(r["may"] for r in rows)
    blanks = df.limit(1).select(F.lit(" \t\u00a0\u3000x").alias("t")).select(text.even_space(F.col("t"))).first()[0]
    assert blanks == "    x" and not re.match(r"\[ ", text._ODD_SPACE)


def test_bleu4_counts_repeats_only_where_both_sides_repeat(spark):
    """Clipped counts by sets where a side repeats nothing; equal to plain counting."""
    rng = random.Random(4)
    rows = [([rng.choice("abc") for _ in range(rng.randrange(9))], [rng.choice("abcdefgh") for _ in range(rng.randrange(9))]) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")

    def hits(a, b, n):
        grams = [Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for s in (a, b)]
        return sum((grams[0] & grams[1]).values())

    for (a, b), got in zip(rows, df.select("a", "b", text.bleu4(F.col("a"), F.col("b")).alias("s")).collect(), strict=True):
        h = [hits(a, b, n) for n in (1, 2, 3, 4)]
        logs = [math.log(max(h[n], 0.1) / max(len(a) - n, 1)) for n in range(4)]
        want = math.exp(sum(logs) / 4 + (0 if len(a) > len(b) else 1 - len(b) / max(len(a), 1))) if h[0] else 0.0
        assert got["s"] == pytest.approx(want)
