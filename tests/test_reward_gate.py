import pytest
from pyspark.sql import functions as F

from stratocast.functions.reward import normalize_weights
from stratocast.operators import evaluate, gate, rewards
from stratocast.schemas import QUALITY_CASE

CASES = [
    ("nairobi", "Nairobi should stay mild and mostly dry, with temperatures near 23-25C and breezy winds around 10-15 km/h.",
     ["mild", "dry", "breezy"], False, 24.0, 0.9867, 0.892),
    ("london", "London is likely to be cool and wet, with showers developing, temperatures around 15-16C, and winds increasing toward 30 km/h.",
     ["showers", "cool", "winds"], True, 15.5, 0.9667, 0.984),
    ("phoenix", "Phoenix should remain hot and dry, with temperatures climbing into the mid to upper 30s C and light winds near 10 km/h.",
     ["hot", "dry", "light winds"], False, 36.0, 0.9533, 0.892),
    ("mumbai", "Mumbai should be warm and very humid, with rain becoming likely and winds around 20-22 km/h.",
     ["humid", "rain", "warm"], True, 29.0, 0.9933, 0.952),
    ("toronto", "Toronto should stay cold and mainly dry, with temperatures near -6 to -4C and brisk winds around 20 km/h.",
     ["cold", "dry", "brisk"], False, -5.0, 0.9733, 0.892),
]
FORBIDDEN = ["\\|", "Generate a forecast", "<\\|user\\|>", "\\[/INST\\]"]


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(i, i.title(), "Weather data", text, terms, FORBIDDEN, (rain, temp)) for i, text, terms, rain, temp, *_ in CASES]
    return spark.createDataFrame(rows, QUALITY_CASE)


def test_evaluate_golden(pairs):
    row = evaluate.evaluate(pairs).first()
    assert row["overall_score"] == pytest.approx(0.506469, abs=1e-6)
    assert (row["rain_accuracy"], row["temperature_mae"], row["wind_speed_mae"]) == (1.0, 0.25, 0.0)
    assert row["categorical_accuracy"] == 0.5
    assert row["bleu_score"] == pytest.approx(0.353548, abs=1e-6) and row["rouge_l_f"] == row["rouge_1_f"]
    assert row["rouge_2_f"] == pytest.approx(0.112444, abs=1e-6)
    assert row["brier_score"] == row["reliability"] == row["resolution"] == 0.0
    assert row["confidence_interval_low"] == pytest.approx(0.406469, abs=1e-6)
    assert row["confidence_interval_high"] == pytest.approx(0.606469, abs=1e-6)
    advice = evaluate.recommendations(evaluate.evaluate(pairs)).first()
    assert advice["verdict"].startswith("Good") and advice["flags"] == [evaluate.FLAGS["readability"]]


def test_report_text(pairs):
    text = evaluate.render_report(evaluate.evaluate(pairs), "2026-01-01 00:00:00").first()["report"]
    assert "- **BLEU Score**: 0.3535\n" in text and "- **Temperature MAE**: 0.25°C\n" in text
    assert "[0.4065, 0.6065]" in text and text.endswith("- 📝 Focus on improving forecast readability and style\n")


def test_evaluate_groups_and_empty(pairs, spark):
    by = {r["location"]: r["predictions"] for r in evaluate.evaluate(pairs, by=["location"], rollup=True).collect()}
    assert by == {None: 2, "New York": 1, "London": 1}
    assert evaluate.evaluate(pairs.limit(0)).count() == 0
    assert evaluate.brier_score(spark.createDataFrame([], "p double, outcome boolean")).first()[0] == 1.0
    probs = spark.createDataFrame([(0.9, True), (0.2, False)], "p double, outcome boolean")
    assert evaluate.brier_score(probs).first()[0] == pytest.approx(0.025)


def test_reward_golden(spark):
    rows = [
        (1, "Partly cloudy with temperatures around 22-25C. Light winds up to 15 km/h. Showers possible by evening.", (True, 23.5)),
        (2, "Weather expected.", (False, 20.0)),
        (3, "Clear, around 10C", (True, 30.0)),
        (4, "Weather expected.", None),
        (5, "Weather expected.", (None, None)),
    ]
    df = spark.createDataFrame(rows, "id int, text string, observed struct<rain:boolean,temperature:double>")
    got = {r["id"]: r for r in rewards.composite_reward(df, "text", "observed").collect()}
    parts = lambda r: (r["accuracy_reward"], r["style_reward"], r["calibration_reward"], r["factual_consistency"], r["total_reward"])
    assert parts(got[1]) == pytest.approx((1.0, 0.84, 1.0, 1.0, 0.968))
    assert parts(got[2]) == pytest.approx((0.5, 0.36, 1.0, 0.5, 0.572))
    assert got[3]["accuracy_reward"] == 0.0
    assert got[4]["accuracy_reward"] == got[5]["accuracy_reward"] == 0.5
    assert rewards.reward_range_check(rewards.composite_reward(df, "text", "observed")).first() == (5, 0)
    assert normalize_weights(1, 1, 1, 1)["style"] == 0.25


def test_mean_reward_prefers_and_limits(spark):
    rows = [(1, "", "Weather expected."), (2, "Rain likely around 20C.", "x"), (3, "zzz", "zzz")]
    df = spark.createDataFrame(rows, "id int, target string, response string")
    all_rows = rewards.mean_reward(df, None, ["id"]).first()
    two = rewards.mean_reward(df, 2, ["id"]).first()
    assert all_rows["samples"] == 3 and two["samples"] == 2 and two["avg_reward"] > all_rows["avg_reward"]
    assert rewards.mean_reward(df.limit(0), 5, ["id"]).first()["avg_reward"] == 0.0


def test_training_guards(spark):
    rows = [(0, 5, 0.5), (0, 1, 0.5), (1, 4, float("nan")), (2, 3, 0.1), (3, 3, None), (4, 2, float("inf"))]
    df = spark.createDataFrame(rows, "batch int, tokens int, total_reward double")
    got = {r["batch"]: r["reason"] for r in rewards.training_guards(df).collect()}
    assert got == {
        0: "too-short response", 1: "non-finite reward", 2: None, 3: "non-finite reward", 4: "non-finite reward",
    }


def test_gate_passes_on_references(cases):
    rows = {r["id"]: r for r in gate.gate_rows(gate.attach_predictions(cases)).collect()}
    for name, *_, overall, reward in CASES:
        assert rows[name]["passed"]
        assert rows[name]["overall_score"] == pytest.approx(overall, abs=1e-4)
        assert rows[name]["reward"] == pytest.approx(reward, abs=1e-4)


def test_gate_failures_and_report(cases, spark):
    preds = spark.createDataFrame(
        [("london", "Generate A forecast | London cool showers winds, likely wet around 15-16C expected."), ("mumbai", "Rain.")],
        "id string, generated_forecast string",
    )
    without_terms = cases.withColumn(
        "required_terms", F.when(F.col("id") == "toronto", F.array().cast("array<string>")).otherwise(F.col("required_terms"))
    )
    rows = gate.gate_rows(gate.attach_predictions(without_terms, preds)).cache()
    got = {r["id"]: r for r in rows.collect()}
    assert got["london"]["forbidden_patterns_found"] == ["\\|", "Generate a forecast"]
    assert not got["london"]["passed"] and not got["mumbai"]["passed"] and not got["toronto"]["passed"]
    report = gate.gate_report(rows)
    assert tuple(report.first()) == (5, 2, 0.4)
    assert {r["id"] for r in gate.failing_cases(rows).collect()} == {"london", "mumbai", "toronto"}
    with pytest.raises(RuntimeError):
        gate.require_pass(report)
