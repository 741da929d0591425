import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from stratocast.functions import labels
from stratocast.operators import corpus, scale
from stratocast.operators import sequences as seq
from stratocast.storage import stored

SCHEMA = (
    "location_name string, datetime timestamp, event_id bigint, temperature_c double, humidity_pct double, "
    "wind_speed_kph double, pressure_hpa double, precipitation_probability double"
)
START = dt.datetime(2024, 1, 1)


def series(name, n, first_id=0, step=3600, seed=1):
    rng = random.Random(f"{name}{seed}")
    return [
        (name, START + dt.timedelta(seconds=i * step), first_id + i, rng.randrange(-99, 400) / 10,
         float(rng.randrange(20, 99)), rng.randrange(0, 500) / 10, 1000.0, rng.randrange(0, 100) / 100)
        for i in range(n)
    ]


def brute(rows, length=4, horizon=6):
    out = {}
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for group in groups.values():
        group.sort(key=lambda r: (r[1], r[2]))
        for i in range(len(group) - length - horizon):
            past, future = group[i : i + length], group[i + length : i + length + horizon]
            temps = [r[3] for r in future]
            out[group[i][2]] = (
                [r[3] for r in past], [r[7] for r in past], sum(temps) / horizon, max(temps), min(temps),
                sum(r[4] for r in future) / horizon, max(r[5] for r in future), sum(r[7] for r in future) / horizon,
            )
    return out


@pytest.mark.parametrize("hot_rows, chunk_rows", [(None, 10), (10**6, 10), (30, 10), (0, 13)])
def test_windows_against_brute_force(spark, hot_rows, chunk_rows):
    rows = series("hot", 120, 0) + series("b", 11, 1000) + series("c", 10, 2000) + series("ties", 45, 3000, step=0)
    rows += series("burst", 40, 5000, step=1) + [("burst", START + dt.timedelta(days=400), 6000, 1.0, 2.0, 3.0, 4.0, 0.5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = seq.window_features(df, order=("datetime", "event_id"), hot_rows=hot_rows, chunk_rows=chunk_rows).collect()
    expected = brute(rows)
    assert len(got) == len(expected)
    for r in got:
        temp, precip, *aggregates = expected[r["event_id"]]
        assert r["temperature"] == temp and r["precipitation_probability"] == precip
        assert [r[c] for c in ("avg_temp", "max_temp", "min_temp", "avg_humidity", "max_wind", "avg_precip")] == pytest.approx(aggregates)
    assert {r["location_name"] for r in got} == {"hot", "b", "ties", "burst"}


def test_nulls_and_nan(spark):
    rows = [list(r) for r in series("a", 11)]
    rows[1][3] = None
    rows[5][3] = float("nan")
    rows[2][7] = None
    rows += [[None] + r[1:] for r in rows]
    w = seq.window_features(spark.createDataFrame([tuple(r) for r in rows], SCHEMA)).collect()
    assert len(w) == 1
    assert w[0]["temperature"][1] is None and w[0]["precipitation_probability"][2] is None
    seen = [rows[i][3] for i in (4, 6, 7, 8, 9)]
    assert w[0]["avg_temp"] == pytest.approx(sum(seen) / 5) and w[0]["max_temp"] == max(seen)


def test_first_rows_per_location(spark):
    df = spark.createDataFrame(series("a", 9) + series("b", 2, 100), SCHEMA)
    got = {r["location_name"]: r for r in seq.first_l_per_location(df, 4).collect()}
    expected = [r[3] for r in series("a", 9)]
    assert got["a"]["temperature"] == expected[:4] and len(got["b"]["temperature"]) == 2
    last = {r["location_name"]: r for r in seq.first_l_per_location(df, 4, descending=True).collect()}
    assert last["a"]["temperature"] == expected[:-5:-1]
    plan = seq.first_l_per_location(df, 4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_prompt_golden(spark):
    row = ("New York", "2025-10-12 12:00 UTC", [23.0, 24.0, 22.0, 21.0], [70.0, 75.0, 80.0, 82.0],
           [12.0, 18.0, 20.0, 15.0], [1008.0, 1007.0, 1006.0, 1005.0], [0.1, 0.2, 0.6, 0.7])
    df = spark.createDataFrame([row], "location_name string, datetime string, temperature array<double>, humidity array<double>, "
                               "wind_speed array<double>, pressure array<double>, precipitation_probability array<double>")
    assert seq.with_prompt(df).first()["prompt"] == (
        "Weather data for New York on 2025-10-12 12:00 UTC:\n- Temperature (°C): 23.0, 24.0, 22.0, 21.0\n"
        "- Humidity (%): 70, 75, 80, 82\n- Wind speed (km/h): 12.0, 18.0, 20.0, 15.0\n"
        "- Pressure (hPa): 1008.0, 1007.0, 1006.0, 1005.0\n- Precipitation probability: 0.10, 0.20, 0.60, 0.70\n\n"
        "Generate a forecast bulletin:"
    )


def test_bulletins(spark):
    rows = [(1, -0.3, 9.5, 50.0, 28.0, 0.55), (2, 31.0, 35.0, 80.0, 17.9, 0.1), (3, 5.0, 15.0, 10.0, 18.0, 0.3)]
    df = spark.createDataFrame(rows, "event_id int, min_temp double, max_temp double, avg_humidity double, max_wind double, avg_precip double")
    df = df.withColumn("avg_temp", (F.col("min_temp") + F.col("max_temp")) / 2).withColumn("location_name", F.lit("x"))
    got = {r["event_id"]: r["target"] for r in seq.with_bulletin(df).collect()}
    assert got[1] == "Rain likely conditions expected with cold temperatures around -0-10C and windy with gusts near 28 km/h."
    assert got[2] == "Cloudy conditions expected with hot temperatures around 31-35C and light winds near 18 km/h."
    assert got[3] == "Showers possible conditions expected with cool temperatures around 5-15C and breezy with winds around 18 km/h."
    templated = seq.with_templated_bulletin(df, order=["event_id"])
    texts = {r["event_id"]: r["target"] for r in templated.collect()}
    assert texts == {r["event_id"]: r["target"] for r in templated.repartition(3).collect()}
    assert "-0-10°C" in texts[1] and any(t.replace("{wind_speed}", "28") in texts[1] for t in labels.WIND)
    assert any(texts[1].find(t) > 0 for t in labels.TIMING) and not any(t in texts[2] for t in labels.TIMING)


@pytest.mark.parametrize("n, sizes", [(10, (8, 1, 1)), (20, (16, 2, 2)), (17392, (13913, 1739, 1740)), (1, (0, 0, 1)), (0, (0, 0, 0))])
def test_exact_split(spark, n, sizes):
    df = spark.range(n)
    split = corpus.exact_split(df, ["id"])
    got = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == sizes
    if n == 20:
        first = {r["id"]: r["split"] for r in split.collect()}
        assert first == {r["id"]: r["split"] for r in corpus.exact_split(df.repartition(7), ["id"]).collect()}
        other = {r["id"]: r["split"] for r in corpus.exact_split(df, ["id"], seed=1).collect()}
        assert first != other


def test_batches_and_rank(spark):
    got = corpus.shuffled_batches(spark.range(35), ["id"], 16).collect()
    assert sorted(r["position"] for r in got) == list(range(1, 36))
    assert sorted(r["batch"] for r in got) == [0] * 16 + [1] * 16 + [2] * 3
    again = corpus.shuffled_batches(spark.range(35), ["id"], 16, epoch=1).collect()
    assert {r["id"]: r["position"] for r in got} != {r["id"]: r["position"] for r in again}
    ranks = scale.global_rank(spark.range(500), scale.hash_key(0, "id"), digits=1)
    assert ranks.select(F.count_distinct("rank"), F.max("rank")).first() == (500, 500)


def test_skew_join_equals_join(spark):
    facts = spark.range(300).withColumn("k", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 40)))
    dim = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 40, 2)], "k string, v int")
    for how in ("left", "inner"):
        plain = sorted(map(tuple, facts.join(dim, "k", how).select("id", "k", "v").collect()))
        for min_rows in (5, 50, 10**6):
            assert sorted(map(tuple, scale.skew_join(facts, dim, "k", how, min_rows=min_rows).select("id", "k", "v").collect())) == plain


def test_skew_join_spreads_equal_rows(spark):
    facts = spark.range(0, 4000, 1, 8).select(F.lit("hot").alias("k"))
    dim = spark.createDataFrame([("hot", 1), ("x", 2)], "k string, v int")
    out = scale.skew_join(facts, dim, "k", min_rows=10)
    assert out.where("v = 1").count() == 4000


def test_stored_reads_back(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, None)], "id int, tags array<string>")
    kept = stored(df)
    assert kept.schema == df.schema and sorted(kept.collect()) == sorted(df.collect())


def test_training_arrays(spark):
    df = spark.createDataFrame([(1, [5, 6], [7]), (2, [1, 2, 3], [4, 5, 6])], "id int, prompt_ids array<int>, response_ids array<int>")
    got = {r["id"]: r for r in corpus.response_only_arrays(df, 5, 0).collect()}
    assert got[1]["input_ids"] == [5, 6, 7, 0, 0] and got[1]["attention_mask"] == [1, 1, 1, 0, 0]
    assert got[1]["labels"] == [-100, -100, 7, -100, -100]
    assert got[2]["input_ids"] == [1, 2, 3, 4, 5] and got[2]["labels"] == [-100, -100, -100, 4, 5]
    full = corpus.full_sequence_arrays(df.select("id", F.col("prompt_ids").alias("ids")), 4, 9).orderBy("id").collect()
    assert full[0]["input_ids"] == full[0]["labels"] == [5, 6, 9, 9] and full[0]["attention_mask"] == [1, 1, 0, 0]


@pytest.mark.parametrize("min_rows", [2, 10**6])
def test_vocab_round_trip(spark, min_rows):
    rows = [(1, "the rain the sun", "dry"), (2, "", "the end"), (3, None, "the")]
    df = spark.createDataFrame(rows, "id int, input string, target string")
    vocab = corpus.build_vocab(df, ["input", "target"])
    ids = {r["token"]: (r["id"], r["uses"]) for r in vocab.collect()}
    assert sorted(i for i, _ in ids.values()) == [1, 2, 3, 4, 5] and ids["the"][1] == 4
    got = {r["id"]: r for r in corpus.encode_vocab(df, ["id"], {"input": "i", "target": "t"}, vocab, min_rows=min_rows).collect()}
    back = {i: t for t, (i, _) in ids.items()}
    assert [back[i] for i in got[1]["i"]] == ["the", "rain", "the", "sun"] and got[2]["i"] == [] and got[3]["i"] == []
    assert [back[i] for i in got[2]["t"]] == ["the", "end"]
    unknown = corpus.encode_vocab(df, ["id"], {"input": "i"}, vocab.where("token <> 'rain'"), min_rows=min_rows)
    assert {r["id"]: r["i"] for r in unknown.collect()}[1][1] == 0


def test_corpus_stats(spark):
    rows = [("a", "x y z"), ("a", "x"), ("b", "")]
    df = spark.createDataFrame(rows, "location string, response string")
    s = corpus.corpus_stats(df).first()
    assert (s["total_samples"], s["unique_locations"], s["min_response_length"], s["max_response_length"]) == (3, 2, 0, 3)
    assert s["avg_response_length"] == pytest.approx(4 / 3) and s["response_length_std"] == pytest.approx(math.sqrt(14 / 9))
    assert corpus.corpus_stats(df.limit(0)).count() == 0
    assert corpus.concat_example(spark.createDataFrame([("i", "t")], "input string, target string")).first()["text"] == "i\nt</s>"


@pytest.mark.parametrize("times", ["outlier", "equal", "missing tiebreak"])
def test_hot_location_is_spread(spark, times):
    """No partition of a hot location's rows gets much more than its share, whatever the times."""
    at = {"outlier": "if(id = 0, 0, 1000000000 + id)", "equal": "5", "missing tiebreak": "id div 500"}[times]
    rows = spark.range(0, 20_000, 1, 8).selectExpr("'hot' AS location_name", f"timestamp_seconds({at}) AS datetime", "id AS event_id")
    dealt = seq.placed(rows, "location_name", ("datetime", "event_id"))
    assert [r["_position"] for r in dealt.orderBy("event_id").collect()] == list(range(20_000))
    parts = rows.repartitionByRange(8, "location_name", "datetime", "event_id").groupBy(F.spark_partition_id()).count()
    assert parts.agg(F.max("count")).first()[0] < 20_000 / 8 * 2


def test_null_keys_are_spread(spark):
    facts = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).alias("k"), "id")
    dim = spark.createDataFrame([(str(i), i) for i in range(0, 20_000, 20)], "k string, v int")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        out = scale.skew_join(facts, dim, "k")
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 20_000 * 0.6 and out.where("v IS NOT NULL").count() == 1000
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_words_travel_once_for_a_chunk(spark):
    """Repeated words, rows of equal identity, null identities and texts, in one chunk and in many."""
    rows = [(i, f"wind wind rain w{i % 7} wind") for i in range(40)] + [(5, "rain dry"), (None, "wind"), (41, None), (42, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    vocab = spark.createDataFrame([("wind", 1), ("rain", 2), ("w3", 3)], "token string, id int")
    for chars in (10, 1_000_000):
        out = corpus.encode_vocab(df, ["id"], {"text": "ids"}, vocab, chunk_chars=chars)
        assert "xxhash64" in out._jdf.queryExecution().optimizedPlan().toString()  # chunks, not single words, meet their rows
        got = {r["id"]: r["ids"] for r in out.collect()}
        assert got[3] == [1, 1, 2, 3, 1] and got[4] == [1, 1, 2, 0, 1] and got[41] == got[42] == got[None] == []
        assert got[5] == [1, 2, 0, 1, 2, 0, 1]
