"""Resampling, paired tests, isotonic fits and change points against plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratocast.operators import evaluate, inference


def draws(key, n, seed=0):
    out = []
    for c in range(n // 8):
        h = hashlib.md5(f"{seed}:{key}:{c}".encode()).hexdigest()
        out += [int(h[4 * i : 4 * i + 4], 16) for i in range(8)]
    return out


def poisson(u):
    total, k, p = 0.0, 0, math.exp(-1)
    while k < 8:
        total += p
        if u < int(65536 * total):
            return k
        k += 1
        p /= k
    return k


def test_bootstrap_equals_plain_weights(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), rng.random(), rng.choice([None, rng.random()])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g string, x double, y double").repartition(5)
    got = {(r["g"], r["replicate"]): r for r in inference.bootstrap_sums(df, "id", {"x": F.col("x"), "y": F.col("y")}, ["g"], 16).collect()}
    for g in "ab":
        for k in range(16):
            own = [(poisson(draws(i, 16)[k]), x, y) for i, h, x, y in rows if h == g]
            assert got[g, k]["weight"] == sum(w for w, _, _ in own)
            assert got[g, k]["x"] == pytest.approx(sum(w * x for w, x, _ in own))
            assert got[g, k]["y"] == pytest.approx(sum(w * (y or 0) for w, _, y in own))
    weights = [poisson(u) for i in range(400) for u in draws(i, 8)]
    assert abs(np.mean(weights) - 1) < 0.06 and abs(np.var(weights) - 1) < 0.12
    with pytest.raises(ValueError):
        inference.bootstrap_sums(df, "id", {}, replicates=12)


def test_interval_holds_the_score_and_narrows(spark, pairs):
    many = pairs.crossJoin(spark.range(60).select(F.col("id").alias("k"))).withColumn("id", F.col("k") * 2 + F.col("id"))
    texts = many.withColumn("generated_forecast", F.when(F.col("k") % 5 < 2, F.col("reference_forecast")).otherwise(F.col("generated_forecast")))
    wide = inference.evaluate_with_bootstrap(texts.where("k < 5"), "id").first()
    narrow = inference.evaluate_with_bootstrap(texts, "id").first()
    for r in (wide, narrow):
        assert r["bootstrap_low"] <= r["overall_score"] <= r["bootstrap_high"] and "confidence_interval_low" in r
    assert narrow["bootstrap_high"] - narrow["bootstrap_low"] < wide["bootstrap_high"] - wide["bootstrap_low"]
    with_null = texts.withColumn("g", F.when(F.col("k") > 30, "x"))
    assert inference.evaluate_with_bootstrap(with_null, "id", ["g"]).where("bootstrap_low is null").isEmpty()
    assert inference.evaluate_with_bootstrap(texts.where("k < 0"), "id", ["location"]).count() == 0


def test_sign_flips_equal_plain_ones(spark):
    rng = random.Random(2)
    nan = float("nan")
    rows = [(i, "moved", rng.gauss(0, 1), rng.gauss(0.8, 1)) for i in range(60)] + [(100 + i, "same", x := rng.gauss(0, 1), x + rng.choice([-1.0, 1.0])) for i in range(60)]
    rows += [(200, "equal", 1.0, 1.0), (201, "equal", 2.0, 2.0), (300, "moved", None, 1.0), (301, "moved", nan, 1.0), (302, "moved", float("inf"), 1.0)]
    df = spark.createDataFrame(rows, "id int, g string, a double, b double").repartition(3)
    got = {r["g"]: r for r in inference.sign_flip_test(df, "a", "b", "id", ["g"]).collect()}
    for g in ("moved", "same", "equal"):
        d = [(i, b - a) for i, h, a, b in rows if h == g and a is not None and math.isfinite(a)]
        signs = {i: [u >> k & 1 for u in draws(i, 16) for k in range(16)] for i, _ in d}
        total = sum(x for _, x in d)
        far = sum(abs(sum(x if signs[i][f] else -x for i, x in d)) >= abs(total) - 1e-9 * sum(abs(x) for _, x in d) for f in range(256))
        assert (got[g]["pairs"], got[g]["p_value"]) == (len(d), pytest.approx((far + 1) / 257))
        assert got[g]["delta"] == pytest.approx(total / len(d))
    assert got["moved"]["p_value"] < 0.01 < 0.05 < got["same"]["p_value"] and got["equal"]["p_value"] == 1
    with pytest.raises(ValueError):
        inference.sign_flip_test(df, "a", "b", "id", flips=100)


def test_pooled_is_the_isotonic_fit(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40):
        rates, weights = rng.integers(0, 5, n) / 4, rng.integers(1, 9, n)
        fitted = inference.pooled(rates, weights)
        mean = lambda j, k: np.average(rates[j : k + 1], weights=weights[j : k + 1])
        assert fitted == pytest.approx([max(min(mean(j, k) for k in range(i, n)) for j in range(i + 1)) for i in range(n)])
    df = spark.range(2000).selectExpr("id % 101 / 100D AS p", "int(pmod(hash(id), 100) < id % 101) AS hit", "id % 2 AS g").union(spark.sql("SELECT NULL, 1, 0"))
    curve = inference.calibration_curve(df.repartition(7), "p", "hit", ["g"], bins=20).collect()
    for g in (0, 1):
        own = sorted((r for r in curve if r["g"] == g), key=lambda r: r["bin"])
        assert len(own) == 20 and all(a["fitted"] <= b["fitted"] for a, b in zip(own, own[1:]))
        assert sum(r["rows"] * r["fitted"] for r in own) == pytest.approx(sum(r["rows"] * r["rate"] for r in own))
    assert inference.calibration_curve(df.where("p < 0"), "p", "hit").count() == 0


def test_change_points_equal_the_recursion(spark):
    rng = random.Random(4)
    rows = [("up", t, rng.gauss(0 if t < 40 else 1.5, 0.5)) for t in range(80)] + [("flat", t, 3.0) for t in range(20)]
    rows += [("gaps", t, rng.choice([None, float("nan"), rng.gauss(5 if t < 30 else 2, 0.3)])) for t in range(60)]
    df = spark.createDataFrame(rows, "s string, t int, x double").repartition(4)
    got = {(r["s"], r["t"]): r for r in inference.change_points(df, "x", "t", ["s"]).collect()}
    for s in ("up", "flat", "gaps"):
        own = [(t, x) for n, t, x in rows if n == s]
        known = [x for _, x in own if x is not None and math.isfinite(x)]
        mean, spread = np.mean(known), np.std(known)
        up = down = 0.0
        for t, x in own:
            if x is not None and math.isfinite(x) and spread > 1e-12:
                z = (x - mean) / spread
                up, down = max(0.0, up + z - 0.5), max(0.0, down - z - 0.5)
            r = got[s, t]
            assert (r["up"], r["down"]) == (pytest.approx(up, abs=1e-9), pytest.approx(down, abs=1e-9))
            assert r["changed"] == (up > 4 or down > 4)
    first = min(t for (s, t), r in got.items() if s == "up" and r["up"] > 4)
    assert 40 <= first < 56 and 36 <= got["up", first]["up_since"] < 44
    assert not any(r["changed"] for (s, _), r in got.items() if s == "flat")
    assert got["gaps", 59]["down"] > 3
