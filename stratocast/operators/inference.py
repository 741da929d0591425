"""How sure figures are: resampled intervals, paired tests, monotone calibration, change points.

Resampling draws its weights from hashes of (seed, row, replicate), so each row
decides alone what it counts in every replicate: one pass, partial sums before
the shuffle, and the same figures on a rerun.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratocast.operators import evaluate

REPLICATES = 64  # of a bootstrap; a multiple of LANES
FLIPS = 256  # of a sign-flip test; a multiple of 16 * LANES
LANES = 8  # numbers of 16 bits in one md5
CURVE_BINS = 100
_CDF = [int(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8)]


def _lanes(key: str, seed: int, draws: int) -> Column:
    """`draws` numbers of 16 bits from a row's key, LANES from each md5."""
    hashes = F.transform(
        F.sequence(F.lit(0), F.lit(draws // LANES - 1)),
        lambda c: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), c.cast("string"))),
    )
    parts = F.transform(
        hashes, lambda h: F.array(*[F.conv(F.substring(h, 4 * i + 1, 4), 16, 10).cast("int") for i in range(LANES)])
    )
    return F.flatten(parts)


def poisson_weight(draw: Column) -> Column:
    """A Poisson weight of mean 1 from a number of 16 bits."""
    return sum(((draw >= edge).cast("int") for edge in _CDF[1:]), (draw >= _CDF[0]).cast("int"))


def bootstrap_sums(
    df: DataFrame, key: str, sums: Mapping[str, Column], by: Sequence[str] = (), replicates: int = REPLICATES, seed: int = 0
) -> DataFrame:
    """by, replicate, weight and the weighted sums, a row for each group and replicate. `key` names a row."""
    if replicates % LANES:
        raise ValueError(f"replicates must be a multiple of {LANES}")
    drawn = df.select(*by, *[v.alias(f"_{n}") for n, v in sums.items()], F.posexplode(_lanes(key, seed, replicates)).alias("replicate", "_draw"))
    w = poisson_weight(F.col("_draw"))
    return drawn.groupBy(*by, "replicate").agg(F.sum(w).alias("weight"), *[F.sum(w * F.col(f"_{n}")).alias(n) for n in sums])


def _middle(values: Column, share: float) -> tuple[Column, Column]:
    """The ends of the middle `share` of a sorted array, both taken outwards."""
    last = F.size(values) - 1
    out = (1 - share) / 2
    low, high = F.floor(last * F.lit(out) + 1e-9), F.ceil(last * F.lit(1 - out) - 1e-9)
    return F.try_element_at(values, (low + 1).cast("int")), F.try_element_at(values, (high + 1).cast("int"))


def overall_interval(
    scored: DataFrame, key: str, by: Sequence[str] = (), share: float = 0.95, replicates: int = REPLICATES, seed: int = 0
) -> DataFrame:
    """by, bootstrap_low and bootstrap_high of the overall score of `evaluate.score_rows`' rows."""
    weights = evaluate.OVERALL
    names = {"bleu": "_bleu", "rouge_1": "_rouge_1", "categorical": "_categorical", "length": "_length", "readability": "_readability"}
    terms = [F.lit(weights[n]) * F.coalesce(F.col(c), F.lit(0.0)) for n, c in names.items()]
    sums = {"score": sum(terms[1:], terms[0]), "hit": F.col("_rain_hit"), "pair": F.col("_rain_pair")}
    drawn = bootstrap_sums(scored, key, sums, by, replicates, seed).where("weight > 0")
    rain = F.lit(weights["rain"]) * F.col("hit") / F.greatest("pair", F.lit(1))
    scores = drawn.groupBy(*by).agg(F.sort_array(F.collect_list(F.col("score") / F.col("weight") + rain)).alias("_scores"))
    low, high = _middle(F.col("_scores"), share)
    return scores.select(*by, low.alias("bootstrap_low"), high.alias("bootstrap_high"))


def evaluate_with_bootstrap(pred: DataFrame, key: str, by: Sequence[str] = (), **options) -> DataFrame:
    """`evaluate` with bootstrap_low and bootstrap_high beside the fixed margin."""
    scored = evaluate.score_rows(pred)
    metrics, interval = evaluate.evaluate(scored, by=by, scored=True), overall_interval(scored, key, by, **options)
    if not by:
        return metrics.crossJoin(interval)  # one row each
    same = [metrics[c].eqNullSafe(interval[c]) for c in by]
    return metrics.join(interval, same, "left").select(metrics["*"], "bootstrap_low", "bootstrap_high")


def sign_flip_test(
    pairs: DataFrame, first: str, second: str, key: str, by: Sequence[str] = (), flips: int = FLIPS, seed: int = 0
) -> DataFrame:
    """by, pairs, delta (mean of second - first) and p_value of a two-sided paired permutation test.

    Under the null either order of a pair is as likely, so each flip gives every
    difference a hashed sign; the p-value is the share of flips, and the rows as
    they are, that lie as far from 0. Pairs with a missing or non-finite side do
    not count.
    """
    if flips % (16 * LANES):
        raise ValueError(f"flips must be a multiple of {16 * LANES}")
    d = F.col(second) - F.col(first)
    rows = pairs.where(d.isNotNull() & (F.abs(d) < float("inf"))).select(*by, F.col(key).alias("_key"), d.alias("_d"))
    drawn = rows.select(*by, "_d", F.posexplode(_lanes("_key", seed, flips // 16)).alias("_lane", "_draw"))
    signed = [F.sum(F.when(F.getbit("_draw", F.lit(k)) == 1, F.col("_d")).otherwise(-F.col("_d"))).alias(f"_s{k}") for k in range(16)]
    sums = drawn.groupBy(*by, "_lane").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("_d").alias("_sum"), F.sum(F.abs("_d")).alias("_size"), *signed
    )
    edge = F.abs("_sum") - 1e-9 * F.col("_size")  # the order of a sum must not part equal ones
    as_far = sum(((F.abs(f"_s{k}") >= edge).cast("int") for k in range(1, 16)), (F.abs("_s0") >= edge).cast("int"))
    return sums.groupBy(*by).agg(
        F.max("pairs").alias("pairs"),
        (F.first("_sum") / F.max("pairs")).alias("delta"),
        ((F.sum(as_far) + 1) / F.lit(flips + 1.0)).alias("p_value"),
    )


def pooled(rates: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weighted least-squares fit that never falls: adjacent violators are pooled until none is left."""
    blocks: list[list[float]] = []  # mean, weight, length
    for rate, weight in zip(rates, weights):
        blocks.append([float(rate), float(weight), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            mean, w, n = blocks.pop()
            total = blocks[-1][1] + w
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + mean * w) / total, total, blocks[-1][2] + n]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def calibration_curve(df: DataFrame, p: str, outcome: str, by: Sequence[str] = (), bins: int = CURVE_BINS) -> DataFrame:
    """by, bin, rows, mean_p, rate and fitted, the isotonic rate of each bin of probabilities.

    Counts are reduced to `bins` rows a group before a group is fitted.
    """
    from stratocast.operators.outcomes import reliability_bins

    table = reliability_bins(df, p, outcome, by, bins)
    schema = table.withColumn("fitted", F.lit(0.0)).schema

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches)).sort_by("bin")
        fitted = pooled(group.column("rate").to_numpy(), group.column("rows").to_numpy())
        yield from group.append_column("fitted", pa.array(fitted)).to_batches()

    return table.groupBy(*by).applyInArrow(fit, schema)


def change_points(
    series: DataFrame, value: str, order: str, by: Sequence[str] = (), slack: float = 0.5, limit: float = 4.0
) -> DataFrame:
    """`series` with up, down (cumulative sums), up_since, down_since and changed; for series of summed-up rows, such as weeks.

    Values are standardized within their series. `up` adds what lies more than
    `slack` above the mean and never falls below 0, `down` the same below it;
    above `limit` the level has changed, since the time the sum left 0. Both sums
    are a running total less its smallest value so far, so no step needs the one
    before. Missing and non-finite values add nothing.
    """
    whole = Window.partitionBy(*by)
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    finite = F.when(F.col(value).isNotNull() & (F.abs(value) < float("inf")), F.col(value).cast("double"))
    spread = F.stddev_pop("_x").over(whole)
    z = F.coalesce(F.when(spread > 0, (F.col("_x") - F.avg("_x").over(whole)) / spread), F.lit(0.0))
    known = F.col("_x").isNotNull()
    out = series.withColumn("_x", finite).withColumn("_z", z)
    for side, step in (("up", F.col("_z") - slack), ("down", -F.col("_z") - slack)):
        out = out.withColumn("_run", F.sum(F.when(known, step).otherwise(0.0)).over(upto))
        low = F.least(F.min("_run").over(upto), F.lit(0.0))
        out = out.withColumn("_low", low).withColumn(side, F.col("_run") - F.col("_low"))
        at_zero = F.when(F.col(side) <= 0, F.col(order))
        out = out.withColumn(f"{side}_since", F.when(F.col(side) > limit, F.max(at_zero).over(upto)))
    return out.withColumn("changed", (F.col("up") > limit) | (F.col("down") > limit)).drop("_x", "_z", "_run", "_low")
