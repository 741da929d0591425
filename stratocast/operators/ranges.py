"""Sums and maxima over ranges of time, without a row for any pair of a range and a value.

Values are ranked by time within their place, in runs of RUN. A value keeps the
sums and maxima from its run's start to itself and from itself to the run's end,
and a sparse table: the maxima of the next and the last 1, 2, 4, ... values of
its run. A range is then answered by its two bounds: within one run by the
difference of two prefix sums and two overlapping maxima, else by the end of one
run and the start of another; whole runs between are values of the next level,
where the same holds. Each level is RUN times smaller.

Ranks come from rows dealt by range of (place, time), so a place of any size is
spread; every other step is keyed by a run, a bound or a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratocast.storage import stored

RUN = 256  # a power of two


def range_summary(ranges: DataFrame, values: DataFrame, run: int = RUN) -> DataFrame:
    """`ranges` (at, since, until) with total, n and top over the values in (since, until].

    `values` has at, time, total, n, top, one row for each (at, time). Ranges
    that hold no value are left out.
    """
    if run < 2 or run & (run - 1):
        raise ValueError("the run must be a power of two")
    asked = ranges.where("since < until").select("at", "since", "until").distinct()
    bounds = asked.select("at", F.col("since").alias("time")).union(asked.select("at", F.col("until").alias("time"))).distinct()
    ranked = stored(_ranked(values, bounds))
    places = ranked.where("bound").select("at", "time", F.col("rank").alias("place"))
    below, upto = (places.select("at", F.col("time").alias(t), F.col("place").alias(r)) for t, r in (("since", "a"), ("until", "b")))
    placed = stored(asked.join(below, ["at", "since"]).join(upto, ["at", "until"]).where("a < b"))
    level = ranked.where("NOT bound").select("at", "rank", "total", "n", "top")
    most = level.agg(F.max("rank")).first()[0] or 0
    answers = _answer(placed.select("at", "a", "b").distinct(), level, most, run)
    return placed.join(answers, ["at", "a", "b"]).select("at", "since", "until", "total", "n", "top")


def _ranked(values: DataFrame, bounds: DataFrame) -> DataFrame:
    """Values and bounds with `rank`: the number of values of the place up to this time."""
    both = values.select("at", "time", F.lit(False).alias("bound"), "total", "n", "top").unionByName(
        bounds.withColumn("bound", F.lit(True)), allowMissingColumns=True
    )
    order = ["at", "time", "bound"]  # a bound counts the value of its own time
    dealt = stored(both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", 33)  # the upper bits are the partition
    mine = F.when(F.col("bound"), 0).otherwise(1)
    earlier = Window.partitionBy("at").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = (  # one row per place and partition
        dealt.groupBy("at", part.alias("_part"))
        .agg(F.sum(mine).alias("_own"))
        .select("at", "_part", F.coalesce(F.sum("_own").over(earlier), F.lit(0)).alias("_before"))
    )
    within = Window.partitionBy("at", "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    return (
        dealt.withColumn("_part", part)
        .withColumn("_within", F.sum(mine).over(within))
        .join(before, ["at", "_part"])
        .select("at", "time", "bound", "total", "n", "top", (F.col("_before") + F.col("_within")).alias("rank"))
    )


def _index(values: DataFrame, run: int) -> DataFrame:
    """Every value with its run's sums and maxima up to it and from it on, and its row of the sparse table."""
    rows = values.withColumn("_run", F.floor((F.col("rank") - 1) / run))
    order = Window.partitionBy("at", "_run").orderBy("rank")
    head = order.rowsBetween(Window.unboundedPreceding, 0)
    tail = order.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns(
        {f"{name}_{c}": f(c).over(w) for name, w in (("head", head), ("tail", tail)) for c, f in (("total", F.sum), ("n", F.sum), ("top", F.max))}
    )
    steps = run.bit_length()
    rows = rows.withColumns({"_next0": F.col("top"), "_last0": F.col("top")})
    for k in range(1, steps):
        half = 1 << (k - 1)
        rows = rows.withColumns(
            {
                f"_next{k}": F.greatest(f"_next{k - 1}", F.lead(f"_next{k - 1}", half).over(order)),
                f"_last{k}": F.greatest(f"_last{k - 1}", F.lag(f"_last{k - 1}", half).over(order)),
            }
        )
    tables = {name: F.array(*[F.col(f"_{name}{k}") for k in range(steps)]) for name in ("next", "last")}
    kept = [f"{side}_{c}" for side in ("head", "tail") for c in ("total", "n", "top")]
    return rows.select("at", "rank", "_run", "total", "n", *kept, *[t.alias(name) for name, t in tables.items()])


def _answer(ranges: DataFrame, values: DataFrame, most: int, run: int) -> DataFrame:
    """total, n and top of the values of ranks a + 1 to b, for distinct (at, a, b) with a < b; `most` is the largest rank."""
    index = stored(_index(values, run))
    first = index.select("at", (F.col("rank") - 1).alias("a"), F.struct(*[c for c in index.columns if c != "at"]).alias("x"))
    last = index.select("at", F.col("rank").alias("b"), F.struct(*[c for c in index.columns if c != "at"]).alias("y"))
    met = ranges.join(first, ["at", "a"]).join(last, ["at", "b"])
    same = F.col("x._run") == F.col("y._run")

    def added(c: str) -> Column:
        inside = F.col(f"y.head_{c}") - F.col(f"x.head_{c}") + F.col(f"x.{c}")
        return F.when(same, inside).otherwise(F.col(f"x.tail_{c}") + F.col(f"y.head_{c}"))

    length = F.length(F.bin(F.col("b") - F.col("a")))  # 1 + the power of two that fits
    inside = F.greatest(F.try_element_at("x.next", length), F.try_element_at("y.last", length))
    part = met.select(
        "at",
        "a",
        "b",
        added("total").alias("total"),
        added("n").alias("n"),
        F.when(same, inside).otherwise(F.greatest("x.tail_top", "y.head_top")).alias("top"),
        (F.col("x._run") + 1).alias("a2"),
        F.col("y._run").alias("b2"),
    )
    if most <= run:
        return part.select("at", "a", "b", "total", "n", "top")
    part = stored(part)
    runs = values.groupBy("at", (F.floor((F.col("rank") - 1) / run) + 1).alias("rank")).agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("top").alias("top")
    )
    between = part.where("a2 < b2").select("at", F.col("a2").alias("a"), F.col("b2").alias("b")).distinct()
    above = _answer(between, runs, -(-most // run), run).select(
        "at", F.col("a").alias("a2"), F.col("b").alias("b2"), F.struct("total", "n", "top").alias("more")
    )
    return part.join(above, ["at", "a2", "b2"], "left").select(
        "at",
        "a",
        "b",
        (F.col("total") + F.coalesce("more.total", F.lit(0.0))).alias("total"),
        (F.col("n") + F.coalesce("more.n", F.lit(0))).alias("n"),
        F.greatest("top", "more.top").alias("top"),
    )
