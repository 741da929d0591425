"""Building blocks that keep joins, ranks and splits spread over the cluster.

None of them lets one key, however large its share of the rows, end up in one
task, and whatever they broadcast is bounded by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A rank histogram has 16**RANK_DIGITS rows at most, whatever the data size.
RANK_DIGITS = 4
# At most this many keys are treated as heavy; any key outside holds less than
# a HEAVY_LIMIT-th of the rows.
HEAVY_LIMIT = 10_000
HEAVY_ROWS = 1_000_000


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a scan that has fewer tasks than there are cores by `keys`.

    For costly work per row on a file of few row groups. A large table has tasks
    enough and stays as it is, so nothing is shuffled at scale.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, *keys)


def heavy_keys(
    df: DataFrame, key: str, min_rows: int = HEAVY_ROWS, limit: int = HEAVY_LIMIT, **extra: Column
) -> DataFrame:
    """The (at most `limit`) most frequent values of `key` above `min_rows`, with their counts.

    Counting is partially aggregated before its shuffle. The limit bounds what
    gets broadcast; it only decides how a key is processed, never whether.
    """
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"), *[c.alias(name) for name, c in extra.items()])
        .where(F.col("_n") > min_rows)
        .orderBy(F.col("_n").desc(), F.col(key))
        .limit(limit)
    )


def skew_join(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    how: str = "left",
    min_rows: int = HEAVY_ROWS,
    limit: int = HEAVY_LIMIT,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """Look `key` up in `dim` (unique on `key`), safely for skewed facts.

    Heavy keys meet their few dim rows by broadcast. All other rows shuffle on
    the key; rows already served, and rows with a NULL key, carry a spread key,
    so no task gets them all. `heavy` names the heavy keys (column `key`, at
    most `limit` rows) where they are known already, which saves counting.
    `how` is 'left' or 'inner'.
    """
    values = [c for c in dim.columns if c != key]
    hot = (heavy_keys(facts, key, min_rows, limit) if heavy is None else heavy).select(F.col(key).alias("_hot_key"))
    hot_dim = (
        dim.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"))
        .select("_hot_key", F.struct(*values, F.lit(True).alias("_hit")).alias("_hot"))
    )
    cold_dim = dim.select(F.col(key).alias("_cold_key"), F.struct(*values, F.lit(True).alias("_hit")).alias("_cold"))
    # Row content spreads served rows; the partition number does so for equal rows, and stays the same in a retry.
    plain = [F.col(c) for c, t in facts.dtypes if "map<" not in t]
    spread = F.concat(
        F.lit("\x00"), F.pmod(F.xxhash64(*plain, F.spark_partition_id()), F.lit(1 << 20)).cast("string")
    )
    tagged = facts.join(F.broadcast(hot_dim), F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_join_key", F.when(F.col("_hot_key").isNull() & F.col(key).isNotNull(), F.col(key).cast("string")).otherwise(spread)
    )
    joined = tagged.join(
        cold_dim.withColumn("_cold_key", F.col("_cold_key").cast("string")),
        (F.col("_join_key") == F.col("_cold_key")) & F.col("_hot_key").isNull() & F.col(key).isNotNull(),
        "left",
    )
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    out = joined.withColumn("_found", found)
    if how == "inner":
        out = out.where(F.col("_found._hit"))
    return out.select(*facts.columns, *[F.col("_found")[v].alias(v) for v in values])


def hash_key(seed: int, *identity: str) -> Column:
    """A uniform, engine-independent sort key for a unique row identity."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity]))


def _histogram(keys: DataFrame) -> DataFrame:
    # One row per key prefix, so the windows here see at most 16**RANK_DIGITS rows.
    before = "sum(_n) OVER (ORDER BY _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    counts = keys.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    return counts.selectExpr("*", f"coalesce({before}, 0) AS _before", "sum(_n) OVER () AS _total")


def global_rank(df: DataFrame, key: Column, name: str = "rank", digits: int = RANK_DIGITS) -> DataFrame:
    """Exact 1-based rank of every row by `key` (hex text, unique), without a one-task sort.

    Rows are numbered inside their key prefix and shifted by the count of all
    smaller prefixes.
    """
    keyed = df.withColumn("_key", key).withColumn("_bucket", F.expr(f"substring(_key, 1, {digits})"))
    shift = F.broadcast(_histogram(keyed.select("_bucket")).select("_bucket", "_before"))
    within = keyed.selectExpr("*", "row_number() OVER (PARTITION BY _bucket ORDER BY _key) AS _within")
    return within.join(shift, "_bucket").select(*df.columns, (F.col("_before") + F.col("_within")).alias(name))


def rank_cuts(df: DataFrame, key: Column, shares: list[float], digits: int = RANK_DIGITS) -> Column:
    """A scalar struct c0, c1, ... of the keys that end each share's rows in key order.

    Only the key prefixes that contain a cut are sorted; all other rows are
    merely counted. Share sizes are floor(n * share); an empty leading part
    has the cut ''.
    """
    keys = df.select(key.alias("_key")).selectExpr("_key", f"substring(_key, 1, {digits}) AS _bucket")
    cuts = range(len(shares))
    sizes = [f"floor(_total * {share!r}D)" for share in shares]
    ends = [" + ".join(sizes[: i + 1]) + f" AS _end{i}" for i in cuts]
    holds = " OR ".join(f"(_before < _end{i} AND _end{i} <= _before + _n)" for i in cuts)
    cut_buckets = _histogram(keys).selectExpr("*", *ends).where(holds)
    ranked = keys.join(F.broadcast(cut_buckets), "_bucket").selectExpr(
        "*", "_before + row_number() OVER (PARTITION BY _bucket ORDER BY _key) AS _rank"
    )
    found = ", ".join(f"coalesce(max(if(_rank = _end{i}, _key, NULL)), '') AS c{i}" for i in cuts)
    return ranked.selectExpr(f"struct({found}) AS cuts").scalar()
