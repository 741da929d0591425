"""The most frequent of many counted things, without sending every task's share to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 16  # for each doubling of the count


def most_frequent(counts: DataFrame, count: str, limit: int) -> DataFrame:
    """The rows of the largest counts (1 or more), `limit` at most: all that lie above a cut.

    Rows are counted by level of their count's logarithm, about a thousand
    levels at most; a level is taken whole or not at all, so the choice does
    not depend on the order of rows.
    """
    level = F.floor(F.log2(F.col(count)) * LEVELS)
    levels = {r["_level"]: r["_n"] for r in counts.groupBy(level.alias("_level")).agg(F.count(F.lit(1)).alias("_n")).collect()}
    cut, taken = None, 0
    for at in sorted(levels, reverse=True):
        taken += levels[at]
        if taken > limit:
            break
        cut = at
    return counts.where(level >= cut) if cut is not None else counts.where(F.lit(False))
