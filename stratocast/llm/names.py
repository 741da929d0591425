"""Names for helper columns that no column of the input carries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def free_name(columns: Iterable[str], name: str) -> str:
    """`name` with as many underscores before it as make it new among `columns`, in any case."""
    taken = {c.lower() for c in columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def set_apart(df: DataFrame, *more: str) -> tuple[DataFrame, dict[str, str]]:
    """`df` with its columns that begin with an underscore (as helper columns do), and `more`, renamed; old names by new ones."""
    own: dict[str, str] = {}
    for c in df.columns:
        if c.startswith("_") or c.lower() in {m.lower() for m in more}:
            own[free_name([*df.columns, *own], f"_{c}")] = c
    return df.withColumnsRenamed({c: new for new, c in own.items()}) if own else df, own


def renamed(own: dict[str, str], *columns: str) -> list[str]:
    """What `columns` are called after set_apart."""
    new = {c: n for n, c in own.items()}
    return [new.get(c, c) for c in columns]
