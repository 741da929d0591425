"""Longest common subsequences in blocks against the plain table."""

import random

import pytest
from pyspark.sql import functions as F

from stratocast.functions import text
from stratocast.operators import longest
from stratocast.storage import stored


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def score(a, b):
    return 2 * lcs(a or [], b or []) / (len(a) + len(b)) if a and b else 0.0


def test_blocks_compose_to_the_whole():
    rng = random.Random(2)
    for letters in ("ab", "abcdefgh"):
        for _ in range(60):
            a, b = (rng.choices(letters, k=rng.randrange(1, 40)) for _ in range(2))
            block, carries, total = rng.randrange(1, 12), {}, 0
            for i in range(0, len(a), block):
                state = None
                for j in range(0, len(b), block):
                    state, carries[j] = longest.advance(a[i : i + block], b[j : j + block], state, carries.get(j))
                total += len(a[i : i + block]) - int.from_bytes(state, "little").bit_count()
            assert total == lcs(a, b)


def test_rouge_l_long_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, *(rng.choices("uvwxyz", k=rng.randrange(0, 30)) for _ in range(2))) for i in range(60)]
    rows += [(60, None, ["u"]), (61, ["u"], None), (62, None, None), (63, [], []), (64, ["é", None, "x"], ["é", "x"])]
    rows += [(None, list("uvw"), list("vwu")), (7, *rows[7][1:]), (65, rng.choices("uvwxyz", k=90), rng.choices("uvwxyz", k=7))]
    rows = [(i, *([t for t in side if t is not None] if side is not None else None for side in sides)) for i, *sides in rows]
    df = spark.createDataFrame(rows, "_row int, g array<string>, r array<string>").repartition(4)
    want = sorted((str(i), round(score(g, r), 9)) for i, g, r in rows)
    for got in (
        longest.rouge_l_long(df, ["_row"], "g", "r", block=8),
        longest.rouge_l_any(df, ["_row"], "g", "r", long_tokens=12, block=5),
        longest.rouge_l_any(df, ["_row"], "g", "r"),
    ):
        assert got.columns == ["_row", "rouge_l"]
        assert sorted((str(i), round(v, 9)) for i, v in got.collect()) == want
    assert longest.rouge_l_any(df.where("_row < 0"), ["_row"], "g", "r", block=5).count() == 0


def test_one_very_long_pair_is_many_rows(spark):
    rng = random.Random(4)
    a = [f"t{rng.randrange(900)}" for _ in range(12_000)]
    b = [t for t in a if rng.random() < 0.9] + ["end"]
    df = spark.createDataFrame([(1, a, b)], "id int, g array<string>, r array<string>")
    whole = df.select(text.rouge_l_lcs(F.col("g"), F.col("r"))).first()[0]
    assert longest.rouge_l_long(df, ["id"], "g", "r").first()["rouge_l"] == pytest.approx(whole)


def test_written_tables_hold_numbers_for_tokens(spark, monkeypatch):
    """What is written and shuffled for each diagonal has a number per token, whatever its length."""
    kinds = []

    def recorded(df, *args):
        kinds.extend(t for _, t in df.dtypes)
        return stored(df, *args)

    monkeypatch.setattr(longest, "stored", recorded)
    rows = [(1, ["a" * 50, "b", None, "b"], ["b", "a" * 50, None, "c"]), (2, None, ["b"]), (3, [], []), (4, ["b", "c"], ["b", "c"])]
    df = spark.createDataFrame(rows, "id int, g array<string>, r array<string>")
    out = longest.rouge_l_long(df, ["id"], "g", "r", block=2)
    assert {r["id"]: r["rouge_l"] for r in out.collect()} == {1: 0.5, 2: 0.0, 3: 0.0, 4: 1.0}
    assert "array<int>" in kinds and "array<string>" not in kinds
