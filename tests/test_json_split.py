"""JSON arrays and maps that many tasks read, against the plain parser."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stratocast.sources import files
from stratocast.sources import json_split
from stratocast.sources.json_split import array_records, first_characters, map_entries

NASTY = ['plain', 'a "quoted" }, { text', "back\\slash\\\\", "line\nbreak, comma", "}{][,:", '\\"}', "", "ünï ☃ \U0001f600", "\\", '",', "x" * 300]


def records(n, seed):
    rng = random.Random(seed)
    return [
        {"id": str(i), "location": rng.choice(NASTY), "input": rng.choice([*NASTY, None]), "required_terms": rng.sample(NASTY, 2),
         "observed_weather": rng.choice([None, {"rain": True, "temperature": 1.5}, {}]), "extra": {"a": {"b": [{"c": "}"}]}}}
        for i in range(n)
    ]


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_arrays_equal_the_plain_parser(spark, tmp_path, small_ranges, style):
    want = {}
    for k in range(3):
        rows = records([60, 1, 0][k], k)
        (tmp_path / f"part{k}.json").write_text(("﻿ \n" if k == 1 else "") + json.dumps(rows, **style), encoding="utf-8")
        want[f"part{k}.json"] = rows
    found = array_records(spark, str(tmp_path))
    got = {}
    for r in found.orderBy("file", "position").collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append(json.loads(r["text"]))
    assert got == {k: v for k, v in want.items() if v}
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10  # one file, many tasks


def test_cases_and_lines_side_by_side(spark, tmp_path, small_ranges):
    rows = records(40, 5)
    folder = tmp_path / "cases.json"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(rows[:20], indent=1))
    (folder / "b.json").write_text("\n".join(json.dumps(r) for r in rows[20:]) + "\n\n")
    (folder / "c.json").write_text("")
    heads = {r["file"].rsplit("/", 1)[1]: r["first"] for r in first_characters(spark, str(folder)).collect()}
    assert heads == {"a.json": "[", "b.json": "{"}
    got = {r["id"]: r for r in files.read_quality_cases(spark, str(folder)).collect()}
    assert set(got) == {r["id"] for r in rows}
    for r in rows:
        row = got[r["id"]]
        assert (row["location"], row["input"], row["required_terms"]) == (r["location"], r["input"], r["required_terms"])
        assert (row["observed_weather"] is None) == (r["observed_weather"] is None)


def test_maps_and_lists_of_predictions(spark, tmp_path, small_ranges):
    """The last of equal ids wins, by file and place, over maps and lists."""
    rng = random.Random(3)
    want = {}
    for k in range(4):
        if k % 2:
            entries = [(f"i{rng.randrange(60)}", rng.choice([*NASTY, None])) for _ in range(80)]
            body = ",\n".join(f"{json.dumps(i)}: {json.dumps(t)}" for i, t in entries)
            (tmp_path / f"{k}.json").write_text(" {" + body + "\n}\n ")
            want.update((i, str(t)) for i, t in entries)
        else:
            items = [{"id": rng.choice([f"i{rng.randrange(60)}", "", None]), rng.choice(["generated_forecast", "forecast"]): rng.choice(NASTY)} for _ in range(80)]
            (tmp_path / f"{k}.json").write_text(json.dumps(items, indent=k))
            want.update((r["id"], t) for r in items if r["id"] and (t := r.get("generated_forecast") or r.get("forecast")))
    (tmp_path / "5.json").write_text("{}")
    got = {r["id"]: r["generated_forecast"] for r in files.read_predictions(spark, str(tmp_path)).collect()}
    assert got == want
    places = map_entries(spark, str(tmp_path), first_characters(spark, str(tmp_path)).where("first = '{'"))
    assert places.groupBy("file").agg(F.count("key").alias("n")).where("n <> 80").isEmpty()


def test_tasks_follow_the_pieces(spark, tmp_path, monkeypatch):
    """Sums run over short runs of pieces, and a task sorts a bounded number of them."""
    monkeypatch.setattr(json_split, "TASK_PIECES", 50)
    monkeypatch.setattr(json_split, "RUN_BITS", 2)
    records = [{"id": i, "text": 'a } "quoted" { [' * (i % 3), "in": {"x": [i, {"y": "}"}]}} for i in range(150)]
    (tmp_path / "a.json").write_text(json.dumps(records))
    found = array_records(spark, str(tmp_path))
    assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString()
    got = [json.loads(r["text"]) for r in found.orderBy("position").collect()]
    assert got == records
