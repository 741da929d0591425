"""The pipeline's stages one after another on a small table."""

import random

import corpus_pipeline
from stratocast.llm import queries

WORDS = [f"w{i}" for i in range(300)]


def words(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def test_stages(spark, tmp_path):
    item = "what is the airspeed of a laden swallow. it is about eleven metres per second"
    docs = [(i, words(60, i), "en", f"s{i % 3}", 1) for i in range(40)]
    docs += [(40, docs[3][1] + " extra", "en", "s0", 1), (41, docs[3][1], "en", "s0", 1), (42, words(80, 99) + " " + item, "en", "s1", 1)]
    docs += [(43, "mail me at some.one@mail.example.com today", "en", "s1", 1), (44, None, None, None, None), (45, "", "en", "s2", 0)]
    docs += [(100 + i, words(30, 200 + i) + " horridslur " + words(5, i), "en", "s2", 1) for i in range(40)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 1) for i in range(40)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = now.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        kept[name] = {r["doc_id"]: r for r in now.collect()}
    assert set(kept["toxicity"]) == set(range(46))
    assert set(kept["near_copies"]) == set(range(46)) - {40, 41}
    assert set(kept["decontamination"]) == set(range(46)) - {40, 41, 42}
    assert "some.one@" not in kept["personal_data"][43]["text"] and kept["personal_data"][44]["text"] is None
    assert kept["personal_data"][0]["text"] == docs[0][1] and set(kept["mixing"]) <= set(range(46))


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
