"""A training-corpus pipeline over the table of documents, in five stages.

Each stage gets what the one before kept and gives rows with the columns of
documents; the last gives the mix. Null and empty texts pass every filter; rows
without a doc_id are never taken for copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocast.llm import decontaminate, mixing, near_join, pii, toxicity
from stratocast.llm.queries import PII_KEY, not_held_out, table
from stratocast.storage import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier trained on the labelled ones does not call toxic."""
    model = toxicity.fit(docs, not_held_out(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id."""
    return near_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where("NOT contaminated").select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates."""
    changed = pii.pseudonymize(docs, key=PII_KEY)
    size = F.when(F.col("n_entities") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return changed.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents once for each copy that the mix takes, with the mix's figures."""
    return mixing.emit(mixing.mix_sources(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("personal_data", replace_personal_data),
    ("mixing", mix),
]

# Trained scores and keyed surrogates are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each reads what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
