"""A corpus made ready for training: toxic texts go, near duplicates go, personal data is taken out, the rest is packed.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the next one's docs.
All but the last give the columns of documents. A table without rows passes through all stages; rows with null texts
are kept as empty ones, except that a toxicity model without both classes keeps or rejects all alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docvec.llm import dedup, packing, pii, toxicity
from docvec.llm.common import fold, table
from docvec.scratch import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the model learns from the labels of four folds, as its query's does."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold("doc_id") != 0)
    return docs.where(toxicity.scored(F.col("text"), model) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.one_of_each(docs)


def take_out_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", take_out_personal_data),
    ("packing", pack),
]

# a trained model, components of a graph and dynamic programming: tested against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
