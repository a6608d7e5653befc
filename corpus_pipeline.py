"""A training corpus in five stages: quality, toxicity, near duplicates, decontamination, packing.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and
read again as the next stage's ``docs``.  All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontam, jaccard, packing, quality, toxicity
from quire.llm.queries import WORD_BPE
from quire.llm.shared import fresh_folder, removed


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled neighbours' vote doesn't reject."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labelled ones among them, doesn't call toxic."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than one word in twenty lies in a passage of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document's pieces with their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written below the shared folder and read again.

    Rows with null ids or texts, repeated rows and extra columns go through the stages as each
    operator defines it; an empty table gives an empty packing.  A stage's table is deleted once
    the next one is written.
    """
    at, last = f"{sf_dir}/documents.parquet", None
    for _, stage in STAGES:
        out = fresh_folder(spark, "stage")
        stage(spark, spark.read.parquet(at), sf_dir).write.parquet(out)
        if last:
            removed(spark, last)
        at = last = out
    return spark.read.parquet(at)


#: No SQL: trained classifiers and a tokenizer stand in the way; the stages are tested against brute force.
ORACLE_SQL = None
