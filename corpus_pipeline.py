"""A training corpus in five stages: language, quality, near duplicates, benchmark leaks, source mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of ``documents``; the last returns the rows of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import decontamination, language, mixing, near_duplicates, quality
from gleaner.llm.common import stash


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` less the rows whose doc_id is in ``dropped``: rows that repeat an id, or have none, go together."""
    name = "gone"
    while name in docs.columns:
        name += "_"
    gone = stash(dropped.select(F.col("doc_id").alias(name)).distinct(), "dropped")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that no learned language explains go, and those without letters, null and empty ones among them. Learns from
    the documents' own labels; rows are judged one by one, whatever their ids."""
    return language.accepted(docs, language.train(docs))


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of good quality is under one half go; of rows that share an id all, if one does."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(docs, quality.classify(docs, quality.train(docs, labels), labels=labels).filter("NOT keep"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest doc_id stays; of rows that repeat an id one.

    Texts without words stay, as they are near to nothing; so do rows without an id, which no smaller id can stand for.
    """
    kept = _without(docs, near_duplicates.near_duplicates(docs).filter("doc_id <> component_id"))
    repeated = not docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").isEmpty()
    return kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id IS NULL")) if repeated else kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go; of rows that share an id all, if one does."""
    found = decontamination.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.filter("contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document that is left: a row for each, those without words or source too."""
    return mixing.mix(docs)


STAGES = [
    ("language", identify_language),
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
]

#: Language models and the classifier have no SQL. The operators are tested against plain versions each; tests of the stages
#: check what they drop and keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
