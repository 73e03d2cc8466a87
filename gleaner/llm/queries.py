"""The queries over the training-data operators: thin projections of each operator's result to its contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fingerprints, html, language, licenses, mixing, near_duplicates, quality, scoring, toxicity
from .common import stash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(by: int) -> Column:
    """crc32 of the doc_id as text, modulo ``by``. Null for a null id: such rows are not learned from and count as held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(by))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marks = stash(fingerprints.edited_fingerprints(docs), "fingerprints")
    digest = F.substring_index("fingerprint", ":", 1)
    groups = fingerprints.exact_duplicates(docs, marks.select("doc_id", digest.alias("digest")))
    # rows of one id and digest are in one group; an id may be null or repeated
    groups = groups.distinct().withColumnsRenamed({"doc_id": "of", "digest": "of_digest"})
    joined = marks.withColumn("digest", digest).join(groups, (F.col("digest") == F.col("of_digest")) & F.col("doc_id").eqNullSafe(F.col("of")))
    return joined.select(*marks.columns, "group_id", "n_copies")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(_remainder(3) == 1, F.lit(True))
    scored = toxicity.score(docs, toxicity.train(docs, labels.filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "neighbours")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(_remainder(4) == 2, F.lit(True))
    told = language.predict(docs, language.train(docs.filter(~held_out)))
    return told.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(_remainder(7) == 2, F.lit(True))
    return scoring.score(table(spark, sf_dir, "documents"), ~held_out)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.classify(docs, quality.train(docs, labels), labels=labels)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_license_scan": op3_license_scan,
    "op4_fingerprints": op4_fingerprints,
    "op5_toxicity": op5_toxicity,
    "op6_html_extraction": op6_html_extraction,
    "op7_language_id": op7_language_id,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_quality": op9_quality,
    "op10_source_mix": op10_source_mix,
}

ORACLES = {
    "op1_decontamination": decontamination.oracle(),
    "op2_near_duplicates": near_duplicates.oracle(),
    "op3_license_scan": licenses.oracle(),
}
