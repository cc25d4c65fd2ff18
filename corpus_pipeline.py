"""A pipeline over documents: language ID, line dedup, n-gram Jaccard join, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents. Rows of one doc_id and text are treated alike in every stage: all of
them stay or go. Rows without a doc_id are never near duplicates. An empty table passes through. No stage has SQL of its own: rank-order
profiles, recursive metric regions and tokenizers are beyond it, so the tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard, language, line_dedup, packing, pii
from lodestone.llm.common import small_batches, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Predict each document's language from its text; documents that have none (null, or no letter) go.

    lang becomes the predicted one.
    """
    small_batches(spark)
    profiles = language.fit(docs.where(~language.held_out()))
    said = language.identify(docs, profiles, docs.columns)
    return said.where("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines that more than a tenth of a source's documents share; no document goes."""
    small_batches(spark)
    out = line_dedup.line_dedup(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return out.select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest doc_id, of each group linked by five-word shingles at 0.8 or more."""
    small_batches(spark)
    found = jaccard.jaccard_join(docs, words=5, percent=80)
    return docs.join(found.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    small_batches(spark)
    out = pii.redacted(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack into sequences of 4096 tokens along the Hilbert curve."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [("language", language_id), ("lines", dedup_lines), ("near_duplicates", dedup_documents), ("pii", redact), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
