"""Stored indexes of the engine's tables: built by the first query that needs one, found again by the next."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession

from ..operators.text_index import TextIndex
from ..operators.vector_index import VectorIndex
from ..sources.manifest import Conflict
from ..sources.shared import shared_dir
from .views import chunks, facts

_TABLES = ("documents", "embeddings", "labels")
LAYOUT = 2  # of what is stored: another number leaves indexes of older code alone


def _place(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A path below the shared folder that names the tables' files as they are: other files, times or sizes mean another index.

    So an index outlives its session, and the next one's queries find it.
    """
    conf, told = spark.sparkContext._jsc.hadoopConfiguration(), [LAYOUT]
    for t in _TABLES:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        fs = at.getFileSystem(conf)
        told += sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(at))
    return f"{shared_dir(spark)}/{name}-{hashlib.sha256(repr(told).encode()).hexdigest()[:24]}"


def _there(index, rows):
    """The index, built of rows() if it isn't there. Where another application builds it at the same time, the first to finish is taken."""
    if not index.exists():
        try:
            index.build(rows())
        except Conflict:
            pass
    return index


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """Of all chunks and fields."""
    return _there(TextIndex(spark, _place(spark, sf_dir, "text")), lambda: chunks(spark, sf_dir))


def vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """Of all chunks that have a vector, with the columns that filters read."""
    index = VectorIndex(spark, _place(spark, sf_dir, "vectors"), keep=("project", "status", "layer"))
    return _there(index, lambda: chunks(spark, sf_dir).where("embedding is not null"))


def fact_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """Of all facts, those without a vector too, with what their weight at a time is made of."""
    keep = ("workspace_id", "confidence", "decay_factor", "updated_at")
    index = VectorIndex(spark, _place(spark, sf_dir, "facts"), keep, group="peer_id")
    return _there(index, lambda: facts(spark, sf_dir).withColumnRenamed("fact_id", "id"))


def indexes(spark: SparkSession, sf_dir: str) -> dict:
    """As arguments of `retrieval.hybrid`."""
    return {"index": text_index(spark, sf_dir), "vectors": vector_index(spark, sf_dir)}
