"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows that Python workers get at once: whole texts are long, and a worker holds several copies of a batch.

    Spark bounds a batch by 64 MB as well. The setting is the session's and stays.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def tidy() -> None:
    """At a task's start: free what earlier tasks of this Python worker left, whose functions came with tables of their own."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession, data: bytes, where: str) -> None:
    """Put the file into the shared folder and make it known to every executor, present and future."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(where)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        with tempfile.NamedTemporaryFile(delete=False) as f:
            f.write(data)
        fs.copyFromLocalFile(True, True, jvm.org.apache.hadoop.fs.Path(f"file://{f.name}"), target)
        if os.path.exists(f.name):
            os.unlink(f.name)
    spark.sparkContext.addFile(where)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id for each vertex of edges(a long, b long): columns id, component_id.

    Every round keeps a smaller label for each vertex (the least label of its neighbours, then the label of
    that label), so a chain of n edges takes about log n rounds. A round is two joins and aggregates with
    map-side combination; nothing is gathered per vertex, so a hub with many links is only a skewed join.
    Self links and repeated links do no harm; null ends are dropped.
    """
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = stored(e.union(e.select("b", "a")).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("l"))
    labels = stored(labels, "labels")
    total_of = lambda x: x.agg(F.sum(F.col("l").cast("decimal(38,0)"))).first()[0]
    before = total_of(labels)  # labels only fall, so an equal sum means that none changed
    for _ in range(max_rounds):
        other = labels.select(F.col("id").alias("b"), "l")
        seen = both.join(other, "b").select(F.col("a").alias("id"), "l")
        near = labels.union(seen).groupBy("id").agg(F.min("l").alias("l"))
        near = stored(near, "labels")
        up = near.select(F.col("id").alias("l"), F.col("l").alias("m"))
        jumped = near.join(up, "l", "left").select("id", F.least("l", F.coalesce("m", "l")).alias("l"))
        # hooking: the label's own vertex also takes the least label that its members have seen
        hooked = labels.join(near.withColumnRenamed("l", "m"), "id").groupBy(F.col("l").alias("id")).agg(F.min("m").alias("l"))
        new = stored(jumped.union(hooked).groupBy("id").agg(F.min("l").alias("l")), "labels")
        total, labels = total_of(new), new
        if total == before:
            return labels.select("id", F.col("l").alias("component_id"))
        before = total
    raise RuntimeError("links did not settle")
