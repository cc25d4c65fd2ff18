"""Drift between a corpus and its index, in one long-form report (axis, key, detail)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import pruned, skipped

SYNTHETIC = "ingested/%"


def own_rows(index: DataFrame) -> DataFrame:
    return index.where(F.col("client_slug").isNull() & ~F.col("file_path").like(SYNTHETIC))


def deleted_files(index: DataFrame, files: DataFrame) -> DataFrame:
    return own_rows(index).select(F.col("file_path").alias("path")).distinct().join(files.select("path"), "path", "left_anti")


def orphan_sections(index: DataFrame, current: DataFrame) -> DataFrame:
    """(path, section) in the index but no longer in current(path, section), of files that current knows."""
    have = own_rows(index).select(F.col("file_path").alias("path"), F.coalesce("section", F.lit("")).alias("section")).distinct()
    now = current.select("path", F.coalesce("section", F.lit("")).alias("section")).distinct()
    return have.join(now, ["path", "section"], "left_anti").join(now.select("path").distinct(), "path", "left_semi")


def orphan_chunks(content: DataFrame) -> DataFrame:
    """doc_id of groups without a first chunk."""
    return content.groupBy("doc_id").agg(F.min(F.when(F.col("position") == 0, 0)).alias("root")).where("root is null").select("doc_id")


def dangling(edges: DataFrame, docs: DataFrame) -> DataFrame:
    known = docs.select(F.col("doc_id").alias("target_id")).distinct().withColumn("known", F.lit(True))
    return edges.join(known, "target_id", "left").where("target_id is null or known is null").select("source_id", "to_ref")


def model_mismatch(tables: dict[str, DataFrame], model: str) -> DataFrame:
    """(table, mismatched, unstamped) for tables with embedding_model."""
    out = None
    for name, t in tables.items():
        x = t.select(F.lit(name).alias("table"), "embedding_model")
        out = x if out is None else out.union(x)
    return out.groupBy("table").agg(F.count_if(F.col("embedding_model") != model).alias("mismatched"), F.count_if(F.col("embedding_model").isNull()).alias("unstamped"))


def synthetic(index: DataFrame) -> DataFrame:
    return index.where(F.col("file_path").like(SYNTHETIC)).agg(F.count("*").alias("n"), F.min("authored_at").alias("first"), F.max("authored_at").alias("last"))


def ceiling(files: DataFrame, index: DataFrame, failed: DataFrame) -> DataFrame:
    """(reason, n): files that can't be in the index by first reason, that failed, or that have no rows."""
    why = files.select("path", skipped(F.col("path")).alias("reason"))
    bad = why.where("reason is null").join(failed.select("path"), "path", "left_semi").select("path", F.lit("unparseable").alias("reason"))
    rest = why.where("reason is null").join(failed.select("path"), "path", "left_anti")
    none = rest.join(index.select(F.col("file_path").alias("path")), "path", "left_anti").select("path", F.lit("no_rows").alias("reason"))
    return why.where("reason is not null").union(bad).union(none).groupBy("reason").agg(F.count("*").alias("n"))


def report(index: DataFrame, files: DataFrame, current: DataFrame, content: DataFrame, edges: DataFrame, model: str) -> DataFrame:
    """(axis, key, detail) of the five axes that mean drift."""
    text = lambda c: F.col(c).cast("string")
    rows = deleted_files(index, files).select(F.lit("deleted").alias("axis"), F.col("path").alias("key"), F.lit("").alias("detail"))
    rows = rows.union(orphan_sections(index, current).select(F.lit("section"), "path", "section"))
    rows = rows.union(orphan_chunks(content).select(F.lit("orphan_chunk"), text("doc_id"), F.lit("")))
    rows = rows.union(dangling(edges, index).select(F.lit("dangling"), "source_id", "to_ref"))
    m = model_mismatch({"index": index, "content": content}, model)
    return rows.union(m.where("mismatched > 0").select(F.lit("model"), "table", text("mismatched")))


def drift(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("findings"), (F.count("*") > 0).alias("drift"))


def repaired(index: DataFrame, files: DataFrame, content: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, content, edges) with deleted files pruned, rootless groups dropped and edges to unknown documents cut to null."""
    new, _ = pruned(index, deleted_files(index, files))
    known = new.select(F.col("doc_id").alias("target_id")).distinct().withColumn("known", F.lit(True))
    cut = edges.join(known, "target_id", "left").select("source_id", "to_ref", F.when(F.col("known"), F.col("target_id")).alias("target_id"))
    return new, content.join(orphan_chunks(content), "doc_id", "left_anti"), cut


def health(index: DataFrame, edges: DataFrame, related: str = "related") -> DataFrame:
    """One row: documents, chunks, edges, newest time, and whether edges are missing though documents name some."""
    some = F.bool_or(F.size(related) > 0) if related in index.columns else F.lit(False)
    x = index.agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.max("indexed_at").alias("newest"), F.coalesce(some, F.lit(False)).alias("named"))
    e = edges.agg(F.count("*").alias("edges"))
    return x.join(F.broadcast(e)).withColumn("edges_missing", F.col("named") & (F.col("edges") == 0)).drop("named")  # one row each
