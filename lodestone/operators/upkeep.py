"""Refresh and repair of a stored corpus: index, content and edges change in one commit, and what changed is told as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.manifest import Manifest
from ..sources.shared import kept
from .corpus import after_rebuild, pruned, replaced, to_index
from .graph import edge_rows
from .reconcile import deleted_files, orphan_chunks, report

EDGES = "source_id string, to_ref string, target_id string"
ERRORS = "kind string, key string, error string"
#: Axes of a report that a repair acts on; the others need a rebuild by hand.
REPAIRED = ("deleted", "orphan_chunk", "dangling")


def loaded_edges(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, errors) of payloads(payload): a payload with a fault and an edge without a source are an error each."""
    rows, skipped, rejected = edge_rows(payloads)
    edges = rows.select(F.col("source_doc_id").alias("source_id"), "to_ref", F.col("target_doc_id").alias("target_id"))
    errors = rejected.select(F.lit("payload").alias("kind"), F.substring("payload", 1, 80).alias("key"), F.col("fault").alias("error"))
    return edges, errors.unionByName(skipped.select(F.lit("edge").alias("kind"), F.col("from").alias("key"), F.lit("unknown source").alias("error")))


def refresh(store: Manifest, files: DataFrame, chunked: Callable[[DataFrame], DataFrame], failed: DataFrame, payloads: DataFrame | None = None, rebuild: DataFrame | None = None, dry_run: bool = False) -> DataFrame:
    """Bring the tables ``index``, ``edges`` and ``errors`` of a store up to files(path, mtime), in one commit; a row of what was done.

    Files that are due (all of them in a rebuild) are cut by ``chunked(files)`` and replace their groups. failed(path, error) are files that can't be parsed:
    they keep their rows, except that a rebuild, given as the manifest of projects(slug), first clears all rows it may clear. Edges are loaded anew from payloads; if one has
    a fault, the old edges stay. Every failure is a row of errors(kind, key, error), and any but a skipped edge makes the exit code 1. A dry run
    commits nothing and skips the edges. Summary: version, dry_run, due, chunks, failed, success, exit_code, edges (null where skipped).
    """
    state = store.state()
    index = store.read("index", state=state)
    base = index if rebuild is None else after_rebuild(index, rebuild)
    due = (files if rebuild is not None else to_index(files, index)).join(failed.select("path"), "path", "left_anti")
    new = chunked(due)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    errors = failed.select(F.lit("parse").alias("kind"), F.col("path").alias("key"), "error")
    spark, version, edges = index.sparkSession, state["version"], None
    if not dry_run:
        new = kept(new, "chunks")
        tables = {"index": replaced(base, new, ["file_path", "section"])}
        if payloads is not None:
            rows, faults = loaded_edges(payloads)
            errors = kept(errors.unionByName(faults), "errors")
            if errors.where("kind = 'payload'").isEmpty():
                tables["edges"] = rows
        version = store.commit(replace=tables | {"errors": errors}, based_on=state)
        edges = store.read("edges").count() if payloads is not None else None
    one = count(due, "due").join(F.broadcast(count(new, "chunks"))).join(F.broadcast(count(errors.where("kind <> 'edge'"), "failed")))  # one row each
    ok = F.col("failed") == 0
    return one.select(F.lit(version).cast("long").alias("version"), F.lit(dry_run).alias("dry_run"), "due", "chunks", "failed", ok.alias("success"), F.when(ok, 0).otherwise(1).alias("exit_code"), F.lit(edges).cast("long").alias("edges"))


def difference(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): rows added, removed or changed between two versions of a table with unique keys. Only keys and digests are shuffled."""
    digest = lambda df, name: df.select(*keys, F.sha2(F.to_json(F.struct(*[c for c in sorted(old.columns) if c not in keys])), 256).alias(name))
    both = digest(old, "__old").join(digest(new, "__new"), keys, "full")
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") != F.col("__new"), "changed")
    return both.select(*keys, change.alias("change")).where("change is not null")


def repair(store: Manifest, files: DataFrame, current: DataFrame, payloads: DataFrame, model: str) -> DataFrame:
    """Repair the tables ``index``, ``content`` and ``edges`` of a store in one commit; (axis, key, detail, outcome) of each finding before or after.

    Rows of deleted files are pruned (clients' rows stay), groups of content without a first chunk go, and if an edge dangles, all edges are loaded anew. Findings are
    ``repaired``, ``new`` (there only afterwards), ``left`` (acted on, there still) or ``manual`` (sections and models, which take a rebuild).
    """
    state = store.state()
    index, content, edges = (store.read(t, state=state) for t in ("index", "content", "edges"))
    before = kept(report(index, files, current, content, edges, model), "before")
    tables = {"index": pruned(index, deleted_files(index, files))[0], "content": content.join(orphan_chunks(content), "doc_id", "left_anti").select(*content.columns)}
    if not before.where("axis = 'dangling'").isEmpty():
        rows, errors = loaded_edges(payloads)
        if bad := errors.where("kind = 'payload'").limit(1).collect():
            raise ValueError(f"payload: {bad[0]['error']}")
        tables["edges"] = rows
    store.commit(replace=tables, based_on=state)
    index, content, edges = (store.read(t) for t in ("index", "content", "edges"))
    after = report(index, files, current, content, edges, model)
    found = before.withColumn("at", F.lit(1)).unionByName(after.withColumn("at", F.lit(2)))
    both = found.groupBy("axis", "key", F.col("detail")).agg(F.bit_or("at").alias("at"))
    outcome = F.when(F.col("at") == 1, "repaired").when(F.col("at") == 2, "new").when(F.col("axis").isin(*REPAIRED), "left").otherwise("manual")
    return both.select("axis", "key", "detail", outcome.alias("outcome"))
