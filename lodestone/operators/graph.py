"""Edges between documents: loading, walks, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import VersionedTable, kept, shared_dir


def load_edges(payload: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped) edges of payload(source_id, to_ref, target_id): sources must be known, targets may be missing."""
    known = nodes.select(F.col("node_id").alias("source_id")).distinct()
    return payload.join(known, "source_id", "left_semi"), payload.join(known, "source_id", "left_anti")


VERSION = "2"
NODE = "id string, doc_id string, scope string"
EDGE = "`from` string, to_ref string, target_node_id string, target_doc_id string, kind string"
_PAYLOAD = f"version string, nodes array<struct<{NODE}>>, edges array<struct<{EDGE}>>"


def read_payloads(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """(payload): a JSON text for each line, or with ``whole`` for each file."""
    return spark.read.text(path, wholetext=whole).withColumnRenamed("value", "payload")


def payload_fault(payload: Column) -> Column:
    """Why a payload can't be loaded, or null: no object, keys that are missing, nodes or edges that are no list, another version."""
    keys = F.json_object_keys(payload)
    missing = F.array_except(F.array(F.lit("version"), F.lit("nodes"), F.lit("edges")), keys)
    array = lambda k: F.startswith(F.get_json_object(payload, f"$.{k}"), F.lit("["))
    bad = lambda k: ~F.coalesce(array(k), F.lit(False))
    version = F.get_json_object(payload, "$.version")
    return (
        F.when(keys.isNull(), "no object").when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))).when(bad("nodes"), "nodes is no list").when(bad("edges"), "edges is no list")
        .when(~F.coalesce(version == VERSION, F.lit(False)), F.concat(F.lit("version "), F.coalesce(version, F.lit("null"))))
    )


def edge_rows(payloads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, skipped, rejected) of payloads(payload).

    rows: source_node_id, source_doc_id, to_ref, target_node_id, target_doc_id, kind, scope; targets may be missing, a missing
    kind is 'related'. skipped: edges whose source is no node of the payload. rejected: payloads with their fault.
    """
    x = payloads.withColumn("fault", payload_fault(F.col("payload")))
    rejected = x.where("fault is not null")
    p = x.where("fault is null").select(F.monotonically_increasing_id().alias("no"), F.from_json("payload", _PAYLOAD).alias("p"))
    p = kept(p, "payloads")  # nodes and edges meet by number, which has to stay as it is
    nodes = p.select("no", F.inline("p.nodes")).where("id is not null").groupBy("no", F.col("id").alias("from")).agg(F.max_by(F.struct("doc_id", "scope"), F.struct("doc_id", "scope")).alias("source"))
    e = p.select("no", F.inline("p.edges")).join(nodes, ["no", "from"], "left")
    rows = e.where("source is not null").select(F.col("from").alias("source_node_id"), F.col("source.doc_id").alias("source_doc_id"), "to_ref", "target_node_id", "target_doc_id", F.coalesce("kind", F.lit("related")).alias("kind"), "source.scope")
    return rows, e.where("source is null").drop("no", "source"), rejected


def reload_edges(table: VersionedTable, payloads: DataFrame) -> int:
    """Clear and reload: the rows of the payloads become the table's next version. A payload with a fault stops it."""
    rows, _, rejected = edge_rows(payloads)
    if bad := rejected.select("fault").limit(1).collect():
        raise ValueError(f"payload: {bad[0]['fault']}")
    table.write(rows)
    return table.read().count()


def walk(roots: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(root, node, level): breadth-first walks from many roots at once, each node at its least level.

    A walk never visits a node twice, so cycles end it; it stops at the first level without new nodes.
    """
    shared_dir(roots.sparkSession)  # checkpoints go there
    step = edges.where("target_id is not null").select(F.col("source_id").alias("node"), F.col("target_id").alias("next")).distinct()
    seen = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("level"))
    frontier = seen
    for level in range(1, depth + 1):
        new = frontier.join(step, "node").select("root", F.col("next").alias("node")).distinct()
        frontier = new.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("level", F.lit(level)).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def neighbours(known: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, doc_id) one step from known(qid, doc_id) and not in it."""
    to = known.join(edges.where("target_id is not null"), known["doc_id"] == edges["source_id"]).select("qid", F.col("target_id").alias("doc_id")).distinct()
    return to.join(known, ["qid", "doc_id"], "left_anti")
