"""Telemetry of runs: status, node runs, intake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KNOWN_TYPES = ["click", "view", "purchase", "signup"]


def run_status(nodes: Column, cancelled: Column, halted: Column, failure: Column, completion: Column) -> Column:
    """One status in strict order of precedence; nodes array<struct<status,...>>, null before the run began.

    A node list that is there but empty is a run that has begun.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    of = lambda s: F.exists(nodes, lambda n: n["status"] == s)
    done = F.forall(nodes, lambda n: n["status"] == "success") & (F.size(nodes) > 0)
    return (
        F.when(nodes.isNull() & ~yes(cancelled) & ~yes(halted) & ~yes(failure) & ~yes(completion), "queued")
        .when(yes(cancelled), "cancelled").when(yes(halted), "halted").when(yes(failure) | yes(of("failed")), "failed")
        .when(yes(completion), "succeeded").when(F.size(nodes) == 0, "running").when(yes(of("running")), "running").when(yes(done), "succeeded").otherwise("running")
    )


def with_status(runs: DataFrame) -> DataFrame:
    return runs.withColumn("status", run_status(F.col("node_runs"), *[F.col(c) for c in ("cancelled", "halted", "failure", "completion")]))


def active(runs: DataFrame) -> DataFrame:
    """Runs with a node that is neither a success nor failed, or without nodes yet."""
    return runs.where(F.coalesce(F.exists("node_runs", lambda n: ~n["status"].isin("success", "failed")), F.lit(True)) | (F.size("node_runs") == 0))


def node_rows(runs: DataFrame) -> DataFrame:
    """(run_id, node, status, seconds, error, input, input_tokens, output_tokens, model): one row a node run.

    What a node does not record (its struct has no such field) is null.
    """
    fields = {f.name for f in runs.schema["node_runs"].dataType.elementType.fields}
    x = runs.select("run_id", F.explode("node_runs").alias("n"))
    some = lambda f, kind: (F.col(f"n.{f}") if f in fields else F.lit(None)).cast(kind).alias(f)
    used = lambda f, kind: (F.col(f"n.usage.{f}") if "usage" in fields else F.lit(None)).cast(kind).alias(f)
    seconds = ((F.unix_micros("n.completed_at") - F.unix_micros("n.started_at")) / 1_000_000).alias("seconds")
    return x.select("run_id", "n.node", "n.status", seconds, some("error", "string"), some("input", "string"), used("input_tokens", "long"), used("output_tokens", "long"), used("model", "string"))


def mark_failed(runs: DataFrame, why: Column) -> DataFrame:
    """runs with metadata.failure set, the other keys of the map as they are."""
    return runs.withColumn("metadata", F.map_concat(F.map_filter("metadata", lambda k, v: k != "failure"), F.create_map(F.lit("failure"), why)))


def intake(events: DataFrame, known: list[str] = KNOWN_TYPES, payload: str = "props") -> tuple[DataFrame, DataFrame]:
    """(queued, rejected with reason): the type must be known and the payload a JSON object with a number k."""
    k = F.from_json(payload, "k bigint")["k"]
    reason = F.when(~F.coalesce(F.col("event_type").isin(known), F.lit(False)), "unknown_type").when(k.isNull(), "bad_payload")
    x = events.withColumn("reason", reason)
    return x.where("reason is null").drop("reason").withColumn("status", F.lit("queued")), x.where("reason is not null")
