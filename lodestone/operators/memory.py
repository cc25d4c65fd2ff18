"""Episodes and decaying facts of peers within workspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import decayed, token_estimate, uuid_or_null, weeks_between
from .retrieval import scored

CONFIDENCE, FACTOR, CONTRADICTED = 0.9, 0.95, 0.5
CONTEXT_TOKENS, CONTEXT_SHARE = 8000, 0.1


def effective(facts: DataFrame, as_of: Column) -> DataFrame:
    """facts with weeks and effective confidence at as_of."""
    w = weeks_between(F.col("updated_at"), as_of)
    return facts.withColumn("weeks", w).withColumn("effective", decayed(F.col("confidence"), F.col("decay_factor"), w))


def upsert_peers(peers: DataFrame, touched: DataFrame) -> DataFrame:
    """peers(workspace_id, peer_id, updated_at) after touched of the same columns: created, or the later time kept."""
    return peers.select("workspace_id", "peer_id", "updated_at").unionByName(touched).groupBy("workspace_id", "peer_id").agg(F.max("updated_at").alias("updated_at"))


def insert_facts(new: DataFrame, batch_evidence: Column) -> DataFrame:
    """new facts with defaults: confidence, factor, and the batch's evidence where a fact brings none."""
    ev = F.when(F.size("evidence") > 0, F.col("evidence")).otherwise(batch_evidence)
    return new.withColumn("confidence", F.coalesce("confidence", F.lit(CONFIDENCE))).withColumn("decay_factor", F.coalesce("decay_factor", F.lit(FACTOR))).withColumn("evidence", ev)


def contradict(facts: DataFrame, hits: DataFrame, as_of: Column) -> DataFrame:
    """facts after hits(fact_id): decayed first, then halved once for each hit, touched; unknown ids do nothing."""
    n = hits.groupBy("fact_id").agg(F.count("*").alias("hits"))
    x = effective(facts, as_of).join(n, "fact_id", "left")
    hit = F.col("hits").isNotNull()
    return (
        x.withColumn("confidence", F.when(hit, F.col("effective") * F.pow(F.lit(CONTRADICTED), F.col("hits"))).otherwise(F.col("confidence")))
        .withColumn("updated_at", F.when(hit, as_of).otherwise(F.col("updated_at")))
        .drop("weeks", "effective", "hits")
    )


def rank_facts(queries: DataFrame, facts: DataFrame, k: int, as_of: Column | None = None, scope: str | None = "workspace_id", vectors=None) -> DataFrame:
    """(qid, id, score, rn): facts of the query's workspace by similarity, times effective confidence where as_of is given.

    Facts without a vector score 0 and come last. With ``vectors``, a `VectorIndex` of the facts that keeps the scope, confidence, decay_factor and
    updated_at, its lists are read instead.
    """
    if vectors is not None:
        weight = (lambda x: decayed(F.col("confidence"), F.col("decay_factor"), weeks_between(F.col("updated_at"), as_of))) if as_of is not None else None
        return vectors.search(queries, k, weight, (scope, scope) if scope else None, keep_missing=True)
    f = facts.withColumnRenamed("fact_id", "id")
    weight = None
    if as_of is not None:
        f, weight = effective(f, as_of), "effective"
    return scored(queries, f, k, weight, (scope, scope) if scope else None, keep_missing=True)


def recent_episodes(episodes: DataFrame, n: int, by: str = "peer_id") -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("occurred_at"), F.desc("episode_id")))
    return episodes.withColumn("rn", rn).where(F.col("rn") <= n)


def context_budget(rows: DataFrame, key: str, text: str) -> DataFrame:
    t = F.sum(token_estimate(F.col(text)))
    return rows.groupBy(key).agg(t.alias("tokens")).withColumn("over_budget", F.col("tokens") > CONTEXT_TOKENS * CONTEXT_SHARE)


def consolidation_context(peers: DataFrame, episodes: DataFrame, facts: DataFrame, since: Column) -> DataFrame:
    """(peer_id, representation, kind, id, at, text): each peer's episodes since a time and all its facts, a row each.

    A peer's context in order is its rows by kind, at, id; a peer without either has one row of no kind. Rows are never gathered,
    however many a peer has.
    """
    e = episodes.where(F.col("occurred_at") >= since).select("peer_id", F.lit("episode").alias("kind"), F.col("episode_id").alias("id"), F.col("occurred_at").alias("at"), F.col("summary").alias("text"))
    f = facts.select("peer_id", F.lit("fact").alias("kind"), F.col("fact_id").alias("id"), F.lit(None).cast("timestamp").alias("at"), F.col("fact").alias("text"))
    return peers.select("peer_id", "representation").join(e.unionByName(f), "peer_id", "left")


def consolidation_apply(peers: DataFrame, facts: DataFrame, results: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(peers, old facts, new facts) after results(peer_id, fact, contradicts, representation).

    Ids that are no uuid count as none; results of unknown peers are ignored.
    """
    known = results.join(peers.select("peer_id"), "peer_id", "left_semi").withColumn("contradicts", uuid_or_null(F.col("contradicts")))
    old = contradict(facts, known.where("contradicts is not null").select(F.col("contradicts").alias("fact_id")), as_of)
    new = known.where("fact is not null").select("peer_id", "fact", F.lit(CONFIDENCE).alias("confidence"), F.lit(FACTOR).alias("decay_factor"))
    rep = known.groupBy("peer_id").agg(F.max("representation").alias("new_representation"))
    p = peers.join(rep, "peer_id", "left").withColumn("representation", F.coalesce("new_representation", "representation")).drop("new_representation")
    return p, old, new


def interaction_rows(records: DataFrame, as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(episodes, facts) of records(episode_id, peer_id, summary, occurred_at, facts array<string>): facts cite their episode.

    Tags and vectors stay with the episode where records have them; an episode without a time took place at ``as_of``.
    """
    more = [c for c in ("tags", "embedding") if c in records.columns]
    e = records.select("episode_id", "peer_id", "summary", F.coalesce("occurred_at", *[as_of] * (as_of is not None)).alias("occurred_at"), *more)
    f = records.select("peer_id", F.explode("facts").alias("fact"), F.array(F.col("episode_id")).alias("evidence"), F.lit(CONFIDENCE).alias("confidence"), F.lit(FACTOR).alias("decay_factor"))
    return e, f
