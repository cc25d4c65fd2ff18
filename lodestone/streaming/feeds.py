"""The operators as streams. A stream reads a table's files, runs until they are used up and is held to the batch result."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import corpus, memory, runs
from ..sources.manifest import Manifest
from ..sources.shared import shared_dir
from .run_state import last_status, stream_session


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table as a stream of files; it may be one file or a folder of them."""
    path = f"{sf_dir}/{table}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def drained(df: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run a stream over all that is there."""
    q = df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", folder(df.sparkSession, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()


def intake(events: DataFrame, accepted: str, rejected: str) -> None:
    """Route events to two tables; a batch that is run again replaces what it wrote."""

    def each(b: DataFrame, n: int) -> None:
        ok, bad = runs.intake(b)
        ok.write.mode("overwrite").parquet(f"{accepted}/batch={n}")
        bad.write.mode("overwrite").parquet(f"{rejected}/batch={n}")

    drained(events, each)


def abstain_rates(log: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Abstain rate by window, for append mode: a window comes out once the watermark has passed its end, its state goes
    then, and rows that come later are dropped."""
    w = log.withWatermark("created_at", late).groupBy(F.window("created_at", window).alias("w"))
    return w.agg(F.count("*").alias("n"), F.avg(F.col("abstained").cast("int")).alias("rate")).select(F.col("w.start").alias("start"), "n", "rate")


STATE = "turns array<struct<turn:bigint,at:bigint,content:string,topics:array<string>>>"


def append_session_turns(turns: DataFrame, late: str = "1 day", expires: dt.timedelta = dt.timedelta(days=30)) -> DataFrame:
    """(session, turns, last, content, topics) for each session of a batch of turns(session, turn, at, content, topics).

    Turns are kept in order in state, so a late one finds its place and one that comes again replaces itself; topics are those
    of the turns in order, each once. A session goes from the state once the watermark is ``expires`` past its last turn.
    """
    more = int(expires.total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        have = {t[0]: t for t in map(tuple, state.get[0])} if state.exists else {}
        for b in batches:
            for turn, at, content, topics in zip(b["turn"], b["at"], b["content"], b["topics"]):
                have[int(turn)] = (int(turn), int(at.timestamp() * 1000), content, [] if topics is None else list(topics))
        order = [have[t] for t in sorted(have)]
        state.update((order,))
        state.setTimeoutTimestamp(max(max(t[1] for t in order) + more, state.getCurrentWatermarkMs() + 1))
        topics = list(dict.fromkeys(x for t in order for x in t[3]))
        yield pd.DataFrame({"session": [key[0]], "turns": [len(order)], "last": [order[-1][0]], "content": ["\n".join(t[2] or "" for t in order)], "topics": [topics]})

    keyed = turns.withWatermark("at", late).groupBy("session")
    return keyed.applyInPandasWithState(run, "session long, turns long, last long, content string, topics array<string>", STATE, "update", GroupStateTimeout.EventTimeTimeout)


def by_batch(out: str) -> Callable[[DataFrame, int], None]:
    """Writes what a batch brings to a folder of its own; a batch that is run again replaces it."""
    return lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")


def current(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each key's last batch."""
    last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*keys, "batch"], "left_semi")


def remember(store: Manifest, interactions: DataFrame, batch: int, stream: str = "interactions") -> None:
    """Episodes, facts and peers of a batch of interactions(workspace_id and the columns of `memory.interaction_rows`) in one commit.

    A reader sees all of a batch or nothing; a batch that is run again, whole or after a failure between two tables, counts once.
    """
    e, f = memory.interaction_rows(interactions)
    touched = newest_peers(interactions.withColumnRenamed("occurred_at", "updated_at"))
    store.commit(append={"episodes": e, "facts": f, "peers": touched}, based_on=store.state(), writer=stream, batch=batch, folded={"peers": newest_peers})


def newest_peers(touched: DataFrame) -> DataFrame:
    """(workspace_id, peer_id, updated_at) once for each peer. The stored table has a row for each batch that touched one, until its folders are put together."""
    return touched.groupBy("workspace_id", "peer_id").agg(F.max("updated_at").alias("updated_at"))


def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream(spark, sf_dir, "events").withColumn("props", F.when(F.col("event_id") % 9 == 0, "{broken").otherwise(F.col("props")))
    a, r = folder(spark, "accepted"), folder(spark, "rejected")
    intake(e, a, r)
    return spark.read.parquet(a).select("event_id", F.lit(None).cast("string").alias("reason")).union(spark.read.parquet(r).select("event_id", "reason"))


def t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots: each event of a user is one of its run, with a node that has the event's state."""
    own, i = stream_session(spark), F.col("event_id")
    node = F.struct(F.col("event_type").alias("node"), F.when(i % 7 == 0, "failed").when(i % 5 == 0, "running").otherwise("success").alias("status"))
    s = stream(own, sf_dir, "events").select(F.col("user_id").cast("long").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), i.cast("long").alias("seq"), F.array(node).alias("node_runs"), (i % 13 == 2).alias("cancelled"), (i % 17 == 3).alias("halted"), F.lit(False).alias("failure"), F.lit(False).alias("completion"))
    out = folder(spark, "status")
    drained(last_status(s), lambda b, n: by_batch(out)(b.select("run_id", "status"), n), "update")
    return current(spark.read.parquet(out), ["run_id"]).select("run_id", "status")


def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts arrive and are chunked; a batch's groups (path, section) replace those of earlier batches."""
    a = stream(spark, sf_dir, "documents").select(F.col("source").alias("type"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.when(F.col("doc_id") % 4 == 0, "given").alias("section"))
    out = folder(spark, "index")
    drained(a, lambda b, n: by_batch(out)(corpus.ingested(b), n))
    return current(spark.read.parquet(out), ["path", "section"]).select("path", "no", "section", "window", F.sha2("content", 256).alias("content_sha256"))


def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns arrive as interactions: an episode each, a fact that cites it, and the peer touched."""
    c = stream(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("episode_id"), F.concat(F.lit("p"), F.col("conv_id") % 50).alias("peer_id"), F.col("text").alias("summary"), F.timestamp_seconds(F.col("conv_id") * 60 + F.col("turn")).alias("occurred_at"), F.array("text").alias("facts"))
    store = Manifest(spark, folder(spark, "memory"))
    drained(c.withColumn("workspace_id", F.lit("w")), lambda b, n: remember(store, b, n))
    state = store.state()
    read = lambda name: store.read(name, state=state)
    episodes = read("episodes").groupBy("peer_id").agg(F.count("*").alias("episodes"))
    facts = read("facts").groupBy("peer_id").agg(F.count("*").alias("facts"), F.sum(F.length("fact")).alias("characters"))
    peers = read("peers").groupBy("peer_id").agg(F.max("updated_at").alias("updated_at"))
    return peers.join(episodes, "peer_id").join(facts, "peer_id").select("peer_id", "episodes", "facts", "characters", F.unix_micros("updated_at").alias("updated_at"))


def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stream(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", F.timestamp_seconds(1_700_000_000 + F.col("conv_id") * 60 + F.col("turn")).alias("at"), F.col("text").alias("content"), F.array(F.split_part("text", F.lit(" "), F.lit(1))).alias("topics"))
    out = folder(spark, "sessions")
    drained(append_session_turns(c), by_batch(out), "update")
    return current(spark.read.parquet(out), ["session"]).select("session", "turns", "last", F.sha2("content", 256).alias("content_sha256"), F.array_join("topics", ",").alias("topics"))


def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that are closed: their end is two days before the last row or earlier."""
    e = stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("created_at"), (F.col("value") / (F.col("value") + 10) < 0.6552).alias("abstained"))
    out = folder(spark, "rates")
    drained(abstain_rates(e), by_batch(out))
    return spark.read.parquet(out).select(F.unix_micros("start").alias("day"), "n", F.round("rate", 6).alias("rate"))
