"""The engine's tables, derived from the given ones: once for Spark, once as SQL with the same rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import tokens

BASE = "2024-06-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base() -> F.Column:
    return F.lit(BASE).cast("timestamp")


def days(n) -> F.Column:
    return F.make_dt_interval(n.cast("int"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").join(e, "doc_id", "left")  # a document without a vector is a chunk too
    return _chunks(d)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunks without file_path and embedding, which vectors' rows tell, so that texts go through no join."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.lit(None).cast("int").alias("label"), F.lit(None).alias("embedding"))
    return _chunks(d).drop("file_path", "embedding")


def _chunks(d: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    return d.select(
        i.alias("id"),
        F.concat(F.lit("d"), i).alias("doc_id"),
        F.concat(F.lit("docs/f"), F.coalesce("label", i % 12), F.lit(".md")).alias("file_path"),
        F.concat(F.lit("s"), i % 7).alias("section"),
        F.col("lang").alias("project"),
        F.col("source").alias("title"),
        F.when(i % 5 == 0, F.lit(None)).when(i % 11 == 0, "archived").otherwise("active").alias("status"),
        F.when(i % 13 != 0, base() - days(i % 100)).alias("authored_at"),
        (base() - days(i % 30)).alias("indexed_at"),
        F.when(i % 17 == 0, "client").alias("client_slug"),
        F.when(i % 3 == 0, F.lit("m1")).when(i % 3 == 1, F.lit("m2")).alias("embedding_model"),
        F.array("lang", "source").alias("layer"),
        F.concat(F.lit("from "), "source", F.lit(" in "), "lang").alias("description"),
        F.array(F.concat(F.lit("k"), i % 5), F.lit("été")).alias("keywords"),
        F.col("text").alias("content"),
        "embedding",
    )


CHUNKS = f"""chunks as (
  select doc_id as id, 'd' || doc_id as doc_id, 'docs/f' || coalesce(label, doc_id % 12) || '.md' as file_path, 's' || (doc_id % 7) as section, lang as project, source as title,
    case when doc_id % 5 = 0 then null when doc_id % 11 = 0 then 'archived' else 'active' end as status,
    case when doc_id % 13 <> 0 then timestamp '{BASE}' - to_days((doc_id % 100)::int) end as authored_at,
    timestamp '{BASE}' - to_days((doc_id % 30)::int) as indexed_at,
    case when doc_id % 17 = 0 then 'client' end as client_slug,
    case when doc_id % 3 = 0 then 'm1' when doc_id % 3 = 1 then 'm2' end as embedding_model,
    [lang, source] as layer, 'from ' || source || ' in ' || lang as description, ['k' || (doc_id % 5), 'été'] as keywords, text as content, embedding::double[] as embedding
  from documents left join (select vec_id as doc_id, embedding, label from embeddings) using (doc_id))"""


def recall_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50; two words of its text make the query's text."""
    c = chunks(spark, sf_dir).where("id % 50 = 0 and embedding is not null")
    t = tokens(F.col("content"))
    return c.select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"), F.concat_ws(" ", F.get(t, F.lit(3)), F.get(t, F.lit(6))).alias("query"), F.col("project").alias("qproject"))


QUERIES = """q as (
  select id as qid, embedding as qvec, concat_ws(' ', t[4], t[7]) as query, project as qproject
  from (select *, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') as t from chunks where id % 50 = 0 and embedding is not null))"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id")
    n = d.agg(F.count("*").alias("n"))
    e = d.join(F.broadcast(n))  # one row, for the modulus
    to = (F.col("doc_id") * 7 + 1) % F.col("n")
    return e.select(F.concat(F.lit("d"), "doc_id").alias("source_id"), F.concat(F.lit("d"), to).alias("to_ref"), F.when(F.col("doc_id") % 11 != 0, F.concat(F.lit("d"), to)).alias("target_id"))


EDGES = """edges as (
  select 'd' || doc_id as source_id, 'd' || ((doc_id * 7 + 1) % n) as to_ref, case when doc_id % 11 <> 0 then 'd' || ((doc_id * 7 + 1) % n) end as target_id
  from documents, (select count(*) as n from documents))"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("text").alias("fact"))
    d = d.join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    i = F.col("doc_id")
    return d.join(e, "doc_id", "left").select(
        i.alias("fact_id"),
        F.col("source").alias("peer_id"),
        F.col("lang").alias("workspace_id"),
        "fact",
        (0.5 + 0.4 * F.col("quality")).alias("confidence"),
        F.lit(0.95).alias("decay_factor"),
        (base() - days(7 * (i % 52))).alias("updated_at"),
        F.when(i % 9 != 0, F.col("embedding")).alias("embedding"),
    )


FACTS = f"""facts as (
  select doc_id as fact_id, source as peer_id, lang as workspace_id, text as fact, 0.5::double + 0.4::double * quality as confidence, 0.95::double as decay_factor,
    timestamp '{BASE}' - to_days((7 * (doc_id % 52))::int) as updated_at, case when doc_id % 9 <> 0 then embedding::double[] end as embedding
  from documents join labels using (doc_id) left join (select vec_id as doc_id, embedding from embeddings) using (doc_id))"""


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    when = F.unix_micros(base()) + (F.col("conv_id") * 3600 + F.col("turn") * 60) * 1_000_000
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("episode_id"),
        F.concat(F.lit("p"), F.col("conv_id") % 50).alias("peer_id"),
        F.concat(F.lit("w"), F.col("conv_id") % 5).alias("workspace_id"),
        F.col("conv_id").alias("session_id"),
        "turn",
        "role",
        F.col("text").alias("summary"),
        F.timestamp_micros(when).alias("occurred_at"),
    )


EPISODES = f"""episodes as (
  select conv_id * 1000 + turn as episode_id, 'p' || (conv_id % 50) as peer_id, 'w' || (conv_id % 5) as workspace_id, conv_id as session_id, turn, role, text as summary,
    make_timestamp(epoch_us(timestamp '{BASE}') + (conv_id * 3600 + turn * 60) * 1000000) as occurred_at
  from conversations)"""


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    i, conf = F.col("event_id"), F.col("value") / (F.col("value") + 10)
    return e.select(
        i.alias("id"),
        F.concat_ws(":", "event_type", F.col("user_id") % 20).alias("query"),
        F.when(i % 5 == 0, "eval").when(i % 5 == 1, F.lit(None)).when(i % 5 == 2, "http").otherwise("cli").alias("surface"),
        conf.alias("confidence"),
        (conf < 0.6552).alias("abstained"),
        F.array(F.lit(1.0), 1 - (i % 10) / 100).alias("top_scores"),
        F.create_map(F.lit("semantic"), i % 6, F.lit("keyword"), i % 4).alias("via_mix"),
        F.col("ts").alias("created_at"),
    )


QUERY_LOG = """query_log as (
  select event_id as id, event_type || ':' || (user_id % 20) as query,
    case event_id % 5 when 0 then 'eval' when 1 then null when 2 then 'http' else 'cli' end as surface,
    value / (value + 10) as confidence, value / (value + 10) < 0.6552::double as abstained,
    [1.0::double, 1 - (event_id % 10)::double / 100] as top_scores, event_id % 6 as via_semantic, event_id % 4 as via_keyword, ts as created_at
  from events)"""


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases: one expected chunk for three of four items, none for the fourth, which should be abstained on."""
    b = read(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    expect = F.when(i % 4 != 3, F.array(F.concat(F.lit("d"), i * 3))).otherwise(F.array().cast("array<string>"))
    return b.select(i.alias("case_id"), F.col("text").alias("query"), expect.alias("expect_docs"), (i % 4 == 3).alias("expect_abstain"))


GOLDEN = """golden as (
  select item_id as case_id, text as query, case when item_id % 4 <> 3 then ['d' || (item_id * 3)] else []::varchar[] end as expect_docs, item_id % 4 = 3 as expect_abstain from benchmark)"""


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as markdown: every third line of a text becomes a header of level 2 (some with a blank line behind), every fifth other line one of level 3."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 3 == 1, F.concat(F.lit("## "), x, F.when(i % 2 == 0, "\n").otherwise(""))).when(i % 5 == 4, F.concat(F.lit("### "), x)).otherwise(x))
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("docs/"), "source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), "lang", "source", F.array_join(lines, "\n").alias("body"))


MARKDOWN = """markdown as (
  select doc_id, 'docs/' || source || '/' || doc_id || '.md' as path, lang, source,
    array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: case when (i - 1) % 3 = 1 then '## ' || x || case when (i - 1) % 2 = 0 then chr(10) else '' end when (i - 1) % 5 = 4 then '### ' || x else x end), chr(10)) as body
  from documents)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run for each user: an entry for each event type with the user's latest event of it."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    node = F.struct(F.col("ts"), F.col("event_id"), F.col("value"))
    n = e.groupBy("user_id", "event_type").agg(F.max(node).alias("last"), F.min("ts").alias("began"))
    status = F.when(F.col("last.event_id") % 7 == 0, "failed").when(F.col("last.event_id") % 5 == 0, "running").otherwise("success")
    n = n.select("user_id", F.struct(F.col("event_type").alias("node"), status.alias("status"), F.col("began").alias("started_at"), F.col("last.ts").alias("completed_at")).alias("node"))
    i = F.col("user_id")
    nodes = F.when(i % 10 == 0, F.lit(None)).when(i % 10 == 1, F.array().cast("array<struct<node:string,status:string,started_at:timestamp,completed_at:timestamp>>")).otherwise(F.array_sort(F.collect_list("node")))
    out = n.groupBy("user_id").agg(nodes.alias("node_runs"))
    return out.select(i.alias("run_id"), "node_runs", (i % 13 == 2).alias("cancelled"), (i % 17 == 3).alias("halted"), (i % 19 == 4).alias("failure"), (i % 23 == 5).alias("completion"))


RUNS = """node_runs as (
  select user_id as run_id, event_type as node, min(ts) as started_at, max(ts) as completed_at, max_by(event_id, (ts, event_id)) as last_id from events group by all),
nodes as (
  select run_id, node, case when last_id % 7 = 0 then 'failed' when last_id % 5 = 0 then 'running' else 'success' end as status, started_at, completed_at from node_runs where run_id % 10 > 1),
runs as (
  select user_id as run_id, user_id % 10 = 0 as no_nodes, user_id % 13 = 2 as cancelled, user_id % 17 = 3 as halted, user_id % 19 = 4 as failure, user_id % 23 = 5 as completion from events group by user_id)"""

NEEDS = {"q": ["chunks"]}
VIEWS = {"chunks": CHUNKS, "q": QUERIES, "edges": EDGES, "facts": FACTS, "episodes": EPISODES, "query_log": QUERY_LOG, "golden": GOLDEN, "markdown": MARKDOWN, "runs": RUNS}


def sql(views: str, body: str) -> str:
    """body after the named views (space-separated), each once."""
    names: list[str] = []
    for v in views.split():
        names += [n for n in [*NEEDS.get(v, []), v] if n not in names]
    return "with recursive " + ",\n".join(VIEWS[n] for n in names) + ("\n" if body.lstrip().startswith("select") else ",\n") + body
