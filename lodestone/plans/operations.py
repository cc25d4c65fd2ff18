"""Queries over reconciliation, runs, scalars and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import chunking as K
from ..operators import reconcile as I
from ..operators import runs as J
from ..operators.query_log import read_window
from ..operators.upkeep import repair
from ..sources.manifest import Manifest
from ..sources.shared import shared_dir
from ..streaming import feeds
from .corpus import _FILES, _files, _payloads, _times, _TIMES
from .views import base, chunks, edges, query_log, read, runs, sql


def _content(spark, d):
    """Content chunks: the turns of conversations as positions; every ninth conversation lacks its first."""
    c = read(spark, d, "conversations")
    return c.where("turn <> 0 or conv_id % 9 <> 0").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("position"), F.when(F.col("conv_id") % 4 != 0, F.lit("m1")).alias("embedding_model"))


def _current(spark, d):
    c = chunks(spark, d)
    return c.where("section <> 's3' and file_path <> 'docs/f5.md'").select(F.col("file_path").alias("path"), "section").distinct()


def i1(spark, d):
    return I.deleted_files(chunks(spark, d), _times(spark, d))


def i2(spark, d):
    return I.orphan_sections(chunks(spark, d), _current(spark, d))


def i3(spark, d):
    return I.orphan_chunks(_content(spark, d))


def i4(spark, d):
    return I.dangling(edges(spark, d), chunks(spark, d))


def i5(spark, d):
    return I.model_mismatch({"index": chunks(spark, d), "content": _content(spark, d)}, "m1")


def i6(spark, d):
    x = chunks(spark, d).withColumn("file_path", F.when(F.col("id") % 6 == 0, F.concat(F.lit("ingested/a/"), "id", F.lit(".md"))).otherwise(F.col("file_path")))
    return I.synthetic(x).select("n", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"))


def i7(spark, d):
    f = _files(spark, d)
    index = f.where("doc_id % 3 = 0").select(F.col("path").alias("file_path"))
    return I.ceiling(f, index, f.where("doc_id % 10 = 0").select("path"))


def i8(spark, d):
    """Every finding."""
    return I.report(chunks(spark, d), _times(spark, d), _current(spark, d), _content(spark, d), edges(spark, d), "m1")


def i9(spark, d):
    from ..operators.corpus import stale

    return stale(_times(spark, d), chunks(spark, d)).select("path")


def i10(spark, d):
    """Findings before and after a repair of the stored tables, and what became of each."""
    store = Manifest(spark, f"{shared_dir(spark)}/repair-{uuid.uuid4().hex}")
    columns = ["id", "doc_id", "file_path", "section", "client_slug", "embedding_model"]
    store.commit(replace={"index": chunks(spark, d).select(*columns), "content": _content(spark, d), "edges": edges(spark, d).select("source_id", "to_ref", "target_id")})
    return repair(store, _times(spark, d), _current(spark, d), _payloads(spark, d), "m1")


def i10_cut(spark, d):
    """Without payloads: edges to documents that are gone are cut to null."""
    _, _, cut = I.repaired(chunks(spark, d), _times(spark, d), _content(spark, d), edges(spark, d))
    return cut.select("source_id", "to_ref", "target_id")


def i11(spark, d):
    x = I.health(chunks(spark, d).withColumn("related", F.array(F.lit("x"))), edges(spark, d))
    return x.withColumn("newest", F.unix_micros("newest"))


def j1(spark, d):
    return J.with_status(runs(spark, d)).select("run_id", "status")


def j2(spark, d):
    return J.active(runs(spark, d)).select("run_id")


def j3(spark, d):
    """Failed nodes have an error; every node tells what it was given and used."""
    usage = lambda n: F.struct(F.length(n["node"]).cast("long").alias("input_tokens"), F.lit(7).cast("long").alias("output_tokens"), F.lit("m1").alias("model"))
    more = lambda n: n.withField("error", F.when(n["status"] == "failed", F.concat(F.lit("failed: "), n["node"]))).withField("input", n["node"]).withField("usage", F.when(n["status"] != "running", usage(n)))
    r = runs(spark, d).withColumn("node_runs", F.transform("node_runs", more))
    return J.node_rows(r).withColumn("seconds", F.round("seconds", 6))


def j4(spark, d):
    r = read(spark, d, "events").select("event_id", F.create_map(F.lit("failure"), F.lit("old"), F.lit("kind"), F.col("event_type")).alias("metadata"))
    m = J.mark_failed(r, F.concat(F.lit("event "), "event_id"))
    return m.select("event_id", F.try_element_at("metadata", F.lit("failure")).alias("failure"), F.try_element_at("metadata", F.lit("kind")).alias("kind"))


def _intake(spark, d):
    e = read(spark, d, "events")
    return e.withColumn("props", F.when(F.col("event_id") % 9 == 0, "{broken").otherwise(F.col("props")))


def j5(spark, d):
    ok, bad = J.intake(_intake(spark, d))
    return ok.select("event_id", F.lit(None).cast("string").alias("reason")).union(bad.select("event_id", "reason"))


def s_text(spark, d):
    """Every third text names an id somewhere inside."""
    i = F.col("doc_id")
    t = F.when(i % 3 == 0, F.concat(F.lower("text"), F.lit(" AB"), i % 1000, F.lit(" y"))).otherwise(F.lower("text"))
    return read(spark, d, "documents").select("doc_id", S.first_structured_id(t).alias("found"), F.sha2(S.normal_title(F.concat(F.lit(" ## "), "text")), 256).alias("title_sha256"), S.token_estimate(F.col("text")).alias("tokens"), S.is_kebab(F.lower("source")).alias("kebab"))


def s_iso(spark, d):
    """Times written and read again, and texts that name a time in other ways or none."""
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    i = F.col("event_id")
    odd = F.when(i % 4 == 0, F.concat(F.substring(S.iso_time(F.col("ts")), 1, 19), F.lit("+02:00"))).when(i % 4 == 1, F.concat(F.substring(S.iso_time(F.col("ts")), 1, 10))).when(i % 4 == 2, "yesterday").otherwise(F.concat(F.substring(S.iso_time(F.col("ts")), 1, 16), F.lit("Z")))
    return e.select("event_id", S.iso_time(F.col("ts")).alias("iso"), F.unix_micros(S.parsed_time(S.iso_time(F.col("ts")))).alias("again"), F.unix_micros(S.parsed_time(odd)).alias("odd"))


def s_window(spark, d):
    e = read(spark, d, "events")
    w = F.concat(F.col("event_id") % 9, F.when(F.col("event_id") % 3 == 0, "d").when(F.col("event_id") % 3 == 1, "h").otherwise("x"))
    return e.select("event_id", F.coalesce(S.window_hours(w), F.lit(-1)).alias("hours"), S.video_id(F.concat(F.when(F.col("event_id") % 2 == 0, "https://v.example/watch?v=").otherwise("https://youtu.be/"), F.substring(F.md5(F.col("event_id").cast("string")), 1, 11), F.lit("&t=1"))).alias("video"), F.round(S.squash(F.col("value") / 100), 6).alias("squashed"))


def s_vector(spark, d):
    e = read(spark, d, "embeddings")
    f = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    x = e.join(f, "vec_id")
    return x.select("vec_id", F.round(S.cosine_similarity(F.col("embedding"), F.col("other")), 6).alias("similarity"))


def b7(spark, d):
    """Rows of three windows, read as texts."""
    out = None
    for w in ("7d", "36h", " 2d "):
        x = read_window(query_log(spark, d), w, F.lit("2024-01-30").cast("timestamp")).groupBy("surface").agg(F.count("*").alias("n")).withColumn("window", F.lit(w))
        out = x if out is None else out.unionByName(x)
    return out


QUERIES = {
    "b7_time_window": b7, "i1_deleted_files": i1, "i2_orphan_sections": i2, "i3_orphan_chunks": i3, "i4_dangling_edges": i4, "i5_model_mismatch": i5, "i6_synthetic": i6, "i7_ceiling": i7, "i8_drift_report": i8, "i9_staleness": i9,
    "i10_repair": i10, "i10_cut_edges": i10_cut, "i11_health": i11, "j1_run_status": j1, "j2_active_runs": j2, "j3_node_rows": j3, "j4_failure_marker": j4, "j5_intake": j5, "s_text": s_text, "s_iso": s_iso, "s_window": s_window, "s_vector": s_vector,
    "t1_intake_stream": feeds.t1, "t2_status_stream": feeds.t2, "t3_ingest_stream": feeds.t3, "t4_memory_stream": feeds.t4, "t5_session_stream": feeds.t5, "t6_abstain_stream": feeds.t6,
}
_CONTENT = "content as (select conv_id as doc_id, turn as position, case when conv_id % 4 <> 0 then 'm1' end as embedding_model from conversations where turn <> 0 or conv_id % 9 <> 0)"
_I1 = "del as (select distinct file_path as path from chunks where client_slug is null and file_path not in (select path from times))"
_I2 = "orph as (select distinct file_path as path, section from chunks where client_slug is null and section = 's3' and file_path <> 'docs/f5.md')"
_I4 = "dang as (select source_id, to_ref from edges where target_id is null or target_id not in (select doc_id from chunks))"
_STATUS = """nn as (select run_id, count(*) as n, bool_or(status = 'failed') as failed, bool_or(status = 'running') as running from nodes group by run_id),
st as (select r.run_id, case when no_nodes and not cancelled and not halted and not failure and not completion then 'queued' when cancelled then 'cancelled' when halted then 'halted'
  when failure or coalesce(failed, false) then 'failed' when completion then 'succeeded' when n is null then 'running' when running then 'running' else 'succeeded' end as status
  from runs r left join nn on nn.run_id = r.run_id)"""
ORACLE_SQL = {
    "b7_time_window": sql("query_log", "w(\"window\", since) as (values ('7d', timestamp '2024-01-23'), ('36h', timestamp '2024-01-28 12:00:00'), (' 2d ', timestamp '2024-01-28')) select \"window\", surface, count(*) as n from query_log, w where created_at >= since group by all"),
    "i1_deleted_files": sql("chunks", _TIMES + ", " + _I1 + " select path from del"),
    "i2_orphan_sections": sql("chunks", _I2 + " select * from orph"),
    "i3_orphan_chunks": "with " + _CONTENT + " select doc_id from content group by doc_id having count(*) filter (position = 0) = 0",
    "i4_dangling_edges": sql("chunks edges", _I4 + " select * from dang"),
    "i5_model_mismatch": sql("chunks", _CONTENT + " select 'index' as \"table\", count(*) filter (embedding_model <> 'm1') as mismatched, count(*) filter (embedding_model is null) as unstamped from chunks union all select 'content', count(*) filter (embedding_model <> 'm1'), count(*) filter (embedding_model is null) from content"),
    "i6_synthetic": sql("chunks", "select count(*) as n, epoch_us(min(authored_at)) as first, epoch_us(max(authored_at)) as last from chunks where id % 6 = 0"),
    "i7_ceiling": "with " + _FILES + " select case when doc_id % 7 = 3 then 'underscore' when doc_id % 7 = 4 then 'skip_dir' when doc_id % 7 = 5 then 'hidden' when doc_id % 10 = 0 then 'unparseable' else 'no_rows' end as reason, count(*) as n from files where doc_id % 7 in (3, 4, 5) or doc_id % 10 = 0 or doc_id % 3 <> 0 group by 1",
    "i8_drift_report": sql("chunks edges", _TIMES + ", " + _I1 + ", " + _I2 + ", " + _I4 + ", " + _CONTENT + """ select 'deleted' as axis, path as key, '' as detail from del union all select 'section', path, section from orph union all select 'dangling', source_id, to_ref from dang
  union all select 'orphan_chunk', doc_id::varchar, '' from content group by doc_id having count(*) filter (position = 0) = 0 union all select 'model', 'index', (count(*))::varchar from chunks where embedding_model <> 'm1' having count(*) > 0"""),
    "i9_staleness": sql("chunks", _TIMES + " select path from times left join (select file_path as path, max(indexed_at) as newest from chunks group by 1) using (path) where newest is null or mtime > newest"),
    "i10_repair": sql("chunks edges", _TIMES + ", " + _I1 + ", " + _I2 + ", " + _I4 + ", " + _CONTENT + """, left_ as (select * from chunks where client_slug is not null or file_path not in (select path from del)),
fresh as (select source_id, to_ref, case when i % 22 <> 0 then to_ref end as target_id from (select *, substr(source_id, 2)::bigint as i from edges) where i % 30 <> 0),
found as (
  select 1 as seen, 'deleted' as axis, path as key, '' as detail from del
  union all select 1, 'section', path, section from orph union all select 2, 'section', path, section from orph where path not in (select path from del) or exists (select 1 from left_ l where l.file_path = orph.path and l.section = orph.section and l.client_slug is null)
  union all select distinct 1, 'dangling', source_id, to_ref from dang
  union all select distinct 2, 'dangling', source_id, to_ref from fresh where target_id is null or target_id not in (select doc_id from left_)
  union all select 1, 'orphan_chunk', doc_id::varchar, '' from content group by doc_id having count(*) filter (position = 0) = 0
  union all select 1, 'model', 'index', (count(*))::varchar from chunks where embedding_model <> 'm1' having count(*) > 0
  union all select 2, 'model', 'index', (count(*))::varchar from left_ where embedding_model <> 'm1' having count(*) > 0)
select axis, key, detail, case when sum(seen) = 1 then 'repaired' when sum(seen) = 2 then 'new' when axis in ('deleted', 'orphan_chunk', 'dangling') then 'left' else 'manual' end as outcome from (select distinct * from found) group by axis, key, detail"""),
    "i10_cut_edges": sql("chunks edges", _TIMES + ", " + _I1 + """, left_ as (select * from chunks where client_slug is not null or file_path not in (select path from del))
select source_id, to_ref, case when target_id in (select doc_id from left_) then target_id end as target_id from edges"""),
    "i11_health": sql("chunks edges", "select count(distinct doc_id) as documents, count(*) as chunks, epoch_us(max(indexed_at)) as newest, (select count(*) from edges) as edges, false as edges_missing from chunks"),
    "j1_run_status": sql("runs", _STATUS + " select run_id, status from st"),
    "j2_active_runs": sql("runs", "select run_id from runs r where run_id % 10 <= 1 or exists (select 1 from nodes n where n.run_id = r.run_id and status = 'running')"),
    "j3_node_rows": sql("runs", "select run_id, node, status, round((epoch_us(completed_at) - epoch_us(started_at)) / 1000000, 6) as seconds, case when status = 'failed' then 'failed: ' || node end as error, node as input, case when status <> 'running' then length(node) end as input_tokens, case when status <> 'running' then 7 end as output_tokens, case when status <> 'running' then 'm1' end as model from nodes"),
    "j4_failure_marker": "select event_id, 'event ' || event_id as failure, event_type as kind from events",
    "j5_intake": "select event_id, case when event_type = 'error' then 'unknown_type' when event_id % 9 = 0 then 'bad_payload' end as reason from events",
    "s_text": r"select doc_id, case when doc_id % 3 = 0 then 'AB' || (doc_id % 1000) end as found, sha256(lower(regexp_replace(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '^#+', ''), '\s+', ' ', 'g'))) as title_sha256, greatest(1, length(text) // 4) as tokens, regexp_matches(lower(source), '^[a-z0-9]+(-[a-z0-9]+)*$') as kebab from documents",
    "s_iso": """select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' as iso, epoch_us(ts) as again,
  case event_id % 4 when 0 then epoch_us(date_trunc('second', ts)) - 7200000000 when 1 then epoch_us(date_trunc('day', ts)) when 3 then epoch_us(date_trunc('minute', ts)) end as odd from (select event_id, ts::timestamp as ts from events)""",
    "s_window": "select event_id, case event_id % 3 when 0 then (event_id % 9) * 24 when 1 then event_id % 9 else -1 end as hours, substr(md5(event_id::varchar), 1, 11) as video, round(1 / (1 + exp(-value / 100)), 6) as squashed from events",
    "s_vector": "select a.vec_id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) as similarity from (select vec_id, embedding::double[] as e from embeddings) a join (select vec_id + 1 as vec_id, embedding::double[] as e from embeddings) b using (vec_id)",
    "t1_intake_stream": "select event_id, case when event_type = 'error' then 'unknown_type' when event_id % 9 = 0 then 'bad_payload' end as reason from events",
    "t6_abstain_stream": sql("query_log", "select epoch_us(time_bucket(interval '1 day', created_at)) as day, count(*) as n, round(avg(abstained::int), 6) as rate from query_log group by 1 having max(time_bucket(interval '1 day', created_at)) + interval '1 day' <= (select max(created_at) from query_log) - interval '2 days'"),
    "t2_status_stream": """with l as (select user_id as run_id, max_by(event_id, (ts, event_id)) as i from events group by user_id)
select run_id, case when i % 13 = 2 then 'cancelled' when i % 17 = 3 then 'halted' when i % 7 = 0 then 'failed' when i % 5 = 0 then 'running' else 'succeeded' end as status from l""",
    "t4_memory_stream": "select 'p' || (conv_id % 50) as peer_id, count(*) as episodes, count(*) as facts, sum(length(text))::bigint as characters, max(conv_id * 60 + turn) * 1000000 as updated_at from conversations group by 1",
    "t5_session_stream": """with f as (select conv_id, split_part(text, ' ', 1) as w, min(turn) as t from conversations group by all)
select conv_id as session, count(*) as turns, max(turn) as last, sha256(string_agg(text, chr(10) order by turn)) as content_sha256, any_value(topics) as topics from conversations join (select conv_id, string_agg(w, ',' order by t) as topics from f group by conv_id) using (conv_id) group by conv_id""",
}
