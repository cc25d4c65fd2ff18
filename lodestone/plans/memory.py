"""Queries over graph, grounding, memory and query-log operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import graph, grounding, memory, query_log
from .stores import fact_index
from .views import BASE, base, chunks, edges, episodes, facts, golden, markdown, query_log as log_view, read, recall_queries, sql

_STOP = ", ".join("'" + w + "'" for w in S.STOP_WORDS)


def _words(x: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({x}, '[a-zA-Z'']+'), lambda w: lower(w)), lambda w: length(w) > 2 and w not in ({_STOP})))"


def d1(spark, d):
    roots = read(spark, d, "documents").where("doc_id % 50 = 0").select(F.concat(F.lit("d"), "doc_id").alias("root"))
    return graph.walk(roots, edges(spark, d), 3)


def d2(spark, d):
    nodes = read(spark, d, "documents").where("doc_id % 3 <> 0").select(F.concat(F.lit("d"), "doc_id").alias("node_id"))
    kept, skipped = graph.load_edges(edges(spark, d), nodes)
    return kept.withColumn("kept", F.lit(True)).union(skipped.withColumn("kept", F.lit(False)))


def d3(spark, d):
    known = read(spark, d, "documents").select((F.col("doc_id") % 20).alias("qid"), F.concat(F.lit("d"), "doc_id").alias("doc_id"))
    return graph.neighbours(known, edges(spark, d))


def _answers(spark, d):
    """One answer a conversation: its first assistant turn, citing the sections s0, s1 and a missing one."""
    c = read(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("answer"))
    return c.select(F.col("conv_id").alias("answer_id"), "answer", F.array(F.lit("# S0 "), F.lit("s1"), F.lit("gone")).alias("cited_sections"), (F.col("conv_id") % 2 == 0).alias("high_stakes"))


def _evidence(spark, d):
    """Chunks for each answer: the turns of its conversation."""
    c = read(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("rank"), F.concat(F.lit("S"), F.col("turn") % 3).alias("section_title"), F.col("text").alias("content"), F.concat(F.lit("f"), F.col("turn") % 2).alias("file_path"))


_ANSWERS = """answers as (select conv_id as answer_id, min_by(text, turn) as answer, ['s0', 's1', 'gone'] as keys, conv_id % 2 = 0 as high_stakes from conversations where role = 'assistant' group by conv_id),
ev as (select conv_id as answer_id, turn as rank, 's' || (turn % 3) as key, text as content, 'f' || (turn % 2) as file_path from conversations),
last as (select answer_id, key, max_by(content, rank) as content, max_by(file_path, rank) as file_path from ev group by all),
cited as (select answer_id, answer, unnest(range(3)) as place, unnest(keys) as key from answers)"""
_CHECKS = _ANSWERS + f""",
w as (select c.answer_id, c.place, l.file_path, l.content, {_words('answer')} as a, {_words('l.content')} as b from cited c left join last l using (answer_id, key)),
checks as (select answer_id, place, file_path, content, case when content is not null and len(a) > 0 then len(list_intersect(a, b))::double / len(a) else 0 end as support from w)"""


def e4(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(S.content_words(F.col("text"))).alias("n_words"))


def e5(spark, d):
    s = S.sentences(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(s).alias("n_sentences"), F.get(s, F.lit(0)).alias("first"))


def e7(spark, d):
    c = grounding.check_citations(_answers(spark, d), _evidence(spark, d))
    return c.select("answer_id", "place", "file_path", F.round("support", 6).alias("support"), "verified", "reason")


def e8(spark, d):
    a, v = _answers(spark, d), _evidence(spark, d)
    e = grounding.envelope(a, grounding.check_citations(a, v), v.groupBy("answer_id").agg(F.count("*").alias("n_chunks")))
    return e.withColumn("chosen", grounding.best_envelope(F.when(F.col("verified") > 0, "verified"), F.when(F.col("cited") > 1, "answered"), F.lit("abstained")))


def e1(spark, d):
    q = read(spark, d, "events").select(F.col("event_id").alias("qid"), "value")
    conf = q.where("qid % 8 <> 0").select("qid", (F.col("value") / (F.col("value") + 10)).alias("confidence"))
    return grounding.abstain_gate(q, conf, q.where("qid % 6 <> 0").select("qid", F.lit(3).alias("n")))


def e3(spark, d):
    c = read(spark, d, "conversations")
    rows = c.select(F.col("conv_id").alias("qid"), F.col("turn").alias("rank"), F.when(F.col("turn") % 3 != 0, F.col("role")).alias("title"), ((F.col("turn") + 1) / 7).alias("score"), F.col("text").alias("content"))
    return grounding.context_block(rows).select("qid", F.sha2("context", 256).alias("context_sha256"))


def e9(spark, d):
    c = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    turns = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    c = c.select("conv_id", grounding.append_turns(turns, F.lit("more"), F.lit("ok")).alias("turns"), grounding.add_topics(F.array_distinct(F.transform("t", lambda x: x["role"])), F.array(F.lit("user"), F.lit("new"), F.lit("new"))).alias("topics"))
    return c.select("conv_id", F.size("turns").alias("n_turns"), F.element_at("turns", -1)["content"].alias("last"), F.array_join("topics", ",").alias("topics"))


def f1(spark, d):
    f = memory.effective(facts(spark, d), base())
    return f.select("fact_id", "weeks", F.round("effective", 6).alias("effective"))


def f3(spark, d):
    e = episodes(spark, d)
    half = F.col("session_id") % 2 == 0
    peers = e.where(half).groupBy("workspace_id", "peer_id").agg(F.min("occurred_at").alias("updated_at"))
    out = memory.upsert_peers(peers, e.select("workspace_id", "peer_id", F.col("occurred_at").alias("updated_at")))
    return out.select("workspace_id", "peer_id", F.unix_micros("updated_at").alias("updated_at"))


def f5(spark, d):
    n = facts(spark, d).select("fact_id", F.when(F.col("fact_id") % 2 == 0, F.col("confidence")).alias("confidence"), F.lit(None).cast("double").alias("decay_factor"), F.when(F.col("fact_id") % 3 == 0, F.array(F.lit("own"))).otherwise(F.array().cast("array<string>")).alias("evidence"))
    out = memory.insert_facts(n, F.array(F.lit("batch")))
    return out.select("fact_id", "confidence", "decay_factor", F.array_join("evidence", ",").alias("evidence"))


def f6(spark, d):
    f = facts(spark, d)
    hits = f.where("fact_id % 4 = 0").select("fact_id").union(f.where("fact_id % 8 = 0").select("fact_id")).union(f.limit(1).select(F.lit(-5).cast("long")))
    out = memory.contradict(f, hits, base())
    return out.select("fact_id", F.round("confidence", 6).alias("confidence"), F.unix_micros("updated_at").alias("updated_at"))


def _ranked(spark, d, as_of, vectors=None):
    q = recall_queries(spark, d).withColumnRenamed("qproject", "workspace_id")
    return memory.rank_facts(q, facts(spark, d), 5, as_of, vectors=vectors).select("qid", F.col("id").alias("fact_id"), F.round("score", 6).alias("score"), "rn")


def f7(spark, d):
    return _ranked(spark, d, None, fact_index(spark, d))


def f8_index(spark, d):
    """f8 by the lists of the stored index."""
    return _ranked(spark, d, base(), fact_index(spark, d))


def f8(spark, d):
    return _ranked(spark, d, base())


_RANK = """fsim as (select qid, fact_id, list_dot_product(qvec, embedding) / (sqrt(list_dot_product(qvec, qvec)) * sqrt(list_dot_product(embedding, embedding))) as s from q join (select * from facts where embedding is not null) on workspace_id = qproject),
sim as (select qid, fact_id, coalesce(s, 0) * {w} as score from q join facts on workspace_id = qproject left join fsim using (qid, fact_id))
select qid, fact_id, round(score, 6) as score, rn from (select *, row_number() over (partition by qid order by score desc, fact_id) as rn from sim) where rn <= 5"""
_WEEKS = f"greatest(0, floor((epoch_us(timestamp '{BASE}') - epoch_us(updated_at))::double / 604800000000))"


def f9(spark, d):
    return memory.recent_episodes(episodes(spark, d), 3).select("peer_id", "episode_id", "rn")


def f10(spark, d):
    return memory.context_budget(episodes(spark, d), "peer_id", "summary")


def a22(spark, d):
    """A payload for every hundred documents, written as JSON and read again; some edges have no source, some payloads a fault."""
    import uuid

    from ..sources.shared import shared_dir

    i = F.col("doc_id")
    node = F.struct(F.concat(F.lit("n"), i).alias("id"), F.concat(F.lit("d"), i).alias("doc_id"), F.col("lang").alias("scope"))
    edge = F.struct(F.concat(F.when(i % 5 == 0, "x").otherwise("n"), i).alias("from"), F.concat(F.lit("d"), i + 1).alias("to_ref"), F.when(i % 3 != 0, F.concat(F.lit("n"), i + 1)).alias("target_node_id"), F.when(i % 3 != 0, F.concat(F.lit("d"), i + 1)).alias("target_doc_id"), F.when(i % 2 == 0, "cites").alias("kind"))
    g = F.floor(i / 100)
    p = read(spark, d, "documents").groupBy(g.alias("g")).agg(F.collect_list(node).alias("nodes"), F.collect_list(edge).alias("edges"))
    p = p.select(F.when(F.col("g") % 4 == 3, "1").otherwise("2").alias("version"), "nodes", F.when(F.col("g") % 7 != 6, F.col("edges")).alias("edges"))
    path = f"{shared_dir(spark)}/payload-{uuid.uuid4().hex}"
    p.write.json(path)
    rows, skipped, rejected = graph.edge_rows(graph.read_payloads(spark, path))
    out = rows.select("source_node_id", "source_doc_id", "to_ref", "target_node_id", "target_doc_id", "kind", "scope", F.lit(None).cast("string").alias("fault"))
    none = lambda c: F.lit(None).cast("string").alias(c)
    out = out.union(skipped.select("from", none("source_doc_id"), "to_ref", "target_node_id", "target_doc_id", "kind", none("scope"), F.lit("skipped")))
    return out.union(rejected.select(*[none(c) for c in out.columns[:-1]], "fault"))


def f11(spark, d):
    e, f = episodes(spark, d), facts(spark, d).select(F.concat(F.lit("p"), F.col("fact_id") % 60).alias("peer_id"), "fact_id", "fact")
    peers = e.select("peer_id").distinct().withColumn("representation", F.concat(F.lit("about "), "peer_id"))
    out = memory.consolidation_context(peers, e, f, F.lit("2024-06-05 00:00:00").cast("timestamp"))
    return out.select("peer_id", "representation", "kind", "id", F.unix_micros("at").alias("at"), F.sha2("text", 256).alias("text_sha256"))


def f12(spark, d):
    """Facts of every third document contradict one of their peer's; ids that are no uuid count as none."""
    f = facts(spark, d).withColumn("fact_id", F.format_string("00000000-0000-4000-8000-%012d", "fact_id"))
    peers = f.select("peer_id").distinct().withColumn("representation", F.lit("old"))
    r = f.select("peer_id", F.lit("new").alias("fact"), F.when(F.substring("fact_id", 36, 1) == "3", F.col("fact_id")).otherwise("none").alias("contradicts"), F.lit("fresh").alias("representation"))
    p, old, new = memory.consolidation_apply(peers, f, r, base())
    return old.groupBy("peer_id").agg(F.round(F.sum("confidence"), 6).alias("confidence")).join(p, "peer_id").join(new.groupBy("peer_id").agg(F.count("*").alias("new")), "peer_id").select("peer_id", "confidence", "representation", "new")


def f13(spark, d):
    e = episodes(spark, d).withColumn("facts", F.filter(S.sentences(F.col("summary")), lambda s: F.length(s) > 40))
    _, f = memory.interaction_rows(e)
    return f.select("peer_id", F.get("evidence", F.lit(0)).alias("evidence"), F.sha2("fact", 256).alias("fact_sha256"), "confidence", "decay_factor")


def f4(spark, d):
    """Episodes as they are appended, with tags and vectors; every third turn tells no time."""
    i = F.col("turn")
    e = episodes(spark, d).withColumns({"occurred_at": F.when(i % 3 != 0, F.col("occurred_at")), "tags": F.array("role", F.concat(F.lit("t"), i)), "embedding": F.array(F.length("summary").cast("float"), i.cast("float")), "facts": F.array().cast("array<string>")})
    rows, _ = memory.interaction_rows(e, base())
    return rows.select("episode_id", "peer_id", F.sha2("summary", 256).alias("summary_sha256"), F.unix_micros("occurred_at").alias("occurred_at"), F.array_join("tags", ",").alias("tags"), F.get("embedding", F.lit(0)).cast("long").alias("first"))


def g1(spark, d):
    from .retrieval import _hybrid
    from ..operators.retrieval import confidence

    q, r = _hybrid(spark, d)
    x = query_log.log_rows(q, r, confidence(q, r))
    return x.select("qid", "query", "result_count", F.round("top_score", 6).alias("top_score"), F.array_join("top_doc_ids", ",").alias("top_doc_ids"), F.coalesce(F.try_element_at("via_mix", F.lit("keyword")), F.lit(0)).alias("n_keyword"), "abstained", "surface")


def g2(spark, d):
    x = query_log.read_log(log_view(spark, d), F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return query_log.abstain_rate(x).select("n", F.round("rate", 6).alias("rate"))


def _mined(spark, d):
    return query_log.mined(log_view(spark, d), golden(spark, d))


def g3(spark, d):
    return _mined(spark, d).select("query", "n", F.round("confidence", 6).alias("confidence"), F.unix_micros("last_seen").alias("last_seen"), F.col("latest.id").alias("latest_id"))


def g5(spark, d):
    return query_log.low_threshold(_mined(spark, d)).select(F.round("low", 6).alias("low"))


def g6(spark, d):
    return query_log.ranked(query_log.classified(_mined(spark, d))).select("query", "n", "reason", "place")


def g8(spark, d):
    return query_log.draft_cases(query_log.classified(_mined(spark, d))).select("case_id", "query", F.size("expect_docs").alias("n_expected"), "expect_abstain", "source")


def g9(spark, d):
    _, counts = query_log.retained(log_view(spark, d), F.lit("2024-02-01 00:00:00").cast("timestamp"), query_log.keep_days("15"))
    return counts


_MINED = """m as (select query, count(*) as n, avg(confidence) as confidence, max(created_at) as last_seen, max_by(id, (created_at, id)) as latest_id from query_log where (surface is null or surface <> 'eval') group by query having count(*) >= 2),
latest as (select m.*, l.abstained, l.top_scores, l.via_keyword, l.via_semantic from m join query_log l on l.id = m.latest_id),
low as (select case when count(*) < 4 then min(confidence) else quantile_cont(confidence, 0.25) end as low from latest where not abstained),
cls as (select *, case when abstained then 'abstained' when confidence <= low then 'low_confidence'
  when round(top_scores[1] - top_scores[2], 9) <= 0.05 or (via_keyword + via_semantic > 0 and via_keyword::double / (via_keyword + via_semantic) >= 0.5) then 'suspect' end as reason from latest, low)"""

QUERIES = {
    "d1_walk": d1, "d2_edge_load": d2, "d3_neighbours": d3, "e1_abstain_gate": e1, "e3_context_block": e3, "e4_content_words": e4, "e5_sentences": e5, "e7_citations": e7, "e8_envelope": e8, "e9_session_update": e9,
    "f1_decay": f1, "f3_peer_upsert": f3, "f4_episode_append": f4, "f5_fact_insert": f5, "f6_contradiction": f6, "f7_rank_facts": f7, "f8_rank_decayed": f8, "f8_indexed": f8_index, "f9_recent_episodes": f9, "f10_budget": f10, "f11_consolidation_context": f11, "a22_edge_payload": a22, "f12_consolidation_apply": f12, "f13_interactions": f13,
    "g1_log_rows": g1, "g2_abstain_rate": g2, "g3_mining": g3, "g5_low_threshold": g5, "g6_classification": g6, "g8_draft_cases": g8, "g9_retention": g9,
}
from .retrieval import _CTE, _V  # noqa: E402

ORACLE_SQL = {
    "d1_walk": sql("edges", """hop(root, node, level) as (select 'd' || doc_id, 'd' || doc_id, 0 from documents where doc_id % 50 = 0
  union select root, target_id, level + 1 from hop join edges on source_id = node where level < 3 and target_id is not null)
select root, node, min(level) as level from hop group by all"""),
    "d2_edge_load": sql("edges", "select *, substr(source_id, 2)::bigint % 3 <> 0 as kept from edges"),
    "d3_neighbours": sql("edges", "known as (select doc_id % 20 as qid, 'd' || doc_id as doc_id from documents) select distinct qid, target_id as doc_id from known join edges on source_id = doc_id where target_id is not null and not exists (select 1 from known k where k.qid = known.qid and k.doc_id = target_id)"),
    "e1_abstain_gate": """select qid, none or low as abstain, case when none then 'no_chunks' when low then 'low_confidence' end as reason, case when none or low then 'I don''t have that in my documents.' end as message
from (select event_id as qid, event_id % 6 = 0 as none, coalesce(case when event_id % 8 <> 0 then value / (value + 10) end, 0) < 0.6552::double as low from events)""",
    "e3_context_block": """select conv_id as qid, sha256(string_agg('Section: ' || case when turn % 3 <> 0 then role else 'General' end || ' (relevance: ' || printf('%.2f', (turn + 1)::double / 7) || ')' || chr(10) || text, chr(10) || chr(10) order by turn)) as context_sha256 from conversations group by conv_id""",
    "e4_content_words": f"select doc_id, len({_words('text')}) as n_words from documents",
    "e5_sentences": r"""select doc_id, len(s) as n_sentences, s[1] as first from (select doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as s from documents)""",
    "e7_citations": "with " + _CHECKS + " select answer_id, place, file_path, round(support, 6) as support, content is not null and support >= 0.3 as verified, case when content is null then 'not_found' when support < 0.3 then 'unsupported' end as reason from checks",
    "e8_envelope": "with " + _CHECKS + """, v as (select answer_id, count(*) filter (content is not null and support >= 0.3) as verified, count(*) as cited, count(distinct case when content is not null and support >= 0.3 then file_path end) as files from checks group by answer_id)
select answer_id, verified, cited, cited > 0 and verified = 0 as withheld, files >= 2 as corroborated, high_stakes and files < 2 as escalate, case when verified > 0 then 'verified' when cited > 1 then 'answered' else 'abstained' end as chosen from answers join v using (answer_id)""",
    "e9_session_update": """select conv_id, count(*) + 2 as n_turns, 'ok' as last, array_to_string(list_concat(list_distinct_in_order, list_filter(['user', 'new', 'new'], lambda t: not list_contains(list_distinct_in_order, t))), ',') as topics
from (select conv_id, turn, list(role) over (partition by conv_id) as x from conversations) join (select conv_id, list(role order by first) as list_distinct_in_order from (select conv_id, role, min(turn) as first from conversations group by all) group by conv_id) using (conv_id) group by conv_id, list_distinct_in_order""",
    "f1_decay": sql("facts", f"select fact_id, {_WEEKS}::int as weeks, round(confidence * power(0.95::double, {_WEEKS}), 6) as effective from facts"),
    "f3_peer_upsert": sql("episodes", "select workspace_id, peer_id, epoch_us(max(occurred_at)) as updated_at from episodes group by all"),
    "f5_fact_insert": sql("facts", "select fact_id, case when fact_id % 2 = 0 then confidence else 0.9::double end as confidence, 0.95::double as decay_factor, case when fact_id % 3 = 0 then 'own' else 'batch' end as evidence from facts"),
    "f6_contradiction": sql("facts", f"select fact_id, round(case when fact_id % 4 = 0 then confidence * power(0.95::double, {_WEEKS}) * case when fact_id % 8 = 0 then 0.25::double else 0.5::double end else confidence end, 6) as confidence, epoch_us(case when fact_id % 4 = 0 then timestamp '{BASE}' else updated_at end) as updated_at from facts"),
    "f7_rank_facts": sql("chunks q facts", _RANK.format(w="1")),
    "f8_rank_decayed": sql("chunks q facts", _RANK.format(w=f"confidence * power(0.95::double, {_WEEKS})")),
    "f8_indexed": sql("chunks q facts", _RANK.format(w=f"confidence * power(0.95::double, {_WEEKS})")),
    "f9_recent_episodes": sql("episodes", "select peer_id, episode_id, rn from (select *, row_number() over (partition by peer_id order by occurred_at desc, episode_id desc) as rn from episodes) where rn <= 3"),
    "f10_budget": sql("episodes", "select peer_id, sum(greatest(1, length(summary) // 4))::bigint as tokens, sum(greatest(1, length(summary) // 4)) > 800 as over_budget from episodes group by peer_id"),
    "a22_edge_payload": """with g as (select doc_id as i, lang, doc_id // 100 as g from documents), ok as (select * from g where g % 4 <> 3 and g % 7 <> 6)
select case when i % 5 = 0 then 'x' else 'n' end || i as source_node_id, case when i % 5 <> 0 then 'd' || i end as source_doc_id, 'd' || (i + 1) as to_ref, case when i % 3 <> 0 then 'n' || (i + 1) end as target_node_id, case when i % 3 <> 0 then 'd' || (i + 1) end as target_doc_id,
  case when i % 2 = 0 then 'cites' when i % 5 <> 0 then 'related' end as kind, case when i % 5 <> 0 then lang end as scope, case when i % 5 = 0 then 'skipped' end as fault from ok
union all select null, null, null, null, null, null, null, case when g % 7 = 6 then 'missing edges' else 'version 1' end from (select distinct g from g where g % 4 = 3 or g % 7 = 6)""",
    "f11_consolidation_context": sql("episodes facts", """x as (select peer_id, 'episode' as kind, episode_id as id, epoch_us(occurred_at) as "at", summary as text from episodes where occurred_at >= timestamp '2024-06-05'
  union all select 'p' || (fact_id % 60), 'fact', fact_id, null, fact from facts)
select peer_id, 'about ' || peer_id as representation, kind, id, "at", sha256(text) as text_sha256 from (select distinct peer_id from episodes) left join x using (peer_id)"""),
    "f12_consolidation_apply": sql("facts", f"select peer_id, round(sum(case when fact_id % 10 = 3 then confidence * power(0.95::double, {_WEEKS}) * 0.5::double else confidence end), 6) as confidence, 'fresh' as representation, count(*) as new from facts group by peer_id"),
    "f13_interactions": sql("episodes", r"""s as (select peer_id, episode_id, unnest(list_filter(string_split(regexp_replace(regexp_replace(summary, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 40)) as fact from episodes)
select peer_id, episode_id as evidence, sha256(fact) as fact_sha256, 0.9::double as confidence, 0.95::double as decay_factor from s"""),
    "f4_episode_append": sql("episodes", f"""select episode_id, peer_id, sha256(summary) as summary_sha256, epoch_us(case when turn % 3 <> 0 then occurred_at else timestamp '{BASE}' end) as occurred_at, role || ',t' || turn as tags, length(summary) as first from episodes"""),
    "g1_log_rows": sql(_V, _CTE + """select q.qid, query, count(f.id) as result_count, round(max(f.score) filter (f.rank = 1), 6) as top_score, string_agg(f.doc_id, ',' order by f.rank) filter (f.rank <= 5) as top_doc_ids, count(*) filter (f.via = 'keyword') as n_keyword,
  max(confidence) < 0.6552::double as abstained, 'unknown' as surface from q left join final f using (qid) join conf using (qid) group by q.qid, query"""),
    "g2_abstain_rate": sql("query_log", "select count(*) as n, round(avg(abstained::int), 6) as rate from query_log where created_at >= timestamp '2024-01-20'"),
    "g3_mining": sql("query_log", _MINED + " select query, n, round(confidence, 6) as confidence, epoch_us(last_seen) as last_seen, latest_id from m"),
    "g5_low_threshold": sql("query_log", _MINED + " select round(low, 6) as low from low"),
    "g6_classification": sql("query_log", _MINED + " select query, n, reason, row_number() over (partition by reason order by n desc, last_seen desc, query) as place from cls where reason is not null"),
    "g8_draft_cases": sql("query_log", _MINED + " select 'mined-' || latest_id as case_id, query, 0 as n_expected, reason = 'abstained' as expect_abstain, 'mined' as source from cls where reason is not null"),
    "g9_retention": sql("query_log", "select count(*) filter (created_at < timestamp '2024-01-17') as deleted, count(*) filter (created_at >= timestamp '2024-01-17') as kept from query_log"),
}
