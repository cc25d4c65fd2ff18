"""Queries over the retrieval operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators.text_index import TextIndex
from ..sources.shared import shared_dir
from .stores import indexes, text_index, vector_index
from .views import BASE, base, chunks, edges, facts, recall_queries, sql, texts

_STOP = ", ".join(f"'{w}'" for w in R.STOPPED)
_LIVE = "status is null or status <> 'archived'"
_CTE = f"""
live as (select * from chunks where {_LIVE}),
dist as (select qid, id, doc_id, 1 - list_dot_product(qvec, embedding) / (sqrt(list_dot_product(qvec, qvec)) * sqrt(list_dot_product(embedding, embedding))) as distance from q, live where embedding is not null),
sem as (select * from (select *, row_number() over (partition by qid order by distance, id) as rn from dist) where rn <= {R.SEMANTIC}),
target as (select distinct s.qid, e.target_id as doc_id from sem s join edges e on e.source_id = s.doc_id where s.rn <= {R.SEEDS} and e.target_id is not null),
struct_ as (select d.* from dist d join target t on d.qid = t.qid and d.doc_id = t.doc_id where not exists (select 1 from sem s where s.qid = t.qid and s.doc_id = t.doc_id)),
term as (select distinct qid, t as term from (select qid, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) as t from q) where t not in ({_STOP})),
post as (
  select id, t as term, sum(w) as s from (
    select id, unnest(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+')) as t, 1.0::double as w from live
    union all select id, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')), 0.2::double from live)
  where t not in ({_STOP}) group by all),
krank as (
  select qid, id, sum(s / (s + 1)) / n as rank from term join post using (term) join (select qid, count(*) as n from term group by qid) using (qid)
  group by qid, id, n having count(*) = n),
kw as (
  select * from (select k.*, row_number() over (partition by qid order by rank desc, id) as rn from krank k
    where not exists (select 1 from sem s where s.qid = k.qid and s.id = k.id) and not exists (select 1 from struct_ s where s.qid = k.qid and s.id = k.id)) where rn <= {R.KEYWORD}),
cand as (
  select qid, id, distance, 'semantic' as via from sem union all select qid, id, distance, 'structural' from struct_
  union all select kw.qid, kw.id, dist.distance, 'keyword' from kw join dist using (qid, id)),
fuse as (
  select c.qid, c.id, c.via, c.distance, l.doc_id, l.file_path,
    ((1 - c.distance) + 0.5 * coalesce(k.rank, 0)) * case when authored_at is null then 1.0::double else power(0.99::double, greatest(0, floor(date_diff('day', authored_at, timestamp '{BASE}') / 7))) end as score
  from cand c join live l using (id) left join krank k on k.qid = c.qid and k.id = c.id),
kept as (select *, case when file_path is not null and row_number() over (partition by qid, file_path order by score desc, id) > 2 then 1 else 0 end as over_ from fuse where score >= 0),
final as (select * from (select *, row_number() over (partition by qid order by over_, score desc, id) as rank from kept) where rank <= 10),
conf as (select q.qid, coalesce(1 / (1 + exp(-avg(f.score))), 0) as confidence from q left join final f on f.qid = q.qid and f.rank <= 5 group by q.qid)
"""
# _CTE with ties as the queries have them: s in fifths, whose sum is exact in any order; cosines, ranks and scores at 12 digits, then ids
_TIED = _CTE
for _a, _b in [
    ("1 - list_dot_product(qvec, embedding) / (sqrt(list_dot_product(qvec, qvec)) * sqrt(list_dot_product(embedding, embedding))) as distance", "1 - round(list_dot_product(qvec, embedding) / (sqrt(list_dot_product(qvec, qvec)) * sqrt(list_dot_product(embedding, embedding))), 12) as distance"),
    ("sum(w) as s", "sum(w) / 5 as s"), ("1.0::double as w", "5 as w"), ("'[\\p{L}\\p{N}]+')), 0.2::double", "'[\\p{L}\\p{N}]+')), 1"),
    ("sum(s / (s + 1)) / n as rank", "round(sum(s / (s + 1)) / n, 12) as rank"),
    ("((1 - c.distance) + 0.5", "round(((1 - c.distance) + 0.5"), ("/ 7))) end as score", "/ 7))) end, 12) as score"),
]:
    assert _TIED.count(_a) == 1, _a
    _TIED = _TIED.replace(_a, _b)
_V = "chunks q edges"


def _in(spark, d):
    return recall_queries(spark, d), chunks(spark, d), edges(spark, d)


def c1(spark, d):
    q, c, _ = _in(spark, d)
    return R.semantic(q, c, vectors=vector_index(spark, d), where=R.live).select("qid", "id", F.round("distance", 6).alias("distance"), "rn")


def c2(spark, d):
    q, c, _ = _in(spark, d)
    return R.semantic(q, c, 5, vector_index(spark, d)).select("qid", "id", F.round(1 - F.col("distance"), 6).alias("score"), "rn")


def u1(spark, d):
    """Search of vectors that one model made or that bear no stamp, guarded against any other; a query without direction finds nothing."""
    q, c, _ = _in(spark, d)
    c = R.stamped(R.live(c).where("coalesce(embedding_model, 'm1') = 'm1'"), "m1")
    return R.semantic(q.unionByName(q.limit(1).withColumns({"qid": F.lit(-1).cast(q.schema["qid"].dataType), "qvec": F.transform("qvec", lambda x: F.lit(float("nan")).cast(q.schema["qvec"].dataType.elementType))})), c, 5).select("qid", "id", F.round("distance", 6).alias("distance"), "rn")


def c3(spark, d):
    q, c, e = _in(spark, d)
    c = R.live(c)
    return R.structural(R.semantic(q, c), q, c, e).select("qid", "id", F.round("distance", 6).alias("distance"))


def _postings(spark, d, q, c):
    """Postings of the queries' terms in chunks, by the stored index."""
    found = text_index(spark, d).postings(R.query_terms(q).select("term").distinct(), R.Corpus().fields)
    return found.join(c.select("id"), "id", "left_semi")


def c4(spark, d):
    q, c, e = _in(spark, d)
    c = R.live(c)
    s = R.semantic(q, c)
    present = R.merged(s, R.structural(s, q, c, e))
    k = R.keyword_best(q, _postings(spark, d, q, c), present).where("rn is not null")
    return k.select("qid", "id", F.round("rank", 6).alias("rank"), "rn")


def c5(spark, d):
    q, c, _ = _in(spark, d)
    return R.keyword_rank(q, _postings(spark, d, q, R.live(c))).select("qid", "id", F.round("rank", 6).alias("rank"))


def c6(spark, d):
    return R.flat_matches(recall_queries(spark, d), R.live(texts(spark, d)))


def c8(spark, d):
    q, c, e = _in(spark, d)
    c = R.live(c)
    s = R.semantic(q, c)
    return R.merged(s, R.structural(s, q, c, e)).select("qid", "id", "via", F.round("distance", 6).alias("distance"))


def c14(spark, d):
    return text_index(spark, d).postings().select("id", "term", F.round("s", 6).alias("s"))


def c14_update(spark, d):
    """Files f3 and f5 are replaced: the one's chunks get another title, the other's go; a chunk of a new file comes."""
    c = chunks(spark, d)
    index = TextIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", ("title", "description"))
    index.build(c)
    new = c.where("file_path = 'docs/f3.md'").withColumn("title", F.concat("title", F.lit(" revised "), F.col("id") % 3))
    more = c.where("id % 40 = 7").withColumns({"id": -F.col("id"), "file_path": F.lit("docs/new.md")})
    index.update(spark.createDataFrame([("docs/f3.md",), ("docs/f5.md",), ("docs/new.md",)], "file_path string"), new.unionByName(more))
    return index.postings().select("id", "term", F.round("s", 6).alias("s"))


def _hybrid(spark, d):
    q, c, e = _in(spark, d)
    return q, R.hybrid(q, c, e, base(), **indexes(spark, d))


def c15(spark, d):
    _, r = _hybrid(spark, d)
    return r.select("qid", "id", "doc_id", "file_path", "via", "rank", F.round("score", 6).alias("score"))


def c11(spark, d):
    q, r = _hybrid(spark, d)
    return R.confidence(q, r).select("qid", F.round("confidence", 6).alias("confidence"))


def b3(spark, d):
    q = chunks(spark, d).where("id % 50 = 0").select(F.col("id").alias("qid"), F.concat(F.lit("see F"), F.col("id") % 7).alias("query"))
    return R.exact_id(q, chunks(spark, d)).select("qid", "id", "rn")


def b1(spark, d):
    c = R.filtered(R.live(chunks(spark, d)), {"project": "en", "layer": "src1", "status": None, "colour": "red"})
    return c.select("id", "project", "title", "status")


def _workspace_queries(spark, d):
    return recall_queries(spark, d).withColumnRenamed("qproject", "workspace_id")


def c7(spark, d):
    m = R.memory_candidates(_workspace_queries(spark, d), facts(spark, d), base())
    return m.select("qid", "id", F.round("distance", 6).alias("distance"))


def c12(spark, d):
    """Ids for every second query, the whole pipeline for some, meaning within a project or a workspace's project for others."""
    q, c, e = _in(spark, d)
    i = F.col("qid")
    q = q.withColumn("query", F.when(i % 100 == 0, F.concat(F.lit("see F"), i % 7)).otherwise(F.col("query")))
    q = q.withColumn("mode", F.when(i % 150 == 50, "hybrid").otherwise("auto")).withColumn("scope", R.scoped(F.when(i % 350 == 50, "de"), F.when(i % 250 == 50, F.col("qproject"))))
    return R.recall(q, c, e, base(), **indexes(spark, d)).select("qid", "id", "doc_id", "title", "section", "via", "rn", F.round("score", 6).alias("score"))


def c15_flat(spark, d):
    """A corpus of flat matches, archived chunks included, without graph and decay, above a threshold."""
    q, c, e = _in(spark, d)
    r = R.hybrid(q, c, e, base(), include_archived=True, expand=False, decay=False, threshold=1.1, corpus=R.Corpus(fields=("title",), graded=False), **indexes(spark, d))
    return r.select("qid", "id", "via", "rank", F.round("score", 6).alias("score"))


def c15m(spark, d):
    r = R.hybrid(_workspace_queries(spark, d), chunks(spark, d), edges(spark, d), base(), facts=facts(spark, d), **indexes(spark, d))
    return r.select("qid", "id", "via", "rank", F.round("score", 6).alias("score"))


QUERIES = {
    "c7_memory_candidates": c7, "c12_dispatch": c12, "c15_with_memory": c15m, "c15_flat_corpus": c15_flat,
    "b1_metadata_filters": b1, "b3_exact_lookup": b3, "c1_semantic_candidates": c1, "c2_semantic_search": c2, "c3_structural": c3, "c4_keyword_candidates": c4,
    "c5_keyword_rank": c5, "c6_flat_keyword": c6, "c8_priority_merge": c8, "c11_confidence": c11, "c14_text_index": c14, "c14_index_update": c14_update, "u1_stamp_guard": u1, "c15_hybrid_recall": c15,
}
_tail = lambda body: sql(_V, _CTE + body)
_tied = lambda body: sql(_V, _TIED + body)
_MEM = f"""fsim as (select qid, fact_id, list_dot_product(qvec, embedding) / (sqrt(list_dot_product(qvec, qvec)) * sqrt(list_dot_product(embedding, embedding))) as s from q join (select * from facts where embedding is not null) on workspace_id = qproject),
msim as (select qid, fact_id, coalesce(s, 0) * confidence * power(0.95::double, greatest(0, floor((epoch_us(timestamp '{BASE}') - epoch_us(updated_at))::double / 604800000000))) as score
  from q join facts on workspace_id = qproject left join fsim using (qid, fact_id)),
mem as (select qid, -1 - fact_id as id, 1 - score as distance from (select *, row_number() over (partition by qid order by score desc, fact_id) as rn from msim) where rn <= {R.MEMORY})"""
ORACLE_SQL = {
    "c7_memory_candidates": sql("chunks q facts", _MEM + " select qid, id, round(distance, 6) as distance from mem"),
    "c15_with_memory": sql("chunks q edges facts", _TIED.rstrip() + ",\n" + _MEM + """, every as (select qid, id, via, file_path, score from fuse where score >= 0 union all select qid, id, 'memory', null, 1 - distance from mem where distance <= 1),
kept2 as (select *, case when file_path is not null and row_number() over (partition by qid, file_path order by score desc, id) > 2 then 1 else 0 end as over_ from every)
select qid, id, via, rank, round(score, 6) as score from (select *, row_number() over (partition by qid order by over_, score desc, id) as rank from kept2) where rank <= 10"""),
    "c12_dispatch": None,
    "c15_flat_corpus": sql("chunks q", f"""d as (select qid, id, file_path, 1 - list_dot_product(qvec, embedding) / (sqrt(list_dot_product(qvec, qvec)) * sqrt(list_dot_product(embedding, embedding))) as distance from q, chunks where embedding is not null),
sem as (select * from (select *, row_number() over (partition by qid order by distance, id) as rn from d) where rn <= {R.SEMANTIC}),
term as (select distinct qid, t as term from (select qid, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) as t from q) where t not in ({_STOP})),
post as (select id, t as term, count(*)::double as s from (select id, unnest(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+')) as t from chunks) group by all),
krank as (select qid, id, sum(s / (s + 1)) / n as rank from term join post using (term) join (select qid, count(*) as n from term group by qid) using (qid) group by qid, id, n having count(*) = n),
kw as (select * from (select k.*, row_number() over (partition by qid order by rank desc, id) as rn from krank k where not exists (select 1 from sem s where s.qid = k.qid and s.id = k.id)) where rn <= {R.KEYWORD}),
cand as (select qid, id, distance, file_path, 'semantic' as via from sem union all select kw.qid, kw.id, d.distance, file_path, 'keyword' from kw join d using (qid, id)),
w as (select distinct qid, regexp_replace(x, '[^\\p{{L}}\\p{{N}}_]+', '', 'g') as word from (select qid, unnest(string_split(query, ' ')) as x from q)),
fl as (select distinct qid, id from w, chunks where word <> '' and content ilike '%' || word || '%'),
fuse as (select c.*, 1 - distance + case when fl.id is not null then {R.FLAT_BOOST}::double else 0 end as score from cand c left join fl using (qid, id)),
kept as (select *, case when row_number() over (partition by qid, file_path order by score desc, id) > 2 then 1 else 0 end as over_ from fuse where score >= 1.1)
select qid, id, via, rank, round(score, 6) as score from (select *, row_number() over (partition by qid order by over_, score desc, id) as rank from kept) where rank <= 10"""),
    "b1_metadata_filters": sql("chunks", f"select id, project, title, status from chunks where ({_LIVE}) and project = 'en' and list_contains(layer, 'src1')"),
    "b3_exact_lookup": sql("chunks", """want as (select id as qid, 'F' || (id % 7) as wanted from chunks where id % 50 = 0)
select qid, id, rn from (select qid, id, row_number() over (partition by qid order by case when doc_id ilike '%' || wanted || '%' then 0 else 1 end, file_path, id) as rn
 from chunks, want where doc_id ilike '%' || wanted || '%' or file_path ilike '%' || wanted || '%') where rn <= 5"""),
    "c1_semantic_candidates": _tail("select qid, id, round(distance, 6) as distance, rn from sem"),
    "c2_semantic_search": sql("chunks q", """d as (select qid, id, list_dot_product(qvec, embedding) / (sqrt(list_dot_product(qvec, qvec)) * sqrt(list_dot_product(embedding, embedding))) as s from q, chunks where embedding is not null)
select qid, id, round(s, 6) as score, rn from (select *, row_number() over (partition by qid order by s desc, id) as rn from d) where rn <= 5"""),
    "c3_structural": _tail("select qid, id, round(distance, 6) as distance from struct_"),
    "c4_keyword_candidates": _tied("select qid, id, round(rank, 6) as rank, rn from kw"),
    "c5_keyword_rank": _tail("select qid, id, round(rank, 6) as rank from krank"),
    "c6_flat_keyword": sql("chunks q", f"""w as (select distinct qid, regexp_replace(x, '[^\\p{{L}}\\p{{N}}_]+', '', 'g') as word from (select qid, unnest(string_split(query, ' ')) as x from q))
select distinct qid, id from w, chunks where word <> '' and content ilike '%' || word || '%' and ({_LIVE})"""),
    "c8_priority_merge": _tail("select qid, id, via, round(distance, 6) as distance from cand where via <> 'keyword'"),
    "c11_confidence": _tail("select qid, round(confidence, 6) as confidence from conf"),
    "c14_text_index": sql("chunks", f"""select id, term, round(sum(w), 6) as s from (
    select id, unnest(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+')) as term, 1.0::double as w from chunks
    union all select id, unnest(regexp_extract_all(lower(array_to_string(keywords, ' ')), '[\\p{{L}}\\p{{N}}]+')), 1.0::double from chunks
    union all select id, unnest(regexp_extract_all(lower(description), '[\\p{{L}}\\p{{N}}]+')), 0.4::double from chunks
    union all select id, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')), 0.2::double from chunks) where term not in ({_STOP}) group by id, term"""),
    "u1_stamp_guard": _tail("select qid, id, round(distance, 6) as distance, rn from (select d.qid, d.id, distance, row_number() over (partition by d.qid order by distance, d.id) as rn from dist d join live l using (id) where coalesce(l.embedding_model, 'm1') = 'm1') where rn <= 5"),
    "c14_index_update": sql("chunks", f"""now as (
    select id, title, description from chunks where file_path not in ('docs/f3.md', 'docs/f5.md')
    union all select id, title || ' revised ' || (id % 3), description from chunks where file_path = 'docs/f3.md'
    union all select -id, title, description from chunks where id % 40 = 7)
  select id, term, round(sum(w), 6) as s from (
    select id, unnest(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}]+')) as term, 1.0::double as w from now
    union all select id, unnest(regexp_extract_all(lower(description), '[\\p{{L}}\\p{{N}}]+')), 0.4::double from now) where term not in ({_STOP}) group by id, term"""),
    "c15_hybrid_recall": _tied("select qid, id, doc_id, file_path, via, rank, round(score, 6) as score from final"),
}
_q_hybrid = "qid % 100 <> 0 and qid % 150 = 50"
_scope = "case when qid % 350 = 50 then 'de' when qid % 250 = 50 then qproject end"
ORACLE_SQL["c12_dispatch"] = sql(_V, _CTE.replace("from q, live where embedding is not null)", f"from q, live where embedding is not null and {_q_hybrid} and coalesce({_scope}, project) = project)").replace("row_number() over (partition by qid order by over_, score desc, id) as rank from kept) where rank <= 10", "row_number() over (partition by qid order by over_, score desc, id) as rank from kept) where rank <= 5").rstrip() + f""",
want as (select qid, 'F' || (qid % 7) as wanted from q where qid % 100 = 0),
ex as (select qid, id, 1.0::double as score, 'exact-id' as via, row_number() over (partition by qid order by case when doc_id ilike '%' || wanted || '%' then 0 else 1 end, file_path, id) as rn
  from chunks, want where doc_id ilike '%' || wanted || '%' or file_path ilike '%' || wanted || '%'),
d as (select qid, id, list_dot_product(qvec, embedding) / (sqrt(list_dot_product(qvec, qvec)) * sqrt(list_dot_product(embedding, embedding))) as score from q, chunks where embedding is not null and qid % 100 <> 0 and not ({_q_hybrid}) and coalesce({_scope}, project) = project),
r as (select * from ex union all select qid, id, score, 'semantic', row_number() over (partition by qid order by score desc, id) from d union all select qid, id, score, via, rank from final)
select qid, r.id, doc_id, title, section, via, rn, round(score, 6) as score from r join chunks c on c.id = r.id where rn <= 5""")
