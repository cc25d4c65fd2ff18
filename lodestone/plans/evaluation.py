"""Queries over the evaluation operators."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import retrieval as R
from ..sources.shared import read_report, shared_dir, write_report
from .memory import _words
from .retrieval import _CTE
from .stores import indexes
from .views import base, chunks, edges, golden, read, sql


def _cases(spark, d):
    """Benchmark items as cases whose vectors are those of chunks; the expected chunk is the same one or its neighbour."""
    b = read(spark, d, "benchmark")
    i = F.col("item_id")
    expect = F.when(i % 4 != 3, F.array(F.concat(F.lit("d"), i * 5 + i % 2))).otherwise(F.array().cast("array<string>"))
    cases = b.select(i.alias("case_id"), F.col("text").alias("query"), expect.alias("expect_docs"), (i % 4 == 3).alias("expect_abstain"))
    e = read(spark, d, "embeddings").select((F.col("vec_id") / 5).alias("x"), "embedding").where("x = floor(x)").select(F.col("x").cast("long").alias("case_id"), F.col("embedding").alias("qvec"))
    return cases, cases.join(e, "case_id").select(F.col("case_id").alias("qid"), "qvec", "query")


def _scores(spark, d, scope=None):
    cases, q = _cases(spark, d)
    q = q if scope is None else q.withColumn("scope", scope)
    c = chunks(spark, d)
    r = R.hybrid(q, c, edges(spark, d), base(), **indexes(spark, d))
    return E.case_scores(cases, r.join(c.select("id", "content"), "id"), R.confidence(q, r))


_CASES = """cases as (select item_id as case_id, text as query, case when item_id % 4 <> 3 then ['d' || (item_id * 5 + item_id % 2)] else []::varchar[] end as expect_docs, item_id % 4 = 3 as expect_abstain from benchmark),
q as (select case_id as qid, embedding::double[] as qvec, query from cases join embeddings on vec_id = case_id * 5),"""
_SCORES = f""",
hit as (select c.case_id, min(f.rank) as hit, min_by(l.content, f.rank) as content from cases c join final f on f.qid = c.case_id join live l on l.id = f.id where list_contains(c.expect_docs, f.doc_id) or list_contains(c.expect_docs, f.file_path) group by c.case_id),
w as (select c.*, hit, content, coalesce(confidence, 0) < 0.6552::double as says, {_words('query')} as a, {_words("coalesce(content, '')")} as b from cases c left join hit using (case_id) left join conf on conf.qid = c.case_id),
scores as (select case_id, case when len(expect_docs) > 0 then coalesce(hit <= 5, false)::int end as recall_at_5, case when len(expect_docs) > 0 then coalesce(hit <= 10, false)::int end as recall_at_10,
  case when len(expect_docs) > 0 then coalesce(1.0::double / hit, 0) end as mrr, case when len(expect_docs) > 0 then case when hit is null or len(a) = 0 then 0::double else len(list_intersect(a, b))::double / len(a) end end as groundedness,
  hit is not null as matched, says as abstained, (says = expect_abstain)::int as abstain_correct from w)
"""


def _h_sql(body):
    from .views import CHUNKS, EDGES

    return "with recursive " + CHUNKS + ",\n" + EDGES + ",\n" + _CASES + _CTE.strip() + _SCORES + body


def h1(spark, d):
    return _scores(spark, d).select("case_id", F.col("recall_at_5").cast("double").alias("recall_at_5"), F.col("recall_at_10").cast("double").alias("recall_at_10"), F.round("mrr", 6).alias("mrr"), F.round("groundedness", 6).alias("groundedness"), "matched", "abstained", "abstain_correct")


def h17(spark, d):
    """A run whose cases are confined to a project each, but for every fourth."""
    scope = F.get(F.array(F.lit("en"), F.lit("de"), F.lit("fr"), F.lit(None)), (F.col("qid") % 4).cast("int"))
    return _scores(spark, d, scope).select("case_id", *[F.col(c).cast("double").alias(c) for c in ("recall_at_5", "recall_at_10")], *[F.round(c, 6).alias(c) for c in ("mrr", "groundedness")], "matched", "abstained")


def h4(spark, d):
    x = E.aggregates(_scores(spark, d))
    return x.select("cases", *[F.round(c, 6).alias(c) for c in x.columns if c != "cases"])


def _values(spark, d, both=False):
    """Two runs over users as cases: base from even events, current from odd ones; ``both``: users of both runs alone."""
    e = read(spark, d, "events")
    x = e.groupBy(F.when(F.col("event_id") % 2 == 0, "base").otherwise("current").alias("run"), F.col("user_id").alias("case_id")).agg(F.count("*").alias("n"), F.max("event_id").alias("m"))
    hit = (F.col("m") % 3 != 0).cast("int")
    x = x.select("run", "case_id", hit.alias("recall_at_5"), F.lit(1).alias("recall_at_10"), (1 / (1 + F.col("n") % 5)).alias("mrr"), (F.col("n") % 7 / 7).alias("groundedness"), (F.col("n") % 2).cast("int").alias("abstain_correct"), (F.col("case_id") % 3 != 0).alias("matched"))
    v = E.long_form(x, ["run", "case_id"])
    if both:
        v = v.join(e.groupBy(F.col("user_id").alias("case_id")).agg(F.count_distinct(F.col("event_id") % 2).alias("k")).where("k = 2"), "case_id", "left_semi")
    return v.where("metric <> 'groundedness' or run <> 'base' or case_id % 40 <> 7")


_VALUES = """g as (select case when event_id % 2 = 0 then 'base' else 'current' end as run, user_id as case_id, count(*) as n, max(event_id) as m from events group by all),
vals as (
  select run, case_id, 'recall_at_5' as metric, (m % 3 <> 0)::int::double as value from g union all select run, case_id, 'recall_at_10', 1.0::double from g
  union all select run, case_id, 'mrr', 1.0::double / (1 + n % 5) from g union all select run, case_id, 'groundedness', (n % 7)::double / 7 from g where run <> 'base' or case_id % 40 <> 7
  union all select run, case_id, 'groundedness_on_hits', (n % 7)::double / 7 from g where case_id % 3 <> 0
  union all select run, case_id, 'abstain_correct', (n % 2)::double from g)"""
_BOTH = _VALUES.replace("from events group by all)", "from events where user_id in (select user_id from events group by user_id having count(distinct event_id % 2) = 2) group by all)")
_POISSON = " + ".join(f"(u >= {sum(math.exp(-1) / math.factorial(j) for j in range(k)):.17g}::double)::int" for k in range(1, 12))


def _bootstrap(source, seed, resamples):
    """SQL of the Poisson bootstrap of source(metric, case_id, value): table boot(metric, point, lo, hi, n). A seed may be an expression of the metric."""
    lo, hi = E.places(resamples)
    return f"""each as (select metric, r, value, ('0x' || substr(md5(({seed}) || ':' || r || ':' || case_id), 1, 8))::ubigint::double / 4294967296 as u from {source}, range({resamples}) t(r)),
drawn as (select metric, r, sum(({_POISSON}) * value) as s, sum({_POISSON}) as w, count(*) as n, avg(value) as point from each group by metric, r),
boot as (select metric, any_value(point) as point, list_sort(list(s / w))[{lo + 1}] as lo, list_sort(list(s / w))[{hi + 1}] as hi, any_value(n) as n from drawn group by metric)"""


def _paired(source):
    return source + """,
b as (select case_id, metric, value as b from vals where run = 'base'), c as (select case_id, metric, value as c from vals where run = 'current'),
bc as (select * from b full join c using (case_id, metric)), dv as (select metric, case_id, c - b as value from bc where metric in ('mrr', 'groundedness', 'groundedness_on_hits') and c - b is not null),
pm as (select metric, metric in ('mrr', 'groundedness', 'groundedness_on_hits') as mean, count(*) filter (b is null) as added, count(*) filter (c is null) as removed, count(*) filter (c > b) as up, count(*) filter (c < b) as down, avg(c - b) as delta from bc group by metric),
""" + _bootstrap("dv", "case metric when 'mrr' then 10 when 'groundedness' then 11 else 12 end", 200) + """,
lost as (select exists (select 1 from vals group by case_id having count(distinct run) < 2) as x),
pp as (select pm.*, lo, hi, x as other, case when mean then null when up + down = 0 then 1::double else least(1, 2 * (select sum(exp(lgamma(up + down + 1) - lgamma(i + 1) - lgamma(up + down - i + 1) - (up + down) * ln(2::double))) from range(least(up, down) + 1) t(i))) end as p from pm left join boot using (metric), lost),
verdicts as (select *, case when not mean then up end as better, case when not mean then down end as worse, case when other or added > 0 or removed > 0 then 'incomparable'
  when case when mean then delta = 0 else up = down end then 'flat' when mean then case when delta < 0 then 'regressed' || case when hi < 0 then '-significant' else '-within-noise' end else 'improved' || case when lo > 0 then '-significant' else '-within-noise' end end
  else case when down > up then 'regressed' else 'improved' end || case when p < 0.05 then '-significant' else '-within-noise' end end as verdict from pp)"""


_PAIRED = _paired(_BOTH)


def h5(spark, d):
    v = _values(spark, d).where(F.col("metric").isin(E.PROPORTIONS) & (F.col("run") == "base"))
    return E.proportion_intervals(v).select("metric", "k", "n", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def h6(spark, d):
    """An evaluation for each cohort of a hundred users."""
    v = _values(spark, d).where(F.col("metric").isin(E.CONTINUOUS) & (F.col("run") == "current")).withColumn("cohort", F.floor(F.col("case_id") / 100))
    return E.bootstrap_exact(v, 17, 500, ["cohort", "metric"]).select("cohort", "metric", *[F.round(c, 6).alias(c) for c in ("point", "lo", "hi")], "n")


def h6b(spark, d):
    v = _values(spark, d).where(F.col("metric").isin(E.CONTINUOUS) & (F.col("run") == "current"))
    return E.bootstrap_spread(v, 17, 100).select("metric", *[F.round(c, 6).alias(c) for c in ("point", "lo", "hi")], "n")


def h7(spark, d):
    return E.corpus_stamp(chunks(spark, d), edges(spark, d)).withColumn("max_indexed_at", F.unix_micros("max_indexed_at"))


def h8(spark, d):
    from ..functions.scalars import sign_test

    e = read(spark, d, "events").groupBy("user_id").agg(F.count_if(F.expr("event_id % 3 = 0")).alias("better"), F.count_if(F.expr("event_id % 3 = 1")).alias("worse"))
    return e.select("user_id", "better", "worse", F.round(sign_test(F.col("better"), F.col("worse")), 6).alias("p"))


def h9(spark, d):
    """Cases that one run lacks, of all metrics (no metric) and of each."""
    v = _values(spark, d)
    return E.case_changes(v).select(F.lit(None).cast("string").alias("metric"), "case_id", "change").union(E.case_changes(v, True).select("metric", "case_id", "change"))


def h9_flips(spark, d):
    return E.flips(_values(spark, d))


def h10(spark, d):
    """Six metrics, that on hits over the cases that matched alone."""
    x = E.paired(_values(spark, d, True), resamples=200)
    return x.select("metric", "added", "removed", "better", "worse", *[F.round(c, 6).alias(c) for c in ("delta", "lo", "hi", "p")], "verdict")


def h10_other_cases(spark, d):
    """The same over runs that differ in some users: nothing can be compared."""
    return E.paired(_values(spark, d), resamples=200).select("metric", "added", "removed", "verdict")


def _means(spark, d, run):
    return _values(spark, d).where(F.col("run") == run).groupBy("metric").agg(F.avg("value").alias("value"))


def h11(spark, d):
    return E.deltas(_means(spark, d, "base"), _means(spark, d, "current").where("metric <> 'mrr'")).select("metric", *[F.round(c, 6).alias(c) for c in ("base", "current", "delta")], "regressed")


def h12(spark, d):
    s = chunks(spark, d).groupBy("project").agg(F.count("*").alias("chunk_count"), F.count_distinct("file_path").alias("file_count"))
    s = s.select("project", F.when(F.col("project") != "fr", F.col("chunk_count")).alias("chunk_count"), "file_count", F.col("chunk_count").alias("base_chunk_count"), F.when(F.col("project") == "de", 1).otherwise(F.col("file_count")).alias("base_file_count"))
    return E.confounded(s, ["chunk_count", "file_count"]).select("project", "confounded", F.array_join("confounded_by", ",").alias("confounded_by"))


def h13(spark, d):
    e = read(spark, d, "events")
    a = F.create_map(F.lit("k"), F.col("event_id") % 3, F.lit("w"), F.lit(1))
    b = F.when(F.col("event_id") % 5 != 0, F.create_map(F.lit("k"), F.lit(0), F.lit("z"), F.lit(1)))
    return e.select("event_id", F.array_join(E.changed_keys(a, b), ",").alias("changed"))


def h14(spark, d):
    g = golden(spark, d).withColumn("source", F.when(F.col("case_id") % 5 == 0, "guessed").when(F.col("case_id") % 5 == 1, "mined").otherwise("authored")).withColumn("source_query_id", F.when(F.col("case_id") % 3 == 0, F.lit("x")))
    return E.violations(g.withColumn("expect_abstain", F.col("expect_abstain") | (F.col("case_id") % 7 == 0)))


def h15(spark, d):
    return E.case_digest(golden(spark, d))


def h16(spark, d):
    return E.gate(E.paired(_values(spark, d, True), resamples=200), True)


def a24(spark, d):
    """A run's report, written as JSON and read again."""
    r = _means(spark, d, "base").select("metric", F.round("value", 6).alias("value"))
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    write_report(r, path)
    return read_report(spark, path, r.schema)


def h18(spark, d):
    r = read(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 4 != 0, F.lit("better recall")).alias("reason"), F.when(F.col("o_orderkey") % 5 != 0, "g").alias("golden_digest"), F.lit("c").alias("corpus_digest"), F.lit("k").alias("constants"), (F.col("o_orderkey") % 7 == 0).alias("worse"))
    return E.promotable(r).select("run_id", "eligible", "why_not")


QUERIES = {
    "h1_case_scores": h1, "h4_aggregates": h4, "h5_wilson": h5, "h6_bootstrap_exact": h6, "h6_bootstrap_spread": h6b, "h7_corpus_stamp": h7, "h8_sign_test": h8, "h9_case_changes": h9, "h9_flips": h9_flips, "h10_paired_verdict": h10, "h10_other_cases": h10_other_cases,
    "h11_deltas": h11, "h12_confounded": h12, "h13_constants": h13, "h14_case_rules": h14, "h15_case_digest": h15, "h16_gate": h16, "h17_scoped_run": h17, "h18_promotable": h18, "a24_report": a24,
}
ORACLE_SQL = {
    "h1_case_scores": _h_sql("select case_id, recall_at_5::double as recall_at_5, recall_at_10::double as recall_at_10, round(mrr, 6) as mrr, round(groundedness, 6) as groundedness, matched, abstained, abstain_correct from scores"),
    "h17_scoped_run": _h_sql("select case_id, recall_at_5::double as recall_at_5, recall_at_10::double as recall_at_10, round(mrr, 6) as mrr, round(groundedness, 6) as groundedness, matched, abstained from scores")
    .replace("embedding::double[] as qvec, query from cases", "embedding::double[] as qvec, query, case case_id % 4 when 0 then 'en' when 1 then 'de' when 2 then 'fr' end as scope from cases")
    .replace("from q, live where embedding is not null", "from q, live where embedding is not null and coalesce(scope, project) = project")
    .replace("from term join post using (term) join (select qid", "from term join (select p.*, l.project as own from post p join live l using (id)) using (term) join (select qid, scope from q) using (qid) join (select qid")
    .replace("group by qid, id, n having count(*) = n)", "where coalesce(scope, own) = own group by qid, id, n having count(*) = n)"),
    "h4_aggregates": _h_sql("select count(*) as cases, round(coalesce(avg(recall_at_5), 0), 6) as recall_at_5, round(coalesce(avg(recall_at_10), 0), 6) as recall_at_10, round(avg(abstain_correct), 6) as abstain_correct, round(coalesce(avg(mrr), 0), 6) as mrr, round(coalesce(avg(groundedness), 0), 6) as groundedness, round(coalesce(avg(groundedness) filter (matched), 0), 6) as groundedness_on_hits from scores"),
    "h5_wilson": "with " + _VALUES + """, w as (select metric, sum(value) as k, count(*)::double as n from vals where run = 'base' and metric in ('recall_at_5', 'recall_at_10', 'abstain_correct') group by metric)
select metric, k::bigint as k, n::bigint as n, round(greatest(0, (k / n + 1.9208::double / n - 1.96::double * sqrt((k / n * (1 - k / n) + 0.9604::double / n) / n)) / (1 + 3.8416::double / n)), 6) as lo,
  round(least(1, (k / n + 1.9208::double / n + 1.96::double * sqrt((k / n * (1 - k / n) + 0.9604::double / n) / n)) / (1 + 3.8416::double / n)), 6) as hi from w""",
    "h6_bootstrap_spread": "with " + _VALUES + ", x as (select * from vals where run = 'current' and metric in ('mrr', 'groundedness', 'groundedness_on_hits')), " + _bootstrap("x", 17, 100) + " select metric, round(point, 6) as point, round(lo, 6) as lo, round(hi, 6) as hi, n from boot",
    "h9_case_changes": "with " + _VALUES + """ select null::varchar as metric, case_id, case when min(run) = 'base' then 'removed' else 'added' end as change from vals group by case_id having count(distinct run) < 2
union all select metric, case_id, case when min(run) = 'base' then 'removed' else 'added' end from vals group by metric, case_id having count(distinct run) < 2""",
    "h9_flips": "with " + _VALUES + " select b.metric, b.case_id, case when c.value > b.value then 'better' else 'worse' end as flip from vals b join vals c on b.run = 'base' and c.run = 'current' and b.metric = c.metric and b.case_id = c.case_id where b.value <> c.value and b.metric not in ('mrr', 'groundedness', 'groundedness_on_hits')",
    "h10_other_cases": "with " + _paired(_VALUES) + " select metric, added, removed, verdict from verdicts",
    "h7_corpus_stamp": sql("chunks edges", "select count(*) as chunk_count, count(distinct file_path) as file_count, epoch_us(max(indexed_at)) as max_indexed_at, (select count(*) from edges) as edge_count from chunks"),
    "h8_sign_test": """select user_id, better, worse, round(case when better + worse = 0 then 1::double else least(1, 2 * (select sum(exp(lgamma(better + worse + 1) - lgamma(i + 1) - lgamma(better + worse - i + 1) - (better + worse) * ln(2::double))) from range(least(better, worse) + 1) t(i))) end, 6) as p
from (select user_id, count(*) filter (event_id % 3 = 0) as better, count(*) filter (event_id % 3 = 1) as worse from events group by user_id)""",
    "h10_paired_verdict": "with " + _PAIRED + " select metric, added, removed, better, worse, round(delta, 6) as delta, round(lo, 6) as lo, round(hi, 6) as hi, round(p, 6) as p, verdict from verdicts",
    "a24_report": "with " + _VALUES + " select metric, round(avg(value), 6) as value from vals where run = 'base' group by metric",
    "h11_deltas": "with " + _VALUES + """, b as (select metric, avg(value) as base from vals where run = 'base' group by metric), c as (select metric, avg(value) as current from vals where run = 'current' and metric <> 'mrr' group by metric)
select metric, round(base, 6) as base, round(coalesce(current, 0), 6) as current, round(coalesce(current, 0) - base, 6) as delta, coalesce(current, 0) - base < 0 as regressed from b left join c using (metric)""",
    "h12_confounded": sql("chunks", """s as (select project, count(*) as n, count(distinct file_path) as f from chunks group by project)
select project, case when project = 'fr' then 'unknown' when project = 'de' and f <> 1 then 'yes' else 'no' end as confounded, case when project = 'de' and f <> 1 then 'file_count' else '' end as confounded_by from s"""),
    "h13_constants": "select event_id, case when event_id % 5 = 0 then null when event_id % 3 = 0 then 'w,z' else 'k,w,z' end as changed from events",
    "h14_case_rules": sql("golden", """g as (select *, expect_abstain or case_id % 7 = 0 as ab, case case_id % 5 when 0 then 'guessed' when 1 then 'mined' else 'authored' end as source from golden)
select case_id, unnest(list_filter([case when trim(query) = '' then 'empty_query' end, case when ab and len(expect_docs) > 0 then 'abstain_with_docs' end, case when not ab and len(expect_docs) = 0 then 'nothing_expected' end,
  case when source = 'guessed' then 'unknown_source' end, case when case_id % 3 = 0 and source <> 'mined' then 'source_query_id' end], lambda x: x is not null)) as rule from g"""),
    "h15_case_digest": sql("golden", """h as (select sha256(concat_ws('|', case_id, query, array_to_string(expect_docs, ','), case when expect_abstain then 'true' else 'false' end)) as h from golden),
p as (select substr(h, 1, 2) as bucket, count(*) as n, sha256(string_agg(h, '' order by h)) as h from h group by 1)
select sum(n)::bigint as n, sha256(string_agg(h, '' order by bucket)) as digest from p"""),
    "h16_gate": "with " + _PAIRED + " select coalesce(bool_or(verdict = 'regressed-significant' or delta < 0), false) as failed, coalesce(string_agg(metric, ',' order by metric) filter (verdict = 'regressed-significant' or delta < 0), '') as metrics from verdicts",
    "h18_promotable": "select o_orderkey as run_id, o_orderkey % 4 <> 0 and o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 as eligible, case when o_orderkey % 4 = 0 then 'no_reason' when o_orderkey % 5 = 0 then 'no_stamp' when o_orderkey % 7 = 0 then 'regression' end as why_not from orders",
}
