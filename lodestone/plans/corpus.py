"""Queries over chunking and corpus upkeep."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import chunking as K
from ..operators import corpus as C
from ..operators import upkeep as U
from ..sources.listing import contents, listed, write_files
from ..sources.manifest import Manifest
from ..sources.shared import shared_dir
from .views import BASE, base, chunks, days, markdown, read, sql

LANES = [("root", "^docs/"), ("tier", "^tier[0-9]/docs/"), ("planning", "^[^/]+/planning/"), ("repo_docs", "^[^/]+/docs/")]


def _files(spark, d):
    """A listing: a path of one of seven kinds for each document."""
    i = F.col("doc_id")
    kinds = ["docs/src1/{}.md", "tier1/docs/{}.mdx", "sub/planning/{}.md", "sub/docs/_{}.md", "sub/target/{}.md", "docs/.git/{}.md", "sub/docs/{}.txt"]
    path = F.coalesce(*[F.when(i % 7 == k, F.concat(F.lit(p.split("{}")[0]), i, F.lit(p.split("{}")[1]))) for k, p in enumerate(kinds)])
    return read(spark, d, "documents").select(path.alias("path"), "lang", "doc_id")


_FILES = """files as (select doc_id, lang, case doc_id % 7 when 0 then 'docs/src1/' || doc_id || '.md' when 1 then 'tier1/docs/' || doc_id || '.mdx' when 2 then 'sub/planning/' || doc_id || '.md' when 3 then 'sub/docs/_' || doc_id || '.md'
  when 4 then 'sub/target/' || doc_id || '.md' when 5 then 'docs/.git/' || doc_id || '.md' else 'sub/docs/' || doc_id || '.txt' end as path from documents)"""


def _times(spark, d):
    """Twelve files with times; the index has ten of them."""
    i = F.col("doc_id")
    return read(spark, d, "documents").groupBy(F.concat(F.lit("docs/f"), i % 12, F.lit(".md")).alias("path")).agg(F.max(base() - days(i % 25 + i % 12)).alias("mtime")).where("path <> 'docs/f3.md'")


_TIMES = f"times as (select 'docs/f' || (doc_id % 12) || '.md' as path, max(timestamp '{BASE}' - to_days((doc_id % 25 + doc_id % 12)::int)) as mtime from documents where doc_id % 12 <> 3 group by 1)"
_NEWEST = "newest as (select file_path as path, max(indexed_at) as newest from chunks group by 1)"


def a1(spark, d):
    return C.discover(_files(spark, d), LANES).select("path", "lane_name", C.doc_type(F.col("path")).alias("doc_type"))


def _written(spark, d):
    """A folder of files, one for each document, of the seven kinds of `_files`."""
    root = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    texts = read(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    write_files(_files(spark, d).join(texts, "doc_id").select("path", "content"), root)
    return root


def a1_listing(spark, d):
    """Lanes of the files that a folder holds, as its listing tells them."""
    f = C.discover(listed(spark, _written(spark, d)), LANES)
    return f.select("path", "lane_name", "length")


def a2(spark, d):
    """What a workspace of the same folder takes, and the texts that are read of it."""
    root = _written(spark, d)
    f = C.discover_workspace(listed(spark, root))
    return contents(root, f).select("path", F.sha2("content", 256).alias("content_sha256"))


def a14_workspace(spark, d):
    """Files of two projects of the same paths: each is due by its own project's rows."""
    t = _times(spark, d)
    f = t.withColumn("project", F.lit("fr")).unionByName(t.withColumn("project", F.lit("none")))
    return C.to_index(f, chunks(spark, d)).select("path", "project")


def a3(spark, d):
    return _files(spark, d).select("path", C.skipped(F.col("path")).alias("reason"))


def a3_prefixes(spark, d):
    """Two folders more that are never read."""
    return _files(spark, d).select("path", C.skipped(F.col("path"), ["target"], ("docs/src1", "sub/planning")).alias("reason"))


def a16_workspace(spark, d):
    """A rebuild of one workspace clears its rows alone."""
    return C.after_rebuild(chunks(spark, d), spark.createDataFrame([], "slug string"), "en").select("id", "project")


def a5(spark, d):
    f = C.discover(_files(spark, d), LANES)
    own = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    return f.select("path", C.attributed(F.col("lane"), F.split_part("path", F.lit("/"), F.lit(1)), own).alias("project"))


def _front(spark, d):
    """documents with a YAML block; every ninth is malformed."""
    i = F.col("doc_id")
    block = F.concat(F.lit("---\ntitle: T"), i, F.lit("\nlayer: ["), "lang", F.lit(", Research]\nstatus: ' Active '\nkeywords: "), F.when(i % 2 == 0, "[]").otherwise(F.concat(F.lit("k"), i % 5)), F.when(i % 9 == 0, "\n: [bad").otherwise(""), F.lit("\n---\n"))
    return read(spark, d, "documents").select(F.concat(F.lit("docs/x"), i, F.lit(".md")).alias("path"), F.concat(block, F.coalesce("text", F.lit(""))).alias("content"))


def a6(spark, d):
    p = K.normalised(K.parse_documents(_front(spark, d)))
    return p.select("path", "doc_id", "title", F.array_join("layer", ",").alias("layer"), "status", F.array_join("keywords", ",").alias("keywords"), F.array_join("unknown_layers", ",").alias("unknown"), F.col("parse_error").isNotNull().alias("failed"), F.when(F.col("parse_error").isNull(), F.sha2("body", 256)).alias("body_sha256"))


def a8(spark, d):
    c = chunks(spark, d)
    return c.select("id", K.context_prefix({"type": F.lit(None).cast("string"), "title": F.col("title"), "layer": F.array_join("layer", ", "), "project": F.col("project"), "keywords": F.col("status")}).alias("prefix"))


def a9(spark, d):
    s = K.sections(markdown(spark, d))
    return s.select("doc_id", "no", "section", F.sha2("content", 256).alias("content_sha256"), K.header_only(F.col("content"), F.col("section")).alias("header_only"))


def a11(spark, d):
    w = K.windows(read(spark, d, "documents"), "text", ["doc_id"])
    return w.select("doc_id", "window", F.sha2("content", 256).alias("content_sha256"))


def a12(spark, d):
    c = K.content_chunks(markdown(spark, d))
    return c.select("doc_id", "position", "section_title", "is_section_title", F.sha2("content", 256).alias("content_sha256"))


def a13(spark, d):
    """The vectors' numbers that aren't 0."""
    e = K.embedded(markdown(spark, d).select("doc_id", "body"), "body", K.hashed_words(32), 32, "hashed-32")
    x = e.select("doc_id", "embedding_model", F.posexplode("embedding").alias("place", "value"))
    return x.where("value <> 0").select("doc_id", "place", F.col("value").cast("long").alias("value"), "embedding_model")


def a14(spark, d):
    return C.to_index(_times(spark, d), chunks(spark, d)).select("path")


def a15(spark, d):
    c = chunks(spark, d).select("id", "file_path", "section", "title")
    new = c.where("id % 9 = 0").select((F.col("id") + 1_000_000).alias("id"), "file_path", "section", F.lit("new").alias("title"))
    return C.replaced(c, new, ["file_path", "section"]).select("id", "file_path", "section", "title")


def a16(spark, d):
    manifest = spark.createDataFrame([("en",), ("de",)], "slug string")
    return C.after_rebuild(chunks(spark, d), manifest).select("id", "project", "client_slug")


def _paths(spark, d):
    return read(spark, d, "nation").where("n_nationkey % 3 = 0").select(F.concat(F.lit("docs/f"), "n_nationkey", F.lit(".md")).alias("path"))


def a17(spark, d):
    """What stays, by the kind of the prune: of all projects, of one, and in a dry run."""
    c, p = chunks(spark, d), _paths(spark, d)
    kinds = {"all": C.pruned(c, p), "en": C.pruned(c, p, "en"), "dry": C.pruned(c, p, dry_run=True)}
    out = None
    for k, (kept, counts) in kinds.items():
        x = kept.select(F.lit(k).alias("kind"), "id").unionByName(counts.select(F.lit(k).alias("kind"), F.explode(F.array((-1 - F.col("deleted")), (-1_000_000_000 - F.col("protected")))).alias("id")))
        out = x if out is None else out.unionByName(x)
    return out


def a18(spark, d):
    return C.quarantined(_paths(spark, d), chunks(spark, d))


def a18_delete(spark, d):
    return C.without_quarantined(chunks(spark, d), _paths(spark, d)).select("id", "file_path")


def a19(spark, d):
    return C.backfilled(chunks(spark, d), _times(spark, d)).select("id", F.coalesce(F.unix_micros("authored_at"), F.lit(-1)).alias("authored_at"))


def a19_project(spark, d):
    t = _times(spark, d).withColumn("project", F.lit("fr"))
    return C.backfilled(chunks(spark, d), t).select("id", F.coalesce(F.unix_micros("authored_at"), F.lit(-1)).alias("authored_at"))


def a20(spark, d):
    """Every third document's file is asked for, and each has a neighbour that isn't in the corpus."""
    f = _files(spark, d)
    wanted = f.where("doc_id % 3 = 0").select(F.explode(F.array(F.col("path"), F.concat("path", F.lit(".old")))).alias("path"))
    inside, outside = C.restricted(f.select("path"), wanted)
    first, _ = C.restricted(f.select("path"), first=10)
    return inside.withColumn("known", F.lit("yes")).union(outside.withColumn("known", F.lit("no"))).union(first.withColumn("known", F.lit("first")))


def _artifacts(spark, d):
    m = markdown(spark, d)
    return m.select(F.col("source").alias("type"), F.col("doc_id").cast("string").alias("id"), F.col("body").alias("content"), F.when(F.col("doc_id") % 4 == 0, "given").alias("section"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("project"), F.concat(F.lit("T"), "doc_id").alias("title"), F.lit(None).cast("string").alias("description"))


def a21(spark, d):
    """Artifacts over an index that holds older rows of some of them, and rows of another project."""
    columns = ["file_path", "section", "project", "title", "content", "embedding_model", "window"]
    a = _artifacts(spark, d)
    old = a.where("cast(id as bigint) % 8 = 0").select(F.concat(F.lit("ingested/"), "type", F.lit("/"), "id", F.lit(".md")).alias("file_path"), "section", F.explode(F.array("project", F.lit("other"))).alias("project"), F.lit("old").alias("title"), F.lit("old text").alias("content"), F.lit("m").alias("embedding_model"), F.lit(0).alias("window"))
    index, _ = C.ingest(old.select(*columns), a, K.hashed_words(8), 8, "hashed-8")
    return index.select("file_path", "section", "project", "title", "window", "embedding_model", F.sha2("content", 256).alias("content_sha256"))


def a27(spark, d):
    """Chunks written twice: each write appends."""
    path = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    c = K.content_chunks(markdown(spark, d)).select("doc_id", "position", "content")
    C.store_chunks(c.where("doc_id % 2 = 0"), path)
    C.store_chunks(c.where("doc_id % 2 = 1"), path)
    return spark.read.parquet(path).select("doc_id", "position", F.sha2("content", 256).alias("content_sha256"))


def a23(spark, d):
    """Logs: lines of a text with headers of every kind put in between."""
    i = F.col("doc_id")
    lines = F.transform(F.split("text", "\n", -1), lambda x, k: F.when(k % 7 == 1, F.format_string("## [run: 2026-01-%02d]", (i + k) % 28 + 1)).when(k % 7 == 3, F.concat(F.lit("### "), x)).when(k % 7 == 5, F.format_string("## 2026-02-%02d (entry)", (i + k) % 28 + 1)).when(k % 7 == 6, F.concat(F.lit("## "), x)).otherwise(x))
    return K.log_entries(read(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("body"))).select("doc_id", "entry", "date", "title", F.sha2("body", 256).alias("body_sha256"))


def a25(spark, d):
    """Pages, every tenth behind a navigation that is never closed; and what is left of some when their text is taken away."""
    i = F.col("page_id")
    p = read(spark, d, "pages").select("page_id", F.when(i % 10 == 3, F.concat(F.lit("<nav>"), "html")).when(i % 10 == 7, F.concat(F.regexp_extract("html", "(?is)<style.*?</style>", 0), F.lit("<!-- none -->"))).otherwise(F.col("html")).alias("html"))
    return K.article_text(p).select("page_id", "fetch_status", F.sha2("article", 256).alias("article_sha256"))


def a26(spark, d):
    c = read(spark, d, "conversations")
    u = c.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "application/pdf").otherwise("text/plain").alias("mime"), F.base64(F.encode("text", "UTF-8")).alias("data"))
    ok, bad = K.plain_text(u)
    return ok.select("conv_id", "turn", F.length("text").alias("length"), F.lit(None).cast("string").alias("reason")).union(bad.select("conv_id", "turn", F.lit(-1), "reason"))


def a28(spark, d):
    r = C.Repository(read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))
    r = C.Repository(r.merge(r.rows.where("id % 10 = 0").withColumn("name", F.lit("merged"))))
    r = C.Repository(r.delete(r.rows.where("id % 7 = 0").select("id")))
    return r.latest(50)


def _refreshed(spark, d, dry_run=False):
    """Files that are due get two rows for each row of section s1 or s2; one file can't be parsed."""
    from .views import edges

    c = chunks(spark, d).select("id", "file_path", "section", "indexed_at")
    bad = read(spark, d, "nation").where("n_nationkey = 5").select(F.lit("docs/f5.md").alias("path"))
    cut = lambda due: c.where("section in ('s1', 's2')").join(due.select(F.col("path").alias("file_path")), "file_path", "left_semi").withColumn("id", F.explode(F.array(-F.col("id"), F.col("id") + 1_000_000_000))).select(*c.columns)
    return C.refresh(c, _times(spark, d), cut, bad, lambda: edges(spark, d).count(), dry_run)


def a29(spark, d):
    return _refreshed(spark, d)[0].select("id", "file_path", "section")


def a29_summary(spark, d):
    return _refreshed(spark, d)[1].unionByName(_refreshed(spark, d, True)[1])


def _payloads(spark, d):
    """A payload for each document: itself as a node and its edge, without a target for every 22nd, and for every 30th from a node that it doesn't name."""
    from .views import edges

    i = F.regexp_extract("source_id", "[0-9]+", 0).cast("long")
    e = edges(spark, d)
    node = F.struct(F.col("source_id").alias("id"), F.col("source_id").alias("doc_id"), F.lit("s").alias("scope"))
    edge = F.struct(F.when(i % 30 == 0, "nobody").otherwise(F.col("source_id")).alias("from"), "to_ref", F.lit(None).cast("string").alias("target_node_id"), F.when(i % 22 != 0, F.col("to_ref")).alias("target_doc_id"), F.lit("related").alias("kind"))
    return e.select(F.to_json(F.struct(F.lit("2").alias("version"), F.array(node).alias("nodes"), F.array(edge).alias("edges"))).alias("payload"))


def _upkeep(spark, d, rebuild=None):
    """A store of the index and edges after a refresh; one file can't be parsed."""
    from .views import edges

    c = chunks(spark, d).select("id", "file_path", "section", "indexed_at", "project", "client_slug")
    store = Manifest(spark, f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}")
    store.commit(replace={"index": c, "edges": edges(spark, d).select("source_id", "to_ref", "target_id")})
    bad = read(spark, d, "nation").where("n_nationkey = 5").select(F.lit("docs/f5.md").alias("path"), F.lit("bad header").alias("error"))
    cut = lambda due: c.where("section in ('s1', 's2')").join(due.select(F.col("path").alias("file_path")), "file_path", "left_semi").withColumn("id", F.explode(F.array(-F.col("id"), F.col("id") + 1_000_000_000))).select(*c.columns)
    summary = U.refresh(store, _times(spark, d), cut, bad, _payloads(spark, d), rebuild)
    return store, summary


def a29_commit(spark, d):
    """What a refresh changed in the index, the edges that it loaded and its errors, as rows."""
    store, _ = _upkeep(spark, d)
    changed = U.difference(store.read("index", 1), store.read("index", 2), ["id"]).select(F.lit("index").alias("table"), F.col("id").cast("string").alias("key"), "change")
    edges_ = store.read("edges", 2).select(F.lit("edges"), "source_id", F.coalesce("target_id", F.lit("none")))
    return changed.union(edges_).union(store.read("errors", 2).select(F.concat(F.lit("error "), "kind"), "key", "error"))


def a29_rebuild(spark, d):
    """The index after a rebuild of two projects, and the run's summary as a row of no id."""
    store, summary = _upkeep(spark, d, spark.createDataFrame([("en",), ("de",)], "slug string"))
    told = summary.select(F.lit(None).cast("long").alias("id"), F.concat_ws(" ", "version", "due", "chunks", "failed", "exit_code", "edges").alias("file_path"))
    return store.read("index", 2).select("id", "file_path").unionByName(told)


QUERIES = {
    "a3_prefixes": a3_prefixes, "a16_workspace": a16_workspace,
    "a1_listing": a1_listing, "a2_workspace": a2, "a14_workspace": a14_workspace, "a29_commit": a29_commit, "a29_rebuild": a29_rebuild,
    "a1_discovery": a1, "a3_skip_rules": a3, "a5_attribution": a5, "a6_metadata": a6, "a8_context_prefix": a8, "a9_sections": a9, "a11_token_windows": a11, "a12_content_chunks": a12, "a13_embedding": a13,
    "a14_incremental": a14, "a15_group_replace": a15, "a16_scoped_rebuild": a16, "a17_prune": a17, "a18_quarantine": a18, "a18_delete": a18_delete, "a19_backfill": a19, "a19_project": a19_project, "a27_store": a27, "a29_summary": a29_summary, "a20_restrict": a20, "a21_artifacts": a21, "a23_log_entries": a23,
    "a25_article_text": a25, "a26_plain_text": a26, "a28_repository": a28, "a29_refresh": a29,
}
_SKIP = "case when regexp_matches(path, '/_[^/]*$') then 'underscore' when regexp_matches(path, '(^|/)\\.') then 'hidden' when regexp_matches(path, '(^|/)target/') then 'skip_dir' end"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')".format
_SECTION = rf"""cut as (select doc_id, regexp_extract_all(coalesce(body, ''), '(?m)^#{{2,3}}\s+.+$') as h, string_split_regex(coalesce(body, ''), '(?m)^#{{2,3}}\s+.+$') as b from markdown),
part as (select doc_id, '' as section, 0 as i, {_STRIP('b[1]')} as content from cut where len(h) = 0 or {_STRIP('b[1]')} <> ''
  union all select doc_id, h[i] as section, i, h[i] || case when {_STRIP('b[i + 1]')} = '' then '' else chr(10) || {_STRIP('b[i + 1]')} end from cut, range(1, 100000) t(i) where i <= len(h)),
sec as (select doc_id, row_number() over (partition by doc_id order by i) - 1 as no, section, content from part)"""
_CONTENT = rf"""cut as (select doc_id, regexp_extract_all(coalesce(body, ''), '(?m)^#{{1,3}}\s+(.*)$', 1) as h, string_split_regex(coalesce(body, ''), '(?m)^#{{1,3}}\s+.*$') as b from markdown),
part as (select doc_id, i, case when i > 0 then {_STRIP('h[i]')} end as title, b[i + 1] as body from (select doc_id, h, b, unnest(range(len(b))) as i from cut)),
tok as (select doc_id, i, title, regexp_extract_all(body, '(?:\A\s+)?\S+\s*') as t from part where {_STRIP('body')} <> ''),
win as (select doc_id, i, title, t, unnest(range(0, len(t), 450)) as start from tok),
piece as (select doc_id, i, -1 as start, title, true as is_title, title as content from part where title is not null union all select doc_id, i, start, title, false, array_to_string(t[start + 1:start + 500], '') from win)
select doc_id, row_number() over (partition by doc_id order by i, start) - 1 as position, title as section_title, is_title as is_section_title, sha256(content) as content_sha256 from piece"""
_LOG = r"""raw as (select doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(len(string_split(text, chr(10))))) as k from documents where text is not null),
made as (select doc_id, k, case when k % 7 = 1 then format('## [run: 2026-01-{:02d}]', (doc_id + k) % 28 + 1) when k % 7 = 3 then '### ' || x when k % 7 = 5 then format('## 2026-02-{:02d} (entry)', (doc_id + k) % 28 + 1) when k % 7 = 6 then '## ' || x else x end as t from raw),
lines as (select doc_id, k, t, case when starts_with(t, '## ') then 2 when starts_with(t, '### ') then 3 end as level, trim(case when starts_with(t, '## ') then substr(t, 4) when starts_with(t, '### ') then substr(t, 5) end) as h from made),
own as (select *, nullif(regexp_extract(h, '^(\d{4}-\d{2}-\d{2})\s*\((.+)\)$', 1), '') as own, nullif(regexp_extract(h, '^\[?(?:run:\s*)?(\d{4}-\d{2}-\d{2})\]?$', 1), '') as grp, nullif(regexp_extract(h, '\d{4}-\d{2}-\d{2}'), '') as any_date from lines),
cur as (select *, last_value(case when level = 2 then coalesce(own, any_date) end ignore nulls) over (partition by doc_id order by k) as current, count(level) over (partition by doc_id order by k) as entry from own),
body as (select doc_id, entry, string_agg(t, chr(10) order by k) as body from cur where level is null group by all)
select c.doc_id, c.entry, coalesce(own, current) as date, coalesce(nullif(regexp_extract(h, '^(\d{4}-\d{2}-\d{2})\s*\((.+)\)$', 2), ''), h) as title, sha256(regexp_replace(regexp_replace(coalesce(body, ''), '\n?-{3,}\s*$', ''), '^\s+|\s+$', '', 'g')) as body_sha256
from cur c left join body using (doc_id, entry) where level is not null and not (level = 2 and grp is not null) and coalesce(own, current) is not null"""
_DUE = "due as (select path from times left join newest using (path) where (newest is null or newest <= mtime) and path <> 'docs/f5.md')"
ORACLE_SQL = {
    "a3_prefixes": "with " + _FILES + " select path, case when doc_id % 7 = 3 then 'underscore' when doc_id % 7 = 5 then 'hidden' when doc_id % 7 in (0, 2, 4) then 'skip_dir' end as reason from files",
    "a16_workspace": sql("chunks", "select id, project from chunks where project is distinct from 'en'"),
    "a1_listing": "with " + _FILES + " select path, case doc_id % 7 when 0 then 'root' when 1 then 'tier' when 2 then 'planning' end as lane_name, strlen(coalesce(text, ''))::bigint as length from files join documents using (doc_id) where doc_id % 7 < 3",
    "a2_workspace": "with " + _FILES + " select path, sha256(coalesce(text, '')) as content_sha256 from files join documents using (doc_id) where doc_id % 7 in (0, 1, 2, 3)",
    "a14_workspace": sql("chunks", _TIMES + """, pr(project) as (values ('fr'), ('none')), newest as (select file_path as path, project, max(indexed_at) as newest from chunks group by all)
select path, project from (select * from times, pr) t left join newest using (path, project) where newest is null or newest <= mtime"""),
    "a29_commit": sql("chunks edges", _TIMES + ", " + _NEWEST + ", " + _DUE + """,
fresh as (select id, file_path, section from chunks where section in ('s1', 's2') and file_path in (select path from due)),
ed as (select *, substr(source_id, 2)::bigint as i from edges)
select 'index' as "table", id::varchar as key, 'removed' as change from chunks where (file_path, section) in (select (file_path, section) from fresh) and id <> 0
union all select 'index', (-id)::varchar, 'added' from fresh where id <> 0 union all select 'index', (id + 1000000000)::varchar, 'added' from fresh
union all select 'edges', source_id, case when i % 22 <> 0 then to_ref else 'none' end from ed where i % 30 <> 0
union all select 'error edge', 'nobody', 'unknown source' from ed where i % 30 = 0 union all select 'error parse', 'docs/f5.md', 'bad header' from nation where n_nationkey = 5"""),
    "a29_rebuild": sql("chunks edges", _TIMES + """, due as (select path from times where path <> 'docs/f5.md'), base as (select id, file_path, section from chunks where not (client_slug is null and (project is null or project in ('', 'en', 'de')))),
fresh as (select id, file_path, section from chunks where section in ('s1', 's2') and file_path in (select path from due))
select id, file_path from base where (file_path, section) not in (select (file_path, section) from fresh) union all select -id, file_path from fresh union all select id + 1000000000, file_path from fresh
union all select null, '2 ' || (select count(*) from due) || ' ' || (select 2 * count(*) from fresh) || ' 1 1 ' || (select count(*) from edges where substr(source_id, 2)::bigint % 30 <> 0)"""),
    "a1_discovery": "with " + _FILES + " select path, case doc_id % 7 when 0 then 'root' when 1 then 'tier' when 2 then 'planning' end as lane_name, case doc_id % 7 when 0 then 'meta' else 'content' end as doc_type from files where doc_id % 7 < 3",
    "a3_skip_rules": "with " + _FILES + f" select path, {_SKIP} as reason from files",
    "a5_attribution": "with " + _FILES + " select path, case when doc_id % 7 = 2 then 'sub' when doc_id % 2 = 0 then lang end as project from files where doc_id % 7 < 3",
    "a6_metadata": """select 'docs/x' || doc_id || '.md' as path, 'x' || doc_id as doc_id, case when doc_id % 9 <> 0 then 'T' || doc_id end as title, case when doc_id % 9 <> 0 then lang || ',research' end as layer,
  case when doc_id % 9 <> 0 then 'active' end as status, case when doc_id % 9 <> 0 and doc_id % 2 <> 0 then 'k' || (doc_id % 5) end as keywords, case when doc_id % 9 <> 0 then lang else '' end as unknown, doc_id % 9 = 0 as failed, case when doc_id % 9 <> 0 then sha256(ltrim(coalesce(text, ''), chr(10))) end as body_sha256 from documents""",
    "a8_context_prefix": sql("chunks", "select id, 'title: ' || title || chr(10) || 'layer: ' || array_to_string(layer, ', ') || chr(10) || 'project: ' || project || coalesce(chr(10) || 'keywords: ' || status, '') || chr(10) || chr(10) as prefix from chunks"),
    "a9_sections": sql("markdown", _SECTION + r"select doc_id, no, section, sha256(content) as content_sha256, length(regexp_replace(substr(content, length(section) + 1), '^\s+|\s+$', '', 'g')) < 40 as header_only from sec".replace("select", " select", 1)),
    "a12_content_chunks": sql("markdown", _CONTENT),
    "a13_embedding": sql("markdown", r"""w as (select doc_id, unnest(list_filter(string_split_regex(lower(body), '\s+'), lambda x: x <> '')) as w from markdown),
h as (select doc_id, ('0x' || substr(md5(w), 1, 8))::ubigint as h from w)
select doc_id, (h % 32)::int as place, sum(case when h >= 2147483648 then 1 else -1 end)::bigint as value, 'hashed-32' as embedding_model from h group by 1, 2 having value <> 0"""),
    "a23_log_entries": "with " + _LOG,
    "a11_token_windows": r"""with t as (select doc_id, text, regexp_extract_all(text, '(?:\A\s+)?\S+\s*') as t from documents),
w as (select doc_id, text, t, unnest(case when len(t) > 500 then range(0, len(t), 450) else [0] end) as start from t)
select doc_id, start // 450 as "window", sha256(case when len(t) > 500 then array_to_string(t[start + 1:start + 500], '') else text end) as content_sha256 from w""",
    "a14_incremental": sql("chunks", _TIMES + ", " + _NEWEST + " select path from times left join newest using (path) where newest is null or newest <= mtime"),
    "a15_group_replace": sql("chunks", "k as (select distinct file_path, section from chunks where id % 9 = 0) select id, file_path, section, title from chunks c where not exists (select 1 from k where k.file_path = c.file_path and k.section = c.section) union all select id + 1000000, file_path, section, 'new' from chunks where id % 9 = 0"),
    "a16_scoped_rebuild": sql("chunks", "select id, project, client_slug from chunks where not (client_slug is null and (project is null or project in ('', 'en', 'de')))"),
    "a17_prune": sql("chunks", """p as (select 'docs/f' || n_nationkey || '.md' as path from nation where n_nationkey % 3 = 0),
k(kind) as (values ('all'), ('en'), ('dry')), h as (select kind, id, path is not null and (kind <> 'en' or project = 'en') as mine, client_slug from k, chunks left join p on path = file_path)
select kind, id from h where kind = 'dry' or not (mine and client_slug is null)
union all select kind, -1 - count(*) filter (mine and client_slug is null) from h group by kind union all select kind, -1000000000 - count(*) filter (mine and client_slug is not null) from h group by kind"""),
    "a18_delete": sql("chunks", "p as (select 'docs/f' || n_nationkey || '.md' as path from nation where n_nationkey % 3 = 0) select id, file_path from chunks where file_path not in (select path from p)"),
    "a19_project": sql("chunks", _TIMES + " select id, coalesce(epoch_us(coalesce(mtime, authored_at)), -1) as authored_at from chunks left join times on path = file_path and project = 'fr'"),
    "a27_store": None,
    "a18_quarantine": sql("chunks", "p as (select 'docs/f' || n_nationkey || '.md' as path from nation where n_nationkey % 3 = 0) select path, count(id) as rows from p left join chunks on path = file_path group by path"),
    "a19_backfill": sql("chunks", _TIMES + " select id, coalesce(epoch_us(coalesce(mtime, authored_at)), -1) as authored_at from chunks left join times on path = file_path"),
    "a20_restrict": "with " + _FILES + " select path, 'yes' as known from files where doc_id % 3 = 0 union all select path || '.old', 'no' from files where doc_id % 3 = 0 union all (select path, 'first' from files order by path limit 10)",
    "a25_article_text": r"""select page_id, case when a = '' then 'failed' when page_id % 10 = 3 then 'fallback_used' else 'ok' end as fetch_status, sha256(a) as article_sha256 from (select page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(
  case when page_id % 10 = 7 then '' when page_id % 10 = 3 then html else regexp_replace(html, '(?is)<!--.*?-->|<nav\b.*?</nav\s*>|<head\b.*?</head\s*>', ' ', 'g') end,
  '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) as a from pages)""",
    "a26_plain_text": "select conv_id, turn, case when turn % 3 <> 0 then length(text) else -1 end as length, case when turn % 3 = 0 then 'unsupported type application/pdf' end as reason from conversations",
    "a28_repository": "select c_custkey as id, case when c_custkey % 10 = 0 then 'merged' else c_name end as name from customer where c_custkey % 7 <> 0 order by 1 desc limit 50",
    "a29_refresh": sql("chunks", _TIMES + ", " + _NEWEST + """, due as (select path from times left join newest using (path) where (newest is null or newest <= mtime) and path <> 'docs/f5.md'),
fresh as (select id, file_path, section from chunks where section in ('s1', 's2') and file_path in (select path from due))
select id, file_path, section from chunks where (file_path, section) not in (select (file_path, section) from fresh) union all select -id, file_path, section from fresh union all select id + 1000000000, file_path, section from fresh"""),
    "a29_summary": sql("chunks edges", _TIMES + ", " + _NEWEST + """, due as (select path from times left join newest using (path) where (newest is null or newest <= mtime) and path <> 'docs/f5.md')
select dry_run, (select count(*) from due) as due, (select 2 * count(*) from chunks where section in ('s1', 's2') and file_path in (select path from due)) as chunks, 1::bigint as failed, false as success, 1 as exit_code,
  case when not dry_run then (select count(*) from edges) end as edges from (values (false), (true)) t(dry_run)"""),
}
ORACLE_SQL["a27_store"] = sql("markdown", _CONTENT.replace("select doc_id, row_number()", "select doc_id, content_sha256, position from (select doc_id, row_number()").rstrip() + ")")
_ART = _SECTION.replace("from cut where len(h) = 0", "from cut where doc_id % 4 <> 0 and (len(h) = 0").replace("<> ''\n  union all select doc_id, h[i]", "<> '')\n  union all select doc_id, h[i]").replace("where i <= len(h))", "where doc_id % 4 <> 0 and i <= len(h))") + r""",
every as (select doc_id, section, no, content from sec union all select doc_id, 'given', 0, body from markdown where doc_id % 4 = 0),
tk as (select *, regexp_extract_all(content, '(?:\A\s+)?\S+\s*') as t from every),
win as (select *, unnest(case when len(t) > 500 then range(0, len(t), 450) else [0] end) as start from tk),
piece as (select doc_id, section, no, (start // 450)::int as w, case when len(t) > 500 then array_to_string(t[start + 1:start + 500], '') else content end as content from win)"""
ORACLE_SQL["a21_artifacts"] = sql("markdown", _ART + """
select 'ingested/' || source || '/' || doc_id || '.md' as file_path, section, case when doc_id % 3 <> 0 then lang end as project, 'T' || doc_id as title, w as "window", 'hashed-8' as embedding_model, sha256(content) as content_sha256 from piece join markdown using (doc_id)
union all select 'ingested/' || source || '/' || doc_id || '.md', 'given', 'other', 'old', 0, 'm', sha256('old text') from markdown where doc_id % 8 = 0 and doc_id % 3 <> 0""".replace("select 'ingested", " select 'ingested", 1))
ORACLE_SQL["t3_ingest_stream"] = "with markdown as (select doc_id, source, lang, text as body from documents),\n" + _ART + """
select 'ingested/' || source || '/' || doc_id || '.md' as path, no, section, w as "window", sha256(content) as content_sha256 from piece join markdown using (doc_id)"""
