"""Commits of streams, state that ends, ranks without one task, listings, HTML, refresh and repair, guards on vectors."""

import datetime as dt
import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from lodestone.functions import markup
from lodestone.functions.ranks import order_statistic, ranked_within
from lodestone.operators import corpus, graph, query_log, retrieval, upkeep
from lodestone.sources.listing import contents, listed, write_files
from lodestone.sources.manifest import Manifest
from lodestone.streaming import feeds, run_state

INTERACTIONS = "workspace_id string, episode_id long, peer_id string, summary string, occurred_at timestamp, facts array<string>"


def interactions(spark, *ids):
    return spark.createDataFrame([("w", i, f"p{i % 2}", f"s{i}", dt.datetime(2024, 1, 1 + i), [f"fact {i}"]) for i in ids], INTERACTIONS)


def test_a_batch_of_interactions_is_seen_whole_or_not_at_all(spark, tmp_path):
    store = Manifest(spark, f"file://{tmp_path}/memory")
    feeds.remember(store, interactions(spark, 1, 2), 0)
    broken = interactions(spark, 3).withColumn("facts", F.array(F.raise_error(F.lit("no fact")).cast("string")))
    with pytest.raises(Exception, match="no fact"):  # the episodes are written by then, the facts are not
        feeds.remember(store, broken, 1)
    read = lambda t: feeds.newest_peers(store.read(t)) if t == "peers" else store.read(t)
    told = lambda: {t: sorted(str(r[0]) for r in read(t).select({"episodes": "episode_id", "facts": "fact", "peers": "updated_at"}[t]).collect()) for t in ("episodes", "facts", "peers")}
    assert told() == {"episodes": ["1", "2"], "facts": ["fact 1", "fact 2"], "peers": ["2024-01-02 00:00:00", "2024-01-03 00:00:00"]}
    for _ in range(2):  # run again after the failure, and once more
        feeds.remember(store, interactions(spark, 3), 1)
    assert told() == {"episodes": ["1", "2", "3"], "facts": ["fact 1", "fact 2", "fact 3"], "peers": ["2024-01-03 00:00:00", "2024-01-04 00:00:00"]}


SNAPSHOT = "run_id long, ts timestamp, seq long, node_runs array<struct<node:string,status:string>>, cancelled boolean, halted boolean, failure boolean, completion boolean"


def test_finished_runs_leave_the_state_and_are_not_revived(spark, tmp_path):
    """Batches a day apart: (run, hour, status); state rows are counted after each."""
    own = run_state.stream_session(spark)
    batches = [[(1, 0, "running"), (2, 0, "running")], [(1, 24, "success"), (3, 24, "running")], [(1, 12, "running"), (2, 48, "running")], [(4, 120, "running")], [(1, 20, "running"), (5, 121, "running")], [(6, 122, "running")]]
    for n, rows in enumerate(batches):
        made = [(r, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), n, [("a", s)], False, False, False, False) for r, h, s in rows]
        own.createDataFrame(made, SNAPSHOT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{n}")
    seen, states = [], []
    reader = own.readStream.schema(SNAPSHOT).option("recursiveFileLookup", "true")
    os.makedirs(f"{tmp_path}/feed")
    stream = run_state.last_status(reader.parquet(f"{tmp_path}/feed"), late="1 day", settled=dt.timedelta(days=1), silent=dt.timedelta(days=3))
    for n in range(len(batches)):
        for f in os.listdir(f"{tmp_path}/in/{n}"):
            if f.endswith(".parquet"):
                shutil.copy(f"{tmp_path}/in/{n}/{f}", f"{tmp_path}/feed/{n}-{f}")
        q = stream.writeStream.outputMode("update").foreachBatch(lambda b, _, n=n: seen.extend((n, r["run_id"], r["status"]) for r in b.collect())).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        states.append(q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert sorted(seen) == [(0, 1, "running"), (0, 2, "running"), (1, 1, "succeeded"), (1, 3, "running"), (2, 2, "running"), (3, 4, "running"), (4, 5, "running"), (5, 6, "running")]
    # run 1 goes a day after it ended and its late snapshot brings nothing back, run 3 after three silent days; 2, 4, 5 and 6 stay
    assert states == [2, 3, 3, 2, 3, 4]


@pytest.mark.parametrize("parts", [1, 3])
def test_ranks_equal_the_window(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 5), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, n long, i long").repartition(parts)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 7)
    try:
        ranked = ranked_within(df, ["g"], [F.desc("n"), F.col("i").asc()])
        got = {r["i"]: r["place"] for r in ranked.collect()}
        plan = ranked._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = {}
    for g in ("a", "b", None):
        for k, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))):
            want[i] = k + 1
    assert got == want and "Window" not in plan
    assert ranked_within(df.limit(0), ["g"], [F.desc("n")]).collect() == []


def test_order_statistic_equals_percentile(spark):
    for xs in ([], [3.0], [1.0, 2.0], [5.0, 1.0, 1.0, 9.0, 2.5, 2.5, None]):
        df = spark.createDataFrame([(x,) for x in xs], "x double")
        r, w = order_statistic(df, "x", 0.25).first(), df.agg(F.count("x").alias("n"), F.percentile("x", 0.25).alias("q")).first()
        assert (r["n"], r["quantile"]) == (w["n"], pytest.approx(w["q"]) if w["q"] is not None else None)


def test_files_are_written_listed_and_read(spark, tmp_path):
    files = {"docs/a.md": "é\r\nx", "docs/_b.md": "b", "deep/er/c.mdx": "", ".git/d.md": "d", "x/target/e.md": "e", "x/target.md": "f", "g.txt": "g", "y/.h/i.md": "i"}
    root = f"file://{tmp_path}/root"
    write_files(spark.createDataFrame(list(files.items()), "path string, content string").repartition(3), root)
    assert {r["path"]: r["length"] for r in listed(spark, root).collect()} == {p: len(t.encode()) for p, t in files.items()}
    w = corpus.discover_workspace(listed(spark, root))
    assert {r["path"]: r["content"] for r in contents(root, w).collect()} == {p: files[p] for p in ("docs/a.md", "docs/_b.md", "deep/er/c.mdx", "x/target.md")}
    assert listed(spark, root).where("mtime is null").count() == 0


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>a<b>b</b></p>", ("a b", "ok")),
        ("<nav>x<nav>y</nav>z</nav><p>kept</p>", ("kept", "ok")),
        ("<script>if (a < b && c > d) '<p>no</p>'</script>yes", ("yes", "ok")),
        ("<nav>never closed <p>text</p>", ("never closed text", "fallback_used")),
        ("<head><title>t</title><body>b", ("b", "ok")),
        ("a</nav> b<br/>c<img src='x>y'>d", ("a b c d", "ok")),
        ("&eacute;&#x41;&#66;&nbsp;&lt;p&gt; &amp;lt; &notanentity;", ("éAB <p> &lt; ¬anentity;", "ok")),
        ("<nav><script>x</nav></script>n</nav>after", ("after", "ok")),
        ("<style>p{}</style><!-- c -->", ("", "failed")),
        ("", ("", "failed")),
        (None, ("", "failed")),
        ("<<p>> <![CDATA[x]]> <?pi?> a < b", None),
    ],
)
def test_article(html, want):
    got = markup.article(html)
    assert want is None or got == want


def test_articles_whose_titles_are_cut_within_a_reference(spark, tmp_path):
    import duckdb

    from lodestone import catalog

    refs = ["&quot", "&lt", "&gt", "&copy", "&nbsp", "&middot", "&#39", "&amp", "&quo", "&am", "&", "&amp;quot;", "&quot;", "&copy=1", "&ltx;", "&lt;b&gt;", "&#39;", "&nbsp;&middot;", "\ue000&quot"]
    pages = [(10 * i + last, f"<head><title>t {x}</title></head><body><h1>t {x}</h1><p>{x} text {x}") for i, x in enumerate(refs) for last in (1, 3)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(map(tuple, catalog.QUERIES["a25_article_text"](spark, str(tmp_path)).collect()))
    assert got == sorted(duck.sql(catalog.ORACLE_SQL["a25_article_text"]).fetchall())
    assert markup.article("<p>&ltimes; 1 &lt 2 &quot") == ("\u22c9 1 &lt 2 &quot", "ok")


def tables(spark):
    index = spark.createDataFrame([(1, "d1", "a.md", "s", None, "m1", dt.datetime(2024, 1, 5)), (2, "d2", "b.md", "s", None, "m1", dt.datetime(2024, 1, 1)), (3, "d3", "gone.md", "s", None, "m2", dt.datetime(2024, 1, 5)), (4, "d4", "gone.md", "s", "client", "m1", dt.datetime(2024, 1, 5))], "id long, doc_id string, file_path string, section string, client_slug string, embedding_model string, indexed_at timestamp").withColumn("project", F.lit("p"))
    files = spark.createDataFrame([("a.md", dt.datetime(2024, 1, 3)), ("b.md", dt.datetime(2024, 1, 3)), ("bad.md", dt.datetime(2024, 1, 3))], "path string, mtime timestamp")
    edges = spark.createDataFrame([("d1", "b", None), ("d2", "a", "d1")], upkeep.EDGES)
    return index, files, edges


def payload(**more):
    return json.dumps({"version": "2", "nodes": [{"id": "d1", "doc_id": "d1", "scope": "x"}], "edges": [{"from": "d1", "to_ref": "b", "target_doc_id": "d2"}, {"from": "ghost", "to_ref": "z"}]} | more)


def test_refresh_commits_index_edges_and_errors_together(spark, tmp_path):
    index, files, edges = tables(spark)
    store = Manifest(spark, f"file://{tmp_path}/c")
    store.commit(replace={"index": index, "edges": edges})
    cut = lambda due: due.select(F.lit(9).cast("long").alias("id"), F.lit("d9").alias("doc_id"), F.col("path").alias("file_path"), F.lit("s").alias("section"), F.lit(None).cast("string").alias("client_slug"), F.lit("m1").alias("embedding_model"), F.col("mtime").alias("indexed_at"), F.lit("p").alias("project"))
    failed = spark.createDataFrame([("bad.md", "no header")], "path string, error string")
    payloads = spark.createDataFrame([(payload(),)], "payload string")
    dry = upkeep.refresh(store, files, cut, failed, payloads, dry_run=True).first()
    assert (dry["version"], dry["due"], dry["chunks"], dry["edges"], dry["exit_code"]) == (1, 1, 1, None, 1) and store.versions() == [1]
    done = upkeep.refresh(store, files, cut, failed, payloads).first()
    assert (done["version"], done["due"], done["failed"], done["success"], done["edges"]) == (2, 1, 1, False, 1)
    assert sorted(r["id"] for r in store.read("index").collect()) == [1, 3, 4, 9]
    assert {tuple(r) for r in store.read("errors").collect()} == {("parse", "bad.md", "no header"), ("edge", "ghost", "unknown source")}
    changed = {r["id"]: r["change"] for r in upkeep.difference(store.read("index", 1), store.read("index", 2), ["id"]).collect()}
    assert changed == {2: "removed", 9: "added"}
    bad = upkeep.refresh(store, files, cut, failed.limit(0), spark.createDataFrame([(payload(version="1"),)], "payload string")).first()
    assert bad["exit_code"] == 1 and [tuple(r) for r in store.read("edges").collect()] == [("d1", "b", "d2")]  # the old edges stay
    again = upkeep.refresh(store, files, cut, failed.limit(0), rebuild=spark.createDataFrame([("p",)], "slug string")).first()
    assert again["due"] == 3 and again["success"] and sorted(r["file_path"] for r in store.read("index").collect()) == ["a.md", "b.md", "bad.md", "gone.md"]


def test_repair_tells_what_became_of_each_finding(spark, tmp_path):
    index, files, edges = tables(spark)
    content = spark.createDataFrame([(1, 0, "m1"), (1, 1, "m1"), (2, 1, "m1")], "doc_id long, position int, embedding_model string")
    store = Manifest(spark, f"file://{tmp_path}/c")
    store.commit(replace={"index": index, "edges": edges, "content": content})
    current = spark.createDataFrame([("a.md", "other"), ("b.md", "s")], "path string, section string")
    found = {(r["axis"], r["key"], r["detail"]): r["outcome"] for r in upkeep.repair(store, files, current, spark.createDataFrame([(payload(),)], "payload string"), "m1").collect()}
    assert found == {("deleted", "gone.md", ""): "repaired", ("section", "a.md", "s"): "manual", ("orphan_chunk", "2", ""): "repaired", ("dangling", "d1", "b"): "repaired", ("model", "index", "1"): "repaired"}
    assert sorted(r["id"] for r in store.read("index").collect()) == [1, 2, 4] and store.versions() == [1, 2]


def test_edges_of_payloads_behind_a_shuffle_keep_their_nodes(spark):
    made = [(json.dumps({"version": "2", "nodes": [{"id": "n", "doc_id": f"d{i}", "scope": None}], "edges": [{"from": "n", "to_ref": f"r{i}"}]}),) for i in range(200)]
    rows, skipped, rejected = graph.edge_rows(spark.createDataFrame(made, "payload string").repartition(7, F.rand()))
    assert {(r["source_doc_id"], r["to_ref"]) for r in rows.collect()} == {(f"d{i}", f"r{i}") for i in range(200)}
    assert skipped.count() == 0 == rejected.count()


def test_windows_are_read_and_refused(spark):
    log = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), True), (2, dt.datetime(2024, 1, 2), False), (3, None, True)], "id long, created_at timestamp, abstained boolean")
    at = F.lit(dt.datetime(2024, 1, 3))
    ids = lambda *a: sorted(r["id"] for r in query_log.read_window(log, *a).collect())
    assert ids("1d", at) == [2] and ids(" 48h ", at) == [1, 2] and ids("2d", at, True) == [1] and ids("0d", at) == []
    for w in ("7", "d7", "7w", "", "-1d", "1.5h"):
        with pytest.raises(ValueError):
            query_log.read_window(log, w, at)


def test_vectors_of_another_model_fail_the_job_and_what_is_no_number_is_left_out(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], "m1"), (2, [0.0, 1.0], None), (3, [nan, 1.0], "m1"), (4, [0.0, 0.0], "m1"), (5, None, "m1")]
    items = spark.createDataFrame(rows, "id long, embedding array<double>, embedding_model string")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [nan, 0.0]), (3, [0.0, 0.0]), (4, None)], "qid long, qvec array<double>")
    got = retrieval.semantic(queries, retrieval.stamped(items, "m1"), 9).collect()
    assert sorted((r["qid"], r["id"], round(r["distance"], 9)) for r in got) == [(1, 1, 0.0), (1, 2, 1.0)]
    everything = retrieval.scored(queries, items, 9, keep_missing=True).collect()
    assert len(everything) == 20 and all(r["score"] == 0 for r in everything if (r["qid"], r["id"]) != (1, 1))
    with pytest.raises(Exception, match="can't be compared with one of m9"):
        retrieval.semantic(queries, retrieval.stamped(items.unionByName(items.where("id = 1").withColumn("embedding_model", F.lit("m9"))), "m1"), 9).collect()
