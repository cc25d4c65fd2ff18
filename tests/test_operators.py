"""Operators on small frames with known results."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.operators import chunking, corpus, evaluation, graph, grounding, memory, query_log, reconcile, retrieval, runs
from lodestone.streaming import feeds

T0 = dt.datetime(2024, 6, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("k, n, lo, hi", [(15, 17, 0.6566, 0.9671), (15, 15, 0.7961, 1.0), (22, 23, 0.7901, 0.9923)])
def test_wilson(spark, k, n, lo, hi):
    a, b = S.wilson(F.lit(k), F.lit(n))
    assert one(spark, a) == pytest.approx(lo, abs=1e-4) and one(spark, b) == pytest.approx(hi, abs=1e-4)


def test_wilson_of_nothing(spark):
    assert one(spark, S.wilson(F.lit(0), F.lit(0))[0]) is None


@pytest.mark.parametrize("a, b, p", [(1, 0, 1.0), (3, 0, 0.25), (5, 0, 0.0625), (6, 0, 0.03125), (7, 0, 0.015625), (5, 1, 0.21875), (4, 2, 0.6875), (0, 0, 1.0)])
def test_sign_test(spark, a, b, p):
    assert one(spark, S.sign_test(F.lit(a), F.lit(b))) == pytest.approx(p)


def test_weeks_and_decay(spark):
    weeks = S.weeks_between(F.lit(T0), F.lit(T0 + dt.timedelta(days=20)))
    assert one(spark, weeks) == 2
    assert one(spark, S.weeks_between(F.lit(T0), F.lit(T0 - dt.timedelta(days=20)))) == 0
    assert one(spark, S.decayed(F.lit(0.9), F.lit(0.95), weeks)) == pytest.approx(0.9 * 0.95**2)


def test_angled_vectors_come_in_order(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], "x")], "qid long, qvec array<double>, query string")
    rows = [(i, [math.cos(i / 10), math.sin(i / 10)]) for i in (5, 2, 9, 1)] + [(77, None), (78, [0.0, 0.0])]
    items = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = retrieval.semantic(q, items, 3).orderBy("rn").collect()
    assert [r["id"] for r in got] == [1, 2, 5]
    assert got[0]["distance"] == pytest.approx(1 - math.cos(0.1))
    everything = memory.rank_facts(q, items.withColumnRenamed("id", "fact_id"), 6, scope=None).orderBy("rn").collect()
    assert {r["id"] for r in everything[-2:]} == {77, 78} and everything[-1]["score"] == 0.0


def test_neighbours_stay_within_the_scope(spark):
    chunks = spark.createDataFrame([(i, f"d{i}", p, [1.0, i / 10]) for i, p in enumerate(["a", "a", "b", None])], "id long, doc_id string, project string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], None), (3, [1.0, 0.0], "b")], "qid long, qvec array<double>, scope string")
    edges = spark.createDataFrame([("d0", f"d{i}") for i in range(1, 4)] + [("d2", "d0")], "source_id string, target_id string")
    found = retrieval.semantic(q, chunks, 1)
    got = lambda q: {(r["qid"], r["id"]) for r in retrieval.structural(found, q, chunks, edges).collect()}
    assert got(q) == {(1, 1), (2, 1), (2, 2), (2, 3)}
    assert got(q.drop("scope")) == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 0)}


def test_diversity_against_plain_python(spark):
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["a", "b", None]), rng.randint(0, 6) / 7) for i in range(30)]
    got = [r["id"] for r in retrieval.diverse(spark.createDataFrame(rows, "qid long, id long, file_path string, score double"), 12).orderBy("rank").collect()]
    first, rest, n = [], [], {}
    for _, i, f, s in sorted(rows, key=lambda r: (-r[3], r[1])):
        n[f] = n.get(f, 0) + 1
        (first if f is None or n[f] <= 2 else rest).append(i)
    assert got == (first + rest)[:12]


def test_filters_ignore_unknown_and_none(spark):
    c = spark.createDataFrame([(1, "a", ["x"]), (2, "b", ["y"])], "id long, project string, layer array<string>")
    assert retrieval.filtered(c, {"project": None, "nope": 1, "layer": "y"}).collect()[0]["id"] == 2


def test_confidence_of_nothing_is_zero(spark):
    q = spark.createDataFrame([(1,)], "qid long")
    r = spark.createDataFrame([], "qid long, rank int, score double")
    assert retrieval.confidence(q, r).first()["confidence"] == 0.0


def test_walk_is_cycle_safe(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", None)], "source_id string, target_id string")
    got = {(r["node"], r["level"]) for r in graph.walk(spark.createDataFrame([("a",)], "root string"), e, 9).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2)}


def test_citations(spark):
    a = spark.createDataFrame([(1, "the quick brown fox jumps", ["# Intro ", "gone", "other"], True)], "answer_id long, answer string, cited_sections array<string>, high_stakes boolean")
    c = spark.createDataFrame([(1, 1, "intro", "old", "f1"), (1, 2, "Intro", "quick brown fox", "f2"), (1, 3, "Other", "nothing here", "f3")], "answer_id long, rank int, section_title string, content string, file_path string")
    checks = grounding.check_citations(a, c)
    got = [(r["verified"], r["reason"]) for r in checks.orderBy("place").collect()]
    assert got == [(True, None), (False, "not_found"), (False, "unsupported")]
    env = grounding.envelope(a, checks, spark.createDataFrame([(1, 3)], "answer_id long, n_chunks int")).first()
    assert (env["withheld"], env["corroborated"], env["escalate"]) == (False, False, True)


def test_topics_keep_order(spark):
    got = one(spark, grounding.add_topics(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"), F.lit("a"), F.lit("c"))))
    assert got == ["a", "b", "c", "c"]


def test_two_contradictions_halve_twice(spark):
    f = spark.createDataFrame([(1, 0.8, 0.95, T0 - dt.timedelta(days=15)), (2, 0.8, 0.95, T0)], "fact_id long, confidence double, decay_factor double, updated_at timestamp")
    hits = spark.createDataFrame([(1,), (1,), (9,)], "fact_id long")
    got = {r["fact_id"]: r for r in memory.contradict(f, hits, F.lit(T0)).collect()}
    assert got[1]["confidence"] == pytest.approx(0.8 * 0.95**2 * 0.25) and got[1]["updated_at"] == T0
    assert got[2]["confidence"] == 0.8


def test_consolidation(spark):
    u = "0a1b2c3d-0000-4000-8000-00000000000a"
    peers = spark.createDataFrame([("p", "old")], "peer_id string, representation string")
    f = spark.createDataFrame([(u, 0.8, 0.95, T0)], "fact_id string, confidence double, decay_factor double, updated_at timestamp")
    r = spark.createDataFrame([("p", "x", u, "new"), ("p", "y", "no-uuid", None), ("ghost", "z", None, None)], "peer_id string, fact string, contradicts string, representation string")
    p, old, new = memory.consolidation_apply(peers, f, r, F.lit(T0))
    assert p.first()["representation"] == "new" and old.first()["confidence"] == pytest.approx(0.4) and new.count() == 2


def test_low_threshold_of_few(spark):
    rows = [(f"q{i}", 2, c, T0, (i, c < 0)) for i, c in enumerate([1.0, 2.0, 4.0, 9.0])]
    c = spark.createDataFrame(rows, "query string, n long, confidence double, last_seen timestamp, latest struct<id:long,abstained:boolean>")
    assert query_log.low_threshold(c).first()["low"] == 1.75
    assert query_log.low_threshold(c.where("confidence > 1")).first()["low"] == 2.0
    assert query_log.low_threshold(c.limit(0)).first()["low"] is None


@pytest.mark.parametrize("text, days", [("15", 15), ("0", 90), ("-3", 90), ("x", 90), (None, 90)])
def test_keep_days(text, days):
    assert query_log.keep_days(text) == days


def test_cutoff_row_is_kept(spark):
    log = spark.createDataFrame([(1, T0 - dt.timedelta(days=10)), (2, T0 - dt.timedelta(days=10, seconds=1)), (3, None)], "id long, created_at timestamp")
    kept, counts = query_log.retained(log, F.lit(T0), 10)
    assert {r["id"] for r in kept.collect()} == {1, 3} and counts.first()["deleted"] == 1


def test_sections_and_headers(spark):
    text = "# Top\nintro\n\n## One\nbody of one that is long enough to stay as a section\n### Two\n## Three\nx"
    got = chunking.sections(spark.createDataFrame([(1, text), (2, "no headers"), (3, None)], "doc_id long, body string")).orderBy("doc_id", "no").collect()
    assert [r["section"] for r in got] == ["", "## One", "### Two", "## Three", "", ""]
    assert got[1]["content"].startswith("## One\nbody")


def test_windows_overlap(spark):
    text = " ".join(str(i) for i in range(1000))
    got = chunking.windows(spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, t string"), "t", ["doc_id"]).orderBy("doc_id", "window").collect()
    assert [r["window"] for r in got] == [0, 1, 2, 0]
    assert got[1]["content"].split()[0] == "450" and got[2]["content"].split()[-1] == "999"


def test_content_chunks_positions(spark):
    got = chunking.content_chunks(spark.createDataFrame([(1, "pre\n# A\nbody\n## B\n")], "doc_id long, body string")).orderBy("position").collect()
    assert [(r["position"], r["is_section_title"], r["content"]) for r in got] == [(0, False, "pre\n"), (1, True, "A"), (2, False, "\nbody\n"), (3, True, "B")]


def test_frontmatter(spark):
    rows = [("a/x.md", "---\ntitle: T\nlayer: Product\nkeywords: []\n---\nbody"), ("a/y.md", "plain"), ("a/z.md", "---\n: [\n---\nb"), ("a/w.md", None)]
    got = {r["path"]: r for r in chunking.normalised(chunking.parse_documents(spark.createDataFrame(rows, "path string, content string"))).collect()}
    assert got["a/x.md"]["layer"] == ["product"] and got["a/x.md"]["keywords"] is None and got["a/x.md"]["body"] == "body"
    assert got["a/y.md"]["doc_id"] == "y" and got["a/y.md"]["parse_error"] is None
    assert got["a/z.md"]["parse_error"] is not None


def test_dated_log(spark):
    text = "## [run: 2026-01-02]\n### First\nbody\n---\n### 2026-01-01 (Own)\nx\n## 2026-02-03 (Entry)\ny\n## 2026-03-04\n### Later\n"
    got = chunking.log_entries(spark.createDataFrame([(1, "### Undated\n" + text)], "doc_id long, body string")).orderBy("entry").collect()
    assert [(r["date"], r["title"], r["body"]) for r in got] == [("2026-01-02", "First", "body"), ("2026-01-01", "Own", "x"), ("2026-02-03", "Entry", "y"), ("2026-03-04", "Later", "")]


def test_wrong_width_fails(spark):
    df = spark.createDataFrame([("a",)], "t string")
    with pytest.raises(Exception, match="another count or width"):
        chunking.embedded(df, "t", lambda texts: [[1.0]] * len(texts), 3, "m").collect()


def test_equal_times_are_read_again_but_not_stale(spark):
    files = spark.createDataFrame([("a", T0), ("b", T0)], "path string, mtime timestamp")
    index = spark.createDataFrame([("a", T0)], "file_path string, indexed_at timestamp")
    assert {r["path"] for r in corpus.to_index(files, index).collect()} == {"a", "b"}
    assert {r["path"] for r in corpus.stale(files, index).collect()} == {"b"}


def test_group_replace_keeps_duplicates(spark):
    old = spark.createDataFrame([("k", 1), ("k", 2), ("z", 3)], "key string, v int")
    new = spark.createDataFrame([("k", 8), ("k", 8)], "key string, v int")
    assert sorted(r["v"] for r in corpus.replaced(old, new, ["key"]).collect()) == [3, 8, 8]


def test_repository(spark):
    r = corpus.Repository(spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"))
    assert r.exists(name="a") and not r.exists(name="a", id=2) and r.count() == 2 and r.latest(1).first()["id"] == 2
    assert r.delete(r.get(1).select("id")).first()["id"] == 2


def test_null_stamp_is_no_mismatch(spark):
    t = spark.createDataFrame([("m",), (None,), ("old",)], "embedding_model string")
    got = reconcile.model_mismatch({"t": t}, "m").first()
    assert (got["mismatched"], got["unstamped"]) == (1, 1)


@pytest.mark.parametrize(
    "nodes, flags, status",
    [
        (None, (0, 0, 0, 0), "queued"), ([], (0, 0, 0, 0), "running"), (["failed"], (1, 1, 0, 0), "cancelled"), (["failed"], (0, 1, 0, 0), "halted"), (["failed", "success"], (0, 0, 0, 1), "failed"),
        (["pending"], (0, 0, 0, 1), "succeeded"), (["success", "running"], (0, 0, 0, 0), "running"), (["success"], (0, 0, 0, 0), "succeeded"), (["success", "pending"], (0, 0, 0, 0), "running"),
    ],
)
def test_run_status(spark, nodes, flags, status):
    n = None if nodes is None else [(x,) for x in nodes]
    df = spark.createDataFrame([(n, *map(bool, flags))], "node_runs array<struct<status:string>>, cancelled boolean, halted boolean, failure boolean, completion boolean")
    assert runs.with_status(df).first()["status"] == status


def test_exact_bootstrap_gives_the_bounds_of_a_seeded_run(spark):
    """Drawn by hand: one generator for all resamples, bounds at the rounded places."""
    x = [0.1, 0.9, 0.4, 0.4, 0.7]
    v = spark.createDataFrame([("m", i, y) for i, y in enumerate(x)], "metric string, case_id long, value double")
    rng, means = random.Random(3), []
    for _ in range(200):
        means.append(sum(x[rng.randrange(5)] for _ in range(5)) / 5)
    means.sort()
    got = evaluation.bootstrap_exact(v, 3, 200).first()
    assert (got["lo"], got["hi"], got["n"]) == (means[5], means[194], 5)
    assert evaluation.places(200) == (5, 194) and evaluation.places(10_000) == (250, 9749)


def values_of(spark, base, current, metric):
    rows = [(run, i, metric, float(y)) for run, x in (("base", base), ("current", current)) for i, y in enumerate(x) if y is not None]
    return spark.createDataFrame(rows, "run string, case_id long, metric string, value double")


@pytest.mark.parametrize(
    "metric, base, current, verdict",
    [
        ("groundedness", [0.9] * 40, [0.901] * 30 + [0.0] * 10, "regressed-significant"),
        ("mrr", [0.5] * 30, [0.7] * 30, "improved-significant"),
        ("mrr", [0.5, 0.5, 0.5, 0.5], [1.0, 0.4, 0.3, 0.5], "improved-within-noise"),
        ("mrr", [0.5, 0.2], [0.5, 0.2], "flat"),
        ("recall_at_5", [1, 1, 0, 0, 1], [0, 0, 1, 1, 1], "flat"),
        ("recall_at_5", [1] * 10, [0] * 10, "regressed-significant"),
        ("recall_at_5", [1] * 10, [0] * 3 + [1] * 7, "regressed-within-noise"),
        ("recall_at_5", [0] * 10, [1] * 8 + [0] * 2, "improved-significant"),
        ("recall_at_5", [1, 1, 1], [0, 0, None], "incomparable"),
    ],
)
def test_paired_verdicts(spark, metric, base, current, verdict):
    got = evaluation.paired(values_of(spark, base, current, metric), 3, 400).first()
    assert got["verdict"] == verdict
    assert (got["p"] is None) == (metric == "mrr" or metric == "groundedness")


def test_one_case_set_for_all_metrics(spark):
    """A case that one run lacks makes every metric incomparable, also those that the case has no part in."""
    v = values_of(spark, [1, 0], [1, 0], "recall_at_5").union(values_of(spark, [1, 0, 1], [1, 0, None], "abstain_correct"))
    assert {r["verdict"] for r in evaluation.paired(v, 3, 50).collect()} == {"incomparable"}
    assert [tuple(r) for r in evaluation.case_changes(v).collect()] == [(2, "removed")]
    assert evaluation.gate(evaluation.paired(values_of(spark, [1] * 10, [0] * 10, "recall_at_5"), 3, 50)).first()["failed"]



SESSION = "session long, turn long, at timestamp, content string, topics array<string>"


def test_stream_keeps_late_turn_in_order(spark, tmp_path):
    for i, turns in enumerate(([2, 3], [1])):
        spark.createDataFrame([(7, t, T0, str(t), []) for t in turns], SESSION).coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
    s = spark.readStream.schema(SESSION).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = []
    feeds.drained(feeds.append_session_turns(s), lambda b, n: out.extend(b.collect()), "update")
    assert out[-1]["turns"] == 3 and out[-1]["last"] == 3


def test_versions_and_reports(spark, tmp_path):
    from lodestone.sources.shared import VersionedTable, read_report, write_report

    t = VersionedTable(spark, f"{tmp_path}/t")
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    assert t.versions() == [] and t.write(df) == 1
    assert t.write(t.read().unionByName(df)) == 2 and t.read().count() == 2
    (tmp_path / "t" / "v=3").mkdir()
    assert t.versions() == [1, 2]
    write_report(df, f"{tmp_path}/r")
    assert read_report(spark, f"{tmp_path}/r", df.schema).collect() == df.collect()


@pytest.mark.parametrize(
    "text, want",
    [
        ("## One\n\nbody\n\n", [("## One", "## One\nbody")]),
        ("", [("", "")]),
        (None, [("", "")]),
        (" only text ", [("", "only text")]),
        ("lead\n\n## A\n### B\nb", [("", "lead"), ("## A", "## A"), ("### B", "### B\nb")]),
        ("# Top\n#### deep\n##x", [("", "# Top\n#### deep\n##x")]),
        ("\n\n## A\nx", [("## A", "## A\nx")]),
    ],
)
def test_sections_keep_header_and_stripped_body(spark, text, want):
    docs = spark.createDataFrame([("d", text)], "doc_id string, body string")
    assert [(r["section"], r["content"]) for r in chunking.sections(docs).orderBy("no").collect()] == want


def test_content_chunks_keep_bodies_as_they_stand(spark):
    body = " ".join(f"w{i}" for i in range(480))
    docs = spark.createDataFrame([("d", f"lead \n# T\n\n{body}\n##  \n### U")], "doc_id string, body string")
    got = [(r["section_title"], r["is_section_title"], r["content"]) for r in chunking.content_chunks(docs).orderBy("position").collect()]
    assert got[0] == (None, False, "lead \n") and got[1] == ("T", True, "T") and got[2] == ("T", False, f"\n\n{body}\n")
    assert got[3] == ("T", False, " ".join(f"w{i}" for i in range(450, 480)) + "\n") and got[4] == ("### U", True, "### U") and len(got) == 5


def test_log_entries_of_every_heading_shape(spark):
    log = """### stray
## [run: 2026-01-02]
dropped
### first
body
---
## Notes 2026-02-02 extra
kept
### second
## [2026-03-03]
### 2025-12-31 (own date)
x
## 2026-04-04 (titled)

y
## No date here
z
"""
    docs = spark.createDataFrame([("d", log)], "doc_id string, body string")
    got = [(r["date"], r["title"], r["body"]) for r in chunking.log_entries(docs).orderBy("entry").collect()]
    assert got == [
        ("2026-01-02", "first", "body"), ("2026-02-02", "Notes 2026-02-02 extra", "kept"), ("2026-02-02", "second", ""), ("2025-12-31", "own date", "x"),
        ("2026-04-04", "titled", "y"), ("2026-04-04", "No date here", "z"),
    ]


def files_in_order(spark, tmp_path, frames):
    """A stream that reads one frame a batch."""
    import os
    import time

    for n, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        names = [f for f in os.listdir(f"{tmp_path}/in") if f.endswith(".parquet")]
        newest = max(names, key=lambda f: os.stat(f"{tmp_path}/in/{f}").st_mtime_ns)
        os.utime(f"{tmp_path}/in/{newest}", (time.time() - 1000 + 60 * n,) * 2)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")


def test_late_rows_of_closed_windows_are_dropped(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n, 12)
    frame = lambda *rows: spark.createDataFrame(list(rows), "created_at timestamp, abstained boolean")
    log = files_in_order(spark, tmp_path, [frame((day(1), True), (day(10), False)), frame((day(9), True)), frame((day(1), False)), frame((day(20), True))])
    feeds.drained(feeds.abstain_rates(log), feeds.by_batch(f"file://{tmp_path}/out"))
    got = {r["start"].day: (r["n"], r["rate"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {1: (1, 1.0), 9: (1, 1.0), 10: (1, 0.0)}


def test_session_turns_find_their_place(spark, tmp_path):
    at = lambda d: dt.datetime(2024, 1, d)
    frame = lambda *rows: spark.createDataFrame(list(rows), SESSION)
    turns = files_in_order(spark, tmp_path, [frame((1, 2, at(2), "b", ["y", "x"])), frame((1, 1, at(2), "a", ["x"]), (1, 2, at(2), "B", ["y"])), frame((2, 1, at(3), None, None))])
    feeds.drained(feeds.append_session_turns(turns), feeds.by_batch(f"file://{tmp_path}/out"), "update")
    got = {r["session"]: (r["turns"], r["last"], r["content"], r["topics"]) for r in feeds.current(spark.read.parquet(f"file://{tmp_path}/out"), ["session"]).collect()}
    assert got == {1: (2, 2, "a\nB", ["x", "y"]), 2: (1, 1, "", [])}


def test_edge_payload_faults(spark, tmp_path):
    ok = '{"version": "2", "nodes": [{"id": "a", "doc_id": "d", "scope": "s"}], "edges": [{"from": "a", "to_ref": "r", "target_doc_id": null}, {"from": "z", "to_ref": "q"}]}'
    texts = [ok, '{"version": "2", "nodes": []}', '{"version": "1", "nodes": [], "edges": []}', '{"version": "2", "nodes": {}, "edges": []}', '{"version": "2", "nodes": [], "edges": "x"}', "[1]", "{bad"]
    rows, skipped, rejected = graph.edge_rows(spark.createDataFrame([(t,) for t in texts], "payload string"))
    assert [tuple(r) for r in rows.collect()] == [("a", "d", "r", None, None, "related", "s")] and [r["from"] for r in skipped.collect()] == ["z"]
    assert sorted(r["fault"] for r in rejected.collect()) == ["edges is no list", "missing edges", "no object", "no object", "nodes is no list", "version 1"]
    from lodestone.sources.shared import VersionedTable

    table = VersionedTable(spark, f"file://{tmp_path}/edges")
    one = spark.createDataFrame([(ok,)], "payload string")
    assert graph.reload_edges(table, one) == graph.reload_edges(table, one) == 1 and table.versions() == [1, 2]
    with pytest.raises(ValueError, match="version 1"):
        graph.reload_edges(table, spark.createDataFrame([(texts[2],)], "payload string"))


def test_times_as_text(spark):
    t = ["2024-01-01T01:02:03.123456+00:00", "2024-01-01T01:02:03+0200", "2024-01-01", "2024-01-01T01:02Z", "x", "2024-13-01", None]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(t)), "i long, t string").orderBy("i").select(F.unix_micros(S.parsed_time(F.col("t")))).collect()]
    day = 1704067200000000
    assert got == [day + 3723123456, day + 3723000000 - 7200000000, day, day + 3720000000, None, None, None]


def test_words_of_any_length_are_found(spark):
    """Words of under three characters have keys of their own, however many there are; _ stands for any character."""
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("aBcé1 .") for _ in range(rng.randint(0, 9)))) for i in range(60)] + [(60, None), (61, "İ_x")]
    words = [a + b + c for a in "abcé1_" for b in ["", *"abé_"] for c in ["", *"aB_"]] + ["__a_b"]
    terms = [(k % 5, w) for k, w in enumerate(words)]
    found = retrieval.containing(spark.createDataFrame(rows, "id long, content string"), ["content"], spark.createDataFrame(terms, "qid long, word string"))
    got = sorted((r["id"], r["word"]) for r in found.collect())
    pattern = lambda w: re.compile("".join("." if c == "_" else re.escape(c) for c in w.lower()), re.S)
    want = sorted((i, w) for i, t in rows if t is not None and i < 60 for _, w in terms if pattern(w).search(t.lower()))
    assert [x for x in got if x[0] < 60] == want


def test_strip_is_that_of_the_pattern(spark):
    texts = ["", " a ", "\n\t x y \r\n", "\x0b\x0c", "é ", "a\u00a0", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r[0] == r[1] for r in df.select(S.strip(F.col("t")), F.regexp_replace("t", r"^\s+|\s+$", "")).collect())
