"""Manifests, stored text and vector indexes: whole commits, pruned reads, results equal to those without an index."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval, text_index, vector_index
from lodestone.sources.manifest import FOLDERS, Conflict, Manifest

CHUNKS = "id long, file_path string, title string, content string, status string"


def numbers(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "a long")


def values(df):
    return sorted(r["a"] for r in df.collect())


def test_a_commit_that_fails_between_two_tables_leaves_the_old_state(spark, tmp_path):
    m = Manifest(spark, f"file://{tmp_path}/m")
    assert m.commit(replace={"x": numbers(spark, 1, 2), "y": numbers(spark, 3)}) == 1
    with pytest.raises(Exception, match="no more"):
        m.commit(append={"x": numbers(spark, 7)}, replace={"y": numbers(spark, 1).selectExpr("cast(raise_error('no more') as long) as a")})
    assert m.versions() == [1] and values(m.read("x")) == [1, 2] and values(m.read("y")) == [3]
    assert m.vacuum(1, 0) == 0 and m.vacuum(1, 10**15) >= 1 and values(m.read("x")) == [1, 2]


def test_of_two_writers_on_one_state_the_second_is_told(spark, tmp_path):
    m = Manifest(spark, f"file://{tmp_path}/m")
    m.commit(replace={"x": numbers(spark, 1)})
    state = m.state()
    m.commit(append={"x": numbers(spark, 2)}, based_on=state)
    with pytest.raises(Conflict):
        m.commit(append={"x": numbers(spark, 3)}, based_on=state)
    assert values(m.read("x")) == [1, 2] and values(m.read("x", 1)) == [1]


def test_a_batch_that_comes_again_changes_nothing_and_appends_are_put_together(spark, tmp_path):
    m = Manifest(spark, f"file://{tmp_path}/m")
    for n in range(FOLDERS + 2):
        for _ in range(2):
            assert m.commit(append={"x": numbers(spark, n)}, writer="s", batch=n) == n + 1
    assert values(m.read("x")) == list(range(FOLDERS + 2)) and len(m.state()["tables"]["x"]["folders"]) == 2


def chunk_rows(seed, n=120):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "Été", "the", "k9", "delta", "of"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(rng.randint(0, k)))
    return [(i, f"f{i % 9}", text(4), None if i % 11 == 0 else text(20), rng.choice(["archived", None])) for i in range(n)]


def by_id_and_term(df):
    return {(r["id"], r["term"]): round(r["s"], 9) for r in df.collect()}


def test_text_index_equals_postings_and_a_rebuilt_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BUCKET_ROWS", 1)
    monkeypatch.setattr("lodestone.sources.generations.DELTAS", 3)
    rows = chunk_rows(1)
    chunks = spark.createDataFrame(rows, CHUNKS)
    index = text_index.TextIndex(spark, f"file://{tmp_path}/t", ("title", "content"))
    assert not index.exists()
    index.build(chunks)
    wanted = spark.createDataFrame([("alpha",), ("été",), ("absent",), (None,)], "term string")
    assert by_id_and_term(index.postings()) == by_id_and_term(retrieval.postings(chunks))
    assert by_id_and_term(index.postings(wanted, ("title",))) == by_id_and_term(retrieval.postings(chunks, ("title",), wanted))
    monkeypatch.setattr(text_index, "TERMS_HELD", 1)
    assert by_id_and_term(index.postings(wanted)) == by_id_and_term(retrieval.postings(chunks, wanted=wanted))
    for step in range(5):  # groups change, come and go, over a compaction
        groups = [f"f{step}", f"f{(step + 4) % 9}", f"new{step}"]
        new = [r for r in chunk_rows(10 + step) if r[1] == f"f{step}"] + [(1000 + step, f"new{step}", "alpha", "beta", None)]
        rows = [r for r in rows if r[1] not in groups] + new
        stray = [(5000, "elsewhere", "alpha", "", None)]
        index.update(spark.createDataFrame([(g,) for g in groups], "file_path string"), spark.createDataFrame(new + stray, CHUNKS))
        assert by_id_and_term(index.postings()) == by_id_and_term(retrieval.postings(spark.createDataFrame(rows, CHUNKS)))
    assert len(index.store.state()["tables"]["rows"]["folders"]) <= 3


def test_an_index_whose_files_are_gone_is_built_anew(spark, tmp_path):
    import shutil

    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/v")
    rows = spark.createDataFrame([(1, "f", [1.0, 0.0], "p", 1.0)], VECTORS)
    index.build(rows)
    assert index.exists()
    shutil.rmtree(f"{tmp_path}/v/data")
    assert not index.exists()
    index.build(rows)
    assert index.exists() and index.search(spark.createDataFrame([(7, [1.0, 0.0])], "qid long, qvec array<double>"), 3).count() == 1


def test_text_index_reads_the_buckets_of_its_terms_alone_and_shuffles_no_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BUCKET_ROWS", 1)
    index = text_index.TextIndex(spark, f"file://{tmp_path}/t", ("title", "content"))
    index.build(spark.createDataFrame(chunk_rows(2, 400), CHUNKS))
    buckets = index.store.state()["notes"]["buckets"]
    assert buckets > 100
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else pruned buckets aren't named in the plan
    try:
        found = index.postings(spark.createDataFrame([("alpha",), ("beta",)], "term string"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert f"SelectedBucketsCount: 2 out of {buckets}" in plan and "Exchange" not in plan
        queries = spark.createDataFrame([(1, "alpha beta")], "qid long, query string")
        joined = retrieval.query_terms(queries).join(index.postings(), "term")
        plan = joined.hint("merge")._jdf.queryExecution().executedPlan().toString()
        scan = plan.index("postings_")
        assert plan.count("Exchange hashpartitioning(term") <= 1 and "Exchange" not in plan[plan.rindex("\n", 0, scan) :]
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    # another session knows the tables by their folders alone
    other = spark.newSession()
    spark.catalog.listTables()
    for t in [t.name for t in spark.catalog.listTables() if t.name.startswith("postings_")]:
        spark.sql(f"DROP TABLE {t}")
    again = text_index.TextIndex(other, f"file://{tmp_path}/t", ("title", "content"))
    assert again.postings().count() == retrieval.postings(spark.createDataFrame(chunk_rows(2, 400), CHUNKS)).count()


def clustered(seed=4, n=3000, width=6, centres=12):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, width))
    x = c[rng.integers(0, centres, n)] + rng.normal(scale=0.05, size=(n, width))
    rows = [(i, f"f{i % 40}", x[i].tolist(), "p1" if i % 3 else "p2", 0.5 + (i % 7) / 10) for i in range(n)]
    odd = [None, [0.0] * width, [float("nan")] * width, [float("inf")] + [0.0] * (width - 1), [1.0]]
    return rows + [(n + i, "odd", v, "p1", 1.0) for i, v in enumerate(odd)] + [(n + 10 + i, "tie", rows[0][2], "p1", 0.5) for i in range(30)], c


VECTORS = "id long, file_path string, embedding array<double>, project string, w double"


def ranking(df):
    return sorted((r["qid"], r["rn"], r["id"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"same": ("scope", "project")}, {"weight": True, "keep_missing": True, "same": ("scope", "project")}])
def test_vector_index_equals_all_products(spark, tmp_path, options):
    rows, c = clustered()
    items = spark.createDataFrame(rows, VECTORS)
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/v", keep=("project", "w"))
    index.build(items)
    queries = spark.createDataFrame([(i, v.tolist(), [None, "p2"][i % 2]) for i, v in enumerate(c)] + [(90, [0.0] * 6, None), (91, None, "p1"), (92, [float("nan")] * 6, None)], "qid long, qvec array<double>, scope string")
    report: dict = {}
    own = dict(options)
    weight = own.pop("weight", None)
    got = index.search(queries, 10, (lambda x: F.col("w")) if weight else None, report=report, **own)
    want = retrieval.scored(queries, items, 10, "w" if weight else None, **own)
    assert ranking(got) == ranking(want) and len(ranking(want)) > 100
    real = {}
    index.search(queries.where("qid < 90"), 10, (lambda x: F.col("w")) if weight else None, report=real, **own).count()
    assert real["lists"] > 40 and real["read"] < 0.35 * real["pairs"]


def test_vector_index_after_updates_and_with_a_filter(spark, tmp_path, monkeypatch):
    rows, c = clustered(n=800)
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/v", keep=("project",))
    index.build(spark.createDataFrame(rows, VECTORS))
    far = np.random.default_rng(1).normal(size=(60, 6))
    new = [(9000 + i, "f3" if i % 2 else "fresh", v.tolist(), "p2", 1.0) for i, v in enumerate(far)]
    index.update(spark.createDataFrame([("f3",), ("f7",), ("fresh",)], "file_path string"), spark.createDataFrame(new, VECTORS))
    now = spark.createDataFrame([r for r in rows if r[1] not in ("f3", "f7", "fresh")] + new, VECTORS)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([c, far[:9]]))], "qid long, qvec array<double>")
    only = lambda x: x.where("project = 'p2'")
    for where in (lambda x: x, only):
        assert ranking(index.search(queries, 7, where=where)) == ranking(retrieval.scored(queries, where(now), 7))
    index.compact()
    assert ranking(index.search(queries, 7)) == ranking(retrieval.scored(queries, now, 7))
    monkeypatch.setattr(vector_index, "QUERIES_HELD", 5)  # too many queries for one task: blocks
    assert ranking(index.search(queries, 7, where=only)) == ranking(retrieval.scored(queries, only(now), 7))


def test_vector_index_of_nothing(spark, tmp_path):
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/v")
    index.build(spark.createDataFrame([], VECTORS))
    assert index.search(spark.createDataFrame([(1, [1.0, 0.0])], "qid long, qvec array<double>"), 3).collect() == []


def test_best_settles_ties_by_id_over_slices(spark):
    rng = np.random.default_rng(3)
    s = rng.integers(0, 4, (5, 200)) / 3
    s[2] = -np.inf
    ids = rng.permutation(1000)[:200]
    best = retrieval.Best(5, 8)
    for at in range(0, 200, 33):
        best.add(s[:, at : at + 33], ids[at : at + 33])
    got = best.frame(np.arange(5))
    for q in range(5):
        want = sorted(((-x, i) for x, i in zip(s[q].tolist(), ids.tolist()) if x > -np.inf))[:8]
        own = got[got["qid"] == q]
        assert [(-x, i) for x, i in zip(own["score"], own["id"])] == want
