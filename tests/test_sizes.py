"""Steps whose work grows no faster than the tables: what is shared, sent or carried along, and that results stay whole."""

import random

from pyspark.sql import functions as F

from lodestone.operators import chunking, retrieval, text_index, vector_index
from lodestone.plans import views
from lodestone.sources import listing


def seen(monkeypatch, name, at):
    """Counts of the frame at a place among the arguments of a function of retrieval."""
    counts, real = [], getattr(retrieval, name)
    monkeypatch.setattr(retrieval, name, lambda *a: counts.append((a[at].count(), a[0].columns)) or real(*a))
    return counts


def test_queries_that_name_one_id_look_it_up_once(spark, monkeypatch):
    counts = seen(monkeypatch, "containing", 2)
    chunks = spark.createDataFrame([(i, f"d{i}", f"docs/f{i % 3}.md") for i in range(12)], "id long, doc_id string, file_path string")
    q = spark.createDataFrame([(i, "see F1") for i in range(4)] + [(4, "see f2"), (5, "none")], "qid long, query string")
    got = sorted((r["qid"], r["id"], r["rn"]) for r in retrieval.exact_id(q, chunks, 2).collect())
    assert counts[0][0] <= 2
    assert [x for x in got if x[0] < 4] == [(i, n, r) for i in range(4) for n, r in ((1, 1), (4, 2))]


def test_flat_words_are_sought_in_distinct_runs(spark, monkeypatch):
    counts = seen(monkeypatch, "containing", 0)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["Alpha", "beta", "al_pha", "Été", "x1,y", "gamma\n"]) for _ in range(6)) if i % 9 else None) for i in range(80)]
    words = ["alph", "TÉ", "a_p", "y", "zzz", "__ta", "1y"]
    q = [(i, f"{words[i % 7]} {words[i * 3 % 7]}!") for i in range(20)]
    chunks, queries = spark.createDataFrame(rows, "id long, content string"), spark.createDataFrame(q, "qid long, query string")
    import re

    hit = lambda w, t: re.search("".join("." if c == "_" else c for c in w.lower()), t.lower(), re.S)
    want = sorted((i, n) for i, x in q for n, t in rows if t is not None and any(hit(w.strip("!"), t) for w in x.split(" ")))
    assert sorted(map(tuple, retrieval.flat_matches(queries, chunks).select("qid", "id").collect())) == want
    assert counts[0][1] == ["run"] and counts[0][0] < 10
    pairs = spark.createDataFrame([(i, n) for i in range(20) for n in range(0, 80, 7)], "qid long, id long")
    assert sorted(map(tuple, retrieval.flat_matches(queries, chunks, pairs).select("qid", "id").collect())) == [x for x in want if x[1] % 7 == 0]


def test_flat_matches_shuffle_neither_texts_nor_pairs(spark, monkeypatch):
    """However little a task remembers, and for more words than tasks hold, results are the same; an id that two chunks bear has a query once."""
    import re

    rng = random.Random(4)
    long = "longword" * 5
    rows = [(i, " ".join(rng.choice(["Alpha", "betalpha", "al_pha", "Été,x", "x" + long + "y", long[:30] + "Z", "a-b", "one\ntwo", "\u4e2d\u6587\u3002tail", "p.h"]) for _ in range(4)) if i % 9 else None) for i in range(60)]
    words = ["ALPH", "al", "té", long, long[:30], long[:24], "o_e", "e_t_o", "p_h", "____", "\u6587", "zz", "b", long + "q"]
    queries = [(i, f" {words[i % 14]}!  {words[i * 5 % 13]} ") for i in range(30)] + [(40, ""), (41, "!"), (42, None), (3, "two")]
    hit = lambda w, t: re.search("".join("." if c == "_" else c for c in w.lower()), t.lower(), re.S)
    want = lambda rows: sorted({(i, n) for i, q in queries if q for w in q.replace("!", "").split() for n, t in rows if t is not None and hit(w, t)})
    q, schema = spark.createDataFrame(queries, "qid long, query string"), "id long, content string"
    df = retrieval.flat_matches(q, spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, df.select("qid", "id").collect())) == want(rows)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    twice = rows + [(n % 7, t) for n, t in rows[30:40]]
    for name, held in (("KNOWN", 1), ("RUNS_TAKEN", 0), ("CELLS", 1), ("WORDS_HELD", 1)):
        monkeypatch.setattr(retrieval, name, held)
        got = retrieval.flat_matches(q, spark.createDataFrame(twice, schema)).select("qid", "id").collect()
        assert sorted(map(tuple, got)) == want(twice)


def test_texts_are_chunks_without_vectors(spark):
    sf = "/root/testdata/sf0.001"
    c, t = views.chunks(spark, sf), views.texts(spark, sf)
    assert t.columns == [x for x in c.columns if x not in ("file_path", "embedding")] and t.exceptAll(c.select(t.columns)).isEmpty() and t.count() == c.count()
    assert "Join" not in t._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_chunk_by_chunk(spark, monkeypatch):
    """1 + 0.2 and six times 0.2 rank alike, so ids decide; pairs that are present have their ranks but no place. As many terms as tasks can't hold give the same."""
    chunks = spark.createDataFrame([(9, "k", "k"), (3, "", "k k k k k k"), (5, "k z", "z"), (7, "z", "")], "id long, title string, content string")
    q = spark.createDataFrame([(1, "k"), (2, "z K k"), (3, "gone k"), (4, "the")], "qid long, query string")
    index = retrieval.postings(chunks)
    present = spark.createDataFrame([(1, 5), (2, 9)], "qid long, id long")
    for held in (1 << 20, 1):
        monkeypatch.setattr(retrieval, "TERMS_HELD", held)
        ranks = {(r["qid"], r["id"]): r["rank"] for r in retrieval.keyword_rank(q, index).collect()}
        assert set(ranks) == {(1, 3), (1, 5), (1, 9), (2, 5)} and ranks[1, 3] == ranks[1, 9] == round(1.2 / 2.2, 12)
        got = sorted((r["qid"], r["id"], r["rn"]) for r in retrieval.keyword_best(q, index, present, 1).collect())
        assert got == [(1, 3, 1), (1, 5, None), (2, 5, 1)]


def test_ranks_within_a_scope(spark, monkeypatch):
    index = spark.createDataFrame([(i, "k", 1.0, "ab"[i % 2]) for i in range(6)], "id long, term string, s double, g string")
    q = spark.createDataFrame([(1, "k", "a"), (2, "k", None)], "qid long, query string, scope string")
    for held in (1 << 20, 1):
        monkeypatch.setattr(retrieval, "TERMS_HELD", held)
        assert sorted(map(tuple, retrieval.keyword_rank(q, index).select("qid", "id").collect())) == [(1, 0), (1, 2), (1, 4), *[(2, i) for i in range(6)]]


def test_items_without_a_vector_are_cut_to_those_that_can_count(spark):
    rows = [(i, None, 1.0 if i else None, "ab"[i % 2]) for i in range(40)] + [(100, [1.0, 0.0], 1.0, "a"), (101, [0.0, 0.0], 1.0, "b")]
    items = spark.createDataFrame(rows, "id long, v array<double>, w double, g string")
    assert sorted(r["id"] for r in retrieval.least_missing(items, ["g"], 2).collect()) == [1, 2, 3, 4, 100, 101]
    q = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.0], None)], "qid long, qvec array<double>, g string")
    facts = items.withColumnRenamed("v", "embedding")
    got = sorted((r["qid"], r["rn"], r["id"]) for r in retrieval.scored(q, facts, 3, "w", ("g", "g"), True).collect())
    assert got == [(1, 1, 100), (1, 2, 2), (1, 3, 4), (2, 1, 100), (2, 2, 1), (2, 3, 2)]


def test_few_more_vectors_than_the_sample_are_ordered(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "SAMPLE", 100)
    rows = spark.range(5000).withColumn("h", F.xxhash64("id"))
    n = vector_index._some(rows, 5000).count()
    assert 60 < n < 180 and vector_index._some(rows, 50).count() == 5000


def test_names_of_a_folder_are_read_by_many_tasks(spark, tmp_path):
    texts = {f"d/{i}.md": "é" * i for i in range(30)}
    listing.write_files(spark.createDataFrame(list(texts.items()), "path string, content string"), f"file://{tmp_path}")
    got = listing.contents(f"file://{tmp_path}", listing.listed(spark, f"file://{tmp_path}").coalesce(1))
    assert got.rdd.getNumPartitions() == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r["path"]: r["content"] for r in got.collect()} == texts


def test_a_text_is_split_once_for_all_its_headers(spark):
    df = chunking.sections(spark.createDataFrame([(1, "a\n## b\nc\n### d")], "doc_id long, body string"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "lambdafunction(" in plan and all("split(" not in x for x in plan.split("lambdafunction(")[1:])
    assert [r["content"] for r in df.orderBy("no").collect()] == ["a", "## b\nc", "### d"]


def test_pages_go_to_python_by_the_hundred(spark):
    df = chunking.article_text(spark.createDataFrame([(1, "<p>a</p>")], "page_id long, html string"))
    assert "BatchEvalPython" in df._jdf.queryExecution().executedPlan().toString() and df.first()["article"] == "a"


def test_texts_are_taken_apart_once_for_an_index(spark, tmp_path, monkeypatch):
    names, real = [], text_index.kept
    monkeypatch.setattr(text_index, "kept", lambda df, name: names.append(name) or real(df, name))
    text_index.TextIndex(spark, f"file://{tmp_path}/i", ("title",)).build(spark.createDataFrame([(1, "f", "a b")], "id long, file_path string, title string"))
    assert names == ["occurrences"]
