"""Odd rows in every operator and stage: nulls, repeated rows, empty tables, long lines, clashing names, and bounds lowered."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import common, cover_tree, jaccard, line_dedup, suffix_dedup, url_filter

SF = "/root/testdata/sf0.001"


def test_stages_on_odd_rows_and_on_none(spark, odd):
    """The odd frame's rows go through all stages; what each keeps is told by doc_id, repeated rows together."""
    kept = {}
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SF), name)
        kept[name] = sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=str)
        if name != "packing":
            assert docs.columns == odd.columns
    assert kept["language"] == sorted([1, 2, 2, 5, 6, None], key=str) == kept["lines"]  # null, empty and letterless texts go
    assert kept["near_duplicates"] == sorted([1, 5, None], key=str) == kept["pii"]  # copies go with both rows of doc_id 2, the row without an id stays
    assert set(kept["packing"]) == {1, 5, None}
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, SF), "none")
        assert docs.collect() == []


def test_repeated_rows_of_a_kept_document_stay(spark):
    text = " ".join(f"word{i}" for i in range(50))
    docs = spark.createDataFrame([(d, text, "en", "s", len(text)) for d in (1, 1, 2, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.dedup_documents(spark, docs, SF)
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted([1, 1, None], key=str)


def test_vectors_with_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (None, [1.0, 0.0]), (3, [0.0, 1.0])]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in cover_tree.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=str)
    assert (2, 1, 1) in got and (3, 0, 3) in got and [g for g in got if g[0] == 1] == [(1, 1, 1)] * len([g for g in got if g[0] == 1])


def test_vectors_without_broadcast_of_tasks(spark, monkeypatch):
    for name, value in [("BROADCAST_TASKS", -1), ("BLOCK", 9)]:
        monkeypatch.setattr(cover_tree, name, value)
    x = np.random.default_rng(8).normal(size=(80, 3))
    rows = {i: v.astype(np.float32).tolist() for i, v in enumerate(x)}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cover_tree.near_vectors(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")).collect()}
    assert got == cover_tree.brute_force(rows)


def test_lines_of_odd_rows(spark, odd):
    """A host of twenty pages with a very long shared line, repeated rows, and null texts that count as one page."""
    long = "x" * 300_000
    rows = [(i, "h", f"{long}\n own {i} \n\n") for i in range(20)] + [(3, "h", f"{long}\n own 3 \n\n"), (50, "h", None), (51, "h", None), (None, "h", f"{long}\nlast")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS n_kept", "'l' AS lines")
    got = line_dedup.line_dedup(docs).collect()
    assert len(got) == len(rows) and {r["lines"] for r in got} == {"l"}
    assert sorted(str(r["text"]) for r in got if r["doc_id"] == 3) == [" own 3 \n\n"] * 2 and [r["text"] for r in got if r["doc_id"] is None] == ["last"]
    assert line_dedup.line_dedup(odd).count() == odd.count() and line_dedup.line_dedup(odd.limit(0)).collect() == []


def test_lines_against_their_sql_with_null_texts(spark, tmp_path):
    import duckdb

    rows = [(i, "h", f"Menu\nstory {i}" if i < 5 else None if i > 40 else f"only {i}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["n_kept_chars"]) for r in line_dedup.op2_line_dedup(spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(line_dedup.OP2_SQL)
    at = [want.columns.index(k) for k in ("doc_id", "n_lines", "n_dropped", "n_kept_chars")]
    assert got == sorted(tuple(r[i] for i in at) for r in want.fetchall()) and sum(g[2] for g in got) == 5


def test_urls_of_null_pages_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "http://example.com/en/"), (1, None), (1, None), (2, "http://www.example.com/en/x"), (2, "http://www.example.com/en/x")], "page_id long, url string").selectExpr("*", "'r' AS rule")
    got = sorted(((r["page_id"], r["verdict"]) for r in url_filter.url_filter(df).collect()), key=str)
    assert got == sorted([(None, "block"), (1, "allow"), (1, "allow"), (2, "allow"), (2, "allow")], key=str)


@pytest.mark.parametrize("bits", [6, 10])
def test_suffix_dedup_with_a_small_bitmap(spark, monkeypatch, bits):
    """All buckets look repeated: slower, and the same."""
    import hashlib

    monkeypatch.setattr(suffix_dedup, "BITMAP", bits)
    rng = random.Random(bits)
    parts = ["".join(rng.choice("abcdé \n") for _ in range(150)) for _ in range(5)]
    texts = {i: "".join(rng.choice(parts)[rng.randrange(60) :] for _ in range(rng.randint(0, 4))) for i in range(40)}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 100).collect()}
    assert got == suffix_dedup.brute_force(texts, 100)


def test_suffix_dedup_with_digests_that_clash(spark, monkeypatch):
    """Digests of two bits: only the bytes tell windows apart."""
    import hashlib

    real = suffix_dedup.window_digests
    monkeypatch.setattr(suffix_dedup, "window_digests", lambda *a: real(*a) & np.uint64(3))
    rng = random.Random(77)
    parts = ["".join(rng.choice("abcdé \n") for _ in range(150)) for _ in range(5)]
    texts = {i: "".join(rng.choice(parts)[rng.randrange(60) :] for _ in range(rng.randint(0, 4))) for i in range(40)}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 100).collect()}
    assert got == suffix_dedup.brute_force(texts, 100)


def test_windows_are_compared_by_their_bytes():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 2, 400).astype(np.uint8)
    own = np.sort(rng.integers(0, 390, 300))
    other = np.where(rng.random(300) < 0.5, own - own[0], rng.integers(0, 390, 300)).clip(0)
    got = suffix_dedup.equal_windows(data, own, other, 7)
    assert got.tolist() == [bytes(data[a : a + 7]) == bytes(data[b : b + 7]) for a, b in zip(own, other)]
    assert suffix_dedup.equal_windows(data, own[:0], other[:0], 7).tolist() == []


def test_jaccard_without_broadcast_of_ids(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", -1)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    base = [[rng.choice(words) for _ in range(40)] for _ in range(4)]
    texts = {i: " ".join(base[i % 4][: 40 - i % 3]) for i in range(30)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == jaccard.brute_force(texts, 3, 90)
