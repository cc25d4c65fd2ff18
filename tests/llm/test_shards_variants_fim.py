"""Sharding, spelling variants and fill-in-the-middle: brute force, inverses and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import fim, sharding, variants

DOCS = "doc_id long, text string"


def plain_place(x: int, n: int, seed: int) -> int:
    """The permutation in Python's integers, a number at a time."""
    m64 = (1 << 64) - 1

    def mixed(v, key):
        v = (v + key) & m64
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            v = ((v ^ (v >> shift)) * factor) & m64
        return v ^ (v >> 31)

    bits = max(2, (n - 1).bit_length())
    low = bits // 2
    keys = [mixed(r * 0x9E3779B97F4A7C15 & m64, seed) for r in range(1, sharding.ROUNDS + 1)]
    while True:
        hi, lo = x >> low, x & ((1 << low) - 1)
        for r, k in enumerate(keys):
            if r % 2:
                lo ^= mixed(hi, k) & ((1 << low) - 1)
            else:
                hi ^= mixed(lo, k) & ((1 << (bits - low)) - 1)
        x = hi << low | lo
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_is_a_bijection_with_an_inverse(n):
    p = sharding.Permutation(n, 5)
    there = p.forward(np.arange(n))
    assert sorted(there.tolist()) == list(range(n)) and p.inverse(there).tolist() == list(range(n))
    assert there.tolist() == [plain_place(x, n, 5) for x in range(n)]
    assert n < 16 or sharding.Permutation(n, 6).forward(np.arange(n)).tolist() != there.tolist()
    big = sharding.Permutation(10**15 + 7, 1)
    assert big.inverse(big.forward(np.arange(10**15, 10**15 + 7))).tolist() == list(range(10**15, 10**15 + 7))


@pytest.mark.parametrize("parts", [1, 7])
def test_shards_against_brute_force(spark, parts):
    texts = {i: f"héllo {i % 7}" * (i % 5) for i in range(300)} | {300: None, 301: ""}
    docs = spark.createDataFrame(list(texts.items()), DOCS).repartition(parts)
    got = sharding.shard(docs).collect()
    places = [plain_place(i, len(texts), sharding.SEED) for i in range(len(texts))]
    size = {d: len((t or "").encode()) + 1 for d, t in texts.items()}
    assert {tuple(r) for r in got} == {(d, size[d], zlib.crc32((t or "").encode()), i, places[i] % 16, places[i] // 16) for i, (d, t) in enumerate(texts.items())}
    r = got[17]
    assert sharding.row_at(len(texts), r["shard"], r["slot"]) == r["row"]
    with pytest.raises(ValueError):
        sharding.row_at(len(texts), 0, 30)


def test_shards_of_odd_rows(spark, odd):
    """Null and repeated ids, a third of all rows alike: shards differ by a row, slots have no gap, shuffles repeat."""
    many = odd.unionByName(odd.where("doc_id = 2").crossJoin(spark.range(60).select("id")).drop("id")).withColumnRenamed("key", "shard")
    runs = [sorted(tuple(r) for r in sharding.shard(many.repartition(n), 5, keep=["lang", "shard"]).drop("lang").collect()) for n in (1, 6)]
    assert runs[0] == runs[1] and len(runs[0]) == many.count()
    slots = defaultdict(list)
    for _, _, _, k, slot in runs[0]:
        slots[k].append(slot)
    assert sorted(slots) == list(range(5)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shard(many.limit(0)).collect() == []


def test_shards_written_and_read(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(100)], DOCS)
    rows = sharding.shard(docs, 4, keep=["doc_id", "text"])
    sharding.write_shards(rows, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted((r["text"], r["shard"], r["slot"]) for r in back.collect()) == sorted((r["text"], r["shard"], r["slot"]) for r in rows.collect())
    for f in back.inputFiles():
        slots = [r["slot"] for r in spark.read.parquet(f).collect()]
        assert slots == sorted(slots)


def variant_texts(seed: int) -> list:
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(25)] + ["aaaaaaaa", "x" * 60, "abcdef" * 9]
    out = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 120)):
            w = base[min(rng.randrange(len(base)), rng.randrange(len(base)))]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "a", "é", "z", "÷"]) + w[k + rng.randrange(2) :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append((i, rng.choice([" ", "-", ", ", "\n"]).join(words)))
    return [*out, (60, None), (61, ""), (None, "aaaaaaaa aaaaaaa " * 9), (3, out[3][1]), (3, out[3][1])]


@pytest.mark.parametrize("seed, blocks, cells, piece, long", [(1, 1 << 23, 1 << 19, 1 << 13, 48), (2, 70, 40, 16, 48), (3, 1000, 300, 64, 7)])
def test_variants_against_brute_force(spark, monkeypatch, seed, blocks, cells, piece, long):
    """Also with several files of filters, few cells at once and one shelf for most lengths."""
    for name, value in [("FILTER_BLOCKS", blocks), ("CELLS", cells), ("PIECE", piece), ("LONG", long)]:
        monkeypatch.setattr(variants, name, value)
    texts = variant_texts(seed)
    docs = spark.createDataFrame(texts, DOCS).selectExpr("*", "1 AS n", "'x' AS word")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.spelling_variants(docs, edited=5).collect()}
    want = variants.brute_force(texts, edited=5)
    assert got == want and sum(v[3] for v in want.values()) > 30


def test_variants_follow_long_chains(spark):
    words = ["abcdef", "abcdeg", "abcdhg", "abcihg", "abjihg", "akjihg"]
    docs = spark.createDataFrame([(i, f"{w} " * 5 ** (k + 1)) for k, w in enumerate(words[:5]) for i in [k]], DOCS)
    got = {r["word"]: (r["form"], r["root"]) for r in variants.spelling_variants(docs, edited=1 << 40).collect()}
    assert got == {w: (words[k + 1] if k < 4 else None, words[4]) for k, w in enumerate(words[:5])}


def test_variants_of_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = {r["word"]: r["n"] for r in variants.spelling_variants(odd, min_length=2, min_count=1).collect()}
    assert got == {w: v[2] for w, v in variants.brute_force(rows, min_length=2, min_count=1).items()}
    assert variants.spelling_variants(odd.limit(0)).collect() == []


def test_filters_have_no_false_negatives_and_few_positives():
    rng = random.Random(0)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(5000)})
    layout = variants.Layout({8: len(words)}, 1 << 20)
    bits = np.zeros(layout.total, np.uint64)
    at, mask = layout.place(variants.hashes(variants.codes(words)), 8)
    np.bitwise_or.at(bits, at.astype(np.int64), mask)
    assert ((bits[at] & mask) == mask).all()
    other = ["".join(rng.choice("ijklmnop") for _ in range(8)) for _ in range(20000)]
    at, mask = layout.place(variants.hashes(variants.codes(other)), 8)
    assert ((bits[at] & mask) == mask).mean() < 0.01


def plain_fim(doc_id, text: str | None, seed: int = 7, rate: int = 100, spm: int = 50) -> tuple:
    t = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = fim.draws(doc_id, seed)
    a, z = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:z]), "".join(lines[z:])
    if not t or any(x in t for x in fim.MARKS) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, t
    return (len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def fim_texts() -> dict:
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice(["a", "é", "\n", "日", "<", ">", "P", "😀", "\r", " "]) for _ in range(n))
    return {i: text(rng.choice([1, 2, 9, 60])) for i in range(200)} | {200: None, 201: "", 202: "x<P>y\nz", 203: "\n\n\n", 204: "<", 205: "a\n" * 3000 + "é" * 5000, 206: "no end", 207: "<S\n<S>\n"}


@pytest.mark.parametrize("window, most, rate", [(1 << 20, 1 << 23, 100), (7, 50, 100), (64, 1, 40)])
def test_fill_in_middle_against_brute_force(spark, monkeypatch, window, most, rate):
    monkeypatch.setattr(fim, "WINDOW", window)
    monkeypatch.setattr(fim, "SLICE", most)
    texts = fim_texts()
    docs = spark.createDataFrame(list(texts.items()), DOCS).selectExpr("*", "'c' AS form", "2 AS output")
    made = fim.fill_in_middle(docs, rate=rate)
    assert {r["doc_id"]: tuple(r)[1:] for r in made.collect()} == {d: plain_fim(d, t, rate=rate) for d, t in texts.items()}
    assert {r["doc_id"]: r["text"] for r in fim.restore(made).collect()} == {d: t or "" for d, t in texts.items()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: (r["output_sha256"], r["restored_sha256"]) for r in fim.fill_in_middle(docs, rate=rate, digests=True).collect()}
    assert got == {d: (sha(plain_fim(d, t, rate=rate)[-1]), sha(t or "")) for d, t in texts.items()}


def test_fill_in_middle_of_odd_rows(spark, odd):
    got = Counter((r["doc_id"], r["form"], r["output"]) for r in fim.fill_in_middle(odd).collect())
    assert got == Counter((r["doc_id"], p[1], p[4]) for r in odd.collect() for p in [plain_fim(r["doc_id"], r["text"])])
    assert fim.fill_in_middle(odd.limit(0)).collect() == []


def test_marks_that_cannot_be_found_again_are_refused():
    fim.check_marks(fim.MARKS)
    fim.check_marks(("<|prefix|>", "<|suffix|>", "<|middle|>"))
    for marks in [("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aba", "x", "y"), ("<P>", "a<P>b", "<M>"), ("", "a", "b")]:
        with pytest.raises(ValueError):
            fim.check_marks(marks)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab\né<P", max_size=12), max_size=6), st.randoms())
def test_gather_undoes_scatter(texts, rng):
    """Any cuts between characters, not at lines alone."""
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    cuts = np.array([[at[i] + len(t[:a].encode()), at[i] + len(t[:z].encode())] for i, t in enumerate(texts) for a, z in [sorted((rng.randint(0, len(t)), rng.randint(0, len(t))))]], np.int64).reshape(-1, 2)
    forms = ["plain" if "<P>" in t else rng.choice(["psm", "spm", "plain"]) for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    out, to = fim.scatter(data, at, cuts, forms)
    back, again = fim.gather(out, to, forms)
    assert back.tobytes() == data.tobytes() and again.tolist() == at.tolist()
