"""The operators for training data: brute force, round trips, held-out accuracy and odd inputs."""

import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import common, cover_tree, fingerprint, jaccard, language, lattice, line_dedup, packing, pii, suffix_dedup, url_filter

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def near_texts(seed: int, n: int = 60) -> dict:
    rng = random.Random(seed)
    words = [f"{rng.choice('abcdefgh')}{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 120))] for _ in range(8)]
    out = {}
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        out[i] = " ".join(w).upper() if i % 7 == 0 else "\n".join(w)
    return out | {n: None, n + 1: "", n + 2: " \t ", n + 3: "one", n + 4: "ONE", n + 5: "one two"}


@pytest.mark.parametrize("words, percent, small", [(3, 90, 40), (5, 80, 2), (3, 50, 1)])
def test_jaccard_against_brute_force(spark, monkeypatch, words, percent, small):
    """With small regions turned off, the dense path has to find the same links."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    texts = near_texts(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(docs, words, percent).collect()}
    assert got == jaccard.brute_force(texts, words, percent)


def test_jaccard_more_clusters_than_pivots(spark, monkeypatch):
    """Two versions of an article, each with a passage that many documents hold: linked though no pivot is near."""
    for name, value in [("SMALL", 4), ("PIVOTS", 2), ("ROUNDS", 1), ("word_levels", lambda docs: np.zeros(1 << jaccard.SLOTS, np.uint8))]:
        monkeypatch.setattr(jaccard, name, value)
    body = lambda i: " ".join(f"b{i}x{k}" for k in range(300))
    passage = lambda i: " ".join(f"p{i % 6}x{k}" for k in range(12))
    texts = {2 * i + v: f"{body(i)} {passage(i + v)}" for i in range(30) for v in (0, 1)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(docs).collect()}
    assert got == jaccard.brute_force(texts, 3, 90)


def families(rng: random.Random, each: int) -> dict[int, str]:
    """A base of 100 words and six versions of it with 20 words of their own; each text has up to four words changed. One ball, seven smaller ones."""
    base, out = [f"b{i}" for i in range(100)], {}
    for f in range(7):
        mine = [f"f{f}x{i}" if f and 14 * (f - 1) <= i < 14 * (f - 1) + 20 else w for i, w in enumerate(base)]
        for _ in range(each):
            w = list(mine)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(100)] = f"r{rng.randrange(10_000)}"
            out[len(out)] = " ".join(w)
    return out


@pytest.mark.parametrize("pivots, size", [(128, 1 << 24), (3, 1 << 24), (128, 4000)])
def test_jaccard_cuts_balls_again(spark, monkeypatch, pivots, size):
    """Balls that stay large are cut by pivots of their own; with three pivots a region, some documents are left for the next cut."""
    for name, value in [("SMALL", 4), ("BLOCK", 20), ("WITNESSES", 70), ("PIVOTS", pivots), ("BLOCK_BYTES", size)]:
        monkeypatch.setattr(jaccard, name, value)
    cut, keep = [], jaccard.stored

    def stored(df, name):
        out = keep(df, name)
        cut.extend([r["ball"] for r in out.select("ball").collect()] if name == "cut" else [])
        return out

    monkeypatch.setattr(jaccard, "stored", stored)
    texts = families(random.Random(pivots), 50)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(docs, 1, 90).collect()}
    assert got == jaccard.brute_force(texts, 1, 90)
    assert max(cut) > 0


@pytest.mark.parametrize("step, percent", [(3, 90), (6, 90), (8, 80)])
def test_jaccard_chain_through_witnesses(spark, monkeypatch, step, percent):
    """Each text is the one before, moved on by a few words: one chain, or none, of which no document links with most others."""
    for name, value in [("SMALL", 2), ("BLOCK", 10), ("WITNESSES", 40)]:
        monkeypatch.setattr(jaccard, name, value)
    texts = {i: " ".join(f"w{k}" for k in range(i * step, i * step + 100)) for i in range(200)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_join(docs, 1, percent).collect()}
    assert got == jaccard.brute_force(texts, 1, percent)


def test_jaccard_witnesses_hold_their_component_together():
    """Links that a region's documents tell of join the same documents as all of its links do."""
    rng = random.Random(5)
    sets = [np.unique(np.array([rng.randrange(k, k + 40) for _ in range(60)], np.uint64)) for k in range(0, 120, 2)]
    linked = lambda a, b: 100 * len(both := np.intersect1d(a, b)) >= 50 * (len(a) + len(b) - len(both))
    told = jaccard.Witnesses(list(range(60)), sets, np.zeros(60, bool), 0.5, 50)
    found = [(i, j) for i in range(60) for j in told.deal(i, sets[i], False)[1]]
    tree = lambda links: len(jaccard.forest(np.array([a for a, _ in links]), np.array([b for _, b in links]), 60))
    assert all(linked(sets[i], sets[j]) for i, j in found)
    assert tree(found) == tree([(i, j) for i in range(60) for j in range(i) if linked(sets[i], sets[j])])


def test_jaccard_levels_beyond_31(spark, monkeypatch):
    """Rarest words of levels 31 and 32 in one pair: the order of shingles has to hold as long too."""
    rare, shared, often = [f"r{i}" for i in range(10)], ["s"], [f"f{i}" for i in range(89)]
    level = np.zeros(1 << jaccard.SLOTS, np.uint8)
    for words, k in [(rare, 10), (shared, 31), (often, 32)]:
        level[(jaccard.word_hashes(" ".join(words)) & np.uint64(len(level) - 1)).astype(np.int64)] = k
    monkeypatch.setattr(jaccard, "word_levels", lambda docs: level)
    docs = spark.createDataFrame([(1, " ".join(rare + shared + often)), (2, " ".join(shared + often))], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_join(docs, 1, 90).collect()) == [(1, 1), (2, 1)]


def test_jaccard_odd_rows(spark, odd):
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_join(odd).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 1), (None, None), (7, 7)], key=str)
    assert jaccard.jaccard_join(odd.limit(0)).collect() == []


@pytest.mark.parametrize("length", [40, 100])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, length):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    rng = random.Random(length)
    parts = ["".join(rng.choice("abcdé \n") for _ in range(150)) for _ in range(6)]
    texts = {i: "".join(rng.choice(parts)[rng.randrange(60) :] for _ in range(rng.randint(0, 4))) for i in range(50)}
    texts |= {50: None, 51: "", 52: "x" * 700, 53: "ab" * 300, 54: "x" * 99, 55: texts[1]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_dedup.suffix_dedup(docs, length).collect()}
    assert got == suffix_dedup.brute_force(texts, length)


def test_suffix_dedup_odd_rows(spark, odd):
    got = sorted(((r["doc_id"], r["n_bytes"] - r["n_removed"]) for r in suffix_dedup.suffix_dedup(odd).collect()), key=str)
    assert len(got) == odd.count() and (3, 0) in got and (4, 0) in got and [n for d, n in got if d is None][0] > 0
    assert suffix_dedup.suffix_dedup(odd.limit(0)).collect() == []


@pytest.mark.parametrize("parts", [1, 3])
def test_suffix_dedup_repeated_rows_keep_their_text(spark, parts):
    """A row that stands twice is one document: its own copy starts no earlier, whichever task holds it."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(200))
    texts = {1: text("a"), 2: text("b"), 3: text("b") + text("c"), 4: text("d") + text("d")}
    docs = spark.createDataFrame([(d, t) for d, t in texts.items() for _ in range(3)], "doc_id long, text string").repartition(parts)
    want = suffix_dedup.brute_force(texts, 100)
    got = [(r["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())) for r in suffix_dedup.suffix_dedup(docs).collect()]
    assert len(got) == 12 and all(w == want[d] for d, w in got)


def test_window_min():
    x = np.random.default_rng(1).integers(0, 99, 300).astype(np.uint64)
    assert suffix_dedup.window_min(x, 7).tolist() == [x[i : i + 7].min() for i in range(294)]


def test_cover_tree_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 9)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    rows = {i: (centres[i % 6] + rng.normal(scale=0.05 * (i % 5), size=8)).astype(np.float32).tolist() for i in range(90)}
    rows |= {90: None, 91: [0.0] * 8, 92: [float("nan")] + [1.0] * 7, 93: [None] + [1.0] * 7, 94: [float("inf")] + [1.0] * 7, 95: [1.0, 0.0], 96: [2.0, 0.0], 97: rows[3]}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>").withColumn("leaf", F.lit("clash"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cover_tree.near_vectors(df).collect()}
    assert got == cover_tree.brute_force(rows)
    assert cover_tree.near_vectors(df.limit(0)).collect() == []


def test_cover_tree_with_planted_copies_at_the_default_block(spark):
    """Several leaves, near copies of some vectors: links as by all products at once."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(7000, 16))
    x[6000:] = x[rng.integers(0, 300, 1000)] + rng.normal(scale=0.15, size=(1000, 16))
    x = x.astype(np.float32)
    u = cover_tree.units(x)
    near = u @ u.T >= cover_tree.COSINE
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.near_vectors(df).collect()}
    label = np.arange(len(x))
    while (new := np.array([min(label[i], *label[near[i]]) if near[i].any() else label[i] for i in range(len(x))])).tolist() != label.tolist():
        label = new
    assert sum(near.sum(axis=1) > 0) > 900 and got == {i: (int(n), int(c)) for i, (n, c) in enumerate(zip(near.sum(axis=1), label))}


def test_tree_prunes_and_keeps_all_pairs():
    rng = np.random.default_rng(4)
    x = cover_tree.units(np.concatenate([c + rng.normal(scale=0.02, size=(40, 5)) for c in np.eye(5)]))
    tree = cover_tree.Tree(x, 10)
    at, path, dist = tree.descend(x)
    radius: dict = {}
    for p, d in zip(path, dist):
        for k, v in zip(p, d):
            radius[k] = max(v, radius.get(k, 0.0))
    pairs = set(tree.dual(radius, math.sqrt(2 - 2 * 0.95)))
    begun = tree.dual(radius, math.sqrt(2 - 2 * 0.95), most=5)
    assert len(begun) >= 5 and sorted(p for b in begun for p in tree.dual(radius, math.sqrt(2 - 2 * 0.95), [b])) == sorted(pairs)
    leaves = len(set(at.tolist()))
    assert len(pairs) < leaves * (leaves + 1) // 2
    for i, j in zip(*np.nonzero(x @ x.T >= 0.95)):
        assert (min(at[i], at[j]), max(at[i], at[j])) in pairs


def test_pii_spans_are_those_of_the_patterns(spark):
    texts = {
        1: "mail a.b+c@x-y.org, not @x or a@b; ip 10.0.0.255 and 1.2.3.4.5 and 300.1.1.1", 2: "card 4111 1111 1111 1111 and 4111-1111-1111-1112, call +49 (30) 123-4567 or +1 2",
        3: None, 4: "", 5: "é@é.de x@y.z@w.v " * 3, 6: "iban DE89 3704 0044 0532 0130 00 account; ssn 078-05-1120 social security", 7: "a@b.c" * 20_000,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("kind", F.lit(1))
    got = {r["doc_id"]: r["spans"] for r in pii.pii_spans(docs).collect()}
    for k, t in texts.items():
        base = ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in got[k] if s["kind"] in pii.BASE)
        assert hashlib.sha256(base.encode()).hexdigest() == pii.base_digest(t), k
    assert {"iban", "ssn"} <= {s["kind"] for s in got[6]}
    assert pii.pii_spans(docs.limit(0)).collect() == []


def test_pii_is_linear_in_long_runs():
    import time

    began = time.time()
    for t in ("1" * 1_000_000, "a" * 1_000_000 + "@!", "a@" * 300_000, "1.2.3." * 200_000, "+1" + "(" * 500_000, "A" * 500_000, "1 " * 400_000):
        pii.find_spans(t)
    assert time.time() - began < 60
    rng = random.Random(8)
    for _ in range(400):
        t = "".join(rng.choice(["a", "@", ".", "1", "-", " ", "b.c", "+", "255", "é"]) for _ in range(40))
        for kind in pii.BASE:
            assert list(pii.matches(kind, t)) == [m.span() for m in pii.PATTERNS[kind].finditer(t)], (kind, t)


def test_pii_context_decides_added_spans():
    iban, ssn = "DE89370400440532013000", "078-05-1120"
    kinds = lambda t: [k for k, *_ in pii.find_spans(t) if k in pii.ADDED]
    assert kinds(f"bank account {iban}") == ["iban"] == kinds(iban) and kinds(f"order {iban}") == [] and kinds(f"invoice for account {iban}") == ["iban"]
    assert kinds(f"social security {ssn}") == ["ssn"] and kinds(ssn) == [] == kinds(f"version {ssn} of the security release")


def test_pii_redaction_and_checksums(spark, odd):
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")
    t = "write a@b.cd now"
    assert pii.redact(t, pii.find_spans(t)) == "write <EMAIL> now"
    assert pii.redacted(odd).columns == odd.columns and pii.redacted(odd).count() == odd.count()


def test_line_dedup_cuts_site_lines_only(spark):
    rows = [(i, "h1", f" Menu \nstory {i}\n\nend {i}") for i in range(20)] + [(100 + i, "h2", "Menu\nonly here") for i in range(4)] + [(200, None, "Menu"), (201, "h1", None), (202, "h1", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("line", F.lit(0))
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.line_dedup(docs).collect()}
    assert got[3] == ("story 3\n\nend 3", 4, 1) and got[100] == ("Menu\nonly here", 2, 0)
    assert got[200][0] == "Menu" and got[201] == (None, 0, 0) and got[202] == ("", 1, 0)
    assert line_dedup.line_dedup(docs.limit(0)).collect() == []


def test_line_dedup_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    rows = [(i, "h1", f"Menu\nstory {i}") for i in range(20)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert {r["text"] for r in got} == {f"story {i}" for i in range(20)}


@given
def test_language_on_held_out_documents(spark):
    docs = common.table(spark, SF, "documents").withColumn("held_out", language.held_out())
    got = language.identify(docs, language.fit(docs.where("not held_out")), ["doc_id", "held_out", "lang"])
    right = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95


def test_language_against_plain_out_of_place(spark):
    """Ranks, distances and the language by plain Python with strings for n-grams."""
    from collections import Counter

    def plain(text: str, top: int) -> list[str]:
        padded = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        n = Counter(g for k in (1, 2, 3) for i in range(len(padded) - k + 1) if (g := padded[i : i + k]) and (k == 1 and g != " " or k == 2 and g != "  " or k == 3 and g[:2] != "  " and g[1:] != "  "))
        return n, [g for g, _ in n.most_common(top)]

    rng = random.Random(12)
    made = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklabmn"}
    text = lambda k: " ".join("".join(rng.choice(made[k]) for _ in range(rng.randint(2, 7))) for _ in range(60))
    rows = [(i, text(k), k) for i, k in enumerate(list(made) * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    p = language.fit(docs, top=5000)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, p, ["doc_id"]).collect()}
    counts = {k: sum((plain(t, 1)[0] for _, t, lang in rows if lang == k), Counter()) for k in made}
    for i, t, _ in rows[:12]:
        own, _ = plain(t, 1)
        # ties may be ranked either way, so the bounds of each rank count
        bounds = lambda n, g: (sum(1 for v in n.values() if v > n[g]), sum(1 for v in n.values() if v >= n[g]) - 1)
        low, high = {}, {}
        for k in made:
            low[k] = high[k] = 0
            for g in own:
                (a, b), (c, d) = bounds(own, g), bounds(counts[k], g) if g in counts[k] else (0, 0)
                if g not in counts[k]:
                    low[k] += 5000
                    high[k] += 5000
                else:
                    low[k] += max(0, c - b, a - d)
                    high[k] += max(abs(d - a), abs(b - c))
        best = got[i][0]
        assert low[best] <= min(high.values()), (i, low, high)
        assert 1 - high[best] / (len(own) * 5000) - 1e-9 <= got[i][1] <= 1 - low[best] / (len(own) * 5000) + 1e-9


def test_language_odd_rows(spark, odd):
    p = language.fit(odd)
    got = {r["doc_id"]: r for r in language.identify(odd, p, ["doc_id", "key"]).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[7]["lang_pred"] == "und" and got[5]["lang_pred"] in ("en", "de")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    nothing = language.fit(odd.limit(0))
    assert language.identify(odd, nothing, ["doc_id"]).first()["lang_pred"] == "und"


def test_language_with_many_letters(spark):
    """Scripts whose letters are rare in the sample keep them apart."""
    rng = random.Random(5)
    scripts = {"el": "αβγδεζηθικλμνξοπ", "hy": "աբգդեզէըթժիլխծկհ", "ru": "абвгдежзийклмноп", "zh": "".join(chr(0x4E00 + i) for i in range(80))}
    word = lambda k: "".join(rng.choice(scripts[k]) for _ in range(rng.randint(2, 6)))
    rows = [(i, " ".join(word(k) for _ in range(400 if k == "zh" else 20)), k) for i, k in enumerate(list(scripts) * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    p = language.fit(docs)
    assert all(r["lang_pred"] == r["lang"] for r in language.identify(docs, p, ["doc_id", "lang"]).collect())
    keys = language.grams("".join(chr(c) for c in range(0x110000) if chr(c).isalpha() and chr(c).lower() == chr(c))[:100_000], p.ready().codes)
    assert len(set(keys[keys < language.BI].tolist())) == 100_000


def test_hilbert_key_is_a_continuous_bijection():
    n = 8
    grid = np.array([(a, b, c) for a in range(n) for b in range(n) for c in range(n)])
    order = np.argsort(key := packing.hilbert_key(grid, 3))
    assert sorted(key.tolist()) == list(range(n**3))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def test_packing_covers_every_id_once(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    pieces = packing.pack(docs).collect()
    for r in docs.collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, packing.END], "<u4")
        own = sorted((p for p in pieces if p["doc_id"] == r["doc_id"]), key=lambda p: p["start"])
        assert sum(p["length"] for p in own) == len(ids) == own[0]["doc_tokens"]
        at = 0
        for p in own:
            assert p["start"] == at and zlib.crc32(ids[at : at + p["length"]].tobytes()) == p["ids_crc32"]
            at += p["length"]
    by: dict = {}
    for p in pieces:
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    fill = []
    for s in sorted(by):
        at = 0
        for off, size in sorted(by[s]):
            assert off == at
            at += size
        fill.append(at)
    assert all(f == packing.LENGTH for f in fill[:-1]) and fill[-1] <= packing.LENGTH
    assert packing.pack(odd).count() >= odd.count() and packing.pack(odd.limit(0)).collect() == []


def test_word_cache_gives_the_library_ids():
    from lodestone.llm.wordcache import WordCache

    w = WordCache(packing.vocabulary(), keep=3)
    for t in ["Héllo, WORLD it's 3.14 don't\nx", "ÀÉÎ ß µ ª", "日本語 Σίσυφος", "a\u0301 e", "tab\there\u00a0nbsp", "", "  ", "!!! ... ,,", "<|endoftext|> y", "end. end, end; end: end! end? end.. é. É!", "naïve – “quoted” CAFÉ İstanbul's ½", "a\u00a0b\u2003c\rd"]:
        assert np.frombuffer(w.encode(t), "<u2").tolist() == w.whole.encode(t, add_special_tokens=False).ids, t


def test_sentencepiece_round_trip_and_best_path(spark, odd):
    got = lattice.decode(lattice.encode(odd.select("doc_id", "text", "key"))).collect()
    assert len(got) == odd.count() and all((r["text"] or "") == r["decoded"] for r in got if r["text"] or r["ids"])
    tricky = spark.createDataFrame([(1, "a  b\n\tc  "), (2, "né 日本 😀 it's 3,50!"), (3, " lead"), (4, "y" * 500)], "doc_id long, text string")
    assert all(r["text"] == r["decoded"] for r in lattice.decode(lattice.encode(tricky)).collect())
    assert lattice.encode(odd.limit(0)).collect() == []


def test_lattice_against_plain_viterbi(spark):
    pieces = {"a": 1, "b": 2, "ab": 3, "ba": 4, "aba": 5, "▁": 6, "▁a": 7}
    cost = {k: 1.0 + v / 10 for k, v in pieces.items()}
    rng = random.Random(1)
    words = ["▁" + "".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(30)]
    table = spark.createDataFrame([(k, v, cost[k]) for k, v in pieces.items()], "piece string, id int, cost double")
    got = {r["word"]: r["ids"] for r in lattice.best_paths(spark.createDataFrame([(w,) for w in set(words)], "word string"), table, list(range(256))).collect()}
    for w in words:
        best: list = [(0.0, [])] + [None] * len(w)
        for z in range(1, len(w) + 1):
            for a in range(z):
                if best[a] is not None and w[a:z] in pieces and (best[z] is None or best[a][0] + cost[w[a:z]] < best[z][0] - 1e-12):
                    best[z] = (best[a][0] + cost[w[a:z]], best[a][1] + [pieces[w[a:z]]])
        names = {v: k for k, v in pieces.items()}
        assert sum(cost[names[i]] for i in got[w]) == pytest.approx(best[-1][0]) and "".join(names[i] for i in got[w]) == w


def test_sentencepiece_takes_pieces_of_space_and_sign_and_folds_long_words(spark, monkeypatch):
    """The whole text's best path, found without any split, is the one that words give."""
    path = lattice.model_path()
    pieces = {r["piece"]: (r["id"], r["cost"]) for r in lattice.piece_table(spark, path).collect()}
    texts = ["a | b ( c \" d - e = f", "x" + " " * 20 + "word   | y  ", "ab" * 100 + " " + "-=" * 90, "日本" * 40 + " né\n\n{\r\n  }"]
    cost = {i: c for i, c in pieces.values()}
    price = lambda ids: sum(cost.get(i, lattice.BYTE_COST) for i in ids)
    want = [lattice.fold("▁" + t.replace(" ", "▁"), pieces, 16, lattice.byte_ids(path)) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (lattice.LONG_CHARACTERS, 10):
        monkeypatch.setattr(lattice, "LONG_CHARACTERS", most)
        got = {r["doc_id"]: r["ids"] for r in lattice.encode(docs).collect()}
        for i, w in enumerate(want):
            assert len(got[i]) == len(w) and math.isclose(price(got[i]), price(w))
    assert {pieces[p][0] for p in ("▁|", "▁(")} <= set(want[0])


def test_words_whose_hashes_clash(spark, monkeypatch):
    """Four hashes for all words: every word is told by its text."""
    real = lattice.hashes
    monkeypatch.setattr(lattice, "hashes", lambda data, a, z: real(data, a, z) & np.uint64(3))
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abé,") for _ in range(rng.randint(1, 4))) for _ in range(30)) for _ in range(8)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = {r["piece"]: (r["id"], r["cost"]) for r in lattice.piece_table(spark, lattice.model_path()).collect()}
    for r in lattice.encode(docs, decoded=True).collect():
        t = texts[r["doc_id"]] or ""
        assert r["decoded"] == t and len(r["ids"]) == (len(lattice.fold("▁" + t.replace(" ", "▁"), pieces, 16, list(range(256)))) if t else 0)


def test_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(lattice, "FREQUENT", 2)
    docs = spark.createDataFrame([(1, "alpha beta gamma alpha"), (2, "alpha delta")], "doc_id long, text string")
    assert all(r["text"] == r["decoded"] for r in lattice.decode(lattice.encode(docs)).collect())


def test_rare_words_behind_a_shuffle(spark, monkeypatch):
    """Rows that another evaluation would number otherwise: every text keeps its own words."""
    monkeypatch.setattr(lattice, "FREQUENT", 2)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id"), F.lit(" common x"), F.col("id") % 7).alias("text")).repartition(7, F.rand())
    got = lattice.encode(docs, decoded=True).collect()
    assert len(got) == 300 and all(r["text"] == r["decoded"] and r["text"].startswith(f"w{r['doc_id']} ") for r in got)


def test_fingerprints(spark, odd, tmp_path):
    rng = random.Random(9)
    words = [f"term{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(80))) for i in range(60)] + [(100, "same text here"), (101, "same text here"), (102, None), (103, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in fingerprint.op8_fingerprint(spark, str(tmp_path)).collect()}
    order = sorted((i for i, _ in rows), reverse=True)
    text = {i: t or "" for i, t in rows}
    for i, nxt in zip(order, order[1:] + order[:1]):
        n = len(text[i]) // 2
        edited = text[i][: len(text[i]) - n] + text[nxt][:n]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(text[i])
    assert got[100]["fingerprint"] == got[101]["fingerprint"] and got[101]["near_next"] == 1.0
    mean = lambda c: sum(got[i][c] for i in range(60)) / 60
    assert mean("near_edited") > mean("near_next")


def plain_i_match(texts: dict[int, str], low: float, high: float) -> tuple[dict, dict]:
    """I-Match by plain Python, but for the hash that deals terms to subsets: the lexicon, and each text's terms."""
    import re

    split = lambda t: {x for x in re.split(r"[\W_]+", t.lower()) if x}
    own = {d: split(t) for d, t in texts.items()}
    df: dict = {}
    for ts in own.values():
        for t in ts:
            df[t] = df.get(t, 0) + 1
    n = len(texts)
    band = {t for t, k in df.items() if max(2, math.ceil(low * n)) <= k <= high * n}
    return band, {d: sorted(ts & band) for d, ts in own.items()}


@pytest.mark.parametrize("most", [200_000, 3])
def test_fingerprints_against_plain_i_match(spark, monkeypatch, most):
    """Exact band, sorted terms, every subset's hash; with the lexicon in the plan and joined."""
    monkeypatch.setattr(fingerprint, "LEXICON", most)
    monkeypatch.setattr(fingerprint, "SLOTS", 8)
    rng = random.Random(1)
    texts = {i: ", ".join(f"{rng.choice('ABc')}été{min(rng.randrange(400), rng.randrange(400))}" for _ in range(rng.randint(0, 60))) for i in range(80)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    band, want = plain_i_match(texts, 0.03, 0.2)
    lex = fingerprint.lexicon(docs, 0.03, 0.2)
    assert {r["t"] for r in lex.collect()} == band and 20 < len(band)
    got = fingerprint.with_known(docs, "text", "known", lex, lex.count() <= fingerprint.LEXICON).withColumn("fp", fingerprint.fingerprint(F.col("known"), F.coalesce("text", F.lit(""))))
    h = {r["t"]: (r["h0"], r["h1"]) for r in lex.select("t", F.xxhash64(F.lit("subset"), "t").alias("h0"), F.xxhash64(F.lit("other"), "t").alias("h1")).collect()}
    for r in got.collect():
        assert r["known"] == want[r["doc_id"]]
        parts = [[t for t in r["known"] if (h[t][k // 4] >> k % 4 * 16) & ((1 << size) - 1) == 0] for k in range(fingerprint.SUBSETS) for size in fingerprint.DENSITY]
        own = [hashlib.sha1((r["text"] or "").encode()).hexdigest()[:8]] * len(parts)
        assert r["fp"] == ([hashlib.sha1(" ".join(p).encode()).hexdigest()[:8] if p else "" for p in parts] if any(parts) else own)


def test_likeness_by_the_sparsest_density(spark):
    """Subsets as lists of hashes by density, against plain Python; texts without signal are like themselves alone."""
    rng = random.Random(2)
    n, m = fingerprint.SUBSETS, len(fingerprint.DENSITY)

    def made():
        out = []
        for _ in range(n):
            have = rng.randint(0, m)  # a sparse subset lies in the denser ones
            out += [rng.choice("xyz") for _ in range(have)] + [""] * (m - have)
        return out

    pairs = [(made(), made()) for _ in range(60)] + [([""] * n * m, ["q"] * n * m), (["q"] * n * m,) * 2]
    got = [r[0] for r in spark.createDataFrame(pairs, "a array<string>, b array<string>").coalesce(1).select(fingerprint.likeness(F.col("a"), F.col("b"))).collect()]
    for (a, b), g in zip(pairs, got):
        votes = []
        for k in range(n):
            some = [(x, y) for x, y in zip(a[k * m : (k + 1) * m], b[k * m : (k + 1) * m]) if x or y]
            votes += [some[-1][0] == some[-1][1]] if some else []
        assert g == (1.0 if a == b else sum(votes) / len(votes) if votes else 0.0)


def test_fingerprints_of_odd_rows(spark, odd, tmp_path):
    """Null ids, repeated rows, empty and null texts, and no rows at all."""
    odd.write.parquet(f"{tmp_path}/a/documents.parquet")
    odd.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    got = fingerprint.op8_fingerprint(spark, f"{tmp_path}/a").collect()
    assert len(got) == odd.count() and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    prints: dict = {}
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for r in got:
        prints.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values()) and len({next(iter(p)) for p in prints.values()}) == len(prints)
    assert fingerprint.op8_fingerprint(spark, f"{tmp_path}/b").collect() == []


def test_next_document_with_odd_ids(spark, odd):
    got = fingerprint.with_next(odd.select("doc_id", "text"), ["doc_id"]).select("doc_id", "next_doc_id").collect()
    assert len(got) == odd.count() and (7, 6) in [tuple(r) for r in got]
    assert fingerprint.with_next(odd.select("doc_id", "text").limit(0), ["doc_id"]).collect() == []


def test_url_rules(spark):
    urls = {
        1: "http://A.Example.COM/en/x?q", 2: "https://www.example.com/en/", 3: "http://example.com", 4: "ftp://x.net/fr/1#a", 5: "http://xnet/es/", 6: None, 7: "nonsense", 8: "http://example.com:80/en/", 9: "http://net/es/", 10: "http:///p", 11: "a://b://net/es/", 12: "http://a.com\n/x",
    }
    df = spark.createDataFrame(list(urls.items()), "page_id long, url string").withColumn("path", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(df).collect()}
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[2][2:] == ("www.example.com/en/", "allow")
    assert got[3] == ("example.com", "", None, "allow") and got[4] == ("x.net", "/fr/1", "net/fr/", "block") and got[5][2] is None
    assert got[6] == ("", "", None, "allow") == got[7] and got[8][2] is None and got[9][2:] == ("net/es/", "block") and got[10][:2] == ("", "/p")
    assert url_filter.url_filter(df.limit(0)).collect() == []


def test_url_with_many_labels_makes_few_keys(spark):
    host = "a." * 50_000 + "www.example.com"
    df = spark.createDataFrame([(1, f"http://{host}/en/x"), (2, "http://.com/"), (3, "http://com/"), (4, "http://example.com./en/")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.url_filter(df).collect()}
    assert got == {1: ("www.example.com/en/", "allow"), 2: ("com/", "allow"), 3: ("com/", "allow"), 4: (None, "allow")}
    assert url_filter.url_filter(df, []).where("rule is not null").count() == 0


def test_digest_collisions_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: 7)
    data, _, _ = url_filter.build_index([("block", "a.b", "/"), ("allow", "c.d", "/")])
    (tmp_path / "x").write_bytes(data)
    index = url_filter.DigestIndex(str(tmp_path / "x"))
    found = index.probe([b"c.d/", b"a.b/", b"e.f/"], np.array([3, 3, 3]))
    assert [bool(index.records[f]["allow"]) if f >= 0 else None for f in found] == [True, False, None]


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 130)] + [(1, i) for i in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(5, 5), (None, 3)]
    got = {r["id"]: r["component_id"] for r in common.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {v: v for e in edges if None not in e and e[0] != e[1] for v in e}
    for _ in range(200):
        for a, b in edges:
            if a in up and b in up:
                up[a] = up[b] = min(up[a], up[b])
    assert got == up


@given
def test_pipeline_against_its_parts(spark):
    """Each stage's decisions are those of a brute-force version on its own input."""
    docs = common.stored(common.table(spark, SF, "documents"), "docs")
    for name, stage in corpus_pipeline.STAGES:
        out = common.stored(stage(spark, docs, SF), name)
        if name != "packing":
            assert out.columns == docs.columns
        rows, after = docs.collect(), out.collect()
        before = {r["doc_id"]: r["text"] for r in rows}
        if name == "language":
            assert {r["doc_id"] for r in after} == {d for d, t in before.items() if t and any(c.isalpha() for c in t)}
            fitted = language.fit(docs.where(~language.held_out())).ready()
            assert all(r["lang"] == fitted.predict(before[r["doc_id"]])[0] and r["text"] == before[r["doc_id"]] for r in after)
        elif name == "lines":
            pages: dict = {}
            for r in rows:
                pages.setdefault(r["source"], set()).add(r["text"])
            share = {h: {} for h in pages}
            for h, texts in pages.items():
                for t in texts:
                    for x in {x.strip(" ") for x in t.split("\n")} - {""}:
                        share[h][x] = share[h].get(x, 0) + 1
            cut = lambda r: "\n".join(x for x in r["text"].split("\n") if not x.strip(" ") or not (share[r["source"]][x.strip(" ")] >= line_dedup.MIN_PAGES and share[r["source"]][x.strip(" ")] > line_dedup.RATIO * len(pages[r["source"]])))
            want = {r["doc_id"]: cut(r) if r["source"] is not None else r["text"] for r in rows}
            assert {r["doc_id"]: r["text"] for r in after} == want and all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "near_duplicates":
            label = jaccard.brute_force(before, 5, 80)
            assert {r["doc_id"] for r in after} == {d for d in before if label[d][1] == d}
        elif name == "pii":
            assert all(r["text"] == pii.redact(before[r["doc_id"]], pii.find_spans(before[r["doc_id"]])) for r in after)
        elif name == "packing":
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(packing.vocabulary())
            ids = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, packing.END], "<u4") for d, x in before.items()}
            assert all(r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) for r in after)
            assert sum(r["length"] for r in after) == sum(map(len, ids.values()))
            ends = sorted((r["sequence_id"], r["offset"], r["length"]) for r in after)
            at = 0
            for seq, off, size in ends:
                assert seq * packing.LENGTH + off == at
                at += size
        docs = out
