"""Hybrid retrieval for a whole DataFrame of queries at once: vectors, graph, text index, fusion, diversity."""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import doubles, first_structured_id, squash, tokens, weeks_between
from ..functions.sizes import broadcast_if_small
from ..sources.shared import kept

# Sizes and weights of the retrieval stages.
SEEDS, SEMANTIC, KEYWORD, MEMORY = 5, 20, 15, 3
KEYWORD_WEIGHT, FLAT_BOOST, TITLE_WEIGHT, DECAY = 0.5, 1.0, 1.0, 0.99
PER_FILE, CONFIDENCE_WINDOW = 2, 5
STOPPED = ["a", "and", "for", "in", "is", "of", "the", "to"]
FIELD_WEIGHTS = {"title": 1.0, "keywords": 1.0, "description": 0.4, "content": 0.2}
QUERY_BLOCK, ITEM_BLOCK = 512, 4000
QUERIES_HELD = 4096  # vectors of queries up to which every task gets them all


@dataclass(frozen=True)
class Corpus:
    """What a corpus can do; another corpus is another value of this class."""

    fields: tuple[str, ...] = ("title", "content")
    filters: tuple[str, ...] = ("project", "status", "file_path")
    graded: bool = True


def unit(vs: pd.Series, width: int) -> np.ndarray:
    """Rows at length 1; zeros for vectors that are missing, of another width, or not finite."""
    x = np.zeros((len(vs), width))
    for r, v in enumerate(vs):
        if v is not None and len(v) == width:
            x[r] = v
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=(size > 0) & np.isfinite(size))


CELLS = 1 << 21  # products held at once


class Best:
    """The k best items of each of n queries so far, by score and then by id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score, self.id = k, np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def add(self, s: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Scores of some queries (all where rows is None) with items; -inf is none. All queries are settled by one partition."""
        rows = np.arange(len(self.score)) if rows is None else rows
        x = np.concatenate([self.score[rows], s], axis=1)
        at = x.shape[1] - self.k
        # all that tie with the k-th best stay, so that ids decide
        r, c = np.nonzero((x >= np.partition(x, at, axis=1)[:, at, None]) & (x > -np.inf))
        own = np.where(c < self.k, self.id[rows[r], np.minimum(c, self.k - 1)], ids[np.maximum(c - self.k, 0)] if len(ids) else 0)
        order = np.lexsort((own, -x[r, c], r))
        r, c, own = r[order], c[order], own[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        kept_ = place < self.k
        self.score[rows] = -np.inf
        self.score[rows[r[kept_]], place[kept_]], self.id[rows[r[kept_]], place[kept_]] = x[r, c][kept_], own[kept_]

    def frame(self, qid: np.ndarray) -> pd.DataFrame:
        r, c = np.nonzero(self.score > -np.inf)
        return pd.DataFrame({"qid": qid[r], "id": self.id[r, c], "score": self.score[r, c]})


def scored(queries: DataFrame, items: DataFrame, k: int, weight: str | None = None, same: tuple[str, str] | None = None, keep_missing: bool = False) -> DataFrame:
    """(qid, id, score, rn): the k best items of each query by cosine, times ``weight`` where given.

    A stated set of queries against all rows. Up to QUERIES_HELD queries travel to the items: a task multiplies its rows
    with all of them, batch by batch, and returns k rows for each query, so no vector of an item is shuffled. More queries are
    dealt in blocks to every block of items. A window picks the best of what comes back. ``same`` names a column of each
    side that must agree, a query without a value taking all. Vectors that are missing, zero or hold
    what is no number score 0 or, by default, go, on either side.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    left, right = same or (None, None)
    q = queries.select(F.col("qid"), doubles(F.col("qvec")).alias("v"), (F.col(left) if left else F.lit(None).cast("string")).alias("g"))
    i = items.select(F.col("id"), doubles(F.col("embedding")).alias("v"), (F.col(right) if right else F.lit("")).alias("g"), w.alias("w"))
    if not keep_missing:
        i = i.where("v is not null")
    if keep_missing:
        i = least_missing(i, ["g"], k)
    held = q.limit(QUERIES_HELD + 1).toPandas()
    top = _best_in_tasks(held, i, k, keep_missing) if len(held) <= QUERIES_HELD else _best_in_blocks(q, i, k, keep_missing)
    rn = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return top.withColumn("rn", rn).where(F.col("rn") <= k)


def least_missing(items: DataFrame, group: list[str], k: int) -> DataFrame:
    """items(id, v, w, group) with no more than k of each group that have no vector: those all score 0, so the least ids are all that can be among the best.

    Items without a weight, or whose weight makes no number of 0, score nothing.
    """
    rn = F.row_number().over(Window.partitionBy(*group).orderBy("id"))
    none = items.where("v is null and w is not null and not isnan(w) and abs(w) < double('infinity')")
    return items.where("v is not null").unionByName(none.withColumn("__rn", rn).where(F.col("__rn") <= k).drop("__rn"))


def products(a: np.ndarray, x: np.ndarray, w: pd.Series) -> np.ndarray:
    """Weighted cosines, rounded so that equal vectors have equal scores whatever the batch, and ids decide."""
    return np.round(a @ x.T * w.to_numpy(np.float64), 12)


def directed(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Scores without those of vectors that have no direction, zeros in either matrix: their distance is no number."""
    s[~a.any(axis=1)] = -np.inf
    s[:, ~b.any(axis=1)] = -np.inf
    return s


def same_group(s: np.ndarray, group: pd.Series, own: pd.Series) -> np.ndarray:
    """Scores without those of items of another group than the query's; a query of no group takes all. NaN is none."""
    if (some := group.notna().to_numpy()).any():
        s[some[:, None] & (group.to_numpy()[:, None] != own.to_numpy()[None, :])] = -np.inf
    s[np.isnan(s)] = -np.inf
    return s


def _settled(best: Best, a: np.ndarray, group: pd.Series, b: pd.DataFrame, missing: bool) -> None:
    """Products of all queries with a batch of items, slice by slice."""
    step = max(1, CELLS // max(1, len(a)))
    for at in range(0, len(b), step):
        part = b.iloc[at : at + step]
        x = unit(part["v"], a.shape[1])
        s = products(a, x, part["w"])
        best.add(same_group(s if missing else directed(s, a, x), group, part["g"]), part["id"].to_numpy(np.int64))


def _best_in_tasks(q: pd.DataFrame, items: DataFrame, k: int, missing: bool) -> DataFrame:
    a = unit(q["v"], max((len(v) for v in q["v"] if v is not None), default=1))
    qid, group = q["qid"].to_numpy(np.int64), q["g"]

    def run(batches):
        best = Best(len(qid), k)
        for b in batches:
            _settled(best, a, group, b, missing)
        yield best.frame(qid)

    return items.mapInPandas(run, "qid long, id long, score double")


def _best_in_blocks(q: DataFrame, items: DataFrame, k: int, missing: bool) -> DataFrame:
    blocks = max(1, -(-items.count() // ITEM_BLOCK))
    q = q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-q.count() // QUERY_BLOCK)))))
    q = q.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("ib"))
    i = items.withColumn("ib", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    to = q.select(F.col("qb").alias("jb"), F.col("ib").alias("kb")).distinct()
    i = i.join(to, F.col("ib") == F.col("kb")).select("id", "v", "g", "w", "jb", "kb")

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        top = Best(len(a), k)
        if len(a):
            _settled(top, unit(a["v"], max((len(v) for v in a["v"] if v is not None), default=1)), a["g"], b, missing)
        return top.frame(a["qid"].to_numpy(np.int64))

    return q.groupBy("qb", "ib").cogroup(i.groupBy("jb", "kb")).applyInPandas(best, "qid long, id long, score double")


def live(chunks: DataFrame, include_archived: bool = False) -> DataFrame:
    """Without archived chunks; a missing status is live."""
    return chunks if include_archived else chunks.where("status is null or status <> 'archived'")


def filtered(chunks: DataFrame, filters: dict | None, corpus: Corpus = Corpus()) -> DataFrame:
    """Scalar fields must be equal, array fields hold the value; unknown fields and None are ignored."""
    for name, value in (filters or {}).items():
        if value is None or name not in chunks.columns or name not in (*corpus.filters, "layer"):
            continue
        array = chunks.schema[name].dataType.typeName() == "array"
        chunks = chunks.where(F.array_contains(name, value) if array else F.col(name) == value)
    return chunks


def semantic(queries: DataFrame, chunks: DataFrame, k: int = SEMANTIC, vectors=None, where=None) -> DataFrame:
    """(qid, id, distance, rn). A query with a ``scope`` takes chunks of that project alone.

    With ``vectors``, a `VectorIndex` of the chunks, its lists are read instead, cut down by ``where``, a function of their rows.
    """
    same = ("scope", "project") if "scope" in queries.columns else None
    found = scored(queries, chunks, k, same=same) if vectors is None else vectors.search(queries, k, same=same, where=where)
    return found.select("qid", "id", (1 - F.col("score")).alias("distance"), "rn")


def stamped(chunks: DataFrame, stamp: str) -> DataFrame:
    """chunks, whose vectors have to bear the caller's stamp or none: one of another model fails the job where it is read."""
    other = F.concat(F.lit(f"a vector of {stamp} can't be compared with one of "), "embedding_model")
    return chunks.withColumn("embedding", F.when(F.col("embedding_model") != stamp, F.raise_error(other).cast(chunks.schema["embedding"].dataType)).otherwise(F.col("embedding")))


def distances(pairs: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """pairs (qid, id, ...) with distance; the candidates are few for each query."""
    from ..functions.scalars import cosine_distance

    x = pairs.join(queries.select("qid", "qvec"), "qid").join(chunks.where("embedding is not null").select("id", "embedding"), "id")
    return x.withColumn("distance", cosine_distance(F.col("qvec"), F.col("embedding"))).drop("qvec", "embedding").where("distance is not null and not isnan(distance)")


def structural(found: DataFrame, queries: DataFrame, chunks: DataFrame, edges: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """All chunks of the documents that the first rows' documents point to and that aren't there yet; with a ``scope``, those of that project alone."""
    here = found.join(chunks.select("id", "doc_id"), "id")
    seed = here.where(F.col("rn") <= seeds).select("qid", F.col("doc_id").alias("source_id"))
    to = seed.join(edges.where("target_id is not null").select("source_id", "target_id"), "source_id").select("qid", F.col("target_id").alias("doc_id")).distinct()
    to = to.join(here.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
    if "scope" in queries.columns:
        to = to.join(queries.select("qid", "scope"), "qid").join(chunks.select("doc_id", "id", "project"), "doc_id").where("scope is null or scope = project")
    else:
        to = to.join(chunks.select("doc_id", "id"), "doc_id")
    return distances(to.select("qid", "id"), queries, chunks)


def postings(chunks: DataFrame, fields: tuple[str, ...] = ("title", "content"), wanted: DataFrame | None = None) -> DataFrame:
    """(id, term, s): the sum of a field's weight over the term's occurrences; of the terms in wanted(term) alone if it is given.

    Fields may be strings or arrays of strings.
    """
    text = lambda f: F.array_join(f, " ") if chunks.schema[f].dataType.typeName() == "array" else F.col(f)
    weighted = lambda f, w: F.transform(tokens(text(f)), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    out = chunks.select("id", F.inline(F.concat(*[weighted(f, FIELD_WEIGHTS[f]) for f in fields])))
    if wanted is not None:
        out = out.join(broadcast_if_small(wanted), "term", "left_semi")
    return out.where(~F.col("term").isin(STOPPED)).groupBy("id", "term").agg(F.sum("w").alias("s"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, terms)."""
    t = F.filter(F.array_distinct(tokens(F.col("query"))), lambda x: ~x.isin(STOPPED))
    return queries.select("qid", F.explode(t).alias("term"), F.size(t).alias("terms"))


TERMS_HELD = 1 << 20  # terms of all queries up to which every task gets them
CHUNKS_AT_ONCE = 1024  # chunks whose ranks are worked out together, or fewer


def _term_sets(queries: DataFrame) -> tuple[pd.DataFrame, np.ndarray, list[str]] | None:
    """(qid, n and g of queries that have terms, their terms' numbers in rows of one width, the terms), None if they are too many to hold. -1 fills up."""
    scope = F.col("scope") if "scope" in queries.columns else F.lit(None).cast("string")
    own = query_terms(queries).join(queries.select("qid", scope.alias("g")), "qid")
    held = own.select("qid", "term", "g").limit(TERMS_HELD + 1).toPandas()
    if len(held) > TERMS_HELD:
        return None
    held = held.drop_duplicates(["qid", "term"]).sort_values(["qid", "term"], ignore_index=True)
    number, names = pd.factorize(held["term"])
    each = held.groupby("qid", sort=True).agg(n=("term", "size"), g=("g", "first")).reset_index()
    row = np.searchsorted(each["qid"].to_numpy(np.int64), held["qid"].to_numpy(np.int64))
    place = held.groupby("qid").cumcount().to_numpy()
    sets = np.full((len(each), int(each["n"].max()) if len(each) else 1), -1)
    sets[row, place] = number
    return each, sets, list(names)


def _slice_ranks(part: pd.DataFrame, queries: pd.DataFrame, sets: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the queries whose terms all occur in these chunks, their ranks of each chunk; -inf where a chunk lacks a term)."""
    column = np.repeat(np.arange(len(part)), part["js"].map(len).to_numpy())
    used, j = np.unique(np.concatenate(part["js"].to_list()), return_inverse=True)
    v = np.concatenate(part["ss"].to_list()).astype(np.float64)
    shares = np.full((len(used) + 1, len(part)), -np.inf)  # a row for each term that occurs, one that adds nothing
    shares[j, column], shares[-1] = v / (v + 1), 0
    at = np.full(terms + 1, -1)
    at[used], at[-1] = np.arange(len(used)), len(used)
    at = at[sets]
    rows = np.flatnonzero((at >= 0).all(axis=1))
    total = np.zeros((len(rows), len(part)))
    for p in range(at.shape[1]):
        total += shares[at[rows, p]]
    # rounded, so that equal ranks are equal whatever the order of terms, and ids decide
    total = np.round(total / queries["n"].to_numpy()[rows][:, None], 12)
    return rows, same_group(total, queries["g"].iloc[rows], part["g"])


def _ranked_in_tasks(index: DataFrame, held: tuple, present: DataFrame | None, k: int | None) -> DataFrame:
    """(qid, id, rank, best) of postings that meet chunk by chunk: all ranks without k; else those of present and each task's k best of the others."""
    queries, sets, names = held
    spark = index.sparkSession
    number = spark.createDataFrame(pd.DataFrame({"term": pd.Series(names, dtype=object), "j": np.arange(len(names), dtype=np.int64)}), "term string, j long")
    g = F.first("g") if "g" in index.columns else F.lit("")
    x = index.join(broadcast_if_small(number), "term").groupBy("id").agg(F.collect_list(F.struct("j", "s")).alias("h"), g.alias("g"))
    x = x.select("id", "g", F.col("h.j").alias("js"), F.col("h.s").alias("ss"))
    if known := present is not None:
        x = x.join(present.groupBy("id").agg(F.collect_set("qid").alias("qs")), "id", "left")
    qid = queries["qid"].to_numpy(np.int64)
    step = max(1, min(CHUNKS_AT_ONCE, CELLS // max(1, len(qid))))

    def run(batches):
        top = Best(len(qid), k) if k else None
        for b in batches:
            for at in range(0, len(b), step):
                part = b.iloc[at : at + step]
                ids = part["id"].to_numpy(np.int64)
                rows, s = _slice_ranks(part, queries, sets, len(names))
                if not k:
                    r, c = np.nonzero(s > -np.inf)
                    yield pd.DataFrame({"qid": qid[rows[r]], "id": ids[c], "rank": s[r, c], "best": False})
                    continue
                if known:
                    qs = [q if q is not None else () for q in part["qs"]]
                    c = np.repeat(np.arange(len(part)), [len(q) for q in qs])
                    wanted = np.array([q for own in qs for q in own], np.int64)
                    r = np.searchsorted(qid[rows], wanted)
                    ok = r < len(rows)
                    ok[ok] = qid[rows][r[ok]] == wanted[ok]
                    r, c = r[ok], c[ok]
                    there = s[r, c] > -np.inf
                    yield pd.DataFrame({"qid": wanted[ok][there], "id": ids[c[there]], "rank": s[r, c][there], "best": False})
                    s[r, c] = -np.inf
                top.add(s, ids, rows)
        if k:
            yield top.frame(qid).rename(columns={"score": "rank"}).assign(best=True)

    return x.mapInPandas(run, "qid long, id long, rank double, best boolean")


def _joined_ranks(queries: DataFrame, index: DataFrame) -> DataFrame:
    """keyword_rank of more terms than tasks hold."""
    hit = query_terms(queries).join(index, "term")
    if "g" in index.columns:
        hit = hit.join(queries.select("qid", "scope"), "qid").where("scope is null or scope = g")
    shares = F.array_sort(F.collect_list(F.struct("term", (F.col("s") / (F.col("s") + 1)).alias("x"))))
    total = F.aggregate(F.col("shares"), F.lit(0.0), lambda a, t: a + t["x"])
    hit = hit.groupBy("qid", "id", "terms").agg(shares.alias("shares")).where(F.size("shares") == F.col("terms"))
    return hit.select("qid", "id", F.round(total / F.col("terms"), 12).alias("rank"))


def keyword_rank(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, id, rank) of chunks that hold all of a query's terms: mean of s / (s + 1), so below 1, at 12 digits.

    ``index`` is postings(id, term, s); with g, the chunk's project, a query with a ``scope`` takes chunks of that project alone. Postings
    meet chunk by chunk, so no term's list and no pair of query and chunk is shuffled.
    """
    held = _term_sets(queries)
    return _joined_ranks(queries, index) if held is None else _ranked_in_tasks(index, held, None, None).select("qid", "id", "rank")


def keyword_best(queries: DataFrame, index: DataFrame, present: DataFrame, k: int = KEYWORD) -> DataFrame:
    """(qid, id, rank, rn): the k best ranks of each query among the pairs that aren't present yet, and without rn the ranks of those that are."""
    held = _term_sets(queries)
    there = F.lit(None).cast("int").alias("rn")
    if held is None:
        ranks = kept(_joined_ranks(queries, index), "ranks")
        return keyword_candidates(ranks, present, k).select("qid", "id", "rank", "rn").unionByName(ranks.join(present.select("qid", "id"), ["qid", "id"], "left_semi").select("qid", "id", "rank", there))
    found = kept(_ranked_in_tasks(index, held, present.select("qid", "id"), k), "ranks")
    rn = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rank"), "id"))
    best = found.where("best").select("qid", "id", "rank", rn.alias("rn")).where(F.col("rn") <= k)
    return best.unionByName(found.where("not best").select("qid", "id", "rank", there))


def keyword_candidates(ranks: DataFrame, present: DataFrame, k: int = KEYWORD) -> DataFrame:
    rest = ranks.join(present.select("qid", "id"), ["qid", "id"], "left_anti")
    rn = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rank"), "id"))
    return rest.withColumn("rn", rn).where(F.col("rn") <= k)


GRAM = 3  # characters of a word's key, where it has so many


def containing(rows: DataFrame, fields: list[str], terms: DataFrame) -> DataFrame:
    """rows joined with terms(qid, word): those of which a field contains the word, letter case aside; _ stands for any character.

    A word's key is its first run of three characters without _, of two or one where it has no longer one, or nothing for a word of _ alone. Rows are
    taken apart into runs of as many characters as there are keys of, and meet the words whose key they hold.
    """
    text = F.lower(F.concat_ws("\n", *fields))
    key = F.lit("")
    for n in range(1, GRAM + 1):
        longer = F.regexp_extract(F.lower("word"), f"[^_]{{{n}}}", 0)
        key = F.when(longer != "", longer).otherwise(key)
    terms = terms.where("word <> ''").withColumn("key", key)
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.ilike(f, F.concat(F.lit("%"), F.col("word"), F.lit("%")))
    keys = terms.select("key").distinct()
    sizes = [r["n"] for r in keys.select(F.length("key").alias("n")).distinct().collect()]  # up to GRAM + 1 numbers
    runs = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1) if n else F.array(F.lit("")) for n in sizes]
    cut = rows.withColumn("key", F.explode(F.array_distinct(F.concat(*runs) if runs else F.array().cast("array<string>"))))
    return cut.join(broadcast_if_small(keys), "key", "left_semi").join(broadcast_if_small(terms), "key").where(hit).drop("key")


WORD = r"(?U)\w+"
RUN = r"[^\x00-/:-@\[-`{-\x7f]+"  # between the ASCII characters that no word without _ has
TOKENS_HELD = 1_000_000  # distinct runs of letters that hold a word, up to which tasks get them all
WORDS_HELD = 1 << 17  # words of all queries up to which every task gets them
KNOWN = 1 << 22  # characters of runs and numbers of their words that a task remembers
RUNS_TAKEN, RUNS_GIVEN, LONGEST = 200_000, 20_000, 64  # runs of the first texts, of these the distinct ones that it is given, and the longest of them
KEY = 24  # characters that a word is looked up by


def _words(queries: DataFrame) -> DataFrame:
    """queries with their distinct words."""
    words = F.filter(F.transform(F.split("query", r"\s+"), lambda w: F.regexp_replace(w, r"(?U)\W+", "")), lambda w: w != "")
    return queries.select("qid", F.array_distinct(words).alias("words"))


class _Within(dict):
    """Runs of characters and their places; the numbers of the words that lie within a run are sought when it is first met."""

    def __init__(self, words: dict[str, int], known: dict[str, list[int]]) -> None:
        super().__init__()
        self.numbers, self.start, self.room = array("q"), array("q", [0]), KNOWN
        self.heads: dict[str, int] = {}  # the beginnings of words, with the number of the word that is one
        self.longer: dict[str, list[tuple[str, int]]] = {}
        for w, n in words.items():
            for size in range(1, min(len(w), KEY) + 1):
                self.heads.setdefault(w[:size], -1)
            if len(w) <= KEY:
                self.heads[w] = n
            else:
                self.longer.setdefault(w[:KEY], []).append((w, n))
        for run, found in known.items():
            self._add(run, found)

    def _add(self, run: str, found) -> int:
        self.numbers.extend(found)
        self.start.append(len(self.numbers))
        self.room -= len(run) + len(found)
        self[run] = n = len(self.start) - 2
        return n

    def __missing__(self, run: str) -> int:
        own, get, size = set(), self.heads.get, len(run)
        for at in range(size):
            end = at + 1
            while end <= size and (n := get(run[at:end])) is not None:
                if n >= 0:
                    own.add(n)
                end += 1
            if end - at > KEY:
                own.update(n for w, n in self.longer.get(run[at : at + KEY], ()) if run.startswith(w, at))
        return self._add(run, own)

    def marked(self, runs: set[str], row: np.ndarray) -> None:
        """True in the row at the numbers of all words within the runs."""
        if self.room < 0:
            self.clear()
            self.numbers, self.start, self.room = array("q"), array("q", [0]), KNOWN
        if runs:
            at = np.fromiter(map(self.__getitem__, runs), np.int64, len(runs))
            start = np.frombuffer(self.start, np.int64)
            first, size = start[at], start[at + 1] - start[at]
            if total := int(size.sum()):
                row[np.frombuffer(self.numbers, np.int64)[np.arange(total) + np.repeat(first - (np.cumsum(size) - size), size)]] = True


def _matched_in_tasks(held: pd.DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, id) of held(qid, word) and chunks: tasks seek all words in the runs of their texts, so neither texts nor pairs are shuffled.

    A word with _ is one that its parts without _ give a hint of; the pattern itself decides. Runs of some texts are looked up beforehand.
    """
    held = held.drop_duplicates().sort_values(["qid", "word"], ignore_index=True)
    number = {w: n for n, w in enumerate(dict.fromkeys(held["word"]))}
    place = held["word"].map(number).to_numpy(np.int64)
    qid, start = np.unique(held["qid"].to_numpy(np.int64), return_index=True)
    width, plain, wild = len(number), {w: n for w, n in number.items() if "_" not in w}, []
    for w, n in number.items():
        if "_" in w:
            parts = [plain.setdefault(x, len(number) + len(plain)) for x in w.split("_") if x]
            wild.append((n, parts, re.compile("".join("." if c == "_" else re.escape(c) for c in w), re.S)))
    spark = chunks.sparkSession
    some = chunks.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(RUN), 0))).alias("run"))
    some = dict.fromkeys(r["run"] for r in some.where(F.length("run") <= LONGEST).limit(RUNS_TAKEN).collect())  # so no more than the first files are opened
    listed = lambda name, x: spark.createDataFrame(pd.DataFrame({name: pd.Series(x, dtype=object)}), f"{name} string")
    given = containing(listed("run", list(some)[:RUNS_GIVEN]), ["run"], listed("word", list(plain))).groupBy("run").agg(F.collect_set("word").alias("found")).collect()
    known = {r["run"]: [plain[w] for w in r["found"]] for r in given}
    step = max(1, CELLS // max(1, len(place)))
    size = max([width, *[n + 1 for n in plain.values()]])

    def run(batches):
        import pyarrow as pa

        within, runs_of = _Within(plain, known), re.compile(RUN).findall
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            for at in range(0, len(ids), step):
                part = texts.slice(at, step).to_pylist()
                there = np.zeros((len(part), size), bool)
                for row, text in zip(there, part):
                    if text is not None:
                        within.marked(set(runs_of(text)), row)
                        for n, parts, pattern in wild:
                            row[n] = row[parts].all() and pattern.search(text) is not None
                r, c = np.nonzero(np.logical_or.reduceat(there[:, place], start, axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(qid[c]), pa.array(ids[at + r])], ["qid", "id"])

    if not len(held):
        return spark.createDataFrame([], "qid long, id long")
    met = lambda x: x.select("id", F.lower("content").alias("text")).mapInArrow(run, "qid long, id long")
    # an id that several chunks bear has its queries once
    again = kept(chunks.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "again")
    if again.isEmpty():
        return met(chunks)
    again = broadcast_if_small(again)
    return met(chunks.join(again, "id", "left_anti")).unionByName(met(chunks.join(again, "id", "left_semi")).distinct())


def _joined_matches(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """flat_matches of more words than tasks hold: words are sought in the distinct runs of all chunks, and chunks meet the words by their runs."""
    to = kept(queries.select("qid", F.explode("words").alias("word")).groupBy(F.lower("word").alias("word")).agg(F.collect_set("qid").alias("qids")), "words")
    words, wild = to.select("word"), F.contains("word", F.lit("_"))
    runs = chunks.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit(WORD), 0))).alias("run"))
    holds = containing(runs.select("run").distinct(), ["run"], words.where(~wild)).groupBy("run").agg(F.collect_set("word").alias("found"))
    hits = runs.join(broadcast_if_small(kept(holds, "runs"), TOKENS_HELD), "run").select("id", F.explode("found").alias("word"))
    hits = hits.unionByName(containing(chunks.select("id", "content"), ["content"], words.where(wild)).select("id", "word"))
    found = hits.groupBy("id").agg(F.collect_set("word").alias("found")).select("id", F.explode("found").alias("word"))
    met = found.join(broadcast_if_small(to), "word").groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("qids"))).alias("qids"))
    return met.select(F.explode("qids").alias("qid"), "id")


def flat_matches(queries: DataFrame, chunks: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(qid, id) of chunks that contain any word of the query, letter case aside; _ in a word stands for any character. Of pairs(qid, id) alone where given.

    A word without _ lies within one run of word characters, so words are sought in distinct runs. Nothing is shuffled up to WORDS_HELD words of
    all queries; more are joined.
    """
    own = _words(queries)
    if pairs is not None:
        x = pairs.select("qid", "id").distinct().join(own, "qid").join(chunks.select("id", "content"), "id")
        return x.where(F.exists("words", lambda w: F.ilike("content", F.concat(F.lit("%"), w, F.lit("%"))))).select("qid", "id").distinct()
    held = own.select("qid", F.explode("words").alias("word")).select("qid", F.lower("word").alias("word")).limit(WORDS_HELD + 1).toPandas()
    return _joined_matches(own, chunks) if len(held) > WORDS_HELD else _matched_in_tasks(held, chunks)


def merged(*stages: DataFrame) -> DataFrame:
    """Union of (qid, id, distance) in stages; the first stage that has an id wins. Adds via."""
    names = ["semantic", "structural", "keyword", "memory"]
    out = None
    for i, s in enumerate(stages):
        s = s.select("qid", "id", "distance", F.lit(i).alias("stage"))
        out = s if out is None else out.unionByName(s)
    best = out.groupBy("qid", "id").agg(F.min_by("distance", "stage").alias("distance"), F.min("stage").alias("stage"))
    return best.withColumn("via", F.get(F.array(*[F.lit(n) for n in names]), F.col("stage")))


def memory_candidates(queries: DataFrame, facts: DataFrame, as_of: Column, k: int = MEMORY) -> DataFrame:
    """(qid, id, distance) of the best facts of the query's workspace, similarity times effective confidence.

    Ids are -1 - fact_id, so they never meet those of chunks. Queries without a workspace have none.
    """
    from .memory import rank_facts

    best = rank_facts(queries.where("workspace_id is not null"), facts, k, as_of)
    return best.select("qid", (-1 - F.col("id")).alias("id"), (1 - F.col("score")).alias("distance"))


def fused(candidates: DataFrame, chunks: DataFrame, ranks: DataFrame | None, as_of: Column, threshold: float = 0.0, decay: bool = True) -> DataFrame:
    """candidates with score: similarity plus weighted keyword rank, decayed by whole weeks since authored_at. At 12 digits, so equal ones go by id whatever stage found them."""
    x = candidates.join(chunks.select("id", "file_path", "doc_id", "authored_at"), "id")
    rank = F.lit(0.0)
    if ranks is not None:
        x = x.join(ranks.select("qid", "id", "rank"), ["qid", "id"], "left")
        rank = F.coalesce("rank", F.lit(0.0))
    score = (1 - F.col("distance")) * TITLE_WEIGHT + KEYWORD_WEIGHT * rank
    if decay:
        score = F.when(F.col("authored_at").isNotNull(), score * F.pow(F.lit(DECAY), weeks_between(F.col("authored_at"), as_of))).otherwise(score)
    return x.withColumn("score", F.round(score, 12)).where(F.col("score") >= threshold)


def diverse(results: DataFrame, k: int, per_file: int = PER_FILE) -> DataFrame:
    """The first k with rank: per_file results of a file come first, the rest fill up; no file, no cap."""
    r = F.row_number().over(Window.partitionBy("qid", "file_path").orderBy(F.desc("score"), "id"))
    x = results.withColumn("over", F.col("file_path").isNotNull() & (r > per_file))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("over", F.desc("score"), "id"))
    return x.withColumn("rank", rank).where(F.col("rank") <= k).drop("over")


def confidence(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(qid, confidence): the squashed mean of the first scores, 0 without results."""
    mean = results.where(F.col("rank") <= CONFIDENCE_WINDOW).groupBy("qid").agg(F.avg("score").alias("mean"))
    return queries.select("qid").join(mean, "qid", "left").select("qid", F.coalesce(squash(F.col("mean")), F.lit(0.0)).alias("confidence"))


def hybrid(queries: DataFrame, chunks: DataFrame, edges: DataFrame, as_of: Column, k: int = 10, include_archived: bool = False, expand: bool = True, decay: bool = True, threshold: float = 0.0, corpus: Corpus = Corpus(), filters: dict | None = None, facts: DataFrame | None = None, index=None, vectors=None) -> DataFrame:
    """The whole pipeline; (qid, id, rank, score, via, distance, doc_id, file_path). Facts take part where they are given.

    ``index`` and ``vectors``, a `TextIndex` and a `VectorIndex` of all chunks, spare taking texts apart and reading all vectors.
    """
    narrowed = lambda x: filtered(live(x, include_archived), filters, corpus)
    c = narrowed(chunks)
    found = kept(semantic(queries, c, vectors=vectors, where=narrowed), "found")
    stages = [found]
    if expand:
        stages.append(structural(found, queries, c, edges))
    wanted = query_terms(queries).select("term").distinct()
    scoped_ = "scope" in queries.columns
    if index is None:
        held = postings(c, corpus.fields, wanted)
        if scoped_:
            held = held.join(c.select("id", F.col("project").alias("g")), "id")
    else:
        held = index.postings(wanted, corpus.fields)
        held = held.join(c.select("id", F.col("project").alias("g")), "id") if scoped_ else held.join(c.select("id"), "id", "left_semi")
    present = merged(*stages)
    ranks = keyword_best(queries, held, present)
    stages.append(distances(ranks.where("rn is not null").select("qid", "id"), queries, c))
    if not corpus.graded:
        ranks = flat_matches(queries, c, kept(merged(*stages), "candidates")).withColumn("rank", F.lit(FLAT_BOOST / KEYWORD_WEIGHT))
    found = fused(merged(*stages), c, ranks, as_of, threshold, decay)
    if facts is not None:
        m = memory_candidates(queries, facts, as_of).withColumns({"score": 1 - F.col("distance"), "via": F.lit("memory"), "file_path": F.lit(None).cast("string"), "doc_id": F.lit(None).cast("string")})
        cols = ["qid", "id", "distance", "via", "score", "file_path", "doc_id"]
        found = found.select(*cols).unionByName(m.where(F.col("score") >= threshold).select(*cols))
    return diverse(found, k)


def exact_id(queries: DataFrame, chunks: DataFrame, limit: int = 5) -> DataFrame:
    """Chunks whose doc_id or path contains the id that a query names; doc_id hits first, then path, then id."""
    ids = queries.select("qid", F.lower(first_structured_id(F.col("query"))).alias("word")).where("word is not null")
    # queries that name the same id share its rows
    hit = containing(chunks.select("id", "doc_id", "file_path"), ["doc_id", "file_path"], ids.select("word").distinct()).distinct()
    first = F.when(F.ilike("doc_id", F.concat(F.lit("%"), F.col("word"), F.lit("%"))), 0).otherwise(1)
    rn = F.row_number().over(Window.partitionBy("word").orderBy(first, "file_path", "id"))
    best = hit.withColumn("rn", rn).where(F.col("rn") <= limit)
    return ids.join(best, "word")


def recall(queries: DataFrame, chunks: DataFrame, edges: DataFrame, as_of: Column, limit: int = 5, **options) -> DataFrame:
    """(qid, id, doc_id, file_path, title, section, score, via, rn), one shape on every path, of queries(qid, qvec, query, mode).

    A query that names an id is looked up by it, even if nothing is found; of the others, those of mode 'hybrid' take the whole
    pipeline and all else go by meaning. A query may have a ``scope``: the project that it is confined to.
    """
    named = first_structured_id(F.col("query")).isNotNull()
    mixed = F.coalesce(F.col("mode") == "hybrid", F.lit(False))
    exact = exact_id(queries.where(named), chunks, limit).select("qid", "id", F.lit(1.0).alias("score"), F.lit("exact-id").alias("via"), "rn")
    near = semantic(queries.where(~named & ~mixed), chunks, limit).select("qid", "id", (1 - F.col("distance")).alias("score"), F.lit("semantic").alias("via"), "rn")
    both = hybrid(queries.where(~named & mixed), chunks, edges, as_of, limit, **options).select("qid", "id", "score", "via", F.col("rank").alias("rn"))
    return shaped(exact.unionByName(near).unionByName(both), chunks)


def shaped(results: DataFrame, chunks: DataFrame) -> DataFrame:
    return results.join(chunks.select("id", "doc_id", "file_path", "title", "section"), "id").select("qid", "id", "doc_id", "file_path", "title", "section", "score", "via", "rn")


def scoped(filters: Column, workspace: Column) -> Column:
    """Project to filter by: an explicit one wins over the workspace."""
    return F.coalesce(filters, workspace)
