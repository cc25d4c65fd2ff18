"""Exact Jaccard join of documents by word shingles, in the metric space of the Jaccard distance.

Two steps cut the documents into regions, so that every linked pair shares one:

* A prefix filter on shingles, the rarest first: any document within the threshold of another also holds one of that one's first
  ``n - ceil(t n) + 1`` shingles in that order, so a document is copied to the regions of these and of no others. Most
  regions hold one document or a few. Their pairs are kept while the sizes and the order of the shared shingles allow the
  threshold. Most links are found here.
* Regions that stay large hold groups of close copies. Their documents are cut by pivot documents into Voronoi balls:
  each is at home in the ball of its nearest pivot, if that is within ``radius``, and is copied to other balls within
  ``radius + eps`` whose pivot is at most ``2 eps`` farther than its own. What no ball holds goes to the next round with
  new pivots. Documents that link with their ball's pivot are of one component by that (its core) and aren't compared
  with each other. A ball that stays large is a region to be cut again, by pivots of its own at half the radius, in the same way;
  the documents drawn for that are witnesses too: who links with one of the core's joins the core. All other pairs of a
  region are compared exactly, block against block.

Only a spanning forest of a block's links leaves its task, never all pairs of a group; the components come
from these links. Copies with one shingle set are one document throughout.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected, stored, table, tidy
from .suffix_dedup import BASE, BASE_INVERSE, BYTES, bytes_of, mix, powers

SLOTS = 20  # log2 of the counters that words are counted in
SMALL = 40  # documents in a region whose pairs are listed one by one
RADIUS = 0.5
PIVOTS = 128
SAMPLE = 1000  # documents that a round's pivots are chosen from
ROUNDS = 4
LEVELS = 4  # times that a ball is cut again
WITNESSES = 200  # documents that a region's pivots are chosen from
SAMPLE_BYTES = 1 << 26  # bytes of any such sample's sets
BLOCK = 250
BLOCK_BYTES = 1 << 24
BROADCAST_IDS = 1_000_000
TOP_BIT = np.uint64(1 << 63)

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS = [powers(BASE, 1 << 16), powers(BASE_INVERSE, 1 << 16)]


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of each word; only A-Z are lower-cased."""
    data = LOWER[bytes_of(text)]
    if not len(data):
        return np.zeros(0, np.uint64)
    while len(_POWERS[0]) <= len(data):
        n = 2 * len(_POWERS[0])
        _POWERS[:] = [powers(BASE, n), powers(BASE_INVERSE, n)]
    inside = np.concatenate([[False], ~SPACE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    a, z = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * _POWERS[0][: len(data)], out=total[1:])
    return mix((total[z] - total[a]) * _POWERS[1][a] + (z - a).astype(np.uint64))


def shingles(text: str | None, words: int, level: np.ndarray) -> np.ndarray:
    """The document's set in order: the level of a shingle's rarest word (6 bits), then 58 bits of hash."""
    w = word_hashes(text)
    if not len(w):
        return w
    size = min(words, len(w))
    h, rare = np.full(len(w) - size + 1, size, np.uint64), None
    for i in range(size):
        part = w[i : len(w) - size + 1 + i]
        h = mix(h + part)
        q = level[part & np.uint64(len(level) - 1)]
        rare = q if rare is None else np.minimum(rare, q)
    return np.unique((rare.astype(np.uint64) << np.uint64(58)) | (h >> np.uint64(6)))


def word_levels(docs: DataFrame) -> np.ndarray:
    """Twice the log2 of each counter, words of all documents counted in 2**SLOTS counters. Only an order
    follows from it, so counters that words share, or lone words of a task, cost time but no result."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy()
        n = np.zeros(1 << SLOTS, np.int64)
        for b in batches:
            for at in range(0, len(b), 500):
                h = np.concatenate([word_hashes(t) for t in b["text"].iloc[at : at + 500]])
                n += np.bincount((h & np.uint64((1 << SLOTS) - 1)).astype(np.int64), minlength=1 << SLOTS)
        slot = np.flatnonzero(n > 1)
        yield pd.DataFrame({"slot": slot, "n": n[slot]})

    counts = docs.select("text").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    level = np.zeros(1 << SLOTS, np.uint8)
    level[counts["slot"].to_numpy()] = np.minimum(63, 2 * np.log2(counts["n"].to_numpy())).astype(np.uint8)
    return level


def least_common(n: int, percent: int) -> int:
    """Shingles that a set of n shares with any set at the threshold, at least."""
    return -(-percent * n // 100)


def features(docs: DataFrame, words: int, percent: int, level) -> DataFrame:
    """doc_id, n, two digests of the set, and the shingles whose regions the document goes to: in order, as
    longs with the top bit flipped, so that longs have the order of the unsigned shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy()
        for b in batches:
            for at in range(0, len(b), 1000):
                out = []
                for doc, text in zip(b["doc_id"].iloc[at : at + 1000], b["text"].iloc[at : at + 1000]):
                    s = shingles(text, words, level.value)
                    n = len(s)
                    d = (int(mix(s).sum()), int(mix(s ^ np.uint64(0x5555)).sum())) if n else (0, 0)
                    out.append((doc, n, *(x - (1 << 64) if x >> 63 else x for x in d), (s[: n - least_common(n, percent) + 1] ^ TOP_BIT).view(np.int64) if n else []))
                yield pd.DataFrame(out, columns=["doc_id", "n", "d1", "d2", "first"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n long, d1 long, d2 long, first array<long>")


def small_pairs(regions: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share a small region and may link.

    With c shared shingles among the first ones, the set whose first ones end earlier has all but c of them
    outside the other set, and so has the other set up to the last shared place. The sum can't exceed the
    symmetric difference that the threshold allows. A pair that shares a large region too may be left out here,
    as not all of its shared shingles are counted; large regions are compared on their own.
    """
    x = regions.select("token", *[F.col(c).alias(f"{c}1") for c in ("doc_id", "n", "pos", "k", "last", "dense")])
    y = regions.select("token", *[F.col(c).alias(f"{c}2") for c in ("doc_id", "n", "pos", "k", "last", "dense")])
    both = x.join(y, "token").where("doc_id1 < doc_id2 and not (dense1 and dense2)")
    both = both.where((F.least("n1", "n2") * 100 >= percent * F.greatest("n1", "n2")))
    pairs = both.groupBy(F.col("doc_id1").alias("a"), F.col("doc_id2").alias("b")).agg(
        F.count("*").alias("c"), F.max("pos1").alias("i"), F.max("pos2").alias("j"), *[F.first(c).alias(c) for c in ("n1", "n2", "k1", "k2", "last1", "last2")]
    )
    apart = F.when(F.col("last1") <= F.col("last2"), F.col("k1") - F.col("c") + F.col("j") - F.col("c")).otherwise(F.col("k2") - F.col("c") + F.col("i") - F.col("c"))
    return pairs.where(apart * (100 + percent) <= (100 - percent) * (F.col("n1") + F.col("n2"))).select("a", "b")


def shingle_sets(docs: DataFrame, ids: DataFrame, words: int, level) -> DataFrame:
    """doc_id, n, tokens (8 bytes each) of the documents named by ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy()
        for b in batches:
            for at in range(0, len(b), 1000):
                sets = [shingles(t, words, level.value) for t in b["text"].iloc[at : at + 1000]]
                yield pd.DataFrame({"doc_id": b["doc_id"].iloc[at : at + 1000].to_numpy(), "n": [len(s) for s in sets], "tokens": [s.tobytes() for s in sets]})

    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInPandas(run, "doc_id long, n long, tokens binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) at the threshold. Both sets travel to each pair."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy()
        for b in batches:
            keep = []
            for s, t in zip(b["s"], b["t"]):
                both = len(np.intersect1d(x := np.frombuffer(s, np.uint64), y := np.frombuffer(t, np.uint64), assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.loc[keep, ["a", "b"]]

    x = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("s")), "a")
    return x.join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("t")), "b").mapInPandas(run, "a long, b long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices; shingles of one set alone are left out."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    token, inverse, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(n > 1) - 1
    keep = n[inverse] > 1
    row, col = row[keep], number[inverse[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((m, m), np.float32)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, 2048):
        a, z = np.searchsorted(col, [at, at + 2048])
        x = np.zeros((m, 2048), np.float32)
        x[row[a:z], col[a:z] - at] = 1
        out += x @ x.T
    return out


def forest(a: np.ndarray, b: np.ndarray, m: int) -> list[tuple[int, int]]:
    """Of links between 0..m-1, a spanning forest."""
    up = list(range(m))

    def root(v: int) -> int:
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        if (x := root(i)) != (y := root(j)):
            up[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def blocks(docs, size) -> F.Column:
    """Blocks for so many documents of so many bytes."""
    return F.ceil(F.greatest(docs / BLOCK, size / BLOCK_BYTES)).cast("int")


def compared(groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within each group of groups(key, doc_id, tokens, core): blocks of about BLOCK documents and
    BLOCK_BYTES at most, each block against each, a spanning forest of every two blocks' links. Two documents that are core in a
    group, and so linked already, needn't be found."""
    long = F.length("tokens").cast("long")
    size = groups.groupBy("key").agg(*[blocks(F.count_if(c), F.coalesce(F.sum(F.when(c, long)), F.lit(0))).alias(name) for name, c in [("rest", ~F.col("core")), ("cores", F.col("core"))]])
    rows = groups.join(size.where("rest > 0"), "key")
    h = F.xxhash64("doc_id")
    rows = rows.withColumn("mine", F.when(F.col("core"), F.col("rest") + F.pmod(h, F.col("cores"))).otherwise(F.pmod(h, F.col("rest"))).cast("int"))
    other = F.when(F.col("core"), F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") + F.col("cores") - 1))
    rows = rows.select("key", "doc_id", "tokens", "mine", F.explode(other).alias("other"))
    rows = rows.select("key", "doc_id", "tokens", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"))

    def run(b: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(t, np.uint64) for t in b["tokens"]]
        n = np.array([len(s) for s in sets])
        both = overlaps(sets)
        i, j = np.nonzero(np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1))
        doc = b["doc_id"].to_numpy()
        return pd.DataFrame([(doc[x], doc[y]) for x, y in forest(i, j, len(b))], columns=["a", "b"])

    return rows.groupBy("key", "b1", "b2").applyInPandas(run, "a long, b long")


class Pivots:
    """Pivot documents, their sets laid out so that one search gives what a set shares with all of them."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]) -> None:
        self.ids = ids
        self.n = np.array([len(s) for s in sets])
        token = np.concatenate(sets)
        self.whose = np.repeat(np.arange(len(sets)), self.n)[order := np.argsort(token, kind="stable")]
        self.token = token[order]

    def shared(self, s: np.ndarray) -> np.ndarray:
        a, z = np.searchsorted(self.token, s, "left"), np.searchsorted(self.token, s, "right")
        hit = z > a
        at = np.concatenate([np.arange(x, y) for x, y in zip(a[hit], z[hit])]) if hit.any() else np.zeros(0, int)
        return np.bincount(self.whose[at], minlength=len(self.n))


def apart(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of all pairs of sets: shared elements, elements of either."""
    n = np.array([len(s) for s in sets])
    both = overlaps(sets)
    both[np.arange(len(n)), np.arange(len(n))] = n
    return both, n[:, None] + n[None, :] - both


def spread(near: np.ndarray, most: int) -> list[int]:
    """Places of which none is near another, those with most others around them first."""
    free, out = np.ones(len(near), bool), []
    while free.any() and len(out) < most:
        best = int(np.where(free, (near & free).sum(axis=1), -1).argmax())
        out.append(best)
        free &= ~near[best]
    return out


def choose_pivots(ids: list[int], sample: list[np.ndarray]) -> Pivots | None:
    """Documents farther than RADIUS from each other."""
    if not sample:
        return None
    both, either = apart(sample)
    out = spread(1 - both / either <= RADIUS, PIVOTS)
    return Pivots([ids[i] for i in out], [sample[i] for i in out])


def seats(d: np.ndarray, radius: float, eps: float) -> tuple[int, np.ndarray]:
    """For distances to pivots: the ball that a document is at home in (or -1), and those that it is copied to."""
    home, near = int(d.argmin()), np.flatnonzero(d <= radius + eps + 1e-9)
    if d[home] > radius:
        return -1, near
    return home, near[(near < home) & (d[near] <= d[home] + 2 * eps + 1e-9)]  # a link between two homes is found in the lower one


class Witnesses:
    """A region's drawn documents: all tell who is core, some are pivots of the smaller balls.

    If the smaller balls, tried on the drawn documents that are no pivots, would leave over half of the region's pairs to compare, or if most
    are pivots, the region has no pivots and stays whole: where documents stand less than the windows apart, no ball tells them apart.
    """

    def __init__(self, ids: list[int], sets: list[np.ndarray], core: np.ndarray, radius: float, percent: int) -> None:
        self.all, self.percent, self.radius, self.eps = Pivots(ids, sets), percent, radius, 1 - percent / 100
        both, either = apart(sets)
        i, j = np.nonzero(np.triu(100 * both >= percent * either, 1))
        tree = forest(i, j, len(ids))
        self.tree: dict[int, list[int]] = {}
        for x, y in tree:
            self.tree.setdefault(ids[x], []).append(ids[y])
        at = np.flatnonzero(core)  # the core is one component already
        self.label = np.arange(len(ids))
        for x, y in [*zip(at[:1].repeat(len(at)), at), *tree]:
            self.label[self.label == self.label[y]] = self.label[x]
        self.core = {int(self.label[at[0]])} if len(at) else set()
        self.main = int(np.bincount(self.label).argmax())  # core of what no ball holds
        tried, self.pivots = np.array(spread(1 - both / either <= radius, PIVOTS)), np.zeros(0, int)
        test = [x for i, x in enumerate(zip(ids, sets, core)) if i not in set(tried.tolist())]
        whole = self.pairs(test)
        self.pivots = tried
        if 2 * len(test) < len(ids) or 2 * self.pairs(test) > whole:
            self.pivots = tried[:0]

    def pairs(self, docs: list[tuple[int, np.ndarray, bool]]) -> int:
        """Pairs to compare if these documents were all."""
        n: dict[int, list[int]] = {}
        for doc, s, core in docs:
            for ball, inside in self.deal(doc, s, bool(core))[0]:
                n.setdefault(ball, [0, 0])[int(inside)] += 1
        return sum(rest * (rest + inside) for rest, inside in n.values())

    def deal(self, doc: int, s: np.ndarray, core: bool) -> tuple[list[tuple[int, bool]], list[int]]:
        """A document's balls (-1: no ball holds it, -2: the region stays whole), each with whether it is core there, and witnesses that it links with: one a component,
        and for a witness those that hold its component together."""
        both = self.all.shared(s)
        either = self.all.n + len(s) - both
        label, first = np.unique(self.label[linked := np.flatnonzero(100 * both >= self.percent * either)], return_index=True)
        mine = {*label.tolist(), *(self.core if core else ())}
        home, near = -2, self.pivots[:0]
        if len(self.pivots):
            home, near = seats((1 - both / either)[self.pivots], self.radius, self.eps)
        out = [(int(j), int(self.label[self.pivots[j]]) in mine) for j in near]
        out.append((home, (self.main if home < 0 else int(self.label[self.pivots[home]])) in mine))
        new = [i for i, x in zip(linked[first], label.tolist()) if not (core and x in self.core)]
        return out, [self.all.ids[i] for i in new] + self.tree.get(doc, [])


def dealer(radius: float, percent: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Deals a part of a region, given its witnesses."""

    def deal(x: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        w, out = w.sort_values("doc_id"), []
        told = Witnesses(w["doc_id"].tolist(), [np.frombuffer(t, np.uint64) for t in w["tokens"]], w["core"].to_numpy(bool), radius, percent) if len(w) else None
        for key, doc, tokens, core in zip(x["key"], x["doc_id"], x["tokens"], x["core"]):
            seated, found = told.deal(doc, np.frombuffer(tokens, np.uint64), bool(core)) if told else ([(-2, bool(core))], [])
            out += [(key, ball, doc, tokens, inside, found if i == 0 else []) for i, (ball, inside) in enumerate(seated)]
        return pd.DataFrame(out, columns=["key", "ball", "doc_id", "tokens", "core", "found"])

    return deal


def cut_again(regions: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Regions(key, doc_id, tokens, core) as regions that are small or that LEVELS cuts didn't make small, and the links found meanwhile.

    A region is dealt in parts of about BLOCK documents, each with all witnesses of the region, whose number and bytes are bounded.
    """
    spark, done, links = regions.sparkSession, [], []
    for k in range(1, LEVELS + 1):
        size = regions.groupBy("key").agg(F.count("*").alias("docs"), F.sum(F.length("tokens").cast("long")).alias("size"), F.count_if(~F.col("core")).alias("rest"))
        size = stored(size.select("*", (F.col("rest") * F.col("docs") > BLOCK * BLOCK).alias("large")), "sizes")
        done.append(regions.join(size.where("rest > 0 and not large").select("key"), "key", "left_semi"))
        size = size.where("large").select("key", blocks(F.col("docs"), F.col("size")).alias("parts"), F.least(WITNESSES / F.col("docs"), SAMPLE_BYTES / F.col("size")).alias("share"))
        if size.isEmpty():
            return functools.reduce(DataFrame.union, done), links
        rows = regions.join(size, "key")
        drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(1_000_000)) < F.col("share") * 1_000_000)
        drawn = drawn.select("key", "doc_id", "tokens", "core", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).toDF("key", "doc_id", "tokens", "core", "part")
        rows = rows.select("key", "doc_id", "tokens", "core", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"))

        dealt = rows.groupBy("key", "part").cogroup(drawn.groupBy("key", "part")).applyInPandas(dealer(max(RADIUS / 2**k, 1 - percent / 100), percent), "key long, ball long, doc_id long, tokens binary, core boolean, found array<long>")
        dealt = stored(dealt, "cut")
        links.append(dealt.select(F.col("doc_id").alias("a"), F.explode("found").alias("b")).where("a <> b"))
        after = dealt.select(F.xxhash64("key", "ball", F.lit(k)).alias("key"), "doc_id", "tokens", "core", "ball")
        done.append(after.where("ball = -2").drop("ball"))
        regions = after.where("ball <> -2").drop("ball")
    done.append(regions)
    return functools.reduce(DataFrame.union, done), links


def dense_links(sets: DataFrame, regions: DataFrame, percent: int) -> list[DataFrame]:
    """Links among the documents of large regions. sets: theirs; regions: rows of all shared regions."""
    eps = 1 - percent / 100
    links, rest = [], sets
    for k in range(ROUNDS):
        docs, size = rest.agg(F.count("*"), F.sum(F.length("tokens").cast("long"))).first()
        most = min(SAMPLE, 1 + SAMPLE_BYTES * docs // max(size or 0, 1))
        drawn = list(rest.orderBy(F.xxhash64("doc_id", F.lit(k)), "doc_id").limit(most).select("doc_id", "tokens").toLocalIterator())
        if not drawn:
            return links
        pivots = choose_pivots([r["doc_id"] for r in drawn], [np.frombuffer(r["tokens"], np.uint64) for r in drawn])

        def deal(batches: Iterator[pd.DataFrame], pivots=pivots) -> Iterator[pd.DataFrame]:
            tidy()
            for b in batches:
                out = []
                for doc, n, tokens in zip(b["doc_id"], b["n"], b["tokens"]):
                    both = pivots.shared(np.frombuffer(tokens, np.uint64))
                    either = pivots.n + n - both
                    core = 100 * both >= percent * either
                    home, near = seats(1 - both / either, RADIUS, eps)
                    if home < 0:
                        out.append((-1, doc, n, tokens, False, None))
                    out += [(int(j), doc, n, tokens, bool(core[j]), pivots.ids[j] if core[j] else None) for j in [*near, *([home] if home >= 0 else [])]]
                part = pd.DataFrame(out, columns=["key", "doc_id", "n", "tokens", "core", "pivot"])
                yield part.assign(pivot=part["pivot"].astype("Int64"))

        dealt = stored(rest.mapInPandas(deal, "key long, doc_id long, n long, tokens binary, core boolean, pivot long"), "balls")
        links.append(dealt.where("pivot <> doc_id").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")))
        small, found = cut_again(dealt.where("key >= 0").select("key", "doc_id", "tokens", "core"), percent)
        links += [*found, stored(compared(small, percent), "links")]
        rest = dealt.where("key < 0").select("doc_id", "n", "tokens")
    # what no pivot is near to: large regions one by one, and pair by pair what shares small ones alone
    mine = stored(regions.join(rest.select("doc_id"), "doc_id", "left_semi"), "left")
    last = rest.join(mine.where(F.col("docs") > SMALL).select("doc_id", F.col("token").alias("key")), "doc_id").select("key", "doc_id", "tokens", F.lit(False).alias("core"))
    small, found = cut_again(last, percent)
    links += [*found, stored(compared(small, percent), "links")]
    pairs = small_pairs(mine.where(F.col("docs") <= SMALL).withColumn("dense", F.lit(False)), percent)
    links.append(stored(verified(pairs, rest, percent), "links"))
    return links


def jaccard_join(docs: DataFrame, words: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text).

    Texts are whole. Without words or text the set is empty and links with nothing: the document is a component
    of its own. Repeated rows give repeated results; rows without a doc_id have no component. Other columns are
    ignored and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    level = spark.sparkContext.broadcast(word_levels(docs))
    found = stored(features(docs, words, percent, level), "features")
    some = found.where("n > 0 and doc_id is not null")
    # one document for all with the same set
    classes = stored(some.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "classes")
    rows = some.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rows = rows.select("doc_id", "n", F.size("first").alias("k"), F.element_at("first", -1).alias("last"), F.posexplode("first").alias("pos", "token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("docs")).where("docs > 1")
    shared = stored(rows.withColumn("pos", F.col("pos") + 1).join(counts, "token"), "regions")
    dense = stored(shared.where(F.col("docs") > SMALL).select("doc_id").distinct(), "dense")
    regions = shared.where(F.col("docs") <= SMALL).join(dense.withColumn("dense", F.lit(True)), "doc_id", "left").withColumn("dense", F.coalesce("dense", F.lit(False)))
    pairs = stored(small_pairs(regions, percent), "pairs")
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(dense).distinct(), "ids")
    sets = stored(shingle_sets(docs, ids, words, level), "sets")
    links = [stored(verified(pairs, sets, percent), "links"), *dense_links(sets.join(dense, "doc_id", "left_semi"), shared, percent)]
    edges = links[0]
    for x in links[1:]:
        edges = edges.union(x)
    component = connected(edges).select(F.col("id").alias("rep"), F.col("component_id"))
    members = some.select("doc_id", "n", "d1", "d2").join(classes, ["n", "d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), "rep")
    members = stored(members, "members").join(component, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    empty = found.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return members.unionByName(empty)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def brute_force(texts: dict[int, str | None], words: int, percent: int) -> dict[int, tuple[int, int]]:
    """For tests: all pairs."""
    sets = {}
    for d, t in texts.items():
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).translate({i: " " for i in range(9, 14)}).split(" ")
        w = [x for x in w if x]
        k = min(words, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    label = {d: d for d in sets}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(label[a], label[b])
            moved |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return {d: (len(s), label[d]) for d, s in sets.items()}
