"""Embedding near-duplicates by dual traversal of a cover tree.

The tree's levels are nested: a node's children are points of it that stand apart by the level's radius, half
that of the level above. It is shaped by a bounded sample of the vectors, but every vector descends to a
leaf, and a node's covering radius is the greatest distance of any vector below it, measured over all. The
traversal starts with the pair (root, root) and opens pairs level by level; a pair whose centres are farther
apart than both covering radii and the threshold's distance can hold no link and is pruned. Leaf pairs that
are left are compared exactly, block against block.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected, shuffle_partitions, stored, table

COSINE = 0.95
SAMPLE = 4096  # vectors that shape the tree; all vectors are in it
FANOUT = 16
LEVELS = 6
BLOCK = 3000  # vectors in a leaf or a block of one, about
ROWS = 500  # rows of a block that are multiplied at once
BROADCAST_TASKS = 200_000
BEGUN = 1000  # node pairs that the driver opens


class Tree:
    """Nodes as arrays: centre, parent, level and the list of children."""

    def __init__(self, sample: np.ndarray, leaf: float) -> None:
        self.centre, self.children, self.depth = [sample[0]], [[]], [0]
        self.grow(0, sample, 1.0, leaf)
        self.centre = np.array(self.centre)

    def grow(self, node: int, points: np.ndarray, radius: float, leaf: float) -> None:
        if len(points) <= leaf or self.depth[node] >= LEVELS or len(points) < 2:
            return
        # the node's own centre is its first child: levels are nested
        near = np.linalg.norm(points - self.centre[node], axis=1)
        whose, centres = np.zeros(len(points), int), [self.centre[node]]
        # no more children than leaves are due here: a vector travels once for each leaf it is compared with
        most = min(FANOUT, max(2, math.ceil(len(points) / leaf)))
        while near.max() > radius and len(centres) < most:
            c = points[int(near.argmax())]
            d = np.linalg.norm(points - c, axis=1)
            whose[d < near] = len(centres)
            near = np.minimum(near, d)
            centres.append(c)
        for i, c in enumerate(centres):
            self.centre.append(c)
            self.children.append([])
            self.depth.append(self.depth[node] + 1)
            child = len(self.centre) - 1
            self.children[node].append(child)
            self.grow(child, points[whose == i], radius / 2, leaf)

    def descend(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]], list[list[float]]]:
        """Leaf of each unit vector, the nodes on its way, and its distances to their centres."""
        at = np.zeros(len(x), int)
        path: list[list[int]] = [[0] for _ in x]
        dist = [[d] for d in np.linalg.norm(x - self.centre[0], axis=1).tolist()]
        todo = np.arange(len(x))
        while len(todo):
            nxt = []
            for node in np.unique(at[todo]):
                if not self.children[node]:
                    continue
                rows, kids = todo[at[todo] == node], np.array(self.children[node])
                d = np.sqrt(np.maximum(0, 2 - 2 * x[rows] @ self.centre[kids].T))
                best = d.argmin(axis=1)
                at[rows] = kids[best]
                for r, k, v in zip(rows.tolist(), kids[best].tolist(), d[np.arange(len(rows)), best].tolist()):
                    path[r].append(k)
                    dist[r].append(v)
                nxt.append(rows)
            todo = np.concatenate(nxt) if nxt else np.zeros(0, int)
        return at, path, dist

    def dual(self, radius: dict[int, float], reach: float, start: list[tuple[int, int]] | None = None, most: int | None = None) -> list[tuple[int, int]]:
        """Leaf pairs (i <= j) below the start (the root with itself) that covering radii don't rule out, nodes without vectors left out.

        With ``most``, the traversal goes level by level and stops at so many pairs, which others may go on from.
        """
        out, todo = [], deque([(0, 0)] if start is None else start)
        while todo and 0 in radius:
            if most is not None and len(todo) + len(out) >= most:
                return out + list(todo)
            a, b = todo.popleft() if most is not None else todo.pop()
            if a != b and np.linalg.norm(self.centre[a] - self.centre[b]) > radius[a] + radius[b] + reach + 1e-6:
                continue
            ka = [k for k in self.children[a] if k in radius]
            kb = [k for k in self.children[b] if k in radius]
            if not ka and not kb:
                out.append((min(a, b), max(a, b)))
            elif a == b:
                todo += [(x, y) for i, x in enumerate(ka) for y in ka[i:]]
            elif ka and (not kb or self.depth[a] <= self.depth[b]):
                todo += [(k, b) for k in ka]
            else:
                todo += [(a, k) for k in kb]
        return out


def unit(v) -> np.ndarray | None:
    """The vector at length 1 in double precision; None for null, zero or non-finite ones."""
    if v is None:
        return None
    try:
        x = np.asarray(v, np.float64)
    except (TypeError, ValueError):
        return None
    if not len(x) or not np.isfinite(x).all():
        return None
    big = np.abs(x).max()
    if big == 0:
        return None
    x = x / big
    return x / np.linalg.norm(x)


def units(x: np.ndarray) -> np.ndarray:
    """Rows at length 1 in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def block_links(a: np.ndarray, b: np.ndarray | None, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links between the rows of a and b, or within a: the number for each row (a's, then b's), and a spanning forest.

    Single precision decides pairs far from the threshold, double precision those near it. Rows go in slices, so
    memory stays small though all may link.
    """
    n = len(a)
    other = a if b is None else b
    off = 0 if b is None else n
    count, label, out = np.zeros(n + (0 if b is None else len(b)), np.int64), np.arange(n + (0 if b is None else len(b))), []
    a32, b32 = a.astype(np.float32), other.astype(np.float32).T
    for at in range(0, n, ROWS):
        s = a32[at : at + ROWS] @ b32
        hit = s >= cosine + 1e-4
        i, j = np.nonzero((s >= cosine - 1e-4) & ~hit)
        for k in range(0, len(i), 100_000):
            x, y = i[k : k + 100_000], j[k : k + 100_000]
            hit[x, y] = (a[at + x] * other[y]).sum(axis=1) >= cosine
        if b is None:  # each pair once
            hit &= np.arange(n)[None, :] > np.arange(at, at + len(s))[:, None]
        count[at : at + len(s)] += hit.sum(axis=1)
        count[off : off + len(other)] += hit.sum(axis=0)
        for r in np.flatnonzero(hit.any(axis=1)):
            j = np.flatnonzero(hit[r]) + off
            which, first = np.unique(label[j], return_index=True)
            mine = label[at + r]
            for w, f in zip(which, j[first]):
                if w != mine:
                    label[label == w] = mine
                    out.append((at + int(r), int(f)))
    return count, out


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vec_id of vectors(vec_id, embedding).

    Vectors that are null, zero or hold null or non-finite numbers link with nothing; so do vectors of different
    widths. Equal vectors under different ids link. Of repeated rows of a vec_id the least embedding counts; a
    null vec_id has no component. Empty tables give an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    one = vectors.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [unit(v) for v in b["embedding"]]
            raw = [None if u is None else np.asarray(v, kind).tobytes() for u, v in zip(x, b["embedding"])]
            yield pd.DataFrame({"vec_id": b["vec_id"], "width": [0 if v is None else len(v) for v in x], "x": raw})

    # the numbers as they are, so that nothing is lost; each use takes them to double precision
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    rows = stored(one.mapInPandas(clean, "vec_id long, width int, x binary"), "vectors")
    good = rows.where("x is not null and vec_id is not null")
    found = []
    for r in good.groupBy("width").agg(F.count("*").alias("n")).orderBy("width").collect():
        found.append(_links_of_width(spark, good.where(F.col("width") == r["width"]), r["n"], kind, cosine))
    ids = rows.select("vec_id")
    if not found:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    counts = out.where("b is null").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    component = connected(out.where("b is not null").select("a", "b")).withColumnRenamed("id", "vec_id")
    joined = ids.join(counts, "vec_id", "left").join(component, "vec_id", "left")
    joined = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return joined.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links_of_width(spark: SparkSession, good: DataFrame, n: int, kind: str, cosine: float) -> DataFrame:
    """(a, b, n): a vector's number of links (b null), and links that span the components (n null)."""
    share = min(1.0, SAMPLE / n)
    sample = good.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003)) < share * 1_000_003).orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * SAMPLE).select("x").collect()
    if not sample:
        sample = good.select("x").limit(1).collect()
    points = units(np.array([np.frombuffer(r["x"], kind) for r in sample]))
    tree = Tree(points, BLOCK * len(points) / n)  # travels with the function, which Spark broadcasts

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, path, dist = tree.descend(units(np.array([np.frombuffer(v, kind) for v in b["x"]]))) if len(b) else ([], [], [])
            yield pd.DataFrame({"vec_id": b["vec_id"], "leaf": at, "path": path, "dist": dist, "x": b["x"]})

    placed = stored(good.mapInPandas(place, "vec_id long, leaf int, path array<int>, dist array<double>, x binary"), "placed")
    way = placed.select(F.explode(F.arrays_zip("path", "dist")).alias("p"))
    radius = {r["node"]: r["radius"] for r in way.groupBy(F.col("p.path").alias("node")).agg(F.max("p.dist").alias("radius")).collect()}
    reach = math.sqrt(2 - 2 * cosine)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for pair in zip(b["i"].tolist(), b["j"].tolist()):
                out = tree.dual(radius, reach, [pair])
                for at in range(0, len(out), 100_000):
                    yield pd.DataFrame(out[at : at + 100_000], columns=["i", "j"])

    # the driver opens the first pairs, tasks all below them
    begun = spark.createDataFrame(tree.dual(radius, reach, most=BEGUN), "i int, j int")
    pairs = begun.repartition(shuffle_partitions(spark)).mapInPandas(finish, "i int, j int")
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = stored(sizes, "leaves")
    # every block of one leaf with every block of the other, once
    tasks = pairs.join(sizes.select(F.col("leaf").alias("i"), F.col("blocks").alias("p")), "i").join(sizes.select(F.col("leaf").alias("j"), F.col("blocks").alias("q")), "j")
    tasks = tasks.select("i", "j", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("u"), "q").select("i", "j", "u", F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("v"))
    tasks = stored(tasks.where("i < j or u <= v").select(F.xxhash64("i", "j", "u", "v").alias("task"), "i", "j", "u", "v"), "tasks")
    sides = tasks.select("task", F.col("i").alias("leaf"), F.col("u").alias("block"), F.lit(0).alias("side")).union(tasks.where("i < j or u < v").select("task", "j", "v", F.lit(1)))
    sides = F.broadcast(sides) if tasks.count() <= BROADCAST_TASKS else sides
    rows = placed.join(sizes, "leaf").select("vec_id", "leaf", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "x").join(sides, ["leaf", "block"]).select("task", "side", "vec_id", "x")

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        x = units(np.frombuffer(b"".join(b["x"]), kind).reshape(len(b), -1))
        order = np.argsort(b["side"].to_numpy(), kind="stable")
        first = int((b["side"] == 0).sum())
        ids, x = b["vec_id"].to_numpy()[order], x[order]
        n, links = block_links(x[:first], x[first:] if first < len(b) else None, cosine)
        some, tree_ = np.flatnonzero(n), np.array(links, int).reshape(-1, 2)
        return pd.DataFrame(
            {
                "a": np.concatenate([ids[some], ids[tree_[:, 0]]]),
                "b": pd.array([None] * len(some) + ids[tree_[:, 1]].tolist(), "Int64"),
                "n": pd.array(n[some].tolist() + [None] * len(tree_), "Int64"),
            }
        )

    return stored(rows.groupBy("task").applyInPandas(compare, "a long, b long, n long"), "links")


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def brute_force(vectors: dict, cosine: float = COSINE) -> dict:
    """For tests: all pairs in double precision."""
    x = {k: unit(v) for k, v in vectors.items()}
    near = {k: [j for j in x if j != k and x[j] is not None and x[k] is not None and len(x[j]) == len(x[k]) and float((x[k] * x[j]).sum()) >= cosine] for k in x}
    label = {k: k for k in x}
    moved = True
    while moved:
        moved = False
        for k in x:
            m = min([label[k], *(label[j] for j in near[k])])
            moved |= m != label[k]
            label[k] = m
    return {k: (len(near[k]), label[k], label[k] == k) for k in x}


OP1_SQL = f"""
with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null),
ok as (select vec_id, e from v where len(e) > 0 and list_aggregate(list_transform(e, lambda x: case when x is null or not isfinite(x) then 1 else 0 end), 'sum') = 0 and list_aggregate(list_transform(e, lambda x: abs(x)), 'max') > 0),
link as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a)
select vec_id, (select count(*) from link where a = vec_id) as n_links,
       least(vec_id, coalesce((select min(b) from reach where a = vec_id), vec_id)) as component_id,
       least(vec_id, coalesce((select min(b) from reach where a = vec_id), vec_id)) = vec_id as kept
from embeddings
"""
