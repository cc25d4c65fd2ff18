"""A stored vector index with exact bounds: inverted lists, skipped where the triangle inequality rules them out.

Centres are fitted on a bounded sample; every vector lies in the list of its nearest centre, and each list has its radius, the largest
angle between a vector and the centre, measured over all of its rows. A query first reads the lists nearest to it. Whatever list
can't hold anything better than the k-th result of that, by its angle less its radius, is never read; the rest are. So
results equal those of all products.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import doubles
from ..sources.generations import Generations
from ..sources.shared import kept
from .retrieval import QUERIES_HELD, Best, directed, least_missing, products, same_group, scored, unit

SAMPLE = 20_000  # vectors that centres are fitted on, those with the least hashes of their ids
MOST_LISTS = 1024
ROUNDS = 8  # of k-means
FIRST = 4  # lists that a query reads before bounds are known
SLACK = 1e-9  # for rounding: bounds are that much wider


def fitted(x: np.ndarray, lists: int, seed: int = 3) -> np.ndarray:
    """Unit centres of unit vectors, by spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.where(size > 0, size, 1), c)
    return c


def _some(rows: DataFrame, n: int) -> DataFrame:
    """Those of n rows whose hash h lies below a bound, about 1.1 * SAMPLE: of an ordered limit each task sends that many rows to the driver, so all have few more among them."""
    share = 1.1 * SAMPLE / max(1, n)
    return rows.where(F.col("h") < F.lit(int((share - 0.5) * 2**64))) if share < 1 else rows


class VectorIndex:
    """Lists of rows(id, embedding, the group's column and the columns ``keep``) below a path."""

    def __init__(self, spark: SparkSession, path: str, keep: tuple[str, ...] = (), group: str = "file_path", lists: int | None = None) -> None:
        self.spark, self.keep, self.group, self.lists = spark, keep, group, lists
        self.store = Generations(  # a folder for each list, so a plan names the lists that it reads
            spark, path, lambda df, at, notes: df.repartitionByRange("list", "id").write.partitionBy("list").parquet(at)
        )
        self.exists, self.compact = self.store.exists, self.store.compact

    def _dealt(self, rows: DataFrame, centres: np.ndarray) -> DataFrame:
        """(grp, id, v, keep..., angle, list). Rows without a direction (null, zero, not finite, of another width) lie in list -1."""
        x = rows.select(F.col(self.group).alias("grp"), "id", doubles(F.col("embedding")).alias("v"), *[c for c in self.keep if c != self.group])
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema)

        def run(batches):
            for b in batches:
                u = unit(b["v"], centres.shape[1])
                ok, s = u.any(axis=1), u @ centres.T
                yield b.assign(angle=np.where(ok, np.arccos(np.clip(s.max(axis=1, initial=-1), -1, 1)), 0.0), list=np.where(ok, s.argmax(axis=1), -1) if len(centres) else -1)

        return x.mapInPandas(run, f"{fields}, angle double, list int")

    @staticmethod
    def _measured(rows: DataFrame) -> DataFrame:
        return rows.where("list >= 0").groupBy("list").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))

    def build(self, rows: DataFrame) -> int:
        """The index of rows, in place of all that was there. The sample bounds what the driver fits; all rows are dealt and measured."""
        have = rows.where("embedding is not null").select("id", doubles(F.col("embedding")).alias("v"), F.xxhash64("id").alias("h"))
        n = have.count()
        sample = _some(have, n).orderBy("h", "id").limit(SAMPLE).select("v").toPandas()
        u = unit(sample["v"], max((len(v) for v in sample["v"]), default=1))
        u = u[u.any(axis=1)]
        centres = fitted(u, self.lists or min(MOST_LISTS, max(1, round(n**0.5)))) if len(u) else np.zeros((0, 1))
        radii = lambda tables: self._measured(self.store.store.read("rows", state={"tables": tables}))
        told = self.spark.createDataFrame(list(enumerate(centres.tolist())), "list int, centre array<double>")
        return self.store.build(self._dealt(rows, centres), {"width": centres.shape[1]}, {"radii": radii, "centres": told})

    def update(self, groups: DataFrame, rows: DataFrame) -> int:
        """Whole groups are replaced, their new rows dealt to the centres that there are; a list's radius only grows until it is built anew."""
        keys = groups.select(self.group).distinct()
        own = rows.join(keys, self.group, "left_semi")

        def grown(state: dict) -> dict:
            def radii(tables: dict) -> DataFrame:
                last = tables["rows"] | {"folders": tables["rows"]["folders"][-1:]}
                both = self.store.store.read("radii", state=state).unionByName(self._measured(self.store.store.read("rows", state={"tables": {"rows": last}})))
                return both.groupBy("list").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"))

            return {"radii": radii}

        return self.store.replace(keys.withColumnRenamed(self.group, "grp"), lambda state: self._dealt(own, self._centres(state)), grown)

    def _centres(self, state: dict) -> np.ndarray:
        """The centres in the order of their lists, MOST_LISTS at most."""
        rows = sorted(self.store.store.read("centres", state=state).collect())
        return np.array([r["centre"] for r in rows], np.float64).reshape(-1, state["notes"]["width"])

    def search(self, queries: DataFrame, k: int, weight: Callable[[DataFrame], Column] | None = None, same: tuple[str, str] | None = None, keep_missing: bool = False, where: Callable[[DataFrame], DataFrame] | None = None, report: dict | None = None) -> DataFrame:
        """(qid, id, score, rn) as `retrieval.scored` gives it for the index's rows that ``where`` keeps.

        weight: of each row, not negative, from the columns kept. ``report`` gets lists, pairs (of query and list) and pairs read. More
        than QUERIES_HELD queries meet all rows in blocks.
        """
        state = self.store.state()
        right = same[1] if same else None

        def items(part: DataFrame) -> DataFrame:
            x = part.withColumnRenamed("grp", self.group)
            x = where(x) if where else x
            return x.select("id", "v", "list", (F.col(right) if right else F.lit("")).alias("g"), (weight(x) if weight else F.lit(1.0)).cast("double").alias("w"), F.col(self.group).alias("grp"))

        q = queries.select("qid", doubles(F.col("qvec")).alias("v"), (F.col(same[0]) if same else F.lit(None).cast("string")).alias("g"))
        held = q.limit(QUERIES_HELD + 1).toPandas()
        if len(held) > QUERIES_HELD:
            rows = self.store.rows(state, items).select("id", F.col("v").alias("embedding"), F.col("g").alias("__g"), "w")
            return scored(queries, rows, k, "w", (same[0], "__g") if same else None, keep_missing)
        centres = self._centres(state)
        a = unit(held["v"], centres.shape[1])
        qid, group = held["qid"].to_numpy(np.int64), held["g"]
        radii = {r["list"]: r["radius"] for r in self.store.store.read("radii", state=state).collect()}
        used = np.array(sorted(radii), np.int64)
        radius = np.array([radii[i] for i in used.tolist()])
        angle = np.arccos(np.clip(a @ centres[used].T, -1, 1)) if len(used) else np.zeros((len(a), 0))
        flat = ~a.any(axis=1)  # queries without a direction find all rows alike, or nothing
        bound = np.cos(np.clip(angle - radius - SLACK, 0, np.pi)) + SLACK
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST], True, axis=1)

        def read(pairs: np.ndarray, missing: bool) -> DataFrame | None:
            lists = used[pairs.any(axis=0)].tolist() + [-1] * missing
            if not lists:
                return None
            wanted = {n: np.flatnonzero(pairs[:, i]) for i, n in enumerate(used.tolist())} | {-1: np.arange(len(qid))}

            def run(batches):
                best = Best(len(qid), k)
                for b in batches:
                    for n, rows in b.groupby("list"):
                        to = wanted[n]
                        x = unit(rows["v"], a.shape[1])
                        s = products(a[to], x, rows["w"])
                        best.add(same_group(s if keep_missing else directed(s, a[to], x), group.iloc[to], rows["g"]), rows["id"].to_numpy(np.int64), to)
                yield best.frame(qid)

            rows = self.store.rows(state, lambda p: items(p.where(F.col("list").isin(lists))))
            rows = least_missing(rows, ["g"], k) if missing else rows.where("v is not null")
            return rows.select("id", "v", "list", "g", "w").mapInPandas(run, "qid long, id long, score double")

        rn = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
        top = lambda x: x.withColumn("rn", rn).where(F.col("rn") <= k)
        found = read(first, keep_missing)
        if found is None:  # no list has rows
            return top(self.spark.createDataFrame([], "qid long, id long, score double"))
        found = kept(top(found).drop("rn"), "first-lists")
        least = dict(found.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score"))).collect())
        most = self.store.rows(state, items).agg(F.max("w")).first()[0] if weight else 1.0
        worst = np.array([-np.inf if least.get(i) is None else least[i] for i in qid.tolist()])
        # a row's score is its cosine times its weight; below 0 no weight helps, so 0 bounds it
        reach = np.maximum(bound, 0) * (most or 0.0) if weight else bound
        more = ~first & ((reach >= worst[:, None]) | flat[:, None])
        if not keep_missing:
            more &= ~flat[:, None]
        if report is not None:
            report.update(lists=len(used), pairs=int(first.size), read=int((first | more).sum()))
        rest = read(more, False)
        return top(found if rest is None else found.unionByName(rest))
