"""A stored table whose groups are replaced as a whole, without rewriting what is there.

Rows carry their group (grp). Replacing groups adds a folder, the next generation, and notes which groups it replaces; older generations'
rows of those groups are passed over until `compact` puts all of them into one folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sizes import broadcast_if_small
from .manifest import FOLDERS, Manifest

DELTAS = FOLDERS // 2  # generations; the replacement after that compacts first


class Generations:
    """Tables ``rows`` (generations in order) and ``replaced`` (grp, gen) of a manifest, and others that go with them."""

    def __init__(self, spark: SparkSession, path: str, write: Callable[[DataFrame, str, dict], None] | None = None, read: Callable[[str, dict, dict], DataFrame] | None = None) -> None:
        """write(rows, folder, notes) and read(folder, schema, notes) take the place of plain Parquet."""
        self.spark, self.store, self._write, self._read = spark, Manifest(spark, path), write, read

    def exists(self) -> bool:
        return self.store.whole()

    def state(self) -> dict:
        return self.store.state()

    def _writers(self, notes: dict) -> dict:
        return {"rows": lambda df, at: self._write(df, at, notes)} if self._write else {}

    def _none(self) -> DataFrame:
        return self.spark.createDataFrame([], "grp string, gen int")

    def build(self, rows: DataFrame, notes: dict | None = None, more: dict | None = None) -> int:
        """rows and more in place of all that was there."""
        return self.store.commit(replace={"rows": rows, "replaced": self._none()} | (more or {}), notes=notes, writers=self._writers(notes or {}))

    def replace(self, groups: DataFrame, rows: Callable[[dict], DataFrame], more: Callable[[dict], dict] | None = None) -> int:
        """groups(grp) get the rows that ``rows(state)`` gives for them, perhaps none; rows of other groups have to be left out there."""
        if len(self.state()["tables"]["rows"]["folders"]) >= DELTAS:
            self.compact()
        state = self.state()
        gone = groups.select("grp").distinct().select("grp", F.lit(len(state["tables"]["rows"]["folders"])).alias("gen"))
        return self.store.commit(replace=more(state) if more else None, append={"rows": rows(state), "replaced": gone}, based_on=state, writers=self._writers(state["notes"]))

    def parts(self, state: dict, narrowed: Callable[[DataFrame], DataFrame] | None = None) -> Iterator[DataFrame]:
        """Each generation's rows that none later replaces. ``narrowed`` is applied to what is read, before anything else."""
        t = state["tables"]["rows"]
        gone = self.store.read("replaced", state=state)
        for gen, folder in enumerate(t["folders"]):
            at = f"{self.store.path}/{folder}"
            p = self._read(at, t["schema"], state["notes"]) if self._read else self.store.read("rows", state={"tables": {"rows": t | {"folders": [folder]}}})
            p = narrowed(p) if narrowed else p
            if gen + 1 < len(t["folders"]):
                p = p.join(broadcast_if_small(gone.where(F.col("gen") > gen).select("grp").distinct()), "grp", "left_anti")
            yield p

    def rows(self, state: dict | None = None, narrowed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        out = None
        for p in self.parts(state or self.state(), narrowed):
            out = p if out is None else out.unionByName(p)
        return out

    def compact(self) -> int:
        """One generation, without what was replaced."""
        state = self.state()
        return self.store.commit(replace={"rows": self.rows(state), "replaced": self._none()}, based_on=state, writers=self._writers(state["notes"]))
