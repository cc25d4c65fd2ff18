"""A weighted text index that is stored once and kept up by groups.

Postings (grp, id, term and a count for each field) lie in folders bucketed by term. A reader names its terms, so Spark
opens their buckets alone; weights are applied when postings are read, so one index serves every choice of fields. When
groups of chunks are replaced, their new postings form a further generation (see `sources.generations`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import tokens
from ..sources.generations import Generations
from ..sources.shared import kept
from .retrieval import FIELD_WEIGHTS, STOPPED

BUCKET_ROWS, MOST_BUCKETS = 500_000, 4096  # postings a bucket is laid out for, and how many buckets there are at most
TERMS_HELD = 10_000  # terms up to which a reader names them in the plan; more are joined with the buckets


def occurrences(chunks: DataFrame, fields: tuple[str, ...], group: str) -> DataFrame:
    """(grp, id, term, and a count for each field). Fields may be strings or arrays of strings."""
    text = lambda f: F.array_join(f, " ") if chunks.schema[f].dataType.typeName() == "array" else F.col(f)
    tagged = lambda f: F.transform(tokens(text(f)), lambda t: F.struct(t.alias("term"), F.lit(f).alias("field")))
    rows = chunks.select(F.col(group).alias("grp"), "id", F.inline(F.concat(*[tagged(f) for f in fields]))).where(~F.col("term").isin(STOPPED))
    return rows.groupBy("grp", "id", "term").agg(*[F.count_if(F.col("field") == f).alias(f) for f in fields])


class TextIndex:
    """An index of chunks(id, the group's column, fields) below a path."""

    def __init__(self, spark: SparkSession, path: str, fields: tuple[str, ...] = tuple(FIELD_WEIGHTS), group: str = "file_path") -> None:
        self.spark, self.fields, self.group = spark, fields, group
        self.store = Generations(spark, path, self._write, self._read)
        self.exists, self.compact = self.store.exists, self.store.compact

    @staticmethod
    def _name(at: str) -> str:
        return "postings_" + at.rpartition("-")[2]

    def _write(self, rows: DataFrame, at: str, notes: dict) -> None:
        rows = kept(rows, "occurrences")  # ranges look at the rows first, so texts would be taken apart twice
        # ranges of bucket, term and id: a term that every chunk has is written by several tasks
        dealt = rows.repartitionByRange(F.pmod(F.hash("term"), F.lit(notes["buckets"])), "term", "id")
        dealt.write.bucketBy(notes["buckets"], "term").sortBy("term", "id").option("path", at).format("parquet").saveAsTable(self._name(at))

    def _read(self, at: str, schema: dict, notes: dict) -> DataFrame:
        """A folder as a bucketed table; another session than the writer's declares it first."""
        name = self._name(at)
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f['name']}` {f['type']}" for f in schema["fields"])
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (term) SORTED BY (term, id) INTO {notes['buckets']} BUCKETS LOCATION '{at}'")
        return self.spark.table(name)

    def build(self, chunks: DataFrame) -> int:
        """The index of chunks, in place of all that was there."""
        # the characters of all fields lay out the buckets: a token takes about eight
        size = sum((F.coalesce(F.sum(F.size(F.col(f)) if chunks.schema[f].dataType.typeName() == "array" else F.length(f)), F.lit(0)) for f in self.fields), F.lit(0))
        buckets = min(MOST_BUCKETS, max(16, int(chunks.agg(size.alias("n")).first()["n"]) // 8 // BUCKET_ROWS))
        return self.store.build(occurrences(chunks, self.fields, self.group), {"buckets": buckets})

    def update(self, groups: DataFrame, chunks: DataFrame) -> int:
        """Whole groups are replaced: those of groups(the group's column) get the postings of their chunks, which may be none. Other chunks are left out."""
        keys = groups.select(self.group).distinct()
        own = chunks.join(keys, self.group, "left_semi")
        return self.store.replace(keys.withColumnRenamed(self.group, "grp"), lambda state: occurrences(own, self.fields, self.group))

    def postings(self, wanted: DataFrame | None = None, fields: tuple[str, ...] | None = None) -> DataFrame:
        """(id, term, s): weighted counts over some of the fields, of the terms in wanted(term) or of all."""
        narrowed = None
        if wanted is not None:
            some = wanted.select("term").where("term is not null").distinct()
            held = [r["term"] for r in some.limit(TERMS_HELD + 1).collect()]
            few = F.col("term").isin(held) if held else F.lit(False)
            narrowed = (lambda p: p.where(few)) if len(held) <= TERMS_HELD else (lambda p: p.join(some, "term", "left_semi"))
        s = sum((F.col(f) * F.lit(FIELD_WEIGHTS[f]) for f in (fields or self.fields)), F.lit(0.0))
        return self.store.rows(narrowed=narrowed).select("id", "term", s.alias("s")).where("s > 0")
