"""The corpus index: discovery, attribution, incremental upkeep, whole-group replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.sizes import broadcast_if_small

#: Folders that are never read; a corpus names its own.
SKIPPED = ["target", "node_modules", "archive"]
#: Types of documents by path prefix; the order counts.
TYPES = [
    ("docs/decisions", "decision"), ("docs/projects", "project"), ("docs/business", "business"), ("docs/content", "content"), ("docs/diagnostic", "diagnostic"),
    ("docs/career.md", "career"), ("docs/profile-and-pitch.md", "career"), ("docs/brand.md", "brand"), ("docs/linkedin.md", "content"),
    ("planning", "plan"), ("docs", "meta"), ("README.md", "meta"), ("CLAUDE.md", "meta"),
]


def parts(path: Column) -> Column:
    return F.split(path, "/")


def skipped(path: Column, names: list[str] = SKIPPED, prefixes: tuple[str, ...] = ()) -> Column:
    """Why a path is skipped, or null: underscore file, hand-over note, hidden part, skipped folder or prefix."""
    stem = F.element_at(parts(path), -1)
    why = F.when(stem.startswith("_"), "underscore").when(stem == "handoff.md", "ephemeral").when(F.exists(parts(path), lambda p: p.startswith(".")), "hidden")
    why = why.when(F.arrays_overlap(parts(path), F.array(*[F.lit(n) for n in names])), "skip_dir")
    for p in prefixes:
        why = why.when((path == p) | path.startswith(p + "/"), "skip_dir")
    return why


def discover(files: DataFrame, lanes: list[tuple[str, str]]) -> DataFrame:
    """files(path) that a lane claims, with lane number and name: lanes are (name, pattern), the first to match wins."""
    n = F.coalesce(*[F.when(F.col("path").rlike(p), F.lit(i)) for i, (_, p) in enumerate(lanes)])
    ok = files.where(F.col("path").rlike(r"\.mdx?$") & skipped(F.col("path")).isNull()).withColumn("lane", n)
    first = F.row_number().over(Window.partitionBy("path").orderBy("lane"))
    return ok.where("lane is not null").withColumn("__n", first).where("__n = 1").drop("__n").withColumn("lane_name", F.get(F.array(*[F.lit(x) for x, _ in lanes]), F.col("lane")))


def discover_workspace(files: DataFrame) -> DataFrame:
    """files(path) of a workspace: markdown of any depth, without names that begin with a dot and folders named target."""
    folders = F.slice(parts(F.col("path")), 1, F.size(parts(F.col("path"))) - 1)
    return files.where(F.col("path").rlike(r"\.mdx?$") & ~F.exists(parts(F.col("path")), lambda p: p.startswith(".")) & ~F.array_contains(folders, "target"))


def doc_type(path: Column, types: list[tuple[str, str]] = TYPES) -> Column:
    """By the first prefix that fits; content otherwise."""
    out = F.lit("content")
    for prefix, name in reversed(types):
        out = F.when(path.startswith(prefix), name).otherwise(out)
    return out


def attributed(lane: Column, slug: Column, own: Column) -> Column:
    """Project: the manifest's slug always in lane 2, the document's own before the slug in lane 3, its own elsewhere."""
    return F.when(lane == 2, slug).when(lane == 3, F.coalesce(own, slug)).otherwise(own)


def to_index(files: DataFrame, index: DataFrame) -> DataFrame:
    """files(path, mtime) to read again: those whose newest row isn't strictly later than the file.

    Where files have a project, as in a workspace, only rows of that project count.
    """
    keys = ["path", "project"] if "project" in files.columns else ["path"]
    newest = index.withColumnRenamed("file_path", "path").groupBy(*keys).agg(F.max("indexed_at").alias("newest"))
    return files.join(newest, keys, "left").where("newest is null or newest <= mtime")


def stale(files: DataFrame, index: DataFrame) -> DataFrame:
    """files strictly newer than their newest row, or without any."""
    newest = index.groupBy(F.col("file_path").alias("path")).agg(F.max("indexed_at").alias("newest"))
    return files.join(newest, "path", "left").where("newest is null or mtime > newest")


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with whole groups replaced: all rows under a key that new has go, all rows of new come."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def after_rebuild(index: DataFrame, manifest: DataFrame, workspace: str | None = None) -> DataFrame:
    """What a scoped rebuild keeps: clients' rows, and projects that the manifest doesn't name (or other workspaces)."""
    if workspace is not None:
        return index.where(~F.col("project").eqNullSafe(F.lit(workspace)))
    named = manifest.select(F.col("slug").alias("project"), F.lit(True).alias("named"))
    x = index.join(broadcast_if_small(named), "project", "left")
    gone = F.col("client_slug").isNull() & (F.col("project").isNull() | (F.col("project") == "") | F.col("named").isNotNull())
    return x.where(~gone).select(*index.columns)


def pruned(index: DataFrame, paths: DataFrame, project: str | None = None, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(index without paths' rows, counts): rows with a client stay and count as protected.

    With a project, only its rows go; in a dry run none go, and the counts tell what would.
    """
    hit = index.join(paths.select(F.col("path").alias("file_path")).distinct().withColumn("hit", F.lit(True)), "file_path", "left")
    mine = F.col("hit").isNotNull() & (F.lit(True) if project is None else F.col("project").eqNullSafe(F.lit(project)))
    gone = mine & F.col("client_slug").isNull()
    counts = hit.agg(F.count_if(gone).alias("deleted"), F.count_if(mine & F.col("client_slug").isNotNull()).alias("protected"))
    return index if dry_run else hit.where(~gone).select(*index.columns), counts


def quarantined(failed: DataFrame, index: DataFrame) -> DataFrame:
    """(path, rows): how many old rows each file keeps that failed to parse."""
    n = index.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("rows"))
    return failed.select("path").join(n, "path", "left").select("path", F.coalesce("rows", F.lit(0)).alias("rows"))


def without_quarantined(index: DataFrame, failed: DataFrame) -> DataFrame:
    """index without the old rows of files that failed to parse, for those who ask for it."""
    return index.join(failed.select(F.col("path").alias("file_path")), "file_path", "left_anti").select(*index.columns)


def backfilled(index: DataFrame, files: DataFrame) -> DataFrame:
    """index with authored_at from the files' times. Where files have a project, only rows of that project are filled, null being one too."""
    keys = ["file_path", "project"] if "project" in files.columns else ["file_path"]
    m = files.withColumnRenamed("path", "file_path").groupBy(*keys).agg(F.max("mtime").alias("mtime"))
    i, m = index.alias("i"), m.alias("m")
    on = F.col("i.file_path") == F.col("m.file_path")
    on = on & F.col("i.project").eqNullSafe(F.col("m.project")) if "project" in keys else on
    return i.join(m, on, "left").select(*[F.coalesce("m.mtime", "i.authored_at").alias(c) if c == "authored_at" else F.col(f"i.{c}") for c in index.columns])


def restricted(files: DataFrame, wanted: DataFrame | None = None, first: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(files named by wanted, names outside the corpus), or the first files in order of their paths."""
    inside, outside = (files, files.limit(0).select("path")) if wanted is None else (files.join(wanted, "path", "left_semi"), wanted.join(files, "path", "left_anti"))
    return inside if first is None else inside.orderBy("path").limit(first), outside


def ingested(artifacts: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks of artifacts(type, id, content, section) under a synthetic path; a given section keeps the text whole."""
    from .chunking import sections, windows

    keep = [c for c in ("project", "title", "description") if c in artifacts.columns]
    a = artifacts.withColumn("path", F.concat(F.lit("ingested/"), "type", F.lit("/"), "id", F.lit(".md")))
    a = a.withColumn("own", F.struct("path", F.col("type"), *keep))
    cut = sections(a.where("section is null"), "own", "content").select("own", "no", "section", "content")
    whole = a.where("section is not null").select("own", F.lit(0).alias("no"), "section", "content")
    w = windows(cut.union(whole), "content", ["own", "no", "section"], size, overlap)
    return w.select("own.path", *[f"own.{c}" for c in keep and ["type", *keep]], "no", "section", "window", "content")


def ingest(index: DataFrame, artifacts: DataFrame, embed_batch, width: int, stamp: str) -> tuple[DataFrame, DataFrame]:
    """(index, counts): artifacts(type, id, content, section, project, title, description) are cut, embedded and replace what was there.

    The vector is that of the context prefix and the chunk, of which only the chunk is kept. A group is a path and section,
    within a project where the artifact has one. counts: (path, chunks). index needs file_path, section, project and the columns of the chunks.
    """
    from .chunking import context_prefix, embedded

    c = ingested(artifacts)
    prefix = context_prefix({"type": F.col("type"), "title": F.col("title"), "description": F.col("description"), "project": F.col("project")})
    rows = embedded(c.withColumn("__text", F.concat(prefix, "content")), "__text", embed_batch, width, stamp).drop("__text")
    rows = rows.withColumnRenamed("path", "file_path").select(*index.columns)
    new = c.select(F.col("path").alias("file_path"), "section", F.col("project").alias("__p")).distinct()  # of chunks without vectors, so none is embedded twice
    i = index.join(new.alias("n"), (index["file_path"] == F.col("n.file_path")) & (index["section"] == F.col("n.section")) & (F.col("n.__p").isNull() | (index["project"] == F.col("n.__p"))), "left_anti")
    return i.unionByName(rows), rows.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("chunks"))


def store_chunks(chunks: DataFrame, path: str, buckets: int = 16) -> int:
    """Append chunks(doc_id, position, ...) to a folder dealt by a hash of doc_id; how many were written, counted as they are."""
    seen = Observation()
    rows = chunks.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")).observe(seen, F.count("*").alias("n"))
    rows.write.mode("append").partitionBy("bucket").parquet(path)
    return seen.get["n"]


def refresh(index: DataFrame, files: DataFrame, chunked, failed: DataFrame, load_edges=None, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(index, summary): files that are due are cut by ``chunked(files)`` and replace their groups, then the edges are loaded.

    Files that failed to parse keep their rows and make the run a failure. A dry run changes nothing and skips the edges.
    summary: dry_run, due, chunks, failed, success, exit_code, edges (null where skipped).
    """
    due = to_index(files, index).join(failed.select("path"), "path", "left_anti")
    new = chunked(due)
    edges = None if dry_run or load_edges is None else load_edges()
    count = lambda df, name: df.agg(F.count("*").alias(name))
    one = count(due, "due").join(F.broadcast(count(new, "chunks"))).join(F.broadcast(count(failed, "failed")))  # one row each
    ok = F.col("failed") == 0
    summary = one.select(F.lit(dry_run).alias("dry_run"), "due", "chunks", "failed", ok.alias("success"), F.when(ok, 0).otherwise(1).alias("exit_code"), F.lit(edges).cast("long").alias("edges"))
    return index if dry_run else replaced(index, new, ["file_path", "section"]), summary


class Repository:
    """Verbs over a table with an id column; every change is a new DataFrame."""

    def __init__(self, rows: DataFrame, id: str = "id") -> None:
        self.rows, self.id = rows, id

    def create(self, new: DataFrame) -> DataFrame:
        return self.rows.unionByName(new)

    def get(self, id) -> DataFrame:
        return self.rows.where(F.col(self.id) == id)

    def merge(self, new: DataFrame) -> DataFrame:
        return replaced(self.rows, new, [self.id])

    def delete(self, ids: DataFrame) -> DataFrame:
        return self.rows.join(ids, self.id, "left_anti")

    def latest(self, n: int) -> DataFrame:
        return self.rows.orderBy(F.desc(self.id)).limit(n)

    def count(self) -> int:
        return self.rows.count()

    def exists(self, **equal) -> bool:
        x = self.rows
        for k, v in equal.items():
            x = x.where(F.col(k) == v)
        return not x.isEmpty()
