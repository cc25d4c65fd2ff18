"""Line dedup by site-relative frequency.

For each host, the share of its pages that contain a line tells boilerplate from content: lines on more than
``ratio`` of the pages of a host go from all of its pages. Pages of a host with one and the same text count as one page:
else a page that was copied often enough would be boilerplate as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

RATIO = 0.1
MIN_PAGES = 5  # a line on fewer pages of the host stays
BROADCAST_LINES = 100_000


def line_keys(text: Column) -> Column:
    """Digest of each line without its outer spaces; null for blank lines."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines array<long>): digests of the lines on at least min_pages and more than ratio of a host's pages.

    A host has at most (mean distinct lines of a page) / ratio such lines, so the arrays are small whatever the
    number of pages. Counts combine before the shuffle, so a hot host or line is a few rows for each task.
    """
    pages = docs.where(F.col(host).isNotNull()).select(F.col(host).alias("__host"), F.xxhash64("text").alias("__page"), F.array_distinct(F.array_compact(line_keys(F.col("text")))).alias("__lines"))
    # pages of one host with the same text count once: copies of a page don't make its text boilerplate
    pages = pages.dropDuplicates(["__host", "__page"])
    # the row with a null line counts the page itself
    rows = pages.select("__host", F.explode(F.concat(F.array(F.lit(None).cast("long")), F.coalesce("__lines", F.array().cast("array<long>")))).alias("line"))
    counts = rows.groupBy("__host", "line").agg(F.count("*").alias("n"))
    counts = stored(counts.where((F.col("n") >= min_pages) | F.col("line").isNull()), "lines")
    totals = counts.where("line is null").select("__host", F.col("n").alias("total"))
    often = counts.where("line is not null").join(totals, "__host").where(F.col("n") > ratio * F.col("total"))
    return often.groupBy("__host").agg(F.collect_list("line").alias("__drop"))


def line_dedup(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with the boilerplate lines of each host cut from text; columns n_lines and n_dropped are added.

    Lines are compared without outer spaces; blank lines stay. Pages without a host and null texts stay as they
    are (0 lines for null). Repeated rows and copies count as one page and are all cut alike. A page may end up with an empty text; no row
    goes. Columns of other names are untouched.
    """
    drop = stored(boilerplate(docs, host, ratio, min_pages), "boilerplate")
    small = (drop.agg(F.coalesce(F.sum(F.size("__drop")), F.lit(0))).first()[0]) <= BROADCAST_LINES
    # beyond the bound the planner joins by shuffle and splits hot hosts (adaptive skew join)
    joined = docs.join(F.broadcast(drop) if small else drop, F.col(host) == F.col("__host"), "left")
    lines = F.split("text", "\n", -1)
    gone = F.coalesce(F.col("__drop"), F.array().cast("array<long>"))
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(gone, F.xxhash64(F.trim(x))))
    same = F.col("__drop").isNull()
    out = joined.withColumn("__kept", F.when(~same, kept))
    n = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(n)
    return out.select(
        *[F.when(same, F.col("text")).otherwise(F.array_join("__kept", "\n")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        n.alias("n_lines"),
        F.when(same | F.col("text").isNull(), F.lit(0)).otherwise(n - F.size("__kept")).cast("long").alias("n_dropped"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = f"""
with pages as (select doc_id, source, text, string_split(text, chr(10)) as lines from documents),
totals as (select source, count(distinct text) + max(case when text is null then 1 else 0 end) as total from pages group by source),
often as (
  select source, line from (select source, text, unnest(list_distinct(list_transform(lines, lambda x: trim(x)))) as line from (select distinct source, text, lines from pages))
  join totals using (source) where line <> '' group by source, line, total having count(*) >= {MIN_PAGES} and count(*) > {RATIO} * total
),
gone as (select source, list(line) as gone from often group by source),
cut as (
  select doc_id, lines, list_filter(lines, lambda x: trim(x) = '' or not coalesce(list_contains(gone, trim(x)), false)) as kept
  from pages left join gone using (source)
)
select doc_id, coalesce(len(lines), 0) as n_lines, coalesce(len(lines) - len(kept), 0) as n_dropped,
       length(array_to_string(kept, chr(10))) as n_kept_chars, sha256(array_to_string(kept, chr(10))) as kept_sha256 from cut
"""
