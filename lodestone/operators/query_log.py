"""The retrieval log: writing rows, reading windows, mining evaluation cases, retention."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import order_statistic, ranked_within
from ..functions.scalars import window_hours

MIN_COUNT, GAP, KEYWORD_SHARE, KEEP_DAYS = 2, 0.05, 0.5, 90


def log_rows(queries: DataFrame, results: DataFrame, confidence: DataFrame) -> DataFrame:
    """One log row for each query from its results(qid, rank, doc_id, score, via): counts by via, first scores, first ids."""
    via = results.groupBy("qid", "via").agg(F.count("*").alias("n")).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("via", "n"))).alias("via_mix"))
    first = F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score")))
    r = results.groupBy("qid").agg(F.slice(first, 1, 5).alias("first"), F.count("*").alias("result_count"))
    x = queries.select("qid", "query").join(r, "qid", "left").join(via, "qid", "left").join(confidence, "qid", "left")
    return x.select(
        "qid",
        "query",
        F.coalesce("result_count", F.lit(0)).alias("result_count"),
        F.get("first", F.lit(0))["score"].alias("top_score"),
        F.array_compact(F.transform("first", lambda s: s["doc_id"])).alias("top_doc_ids"),
        F.transform("first", lambda s: s["score"]).alias("top_scores"),
        F.map_from_entries("via_mix").alias("via_mix"),
        "confidence",
        F.coalesce(F.col("confidence") < 0.6552, F.lit(False)).alias("abstained"),
        F.lit("unknown").alias("surface"),
    )


def read_log(log: DataFrame, since: Column | None = None, abstained_only: bool = False) -> DataFrame:
    """Rows of the window; rows without a time go when a window is set."""
    x = log.where(F.col("created_at") >= since) if since is not None else log
    return x.where("abstained") if abstained_only else x


def read_window(log: DataFrame, window: str, as_of: Column, abstained_only: bool = False) -> DataFrame:
    """Rows of the last '7d' or '36h' before as_of, the border included, newest first by whoever sorts them; any other text is refused."""
    if not re.fullmatch(r"[0-9]+[dh]", window.strip()):
        raise ValueError(f"{window!r} is no window like 7d or 24h")
    since = as_of - F.make_dt_interval(hours=window_hours(F.lit(window.strip())))
    return read_log(log, since, abstained_only)


def abstain_rate(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col("abstained").cast("int")), F.lit(0.0)).alias("rate"))


def mined(log: DataFrame, golden: DataFrame | None = None, least: int = MIN_COUNT) -> DataFrame:
    """(query, n, confidence, last_seen, latest struct): repeated queries of people, not of evaluations or golden cases."""
    x = log.where("surface is null or surface <> 'eval'")
    if golden is not None:
        x = x.join(golden.select("query").distinct(), "query", "left_anti")
    latest = F.max_by(F.struct(*[c for c in log.columns if c != "query"]), F.struct("created_at", "id"))
    return x.groupBy("query").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.max("created_at").alias("last_seen"), latest.alias("latest")).where(F.col("n") >= least)


def low_threshold(candidates: DataFrame) -> DataFrame:
    """One row: the lower quartile of the means that weren't abstained on; the least of under four; null of none."""
    c = order_statistic(candidates.where("not latest.abstained"), "confidence", 0.25)
    return c.select(F.when(F.col("n") < 4, F.col("least")).otherwise(F.col("quantile")).alias("low"))


def classified(candidates: DataFrame) -> DataFrame:
    """candidates with reason: abstained, low_confidence or suspect; others go."""
    x = candidates.join(F.broadcast(low_threshold(candidates)))  # one row
    s, mix = F.col("latest.top_scores"), F.col("latest.via_mix")
    total = F.aggregate(F.map_values(mix), F.lit(0).cast("long"), lambda a, b: a + b)
    share = F.when(total > 0, F.coalesce(F.try_element_at(mix, F.lit("keyword")), F.lit(0)) / total).otherwise(0.0)
    close = (F.size(s) >= 2) & (F.round(F.get(s, F.lit(0)) - F.get(s, F.lit(1)), 9) <= GAP)
    reason = F.when(F.col("latest.abstained"), "abstained").when(F.col("confidence") <= F.col("low"), "low_confidence").when(close | (share >= KEYWORD_SHARE), "suspect")
    return x.withColumn("reason", reason).where("reason is not null").drop("low")


def ranked(candidates: DataFrame) -> DataFrame:
    """In order of count, time and text; place is 1, 2, ... within each reason."""
    return ranked_within(candidates, ["reason"], [F.desc("n"), F.desc("last_seen"), F.col("query").asc()])


def draft_cases(candidates: DataFrame) -> DataFrame:
    return candidates.select(F.concat(F.lit("mined-"), F.col("latest.id")).alias("case_id"), "query", F.array().cast("array<string>").alias("expect_docs"), (F.col("reason") == "abstained").alias("expect_abstain"), F.lit("mined").alias("source"))


def keep_days(text: str | None) -> int:
    """Days to keep; anything but a positive number means the default."""
    return int(text) if text and text.strip().isdigit() and int(text) > 0 else KEEP_DAYS


def retained(log: DataFrame, as_of: Column, days: int) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one row of counts): rows before the cutoff go, the cutoff itself stays."""
    old = F.col("created_at") < as_of - F.make_dt_interval(F.lit(days))
    gone = F.coalesce(old, F.lit(False))
    return log.where(~gone), log.agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"))
