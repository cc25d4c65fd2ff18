"""Retrieval evaluation: case scores, aggregates with intervals, paired comparison of runs, gates."""

from __future__ import annotations

import math
import random
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import content_words, sign_test, support, wilson

ABSTAIN_BELOW, RESAMPLES, ALPHA = 0.6552, 10_000, 0.05
EXACT_CASES = 20_000  # values of a group that are drawn one after the other
#: Which metrics are shares of cases and which are means.
PROPORTIONS = ["recall_at_5", "recall_at_10", "abstain_correct"]
CONTINUOUS = ["mrr", "groundedness", "groundedness_on_hits"]
#: The seed of each mean's interval, and of that of its differences between two runs.
SEEDS = {"mrr": 0, "groundedness": 1, "groundedness_on_hits": 2}
PAIRED_SEEDS = {"mrr": 10, "groundedness": 11, "groundedness_on_hits": 12}


def case_scores(cases: DataFrame, results: DataFrame, confidence: DataFrame) -> DataFrame:
    """A row for each of cases(case_id, query, expect_docs, expect_abstain) from results(qid, rank, doc_id, file_path, content).

    Retrieval scores are null for cases without expectation; a miss scores 0.
    """
    wanted = cases.select(F.col("case_id").alias("qid"), F.explode("expect_docs").alias("want"))
    hit = results.join(wanted, "qid").where((F.col("doc_id") == F.col("want")) | (F.col("file_path") == F.col("want")))
    first = hit.groupBy("qid").agg(F.min("rank").alias("hit"), F.min_by("content", "rank").alias("content"))
    x = cases.join(first, cases["case_id"] == first["qid"], "left").drop("qid").join(confidence.withColumnRenamed("qid", "case_id"), "case_id", "left")
    scored = F.size("expect_docs") > 0
    at = lambda k: F.when(scored, F.coalesce(F.col("hit") <= k, F.lit(False)).cast("int"))
    says = F.coalesce("confidence", F.lit(0.0)) < ABSTAIN_BELOW
    ground = F.when(F.col("hit").isNull(), F.lit(0.0)).otherwise(support(content_words(F.col("query")), content_words(F.col("content"))))
    return x.select(
        "case_id", at(5).alias("recall_at_5"), at(10).alias("recall_at_10"), F.when(scored, F.coalesce(1 / F.col("hit"), F.lit(0.0))).alias("mrr"),
        F.when(scored, ground).alias("groundedness"), F.col("hit").isNotNull().alias("matched"), says.alias("abstained"), (says == F.col("expect_abstain")).cast("int").alias("abstain_correct"),
    )


def aggregates(scores: DataFrame) -> DataFrame:
    """One row of means; cases without expectation count for abstention alone; no case gives 0."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return with_on_hits(scores).agg(F.count("*").alias("cases"), *[mean(c).alias(c) for c in PROPORTIONS + CONTINUOUS])


def with_on_hits(scores: DataFrame) -> DataFrame:
    """scores with groundedness_on_hits, which is defined on cases that found an expected document (``matched``) alone."""
    return scores.withColumn("groundedness_on_hits", F.when(F.col("matched"), F.col("groundedness")))


def long_form(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., metric, value) without null values: a metric stands where its case defines it. Without ``matched``, nothing is said on hits."""
    metrics = [c for c in PROPORTIONS + CONTINUOUS if c != "groundedness_on_hits" or "matched" in scores.columns]
    scores = with_on_hits(scores) if "matched" in scores.columns else scores
    return scores.unpivot(keys, [F.col(c).cast("double").alias(c) for c in metrics], "metric", "value").where("value is not null")


def proportion_intervals(values: DataFrame) -> DataFrame:
    """(metric, k, n, lo, hi): Wilson's interval of values(metric, value in {0, 1})."""
    x = values.groupBy("metric").agg(F.sum("value").cast("long").alias("k"), F.count("value").alias("n"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return x.withColumns({"lo": lo, "hi": hi})


def places(resamples: int, alpha: float = 0.05) -> tuple[int, int]:
    """Where the bounds stand among sorted means, counted from 0."""
    last = resamples - 1
    return min(round(alpha / 2 * last), last), min(round((1 - alpha / 2) * last), last)


def bootstrap_exact(values: DataFrame, seed: int, resamples: int = RESAMPLES, keys: list[str] = ["metric"]) -> DataFrame:  # noqa: B006
    """(keys, point, lo, hi, n) by a seeded percentile bootstrap of the mean of values(keys, case_id, value), a task for each group.

    Draws follow one another from Python's generator, cases in order of case_id, so the bounds are those that any seeded
    run gives. That can't be spread: a group of more than EXACT_CASES values fails; use bootstrap_spread for it.
    """
    large = values.groupBy(*keys).agg(F.count("value").alias("n")).where(F.col("n") > EXACT_CASES).limit(1).collect()
    if large:
        raise ValueError(f"{large[0].asDict()}: more than {EXACT_CASES} values")

    def run(b: pd.DataFrame) -> pd.DataFrame:
        rng, x = random.Random(seed), b.sort_values(["case_id", "value"])["value"].tolist()
        n = len(x)
        means = sorted(sum([x[rng.randrange(n)] for _ in range(n)]) / n for _ in range(resamples))
        lo, hi = places(resamples)
        return b[keys].head(1).assign(point=sum(x) / n, lo=means[lo], hi=means[hi], n=n)

    schema = ", ".join(f"{k} {values.schema[k].dataType.simpleString()}" for k in keys)
    return values.where("value is not null").groupBy(*keys).applyInPandas(run, f"{schema}, point double, lo double, hi double, n long")


def times_drawn(seed: Column, r: Column, case_id: Column) -> Column:
    """How often resample r holds a case: a Poisson number of mean 1, from a digest."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", seed, r, case_id)), 1, 8), 16, 10).cast("double") / (1 << 32)
    out, p, below = F.lit(0), math.exp(-1), math.exp(-1)
    for k in range(1, 12):
        out, p = out + (u >= below).cast("int"), p / k
        below += p
    return out


def bootstrap_spread(values: DataFrame, seed: int | dict[str, int], resamples: int) -> DataFrame:
    """(metric, point, lo, hi, n) by the Poisson bootstrap: every case decides by itself how often each resample holds it.

    ``seed`` may differ by metric (0 for those that it doesn't name). Nothing is numbered, gathered or joined: a sum for each metric and resample, combined before the shuffle.
    """
    each = values.where("value is not null").select("metric", "case_id", "value", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    own = F.lit(seed if isinstance(seed, int) else 0)
    for metric, s in seed.items() if isinstance(seed, dict) else ():
        own = F.when(F.col("metric") == metric, s).otherwise(own)
    each = each.withColumn("w", times_drawn(own, F.col("r"), F.col("case_id")))
    total = each.groupBy("metric", "r").agg(F.sum(F.col("w") * F.col("value")).alias("s"), F.sum("w").alias("w"), F.count("*").alias("n"), F.avg("value").alias("point"))
    total = total.withColumn("mean", F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(F.col("point")))
    means = total.groupBy("metric").agg(F.array_sort(F.collect_list("mean")).alias("m"), F.first("n").alias("n"), F.first("point").alias("point"))  # ``resamples`` numbers
    lo, hi = places(resamples)
    return means.select("metric", "point", F.element_at("m", lo + 1).alias("lo"), F.element_at("m", hi + 1).alias("hi"), "n")


def case_changes(values: DataFrame, by_metric: bool = False) -> DataFrame:
    """(case_id, change), or for each metric: cases of values(run in {base, current}, case_id, metric, ...) that one run lacks."""
    keys = ["metric", "case_id"] if by_metric else ["case_id"]
    x = values.groupBy(*keys).agg(F.bool_or(F.col("run") == "base").alias("b"), F.bool_or(F.col("run") == "current").alias("c"))
    return x.where("not (b and c)").select(*keys, F.when(F.col("b"), "removed").otherwise("added").alias("change"))


def flips(values: DataFrame) -> DataFrame:
    """(metric, case_id, flip): cases whose value rose or fell between the runs, for metrics that are shares of cases."""
    x = values.where(F.col("metric").isin(PROPORTIONS)).groupBy("metric", "case_id").agg(F.max(F.when(F.col("run") == "base", F.col("value"))).alias("b"), F.max(F.when(F.col("run") == "current", F.col("value"))).alias("c"))
    return x.where("b <> c").select("metric", "case_id", F.when(F.col("c") > F.col("b"), "better").otherwise("worse").alias("flip"))


def paired(values: DataFrame, seed: int | dict[str, int] = PAIRED_SEEDS, resamples: int = RESAMPLES) -> DataFrame:  # noqa: B006
    """Verdict for each metric of values(run in {base, current}, case_id, metric, value).

    Runs over different cases are incomparable in every metric, and a metric whose own cases differ is so by itself;
    case_changes names the cases. Shares of cases go by the exact sign test on the cases that flipped, as many up as
    down being flat; means by a bootstrap of the differences case by case, significant if its interval leaves out 0.
    """
    pair = values.groupBy("metric", "case_id").agg(F.max(F.when(F.col("run") == "base", F.col("value"))).alias("b"), F.max(F.when(F.col("run") == "current", F.col("value"))).alias("c"))
    share = F.col("metric").isin(PROPORTIONS)
    x = pair.groupBy("metric").agg(
        F.count_if(F.expr("b is null")).alias("added"), F.count_if(F.expr("c is null")).alias("removed"), F.count_if(F.expr("c > b")).alias("up"), F.count_if(F.expr("c < b")).alias("down"), F.avg(F.col("c") - F.col("b")).alias("delta"),
    )
    other = not case_changes(values).isEmpty()
    moved = bootstrap_spread(pair.where(~share).select("metric", "case_id", (F.col("c") - F.col("b")).alias("value")), seed, resamples).select("metric", "lo", "hi")
    x = x.join(F.broadcast(moved), "metric", "left")  # a row for each metric
    x = x.withColumns({"better": F.when(share, F.col("up")), "worse": F.when(share, F.col("down")), "p": F.when(share, sign_test(F.col("up"), F.col("down")))})
    down = F.when(share, F.col("worse") > F.col("better")).otherwise(F.col("delta") < 0)
    sure = F.when(share, F.col("p") < ALPHA).otherwise(F.when(F.col("delta") < 0, F.col("hi") < 0).otherwise(F.col("lo") > 0))
    verdict = (
        F.when(F.lit(other) | (F.col("added") > 0) | (F.col("removed") > 0), "incomparable")
        .when(F.when(share, F.col("worse") == F.col("better")).otherwise(F.col("delta") == 0), "flat")
        .otherwise(F.concat(F.when(down, "regressed").otherwise("improved"), F.when(sure, "-significant").otherwise("-within-noise")))
    )
    return x.select("metric", "added", "removed", "better", "worse", "delta", "lo", "hi", "p", verdict.alias("verdict"))


def deltas(base: DataFrame, current: DataFrame) -> DataFrame:
    """(metric, base, current, delta, regressed) over the base's metrics; a metric the current run lacks counts as 0."""
    x = base.select("metric", F.col("value").alias("base")).join(current.select("metric", F.col("value").alias("current")), "metric", "left")
    x = x.withColumn("current", F.coalesce("current", F.lit(0.0))).withColumn("delta", F.col("current") - F.col("base"))
    return x.withColumn("regressed", F.col("delta") < 0)


def confounded(runs: DataFrame, fields: list[str]) -> DataFrame:
    """runs with base_<f> and <f>: which fields differ, 'unknown' where a side lacks one."""
    missing = F.lit(False)
    for f in fields:
        missing = missing | F.col(f).isNull() | F.col(f"base_{f}").isNull()
    names = F.array_compact(F.array(*[F.when(F.col(f) != F.col(f"base_{f}"), f) for f in fields]))
    return runs.withColumn("confounded_by", names).withColumn("confounded", F.when(missing, "unknown").when(F.size(names) > 0, "yes").otherwise("no"))


def changed_keys(a: Column, b: Column) -> Column:
    """Names whose values differ between two maps, in order; null if either is null."""
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
    return F.when(a.isNotNull() & b.isNotNull(), F.filter(keys, lambda k: ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k))))


def violations(cases: DataFrame) -> DataFrame:
    """(case_id, rule) of cases(case_id, query, expect_docs, expect_abstain, source, source_query_id) that break a rule."""
    rules = {
        "empty_query": F.coalesce(F.trim("query"), F.lit("")) == "",
        "abstain_with_docs": F.col("expect_abstain") & (F.size("expect_docs") > 0),
        "nothing_expected": ~F.col("expect_abstain") & (F.size("expect_docs") == 0),
        "unknown_source": ~F.coalesce(F.col("source").isin("authored", "mined", "archived"), F.lit(False)),
        "source_query_id": F.col("source_query_id").isNotNull() & (F.col("source") != "mined"),
    }
    return cases.select("case_id", F.explode(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]))).alias("rule"))


def case_digest(cases: DataFrame) -> DataFrame:
    """(n, digest) of the scoring fields. Rows are digested where they are; what meets are their sums by bucket of the id."""
    row = F.concat_ws("|", "case_id", "query", F.array_join("expect_docs", ","), F.col("expect_abstain").cast("string"))
    h = F.sha2(row, 256)
    part = cases.groupBy(F.substring(h, 1, 2).alias("bucket")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(h)), ""), 256).alias("h"))
    return part.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda s: s["h"]), ""), 256).alias("digest"))


def gate(verdicts: DataFrame, strict: bool = False) -> DataFrame:
    """(failed, metrics): a significant regression fails, under ``strict`` any decrease."""
    bad = (F.col("verdict") == "regressed-significant") | (F.lit(strict) & (F.col("delta") < 0))
    return verdicts.agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("failed"), F.array_join(F.array_sort(F.collect_list(F.when(bad, F.col("metric")))), ",").alias("metrics"))


def promotable(runs: DataFrame, forced: bool = False) -> DataFrame:
    """runs(reason, three stamps, worse) with eligible and why not."""
    why = F.when(F.coalesce(F.trim("reason"), F.lit("")) == "", "no_reason").when(F.col("golden_digest").isNull() | F.col("corpus_digest").isNull() | F.col("constants").isNull(), "no_stamp").when(F.col("worse") & ~F.lit(forced), "regression")
    return runs.withColumn("why_not", why).withColumn("eligible", why.isNull())


def corpus_stamp(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: chunk count, distinct files, edge count, newest indexed_at."""
    c = chunks.agg(F.count("*").alias("chunk_count"), F.count_distinct("file_path").alias("file_count"), F.max("indexed_at").alias("max_indexed_at"))
    return c.join(F.broadcast(edges.agg(F.count("*").alias("edge_count"))))  # one row each
