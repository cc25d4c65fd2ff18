"""Ranks and order statistics of whole tables, without all rows of a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

PLACE_BITS = 33  # monotonically_increasing_id() has the position in a partition below the partition's number


def ranked_within(rows: DataFrame, group: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """rows with their rank 1, 2, ... within each group in an order, which should be total.

    Rows are dealt to ranges of (group, order) and sorted there; a row's rank is its place in its range, less where its group begins there, plus
    the group's rows in earlier ranges. Of a group, only those counts meet in a task, one for each range that it reaches.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(g).asc() for g in group], *order]
    sorted_ = kept(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    sorted_ = sorted_.withColumn("__part", F.shiftright("__at", PLACE_BITS)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
    counts = sorted_.groupBy("__part", *group).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = kept(counts.select("__part", *group, "__first", F.coalesce(before, F.lit(0)).alias("__before")), "offsets").alias("o")
    r = sorted_.alias("r")
    on = F.col("r.__part") == F.col("o.__part")
    for g in group:
        on = on & F.col(f"r.{g}").eqNullSafe(F.col(f"o.{g}"))
    return r.join(offsets, on).select(*[f"r.{c}" for c in rows.columns], (F.col("o.__before") + F.col("r.__at") - F.col("o.__first") + 1).cast("long").alias(name))


def order_statistic(rows: DataFrame, value: str, share: float) -> DataFrame:
    """One row (n, least, quantile): the count, least and quantile of non-null values, interpolated between the two ranks it lies between; null of none."""
    x = ranked_within(rows.where(F.col(value).isNotNull()).select(value), [], [F.col(value)], "place")
    n = x.agg(F.count("*").alias("n"), F.min(value).alias("least"))
    at = (F.col("n") - 1) * F.lit(share)
    near = x.join(F.broadcast(n)).where((F.col("place") - 1 == F.floor(at)) | (F.col("place") - 1 == F.ceil(at)))  # n is one row
    low, high = F.min(value), F.max(value)
    q = near.groupBy("n", "least").agg((low + (high - low) * F.first(at - F.floor(at))).alias("quantile"))
    return n.select("n", "least").join(F.broadcast(q.select("quantile")), how="left")
