"""Shuffled shards by a Feistel permutation of global row numbers.

Rows get numbers 0 to n - 1 in the order of their ids. A Feistel network over the next power of two, walked along its
cycle until it is back below n, permutes the numbers; place p of the shuffle is slot p // shards of shard p % shards.
So the shuffle depends on rows and seed alone, each row's shard and slot can be computed from its number, and the row
at any shard and slot from the inverse, without a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored, table

SHARDS = 16
SEED = 20_011
ROUNDS = 8
PLACE_BITS = 33  # monotonically_increasing_id() has the position in a partition below the partition's number


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A round's function: the finalizer of a 64-bit generator over x plus the round's key."""
    x = x.astype(np.uint64) + np.uint64(key)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A bijection of 0 to n - 1 by seed; forward() and inverse() take and give arrays of numbers below n."""

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS) -> None:
        bits = max(2, (n - 1).bit_length())
        self.n, self.low = n, np.uint64(bits // 2)
        self.masks = [np.uint64((1 << (bits - bits // 2)) - 1), np.uint64((1 << bits // 2) - 1)]
        self.keys = [int(k) for k in mixed(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), seed)]

    def _network(self, x: np.ndarray, rounds: range) -> np.ndarray:
        halves = [x >> self.low, x & self.masks[1]]
        for r in rounds:
            halves[r % 2] = halves[r % 2] ^ (mixed(halves[1 - r % 2], self.keys[r]) & self.masks[r % 2])
        return (halves[0] << self.low) | halves[1]

    def _walk(self, x: np.ndarray, rounds: range) -> np.ndarray:
        x = self._network(np.asarray(x).astype(np.uint64), rounds)
        while len(out := np.flatnonzero(x >= np.uint64(self.n))):  # under half of the domain is out, so walks are short
            x[out] = self._network(x[out], rounds)
        return x.astype(np.int64)

    def forward(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, range(len(self.keys)))

    def inverse(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, range(len(self.keys) - 1, -1, -1))


def row_at(n: int, shard: int, slot: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The number of the row that lies at a shard's slot."""
    place = slot * shards + shard
    if not (0 <= shard < shards and 0 <= place < n):
        raise ValueError(f"shard {shard} has no slot {slot}")
    return int(Permutation(n, seed).inverse(np.array([place]))[0])


def numbered(rows: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """rows with __row, their numbers from 0 in the order of the columns ``by``, and how many there are.

    Rows are dealt to ranges and sorted there; the driver sees one count for each range. Rows equal in all of ``by``
    follow an order that is stored with them, so thousands of equal rows spread over ranges too.
    """
    spark = rows.sparkSession
    rows = stored(rows.withColumn("__tie", F.monotonically_increasing_id()), "rows")  # the numbers have to stay as they are
    ordered = rows.repartitionByRange(shuffle_partitions(spark), *by, "__tie").sortWithinPartitions(*by, "__tie")
    ordered = stored(ordered.drop("__tie").withColumn("__place", F.monotonically_increasing_id()), "ordered")
    part, before, n = F.shiftright("__place", PLACE_BITS), [], 0
    for r in ordered.groupBy(part.alias("part")).count().orderBy("part").collect():
        before.append((r["part"], n))
        n += r["count"]
    base = spark.createDataFrame(before, "__part long, __before long")
    at = F.col("__place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return ordered.withColumn("__part", part).join(F.broadcast(base), "__part").withColumn("__row", F.col("__before") + at).drop("__part", "__before", "__place"), n


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id where None) with size, text_crc32, row, shard and slot, one row for each of docs.

    Size is the text's UTF-8 bytes plus 1; a null text has none of them and the crc32 of the empty text. The order that is
    numbered is by doc_id (null first), then by text (its length, crc32 and 64-bit hash), so neither files nor partitions matter;
    rows with the same id and text count one by one and are alike to the shuffle. Equal texts under different ids are
    rows like any others and scatter over all shards. Shards differ by a row at most. An empty table gives no rows. Other columns of
    docs are ignored; one of ``keep`` that is named like an added column gives way to it.
    """
    text = F.coalesce("text", F.lit(""))
    keep = [c for c in (keep or ["doc_id"]) if c not in ("size", "text_crc32", "row", "shard", "slot")]
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(F.encode(text, "utf-8"))
    rows = docs.select(*keep, F.col("doc_id").alias("__id"), size.alias("size"), crc.alias("text_crc32"), F.xxhash64(text).alias("__text"))
    rows, n = numbered(rows, ["__id", "size", "text_crc32", "__text"])

    def places(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        order = Permutation(n, seed)
        for b in batches:
            yield pd.Series(order.forward(b.to_numpy()))

    rows = rows.withColumn("__at", F.pandas_udf(places, "long")(F.col("__row")))
    place = F.col("__at")
    return rows.select(*keep, "size", "text_crc32", F.col("__row").alias("row"), F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.expr(f"__at div {shards}").alias("slot"))


def write_shards(rows: DataFrame, path: str) -> None:
    """Folders shard=0, shard=1, ... under path, each file sorted by slot; a shard of any size is written by many tasks."""
    parts = shuffle_partitions(rows.sparkSession)
    rows.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law ``rows``; see ``shard``."""
    rows = shard(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")
