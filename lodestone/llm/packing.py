"""Packing along a space-filling curve.

Each document's token counts are projected to three dimensions by a hashed random sign matrix; the point's
Hilbert key orders the documents, so that neighbours on the curve resemble each other. Documents are laid
end to end in that order and the line is cut every 4096 tokens, so only the last sequence has padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored, table, tidy
from .wordcache import WordCache

LENGTH = 4096
END = 2
BITS = 16  # of each of the three coordinates


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def sign_matrix(n: int, dims: int = 3) -> np.ndarray:
    """A row of signs for each dimension."""
    return np.random.default_rng(7).choice(np.array([-1, 1], np.int8), (dims, n))


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of integer points (n x dims), by Skilling's transposed form."""
    x = points.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        p = q - one
        for i in range(dims):
            set_ = (x[i] & q) > 0
            t = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        t = np.where((x[-1] & q) > 0, t ^ (q - one), t)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def curve_key(ids: list[np.ndarray], signs: np.ndarray) -> np.ndarray:
    n = np.array([len(x) for x in ids])
    flat, at = np.concatenate(ids), np.cumsum(n) - n
    v = np.stack([np.add.reduceat(row[flat], at, dtype=np.int64) for row in signs], axis=1) / np.sqrt(n)[:, None]
    return hilbert_key(np.clip((np.tanh(v / 4) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1))


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """row, doc_id, n, key, ids (little-endian, 2 bytes each) of every document, id END included."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy()
        words = WordCache(path)
        signs, end = sign_matrix(max(words.size, END + 1)), END.to_bytes(2, "little")
        for b in batches:
            for at in range(0, len(b), 200):
                part = b.iloc[at : at + 200]
                raw = [words.encode(t) + end if t else end for t in part["text"]]
                ids = [np.frombuffer(x, "<u2") for x in raw]
                yield pd.DataFrame({"row": part["row"], "doc_id": part["doc_id"], "n": [len(x) for x in ids], "key": curve_key(ids, signs), "ids": raw})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return rows.mapInPandas(run, f"row long, doc_id {kind}, n long, key long, ids binary")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the single id END. Equal keys follow doc_id, then the row's number, so a group of
    copies spreads over range partitions like any others. Texts of any length work: a document spans as many
    sequences as it needs. An empty table gives no pieces; other columns are ignored. The driver sees one
    number for each range partition.
    """
    spark = docs.sparkSession
    tokens = stored(tokenized(docs, path or vocabulary()), "tokens")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            end = at + b["n"].cumsum()
            yield pd.DataFrame({"row": b["row"], "part": part, "at": end - b["n"], "n": b["n"]})
            at = int(end.iloc[-1]) if len(b) else at

    ordered = tokens.select("key", "doc_id", "row", "n").repartitionByRange(shuffle_partitions(spark), "key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row")
    places = stored(ordered.mapInPandas(running, "row long, part int, at long, n long"), "places")
    before, total = [], 0
    for r in places.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        before.append((r["part"], total))
        total += r["n"]
    base = spark.createDataFrame(before, "part int, before long")
    placed = places.join(F.broadcast(base), "part").select("row", (F.col("at") + F.col("before")).alias("at"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy()
        for b in batches:
            out = []
            for doc, n, at, ids in zip(b["doc_id"], b["n"], b["at"], b["ids"]):
                wide, s = np.frombuffer(ids, "<u2").astype("<u4"), 0
                while s < n:
                    seq, off = divmod(at + s, length)
                    size = min(n - s, length - off)
                    out.append((doc, s, size, zlib.crc32(wide[s : s + size].tobytes()), n, seq, off))
                    s += size
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return tokens.select("row", "doc_id", "n", "ids").join(placed, "row").mapInPandas(cut, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
