"""Spelling variants: neighbourhoods of one edit, guided by Bloom filters.

Every word of the vocabulary makes its deletions, and its replacements by a smaller letter; insertions and replacements by
a larger one are found from the other side. The edits are only hashed: each probes the filter of its own
length, a blocked Bloom filter of the vocabulary's words of that length, which tasks map from one file. Only what a filter lets
through becomes a string and is shuffled to an exact join with the vocabulary, which removes false positives.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir
from .common import ship, shuffle_partitions, stored, table, tidy

# Letters of a word, its least length and count, the ratio of a form's count to the word's, and the share of runs that lose a letter.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
MIN_LENGTH, MIN_COUNT, RATIO, EDITED = 6, 5, 5, 199
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]

LONG = 48  # words of so many letters or more share a filter, kept so sparse that it lets hardly anything through
BITS, LONG_BITS = 32, 4096  # of a filter for each of its words
PIECE = 1 << 13  # blocks of 64 bits in a piece, which one task fills
FILTER_BLOCKS = 1 << 23  # blocks in a file (64 MB): a larger vocabulary takes several, one after the other
CELLS = 1 << 19  # edits hashed at once
BASE = 0x9E3779B97F4A7C15  # of the rolling hash; odd, so it has an inverse
INVERSE = pow(BASE, -1, 1 << 64)


def counted(docs: DataFrame, edited: int = EDITED, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the vocabulary, counted over all whole texts; one run in ``edited`` of a document's different runs loses a letter."""
    run = F.col("run")
    low = F.when(F.length(run) == F.octet_length(run), F.lower(run)).otherwise(F.translate(run, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), 0)).alias("run"))
    # a run of one letter less than a word can't become one
    runs = runs.select("id", low.alias("run")).where(F.length("run") >= min_length)
    h, size = F.crc32(F.encode(F.concat("id", F.lit(":"), run), "utf-8")), F.length(run)
    at = F.pmod(h, size).cast("int")
    word = F.when(F.pmod(h, F.lit(edited)) == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, size))).otherwise(run)
    return runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") >= min_length) & (F.col("n") >= min_count))


def shelf(length: Column) -> Column:
    return F.least(length, F.lit(LONG))


class Layout:
    """Where each length's filter lies: pieces one after the other, the same number of blocks a word wherever it is."""

    def __init__(self, words: dict[int, int], file_blocks: int) -> None:
        self.first, self.blocks, at = {}, {}, 0
        for length in sorted(words):
            bits = LONG_BITS if length == LONG else BITS
            self.first[length], self.blocks[length] = at, max(64, math.ceil(words[length] * bits / 64))
            at += self.blocks[length]
        self.total = at
        self.files = max(1, math.ceil(at / file_blocks))
        self.file_blocks = math.ceil(max(1, at) / self.files)

    def place(self, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Block and four of its bits for hashes of words of a length. The block comes from the upper half of a mixed hash."""
        m = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        m ^= m >> np.uint64(32)
        block = ((m >> np.uint64(32)) * np.uint64(self.blocks[length]) >> np.uint64(32)) + np.uint64(self.first[length])
        mask = np.uint64(1) << (m & np.uint64(63))
        for shift in (6, 12, 18):
            mask |= np.uint64(1) << ((m >> np.uint64(shift)) & np.uint64(63))
        return block, mask


def codes(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def powers(n: int) -> np.ndarray:
    p = np.full(n, BASE, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def hashes(m: np.ndarray) -> np.ndarray:
    return (m * powers(m.shape[1])).sum(axis=1, dtype=np.uint64)


def by_length(words: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
    lengths = words.str.len().to_numpy()
    order = np.argsort(lengths, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(part):
            yield int(lengths[part[0]]), part


def build(vocabulary: DataFrame, layout: Layout, file: int) -> bytes:
    """One file of filters, FILTER_BLOCKS x 8 bytes at most: tasks set the bits of pieces, the driver puts the pieces in order."""

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for length, rows in by_length(b["word"]):
                block, mask = layout.place(hashes(codes(b["word"].iloc[rows].tolist())), min(length, LONG))
                own = block // np.uint64(layout.file_blocks) == file
                at = (block[own] % np.uint64(layout.file_blocks)).astype(np.int64)
                yield pd.DataFrame({"piece": at // PIECE, "at": at % PIECE, "mask": mask[own].view(np.int64)})

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(PIECE, np.int64)
        np.bitwise_or.at(out, rows["at"].to_numpy(), rows["mask"].to_numpy())
        return pd.DataFrame({"piece": [key[0]], "bits": [out.tobytes()]})

    pieces = vocabulary.select("word").mapInPandas(bits, "piece long, at long, mask long").groupBy("piece").applyInPandas(fill, "piece long, bits binary")
    whole = bytearray(math.ceil(layout.file_blocks / PIECE) * PIECE * 8)
    for r in pieces.toLocalIterator():
        whole[r["piece"] * PIECE * 8 : (r["piece"] + 1) * PIECE * 8] = r["bits"]
    return bytes(whole)


def edits(m: np.ndarray, letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of deletions and of replacements by smaller letters: (length, word's row, position, letter or 0, hash)."""
    rows, n = m.shape
    p = powers(n)
    each = m * p
    before = np.cumsum(each, axis=1, dtype=np.uint64) - each
    whole = before[:, -1] + each[:, -1]
    if n > 1:
        # of equal letters side by side only the first is left out
        first = np.ones(m.shape, bool)
        first[:, 1:] = m[:, 1:] != m[:, :-1]
        r, i = np.nonzero(first)
        yield n - 1, r, i, np.zeros(len(r), np.uint64), before[r, i] + (whole[r] - before[r, i] - each[r, i]) * np.uint64(INVERSE)
    smaller = np.searchsorted(letters, m)  # how many letters are below each
    for a in range(0, rows * n, step := max(1, CELLS // max(1, len(letters)))):
        flat = slice(a, a + step)
        count = smaller.ravel()[flat]
        cell = np.repeat(np.arange(a, a + len(count)), count)
        letter = letters[np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count)]
        r, i = cell // n, cell % n
        yield n, r, i, letter, whole[r] + (letter - m.ravel()[cell]) * p[i]


def positives(vocabulary: DataFrame, layout: Layout, file: int, name: str) -> DataFrame:
    """(word, n, near): the edits that a file's filters let through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy()
        filters = np.memmap(SparkFiles.get(name), np.uint64, "r")
        letters = np.array(LETTERS, np.uint64)
        for b in batches:
            words, counts = b["word"], b["n"].to_numpy()
            for length, rows in by_length(words):
                step = max(1, CELLS // length)
                for a in range(0, len(rows), step):
                    part = rows[a : a + step]
                    own = words.iloc[part].tolist()
                    for size, r, i, letter, h in edits(codes(own), letters):
                        if min(size, LONG) not in layout.first:
                            continue
                        block, mask = layout.place(h, min(size, LONG))
                        if layout.files > 1:
                            here = np.flatnonzero(block // np.uint64(layout.file_blocks) == file)
                            block, mask = block[here] % np.uint64(layout.file_blocks), mask[here]
                        hit = np.flatnonzero((filters[block] & mask) == mask)
                        hit = here[hit] if layout.files > 1 else hit
                        if len(hit):
                            near = [own[x][:y] + (chr(c) if c else "") + own[x][y + 1 :] for x, y, c in zip(r[hit].tolist(), i[hit].tolist(), letter[hit].tolist())]
                            yield pd.DataFrame({"word": [own[x] for x in r[hit].tolist()], "n": counts[part[r[hit]]], "near": near})

    return vocabulary.select("word", "n").mapInPandas(run, "word string, n long, near string")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each two words of the stored vocabulary (word, n) at one edit from each other, once."""
    spark = vocabulary.sparkSession
    layout = Layout({r["length"]: r["count"] for r in vocabulary.groupBy(shelf(F.length("word")).alias("length")).count().collect()}, FILTER_BLOCKS)
    dealt, found = vocabulary.repartition(4 * shuffle_partitions(spark), "word"), None
    for file in range(layout.files):
        name = f"filters-{uuid.uuid4().hex}"
        ship(spark, build(vocabulary, layout, file), f"{shared_dir(spark)}/{name}")
        part = positives(dealt, layout, file, name)
        found = part if found is None else found.unionByName(part)
    exact = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.join(exact, "near").select("word", "n", "near", "near_n")


def followed(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms(word, form).

    Counts grow along a chain by RATIO at least, so it is short, and each round doubles the steps taken.
    """
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = step.select("word", "root")
        if step.where("moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, edited: int = EDITED, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """word, n, form, n_near, form_n, root for each word of the vocabulary; columns doc_id and text of docs are read, others ignored.

    Null texts have no words; a null doc_id counts as the empty text where runs are drawn. Every row counts, repeated ones too. Of
    near words with the same largest n, the smallest in code-point order is the form. Words of any length work; an empty table gives no rows.
    """
    words = stored(counted(docs, edited, min_length, min_count), "vocabulary")
    pairs = stored(near_pairs(words), "near")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    taken = -F.col("best.n") >= ratio * F.col("n")
    rows = stored(words.join(best, "word", "left").select("word", "n", F.when(taken, F.col("best.near")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, -F.col("best.n")).alias("form_n")), "forms")
    roots = followed(rows.where("form is not null"))
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def brute_force(texts: list[tuple[object, str | None]], edited: int = EDITED, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> dict:
    """word: (form, root, n, n_near, form_n), every two words compared letter by letter; for small tables."""
    import re
    import zlib
    from collections import Counter

    n: Counter = Counter()
    for doc, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % edited == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= min_length and k >= min_count}

    def near(a: str, b: str) -> bool:
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    own = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(own[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(own[w]), n.get(form[w]))
    return out
