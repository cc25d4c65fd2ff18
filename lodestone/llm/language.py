"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent character n-grams (1 to 3 letters, words padded by a
space). A document's own most frequent n-grams, counted over its whole text, are compared with each profile
by the out-of-place distance: the sum of the differences in rank, with the full profile length for an n-gram
that the profile lacks. The nearest profile names the language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, tidy

TOP = 300  # n-grams in a profile
TRAIN_DOCS = 2000  # labelled documents for each language that profiles are fitted on, about; a bound on fitting alone
BITS = 18  # of a letter's code: Unicode has some 141,000 letters
BI, TRI = 1 << 3 * BITS, 2 << 3 * BITS  # set n-grams of two and three letters apart
MERGE = 1_000_000  # counts that a fitting task gathers before it adds equal n-grams up


def code_table(letters: str) -> np.ndarray:
    """Code of each code point: 0 for what is no letter, 1.. for the known letters, then one for each other letter."""
    is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    known = np.array([ord(c) for c in letters], np.int64)
    is_letter[known] = False
    rest = np.flatnonzero(is_letter)
    assert len(known) + len(rest) < 1 << BITS
    codes = np.zeros(0x110000, np.int64)
    codes[known] = np.arange(1, len(known) + 1)
    codes[rest] = np.arange(len(known) + 1, len(known) + len(rest) + 1)
    return codes


def grams(text: str, codes: np.ndarray) -> np.ndarray:
    """Numbers of all n-grams of the text."""
    c = np.zeros(len(low := text.lower()) + 2, np.int64)
    c[1:-1] = codes[np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32)]
    a, b = c[:-1], c[1:]
    two = (a > 0) | (b > 0)
    three = two[:-1] & two[1:]
    return np.concatenate([c[c > 0], (BI | a << BITS | b)[two], (TRI | a[:-1] << 2 * BITS | b[:-1] << BITS | c[2:])[three]])


def top_grams(text: str, codes: np.ndarray, top: int = TOP) -> np.ndarray:
    """The text's most frequent n-grams in order; ties by number."""
    g, n = np.unique(grams(text, codes), return_counts=True)
    return g[np.argsort(-n, kind="stable")[:top]]


class Profiles:
    """Fitted profiles: letters, language names and, for each language, the rank of every n-gram."""

    def __init__(self, letters: str, ranked: dict[str, list[int]], top: int = TOP) -> None:
        self.letters, self.names, self.top, self.ranked = letters, sorted(ranked), top, ranked

    def ready(self) -> Profiles:
        self.codes = code_table(self.letters)
        self.known = np.unique(np.array([-1, *(g for name in self.names for g in self.ranked[name])], np.int64))
        self.ranks = np.full((len(self.names), len(self.known)), -1, np.int32)  # the first column is for n-grams of no profile
        for i, name in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.known, self.ranked[name])] = np.arange(len(self.ranked[name]))
        return self

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names:
            return "und", 0.0
        g = top_grams(text, self.codes, self.top)
        if not len(g):
            return "und", 0.0
        at = np.searchsorted(self.known, g, "right") - 1
        r = self.ranks[:, np.where(self.known[at] == g, at, 0)]
        d = np.where(r < 0, self.top, np.abs(r - np.arange(len(g), dtype=np.int32))).sum(axis=1)
        best = int(d.argmin())
        return self.names[best], float(1 - d[best] / (len(g) * self.top))


def held_out() -> Column:
    """True where crc32 of doc_id as text leaves no remainder by 5: rows that nothing is learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, top: int = TOP) -> Profiles:
    """Profiles from labelled rows of docs(doc_id, text, lang).

    About ``train_docs`` rows for each language are taken by a hash of doc_id; texts whole. The driver gets
    the letters that occur and ``top`` numbers for each language.
    """
    rows = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    share = [(r["lang"], min(1.0, train_docs / r["n"])) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    if not share:
        return Profiles("", {}, top)
    at = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in share])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < at * 1_000_003).select("lang", "text")

    def count_letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                n.update(t.lower())
        known = [(c, k) for c, k in n.items() if c.isalpha()]
        yield pd.DataFrame(known, columns=["c", "n"])

    letters = sample.mapInPandas(count_letters, "c string, n long").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").collect()
    letters = "".join(r["c"] for r in letters)

    def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, parts, size = code_table(letters), {}, {}

        def add_up(lang: str) -> None:
            g, at = np.unique(np.concatenate([p[0] for p in parts[lang]]), return_inverse=True)
            n = np.bincount(at, np.concatenate([p[1] for p in parts[lang]])).astype(np.int64)
            parts[lang], size[lang] = [(g, n)], 0

        for b in batches:
            for lang, t in zip(b["lang"], b["text"]):
                u = np.unique(grams(t, codes), return_counts=True)
                parts.setdefault(lang, []).append(u)
                size[lang] = size.get(lang, 0) + len(u[0])
                if size[lang] > MERGE:
                    add_up(lang)
        for lang in parts:
            add_up(lang)
            yield pd.DataFrame({"lang": lang, "g": parts[lang][0][0], "n": parts[lang][0][1]})

    counts = sample.mapInPandas(count_grams, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "g")
    best = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    ranked: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "r").collect():
        ranked.setdefault(r["lang"], []).append(r["g"])
    return Profiles(letters, ranked, top)


def identify(docs: DataFrame, profiles: Profiles, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of docs with lang_pred and score, predicted from the whole text alone.

    Null texts and texts without a letter are ``und`` with score 0; equal distances go to the first language by
    name; with no profile at all everything is ``und``. Row by row: repeated rows and empty tables are fine.
    """
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    with_text = docs.select(*keep, F.col("text").alias("__text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tidy()
        p = profiles.ready()
        for b in batches:
            said = [p.predict(t) for t in b["__text"]]
            yield b.drop(columns="__text").assign(lang_pred=[s[0] for s in said], score=[s[1] for s in said])

    return with_text.mapInPandas(run, f"{schema}, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    profiles = fit(docs.where("not held_out"))
    return identify(docs, profiles, ["doc_id", "held_out"])
