"""I-Match fingerprints, by Spark's own functions alone.

The lexicon holds the terms within a band of document frequency, no others. A document keeps its distinct lexicon terms
in sorted order and hashes the part of them that falls into each of several random subsets of the lexicon;
these hashes side by side are its fingerprint. Subsets come in five densities, for short and long texts, a sparse one
lying inside the next denser.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored, table

LOW, HIGH = 0.002, 0.25  # band: the share of documents that hold a term
SLOTS = 1 << 16  # slots of the lexicon in a task
LEXICON = 200_000  # terms up to which the lexicon goes to every task; a larger one is joined
DENSITY = [2, 4, 6, 8, 10]  # a subset keeps a term with chance 2 ** -bits
SUBSETS = 8  # of each density


def terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")), "")


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(t): the band's terms. Document frequencies are counted over all documents."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.col("text"))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    return stored(counts.where((F.col("df") >= max(2, math.ceil(low * n))) & (F.col("df") <= high * n)).select("t"), "lexicon")


def slot(t: Column) -> Column:
    return F.pmod(F.xxhash64(t), F.lit(SLOTS)).cast("int")


def with_known(docs: DataFrame, text: str, name: str, band: DataFrame, small: bool) -> DataFrame:
    """docs with the sorted lexicon terms of a text.

    A lexicon of at most LEXICON terms is an array by slots, constant in the plan; a larger one is joined, each distinct term of a
    document being a row.
    """
    if small:
        slots: list[list[str]] = [[] for _ in range(SLOTS)]
        for r in band.select("t", slot(F.col("t")).alias("s")).collect():
            slots[r["s"]].append(r["t"])
        table_ = F.from_json(F.lit(json.dumps(slots, ensure_ascii=False, separators=(",", ":"))), "array<array<string>>")
        return docs.withColumn(name, F.sort_array(F.filter(terms(F.col(text)), lambda t: F.array_contains(F.get(table_, slot(t)), t))))
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    rows = stored(rows, "texts")  # the numbers have to stay as they are
    found = rows.select("__row", F.explode(terms(F.col(text))).alias("t")).join(band, "t").groupBy("__row").agg(F.sort_array(F.collect_list("t")).alias(name))
    return rows.join(found, "__row", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>"))).drop("__row")


def fingerprint(known: Column, text: Column) -> Column:
    """array<string> for sorted lexicon terms: by subset, a hash for each density, '' where it holds none of them.

    A text none of whose terms is in any subset has hashes of its own, the same in every place.
    """
    rows = F.transform(known, lambda t: F.struct(t.alias("t"), F.xxhash64(F.lit("subset"), t).alias("h0"), F.xxhash64(F.lit("other"), t).alias("h1")))

    def densities(inside: Column, k: int, sizes: list[int]) -> Column:
        """Hashes of subset k in each density; a sparser one is taken from the terms of the denser. Each subset has 16 bits of its own."""
        part = F.filter(inside, lambda x: F.shiftright(x[f"h{k // 4}"], k % 4 * 16).bitwiseAND(F.lit((1 << sizes[0]) - 1)) == 0)
        told = lambda p: F.array(F.when(F.size(p) == 0, "").otherwise(F.substring(F.sha1(F.array_join(F.transform(p, lambda x: x["t"]), " ")), 1, 8)))
        # the transform binds the part once
        return F.element_at(F.transform(F.array(part), lambda p: F.concat(told(p), densities(p, k, sizes[1:])) if sizes[1:] else told(p)), 1)

    hashes = F.element_at(F.transform(F.array(rows), lambda r: F.flatten(F.array(*[densities(r, k, DENSITY) for k in range(SUBSETS)]))), 1)
    own = F.array_repeat(F.substring(F.sha1(text), 1, 8), SUBSETS * len(DENSITY))
    return F.element_at(F.transform(F.array(hashes), lambda h: F.when(F.exists(h, lambda x: x != ""), h).otherwise(own)), 1)


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets whose hashes are equal, each taken at the sparsest density in which either document has a term; equal fingerprints give 1.

    Few terms stand behind a hash there, so it outlives edits; subsets in which neither has a term don't count.
    """
    same = []
    for k in range(SUBSETS):
        places = [(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range((k + 1) * len(DENSITY) - 1, k * len(DENSITY) - 1, -1)]
        same.append(F.coalesce(*[F.when((x != "") | (y != ""), (x == y).cast("int")) for x, y in places]))
    told = F.array_compact(F.array(*same))
    return F.when(a == b, F.lit(1.0)).when(F.size(told) == 0, F.lit(0.0)).otherwise(F.aggregate(told, F.lit(0), lambda s, x: s + x) / F.size(told))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with next_<column> of the next document by descending doc_id (after the last: the first).

    Documents are dealt to ranges of doc_id whose borders are ids of documents; the document on a border also
    goes to the range above it, as the next one of that range's last. So every range finds its followers by
    itself. A row without an id is its own next; repeated ids follow in the order of their texts.
    """
    spark = docs.sparkSession
    alone = docs.where("doc_id is null").select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    docs = docs.where("doc_id is not null")
    n = 2 * shuffle_partitions(spark)
    q = [i / n for i in range(1, n)]
    r = docs.agg(F.percentile_approx("doc_id", q, 10_000).alias("q"), F.max("doc_id").alias("top")).first()
    borders = sorted(set(r["q"] or []))
    # smallest border that isn't below the id; the lowest range is 0
    edge = F.array(*[F.lit(b) for b in borders]).cast("array<long>")
    own = F.coalesce(F.size(F.filter(edge, lambda b: b < F.col("doc_id"))), F.lit(0))
    homes = [F.when(F.array_contains(edge, F.col("doc_id")), own + 1)]  # guest in the range above
    wrap = F.lit(r["top"]).isNotNull() & (F.col("doc_id") == F.lit(r["top"])) if r["top"] is not None else F.lit(True)
    rows = docs.select("*", F.explode(F.array_compact(F.array(F.struct(own.alias("range"), F.lit(0).alias("guest")), F.when(homes[0].isNotNull(), F.struct(homes[0].alias("range"), F.lit(1).alias("guest"))), F.when(wrap, F.struct(F.lit(0).alias("range"), F.lit(2).alias("guest")))))).alias("__at"))
    order = Window.partitionBy("__range").orderBy("__guest", F.desc("doc_id"), F.col("text"))
    rows = rows.select(*docs.columns, F.col("__at.range").alias("__range"), F.col("__at.guest").alias("__guest"))
    rows = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return rows.where("__guest = 0").drop("__range", "__guest").unionByName(alone)


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text; null texts are empty.

    Equal texts always have equal fingerprints; a text without a term in any subset has a fingerprint of its own, like to no other text's. A
    single document is its own next.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    band = lexicon(docs)
    small = band.count() <= LEXICON
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    known = with_known(docs, "text", "__known", band, small)
    rows = with_next(known.withColumn("fp", fingerprint(F.col("__known"), F.col("text"))).drop("__known"), ["text", "fp"])
    rows = rows.select("doc_id", "fp", "next_fp", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    rows = with_known(rows, "edited", "__known", band, small).withColumn("efp", fingerprint(F.col("__known"), F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("fp", "-").alias("fingerprint"),
        F.array_join("efp", "-").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
