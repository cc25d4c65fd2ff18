"""Citation checks of answers against the chunks they cite, and the sessions that keep the turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import content_words, normal_title, support

ABSTAIN_BELOW, SUPPORTED_FROM = 0.6552, 0.3
#: Fixed value: what an abstained answer says.
ABSTAIN_MESSAGE = "I don't have that in my documents."


def abstain_gate(queries: DataFrame, confidence: DataFrame, counts: DataFrame, threshold: float = ABSTAIN_BELOW) -> DataFrame:
    """qid, abstain, reason, message: without chunks or below the threshold."""
    x = queries.select("qid").join(confidence, "qid", "left").join(counts, "qid", "left")
    none = F.coalesce("n", F.lit(0)) == 0
    low = F.coalesce("confidence", F.lit(0.0)) < threshold
    reason = F.when(none, "no_chunks").when(low, "low_confidence")
    return x.select("qid", (none | low).alias("abstain"), reason.alias("reason"), F.when(none | low, ABSTAIN_MESSAGE).alias("message"))


def context_block(chunks: DataFrame) -> DataFrame:
    """(qid, context) of chunks(qid, rank, title, score, content): one paragraph for each, by rank."""
    block = F.concat(F.lit("Section: "), F.coalesce("title", F.lit("General")), F.lit(" (relevance: "), F.format_string("%.2f", F.col("score")), F.lit(")\n"), "content")
    rows = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return chunks.groupBy("qid").agg(F.array_join(F.transform(rows, lambda r: r["block"]), "\n\n").alias("context"))


def check_citations(answers: DataFrame, chunks: DataFrame, least: float = SUPPORTED_FROM) -> DataFrame:
    """One row for each citation of answers(answer_id, answer, cited_sections): title found, support, reason.

    chunks(answer_id, rank, section_title, content, file_path): of equal titles the last by rank counts.
    """
    last = chunks.groupBy("answer_id", normal_title(F.col("section_title")).alias("key")).agg(F.max_by(F.struct("content", "file_path"), "rank").alias("chunk"))
    cited = answers.select("answer_id", "answer", F.posexplode("cited_sections").alias("place", "section")).withColumn("key", normal_title(F.col("section")))
    x = cited.join(last, ["answer_id", "key"], "left")
    score = support(content_words(F.col("answer")), content_words(F.col("chunk.content")))
    x = x.withColumn("support", F.when(F.col("chunk").isNotNull(), score).otherwise(F.lit(0.0)))
    reason = F.when(F.col("chunk").isNull(), "not_found").when(F.col("support") < least, "unsupported")
    return x.select("answer_id", "place", "section", F.col("chunk.file_path").alias("file_path"), "support", reason.isNull().alias("verified"), reason.alias("reason"))


def envelope(answers: DataFrame, checks: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """withheld, corroborated and escalate for each answer(answer_id, high_stakes)."""
    c = checks.groupBy("answer_id").agg(F.count_if("verified").alias("verified"), F.count("*").alias("cited"), F.count_distinct(F.when(F.col("verified"), F.col("file_path"))).alias("files"))
    x = answers.select("answer_id", "high_stakes").join(c, "answer_id", "left").join(chunk_counts, "answer_id", "left")
    zero = lambda n: F.coalesce(n, F.lit(0))
    corroborated = zero("files") >= 2
    withheld = (zero("cited") > 0) & (zero("verified") == 0) & (zero("n_chunks") > 0)
    return x.select("answer_id", zero("verified").alias("verified"), zero("cited").alias("cited"), withheld.alias("withheld"), corroborated.alias("corroborated"), (F.coalesce("high_stakes", F.lit(False)) & ~corroborated).alias("escalate"))


def best_envelope(verified: Column, answered: Column, abstained: Column) -> Column:
    """The verified answer if there is one, else the answered, else the abstained."""
    return F.coalesce(verified, answered, abstained)


def append_turns(turns: Column, user: Column, assistant: Column) -> Column:
    """turns array<struct<role,content>> with a user's and an assistant's turn added."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.concat(turns, F.array(turn("user", user), turn("assistant", assistant)))


def add_topics(topics: Column, new: Column) -> Column:
    """Ordered union: new ones follow those not there yet; repeats within new stay."""
    return F.concat(topics, F.filter(new, lambda t: ~F.array_contains(topics, t)))
