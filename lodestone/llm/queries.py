"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import cover_tree, fim, fingerprint, jaccard, language, lattice, line_dedup, packing, pii, sharding, suffix_dedup, url_filter, variants
from .common import small_batches



def batched(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


_QUERIES = {
    "op1_cover_tree": cover_tree.op1_cover_tree,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_pii": pii.op3_pii,
    "op4_sentencepiece": lattice.op4_sentencepiece,
    "op5_packing": packing.op5_packing,
    "op6_jaccard_join": jaccard.op6_jaccard_join,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_fingerprint": fingerprint.op8_fingerprint,
    "op9_language": language.op9_language,
    "op10_url_filter": url_filter.op10_url_filter,
}

QUERIES = {name: batched(query) for name, query in _QUERIES.items()} | {
    "op11_sharding": sharding.op11_sharding,
    "op12_spelling_variants": variants.op12_spelling_variants,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}

ORACLE_SQL = {
    "op1_cover_tree": cover_tree.OP1_SQL,
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op13_fill_in_middle": fim.OP13_SQL,
}
