"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, langid, mixing, neardup, negatives, quality, substring, topk, urls, variants, vectors, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.query,
    "op2_chat_format": chat.query,
    "op3_language_id": langid.query,
    "op4_minhash_dedup": neardup.query,
    "op5_url_filter": urls.query,
    "op6_warc": warc.query,
    "op7_embedding_dedup": vectors.query,
    "op8_bpe": bpe.query,
    "op9_substring_dedup": substring.query,
    "op10_quality_rules": quality.query,
    "op11_spelling_variants": variants.query,
    "op12_hard_negatives": negatives.query,
    "op13_exact_top_k": topk.query,
}

ORACLE: dict[str, str] = {
    "op2_chat_format": chat.SQL,
    "op6_warc": warc.SQL,
    "op11_spelling_variants": variants.SQL,
    "op12_hard_negatives": negatives.SQL,
    "op13_exact_top_k": topk.SQL,
}
