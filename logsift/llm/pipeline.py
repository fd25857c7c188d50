"""The stages of the pipeline (see ``corpus_pipeline.py``).

Each takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``, whatever its
columns besides ``doc_id, text, lang, source, n_chars``; all but the last return
the columns of ``docs``.

1. ``language_id`` (3): documents without a letter, or for which no language
   reaches ``MIN_SCORE``, go.
2. ``near_dedup`` (4): of documents linked by similarity one stays, that with the
   smallest id. Rows with equal ids stay or go together.
3. ``substring_dedup`` (9): words in windows that also start elsewhere go. The text
   of a document that loses words is what is left, joined by one space; other
   texts are unchanged. A document that loses all its words has an empty text.
4. ``mix`` (1): rows are repeated, left out or (at most one per source) cut, so that
   sources meet their targets; empty texts are never taken.
5. ``encode`` (8): ids of the whole text, and digests of ids and decoded text.

``n_chars`` follows the text where a table has it. Empty tables pass all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, langid, mixing, neardup, substring
from .blocks import small_batches, written

MIN_SCORE = 0.3


def _free(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, with underscores put after them until ``df`` has none of them."""
    out = []
    for n in names:
        while n in df.columns or n in out:
            n += "_"
        out.append(n)
    return tuple(out)


def _counted(df: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        df = df.withColumn("n_chars", F.length("text").cast("long"))
    return df.select(*columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    pred, score = _free(docs, "lang_pred", "score")
    judged = langid.identify(docs, names=(pred, score))
    return judged.where((F.col(pred) != langid.UNKNOWN) & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    (key,) = _free(docs, "kept_id")
    kept = neardup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(key)), "left_semi").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = _free(docs, "n_words", "n_removed", "kept_text")
    left = substring.substring_dedup(docs, names=names)
    return _counted(left.withColumn("text", F.when(F.col(names[1]) > 0, F.col(names[2])).otherwise(F.col("text"))), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(mixing.mixture(docs), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(docs.select("doc_id", "text", "source")), "source", "ids")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix", mix), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
