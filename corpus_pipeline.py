"""Corpus preparation in five stages, from raw documents to packed sequences.

Each stage reads what its predecessor kept as Parquet. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from screenwright.llm.common import remove, scratch, table
from screenwright.llm.decontaminate import decontaminate
from screenwright.llm.language import identify_language, learn_samples
from screenwright.llm.line_dedup import dedup_lines
from screenwright.llm.ngram_join import keep_one
from screenwright.llm.packing import pack


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str, wanted: tuple[str, ...] | None = None, least: float = 0.0) -> DataFrame:
    """Documents in a wanted language (all that are learned, unless told), with the predicted one where ``lang`` is null.

    Documents go whose prediction is none of ``wanted`` or has a score of at most ``least``; null texts and texts
    without a letter have score 0. A null score says that nothing could be learned, which is no reason to drop a row.
    """
    found = identify_language(docs, learn_samples(docs))
    right = (F.col("score") > least) & (F.lit(True) if wanted is None else F.col("lang_pred").isin(*wanted))
    kept = found.where(F.col("score").isNull() | right)
    told = F.when(F.col("score").isNotNull(), F.col("lang_pred"))
    return kept.withColumn("lang", F.coalesce("lang", told)).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that many of them share; ``n_chars`` follows the text."""
    cut = dedup_lines(docs).drop("n_lines", "n_dropped")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as training sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", known_language),
    ("line_dedup", without_repeated_lines),
    ("ngram_join", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("pack", packed),
]

#: SQL cannot express language identification or packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``; the last stage's rows.

    What a stage wrote goes once the next one has been written; the rows returned read the last table.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
