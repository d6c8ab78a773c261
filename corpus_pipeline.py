"""From raw documents to packed training sequences, each stage by one operator of ``corpusloom.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, jaccard_join, language_id, line_dedup, packing, queries
from corpusloom.llm._common import staged, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the calibrated rejection turns away go."""
    known = language_id.identify(docs, queries.language_model(docs))
    return known.where(~F.col("rejected")).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate; those that had nothing else go."""
    clean = line_dedup.dedup_lines(docs)
    kept = clean.where((F.col("n_removed") == 0) | (F.trim("row.text") != ""))
    return kept.select(*[F.length("row.text").cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return jaccard_join.drop_near_duplicates(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack(docs, queries.n_words(F.col("text")), cluster=F.xxhash64("text"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", join_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("best_fit_packing", pack_best_fit),
]

#: SQL can express neither the language model nor the packing; the tests compare stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs)
    return docs
