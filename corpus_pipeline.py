"""Documents to packed training sequences, in five stages.

Each stage reads all that the one before kept and its decisions take effect; all but the last return the columns of
documents, and any others that the table has, whatever their names. run() writes each stage's result to the cluster's shared
folder and reads it again.

A document with null or empty text has no letters, so the first stage rejects it; a later stage would keep it. A document of
any length is read whole. Rows that repeat are rows of their own until similar documents go: of equal ids the earliest row
stays, and a null id counts as the largest. An empty table gives no rows in any stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.llm import decontaminate, language, line_dedup, ngram_join, packing
from terrasift.llm.common import remove, store, unused


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which no language can be told: those without any letter. If no document has a language, none
    can be told."""
    return language.identified(docs, language.fit(docs))


def near_duplicate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes later similar lines out, and counts n_chars anew. A document all of whose words were in such lines goes; one
    that never had any stays."""
    lines, removed = unused(docs.columns, "n_lines"), unused(docs.columns, "n_removed")
    out = line_dedup.dedup_lines(docs, n_lines=lines, n_removed=removed)
    left = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    chars = F.coalesce(F.length("text"), F.lit(0)).cast(dict(docs.dtypes).get("n_chars", "bigint"))
    columns = [chars.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.where(left | (F.col(removed) == 0)).select(*columns)


def similar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, that with the smallest id: five-word shingles, similarity 0.8."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a passage of the benchmark occurs go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its sequence and place."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicate_lines", near_duplicate_lines),
    ("similar_documents", similar_documents),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The first stage learns a model and the last one searches; SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = store(stage(spark, docs, sf_dir), name)
        if before:
            remove(spark, before)
        before = path
    return docs
