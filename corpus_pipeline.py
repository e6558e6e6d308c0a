"""The training-data pipeline: stages over documents, each written as Parquet before the next one reads it.

Every stage works on whole rows: columns that documents has beside those named here pass through whatever they are
called. Null texts count as empty, rows with a null id are kept apart as rows; an empty table goes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.llm import decontaminate, linededup, ngramjoin, packing, quality
from rulespan.llm.common import kept_table, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go from the texts, and n_chars follows. A document of which nothing is left goes; one that had no
    words before stays."""
    # Through inline_outer() each text is made once. On plain columns the optimizer would put the text's expressions into the
    # filter and n_chars, there inside a lambda, and split the text anew for each of its lines.
    found = linededup.dedup(docs).select(F.inline_outer(F.array(F.struct("row", "n_removed"))))
    emptied = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace(F.coalesce(F.col("row.text").cast("string"), F.lit("")), r"\s+", " ")) == "")
    cleaned = found.where(~emptied).select("row.*")
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest id stays, of equal rows of that id one. Rows with
    a null id, which nothing can name, stay."""
    # Written, since rows with and without an id are each joined to them: else the plan would hold all steps of the join twice.
    copies = kept_table(ngramjoin.join(docs).where(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("copy")).distinct())
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs["doc_id"].alias("own"))
    kept = rows.join(copies, F.col("own") == F.col("copy"), "left_anti")
    named, others = kept.where("own IS NOT NULL"), kept.where("own IS NULL")
    # Rows of one id are in one task already.
    return named.dropDuplicates(["own", "row"]).unionAll(others).select("row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the trained classifier, the rolling hashes of line chunks nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = kept_table(docs)
    return docs
