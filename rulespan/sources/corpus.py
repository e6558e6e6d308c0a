"""The stored text corpus."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespan.functions.text import DEFAULT_DESCRIPTION
from rulespan.operators.chunks import chunk_separators, profile_name


def snippet_text(code: Column, description: Column, tags: Column, seconds: Column, megabytes: Column) -> Column:
    """Code under a header of description, tags and metrics, as ``functions.text.header_fields`` reads it."""
    def known(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("N/A"))

    return F.concat(
        F.lit("# "), F.coalesce(description, F.lit(DEFAULT_DESCRIPTION)), F.lit("\n# Tags: "),
        F.array_join(F.coalesce(tags, F.array().cast("array<string>")), ", "),
        F.lit("\n# Metrics: Time="), known(seconds), F.lit("s, Memory="), known(megabytes), F.lit("MB\n\n"), code,
    )


def append_corpus(new: DataFrame, path: str, profile: Column | str | None = None) -> None:
    """Cut new texts (source, source_type, description, text) into chunks and add them to the corpus.

    Texts that the corpus has from their source already, byte for byte by their digests, and repeats among the new ones are
    left out before anything is cut; so appending the same texts again adds nothing. Each source is cut by its own profile,
    unless ``profile`` names one. Appends of the same texts at the same time may both add them.
    """
    digest = F.sha2(F.col("text").cast("binary"), 256)
    texts = new.withColumn("content", digest).where(F.col("content").isNotNull())
    # One row per text and source, by their digest: the texts themselves travel once.
    texts = texts.dropDuplicates(["source", "content"])
    try:
        stored = new.sparkSession.read.parquet(path).select("source", "content").distinct()
        known = [F.col("a.source").eqNullSafe(F.col("b.source")), F.col("a.content") == F.col("b.content")]
        texts = texts.alias("a").join(stored.alias("b"), known, "left_anti")
    except AnalysisException:  # nothing stored yet
        pass
    name = profile_name(F.col("source_type"), F.col("description")) if profile is None else profile
    chunk_separators(texts, "text", name).drop("text").write.mode("append").parquet(path)
