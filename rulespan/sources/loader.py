"""Reading text sources: folders or files of documents, and stored web pages. A source that fails doesn't stop the others."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.functions.text import page_text
from rulespan.operators.chunks import chunk_separators, profile_name

# The files that belong to a folder of each type.
PATTERNS = {"documentation": "*.{md,txt,py,ipynb}", "code_snippet": "*.py"}
TEXT_COLUMNS = "source string, source_type string, description string, path string, text string"
FAILURE_COLUMNS = "source string, path string, error string"


@dataclass(frozen=True)
class Source:
    """A text source: a folder or file (types documentation, code_snippet), or a table of pages with url and html (web)."""

    name: str
    type: str
    path: str
    description: str = ""
    enabled: bool = True
    fmt: str = "parquet"


@dataclass(frozen=True)
class Loaded:
    """``texts``: a row per file or page. ``failures``: sources that could not be read (no path) and files that are no text."""

    texts: DataFrame
    failures: DataFrame

    def chunks(self) -> DataFrame:
        """The texts cut into chunks, each source by its profile."""
        return chunk_separators(self.texts, "text", profile_name(F.col("source_type"), F.col("description"))).drop("text")


def sources_from(table: DataFrame) -> list[Source]:
    """Sources of a settings table (name, type, path, description, enabled); one that doesn't say so is enabled."""
    return [
        Source(r["name"], r["type"], r["path"], r["description"] or "", r["enabled"] is not False)
        for r in table.select("name", "type", "path", "description", "enabled").toLocalIterator()
    ]


def _files(spark: SparkSession, source: Source) -> DataFrame:
    """path and content of the files of a source; a folder is read with all folders below it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    name = os.path.basename(source.path.rstrip("/"))
    # A path that names a file is read whatever its suffix.
    if "." not in name:
        reader = reader.option("pathGlobFilter", PATTERNS[source.type])
    return reader.load(source.path).select("path", "content")


def _texts(spark: SparkSession, source: Source) -> DataFrame:
    """path and text of a source; text is NULL where the bytes are not UTF-8."""
    if source.type == "web":
        pages = spark.read.format(source.fmt).load(source.path)
        return pages.select(F.col("url").alias("path"), page_text(F.col("html")).alias("text"))
    text = F.col("content").cast("string")
    return _files(spark, source).select("path", F.when(F.is_valid_utf8(text), text).alias("text"))


def load_sources(spark: SparkSession, sources: Sequence[Source]) -> Loaded:
    """Texts of all enabled sources, and what could not be read.

    A source whose path doesn't exist, whose type is unknown or whose table lacks its columns is one failure without path; a
    file that is no UTF-8 text is one with its path. Sources are settings: they are opened one by one, and read together.
    """
    parts: list[DataFrame] = []
    failed: list[tuple] = []
    for source in sources:
        if not source.enabled:
            continue
        if source.type not in (*PATTERNS, "web"):
            failed.append((source.name, None, f"unknown type {source.type}"))
            continue
        try:
            found = _texts(spark, source)
        except AnalysisException as error:
            failed.append((source.name, None, str(error).splitlines()[0]))
            continue
        parts.append(found.select(
            F.lit(source.name).alias("source"), F.lit(source.type).alias("source_type"), F.lit(source.description).alias("description"), "path", "text"))
    failures = spark.createDataFrame(failed, FAILURE_COLUMNS)
    if not parts:
        return Loaded(spark.createDataFrame([], TEXT_COLUMNS), failures)
    texts = reduce(DataFrame.unionAll, parts)
    unreadable = texts.where("text IS NULL").select("source", "path", F.lit("not a UTF-8 text").alias("error"))
    return Loaded(texts.where("text IS NOT NULL"), failures.unionAll(unreadable))
