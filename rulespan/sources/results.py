"""Storing rule results."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.functions.prep import FLOATS
from rulespan.model import RuleResult


def no_nan(df: DataFrame) -> DataFrame:
    """NaN as NULL, which JSON can say."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, FLOATS)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def write_results(result: RuleResult, path: str, fmt: str = "json", mode: str = "append") -> None:
    """Metrics and participants below ``path``, one folder per rule and verdict.

    Participants are sorted within their files by row id, which is what a sorted list of row ids is for a
    table of any size.
    """
    no_nan(result.metrics).write.mode(mode).partitionBy("rule_id").format(fmt).save(os.path.join(path, "metrics"))
    rows = result.participants().sortWithinPartitions("rule_id", "verdict", "row_id")
    rows.write.mode(mode).partitionBy("rule_id", "verdict").format(fmt).save(os.path.join(path, "participants"))


def read_metrics(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.format(fmt).load(os.path.join(path, "metrics"))


def read_participants(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.format(fmt).load(os.path.join(path, "participants"))
