"""A store of rule results in which a rule's metrics and participants appear together or not at all.

Below the store's folder are ``metrics``, ``participants`` and ``commits``, each with a folder per write (``run=<id>``).
Data are written first, then their commit, one file with the ids of the rules, which the file system makes visible at once. What a killed run left behind has no commit and is not read; if two
runs committed the same rule, the earlier one holds. So repeating a run adds nothing.

Row ids differ in type from rule to rule; stored they are text: the id itself, or JSON for one of several columns.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespan.model import KEY_TYPE
from rulespan.sources.results import no_nan

COMMIT_SCHEMA = "rule_id string, at timestamp, rows long, run string"
STORED_PARTICIPANTS = f"rule_id string, verdict string, group_key {KEY_TYPE}, rep_id string, role string, role_key {KEY_TYPE}, row_id string"


def id_text(participants: DataFrame) -> DataFrame:
    """Participants with their row ids as text."""
    kind = participants.schema["row_id"].dataType
    own = F.to_json("row_id") if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else F.col("row_id").cast("string")
    return participants.withColumn("row_id", own)


@dataclass(frozen=True)
class ResultStore:
    """Results of rules below ``path``."""

    spark: SparkSession
    path: str

    def _read(self, part: str, schema: str | None = None) -> DataFrame | None:
        try:
            reader = self.spark.read if schema is None else self.spark.read.schema(schema)
            return reader.parquet(os.path.join(self.path, part))
        except AnalysisException:  # nothing stored yet
            return None

    def commits(self) -> DataFrame:
        """rule_id, run, at, rows: the write that holds for each rule. One row per rule, however many runs there were."""
        found = self._read("commits", COMMIT_SCHEMA)
        if found is None:
            return self.spark.createDataFrame([], "rule_id string, run string, at timestamp, rows long")
        first = F.min(F.struct("at", "run", "rows"))
        return found.groupBy("rule_id").agg(first.alias("c")).select("rule_id", "c.run", "c.at", "c.rows")

    def add(self, rule_ids: Sequence[str], metrics: DataFrame, participants: Sequence[DataFrame] = ()) -> str:
        """Write results of the named rules and commit them; returns the id of the write.

        ``metrics`` has a row per rule. Each participant table is written on its own, since their row ids differ in type.
        """
        run = self.stage(metrics, participants)
        self.commit(rule_ids, run)
        return run

    def stage(self, metrics: DataFrame, participants: Sequence[DataFrame] = ()) -> str:
        """Write results without making them visible."""
        run = uuid.uuid4().hex
        no_nan(metrics).write.parquet(os.path.join(self.path, "metrics", f"run={run}"))
        target = os.path.join(self.path, "participants", f"run={run}")
        for i, part in enumerate(participants):
            id_text(part).write.parquet(os.path.join(target, f"part={i}"))
        return run

    def commit(self, rule_ids: Sequence[str], run: str) -> None:
        stored = self._read("metrics").where(F.col("run") == run).select("rule_id")
        wanted = self.spark.createDataFrame([(r,) for r in rule_ids], "rule_id string")
        rows = wanted.join(stored.groupBy("rule_id").agg(F.count(F.lit(1)).alias("rows")), "rule_id", "left")
        record = rows.select("rule_id", F.current_timestamp().alias("at"), F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))
        # One small file, so that it appears at once, in a folder of its own, so that writes side by side don't meet.
        record.coalesce(1).write.parquet(os.path.join(self.path, "commits", f"run={run}"))

    def _committed(self, found: DataFrame) -> DataFrame:
        return found.join(self.commits().select("rule_id", "run"), ["rule_id", "run"], "left_semi").drop("run", "part")

    def metrics(self) -> DataFrame | None:
        """Metrics of all committed rules; None while there are none."""
        found = self._read("metrics")
        return None if found is None else self._committed(found)

    def participants(self) -> DataFrame:
        """Participants of all committed rules, with row ids as text."""
        found = self._read("participants", STORED_PARTICIPANTS + ", run string, part int")
        return self.spark.createDataFrame([], STORED_PARTICIPANTS) if found is None else self._committed(found)

    def pending(self, rules: DataFrame) -> DataFrame:
        """The rules (rule_id and more) that have no committed result."""
        return rules.join(self.commits().select("rule_id"), "rule_id", "left_anti")
