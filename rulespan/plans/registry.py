"""Named queries, each with the SQL that must give the same table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.model import RuleResult

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """Parquet tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a function from tables to a DataFrame under ``name``."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return build

    return add


def metrics_out(metrics: DataFrame | RuleResult) -> DataFrame:
    """Metrics with plain types and rounded ratios."""
    metrics = metrics.metrics if isinstance(metrics, RuleResult) else metrics
    return metrics.selectExpr(
        "rule_id", "total_rows", "applicable_rows", "sat_rows", "viol_rows",
        "cast(sat_groups as bigint) as sat_groups", "cast(viol_groups as bigint) as viol_groups",
        *[f"round({c}, 9) as {c}" for c in ("support", "confidence", "violation_rate")],
    )


def metrics_sql(rule_id: str, rule_class: str, counts: str, ctes: str = "") -> str:
    """SQL for a metrics row from a SELECT of the six counts."""
    side = "rows" if rule_class == "row" else "groups"
    with_ = f"{ctes}, " if ctes else ""
    return f"""
    WITH {with_}c AS ({counts})
    SELECT '{rule_id}' AS rule_id,
      coalesce(total_rows, 0)::BIGINT AS total_rows, coalesce(applicable_rows, 0)::BIGINT AS applicable_rows,
      coalesce(sat_rows, 0)::BIGINT AS sat_rows, coalesce(viol_rows, 0)::BIGINT AS viol_rows,
      coalesce(sat_groups, 0)::BIGINT AS sat_groups, coalesce(viol_groups, 0)::BIGINT AS viol_groups,
      round(CASE WHEN total_rows = 0 THEN 0.0::DOUBLE ELSE applicable_rows::DOUBLE / total_rows::DOUBLE END, 9) AS support,
      round(CASE WHEN sat_{side} + viol_{side} = 0 THEN 1.0::DOUBLE
            ELSE sat_{side}::DOUBLE / (sat_{side} + viol_{side})::DOUBLE END, 9) AS confidence,
      round(CASE WHEN sat_rows + viol_rows = 0 THEN 0.0::DOUBLE
            ELSE viol_rows::DOUBLE / (sat_rows + viol_rows)::DOUBLE END, 9) AS violation_rate
    FROM c"""


def row_sql(rule_id: str, table: str, head: str, body: str = "TRUE") -> str:
    """SQL for the metrics of a row rule; ``body`` includes the null exclusion."""
    return metrics_sql(
        rule_id, "row",
        f"""SELECT count(*) AS total_rows, count(*) FILTER (WHERE {body}) AS applicable_rows,
          count(*) FILTER (WHERE ({body}) AND ({head})) AS sat_rows,
          count(*) FILTER (WHERE ({body}) AND NOT ({head})) AS viol_rows, 0 AS sat_groups, 0 AS viol_groups
        FROM {table}""",
    )


def group_sql(rule_id: str, groups: str, total: str, ctes: str = "") -> str:
    """SQL for group metrics from a SELECT with n (rows) and ok (the verdict, NULL when not judged)."""
    parts = f"{ctes}, g AS ({groups})" if ctes else f"g AS ({groups})"
    return metrics_sql(
        rule_id, "group",
        f"""SELECT (SELECT count(*) FROM {total}) AS total_rows,
          coalesce(sum(n) FILTER (WHERE ok IS NOT NULL), 0) AS applicable_rows,
          coalesce(sum(n) FILTER (WHERE ok), 0) AS sat_rows, coalesce(sum(n) FILTER (WHERE NOT ok), 0) AS viol_rows,
          count(*) FILTER (WHERE ok) AS sat_groups, count(*) FILTER (WHERE NOT ok) AS viol_groups FROM g""",
        parts,
    )


def verdict_sql(test: str) -> str:
    return f"CASE WHEN {test} THEN 'satisfaction' ELSE 'violation' END"


def key_text(col: str = "group_key") -> Column:
    """A group or role key as ``col=value|col=value``."""
    return F.array_join(F.transform(col, lambda p: F.concat(p["col"], F.lit("="), p["val"])), "|")


def key_sql(*cols: str) -> str:
    return " || '|' || ".join(f"'{c}=' || {c}" for c in cols)
