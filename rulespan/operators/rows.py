"""Row rules: every row is judged on its own."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespan.functions.prep import in_scope, matches, present, relevant_columns
from rulespan.model import (
    SATISFACTION,
    VIOLATION,
    RuleResult,
    as_column,
    as_list,
    literal,
    participant_rows,
    row_id_column,
)
from rulespan.operators.metrics import finish, row_counts


@dataclass(frozen=True)
class RowRule:
    """If ``body`` then ``head``; without a body the head must hold on every row.

    ``cols`` are the columns whose missing values take a row out of the rule; left out, they are the columns that head
    and body read, but for those whose missing values the conditions ask about themselves.
    """

    rule_id: str
    head: Column | str
    body: Column | str | None = None
    cols: Sequence[str] | None = None

    def scope(self, df: DataFrame) -> Column:
        cols = relevant_columns(df, self.head, self.body) if self.cols is None else self.cols
        return in_scope(df, cols, self.body)

    def verdict(self) -> Column:
        return F.when(as_column(self.head), F.lit(SATISFACTION)).otherwise(F.lit(VIOLATION))


def row_rule(
    df: DataFrame,
    head: Column | str,
    body: Column | str | None = None,
    *,
    row_id: str | Sequence[str],
    cols: str | Sequence[str] | None = None,
    rule_id: str = "row_rule",
    support_mode: str = "applicable",
) -> RuleResult:
    rule = RowRule(rule_id, head, body, None if cols is None else as_list(cols))
    scope = rule.scope(df)
    metrics = finish(row_counts(df, scope, as_column(head)), rule_id, "row", support_mode)

    def find(verdicts: Sequence[str]) -> DataFrame:
        judged = df.where(scope).select(rule.verdict().alias("verdict"), row_id_column(row_id).alias("_row"))
        return participant_rows(judged, literal(rule_id)).where(F.col("verdict").isin(*verdicts))

    return RuleResult(rule_id, "row", metrics, find)


def not_null_rule(
    df: DataFrame,
    cols: str | Sequence[str],
    *,
    row_id: str | Sequence[str],
    rule_id: str = "not_null",
) -> RuleResult:
    """A rule about missing values, so rows with missing values are judged and not excluded."""
    return row_rule(df, present(df, as_list(cols)), row_id=row_id, cols=(), rule_id=rule_id)


def pattern_rule(
    df: DataFrame,
    col: str,
    pattern: str,
    *,
    row_id: str | Sequence[str],
    body: Column | str | None = None,
    rule_id: str = "pattern",
) -> RuleResult:
    return row_rule(df, matches(col, pattern), body, row_id=row_id, cols=[col], rule_id=rule_id)


@dataclass(frozen=True)
class SharedScan:
    """Results of several row rules evaluated together."""

    metrics: DataFrame
    participants: DataFrame


def evaluate_row_rules(
    df: DataFrame, rules: Sequence[RowRule], *, row_id: str | Sequence[str], support_mode: str = "applicable"
) -> SharedScan:
    """Evaluate many row rules of one table in a single scan, for metrics and for participants."""
    scopes = {r.rule_id: r.scope(df) for r in rules}
    if len(scopes) != len(rules):
        raise ValueError("rule ids must be distinct")
    flags, counters = [], []
    for i, rule in enumerate(rules):
        flags += [scopes[rule.rule_id].alias(f"_scope{i}"), as_column(rule.head).alias(f"_head{i}")]
        counters.append(
            f"named_struct('rule_id', {literal(rule.rule_id)}, 'total_rows', count(1), "
            f"'applicable_rows', count_if(_scope{i}), 'sat_rows', count_if(_scope{i} and _head{i}))"
        )
    counted = (
        df.select(*flags)
        .selectExpr(f"array({', '.join(counters)}) as r")
        .selectExpr("inline(r)")
        .selectExpr("*", "applicable_rows - sat_rows as viol_rows", "0 as sat_groups", "0 as viol_groups")
    )
    metrics = finish(counted, None, "row", support_mode)
    verdicts = F.array(
        *[
            F.when(scopes[r.rule_id], F.struct(F.lit(r.rule_id).alias("rule_id"), r.verdict().alias("verdict")))
            for r in rules
        ]
    )
    exploded = df.select(row_id_column(row_id).alias("_row"), F.explode(F.array_compact(verdicts)).alias("v"))
    participants = participant_rows(exploded, "v.rule_id", verdict="v.verdict")
    return SharedScan(metrics, participants)
