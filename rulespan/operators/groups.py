"""Group-validation rules: rows are grouped by a key and each group is judged.

Metrics come from per-group aggregates, so a hot group is reduced map-side before anything is shuffled.
Participants join the verdicts back to the rows; that join is salted for hot keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespan.functions.prep import compare, in_scope, present
from rulespan.model import (
    SATISFACTION,
    VIOLATION,
    RuleResult,
    as_column,
    as_list,
    key_sql,
    literal,
    participant_rows,
    quoted,
    row_id_column,
)
from rulespan.operators.metrics import finish, group_counts
from rulespan.operators.skew import find_hot, join_groups


def summable(df: DataFrame, value: str, scale: int | None) -> Column:
    """A column as its sums need it: whole numbers and decimals exactly, doubles as they are.

    Sums of doubles depend on the order of addition in their last digits, so compare them with a tolerance; or give
    ``scale`` for amounts that have so many decimal places, which are then summed exactly.
    """
    kind = df.schema[value].dataType
    if scale is not None:
        return F.col(value).cast(f"decimal(38,{scale})")
    if isinstance(kind, T.IntegralType):
        return F.col(value).cast("decimal(38,0)")
    return F.col(value) if isinstance(kind, T.DecimalType) else F.col(value).cast("double")


def threshold_like(df: DataFrame, value: str, scale: int | None, threshold: float) -> Column:
    """A constant to compare such sums with."""
    exact = scale is not None or isinstance(df.schema[value].dataType, (T.IntegralType, T.DecimalType))
    return F.lit(Decimal(str(threshold))) if exact else F.lit(float(threshold))



def scoped(
    df: DataFrame,
    key: Sequence[str],
    relevant: Sequence[str],
    body: Column | str | None,
    row_id: str | Sequence[str],
    keep: dict[str, Column],
) -> DataFrame:
    """Only the columns the rule needs, with ``_ok`` for rows in scope and ``_row`` for the row identity.

    Rows out of scope get NULL for all else. They then fall into one group, the one without a key, that
    map-side aggregation folds to a row per task; so all rows are counted in the same pass instead of in a
    second scan.
    """
    if not key:
        raise ValueError("a group rule needs at least one key column; group by a constant column for the whole table")
    ok = in_scope(df, relevant, body)
    return df.select(
        ok.alias("_ok"),
        row_id_column(row_id).alias("_row"),
        *[F.when(ok, F.col(c)).alias(c) for c in key],
        *[F.when(ok, expr).alias(name) for name, expr in keep.items()],
    )


def judgeable(key: Sequence[str]) -> str:
    """SQL that is false for the group of the rows out of scope. Grouping by the key alone, and not by ``_ok``
    as well, lets the join back to the rows reuse the partitioning of the groups."""
    return f"{quoted(key[0])} is not null"


def judged_groups(per_key: DataFrame, key: Sequence[str], holds: Column | str, rows: str) -> DataFrame:
    """Add the columns ``group_counts`` sums, for rules that give a whole group one verdict.

    ``holds`` is NULL for groups the rule does not apply to; ``rows`` is the number of rows with a role.
    """
    judged = per_key.withColumn("_holds", as_column(holds)).withColumn("_holds", F.expr(f"if({judgeable(key)}, _holds, null)"))
    return judged.selectExpr(
        "*",
        f"{VERDICT_SQL} as verdict",
        "coalesce(_holds, false) as sat",
        "coalesce(not _holds, false) as viol",
        f"if(_holds is null, 0, {rows}) as involved_rows",
        f"if(_holds, {rows}, 0) as sat_rows",
        f"if(not _holds, {rows}, 0) as viol_rows",
    )


#: The verdict as text, from the flag ``_holds``.
VERDICT_SQL = f"case when _holds then '{SATISFACTION}' when not _holds then '{VIOLATION}' end"


def rows_with_verdict(
    df: DataFrame, rows: DataFrame, groups: DataFrame, key: Sequence[str], verdicts: Sequence[str]
) -> DataFrame:
    """Rows in scope joined with the verdict of their group. ``df`` is the table ``rows`` came from."""
    rows = rows.where("_ok").drop("_ok")
    wanted = groups.where(F.col("verdict").isin(*verdicts)).select(*key, "verdict")
    return join_groups(rows, wanted, key, find_hot(rows, key, df.count()), F.col("_row"))


def _result(
    rule_id: str,
    groups: DataFrame,
    find: Callable[[Sequence[str]], DataFrame],
    group_verdict: str = "each",
) -> RuleResult:
    metrics = finish(group_counts(groups, group_verdict), rule_id, "group")
    return RuleResult(rule_id, "group", metrics, find, groups.where("sat or viol"))


def unique_key(
    df: DataFrame,
    key: str | Sequence[str],
    *,
    row_id: str | Sequence[str],
    body: Column | str | None = None,
    rule_id: str = "unique_key",
) -> RuleResult:
    """No two rows share the key. Groups of one satisfy (``unique_record``), larger ones are ``duplicates``."""
    key = as_list(key)
    rows = scoped(df, key, key, body, row_id, {})
    per_key = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("all_rows"))
    groups = judged_groups(per_key, key, "all_rows = 1", "all_rows")

    def find(verdicts: Sequence[str]) -> DataFrame:
        joined = rows_with_verdict(df, rows, groups, key, verdicts)
        role = f"if(verdict = '{SATISFACTION}', 'unique_record', 'duplicates')"
        return participant_rows(
            joined, literal(rule_id), group_key=key_sql(key), rep_id="0", role=role
        )

    return _result(rule_id, groups, find)


def functional_dependency(
    df: DataFrame,
    lhs: str | Sequence[str],
    rhs: str | Sequence[str],
    *,
    row_id: str | Sequence[str],
    within: str | Sequence[str] = (),
    body: Column | str | None = None,
    rule_id: str = "functional_dependency",
) -> RuleResult:
    """``lhs`` determines ``rhs``. Each distinct right-hand value of a group is a role.

    ``within`` limits the dependency to rows that agree on further columns, which is the same as a wider
    left side. Counting by (lhs, rhs) first keeps a hot left side off a single task: what reaches the
    second grouping is one row per distinct pair.
    """
    key, rhs = as_list(within) + as_list(lhs), as_list(rhs)
    rows = scoped(df, key, key + rhs, body, row_id, {c: F.col(c) for c in rhs if c not in key})
    pairs = rows.groupBy(*key, *[c for c in rhs if c not in key]).agg(F.count(F.lit(1)).alias("_n"))
    per_key = pairs.groupBy(*key).agg(
        F.sum("_n").alias("all_rows"), F.count(F.lit(1)).alias("distinct_values")
    )
    groups = judged_groups(per_key, key, "distinct_values = 1", "all_rows")

    def find(verdicts: Sequence[str]) -> DataFrame:
        joined = rows_with_verdict(df, rows, groups, key, verdicts)
        return participant_rows(
            joined, literal(rule_id), group_key=key_sql(key), rep_id="0", role_key=key_sql(rhs)
        )

    return _result(rule_id, groups, find)


def sum_to_total(
    df: DataFrame,
    key: str | Sequence[str],
    value: str,
    part: Column | str,
    total: Column | str,
    op: str = "=",
    *,
    row_id: str | Sequence[str],
    tol: float = 0,
    scale: int | None = None,
    body: Column | str | None = None,
    rule_id: str = "sum_to_total",
) -> RuleResult:
    """Per group, the sum over ``part`` rows compared with the sum over ``total`` rows.

    A group without one of the two roles is not judged. ``scale``: see ``summable``.
    """
    key = as_list(key)
    role = F.when(as_column(part), F.lit("sum")).when(as_column(total), F.lit("compare"))
    rows = scoped(df, key, [*key, value], body, row_id, {"_value": summable(df, value, scale), "_role": role})
    is_part, is_total = F.col("_role") == "sum", F.col("_role") == "compare"
    per_key = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("all_rows"),
        F.sum(F.when(is_part, F.col("_value"))).alias("sum_value"),
        F.sum(F.when(is_total, F.col("_value"))).alias("total_value"),
        F.count_if(is_part | is_total).alias("role_rows"),
    )
    holds = compare(F.col("sum_value"), op, F.col("total_value"), tol)
    groups = judged_groups(per_key, key, holds, "role_rows")

    def find(verdicts: Sequence[str]) -> DataFrame:
        joined = rows_with_verdict(df, rows.where(F.col("_role").isNotNull()), groups, key, verdicts)
        return participant_rows(
            joined, literal(rule_id), group_key=key_sql(key), rep_id="0", role="_role"
        )

    return _result(rule_id, groups, find)


def sum_to_threshold(
    df: DataFrame,
    key: str | Sequence[str],
    value: str,
    op: str,
    threshold: float,
    *,
    row_id: str | Sequence[str],
    window: tuple[str, str] | None = None,
    tol: float = 0,
    scale: int | None = None,
    body: Column | str | None = None,
    group_verdict: str = "each",
    rule_id: str = "sum_to_threshold",
) -> RuleResult:
    """Per group, the sum of ``value`` compared with a constant. ``scale``: see ``summable``.

    ``window=(time column, unit)`` makes one representation per calendar unit (``quarter``, ``week`` ...),
    so a group may hold satisfied and violated representations.
    """
    key = as_list(key)
    relevant = [*key, value] + ([window[0]] if window else [])
    rep = F.date_trunc(window[1], F.col(window[0])) if window else F.lit(None).cast("timestamp")
    rows = scoped(df, key, relevant, body, row_id, {"_value": summable(df, value, scale), "_rep": rep})
    limit = threshold_like(df, value, scale, threshold)
    reps = (
        rows.groupBy(*key, "_rep")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_value").alias("sum_value"))
        .withColumn("_holds", compare(F.col("sum_value"), op, limit, tol))
        .withColumn("verdict", F.expr(f"if({judgeable(key)}, {VERDICT_SQL}, null)"))
    )
    groups = mixed_groups(reps, key)

    def find(verdicts: Sequence[str]) -> DataFrame:
        on = key + ["_rep_key"]
        # A missing window would not meet itself in the join.
        text = F.coalesce(F.col("_rep").cast("string"), F.lit(""))
        joined = rows_with_verdict(
            df, rows.withColumn("_rep_key", text), reps.withColumn("_rep_key", text), on, verdicts
        )
        return participant_rows(
            joined, literal(rule_id), group_key=key_sql(key), rep_id="coalesce(cast(_rep as string), '0')", role="'sum'"
        )

    return _result(rule_id, groups, find, group_verdict)


def mixed_groups(reps: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per-group table from representations of ``_n`` rows with a verdict each, whose rows do not overlap."""
    sat, viol = f"verdict = '{SATISFACTION}'", f"verdict = '{VIOLATION}'"
    columns = {
        "all_rows": "sum(_n)",
        "sat_rows": f"coalesce(sum(_n) filter (where {sat}), 0)",
        "viol_rows": f"coalesce(sum(_n) filter (where {viol}), 0)",
        "involved_rows": "coalesce(sum(_n) filter (where verdict is not null), 0)",
        "sat_reps": f"count_if({sat})",
        "viol_reps": f"count_if({viol})",
    }
    folded = reps.groupBy(*key).agg(*[F.expr(f"{sql} as {name}") for name, sql in columns.items()])
    return folded.selectExpr("*", "sat_reps > 0 as sat", "viol_reps > 0 as viol")


GROUP_AGGREGATES = {
    "count": lambda c: F.count(F.lit(1)),
    "count_distinct": lambda c: F.count_distinct(c),
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "avg": F.avg,
}


def aggregate_constraint(
    df: DataFrame,
    key: str | Sequence[str],
    agg: str,
    predicate: Callable[[Column], Column] | str,
    value: str | None = None,
    *,
    row_id: str | Sequence[str],
    scale: int | None = None,
    body: Column | str | None = None,
    rule_id: str = "aggregate_constraint",
) -> RuleResult:
    """An aggregate of every group must fulfil ``predicate`` (a function, or SQL over ``agg_value``).

    ``scale``: for sums, see ``summable``.
    """
    if agg not in GROUP_AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}; use one of {sorted(GROUP_AGGREGATES)}")
    if value is None and agg != "count":
        raise ValueError(f"aggregate {agg!r} needs a value column")
    key = as_list(key)
    keep = {"_value": summable(df, value, scale) if agg == "sum" else F.col(value)} if value else {}
    rows = scoped(df, key, key + as_list(value), body, row_id, keep)
    result = GROUP_AGGREGATES[agg](F.col("_value") if value else None)
    per_key = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("all_rows"), result.alias("agg_value"))
    holds = F.expr(predicate) if isinstance(predicate, str) else predicate(F.col("agg_value"))
    groups = judged_groups(per_key, key, F.coalesce(holds, F.lit(False)), "all_rows")

    def find(verdicts: Sequence[str]) -> DataFrame:
        joined = rows_with_verdict(df, rows, groups, key, verdicts)
        return participant_rows(
            joined, literal(rule_id), group_key=key_sql(key), rep_id="0", role="'group'"
        )

    return _result(rule_id, groups, find)


@dataclass(frozen=True)
class GroupRule:
    """A condition on an aggregate of every group: SQL over ``agg_value``. A unique key is ``count``, ``= 1``."""

    rule_id: str
    agg: str
    predicate: str
    value: str | None = None
    body: str | None = None
    scale: int | None = None


def evaluate_group_rules(df: DataFrame, key: str | Sequence[str], rules: Sequence[GroupRule]) -> DataFrame:
    """Metrics of many rules on one key, from one scan and one shuffle of the per-group aggregates.

    Every rule keeps its own scope: rows outside it count for the others.
    """
    key = as_list(key)
    if len({r.rule_id for r in rules}) != len(rules):
        raise ValueError("rule ids must be distinct")
    keyed = present(df, key)
    flags, folded, results = [], [F.count(F.lit(1)).alias("all_rows")], []
    for i, rule in enumerate(rules):
        if rule.agg not in GROUP_AGGREGATES or (rule.value is None and rule.agg != "count"):
            raise ValueError(f"rule {rule.rule_id}: aggregate {rule.agg!r} is unknown or lacks a value column")
        ok = in_scope(df, key + as_list(rule.value), rule.body)
        flags.append(ok.alias(f"_ok{i}"))
        if rule.value:
            own = summable(df, rule.value, rule.scale) if rule.agg == "sum" else F.col(rule.value)
            flags.append(F.when(ok, own).alias(f"_v{i}"))
        folded.append(F.expr(f"count_if(_ok{i}) as _n{i}"))
        folded.append(
            GROUP_AGGREGATES[rule.agg](F.col(f"_v{i}")).alias(f"_a{i}") if rule.value else F.expr(f"count_if(_ok{i}) as _a{i}")
        )
        holds = f"coalesce(transform(array(_a{i}), agg_value -> ({rule.predicate}))[0], false)"
        sat, viol = f"_n{i} > 0 and {holds}", f"_n{i} > 0 and not {holds}"
        counts = {
            "total_rows": "sum(all_rows)", "applicable_rows": f"sum(_n{i})",
            "sat_rows": f"sum(if({sat}, _n{i}, 0))", "viol_rows": f"sum(if({viol}, _n{i}, 0))",
            "sat_groups": f"count_if({sat})", "viol_groups": f"count_if({viol})",
        }
        fields = ", ".join(f"'{name}', {sql}" for name, sql in counts.items())
        results.append(f"named_struct('rule_id', {literal(rule.rule_id)}, {fields})")
    rows = df.select(*[F.when(keyed, F.col(c)).alias(c) for c in key], *flags)
    per_key = rows.groupBy(*key).agg(*folded)
    counted = per_key.selectExpr(f"array({', '.join(results)}) as r").selectExpr("inline(r)")
    return finish(counted, None, "group")
