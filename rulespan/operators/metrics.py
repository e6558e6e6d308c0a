"""Support and confidence, and the shapes a result can be read in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespan.model import METRIC_COLUMNS, SATISFACTION, VIOLATION, literal
from rulespan.operators.skew import find_hot, join_groups

COUNT_TYPE = "bigint"
# Pair rules count pairs, and a group of 10^11 rows has more pairs than a bigint holds.
GROUP_COUNT_TYPE = "decimal(38,0)"

SUPPORT_MODES = ("applicable", "satisfied")
GROUP_VERDICTS = ("each", "any_violation")


def ratio(part: str, whole: str, empty: float) -> str:
    """SQL for a share, ``empty`` where there is nothing to share."""
    return f"if({whole} = 0, {empty}D, cast({part} as double) / cast({whole} as double))"


def finish(counts: DataFrame, rule_id: str | None, rule_class: str, support_mode: str = "applicable") -> DataFrame:
    """Add the ratios to the table of counts, which has one row per rule.

    support    = rows the rule looked at / all rows (nulls excluded from the first, not from the second);
                 with ``support_mode="satisfied"``, rows that satisfy it / all rows
    confidence = satisfied / (satisfied + violated), over rows for row rules and over group keys or pairs
                 otherwise; 1.0 when nothing was applicable

    Without ``rule_id`` the counts carry one. The text form of the expressions is on purpose: it is one call
    into the JVM instead of some hundred, and a catalogue has many rules.
    """
    if support_mode not in SUPPORT_MODES:
        raise ValueError(f"support_mode must be one of {SUPPORT_MODES}")
    counted = counts.selectExpr(
        "rule_id" if rule_id is None else f"{literal(rule_id)} as rule_id",
        f"{literal(rule_class)} as rule_class",
        *[f"cast(coalesce({c}, 0) as {COUNT_TYPE}) as {c}" for c in METRIC_COLUMNS[2:6]],
        *[f"cast(coalesce({c}, 0) as {GROUP_COUNT_TYPE}) as {c}" for c in METRIC_COLUMNS[6:8]],
    )
    sat, viol = ("sat_rows", "viol_rows") if rule_class == "row" else ("sat_groups", "viol_groups")
    supported = "applicable_rows" if support_mode == "applicable" else "sat_rows"
    return counted.selectExpr(
        "*",
        f"{ratio(supported, 'total_rows', 0.0)} as support",
        f"{ratio(sat, f'({sat} + {viol})', 1.0)} as confidence",
        f"{ratio('viol_rows', '(viol_rows + sat_rows)', 0.0)} as violation_rate",
    )


def row_counts(df: DataFrame, scope: Column, head: Column) -> DataFrame:
    """The counts of a row rule, in one aggregate over all rows."""
    judged = df.select(scope.alias("_scope"), head.alias("_head"))
    return judged.selectExpr(
        "count(1) as total_rows",
        "count_if(_scope) as applicable_rows",
        "count_if(_scope and _head) as sat_rows",
        "count_if(_scope and not coalesce(_head, false)) as viol_rows",
        "0 as sat_groups",
        "0 as viol_groups",
    )


def group_counts(groups: DataFrame, group_verdict: str = "each") -> DataFrame:
    """Sum a per-group table up; rows are never touched, group sizes give their number.

    ``groups`` has ``all_rows``, ``involved_rows``, ``sat_rows``, ``viol_rows`` and the flags ``sat`` and
    ``viol``. A key that has representations on both sides counts once on each, or only as violated with
    ``group_verdict="any_violation"``.
    """
    if group_verdict not in GROUP_VERDICTS:
        raise ValueError(f"group_verdict must be one of {GROUP_VERDICTS}")
    sat = "sat" if group_verdict == "each" else "sat and not viol"
    return groups.selectExpr(
        "sum(all_rows) as total_rows",
        "sum(involved_rows) as applicable_rows",
        "sum(sat_rows) as sat_rows",
        "sum(viol_rows) as viol_rows",
        f"count_if({sat}) as sat_groups",
        "count_if(viol) as viol_groups",
    )


def metrics_of(participants: DataFrame, total_rows: int | DataFrame, rule_id: str, rule_class: str = "group") -> DataFrame:
    """Metrics from a participant table, for rules that come as one (user functions, stored results).

    A row counts once per side however many roles it plays; a group counts once per side.
    ``total_rows`` is a number or the table the rule ran on.
    """
    total = F.lit(total_rows) if isinstance(total_rows, int) else total_rows.agg(F.count(F.lit(1))).scalar()
    sat, viol = F.col("verdict") == SATISFACTION, F.col("verdict") == VIOLATION
    per_row = participants.groupBy("row_id").agg(F.max(sat).alias("sat"), F.max(viol).alias("viol"))
    rows = per_row.agg(
        F.count(F.lit(1)).alias("applicable_rows"),
        F.count_if("sat").alias("sat_rows"),
        F.count_if("viol").alias("viol_rows"),
    )
    unit = F.col("rep_id") if rule_class == "pair" else F.to_json("group_key")
    units = (
        participants.select(unit.alias("unit"), "verdict").distinct()
        .agg(F.count_if(sat & F.col("unit").isNotNull()).alias("sat_groups"),
             F.count_if(viol & F.col("unit").isNotNull()).alias("viol_groups"))
    )
    # Two one-row aggregates and a count: the second and third come in as scalar subqueries.
    counted = rows.withColumn("_units", units.select(F.struct("sat_groups", "viol_groups")).scalar())
    return finish(counted.select("*", "_units.*").withColumn("total_rows", total), rule_id, rule_class)


def _dealt(df: DataFrame, by: Sequence[str], page_rows: int, spread: Sequence[str], upper: int | None) -> DataFrame:
    """Deal the rows of each group over pages of about ``page_rows`` rows by a hash of ``spread``."""
    # The key holds nulls (row rules have no group), which do not meet in a join; their JSON text does.
    keyed = df.withColumn("_part", F.to_json(F.struct(*by)))
    pages = keyed.groupBy("_part").agg(F.ceil(F.count(F.lit(1)) / page_rows).alias("_pages"))
    spread_hash = F.xxhash64(*spread)
    return (
        join_groups(keyed, pages, ["_part"], find_hot(keyed, ["_part"], upper), F.struct(*spread))
        .withColumn("page", F.pmod(spread_hash, F.col("_pages")).cast("int"))
        .drop("_part", "_pages")
    )


def nest(participants: DataFrame, page_rows: int = 1000, upper: int | None = None) -> DataFrame:
    """The nested reading: per group and verdict, an array of (rep_id, role, role_key, rows).

    No row is left out and no array grows with the group: a role with more than ``page_rows`` rows becomes
    several entries, a group with more than ``page_rows`` entries several pages. Ordinary groups have the
    one page 0. ``upper`` is a bound on the participants, if one is known.
    """
    group = ["rule_id", "verdict", "group_key"]
    role = group + ["rep_id", "role", "role_key"]
    entries = (
        _dealt(participants, role, page_rows, ["row_id"], upper)
        .groupBy(*role, "page")
        .agg(F.sort_array(F.collect_list("row_id")).alias("rows"))
        .drop("page")
    )
    return (
        _dealt(entries, group, page_rows, ["rep_id", "role", "role_key", "rows"], upper)
        .groupBy(*group, "page")
        .agg(F.sort_array(F.collect_list(F.struct("rep_id", "role", "role_key", "rows"))).alias("representations"))
    )


def participant_ids(nested: DataFrame) -> DataFrame:
    """The row ids inside nested results, once per rule and verdict."""
    return (
        nested.select("rule_id", "verdict", F.explode("representations").alias("r"))
        .select("rule_id", "verdict", F.explode("r.rows").alias("row_id"))
        .distinct()
    )


def verdict_rows(participants: DataFrame) -> DataFrame:
    """Row ids per verdict, each once."""
    return participants.select("rule_id", "verdict", "row_id").distinct()
