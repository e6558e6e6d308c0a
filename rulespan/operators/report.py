"""Comparing results, summing up runs, and samples for a reader."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespan.model import SATISFACTION, VIOLATION, RuleResult, as_list, key_sql, quoted, row_id_column
from rulespan.operators.metrics import ratio, verdict_rows
from rulespan.session import checkpointed

#: Support and confidence may differ by this much and still count as reported equal.
METRIC_TOLERANCE = 0.01
#: The share of passing cases at which a rule counts as working.
PASS_THRESHOLD = 0.5


def compare_results(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Per rule: do both participant tables put the same rows on the same side?

    ``success`` asks for equal row sets of both verdicts. Both tables are folded to one row per
    (rule, verdict, row) with a flag per side, so no join and no per-rule list is involved.
    """
    sides = (
        verdict_rows(actual).withColumns({"in_actual": F.lit(True), "in_expected": F.lit(False)})
        .unionByName(verdict_rows(expected).withColumns({"in_actual": F.lit(False), "in_expected": F.lit(True)}))
        .groupBy("rule_id", "verdict", "row_id")
        .agg(F.bool_or("in_actual").alias("a"), F.bool_or("in_expected").alias("e"))
    )
    missing, unexpected = F.col("e") & ~F.col("a"), F.col("a") & ~F.col("e")
    violated = F.col("verdict") == VIOLATION
    return sides.groupBy("rule_id").agg(
        F.count_if(F.col("a") & F.col("e")).alias("common_rows"),
        F.count_if(missing & violated).alias("missing_violations"),
        F.count_if(unexpected & violated).alias("unexpected_violations"),
        F.count_if(missing & ~violated).alias("missing_satisfactions"),
        F.count_if(unexpected & ~violated).alias("unexpected_satisfactions"),
        (F.count_if(missing | unexpected) == 0).alias("success"),
    )


def compare_metrics(actual: DataFrame, expected: DataFrame, tol: float = METRIC_TOLERANCE) -> DataFrame:
    """Support and confidence against expected values, reported and not part of ``success``."""
    wanted = {"support": "expected_support", "confidence": "expected_confidence"}
    both = beside(actual.select("rule_id", *wanted), expected.select("rule_id", *wanted).withColumnsRenamed(wanted))
    return both.withColumns(
        {f"{c}_matches": F.abs(F.col(c) - F.col(e)) <= tol for c, e in wanted.items()}
    )


def beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per rule id with the columns of both tables, for rules that have a row in each.

    A union folded by rule id: the rule id of a metrics table is a constant, and a join on a constant would
    be planned as a nested loop.
    """
    sides = (
        left.withColumn("_l", F.lit(True)).unionByName(right.withColumn("_r", F.lit(True)), allowMissingColumns=True)
    )
    columns = [c for c in (*left.columns, *right.columns) if c != "rule_id"]
    folded = sides.groupBy("rule_id").agg(*[F.max(c).alias(c) for c in columns], F.bool_or("_l").alias("_l"), F.bool_or("_r").alias("_r"))
    return folded.where("_l and _r").drop("_l", "_r")


def pass_rate(cases: DataFrame, by: Sequence[str] = (), threshold: float = PASS_THRESHOLD) -> DataFrame:
    """Share of cases with ``success`` and whether it reaches the threshold; no cases is a rate of 0."""
    rated = cases.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_cases"), F.count_if(F.coalesce("success", F.lit(False))).alias("passed_cases")
    )
    return rated.withColumn("pass_rate", F.expr(ratio("passed_cases", "total_cases", 0.0))).withColumn("passed", F.col("pass_rate") >= F.lit(threshold))


# The outcomes a run log may hold.
STATUS = {
    "missing_info": "skipped_missing_info",
    "load_failed": "skipped_dataframe_load_failed",
    "ok": "processed_execution_successful",
    "bad_output": "processed_bad_output_format",
    "timeout": "processed_execution_timeout",
    "error": "processed_execution_error",
}


def run_status(
    has_info: Column, loaded: Column, seconds: Column, error: Column, has_output: Column, limit: float
) -> Column:
    """The outcome of one rule run, first cause first."""
    return (
        F.when(~has_info, F.lit(STATUS["missing_info"]))
        .when(~loaded, F.lit(STATUS["load_failed"]))
        .when(seconds > F.lit(limit), F.lit(STATUS["timeout"]))
        .when(error.isNotNull(), F.lit(STATUS["error"]))
        .when(~has_output, F.lit(STATUS["bad_output"]))
        .otherwise(F.lit(STATUS["ok"]))
    )


def run_summary(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals of a run log with status, seconds, injected, injected_found.

    Averages and shares without anything to divide by are NULL.
    """
    timed = F.col("seconds").isNotNull()
    found = F.col("injected") & F.coalesce("injected_found", F.lit(False))
    return (
        log.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("total_rules"),
            F.avg("seconds").alias("average_seconds"),
            F.count_if(timed).alias("timed_rules"),
            F.count_if("injected").alias("injected_rules"),
            F.count_if(found).alias("injected_found_rules"),
            F.count_if(F.col("status") == STATUS["ok"]).alias("ok_rules"),
            F.count_if(F.col("status") == STATUS["timeout"]).alias("timeout_rules"),
            F.count_if(F.col("status").isin(STATUS["error"], STATUS["bad_output"])).alias("failed_rules"),
            F.count_if(F.col("status").startswith("skipped")).alias("skipped_rules"),
        )
        .withColumn(
            "injected_found_percent",
            F.when(F.col("injected_rules") > 0, F.col("injected_found_rules") * 100.0 / F.col("injected_rules")),
        )
    )


def first_seen(df: DataFrame, col: str, order: str) -> DataFrame:
    """Distinct values of ``col`` with the first ``order`` value they were seen at; sort by it to list them."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(order).alias("first_seen"))


def fastest_variant(log: DataFrame, variant: str, seconds: str = "seconds", by: Sequence[str] = ()) -> DataFrame:
    """The variant with the shortest successful run; timed-out and failed runs do not compete."""
    done = log.where((F.col("status") == STATUS["ok"]) & F.col(seconds).isNotNull())
    return done.groupBy(*by).agg(
        F.min_by(variant, F.struct(seconds, variant)).alias("variant"), F.min(seconds).alias("seconds")
    )


def drill_down_rows(participants: DataFrame, df: DataFrame, row_id: str | Sequence[str], rows: int = 20) -> DataFrame:
    """For row rules: the first ``rows`` participants per rule and verdict with their data, and how many more."""
    part = ["rule_id", "verdict"]
    return _sample(participants.select(*part, "row_id").distinct(), part, rows, df, row_id)


def drill_down(
    rule: Callable[[DataFrame], RuleResult],
    df: DataFrame,
    key: str | Sequence[str],
    row_id: str | Sequence[str],
    groups: int = 10,
    per_role: int = 5,
) -> DataFrame:
    """For group rules: the first groups of each verdict, ``per_role`` rows of each role, and how many more.

    Groups are picked from the per-group table. Since a group is judged by its own rows, the rule is then
    run again on the rows of the picked groups alone, at most ``2 * groups`` of them.
    """
    key = as_list(key)
    per_group = rule(df).groups
    if per_group is None:
        raise ValueError("the rule has no groups; use drill_down_rows")
    sides = per_group.selectExpr(
        *[quoted(c) for c in key],
        f"to_json({key_sql(key)}) as _group",
        f"explode(filter(array(if(sat, '{SATISFACTION}', null), if(viol, '{VIOLATION}', null)), v -> v is not null)) as verdict",
    )
    picked = _first_groups(sides, ["verdict"], groups)
    # Written once, as the picked groups are read twice; Spark sees their size and broadcasts them if they are few.
    local = checkpointed(picked)
    few = df.join(local.select(*key), key, "left_semi")
    keyed = _with_role(rule(few).participants())
    return _drilled(keyed.join(local.drop(*key), ["verdict", "_group"]), few, row_id, per_role)


def drill_down_stored(
    participants: DataFrame, df: DataFrame, row_id: str | Sequence[str], groups: int = 10, per_role: int = 5
) -> DataFrame:
    """The same from stored participants of one or several group rules."""
    side = ["rule_id", "verdict"]
    keyed = _with_role(participants)
    picked = _first_groups(keyed.select(*side, "_group").distinct(), side, groups)
    return _drilled(keyed.join(checkpointed(picked), side + ["_group"]), df, row_id, per_role)


def _with_role(participants: DataFrame) -> DataFrame:
    return participants.selectExpr(
        "rule_id", "verdict", "to_json(group_key) as _group", "coalesce(rep_id, '') as rep_id",
        "coalesce(role, to_json(role_key), '') as role", "row_id",
    )


def _first_groups(listed: DataFrame, side: Sequence[str], groups: int) -> DataFrame:
    """The first groups of each side with their number and how many there are beyond them."""
    rank = Window.partitionBy(*side).orderBy("_group")
    first = listed.withColumn("group_no", F.row_number().over(rank)).where(F.col("group_no") <= groups)
    totals = listed.groupBy(*side).agg(F.greatest(F.count(F.lit(1)) - groups, F.lit(0)).alias("more_groups"))
    return first.join(totals, list(side))


def _drilled(kept: DataFrame, df: DataFrame, row_id: str | Sequence[str], per_role: int) -> DataFrame:
    part = ["rule_id", "verdict", "_group", "group_no", "more_groups", "rep_id", "role"]
    sampled = _sample(kept.select(*part, "row_id"), part, per_role, df, row_id)
    return sampled.withColumnRenamed("_group", "group_key")


def _sample(rows: DataFrame, part: Sequence[str], n: int, df: DataFrame, row_id: str | Sequence[str]) -> DataFrame:
    # The window keeps n rows per part on each task before anything is shuffled, so a hot part sends no more.
    first = Window.partitionBy(*part).orderBy("row_id")
    few = rows.withColumn("row_no", F.row_number().over(first)).where(F.col("row_no") <= n)
    totals = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_all"))
    counted = few.join(totals, list(part)).withColumn("more_rows", F.greatest(F.col("_all") - n, F.lit(0))).drop("_all")
    # An inner join, so that the few sampled rows may be the broadcast side.
    return df.withColumn("_own_id", row_id_column(row_id)).join(counted, F.col("_own_id") == counted["row_id"]).drop("_own_id")


def overview(metrics: DataFrame, df: DataFrame, log: DataFrame | None = None) -> DataFrame:
    """One row per rule for a reader: shape of the table, rows and groups per side, ratios.

    With the ``log`` of the run (rule_id, seconds, status) also the seconds the rule took and its outcome; rules that the
    log lacks have none.
    """
    run = []
    if log is not None:
        # A union folded by rule id: the rule id of a metrics table is a constant (see ``beside``).
        sides = metrics.withColumn("_shown", F.lit(True)).unionByName(log.select("rule_id", "seconds", "status"), allowMissingColumns=True)
        kept = [c for c in metrics.columns if c != "rule_id"]
        latest = F.max(F.struct("seconds", "status"))
        folded = sides.groupBy("rule_id").agg(*[F.max(c).alias(c) for c in kept], latest.alias("_run"), F.bool_or("_shown").alias("_shown"))
        metrics = folded.where("_shown")
        run = [F.col("_run.seconds").alias("seconds"), F.col("_run.status").alias("status")]
    return metrics.select(
        "rule_id",
        "rule_class",
        F.col("total_rows").alias("table_rows"),
        F.lit(len(df.columns)).alias("table_columns"),
        F.col("viol_rows").alias("violating_rows"),
        F.col("sat_rows").alias("satisfying_rows"),
        F.col("viol_groups").alias("violating_groups"),
        F.col("sat_groups").alias("satisfying_groups"),
        "support",
        "confidence",
        *run,
    )
