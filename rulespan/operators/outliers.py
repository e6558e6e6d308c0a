"""Outlier rules: values far from the rest of their group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.model import RuleResult, as_list, key_sql, literal, participant_rows
from rulespan.operators.groups import VERDICT_SQL, mixed_groups, scoped
from rulespan.operators.metrics import finish, group_counts
from rulespan.operators.quantiles import exact_quantiles
from rulespan.operators.skew import find_hot, join_groups

METHODS = ("zscore", "iqr")
SIDES = ("both", "upper", "lower")


def outlier(
    df: DataFrame,
    key: str | Sequence[str],
    value: str,
    method: str = "zscore",
    k: float = 3.0,
    sides: str = "both",
    *,
    row_id: str | Sequence[str],
    body: Column | str | None = None,
    group_verdict: str = "each",
    rule_id: str = "outlier",
) -> RuleResult:
    """A row violates when its value lies outside the fences of its group.

    ``zscore``: mean +- k sample standard deviations; ``iqr``: quartiles -+ k times their distance.
    A group of one value, or without spread, has no outlier.
    """
    if method not in METHODS or sides not in SIDES:
        raise ValueError(f"method must be one of {METHODS} and sides one of {SIDES}")
    key = as_list(key)
    upper = df.count()
    rows = scoped(df, key, [*key, value], body, row_id, {"_value": F.col(value).cast("double")})
    judged_rows = rows.where("_ok").drop("_ok")
    if method == "zscore":
        stats = judged_rows.groupBy(*key).agg(F.avg("_value").alias("_mid"), F.stddev_samp("_value").alias("_sd"))
        reach = F.coalesce(F.col("_sd"), F.lit(0.0)) * F.lit(float(k))
        low, high = F.col("_mid") - reach, F.col("_mid") + reach
    else:
        stats = exact_quantiles(judged_rows, key, "_value", {"_q1": 0.25, "_q3": 0.75}, upper)
        reach = (F.col("_q3") - F.col("_q1")) * F.lit(float(k))
        low, high = F.col("_q1") - reach, F.col("_q3") + reach
    fences = stats.select(*key, low.alias("_low"), high.alias("_high"))
    too_low, too_high = F.col("_value") < F.col("_low"), F.col("_value") > F.col("_high")
    outside = {"both": too_low | too_high, "upper": too_high, "lower": too_low}[sides]

    # Judge distinct values with their counts: a hot group reaches the join already folded.
    folded = judged_rows.groupBy(*key, "_value").agg(F.count(F.lit(1)).alias("_n"))
    judged = join_groups(folded, fences, key, find_hot(folded, key, upper), F.col("_value"))
    reps = judged.withColumn("_holds", ~outside).selectExpr("*", f"{VERDICT_SQL} as verdict")
    groups = mixed_groups(reps, key)
    counts = group_counts(groups, group_verdict).withColumn("total_rows", F.lit(upper))
    metrics = finish(counts, rule_id, "group")

    def find(verdicts: Sequence[str]) -> DataFrame:
        joined = join_groups(judged_rows, fences, key, find_hot(judged_rows, key, upper), F.col("_row"))
        placed = joined.withColumn("_holds", ~outside).selectExpr("*", f"{VERDICT_SQL} as verdict")
        return participant_rows(
            placed.where(F.col("verdict").isin(*verdicts)), literal(rule_id),
            group_key=key_sql(key), rep_id="0", role="if(_holds, 'inliers', 'outliers')",
        )

    return RuleResult(rule_id, "group", metrics, find, groups)
