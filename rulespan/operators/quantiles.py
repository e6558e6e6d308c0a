"""Exact quantiles per group, without gathering a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespan.operators.skew import find_hot, join_groups, running, stored_if_large


def exact_quantiles(
    df: DataFrame, key: Sequence[str], value: str, probabilities: dict[str, float], upper: int
) -> DataFrame:
    """One row per key with linearly interpolated quantiles of ``value`` and the count ``n``.

    The result is exact, as ``percentile`` would give, but a group may exceed one task's memory. ``df`` has
    no missing key or value, and ``upper`` is at least its number of rows.
    """
    counts = df.groupBy(*key, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return quantiles_of_counts(counts, key, probabilities, upper)


def quantiles_of_counts(
    counts: DataFrame, key: Sequence[str], probabilities: dict[str, float], upper: int
) -> DataFrame:
    """The same from values already folded to (key, ``_v``, ``_n``).

    A running count over the distinct values tells which value sits at a wanted rank.
    """
    key = list(key)
    counts = stored_if_large(counts, upper)
    hot = find_hot(counts, key, upper)
    placed = running(counts, key, ["_v"], {"_before": ("sum", "_n")}, hot)
    totals = counts.groupBy(*key).agg(F.sum("_n").alias("n"))
    ranked = join_groups(placed, totals, key, hot, F.col("_v"))

    def at(rank: Column) -> Column:
        here = (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
        return F.max(F.when(here, F.col("_v")))

    low, high = {}, {}
    for name, p in probabilities.items():
        position = (F.col("n") - 1) * F.lit(float(p))
        low[name], high[name] = at(F.floor(position)), at(F.ceil(position))
    picked = ranked.groupBy(*key, "n").agg(
        *[c.alias(f"_lo_{name}") for name, c in low.items()], *[c.alias(f"_hi_{name}") for name, c in high.items()]
    )
    columns = []
    for name, p in probabilities.items():
        position = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        columns.append((lo + (hi - lo) * (position - F.floor(position))).alias(name))
    return picked.select(*key, "n", *columns)
