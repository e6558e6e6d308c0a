"""Usage statistics and quality ranking of reusable items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespan.functions.text import header_fields
from rulespan.model import as_list
from rulespan.operators.skew import find_hot, running

# Weights of the quality score, days over which recency fades, and the smoothing share.
SUCCESS_POINTS = 40
TIME_POINTS = 30
MEMORY_POINTS = 20
RECENCY_POINTS = 10
RECENCY_DAYS = 30
SMOOTHING = 0.3
NEW_ITEM_SCORE = 50.0
TOP_ITEMS = 10


def usage_stats(events: DataFrame, key: str, ts: str, success: Column) -> DataFrame:
    """Per item: uses, share of successful uses, time of the last use."""
    return events.groupBy(key).agg(
        F.count(F.lit(1)).alias("usage_count"),
        F.avg(F.coalesce(success, F.lit(False)).cast("double")).alias("success_rate"),
        F.max(ts).alias("last_used"),
    )


def ema(
    events: DataFrame, key: str, order: str | Sequence[str], value: str, alpha: float = SMOOTHING, name: str = "ema"
) -> DataFrame:
    """Per item the exponential moving average of ``value``, oldest first, missing values skipped.

    new = (1 - alpha) * old + alpha * value, beginning with the first value. Unrolled, a value with j later
    ones weighs alpha * (1 - alpha)^j, and the first one (1 - alpha)^j, so the fold is a weighted sum: it
    needs a running count and no step-by-step pass. ``order`` must be unique per item.
    """
    order = as_list(order)
    by = [f"_o{i}" for i in range(len(order))]
    seen = events.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(
        key, F.col(value).cast("double").alias("_v"), F.lit(1).alias("_one"), *[F.col(c).alias(b) for b, c in zip(by, order)]
    )
    hot = find_hot(seen, [key], events.count())
    placed = running(seen, [key], by, {"_later": ("sum", "_one")}, hot, descending=True)
    weight = F.pow(F.lit(1.0 - alpha), F.col("_later"))
    folded = placed.groupBy(key).agg(
        F.sum(F.lit(alpha) * weight * F.col("_v")).alias("_sum"),
        F.count(F.lit(1)).alias("_n"),
        F.min_by("_v", F.struct(*by)).alias("_first"),
    )
    opening = F.pow(F.lit(1.0 - alpha), F.col("_n") - 1) * F.lit(1.0 - alpha) * F.col("_first")
    return folded.select(key, (F.col("_sum") + opening).alias(name))


def _better_when_lower(col: str, low: Column, high: Column, points: int) -> Column:
    """Full points for the smallest value of all items, none for the largest, half when they do not differ."""
    scaled = (1 - (F.col(col) - low) / (high - low)) * points
    return F.when(F.col(col).isNotNull() & (high > low), scaled).otherwise(F.lit(points / 2))


def quality_score(
    stats: DataFrame, as_of: Column, time: str = "execution_time", memory: str = "memory_usage"
) -> DataFrame:
    """Add ``quality_score`` (0 to 100) from success rate, time, memory and recency.

    Time and memory are compared with all items; the extremes come from one scalar subquery. All items are
    scored as of the same moment.
    """
    extremes = stats.agg(
        F.struct(
            F.min(time).alias("t0"), F.max(time).alias("t1"), F.min(memory).alias("m0"), F.max(memory).alias("m1")
        )
    ).scalar()
    placed = stats.withColumn("_x", extremes)
    age = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(F.col("last_used").cast("timestamp"))
    days = F.floor(age / 86400)
    recency = F.greatest(F.lit(0.0), RECENCY_POINTS - F.least(F.lit(float(RECENCY_POINTS)), days / RECENCY_DAYS * RECENCY_POINTS))
    score = (
        F.col("success_rate") * SUCCESS_POINTS
        + _better_when_lower(time, F.col("_x.t0"), F.col("_x.t1"), TIME_POINTS)
        + _better_when_lower(memory, F.col("_x.m0"), F.col("_x.m1"), MEMORY_POINTS)
        + recency
    )
    return placed.withColumn("quality_score", score).drop("_x")


def top_snippets(scores: DataFrame, item: str, tag: str | None = None, k: int = TOP_ITEMS) -> DataFrame:
    """The ``k`` best items, of those whose tags match the regex ``tag`` if one is given."""
    if tag:
        scores = scores.where(F.coalesce(F.col("tags").rlike(tag), F.lit(False)))
    return scores.orderBy(F.col("quality_score").desc(), item).limit(k)


def register_new(files: DataFrame, known: DataFrame, as_of: Column) -> DataFrame:
    """Entries for files not yet known, with neutral values; description and tags come from the header.

    ``files`` has snippet_id, filepath and text; ``known`` has snippet_id.
    """
    new = files.join(known.select("snippet_id"), "snippet_id", "left_anti")
    fields = header_fields(F.col("text"))
    return new.select(
        "snippet_id",
        "filepath",
        fields["description"].alias("description"),
        fields["tags"].alias("tags"),
        F.lit(None).cast("double").alias("execution_time"),
        F.lit(None).cast("double").alias("memory_usage"),
        F.lit(0).cast("long").alias("usage_count"),
        F.lit(0.0).alias("success_rate"),
        as_of.alias("last_used"),
        F.lit(NEW_ITEM_SCORE).alias("quality_score"),
    )
