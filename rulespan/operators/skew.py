"""Group work that stays balanced when a few groups hold most of the rows.

Two things break on a hot group: a join on the group key sends all its rows to one task, and so does a
window partitioned by the key. ``join_groups`` salts the first. ``running`` splits the second into
order-preserving slices and carries totals from slice to slice. Both are used only when a measured group
size calls for them; otherwise the plain join or window is planned.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rulespan.session import BROADCAST_ROWS, checkpointed, hot_group_rows


#: Partitions of one range exchange. Beyond it slices grow instead, and their sort spills.
MAX_SLICES = 20_000


@dataclass(frozen=True)
class HotGroups:
    """Keys above the size limit with the number of parts each is split into.

    There are at most (all rows / limit) of them, and their number is measured before any broadcast.
    """

    table: DataFrame
    count: int
    parts: int

    def hinted(self) -> DataFrame:
        return F.broadcast(self.table) if self.count <= BROADCAST_ROWS else self.table


def stored_if_large(df: DataFrame, upper: int) -> DataFrame:
    """Write an intermediate result that several steps read, when it may be too large to redo cheaply."""
    return checkpointed(df) if upper > hot_group_rows(df.sparkSession) else df


def find_hot(df: DataFrame, key: Sequence[str], upper: int | None = None) -> HotGroups | None:
    """Groups of ``df`` with more rows than one task should hold; None when there are none.

    ``upper`` is a known bound on the rows of ``df`` (say, the rows of the table it was derived from): an
    input no larger than the limit has no hot group, and no job is needed to see it.
    """
    limit = hot_group_rows(df.sparkSession)
    if (df.count() if upper is None else upper) <= limit:
        return None
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    table = checkpointed(sizes.select(*key, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")))
    found = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("_parts"), F.lit(0))).first()
    return HotGroups(table, found[0], found[1]) if found[0] else None


def join_groups(
    rows: DataFrame,
    groups: DataFrame,
    key: Sequence[str],
    hot: HotGroups | None,
    spread: Column,
    how: str = "inner",
) -> DataFrame:
    """Join many ``rows`` to one row per key in ``groups``.

    Rows of a hot key are spread by a hash of ``spread`` over as many parts as the key needs, and only the
    hot keys of ``groups`` are repeated, so the repetition adds at most (all rows / limit) rows.
    """
    key = list(key)
    if hot is None:
        return rows.join(groups, key, how)
    parts = hot.hinted()
    salted = (
        rows.join(parts, key, "left")
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int"), F.lit(0)))
        .drop("_parts")
    )
    repeated = (
        groups.join(parts, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        .drop("_parts")
    )
    return salted.join(repeated, key + ["_salt"], how).drop("_salt")


AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max}
NEIGHBOURS = {"previous": F.lag, "next": F.lead}
# What a row gets from its own slice (near) and from the slices before it (far).
COMBINE = {
    "sum": lambda near, far: F.coalesce(near, F.lit(0)) + F.coalesce(far, F.lit(0)),
    "min": lambda near, far: F.least(near, far),
    "max": lambda near, far: F.greatest(near, far),
    "previous": lambda near, far: F.coalesce(near, far),
    "next": lambda near, far: F.coalesce(near, far),
}


def running(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    aggs: Mapping[str, tuple[str, str]],
    hot: HotGroups | None,
    descending: bool = False,
) -> DataFrame:
    """Add aggregates over all rows of the group that come strictly before the row.

    ``aggs`` maps a new column to (function, column). ``sum``, ``min`` and ``max`` run over everything
    before the row (larger values of ``order`` with ``descending``); ``previous`` and ``next`` take the
    neighbour's value, which must not be NULL itself. ``order`` is unique within a group. Where nothing
    comes before, a sum is 0 and the others are NULL. ``hot`` is what ``find_hot`` measured for ``key``.
    """
    key, order = list(key), list(order)
    if hot is None:
        return _running_window(df, key, order, aggs, descending)
    light = _running_window(df.join(hot.hinted(), key, "left_anti"), key, order, aggs, descending)
    heavy = df.join(hot.hinted(), key, "left_semi")
    return light.unionByName(_running_slices(heavy, key, order, aggs, descending, hot.parts))


def _over_earlier(fn: str, col: str, key: list[str], order: list[str], descending: bool) -> Column:
    ordered = Window.partitionBy(*key).orderBy(*[F.col(c).desc() if descending else F.col(c).asc() for c in order])
    if fn in NEIGHBOURS:
        return NEIGHBOURS[fn](col, 1).over(ordered)
    return AGGREGATES[fn](col).over(ordered.rowsBetween(Window.unboundedPreceding, -1))


def _running_window(df, key, order, aggs, descending) -> DataFrame:
    columns = {name: _over_earlier(fn, col, key, order, descending) for name, (fn, col) in aggs.items()}
    return df.withColumns(
        {name: F.coalesce(c, F.lit(0)) if aggs[name][0] == "sum" else c for name, c in columns.items()}
    )


def _running_slices(df, key, order, aggs, descending, parts) -> DataFrame:
    # A range exchange on (key, order) cuts even a single key into ordered slices of about equal size.
    # The slice number must not change between the two uses below, so the sliced rows are written first.
    sliced = checkpointed(
        df.repartitionByRange(min(2 * parts, MAX_SLICES), *key, *order).withColumn("_slice", F.spark_partition_id())
    )
    rank = F.struct(*order)
    edge = {"previous": lambda c: F.max_by(c, rank), "next": lambda c: F.min_by(c, rank), **AGGREGATES}
    totals = sliced.groupBy(*key, "_slice").agg(*[edge[fn](col).alias(f"_{n}") for n, (fn, col) in aggs.items()])
    # At most one row per slice of a key: a few thousand rows however large the group is.
    carried = totals.select(
        *key,
        "_slice",
        *[_over_earlier(fn, f"_{n}", key, ["_slice"], descending).alias(f"_{n}") for n, (fn, _) in aggs.items()],
    )
    within = _running_window(sliced, key + ["_slice"], order, aggs, descending)
    return (
        within.join(carried, key + ["_slice"])
        .withColumns({n: COMBINE[fn](F.col(n), F.col(f"_{n}")) for n, (fn, _) in aggs.items()})
        .drop("_slice", *[f"_{n}" for n in aggs])
    )
