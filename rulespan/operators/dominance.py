"""How many earlier rows of a group have a smaller value: dominance counts without pairs.

Points have a group, an order and a value; a query asks for the points of its group that come before it in the order
and lie below a threshold. Two range exchanges cut the events (points and queries) into slices of about equal size: first
by (group, order), then by (group, value). A point that counts for a query is

* in the query's order slice: counted there, in one task; or
* in an earlier order slice and the query's value slice: counted there, in one task; or
* in an earlier slice both ways: a sum over the cells (order slice, value slice) of the group.

Only a group that spans several slices both ways has cells to sum, at most slices * slices of them. So a group that
holds the whole table is cut like any other, at every size, and n rows cost n log n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespan.session import checkpointed

#: Where an event stands among those of its value: a query "below", the points, a query "up to".
BELOW, POINT, UP_TO = 0, 1, 2


def smaller_before(group: np.ndarray, code: np.ndarray, point: np.ndarray) -> np.ndarray:
    """For each position that is no point: the points of its group that come before it and have a smaller code.

    Halves of halves: for each width a point in the left half of a block counts for the right half, in the order of codes.
    """
    n = len(group)
    counts = np.zeros(n, np.int64)
    if not n:
        return counts
    # one number per (group, code), so that every width needs one stable sort
    by_code = np.lexsort((code, group))
    step = np.ones(n, bool)
    step[1:] = (group[by_code[1:]] != group[by_code[:-1]]) | (code[by_code[1:]] != code[by_code[:-1]])
    # a point doesn't count for a query of its own code, so among equal codes the points go last
    by_code = by_code[np.lexsort((point[by_code], np.cumsum(step)))]
    width = 1
    while width < n:
        order = by_code[np.argsort(by_code // (2 * width), kind="stable")]
        left = (order // width) % 2 == 0
        running = np.cumsum(point[order] & left)
        start = np.ones(n, bool)
        start[1:] = (order[1:] // (2 * width) != order[:-1] // (2 * width)) | (group[order[1:]] != group[order[:-1]])
        before = np.concatenate(([0], running[:-1]))
        base = np.maximum.accumulate(np.where(start, before, 0))
        counts[order[~left]] += (before - base)[~left]
        width *= 2
    return counts


def _numbers(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).combine_chunks().to_numpy(zero_copy_only=False)


def counted(events: DataFrame, descending: bool = False) -> DataFrame:
    """The queries of ``events`` with ``_hits`` (points before them and below) and ``_before`` (points before them).

    ``events`` has ``_g`` (the group as a long), ``_o`` (the order), ``_v`` (value or threshold), ``_t`` (BELOW, POINT or
    UP_TO) and any other columns, which pass through. Points of the same order as a query don't come before it. With
    ``descending`` larger orders come first. A slice is held in memory by its task: its size follows from the number of
    shuffle partitions.
    """
    number = T.LongType()
    by_order = T.StructType([*events.schema.fields, T.StructField("_i", number), T.StructField("_hits", number), T.StructField("_before", number)])
    by_value = T.StructType([*by_order.fields, T.StructField("_j", number)])

    def within_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        group, tie = _numbers(table, "_g"), _numbers(table, "_t").astype(np.int64)
        point = tie == POINT
        rank = pc.rank(table.column("_v").combine_chunks(), sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)
        hits = smaller_before(group, 3 * rank + tie, point)
        total = np.concatenate(([0], np.cumsum(point)))[:-1]
        start = np.ones(len(group), bool)
        start[1:] = group[1:] != group[:-1]
        before = total - np.maximum.accumulate(np.where(start, total, 0))
        own = TaskContext.get().partitionId()
        table = table.append_column("_i", pa.array(np.full(len(group), own))).append_column("_hits", pa.array(hits)).append_column("_before", pa.array(before))
        yield from table.to_batches(max_chunksize=10_000)

    def within_value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        point = _numbers(table, "_t") == POINT
        slices = _numbers(table, "_i")
        # positions are values here; a point's slice must be smaller than the query's
        more = smaller_before(_numbers(table, "_g"), 2 * slices + point, point)
        at = table.schema.get_field_index("_hits")
        table = table.set_column(at, "_hits", pa.array(_numbers(table, "_hits") + more))
        table = table.append_column("_j", pa.array(np.full(len(point), TaskContext.get().partitionId())))
        yield from table.to_batches(max_chunksize=10_000)

    order = F.col("_o").desc() if descending else F.col("_o")
    # queries first: a query doesn't see points of its own order
    first = events.repartitionByRange("_g", order).sortWithinPartitions("_g", order, F.col("_t") == POINT)
    sliced = first.mapInArrow(within_order, by_order)
    second = sliced.repartitionByRange("_g", "_v", "_t").sortWithinPartitions("_g", "_v", "_t")
    # Slice numbers must be the same in both uses below, so they are written.
    done = checkpointed(second.mapInArrow(within_value, by_value))

    cells = done.groupBy("_g", "_i", "_j").agg(F.count_if(F.col("_t") == POINT).alias("_n"))
    spans = cells.groupBy("_g").agg(F.min("_i").alias("a"), F.max("_i").alias("b"), F.min("_j").alias("c"), F.max("_j").alias("d"))
    grid = (
        spans.where("a < b and c < d")
        .select("_g", F.explode(F.sequence("a", "b")).alias("_i"), "c", "d")
        .select("_g", "_i", F.explode(F.sequence("c", "d")).alias("_j"))
        .join(cells, ["_g", "_i", "_j"], "left")
    )
    earlier = Window.partitionBy("_g", "_j").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy("_g", "_i").orderBy("_j").rowsBetween(Window.unboundedPreceding, -1)
    summed = grid.withColumn("_above", F.sum("_n").over(earlier)).select("_g", "_i", "_j", F.sum("_above").over(lower).alias("_far"))
    rows = cells.groupBy("_g", "_i").agg(F.sum("_n").alias("_n"))
    prior = Window.partitionBy("_g").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    # A group's later slices: there are no more of them than slices.
    slices = rows.withColumn("_prior", F.sum("_n").over(prior)).where("_prior > 0").select("_g", "_i", "_prior")
    queries = done.where(F.col("_t") != POINT)
    met = queries.join(summed.where("_far > 0"), ["_g", "_i", "_j"], "left").join(slices, ["_g", "_i"], "left")
    return met.select(
        *events.columns, (F.col("_hits") + F.coalesce("_far", F.lit(0))).alias("_hits"), (F.col("_before") + F.coalesce("_prior", F.lit(0))).alias("_before"))
