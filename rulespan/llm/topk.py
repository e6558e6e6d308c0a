"""Exact top-k search by inner product over a bit-sliced index.

Vectors become integers floor(scale * x). The index holds, for each block of rows and each dimension, the bits of the
offset values as bitmaps, one per bit position ("slices"). A query adds the slices of all dimensions, shifted by the
signed digits of its own components, with carry-save adders on whole bitmaps; a negative digit adds the complement of a
slice. The k best rows are read off the sum from its most significant slice downward. Rows that tie with the last one
are the boundary: their scores are computed from the vectors and the smaller ids win.

Queries go in rounds of a fixed number, so what a round sends to the tasks has a fixed size. Each task keeps the k
best of its rows for each query of a round, and the results of the tasks are folded by query.

Defined cases: vectors that are null, empty, of another length than the most common one, or hold null or non-finite
components take no part; rows with a null id neither. Repeated ids are separate candidates, but none for a
query of the same id; equal rows are one query, rows of one id with different vectors are queries of their own. Ties go to the smaller id. Fewer than k candidates give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536
ROUND = 4_096


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """Ids and integer vectors of the rows that take part."""
    v = F.col("v")
    whole = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))))
    return whole.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def slices_of(values: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps (dimension, bit from the least, 64-bit words) of non-negative values (row, dimension)."""
    rows = -(-len(values) // 64) * 64
    padded = np.zeros((values.shape[1], rows), np.int64)
    padded[:, : len(values)] = values.T
    planes = (padded[:, None, :] >> np.arange(bits)[None, :, None]) & 1
    return np.packbits(planes.astype(np.uint8), axis=-1, bitorder="little").view(np.uint64)


def add_slices(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sum of bitmaps: ``columns[i]`` are those of weight 2**i; a carry-save adder turns three into a sum and a carry."""
    out, i = [], 0
    while i < len(columns):
        todo = columns[i]
        while len(todo) > 1:
            if i + 1 == len(columns):
                columns.append([])
            if len(todo) == 2:
                a, b = todo
                columns[i + 1].append(a & b)
                todo = [a ^ b]
                break
            a, b, c = todo[:3]
            u = a ^ b
            columns[i + 1].append((a & b) | (u & c))
            todo = [*todo[3:], u ^ c]
        out.append(todo[0] if todo else None)
        i += 1
    zero = np.zeros_like(next(x for x in out if x is not None)) if any(x is not None for x in out) else np.zeros(0, np.uint64)
    return [zero if x is None else x for x in out]


def top_rows(total: list[np.ndarray], alive: np.ndarray, k: int) -> int:
    """The k-th largest sum among the rows of ``alive``, read off the slices from the most significant downward."""
    value, above = 0, 0
    equal = alive
    for bit in range(len(total) - 1, -1, -1):
        ones = equal & total[bit]
        n = int(np.bitwise_count(ones).sum())
        if above + n >= k:
            equal, value = ones, value | (1 << bit)
        else:
            above += n
            equal = equal & ~total[bit]
    return value


def at_least(total: list[np.ndarray], alive: np.ndarray, value: int) -> np.ndarray:
    """Bitmap of the rows of ``alive`` whose sum is ``value`` or more."""
    if value <= 0:
        return alive
    if value >> len(total):
        return np.zeros_like(alive)
    more, equal = np.zeros_like(alive), alive
    for bit in range(len(total) - 1, -1, -1):
        if value >> bit & 1:
            equal = equal & total[bit]
        else:
            more = more | (equal & total[bit])
            equal = equal & ~total[bit]
    return more | equal


def signed_digits(value: int) -> list[tuple[int, int]]:
    """(position, 1 or -1) of the non-adjacent form: no two neighbouring digits, so a third of the bits are set."""
    out, at = [], 0
    sign, value = (1, value) if value >= 0 else (-1, -value)
    while value:
        if value & 1:
            digit = 2 - (value & 3)
            out.append((at, sign * digit))
            value -= digit
        value >>= 1
        at += 1
    return out


class Block:
    """Slices of up to ``BLOCK`` rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.values = ids, values
        spread = values - values.min(axis=0)
        self.bits = max(1, int(spread.max()).bit_length())
        self.planes = slices_of(spread, self.bits)
        self.flipped = ~self.planes
        full = np.zeros(self.planes.shape[-1] * 64, np.uint8)
        full[: len(ids)] = 1
        self.full = np.packbits(full, bitorder="little").view(np.uint64)

    def best(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the block's k best rows for a query, its own id aside; ties to smaller ids."""
        columns: list[list[np.ndarray]] = []
        for d, value in enumerate(query.tolist()):
            for at, digit in signed_digits(value):
                planes = self.planes[d] if digit > 0 else self.flipped[d]
                while len(columns) < at + self.bits:
                    columns.append([])
                for i in range(self.bits):
                    columns[at + i].append(planes[i])
        alive = self.full
        if columns:
            total = add_slices(columns)
            alive = at_least(total, alive, top_rows(total, alive, min(k + int((self.ids == own).sum()), len(self.ids))))
        chosen = np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little")[: len(self.ids)])
        chosen = chosen[self.ids[chosen] != own]
        scores = self.values[chosen] @ query
        order = np.lexsort((self.ids[chosen], -scores))[:k]
        return self.ids[chosen][order], scores[order]


def search(
    vectors: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
    block: int = BLOCK, per_round: int = ROUND,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row that ``queries`` (over ``id``) selects."""
    rows = quantised(vectors, id_col, vector_col, scale)
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    spark = vectors.sparkSession
    shape = "query_id long, rank int, vec_id long, score long"
    if size is None:
        return spark.createDataFrame([], shape)
    rows = rows.where(F.size("v") == size["n"])
    asked = rows.where(queries).distinct()
    rounds = max(1, -(-asked.count() // per_round))
    # The hash deals the queries to rounds; a round is fetched, bounded, and sent with the tasks' code.
    dealt = asked.withColumn("round", F.pmod(F.xxhash64("id"), F.lit(rounds)))
    # Bitmaps pay when they are long: small files are read together, without a shuffle.
    rows = rows.coalesce(max(1, -(-size["count"] // block)))
    hits = [_round(rows, dealt.where(F.col("round") == i).select("id", "v"), k, block, i << 32) for i in range(rounds)]
    by_score = Window.partitionBy("query_id", "asked").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionAll, hits).withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _round(rows: DataFrame, asked: DataFrame, k: int, block: int, first: int) -> DataFrame:
    fetched = asked.toArrow()
    own = fetched.column("id").to_numpy()
    wanted = np.array(fetched.column("v").to_pylist(), np.int64).reshape(len(own), -1)
    sent = rows.sparkSession.sparkContext.broadcast((own, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values = sent.value
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

        def take(found_ids: np.ndarray, found: np.ndarray) -> None:
            index = Block(found_ids, found)
            for i in range(len(ids)):
                a, s = index.best(ids[i], values[i], k)
                a, s = np.concatenate((kept[i][0], a)), np.concatenate((kept[i][1], s))
                order = np.lexsort((a, -s))[:k]
                kept[i] = a[order], s[order]

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                held.append((batch.column(0).to_numpy(zero_copy_only=False), flat.reshape(batch.num_rows, -1)))
            while sum(len(a) for a, _ in held) >= block:
                all_ids, all_values = np.concatenate([a for a, _ in held]), np.concatenate([v for _, v in held])
                take(all_ids[:block], all_values[:block])
                held = [(all_ids[block:], all_values[block:])]
        if sum(len(a) for a, _ in held):
            take(np.concatenate([a for a, _ in held]), np.concatenate([v for _, v in held]))
        for i, (a, s) in enumerate(kept):
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(a), ids[i])), pa.array(np.full(len(a), first + i)), pa.array(a), pa.array(s)],
                    names=["query_id", "asked", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, asked long, vec_id long, score long")
