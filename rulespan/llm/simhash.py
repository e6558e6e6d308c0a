"""SimHash near duplicates by pivot distance tables.

A text's fingerprint has a bit set where over half of the hashes of its word 4-grams have it. Texts of one fingerprint are
one point. Points within ``RADIUS`` bits link, and a component is what links join.

Points meet in lists: of RADIUS + 2 pieces of the bits two points within the radius have at least two pieces equal, so
a list for every pair of pieces and their values misses no link. In a list the distances of all points to many reference
fingerprints (the pivots) come first, a table with a column per pivot. Two points whose distances to some pivot differ
by more than the radius are further apart than the radius (triangle inequality): the greatest difference of a coordinate
discards nearly all pairs, and the rest is verified bit by bit. The pivots are Walsh functions: no two coordinates of the
table are correlated over evenly spread fingerprints, so each discards what others leave.

A list is read as a sorted stream and compared by portions of ``PORTION`` points, as a search from point to point that
takes each point away when it is first reached; so copies that link with each other cost one comparison each, and no
pairs are written, only the links that the search went along. Rows of a list are dealt by range, so a list that holds a third of
all points is spread over tasks. After a round the components are known. A list that was compared in several portions and
has several components is compared whole if it fits a portion. Else its points get further lists: of RADIUS + 1 pieces of the
bits outside the list's own one is equal. Each round so fixes a fifth of the free bits (at least one), and a list with few
free bits is short, whatever the input; lists of one component are done at once.

Defined cases: a null text is an empty text; texts without words have the fingerprint zero, which links like any other;
repeated rows share their point; rows of one id stand for themselves; a null id never names a component (a component of
null ids alone has none); other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespan.llm.common import id_text, kept_table, slices
from rulespan.llm.ngramjoin import components

N, SEED, RADIUS = 4, 42, 4
#: Points that are compared at once, and rows that a task reads before it compares.
PORTION, READ = 4_096, 100_000
#: Points of a list up to which all pairs go through the table together.
FEW = 8
#: Walsh functions as fingerprints: bit j of pivot i is the parity of i & j.
PIVOTS = np.array([sum(((i & j).bit_count() & 1) << j for j in range(64)) for i in range(32)], np.uint64)
#: A key with more than this share of all rows is joined by broadcast: there are fewer than 1,000 such keys.
HOT_SHARE = 1_000
CHUNK = 4 << 20


def fingerprint(text: bytes, n: int = N) -> int:
    """The fingerprint of a text, unsigned. Hashes are counted by portions, so a long text needs little memory for them."""
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = min(n, len(words))
    first, last = starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(first), 65_536):
        hashes = np.array([digest(whole[a:b], SEED) for a, b in zip(first[at : at + 65_536], last[at : at + 65_536])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(first), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every row."""
    source = id_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, CHUNK):
                found = [fingerprint(t) for t in part.column(1).cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("fp", T.LongType())]))


def pieces(bits: list[int], count: int) -> list[int]:
    """The bit numbers dealt to ``count`` masks of about the same size, as signed longs; fewer masks if there are fewer bits."""
    masks = [sum(1 << b for b in bits[i::count]) for i in range(min(count, len(bits)))]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def lists(points: DataFrame, radius: int) -> DataFrame:
    """sig, mask, fp: the first lists of every point, one for each pair of pieces. ``mask`` has the bits a list fixes."""
    masks = [a | b for a, b in combinations(pieces(list(range(64)), radius + 2), 2)]
    entry = [F.struct(F.xxhash64(F.lit(m), F.col("fp").bitwiseAND(F.lit(m))).alias("sig"), F.lit(m).alias("mask")) for m in masks]
    return points.select("fp", F.explode(F.array(*entry)).alias("e")).select("e.sig", "e.mask", "fp")


def further(entries: DataFrame, radius: int) -> DataFrame:
    """The next lists of the points of ``entries``: of radius + 1 pieces of the free bits one is fixed too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[int]] = {}
        for batch in batches:
            masks = batch.column(0).to_pylist()
            for m in set(masks) - set(known):
                known[m] = [m | x for x in pieces([b for b in range(64) if not m >> b & 1], radius + 1)]
            rows = [(x, i) for i, m in enumerate(masks) for x in known[m]]
            if rows:
                fps = batch.column(1).take(pa.array([i for _, i in rows]))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), fps], names=["mask", "fp"])

    made = entries.select("mask", "fp").mapInArrow(run, "mask long, fp long").distinct()
    return made.select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("sig"), "mask", "fp")


def distances(points: np.ndarray) -> np.ndarray:
    """The pivot table: the distance of each point to each pivot."""
    table = np.empty((len(points), len(PIVOTS)), np.int8)
    for k, pivot in enumerate(PIVOTS):
        table[:, k] = np.bitwise_count(points ^ pivot)
    return table


def _near(a: np.ndarray, b: np.ndarray, table_a: np.ndarray, table_b: np.ndarray, radius: int) -> np.ndarray:
    """Positions of the pairs (a, b) within the radius: a few pivots, the other pivots, then the bits."""
    left = np.flatnonzero((np.abs(table_a[..., :8] - table_b[..., :8]) <= radius).all(axis=-1))
    own = table_a[..., 8:] if table_a.ndim == 1 else table_a[left, 8:]
    left = left[(np.abs(own - table_b[left, 8:]) <= radius).all(axis=-1)]
    return left[np.bitwise_count((a if np.ndim(a) == 0 else a[left]) ^ b[left]) <= radius]


def searched(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the points of each component: from every point to those it reaches first."""
    table, left = distances(points), np.arange(len(points))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = _near(points[i], points[left], table[i], table[left], radius)
            if len(hit):
                reached = left[hit]
                a.append(np.full(len(hit), points[i]))
                b.append(points[reached])
                left = np.delete(left, hit)
                todo += reached.tolist()
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _few(sigs: np.ndarray, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The links of many short lists at once: neighbours of each distance in the sorted rows."""
    table = distances(points)
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for lag in range(1, FEW):
        i = np.flatnonzero(sigs[lag:] == sigs[:-lag])
        if not len(i):
            break
        hit = i[_near(points[i], points[i + lag], table[i], table[i + lag], radius)]
        a.append(points[hit])
        b.append(points[hit + lag])
    return np.concatenate(a), np.concatenate(b)


def compared(entries: DataFrame, radius: int, portion: int, whole: bool) -> DataFrame:
    """Links (a, b), and a row with ``sig`` alone for each portion of a list that may have other portions.

    ``entries`` are sorted by sig in each task; ``whole`` says that no list is in two tasks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge_of_task: set[int] = set()

        def out(sigs: np.ndarray, points: np.ndarray, ends: bool) -> pa.RecordBatch:
            """Compare lists; the last one is the task's last if ``ends``."""
            bounds = np.concatenate(([0], np.flatnonzero(sigs[1:] != sigs[:-1]) + 1, [len(sigs)]))
            if not whole and not edge_of_task:
                edge_of_task.add(int(sigs[0]))
            if not whole and ends:
                edge_of_task.add(int(sigs[-1]))
            sizes = np.diff(bounds)
            each = np.repeat(sizes, sizes)
            short = (each > 1) & (each <= FEW)
            a, b = (list(x) for x in zip(_few(sigs[short], points[short], radius)))
            marks = [s for s in (int(sigs[0]), int(sigs[-1])) if s in edge_of_task]
            marks = marks[:1] if len(marks) == 2 and marks[0] == marks[1] else marks
            for g in np.flatnonzero(sizes > FEW).tolist():
                low, high, sig = int(bounds[g]), int(bounds[g + 1]), int(sigs[bounds[g]])
                for at in range(low, high, portion):
                    x, y = searched(points[at : min(at + portion, high)], radius)
                    a.append(x)
                    b.append(y)
                    if at > low or (high - low > portion and sig not in edge_of_task):
                        marks.append(sig)
            x, y = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
            none = pa.nulls(len(marks), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(x), none]), pa.concat_arrays([pa.array(y), none]),
                 pa.concat_arrays([pa.nulls(len(x), pa.int64()), pa.array(marks, pa.int64())])], names=["a", "b", "sig"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            if sum(len(s) for s, _ in held) < READ:
                continue
            sigs, points = np.concatenate([s for s, _ in held]), np.concatenate([p for _, p in held])
            # the last list may go on: of a long one whole portions go now, and it is marked for all of them
            cut = int(np.searchsorted(sigs, sigs[-1]))
            if len(sigs) - cut > portion:
                edge_of_task.add(int(sigs[-1]))
                cut += (len(sigs) - cut) // portion * portion
            if cut:
                yield out(sigs[:cut], points[:cut], False)
            held = [(sigs[cut:], points[cut:])]
        if sum(len(s) for s, _ in held):
            yield out(np.concatenate([s for s, _ in held]), np.concatenate([p for _, p in held]), True)

    return entries.select("sig", "fp").mapInArrow(run, "a long, b long, sig long")


def links(points: DataFrame, radius: int = RADIUS, portion: int = PORTION) -> DataFrame:
    """(v, label): the component of every point (fp, distinct) that links with another one."""
    entries, short = lists(points, radius), None
    known: DataFrame | None = None
    while True:
        found = compared(entries.repartitionByRange("sig", "fp").sortWithinPartitions("sig", "fp"), radius, portion, False)
        if short is not None:
            found = found.unionAll(compared(short.repartition("sig").sortWithinPartitions("sig"), radius, portion, True))
        found = kept_table(found)
        edges = found.where("a IS NOT NULL").select("a", "b")
        known = components(edges if known is None else edges.unionAll(known.select(F.col("v").alias("a"), F.col("label").alias("b"))))
        parts = found.where("sig IS NOT NULL").groupBy("sig").count().where("count > 1").select("sig")
        marked = entries.join(parts, "sig").join(known.withColumnRenamed("v", "fp"), "fp", "left").select(
            "sig", "mask", "fp", F.coalesce("label", "fp").alias("label"))
        open_ = marked.groupBy("sig").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        left = kept_table(marked.select("sig", "mask", "fp").join(open_.select("sig", "n"), "sig"))
        sizes = left.agg(F.count_if(F.col("n") <= portion).alias("short"), F.count_if(F.col("n") > portion).alias("long")).first()
        if not sizes["short"] and not sizes["long"]:
            return known
        short = left.where(F.col("n") <= portion) if sizes["short"] else None
        if sizes["long"]:
            entries = kept_table(further(left.where(F.col("n") > portion), radius))
        else:
            last = kept_table(compared(short.repartition("sig").sortWithinPartitions("sig"), radius, portion, True))
            return components(last.select("a", "b").unionAll(known.select(F.col("v").alias("a"), F.col("label").alias("b"))))


def spread_join(rows: DataFrame, of: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` (a written table) left-joined to ``of`` (one row a key; ``weight``: its rows in ``rows``).

    Keys with more than a thousandth of the rows are fewer than a thousand: they go to all tasks, so that no task gets
    all rows of a key. The others are shuffled.
    """
    total = of.agg(F.sum(weight).alias("n")).first()["n"] or 0
    others = [c for c in of.columns if c not in (key, weight)]
    hot = of.where(F.col(weight) * HOT_SHARE > total).select(key, F.struct(*others).alias("__of"))
    met = rows.join(F.broadcast(hot), key, "left")
    cold = met.where("__of IS NULL").drop("__of").join(of.where(F.col(weight) * HOT_SHARE <= total).select(key, F.struct(*others).alias("__of")), key, "left")
    return met.where("__of IS NOT NULL").unionByName(cold).select(*rows.columns, "__of.*")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, portion: int = PORTION) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest id reachable by links) of every row."""
    rows = kept_table(fingerprints(docs, id_col, text_col))
    points = kept_table(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    labels = links(points.select("fp"), radius, portion).withColumnRenamed("v", "fp")
    named = kept_table(points.join(labels, "fp", "left").select("fp", "low", "n", F.coalesce("label", "fp").alias("label")))
    smallest = kept_table(named.groupBy("label").agg(F.min("low").alias("component_id"), F.count("*").alias("points")))
    of = kept_table(spread_join(named, smallest, "label", "points").select("fp", "n", "component_id"))
    return spread_join(rows, of, "fp", "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
