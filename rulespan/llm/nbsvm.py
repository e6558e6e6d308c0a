"""Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios under a linear hinge-loss model.

``quality`` takes n-grams of words, ``toxicity`` n-grams of characters; the fit is the same. Labels are learnt from a
bounded sample (``bound`` labelled rows, those with the smallest hashes of their ids); every row is scored, over its
whole text. The fitted model is a table of hashed features of a fixed size.

A feature j that df+ of the n+ positive and df- of the n- negative rows hold has the ratio
r_j = log((df+ + 1) / (n+ + 2)) - log((df- + 1) / (n- + 2)). A row is the vector of the r_j of its features. The hinge
loss is minimised by dual coordinate descent: one row after the other, its multiplier moves to the best place between 0
and C and the weights follow.

Defined cases: null texts are empty and score by the bias alone; labels that are null, neither 0 nor 1, without an id or
contradictory for an id are not learnt; of several texts of an id one is learnt, the same at any partitioning; without labels of both classes every score is 0.5; repeated rows are scored
each; null ids are scored and are in no fold (``held_out`` false); extra columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespan.llm.common import bounded_sample, fold, id_text, kept_table, slices

#: Labelled rows that a model is fitted on at most.
BOUND = 20_000
#: Tasks that read the sample.
TASKS = 8
CHUNK = 2 << 20

Features = Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]]
"""(row, hashed feature) pairs of some texts, in portions; the same pair may come again."""


@dataclass
class Model:
    """Weights of hashed features (most are 0), the bias, and the scale of the margin."""

    weights: np.ndarray
    bias: float
    scale: float = 1.0

    def __post_init__(self) -> None:
        self.heavy = self.weights != 0

    def score(self, texts: pa.Array, features: Features) -> np.ndarray:
        margin = np.full(len(texts), self.bias)
        size = np.uint64(len(self.weights))
        kept = [np.zeros(0, np.uint64)]
        for rows, found in features(texts):
            heavy = self.heavy[found]
            kept.append(np.unique(rows[heavy].astype(np.uint64) * size + found[heavy].astype(np.uint64)))
        pairs = np.unique(np.concatenate(kept))
        np.add.at(margin, (pairs // size).astype(np.int64), self.weights[(pairs % size).astype(np.int64)])
        return 1 / (1 + np.exp(-np.clip(self.scale * margin, -30, 30)))


class Looked(Sequence):
    """The values of each row's features, looked up when asked for: the whole sample's would take twice the room of its features."""

    def __init__(self, of: np.ndarray, rows: Sequence[np.ndarray]) -> None:
        self.of, self.rows = of, rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.of[self.rows[i]]


def descend(rows: Sequence[np.ndarray], values: Sequence[np.ndarray], labels: np.ndarray, size: int, cost: np.ndarray, rounds: int, seed: int = 7) -> np.ndarray:
    """Weights (the last one is the bias) of the hinge-loss model by dual coordinate descent."""
    weights, alpha = np.zeros(size + 1), np.zeros(len(rows))
    square = np.array([(v * v).sum() + 1.0 for v in values])
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        largest = 0.0
        for i in random.permutation(len(rows)):
            own = values[i]
            gradient = labels[i] * (weights[rows[i]] @ own + weights[-1]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * labels[i]
            if step:
                weights[rows[i]] += step * own
                weights[-1] += step
                largest = max(largest, abs(step) * square[i])
                alpha[i] = new
        if largest < 1e-3:
            break
    return weights


def ratios(df: np.ndarray, positive: int, negative: int, least_rows: int, least_ratio: float) -> np.ndarray:
    """Log-count ratios from ``df`` (class, feature). Features of few rows or a small ratio are 0, that is left out."""
    ratio = np.log((df[1] + 1) / (positive + 2)) - np.log((df[0] + 1) / (negative + 2))
    ratio[(df[0] + df[1] < least_rows) | (np.abs(ratio) < least_ratio)] = 0
    return ratio


def fit(rows: Sequence[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 60) -> Model:
    """A model from each row's distinct features (those whose ratio is not 0) and 0/1 labels."""
    positive, n = labels == 1, len(labels)
    if not n or positive.all() or not positive.any():
        return Model(np.zeros(len(ratio)), 0.0)
    # Both classes weigh the same in sum.
    weight = np.where(positive, n / 2 / positive.sum(), n / 2 / (n - positive.sum()))
    weights = descend(rows, Looked(ratio, rows), np.where(positive, 1.0, -1.0), len(ratio), cost * weight, rounds)
    return Model((weights[:-1] * ratio).astype(np.float32).astype(np.float64), float(weights[-1]), 2.0)


def by_row(texts: pa.Array, features: Features) -> Iterator[tuple[int, np.ndarray]]:
    """(row, some of its features), in portions; a feature may come again."""
    for rows, found in features(texts):
        ends = np.searchsorted(rows, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            if ends[i] < ends[i + 1]:
                yield i, found[ends[i] : ends[i + 1]]


def kept_features(texts: pa.Array, features: Features, wanted: np.ndarray) -> list[np.ndarray]:
    """The distinct wanted features of each row."""
    lists: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(len(texts))]
    for i, found in by_row(texts, features):
        lists[i].append(found[wanted[found]])
    return [np.unique(np.concatenate(x)).astype(np.int32) for x in lists]


def train(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, features: Features, size: int, bound: int = BOUND,
          least_rows: int = 2, least_ratio: float = 0.0) -> Model:
    """Fit on at most ``bound`` labelled rows; ``learn`` says of a label's doc_id whether it may be learnt."""
    y = F.col("y")
    known = labels.select(F.col("doc_id"), F.col(label_col).cast("int").alias("y")).where(
        F.col("doc_id").isNotNull() & y.isin(0, 1) & learn).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other"))
    chosen = bounded_sample(known.where(F.col("y") == F.col("other")).select("doc_id", "y"), F.col("doc_id"), bound)
    # At most ``bound`` ids and labels travel to the tasks. Of several texts of an id the one with the smallest hash is learnt,
    # whatever the partitioning. The sample's texts are written, as two passes read them.
    rows = id_text(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    single = rows.groupBy("doc_id").agg(F.min_by(F.struct("y", "text"), F.xxhash64("text")).alias("row")).select("row.*")
    sample = kept_table(single.repartition(TASKS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros((2, size), np.int32), [0, 0]
        for batch in batches:
            for part in slices(batch, 1, CHUNK):
                labels_of = part.column(0).to_pylist()
                for i, found in by_row(part.column(1), features):
                    # Portions share no feature but by chance, and a repeated index counts once here.
                    df[labels_of[i]][found] += 1
                for y in labels_of:
                    n[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array([n[1]], pa.int64()), pa.array([n[0]], pa.int64()), pa.array([df.tobytes()], pa.binary())],
                                         names=["positive", "negative", "df"])

    df, positive, negative = np.zeros((2, size), np.int64), 0, 0
    for r in sample.mapInArrow(count, "positive long, negative long, df binary").toLocalIterator():
        df += np.frombuffer(r["df"], np.int32).reshape(2, size)
        positive, negative = positive + r["positive"], negative + r["negative"]
    ratio = ratios(df, positive, negative, least_rows, least_ratio)
    sent = docs.sparkSession.sparkContext.broadcast(ratio != 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, CHUNK):
                found = kept_features(part.column(1), features, sent.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32()))], names=["y", "f"])

    # In an order of its own, so that the same sample gives the same model at any partitioning.
    table = sample.mapInArrow(run, "y int, f array<int>").toArrow()
    labels_of, lists = table.column("y").to_numpy(), lists_of(table.column("f"))
    order = ordered(labels_of, lists)
    return fit([lists[i] for i in order], labels_of[order], ratio)


def lists_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column, as parts of its own memory."""
    out: list[np.ndarray] = []
    for chunk in column.chunks:
        flat, at = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        out += [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    return out


def ordered(labels: np.ndarray, lists: list[np.ndarray]) -> list[int]:
    """Places by label and bytes of the list. Only where the first bytes are the same all of them are taken."""
    first = lambda i: (labels[i], lists[i][:16].tobytes())
    same = groupby(sorted(range(len(lists)), key=first), first)
    return [i for _, group in same for i in sorted(group, key=lambda i: lists[i].tobytes())]


def scored(docs: DataFrame, model: Model, features: Features, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    source = id_text(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, CHUNK):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.score(part.column(1), features))], names=["doc_id", "score"])

    return source.mapInArrow(run, T.StructType([source.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def passing(docs: DataFrame, model: Model, features: Features, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The whole rows that score ``least`` or more, filtered where they are read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, CHUNK):
                texts = pc.fill_null(part.column(at), "")
                yield part.filter(pa.array(sent.value.score(texts, features) >= least))

    return docs.mapInArrow(run, docs.schema)


def judged(docs: DataFrame, labels: DataFrame, label_col: str, mod: int, held: int, features: Features, size: int, **how) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; labels of the held-out fold are not learnt."""
    model = train(docs, labels, label_col, fold(F.col("doc_id"), mod) != held, features, size, **how)
    return scored(docs, model, features).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), mod) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
