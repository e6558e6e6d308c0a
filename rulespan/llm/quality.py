"""Quality classifier: naive Bayes support vectors over n-grams of words and of word shapes (see ``nbsvm``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespan.llm import nbsvm
from rulespan.llm.common import Words, fold, mix

SIZE = 1 << 18
#: White space separates; letters, digits and other characters outside ASCII are one class; each other mark its own.
KINDS = np.array([0 if b in (9, 11, 12, 13, 32) else 1 if 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128 else 2 for b in range(256)], np.uint8)
KINDS[10] = 3
_UPPER = np.array([65 <= b < 91 for b in range(256)])
_DIGIT = np.array([48 <= b < 58 for b in range(256)])


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words, n-grams of 1 to 3 shapes (a mark is itself, a word its case, digits and rough length), and returns of words."""
    words = Words(texts, KINDS, lower=False)
    if not len(words.start):
        return
    size = np.uint64(SIZE)
    yield words.of, (words.hash % size).astype(np.int64)
    sums = lambda flags: np.concatenate(([0], np.cumsum(flags[words.data], dtype=np.int32)))
    upper, digits = sums(_UPPER), sums(_DIGIT)
    length = words.end - words.start
    up, dig = upper[words.end] - upper[words.start], digits[words.end] - digits[words.start]
    case = np.where(up == 0, 0, np.where((up == 1) & _UPPER[words.data[words.start]] & (length > 1), 1, np.where(2 * up >= length, 2, 3)))
    rough = np.minimum(length, 24) // 4
    shape = mix((case * 1000 + np.where(dig == 0, 0, np.where(dig == length, 200, 100)) + rough + 7).astype(np.uint64))
    shape = np.where(KINDS[words.data[words.start]] == 1, shape, words.hash)
    # Words that come again: the same three in a row a few words on.
    three = mix(mix(words.hash[:-2]) + words.hash[1:-1]) + words.hash[2:]
    for lag in range(1, 9):
        again = np.flatnonzero((three[lag:] == three[:-lag]) & (words.of[: len(three) - lag] == words.of[lag + 2 :]))
        yield words.of[again], np.full(len(again), int(mix(np.array([lag + 99], np.uint64))[0] % size))
    gram = shape
    for n in range(1, 4):
        yield words.of[: len(gram)], (mix(gram + np.uint64(n)) % size).astype(np.int64)
        if n == 3 or len(gram) < 2:
            return
        # a gram within one text
        same = words.of[:-n] == words.of[n:]
        gram = np.where(same, mix(gram[:-1]) * np.uint64(3) + shape[n:], np.uint64(0))


def keep(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1, bound: int = nbsvm.BOUND) -> DataFrame:
    """The whole rows of ``docs`` that the classifier takes for good, by the model that ``judge`` fits to these rows."""
    model = nbsvm.train(docs, labels, "quality", fold(F.col("doc_id"), mod) != held, features, SIZE, bound=bound, least_rows=3, least_ratio=0.5)
    return nbsvm.passing(docs, model, features)


def judge(docs: DataFrame, labels: DataFrame, mod: int = 3, held: int = 1, bound: int = nbsvm.BOUND) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    return nbsvm.judged(docs, labels, "quality", mod, held, features, SIZE, bound=bound, least_rows=3, least_ratio=0.5)
