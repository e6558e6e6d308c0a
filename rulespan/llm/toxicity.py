"""Toxicity classifier: character n-grams scaled by naive Bayes log-count ratios under a linear model (see ``nbsvm``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rulespan.llm import nbsvm
from rulespan.llm.common import ALNUM, LOWER, Bytes, mix

SIZE = 1 << 20
BOUND = 12_000
#: Lengths in characters of the n-grams, over text with A-Z in lower case whose runs of other ASCII characters are one blank.
GRAMS = (4, 5, 6)


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    source = Bytes(texts)
    data, bounds = source.data, source.bounds
    data = np.where(ALNUM[data], LOWER[data], 32).astype(np.uint8)
    if not len(data):
        return
    # The first of a run of blanks stays; a text's edge counts as one.
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    edge = np.flatnonzero(np.diff(bounds)) if len(bounds) > 1 else []
    # One text's end goes before the next one's beginning at the same place.
    at = np.concatenate((bounds[1:][edge], bounds[:-1][edge]))
    who = np.concatenate((edge, edge)).astype(np.int32)
    text, rows = data[keep], owner[keep]
    new = np.concatenate(([0], np.cumsum(keep)))[at]
    text, rows = np.insert(text, new, 32), np.insert(rows, new, who)
    # A character is the bytes up to the next one that begins a character, as one number.
    starts = np.flatnonzero((text & 0xC0) != 0x80)
    sizes, rows = np.diff(starts, append=len(text)), rows[starts]
    chars = text[starts].astype(np.uint64)
    for k in range(1, 4):
        longer = sizes > k
        chars[longer] |= text[starts[longer] + k].astype(np.uint64) << np.uint64(8 * k)
    hashed = np.zeros(len(chars), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if n > len(chars):
            return
        hashed = mix(hashed[: len(chars) - n + 1] * np.uint64(31) + chars[n - 1 :] + np.uint64(1))
        if n in GRAMS:
            same = rows[: len(hashed)] == rows[n - 1 :]
            yield rows[: len(hashed)][same], (hashed[same] % np.uint64(SIZE)).astype(np.int64)


def judge(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0, bound: int = BOUND) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    return nbsvm.judged(docs, labels, "toxic", mod, held, features, SIZE, bound=bound, least_rows=8, least_ratio=1.5)
