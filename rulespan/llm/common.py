"""Helpers the operators share: reading tables, bounded samples, folds and words as numpy arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def kept_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to a new folder below the checkpoint folder and read it again.

    The folder is the one ``spark.checkpoint.dir`` names; only where it is unset, in local mode, one is made.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="rulespan-llm-")
    path = f"{folder}/rulespan-llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, null texts as empty, so that no other column can clash with a result's."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def fold(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids belong to no fold."""
    return F.crc32(id_col.cast("string").cast("binary")) % mod


def bounded_sample(rows: DataFrame, key: Column, bound: int) -> DataFrame:
    """At most ``bound`` rows, those with the smallest hash of ``key``; the same rows at any partitioning.

    Only hashes travel to find the cut: each task keeps its ``bound`` smallest.
    """
    hashed = rows.withColumn("__hash", F.xxhash64(key))
    cut = hashed.select("__hash").orderBy("__hash").limit(bound).agg(F.max("__hash").alias("m")).first()["m"]
    if cut is None:
        return rows.limit(0)
    return hashed.where(F.col("__hash") <= F.lit(cut)).limit(bound).drop("__hash")


def slices(batch: pa.RecordBatch, column: str, chars: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice have about ``chars`` bytes; one longer text is a slice alone."""
    if not batch.num_rows:
        return
    texts = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + batch.num_rows + 1]
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + chars, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


#: Bytes of lower-case text: A-Z as a-z, all others as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: letters, digits and everything outside ASCII.
ALNUM = np.array([48 <= b < 58 or 97 <= b < 123 or 65 <= b < 91 or b >= 128 for b in range(256)])
#: Bytes of words: everything but white space.
SOLID = np.array([b not in (32, 9, 10, 11, 12, 13) for b in range(256)])

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Bytes:
    """The texts of an Arrow column as one byte array: ``data`` and each text's ``bounds`` in it."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        n = len(texts)
        self.bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if offsets else np.zeros(n + 1, np.int64)
        first, last = int(self.bounds[0]), int(self.bounds[-1])
        self.data = np.frombuffer(data, np.uint8)[first:last] if data and last > first else np.zeros(0, np.uint8)
        self.bounds = self.bounds - first


class Words:
    """Words of a column of texts, found on whole byte arrays.

    ``start`` and ``end`` are byte positions, ``of`` the text of each word, ``first`` the first word of each
    text (one more entry at the end), ``hash`` a 64-bit hash of the (lower-cased) word. ``kind`` gives each byte a
    class: 0 separates, and a word is a run of one class.
    """

    def __init__(self, texts: pa.Array, kind: np.ndarray, lower: bool = True) -> None:
        source = Bytes(texts)
        self.bounds = source.bounds
        data = LOWER[source.data] if lower else source.data
        self.data = data
        inside = np.zeros(len(data) + 1, np.uint8)
        inside[:-1] = kind[data]
        before = np.zeros(len(data) + 1, np.uint8)
        before[1:] = inside[:-1]
        change = inside != before
        change[self.bounds] = True
        self.start = np.flatnonzero(change & (inside > 0))
        self.end = np.flatnonzero(change & (before > 0))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=sums[1:])
        back = powers(_INVERSE, len(data) + 1)
        self.hash = mix((sums[self.end] - sums[self.start]) * back[self.start] + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, self.bounds)
        self.of = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.first))

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()
