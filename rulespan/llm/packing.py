"""Best-fit packing by minimum bin slack.

Documents become token ids (byte-level BPE and a closing id); longer ones are cut into full pieces, the first piece being
the rest. Packing needs lengths alone: how often each length occurs is a table of at most ``capacity`` rows at any size
of the input, and the plan is made from it. For each sequence the longest remaining length is the seed; bitset
subset-sum dynamic programming over the available lengths (one bit per sum, bounded counts by doubling) finds the fullest
combination with it, which is removed as often as the counts allow. So a plan is a list of patterns with repeats, as
long as the number of lengths, not of pieces. Pieces of a length are numbered in parallel (buckets first, then within
a bucket) and a number names the repeat of the pattern, the sequence and the offset.

Defined cases: a null text is an empty text, one piece of the closing id alone; repeated rows are packed each; rows
with a null id too; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespan.llm.common import id_text, kept_table, slices

CAPACITY = 2048
# Fixed value: the special token of the vocabulary.
SPECIAL = {"<|endoftext|>": 50256}
#: Words a task remembers with their ids, and the longest such word.
CACHE, CACHE_WORD = 400_000, 64
#: Pieces that one bucket of a length should hold.
BUCKET = 200_000
# Beside single spaces, white space next to white space makes tokens that a cut at the space would change.
_ODD_SPACE = re.compile(r"\s \s?| \s|[^\S ]\Z")


class Encoder:
    """Token ids as bytes (little-endian unsigned 32 bit). Splits at single spaces, where no token spans, and remembers words."""

    def __init__(self, ranks: str, pattern: str, special: Mapping[str, int]) -> None:
        import tiktoken

        with open(ranks, "rb") as file:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self._bpe = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens=dict(special))
        self._special = tuple(special)
        self._known: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return np.array(self._bpe.encode_ordinary(text), "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        ids = self._plain(" " + word)
        if len(word) <= CACHE_WORD:
            if len(self._known) >= CACHE:
                self._known.clear()
            self._known[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self._special):
            return np.array(self._bpe.encode(text, allowed_special="all"), "<u4").tobytes()
        if _ODD_SPACE.search(text):
            return self._plain(text)
        head, *words = text.split(" ")
        known, word = self._known.get, self._word
        return self._plain(head) + b"".join([known(w) or word(w) for w in words])


def pieces(
    docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    special: Mapping[str, int] = SPECIAL,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and ids (token ids as bytes) of each piece.

    ``special`` names the strings of the vocabulary that are one id wherever they stand in a text.
    """
    source = id_text(docs, id_col, text_col)
    schema = T.StructType([source.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(ranks, pattern, special)
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                out: list[tuple] = []
                last, ids = None, b""
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if text != last:
                        last, ids = text, encode(text) + b"\0\0\0\0"
                    n = len(ids) // 4
                    start, end = 0, (n - 1) % capacity + 1
                    while start < n:
                        cut = ids[4 * start : 4 * end]
                        out.append((doc_id, -(-start // capacity), start, end - start, zlib.crc32(cut), cut))
                        start, end = end, end + capacity
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (part.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    names=schema.names)

    return source.mapInArrow(run, schema)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of the available lengths with the largest sum within ``room``, long lengths first."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= reach << length * copies & mask
            left -= copies
            copies *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + copies
            at -= length * copies
    return used


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(repeats, length -> how many in a sequence): minimum bin slack with the longest length as the seed."""
    counts = {k: n for k, n in counts.items() if n}
    out = []
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        used = fullest({k: n for k, n in counts.items() if n}, capacity - seed)
        counts[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        repeats = min(counts[k] // n for k, n in used.items())
        out.append((repeats, used))
        for k, n in used.items():
            counts[k] -= repeats * n
        counts = {k: n for k, n in counts.items() if n}
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (pieces, with a length column of 1 to ``capacity``) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return cut.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # Where each length's numbers begin in each pattern: as many rows as the plan has lengths.
    rows, taken, sequence = [], dict.fromkeys(counts, 0), 0
    for repeats, used in plan(counts, capacity):
        offset = 0
        for length in sorted(used, reverse=True):
            rows.append((length, taken[length], used[length], sequence, offset))
            taken[length] += repeats * used[length]
            offset += length * used[length]
        sequence += repeats
    spark = cut.sparkSession
    table = spark.createDataFrame(rows, "length long, first long, each int, sequence long, offset long")
    starts = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "each", "sequence", "offset"))).alias("starts"))
    return _numbered(cut, max(1, -(-sum(counts.values()) // BUCKET))).join(F.broadcast(starts), "length").select(
        *[F.col(c) for c in cut.columns], _place(F.col("starts"), F.col("number")).alias("place")).select(
        *cut.columns, F.col("place.sequence").alias("sequence_id"), F.col("place.offset").alias("offset"))


def _numbered(cut: DataFrame, buckets: int) -> DataFrame:
    """Number the pieces of each length from 0: a length that holds most pieces is dealt over buckets."""
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    return dealt.withColumn("row", F.row_number().over(within)).join(firsts, ["length", "bucket"]).withColumn(
        "number", F.col("first") + F.col("row") - 1)


def _place(starts, number):
    """Sequence and offset of a number: the last pattern that begins at or before it."""
    own = F.element_at(F.filter(starts, lambda s: s["first"] <= number), -1)
    within = number - own["first"]
    # each > 1: neighbours of the same length follow each other in a sequence
    return F.struct((own["sequence"] + F.floor(within / own["each"])).alias("sequence"),
                    (own["offset"] + (within % own["each"]) * F.col("length")).alias("offset"))


def packed(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their place; written once, as lengths are counted before pieces are placed."""
    return pack(kept_table(pieces(docs, ranks, pattern, id_col, text_col, capacity).drop("ids")), capacity)
