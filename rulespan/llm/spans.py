"""Spans of several kinds in a text: joining, digesting and running a finder over Arrow batches."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rulespan.llm.common import id_text, slices

Span = tuple[str, int, int]


def joined(spans: Iterable[Span], order: dict[str, int]) -> str:
    """kind:start:end by start, then kind, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))


def taken(spans: Iterable[Span]) -> list[tuple[int, int]]:
    """The places that spans cover, as ranges by start that don't touch each other."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s, e) for _, s, e in spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def outside(span: Span, ranges: list[tuple[int, int]], least: int = 1) -> Iterator[Span]:
    """The parts of a span that lie in no range, of at least ``least`` characters. ``ranges`` as ``taken`` gives them."""
    kind, at, end = span
    i = bisect_left(ranges, at, key=lambda r: r[1])
    while i < len(ranges) and ranges[i][0] < end:
        if ranges[i][0] - at >= least:
            yield kind, at, ranges[i][0]
        at = max(at, ranges[i][1])
        i += 1
    if end - at >= least:
        yield kind, at, end


def clear(span: Span, ranges: list[tuple[int, int]]) -> bool:
    """Whether a span touches no range."""
    return next(outside(span, ranges), None) == span


def scan_spans(
    docs: DataFrame, id_col: str, text_col: str, kinds: tuple[str, ...],
    find: Callable[[list[str]], Iterator[tuple[list[Span], list[Span]]]], chunk: int = 4 << 20, own_kinds: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, base and added spans as arrays, for every row; ``find`` gets the texts of a few megabytes at a time.

    Counts are those of base spans; of ``own_kinds``, which have none, those of added ones.
    """
    source = id_text(docs, id_col, text_col)
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                     T.StructField("end", T.IntegerType())]))
    schema = T.StructType([source.schema["doc_id"], T.StructField("base", span), T.StructField("added", span),
                           *[T.StructField(f"n_{k}", T.LongType()) for k in kinds],
                           T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    order = {k: i for i, k in enumerate(kinds)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for part in slices(batch, 1, chunk):
                found = list(find(part.column(1).to_pylist()))
                rows = lambda i: pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in f[i]] for f in found], struct)  # noqa: E731, B023
                counts = [pa.array([sum(s[0] == k for s in f[k in own_kinds]) for f in found], pa.int64()) for k in kinds]
                digests = [hashlib.sha256(joined(f[0], order).encode()).hexdigest() for f in found]
                texts = [joined([*f[0], *f[1]], order) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), rows(0), rows(1), *counts, pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                    names=schema.names)

    return source.mapInArrow(run, schema)
