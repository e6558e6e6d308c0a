"""Cutting documents into overlapping chunks and counting them per source."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespan.operators.skew import find_hot, join_groups


@dataclass(frozen=True)
class Profile:
    """Chunk size and overlap in characters, and the separators to cut at, best first."""

    size: int
    overlap: int
    separators: tuple[str, ...]

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.size:
            raise ValueError("overlap must be at least 0 and smaller than size")


# The two chunk profiles.
CODE_PROFILE = Profile(1000, 200, ("\n\n", "\n", " ", ""))
DOC_PROFILE = Profile(1500, 300, ("\n## ", "\n### ", "\n#### ", "\n", " ", ""))
PROFILES = {"code": CODE_PROFILE, "doc": DOC_PROFILE}


def profile_name(source_type: Column, description: Column) -> Column:
    """Which profile a source is cut with: by its type, and web sources by their description."""
    documented = F.contains(F.lower(F.coalesce(description, F.lit(""))), F.lit("documentation"))
    return (
        F.when(source_type == "documentation", F.lit("doc"))
        .when((source_type == "web") & documented, F.lit("doc"))
        .otherwise(F.lit("code"))
    )


def enabled(sources: DataFrame) -> DataFrame:
    """Sources that are switched on; a source that does not say so is."""
    return sources.where(F.coalesce("enabled", F.lit(True)))


def chunk_fixed(
    df: DataFrame, text: str, size: Column | int = CODE_PROFILE.size, overlap: Column | int = CODE_PROFILE.overlap
) -> DataFrame:
    """Chunks at a fixed stride, whatever the text looks like; together they cover all of it."""
    size, overlap = (x if isinstance(x, Column) else F.lit(x) for x in (size, overlap))
    length, stride = F.char_length(text), size - overlap
    count = F.ceil(F.greatest(length - overlap, F.lit(1)) / stride).cast("int")
    numbered = df.where(length > 0).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), count - 1)))
    return numbered.withColumn("chunk", F.substr(text, F.col("chunk_no") * stride + 1, size))


def _bounds(text: str, separator: str, start: int, end: int) -> array:
    """Where the pieces of a part of a text begin, and its end: each separator opens a piece."""
    bounds = array("q", [start])
    bounds.extend(m.start() for m in re.compile(re.escape(separator)).finditer(text, start, end) if m.start() > start)
    bounds.append(end)
    return bounds


def _packed(bounds: Sequence[int], first: int, last: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Fill chunks with the pieces ``first`` to ``last``; each new chunk opens with pieces of the last one, up to ``overlap``."""
    low = first
    for i in range(first, last):
        if i > low and bounds[i + 1] - bounds[low] > size:
            yield bounds[low], bounds[i]
            while low < i and (bounds[i] - bounds[low] > overlap or bounds[i + 1] - bounds[low] > size):
                low += 1
    if last > low:
        yield bounds[low], bounds[last]


def split_spans(text: str, profile: Profile, start: int = 0, end: int | None = None, level: int = 0) -> Iterator[tuple[int, int]]:
    """(start, end) of the chunks of a text: cut at the best separator that occurs, and pieces still too long at the next.

    Pieces are places in the text, eight bytes each; the empty separator, which cuts between any two characters, needs none.
    """
    separators, size = profile.separators, profile.size
    end = len(text) if end is None else end
    while level < len(separators) - 1 and text.find(separators[level], start, end) < 0:
        level += 1
    if not separators[level]:
        while end - start > size:
            yield start, start + size
            start += size - profile.overlap
        if end > start:
            yield start, end
        return
    bounds = _bounds(text, separators[level], start, end)
    first = 0
    for i in range(len(bounds) - 1):
        if bounds[i + 1] - bounds[i] < size:
            continue
        yield from _packed(bounds, first, i, size, profile.overlap)
        first = i + 1
        if level + 1 < len(separators):
            yield from split_spans(text, profile, bounds[i], bounds[i + 1], level + 1)
        else:
            yield bounds[i], bounds[i + 1]
    yield from _packed(bounds, first, len(bounds) - 1, size, profile.overlap)


def split_text(text: str, profile: Profile) -> Iterator[str]:
    """The chunks of one text."""
    return (text[a:b] for a, b in split_spans(text, profile))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split_column(text: pd.Series, profile: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if t is None else [c for c in map(str.strip, split_text(t, PROFILES[p])) if c]
            for t, p in zip(text, profile)
        ],
        index=text.index,
    )


def chunk_separators(df: DataFrame, text: str, profile: Column | str = "code") -> DataFrame:
    """Chunks cut at separators; ``profile`` names one of ``PROFILES``, per row if it is a column."""
    name = F.lit(profile) if isinstance(profile, str) else profile
    return df.select("*", F.posexplode(_split_column(F.col(text), name)).alias("chunk_no", "chunk"))


def tag_source(df: DataFrame, sources: DataFrame, on: str = "source") -> DataFrame:
    """Documents, or chunks of them, with the type and description of their source.

    ``sources`` has one row per source; rows of unknown sources are left out. Tag before cutting: there are
    fewer documents than chunks.
    """
    known = sources.select(on, "source_type", "description")
    return join_groups(df, known, [on], find_hot(df, [on]), F.struct(*[c for c in df.columns if c != on]))


def source_counts(chunks: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    return chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("chunks"))
