"""Samples and profiles of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespan.functions.prep import FLOATS
from rulespan.model import as_list
from rulespan.operators.quantiles import quantiles_of_counts

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
#: Seed of samples unless another is asked for.
SEED = 42


def sample_rows(df: DataFrame, n: int, row_id: str | Sequence[str], seed: int = SEED) -> DataFrame:
    """A repeatable sample of exactly ``n`` rows, or the table when it has no more.

    Rows are ranked by a digest of seed and row id, so the sample depends neither on partitioning nor on
    the engine. Every task keeps its ``n`` best rows only.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in as_list(row_id)]))
    return df.orderBy(digest, *as_list(row_id)).limit(n)


def head_sample(df: DataFrame, order: str | Sequence[str], n: int = 3) -> DataFrame:
    """The first rows in the given order."""
    return df.orderBy(*as_list(order)).limit(n)


def head_samples(tables: Mapping[str, DataFrame], orders: Mapping[str, str | Sequence[str]], n: int = 3) -> DataFrame:
    """The first rows of every table of a set, as JSON records under the table name."""
    parts = [
        head_sample(df, orders[name], n).select(F.lit(name).alias("table_name"), F.to_json(F.struct("*")).alias("record"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _plain(df: DataFrame, name: str) -> Column:
    """A value that can be grouped by: NaN is missing, nested values are taken as JSON."""
    kind = df.schema[name].dataType
    if isinstance(kind, FLOATS):
        return F.when(~F.isnan(name), F.col(name))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(name)
    return F.col(name)


def value_counts(df: DataFrame, cols: Sequence[str], kind: str = "string", one_pass: bool = False) -> DataFrame:
    """(column_name, value, n) over the columns; a frequent value is folded map-side.

    Every column is grouped on its own, in its own type: a stored table is then read once in all, column
    by column. ``one_pass`` reads ``df`` once row by row instead, for inputs that are dear to compute.
    """
    if one_pass:
        cells = [F.struct(F.lit(c).alias("column_name"), _text(_plain(df, c), df, c).cast(kind).alias("value")) for c in cols]
        return df.select(F.inline(F.array(*cells))).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    parts = [
        df.groupBy(_plain(df, c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit(c).alias("column_name"), F.col("value").cast(kind).alias("value"), "n")
        for c in cols
    ]
    return reduce(DataFrame.unionByName, parts)


def _text(col: Column, df: DataFrame, name: str) -> Column:
    # -0.0 and 0.0 are one value but two texts.
    return col + F.lit(0.0) if isinstance(df.schema[name].dataType, FLOATS) else col


def _types(df: DataFrame, cols: Sequence[str]) -> Column:
    pairs = [F.lit(x) for c in cols for x in (c, df.schema[c].dataType.simpleString())]
    return F.element_at(F.create_map(*pairs), F.col("column_name"))


def column_profile(df: DataFrame, approx: bool = False, one_pass: bool = False) -> DataFrame:
    """Per column: type and number of distinct values, a missing value counting as one."""
    cols = df.columns
    if approx:
        stats = [
            F.struct(
                F.lit(c).alias("column_name"),
                (F.approx_count_distinct(_plain(df, c)) + F.max(_plain(df, c).isNull().cast("long"))).alias("distinct_values"),
            )
            for c in cols
        ]
        counted = df.agg(F.array(*stats).alias("s")).select(F.inline("s"))
    else:
        seen = value_counts(df, cols, one_pass=one_pass)
        counted = seen.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_values"))
    return counted.select("column_name", _types(df, cols).alias("data_type"), "distinct_values")


def describe_all(df: DataFrame, one_pass: bool = False) -> DataFrame:
    """One row per column: count; unique, top and freq of non-numeric columns; mean, std, min, quartiles
    and max of numeric ones. The top value with the smallest text wins a tie."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    other = [c for c in df.columns if c not in numeric]
    moments = []
    for c in df.columns:
        if c in numeric:
            value = _plain(df, c).cast("double")
            stats = [F.count(value), F.avg(value), F.stddev_samp(value), F.min(value), F.max(value)]
        else:
            stats = [F.count(c)] + [F.lit(None).cast("double")] * 4
        names = ["count", "mean", "std", "min", "max"]
        moments.append(F.struct(F.lit(c).alias("column_name"), *[s.alias(n) for s, n in zip(stats, names)]))
    described = df.agg(F.array(*moments).alias("m")).select(F.inline("m"))
    words = {"unique": "bigint", "top": "string", "freq": "bigint"}
    if other:
        tops = (
            value_counts(df, other, one_pass=one_pass).where(F.col("value").isNotNull())
            .groupBy("column_name")
            .agg(
                F.count(F.lit(1)).alias("unique"),
                F.min_by("value", F.struct(-F.col("n"), "value")).alias("top"),
                F.max("n").alias("freq"),
            )
        )
        described = described.join(tops, "column_name", "left")
    else:
        described = described.withColumns({c: F.lit(None).cast(t) for c, t in words.items()})
    if numeric:
        counts = value_counts(df, numeric, "double", one_pass).where(F.col("value").isNotNull())
        counts = counts.withColumnsRenamed({"value": "_v", "n": "_n"})
        quartiles = quantiles_of_counts(counts, ["column_name"], QUARTILES, df.count() * len(numeric))
        described = described.join(quartiles.drop("n"), "column_name", "left")
    else:
        described = described.withColumns({q: F.lit(None).cast("double") for q in QUARTILES})
    return described.select("column_name", "count", *words, "mean", "std", "min", *QUARTILES, "max")


def dataset_summary(df: DataFrame, n: int, row_id: str | Sequence[str], seed: int = SEED) -> DataFrame:
    """A table in brief: its columns with types, and sampled records as JSON."""
    types = ", ".join(f"{name}: {kind}" for name, kind in df.dtypes)
    return sample_rows(df, n, row_id, seed).select(
        F.lit(types).alias("columns"), F.to_json(F.struct("*")).alias("record")
    )
