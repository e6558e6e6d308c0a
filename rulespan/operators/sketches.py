"""Column profiles from mergeable sketches: one scan, a row per column, merged over parts of a table that grows.

Beside the exact ways (``profile.column_profile``, ``profile.describe_all``) this keeps, for each column, the number of rows
and missing values, a sketch of its distinct values, of the quantiles of numbers, and of the most frequent values. Sketches
have a fixed size, so a stored profile of each day's part gives the profile of any span of days without reading the table.

Errors: distinct values have a relative standard error of 1.04 / sqrt(2**DISTINCT_LOG); a quantile is a value whose rank is
within ``RANK_ERROR`` of the wanted one (99 of 100 times); a count of a frequent value is too small by at most
``top_error`` of the rows, and exact while the column has no more than ``TOP_VALUES`` * 3/4 values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespan.operators.profile import QUARTILES, _plain, _types

#: Sizes of the sketches: 2**14 registers, k of the quantile sketch, values tracked as frequent ones.
DISTINCT_LOG, QUANTILE_K, TOP_VALUES = 14, 400, 4_096
#: What the sizes promise: three standard errors of the distinct count, and the rank error of a quantile.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (DISTINCT_LOG / 2), 0.01


def top_error(values: int = TOP_VALUES) -> float:
    """The share of all rows by which the count of a frequent value may be off."""
    return 3.5 / values


def column_sketches(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per value of ``by`` and other column: column_name, data_type, n, missing and the three sketches.

    All columns are sketched in one scan, map-side; what is shuffled is a sketch per column and task. Missing values (NULL and
    NaN) are in ``missing`` only. The columns ``by`` say which part of the table a sketch is of.
    """
    by = list(by)
    cols = [c for c in df.columns if c not in by]
    stats = []
    for c in cols:
        value = _plain(df, c)
        number = isinstance(df.schema[c].dataType, T.NumericType)
        text = (value + F.lit(0.0) if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) else value).cast("string")
        stats.append(F.struct(
            F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n"), F.count_if(value.isNull()).alias("missing"),
            F.hll_sketch_agg(text, F.lit(DISTINCT_LOG)).alias("distinct_sketch"),
            (F.kll_sketch_agg_double(value.cast("double"), QUANTILE_K) if number else F.lit(None).cast("binary")).alias("quantile_sketch"),
            F.call_function("approx_top_k_accumulate", text, F.lit(TOP_VALUES)).alias("top_sketch")))
    folded = df.groupBy(*by).agg(F.array(*stats).alias("s")).select(*by, F.inline("s"))
    return folded.where("n > 0").withColumn("data_type", _types(df, cols))


def merged_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of parts of a table, stored or fresh, as those of the whole: one row per value of ``by`` and column."""
    return sketches.groupBy(*by, "column_name").agg(
        F.any_value("data_type").alias("data_type"), F.sum("n").alias("n"), F.sum("missing").alias("missing"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.when(F.count("quantile_sketch") > 0, F.kll_merge_agg_double("quantile_sketch")).alias("quantile_sketch"),
        F.call_function("approx_top_k_combine", F.col("top_sketch"), F.lit(TOP_VALUES)).alias("top_sketch"))


def approximate_profile(sketches: DataFrame, by: Sequence[str] = (), top: int = 1) -> DataFrame:
    """What the sketches say: n, missing, distinct_values (a missing value counting as one), quartiles and the ``top`` values.

    ``top_values`` are structs of value and count, most frequent first; quartiles are null for columns without numbers.
    """
    known = F.col("n") > F.col("missing")
    distinct = F.when(known, F.hll_sketch_estimate("distinct_sketch")).otherwise(F.lit(0)) + F.when(F.col("missing") > 0, 1).otherwise(0)
    has = known & F.col("quantile_sketch").isNotNull()
    quartiles = {q: F.when(has, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(p))) for q, p in QUARTILES.items()}
    # A missing value takes part in the sketch as one more item.
    listed = F.slice(F.filter(F.call_function("approx_top_k_estimate", F.col("top_sketch"), F.lit(top + 1)), lambda t: t["item"].isNotNull()), 1, top)
    return sketches.select(
        *by, "column_name", "data_type", "n", "missing", distinct.cast("long").alias("distinct_values"), *[c.alias(q) for q, c in quartiles.items()],
        F.transform(listed, lambda t: F.struct(t["item"].alias("value"), t["count"].alias("count"))).alias("top_values"))
