"""Reading and writing tables."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cell texts that mean "missing" in a CSV file.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def load_table(
    spark: SparkSession,
    folder: str,
    name: str,
    fmt: str = "csv",
    na_values: Sequence[str] = NA_TOKENS,
    schema: str | T.StructType | None = None,
    multi_line: bool = True,
    store: str | None = None,
) -> DataFrame:
    """A table by name; the file is the lower-cased name with the format as suffix.

    A quoted CSV cell may hold line breaks. That keeps a file in one task; ``multi_line=False`` splits large files
    whose cells are known to hold none. With ``store``, a new folder, the files are parsed once: their cells are written there
    as Parquet, dealt over tasks, and types are inferred and rules run from that. Deliver large tables as many files.

    CSV cells among ``na_values`` are NULL. Column types come from ``schema``; without one they are
    inferred in a pass of their own, after the NA texts are gone, so they do not turn numbers into text.
    """
    return _read(spark, os.path.join(folder, f"{name.lower()}.{fmt}"), fmt, na_values, schema, multi_line, store)


def _read(
    spark: SparkSession, path: str, fmt: str, na_values: Sequence[str], schema: str | T.StructType | None, multi_line: bool,
    store: str | None = None,
) -> DataFrame:
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    options = {"header": True, "multiLine": multi_line, "escape": '"'}
    text = spark.read.options(**options).csv(path)
    text = text.select([F.when(~F.col(f"`{c}`").isin(*na_values), F.col(f"`{c}`")).alias(c) for c in text.columns])
    if store is not None:
        text.repartition(spark.sparkContext.defaultParallelism).write.parquet(store)
        text = spark.read.parquet(store)
    target = schema if schema is not None else _inferred(text)
    if isinstance(target, str):
        target = T._parse_datatype_string(target)
    return text.select([F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in target.fields])


def _inferred(text: DataFrame) -> T.StructType:
    """The narrowest of bigint, double, boolean, timestamp that every present cell of a column fits.

    Only the words true and false make a boolean: Y, N, t or f stay the texts they are.
    """
    kinds = ["bigint", "double", "boolean", "timestamp"]
    bad = []
    for i, c in enumerate(text.columns):
        col = F.col(f"`{c}`")
        fits = {k: col.try_cast(k).isNotNull() for k in kinds} | {"boolean": F.lower(col).isin("true", "false")}
        bad += [F.count_if(col.isNotNull() & ~fits[k]).alias(f"{i}_{k}") for k in kinds]
    row = text.agg(*bad).first()
    fields = []
    for i, c in enumerate(text.columns):
        kind = next((k for k in kinds if row[f"{i}_{k}"] == 0), "string")
        fields.append(T.StructField(c, T._parse_datatype_string(kind)))
    return T.StructType(fields)


def load_tables(
    spark: SparkSession, folder: str, names: Sequence[str], fmt: str = "csv", na_values: Sequence[str] = NA_TOKENS,
    schema: str | T.StructType | None = None, multi_line: bool = True,
) -> dict[str, DataFrame]:
    """A table set; each table is read once, as ``<name>.<fmt>`` or else as ``<name>``.

    Tables that cannot be found are left out of the set, so a caller sees which rules it can run.
    """
    tables: dict[str, DataFrame] = {}
    for name in dict.fromkeys(names):
        try:
            tables[name] = load_table(spark, folder, name, fmt, na_values, schema, multi_line)
        except AnalysisException:
            try:
                tables[name] = _read(spark, os.path.join(folder, name), fmt, na_values, schema, multi_line)
            except AnalysisException:
                continue
    return tables


def register(tables: Mapping[str, DataFrame]) -> None:
    """Make a table set available to SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows of files without a key, in reading order, starting at 0.

    ``df`` is a plain read, whose partitions are the same in every plan: rows are counted per partition
    first, and a row's number is the rows of the partitions before it plus its place in its own. Write the
    result before using it in several plans.
    """
    if name in df.columns:
        raise ValueError(f"the table already has a column {name}")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = df.withColumns({"_partition": F.spark_partition_id(), "_place": place})
    counts = placed.groupBy("_partition").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_partition").rowsBetween(Window.unboundedPreceding, -1)
    # One row per input partition.
    offsets = counts.select("_partition", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    numbered = placed.join(offsets, "_partition").withColumn(name, F.col("_offset") + F.col("_place"))
    return numbered.select(name, *df.columns)


def with_file_position(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Identify rows of parquet files by file and position, without a pass over the data."""
    position = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return df.withColumn(name, position)


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write a table without row numbers; CSV gets a header."""
    writer = df.write.mode(mode).format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
