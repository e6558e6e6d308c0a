"""Rule catalogues: folders of ``rule.json`` files, and lists of rules over two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``check`` is the executable form of a rule (see ``plans.batch``); the rest describes it.
RULE_SCHEMA = (
    "rule_id string, rule string, explanation string, rule_type string, relevant_columns array<string>, check string"
)
MULTI_TABLE_SCHEMA = (
    "rule_definition string, natural_language_explanation string, table1 string, table2 string, "
    "violation_rate double, violation_data_generator string, check string"
)


def load_rules(spark: SparkSession, root: str, file: str = "rule.json") -> DataFrame:
    """All files named ``file`` (a glob) below ``root``, a rule each; the dataset is the first folder below it."""
    files = (
        spark.read.schema(RULE_SCHEMA)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", file)
        .json(root)
    )
    below = F.substring_index(F.col("_metadata.file_path"), f"{root.rstrip('/')}/", -1)
    return files.select("*", F.split(below, "/")[0].alias("dataset"))


def load_multi_table_rules(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of rules over two tables, numbered from 1 in the order of the file.

    The records to inject differ in shape from rule to rule and stay JSON text. A single instruction is
    read as a list of one.
    """
    rules = spark.read.schema(MULTI_TABLE_SCHEMA).option("multiLine", True).json(path)
    one = F.col("violation_data_generator")
    listed = F.when(F.ltrim(one).startswith("{"), F.concat(F.lit("["), one, F.lit("]"))).otherwise(one)
    # A catalogue is a small file read by one task, so the id is the position in it.
    position = (F.monotonically_increasing_id() + 1).cast("string")
    return rules.select(position.alias("rule_id"), "*").withColumn("violation_data_generator", listed)


def pending_rules(rules: DataFrame, results: DataFrame) -> DataFrame:
    """Rules without a result yet; both have dataset and rule_id."""
    return rules.join(results.select("dataset", "rule_id"), ["dataset", "rule_id"], "left_anti")


def split_valid(rules: DataFrame, datasets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules whose dataset exists, rules whose dataset is missing); ``datasets`` has the column dataset."""
    known = datasets.select("dataset")
    return rules.join(known, "dataset", "left_semi"), rules.join(known, "dataset", "left_anti")
