"""What the physical plans must look like."""

import re

import __spark_entry__ as registered
import pytest
from conftest import DATA

from rulespan.operators import groups, rows, tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_no_cross_joins(spark, name):
    text = plan(registered.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def schemas(text):
    return set(re.findall(r"ReadSchema: struct<([^>]*)>", text))


def test_metrics_read_only_the_columns_of_the_rule(spark):
    part = spark.read.parquet(f"{DATA}/part.parquet")
    result = groups.functional_dependency(part, ["p_name", "p_brand"], "p_type", row_id="p_partkey")
    assert schemas(plan(result.metrics)) == {"p_name:string,p_brand:string,p_type:string"}
    assert plan(result.metrics).count("FileScan parquet") == 1


def test_many_row_rules_share_one_scan(spark):
    part = spark.read.parquet(f"{DATA}/part.parquet")
    rules = [rows.RowRule(f"r{i}", f"p_size > {i}") for i in range(20)]
    text = plan(rows.evaluate_row_rules(part, rules, row_id="p_partkey").metrics)
    assert text.count("FileScan parquet") == 1


def test_body_reaches_the_scan(spark):
    part = spark.read.parquet(f"{DATA}/part.parquet")
    result = groups.unique_key(part, "p_name", body="p_size > 40", row_id="p_partkey")
    assert "GreaterThan(p_size,40)" in plan(result.violations())


def test_foreign_keys_are_counted_before_the_join(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    supplier = spark.read.parquet(f"{DATA}/supplier.parquet")
    text = plan(tables.references(events, "user_id", supplier, "s_suppkey", row_id="event_id").metrics)
    join = text.index("Join")
    assert text.index("FileScan parquet") > join
    assert "partial_count" in text[join:]
