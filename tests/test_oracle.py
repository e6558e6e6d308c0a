"""Every registered query against its SQL, plainly and with all larger groups treated as hot."""

import __spark_entry__ as registered
import pytest
from conftest import DATA
from oracle import connect, duck_table, spark_table

from rulespan.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


def same(got, want):
    columns, rows = got
    assert columns == want[0]
    assert len(rows) == len(want[1])
    for a, b in zip(rows, want[1]):
        assert a == pytest.approx(b, abs=1e-6) if all(isinstance(x, (int, float)) for x in (*a, *b)) else a == b


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    same(spark_table(QUERIES[name](spark, DATA)), duck_table(con, SQL[name]))


GROUPED = [
    "unique_key_rows", "fd", "fd_rows", "sum_to_total_rows", "sum_to_threshold_rows", "monotonic", "monotonic_rows",
    "sequence_rule", "sequence_rule_rows", "outlier_iqr", "outlier_iqr_rows", "outlier_zscore_rows", "pair_rule_rows",
    "references_rows", "cross_table", "cross_table_rows", "cross_any_rows", "pandas_group_rule", "pandas_group_rule_rows",
    "nested", "describe_all", "describe_all_nulls", "ema", "source_counts",
]


@pytest.mark.parametrize("name", GROUPED)
def test_query_with_hot_groups(spark, con, hot, name):
    same(spark_table(QUERIES[name](spark, DATA)), duck_table(con, SQL[name]))


def test_entry(spark):
    assert registered.entry(spark).count() == 1


def test_all_queries_have_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(registered.queries()) and set(SQL) <= set(registered.oracle_sql())
