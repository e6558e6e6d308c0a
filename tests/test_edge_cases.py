"""Cases that the driver tables do not hold: tiny and infinite amounts, missing values, duplicate lookup keys, odd files."""

import pytest
from helpers import metrics, row_sets
from pyspark.sql import functions as F

from rulespan.operators import groups, order, report, rows, tables
from rulespan.sources.tables import load_table, load_tables


def amounts(spark, values):
    return spark.createDataFrame([(i, "g", "part" if i else "total", v) for i, v in enumerate(values)], "id int, k string, kind string, v double")


def test_small_sums_keep_their_digits(spark):
    df = amounts(spark, [4e-7, 1e-7, 1e-7])
    rule = lambda **how: groups.sum_to_total(df, "k", "v", "kind = 'part'", "kind = 'total'", row_id="id", **how)
    assert metrics(rule()).viol_groups == 1
    assert metrics(rule(tol=3e-7)).sat_groups == 1


def test_large_and_infinite_sums(spark):
    df = amounts(spark, [1e30, 5.0])
    assert metrics(groups.sum_to_threshold(df, "k", "v", "<=", 1e31, row_id="id")).sat_groups == 1
    endless = amounts(spark, [float("inf"), 2.0])
    assert metrics(groups.aggregate_constraint(endless, "k", "sum", "agg_value < 5", "v", row_id="id")).viol_groups == 1


def test_exact_sums_by_scale(spark):
    df = amounts(spark, [0.3, 0.1, 0.2])
    exact = groups.sum_to_total(df, "k", "v", "kind = 'part'", "kind = 'total'", row_id="id", scale=2)
    assert metrics(exact).sat_groups == 1


def test_whole_numbers_do_not_overflow(spark):
    df = spark.createDataFrame([(1, "g", 2**62), (2, "g", 2**62)], "id int, k string, v long")
    assert metrics(groups.aggregate_constraint(df, "k", "sum", "agg_value > 0", "v", row_id="id")).sat_groups == 1


def test_a_group_rule_needs_a_key(spark):
    with pytest.raises(ValueError, match="key column"):
        groups.aggregate_constraint(amounts(spark, [1.0]), [], "sum", "agg_value < 5", "v", row_id="id")


def test_row_rule_leaves_out_missing_values_of_its_own_columns(spark):
    df = spark.createDataFrame([(1, 5, 1.0), (2, None, 1.0), (3, 20, float("nan")), (4, 20, 1.0)], "id int, a int, b double")
    found = row_sets(rows.row_rule(df, "a < 10", row_id="id"))
    assert found == {"satisfaction": {1}, "violation": {3, 4}}
    assert row_sets(rows.row_rule(df, "a < 10", "b > 0", row_id="id")) == {"satisfaction": {1}, "violation": {4}}
    # a rule about missing values judges them
    assert row_sets(rows.row_rule(df, "a IS NOT NULL", row_id="id")) == {"satisfaction": {1, 3, 4}, "violation": {2}}
    shared = rows.evaluate_row_rules(df, [rows.RowRule("r", "a < 10")], row_id="id")
    assert shared.metrics.first().applicable_rows == 3


def test_lookup_table_needs_one_row_per_key(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "id int, k string")
    right = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k2 string, v int")
    rule = lambda **how: tables.cross_table_rule(left, right, [("k", "k2")], "v > 0", row_id="id", secondary_cols="v", **how)
    with pytest.raises(Exception, match="several rows for a key"):
        metrics(rule())
    one = tables.cross_table_rule(left, right.where("v > 1"), [("k", "k2")], "v > 2", row_id="id", secondary_cols="v")
    assert metrics(one).applicable_rows == 2 and metrics(one).support == 1.0


def test_role_names(spark):
    df = spark.createDataFrame([(0, "d", 2, 20), (1, "d", 1, 10)], "id int, k string, level int, pay int")
    rule = order.monotonic(df, "k", "level", "pay", row_id="id", roles=("senior", "junior"))
    assert {r.role for r in rule.participants().collect()} == {"senior", "junior"}


def test_drill_down_by_a_composite_row_id(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 1, "b")], "o int, n int, k string")
    rule = lambda d: groups.unique_key(d, "k", row_id=["o", "n"])
    found = report.drill_down(rule, df, "k", ["o", "n"]).collect()
    assert sorted((r.o, r.n) for r in found) == [(1, 1), (1, 2), (2, 1)]


def test_csv_with_line_breaks_flags_and_a_bare_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,flag,note,ok\n1,Y,"two\nlines",true\n2,N,"say ""hi""",false\n3,NA,plain,True\n')
    (tmp_path / "Bare").write_text("id,v\n1,NA\n2,7\n")
    df = load_table(spark, str(tmp_path), "T")
    assert dict(df.dtypes) == {"id": "bigint", "flag": "string", "note": "string", "ok": "boolean"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "Y", "two\nlines", True), (2, "N", 'say "hi"', False), (3, None, "plain", True)]
    bare = load_tables(spark, str(tmp_path), ["Bare", "gone"])
    assert list(bare) == ["Bare"] and [tuple(r) for r in bare["Bare"].orderBy("id").collect()] == [(1, None), (2, 7)]


def test_missing_values_however_a_column_is_written(spark):
    """A condition may write a column in another case, quoted or through the table: its missing values take rows out all the same."""
    df = spark.createDataFrame([(1, 5, 1.0), (2, None, 1.0), (3, 50, None), (4, 7, float("nan"))], "id int, a int, `B b` double")
    for head in ("a < 10", "A < 10", "`A` < 10", df.a < 10, F.col("A") < 10):
        m = rows.row_rule(df, head, row_id="id").metrics.first()
        assert (m.total_rows, m.applicable_rows, m.sat_rows, m.viol_rows) == (4, 3, 2, 1), head
    shared = rows.evaluate_row_rules(df, [rows.RowRule("x", "A < 10", "`b b` > 0")], row_id="id").metrics.first()
    assert (shared.applicable_rows, shared.sat_rows) == (1, 1)
    assert rows.row_rule(df, "A is null", row_id="id").metrics.first().sat_rows == 1
