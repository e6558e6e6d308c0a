"""The small tables with known results."""

import pytest
from helpers import group_roles, metrics, row_sets

from rulespan.operators import groups, order, rows
from rulespan.operators.metrics import metrics_of, participant_ids, nest
from rulespan.model import KEY_TYPE


@pytest.fixture
def ab(spark):
    return spark.createDataFrame([(0, 15, 2), (1, 5, 10), (2, 20, 7), (3, 8, 3), (4, 12, 4)], "row int, a int, b int")


def test_conditional_row_rule(ab):
    result = rows.row_rule(ab, "b < 5", "a > 10", row_id="row", cols=["a", "b"])
    m = metrics(result)
    assert (m.support, m.applicable_rows, m.total_rows) == (0.6, 3, 5)
    assert m.confidence == pytest.approx(2 / 3)
    assert row_sets(result) == {"satisfaction": {0, 4}, "violation": {2}}


def test_support_of_satisfied_rows(ab):
    result = rows.row_rule(ab, "b < 5", "a > 10", row_id="row", support_mode="satisfied")
    assert metrics(result).support == 0.4


def test_body_never_true(ab):
    m = metrics(rows.row_rule(ab, "b < 5", "a > 100", row_id="row"))
    assert (m.support, m.confidence, m.violation_rate) == (0.0, 1.0, 0.0)


def test_unconditional_rule_judges_every_row(ab):
    result = rows.row_rule(ab, "b < 5", row_id="row")
    assert metrics(result).support == 1.0
    assert row_sets(result) == {"satisfaction": {0, 3, 4}, "violation": {1, 2}}


@pytest.fixture
def managers(spark):
    data = [(0, "Sales", "Smith"), (1, "Engineering", "Johnson"), (2, "Sales", "Smith"), (3, "Engineering", "Wilson"), (4, "Marketing", "Davis")]
    return spark.createDataFrame(data, "row int, Department string, Manager string")


FD_GROUPS = {
    ("satisfaction", (("Department", "Sales"),)): {(("Manager", "Smith"),): [0, 2]},
    ("satisfaction", (("Department", "Marketing"),)): {(("Manager", "Davis"),): [4]},
    ("violation", (("Department", "Engineering"),)): {(("Manager", "Johnson"),): [1], (("Manager", "Wilson"),): [3]},
}


def test_functional_dependency(managers):
    result = groups.functional_dependency(managers, "Department", "Manager", row_id="row")
    m = metrics(result)
    assert m.support == 1.0
    assert m.confidence == pytest.approx(2 / 3)
    assert group_roles(result) == FD_GROUPS


def test_nulls_are_in_neither_set(spark, managers):
    more = managers.unionByName(spark.createDataFrame([(5, "Sales", None)], managers.schema))
    result = groups.functional_dependency(more, "Department", "Manager", row_id="row")
    m = metrics(result)
    assert m.support == pytest.approx(5 / 6)
    assert m.confidence == pytest.approx(2 / 3)
    assert group_roles(result) == FD_GROUPS


def test_unique_key(spark):
    data = [(0, 101, 1), (1, 102, 2), (2, 101, 2), (3, 103, 1), (4, 102, 2)]
    df = spark.createDataFrame(data, "row int, ProductID int, StoreID int")
    result = groups.unique_key(df, ["ProductID", "StoreID"], row_id="row")
    m = metrics(result)
    assert (m.support, m.confidence) == (1.0, 0.75)
    roles = group_roles(result)
    assert roles["violation", (("ProductID", "102"), ("StoreID", "2"))] == {"duplicates": [1, 4]}
    assert sorted(r["unique_record"][0] for (v, _), r in roles.items() if v == "satisfaction") == [0, 2, 3]


def key(*pairs):
    return list(pairs)


def test_group_metrics_from_participants(spark):
    def part(verdict, project, name, role, ids):
        return [(verdict, [("project_group", project), ("project_name", name)], "0", role, i) for i in ids]

    rows_ = (
        part("violation", "technique", "DeepClean", "sum", [1, 6, 9]) + part("violation", "technique", "DeepClean", "compare", [11])
        + part("violation", "engineering", "FastTrac", "sum", [11, 16, 29]) + part("violation", "engineering", "FastTrac", "compare", [33])
        + part("satisfaction", "marketing", "AdBoost", "sum", [7, 14, 18]) + part("satisfaction", "marketing", "AdBoost", "compare", [20])
    )
    participants = spark.createDataFrame(rows_, f"verdict string, group_key {KEY_TYPE}, rep_id string, role string, row_id int")
    m = metrics_of(participants, 100, "sum").first()
    assert m.confidence == pytest.approx(1 / 3)
    assert (m.support, m.applicable_rows) == (0.11, 11)


def test_sum_to_total(spark):
    data = [
        (0, "m", "A", "sub-part", 10.0), (1, "m", "A", "sub-part", 20.0), (2, "m", "A", "total", 30.0),
        (3, "t", "D", "sub-part", 5.0), (4, "t", "D", "sub-part", 6.0), (5, "t", "D", "total", 12.0),
    ]
    df = spark.createDataFrame(data, "row int, g string, n string, kind string, amount double")
    result = groups.sum_to_total(df, ["g", "n"], "amount", "kind = 'sub-part'", "kind = 'total'", row_id="row")
    m = metrics(result)
    assert (m.support, m.confidence) == (1.0, 0.5)
    roles = group_roles(result)
    assert roles["satisfaction", (("g", "m"), ("n", "A"))] == {"sum": [0, 1], "compare": [2]}
    assert roles["violation", (("g", "t"), ("n", "D"))] == {"sum": [3, 4], "compare": [5]}


def test_monotonic(spark):
    df = spark.createDataFrame([(0, "x", 2, 200.0), (1, "x", 1, 100.0), (2, "y", 2, 100.0), (3, "y", 1, 100.0)], "row int, d string, p int, s double")
    result = order.monotonic(df, "d", "p", "s", row_id="row")
    m = metrics(result)
    assert (m.support, m.confidence) == (1.0, 0.5)
    assert group_roles(result) == {
        ("satisfaction", (("d", "x"),)): {order.HIGHER: [0], order.LOWER: [1]},
        ("violation", (("d", "y"),)): {order.HIGHER: [2], order.LOWER: [3]},
    }


def test_monotonic_leaves_groups_without_comparison_out(spark):
    df = spark.createDataFrame([(0, "x", 1, 1.0), (1, "x", 1, 2.0)], "row int, d string, p int, s double")
    result = order.monotonic(df, "d", "p", "s", row_id="row")
    m = metrics(result)
    assert (m.support, m.confidence) == (0.0, 1.0)
    assert result.participants().count() == 0


def test_sum_to_threshold_with_windows(spark):
    data = [
        (0, "s", "J", "2024-01-01", 50000.0), (1, "s", "J", "2024-02-01", 40000.0), (2, "s", "J", "2024-03-01", 20000.0),
        (3, "s", "J", "2024-04-01", 10000.0), (4, "h", "K", "2024-01-01", 30000.0),
    ]
    df = spark.createDataFrame(data, "row int, team string, name string, m string, salary double").selectExpr("*", "to_date(m) as month")
    result = groups.sum_to_threshold(df, ["team", "name"], "salary", "<=", 100000, window=("month", "quarter"), row_id="row")
    m = metrics(result)
    assert m.support == 1.0
    assert m.confidence == pytest.approx(2 / 3)
    assert row_sets(result) == {"violation": {0, 1, 2}, "satisfaction": {3, 4}}
    strict = groups.sum_to_threshold(
        df, ["team", "name"], "salary", "<=", 100000, window=("month", "quarter"), row_id="row", group_verdict="any_violation")
    assert metrics(strict).confidence == 0.5


@pytest.mark.parametrize("data", [[], [(0, None, None), (1, None, None)]])
def test_empty_and_all_null_tables(spark, data):
    df = spark.createDataFrame(data, "row int, k string, v double")
    for result in (
        rows.row_rule(df, "v > 1", row_id="row", cols=["v"]),
        groups.unique_key(df, "k", row_id="row"),
        groups.functional_dependency(df, "k", "v", row_id="row"),
        groups.sum_to_total(df, "k", "v", "v > 1", "v <= 1", row_id="row"),
        groups.sum_to_threshold(df, "k", "v", "<=", 1, row_id="row"),
        groups.aggregate_constraint(df, "k", "sum", "agg_value > 1", "v", row_id="row"),
        order.monotonic(df, "k", "v", "v", row_id="row"),
        order.sequence_rule(df, "k", "row", lambda a, b: a["v"] < b["v"], "v", row_id="row"),
    ):
        m = metrics(result)
        assert (m.total_rows, m.support, m.confidence, m.violation_rate) == (len(data), 0.0, 1.0, 0.0)
        assert result.participants().count() == 0


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "a", float("nan")), (2, "a", 1.0)], "row int, k string, v double")
    result = groups.functional_dependency(df, "k", "v", row_id="row")
    assert row_sets(result) == {"satisfaction": {0, 2}}
    assert metrics(rows.not_null_rule(df, "v", row_id="row")).viol_rows == 1


def test_nested_pages_keep_every_row(spark):
    df = spark.range(500).selectExpr("id as row", "'a' as k", "id % 2 as v")
    result = groups.functional_dependency(df, "k", "v", row_id="row")
    nested = nest(result.participants(), page_rows=40)
    largest = nested.selectExpr("max(aggregate(representations, 0, (m, r) -> greatest(m, size(r.rows))))").first()[0]
    assert largest < 200
    assert participant_ids(nested).count() == 500
    one = nest(result.participants())
    assert [(len(r.representations), r.page) for r in one.collect()] == [(2, 0)]


def test_real_column_names_with_odd_characters(spark):
    data = [(0, "212", "NY", "x'y"), (1, "212", "NJ", "x'y"), (2, "305", "FL", "z")]
    df = spark.createDataFrame(data, "row int, `AreaCode(String)` string, `State name` string, `it's` string")
    result = groups.functional_dependency(df, "AreaCode(String)", "State name", row_id="row", rule_id="it's a \\ rule")
    assert row_sets(result) == {"violation": {0, 1}, "satisfaction": {2}}
    assert metrics(result).rule_id == "it's a \\ rule"
    keyed = groups.unique_key(df, ["it's", "AreaCode(String)"], row_id="row")
    assert group_roles(keyed)["violation", (("it's", "x'y"), ("AreaCode(String)", "212"))] == {"duplicates": [0, 1]}


def test_unknown_body_leaves_a_row_out(spark):
    df = spark.createDataFrame([(0, 1, None), (1, 1, 5), (2, 1, 50)], "row int, a int, b int")
    assert row_sets(rows.row_rule(df, "a = 1", "b > 10", row_id="row")) == {"satisfaction": {2}}
    result = groups.unique_key(df, "a", body="b > 1", row_id="row")
    m = metrics(result)
    assert (m.total_rows, m.applicable_rows, m.viol_groups) == (3, 2, 1)
    assert row_sets(result) == {"violation": {1, 2}}
