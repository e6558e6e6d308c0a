"""A third of the rows in one group: the split paths must give what the plain ones give."""

from collections import defaultdict

import pytest
from helpers import metrics, row_sets, skewed
from pyspark.sql import functions as F

from rulespan.operators import custom, groups, order, outliers, pairs, tables
from rulespan.operators.quantiles import exact_quantiles
from rulespan.operators.skew import find_hot, join_groups, running


def test_hot_groups_are_measured(spark, hot):
    df = skewed(spark)
    found = find_hot(df, ["k"])
    assert {r.k: r["_parts"] for r in found.table.collect()}["hot"] == 40
    assert find_hot(df, ["row_id"]) is None
    assert find_hot(df, ["k"], upper=25) is None


def test_running_equals_a_plain_scan(spark, hot):
    df = skewed(spark)
    found = running(
        df, ["k"], ["t"],
        {"total": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v"), "prev": ("previous", "v"), "next": ("next", "v")},
        find_hot(df, ["k"]),
    ).collect()
    back = running(df, ["k"], ["t"], {"total": ("sum", "v")}, find_hot(df, ["k"]), descending=True)
    back = {r.row_id: r.total for r in back.collect()}
    by_key = defaultdict(list)
    for r in found:
        by_key[r.k].append(r)
    assert len(found) == 3000
    for part in by_key.values():
        part.sort(key=lambda r: r.t)
        values = [r.v for r in part]
        for i, r in enumerate(part):
            before = values[:i]
            assert r.total == sum(before)
            assert r.low == (min(before) if before else None)
            assert r.high == (max(before) if before else None)
            assert r.prev == (before[-1] if before else None)
            assert r.next == (values[i + 1] if i + 1 < len(values) else None)
            assert back[r.row_id] == sum(values[i + 1:])


def test_a_hot_key_is_spread_over_tasks(spark, hot):
    df = skewed(spark)
    sizes = df.groupBy("k").agg(F.count("*").alias("n"))
    joined = join_groups(df, sizes, ["k"], find_hot(df, ["k"]), F.col("row_id"))
    assert joined.count() == 3000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = join_groups(df, sizes, ["k"], find_hot(df, ["k"]), F.col("row_id"))
        tasks = joined.where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert tasks == 4


OPERATORS = {
    "unique_key": lambda df: groups.unique_key(df, "k", row_id="row_id"),
    "fd": lambda df: groups.functional_dependency(df, "k", "v", row_id="row_id"),
    "aggregate": lambda df: groups.aggregate_constraint(df, "k", "max", "agg_value > 1000", "v", row_id="row_id"),
    "threshold": lambda df: groups.sum_to_threshold(df, "k", "v", "<=", 12000, row_id="row_id"),
    "monotonic": lambda df: order.monotonic(df, "k", "t", "v", row_id="row_id"),
    "sequence": lambda df: order.sequence_rule(df, "k", "t", lambda a, b: a["v"] < b["v"], "v", row_id="row_id"),
    "iqr": lambda df: outliers.outlier(df, "k", "v", "iqr", 0.3, row_id="row_id"),
    "zscore": lambda df: outliers.outlier(df, "k", "v", "zscore", 1.5, row_id="row_id"),
    "pairs": lambda df: pairs.pair_rule(df, "k", "v", row_id="row_id"),
    "references": lambda df: tables.references(df, "v", df.where("v % 2 = 0"), "v", row_id="row_id"),
    "pandas": lambda df: custom.pandas_group_rule(
        df, "k", ["v"], lambda p: {"s": int(p["v"].sum())}, lambda s: {"s": int(s["s"].sum())}, lambda s: s["s"] > 13000,
        "s long", row_id="row_id"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_hot_and_plain_paths_agree(spark, name):
    df = skewed(spark)
    build = OPERATORS[name]

    def outcome():
        result = build(df)
        return metrics(result), row_sets(result)

    plain = outcome()
    spark.conf.set("rulespan.hotGroupRows", "25")
    try:
        split = outcome()
    finally:
        spark.conf.unset("rulespan.hotGroupRows")
    assert plain == split
    assert plain[0].total_rows == 3000


def test_quantiles_are_exact(spark, hot):
    df = skewed(spark)
    want = {
        r.k: r for r in df.groupBy("k").agg(
            F.expr("percentile(v, 0.25)").alias("a"), F.expr("percentile(v, 0.9)").alias("b"), F.count("*").alias("n")).collect()
    }
    for r in exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.9}, 3000).collect():
        assert (r.a, r.b, r.n) == (pytest.approx(want[r.k].a), pytest.approx(want[r.k].b), want[r.k].n)


def test_monotonic_equals_all_pairs(spark, hot):
    df = skewed(spark, 600)
    rows = df.collect()
    sat, viol = set(), set()
    for a in rows:
        for b in rows:
            if a.k == b.k and a.t > b.t:
                (sat if a.v > b.v else viol).update((a.row_id, b.row_id))
    assert row_sets(order.monotonic(df, "k", "t", "v", row_id="row_id")) == {"satisfaction": sat, "violation": viol}


def test_pair_counts_equal_all_pairs(spark):
    df = skewed(spark, 600).withColumn("v", F.col("v") % 3)
    rows = df.collect()
    same = [a.v == b.v for a in rows for b in rows if a.k == b.k and a.row_id < b.row_id]
    m = metrics(pairs.pair_rule(df, "k", "v", row_id="row_id"))
    assert (int(m.sat_groups), int(m.viol_groups)) == (sum(same), len(same) - sum(same))
