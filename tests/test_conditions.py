"""Conditions on two rows: of one table (pair rules, monotonic links) and of two tables (any and all), against plain loops."""

import itertools
import operator

import pytest
from helpers import metrics, skewed
from pyspark.sql import functions as F

from rulespan.operators import order, pairs, tables

OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "=": operator.eq, "!=": operator.ne}


def holds(op, a, b, tol=0):
    return b - tol <= a <= b + tol if op == "within" else OPS[op](a, b)


def expected_pairs(rows, test):
    """(pairs satisfied, violated, {(verdict, role, row id)}) of rows (row_id, k, v, t) in order of their id."""
    sides, counts = set(), [0, 0]
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (str(r[1]), r[0])), key=lambda r: r[1]):
        for a, b in itertools.combinations(list(group), 2):
            ok = test(a, b)
            counts[not ok] += 1
            verdict = "satisfaction" if ok else "violation"
            sides |= {(verdict, "earlier", a[0]), (verdict, "later", b[0])}
    return counts, sides


@pytest.mark.parametrize("head", [
    pairs.Compare("v", "<="), pairs.Compare("v", "=", "t"), pairs.Compare("v", "!="), pairs.Compare("t", "within", "v", 300), pairs.Compare("v", ">", "t"),
], ids=str)
def test_pair_heads_in_a_hot_group(spark, head):
    df = skewed(spark, 400).withColumn("t", F.col("t") % 1000)
    rows = [tuple(r) for r in df.collect()]
    at = {"v": 2, "t": 3}
    counts, sides = expected_pairs(rows, lambda a, b: holds(head.op, a[at[head.left]], b[at[head.right or head.left]], head.tol))
    rule = pairs.pair_rule(df.repartition(5), "k", head=head, row_id="row_id")
    m = metrics(rule)
    assert [int(m.sat_groups), int(m.viol_groups)] == counts
    assert {tuple(r) for r in rule.participants().select("verdict", "role", "row_id").collect()} == sides
    assert {tuple(r) for r in rule.violations().select("role", "row_id").collect()} == {s[1:] for s in sides if s[0] == "violation"}
    assert m.applicable_rows == len({s[2] for s in sides}) and m.total_rows == len(rows)


def test_pair_heads_with_nulls_ties_and_odd_types(spark):
    rows = [(1, "a", 1.0, "x"), (2, "a", None, "y"), (3, "a", float("nan"), "z"), (4, "a", 2.0, "x"), (7, "a", 3.0, "q"), (5, None, 1.0, "x"), (6, "b", 1.0, "only")]
    df = spark.createDataFrame(rows, "id long, k string, v double, s string")
    placed = df.withColumn("place", F.least("id", F.lit(4)))
    m = metrics(pairs.pair_rule(placed, "k", head=pairs.Compare("v", "<"), row_id="id", order="place"))
    # rows of the same place in the order make no pair
    assert (m.total_rows, int(m.sat_groups), int(m.viol_groups)) == (7, 2, 0)
    by_text = pairs.pair_rule(df, "k", head={"left": "s", "op": "="}, row_id="id", order=["v", "s"], body="v < 3")
    assert (int(metrics(by_text).sat_groups), int(metrics(by_text).viol_groups)) == (1, 0)
    empty = metrics(pairs.pair_rule(df.limit(0), "k", head=pairs.Compare("v", "<"), row_id="id"))
    assert (empty.total_rows, empty.support, empty.confidence) == (0, 0.0, 1.0)
    with pytest.raises(ValueError):
        pairs.pair_rule(df, "k", row_id="id")
    with pytest.raises(ValueError):
        pairs.Compare("v", "~")


def two_tables(spark):
    left = [(1, 1, 5), (2, 1, 20), (3, 2, 5), (4, 3, 5), (5, None, 5), (6, 2, None), (7, 4, 7)]
    right = [(1, 4, 6), (1, 10, 12), (1, 1, 30), (2, 6, 9), (2, 5, None), (4, 7, 7), (4, 7, 7), (None, 5, 9), (4, 9, 3)]
    return spark.createDataFrame(left, "id int, k int, p int"), spark.createDataFrame(right, "fk int, lo int, hi int"), left, right


def verdicts(left, right, quantifier, test):
    out = {}
    for i, k, p in left:
        if k is not None and p is not None:
            found = [bool(test(p, lo, hi)) for fk, lo, hi in right if fk == k]
            out[i] = any(found) if quantifier == "any" else all(found)
    return out


def judged(rule):
    m = metrics(rule)
    got = {r.row_id: r.verdict == "satisfaction" for r in rule.participants().select("verdict", "row_id").collect()}
    assert (m.applicable_rows, m.sat_rows, m.viol_rows) == (len(got), sum(got.values()), len(got) - sum(got.values()))
    return got


@pytest.mark.parametrize("quantifier", ["any", "all"])
def test_conditions_on_both_tables(spark, quantifier):
    a, b, left, right = two_tables(spark)
    on, rule = [("k", "fk")], tables.quantified_rule
    inside = lambda p, lo, hi: hi is not None and lo <= p <= hi
    assert judged(rule(a, b, on, tables.Between("p", "lo", "hi"), quantifier, row_id="id")) == verdicts(left, right, quantifier, inside)
    residual = rule(a, b, on, "p between lo and hi", quantifier, row_id="id", primary_cols="p", secondary_cols=["lo", "hi"])
    assert judged(residual) == verdicts(left, right, quantifier, inside)
    for op in [*OPS, "within"]:
        for column, at in (("lo", 0), ("hi", 1)):
            tol = 2 if op == "within" else 0
            want = verdicts(left, right, quantifier, lambda p, lo, hi: (lo, hi)[at] is not None and holds(op, p, (lo, hi)[at], tol))  # noqa: B023
            assert judged(rule(a, b, on, pairs.Compare("p", op, column, tol), quantifier, row_id="id")) == want, (op, column)
    nothing = rule(a, b.limit(0), on, tables.Between("p", "lo", "hi"), quantifier, row_id="id")
    assert set(judged(nothing).values()) == {quantifier == "all"}
    assert judged(rule(a.limit(0), b, on, {"value": "p", "low": "lo", "high": "hi"}, quantifier, row_id="id")) == {}


def test_interval_lookup_in_a_hot_key(spark, hot):
    df = skewed(spark, 900)
    spans = skewed(spark, 600).select("k", F.col("v").alias("lo"), (F.col("v") + F.col("t") % 40).alias("hi"))
    rule = tables.quantified_rule(df, spans, [("k", "k")], tables.Between("v", "lo", "hi"), "any", row_id="row_id")
    by_key = {}
    for r in spans.collect():
        by_key.setdefault(r.k, []).append((r.lo, r.hi))
    want = {r.row_id: any(lo <= r.v <= hi for lo, hi in by_key.get(r.k, [])) for r in df.collect()}
    assert judged(rule) == want and 0 < sum(want.values()) < len(want)


def test_conditions_on_both_tables_emit_no_pairs(spark):
    a, b, *_ = two_tables(spark)
    rule = tables.quantified_rule(a, b, [("k", "fk")], "p < hi", "any", row_id="id", primary_cols="p", secondary_cols="hi")
    plan = rule.violations()._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "Inner" not in plan and "LeftSemi" in rule.satisfactions()._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        tables.quantified_rule(a, b.withColumnRenamed("lo", "p"), [("k", "fk")], "p < hi", "any", row_id="id", primary_cols="p", secondary_cols=["p", "hi"])


@pytest.mark.parametrize("verdict", ["violation", "satisfaction"])
def test_monotonic_pairs_of_a_hot_group(spark, hot, verdict):
    df = skewed(spark, 300)
    found = order.monotonic_pairs(df, "k", "v", "t", verdict, row_id="row_id")
    rows = [tuple(r) for r in df.collect()]
    want = sorted((a[0], b[0]) for a, b in itertools.permutations(rows, 2)
                  if a[1] == b[1] and a[2] < b[2] and (b[3] <= a[3]) == (verdict == "violation"))
    assert sorted((r.lower, r.higher) for r in found.pairs().collect()) == want
    assert int(found.count().first().pairs) == len(want)


def test_monotonic_links_grow_with_the_rows_not_the_pairs(spark):
    df = spark.range(2000).select(F.col("id").alias("row_id"), F.lit("one").alias("k"), "id", (-F.col("id")).alias("t"))
    found = order.monotonic_pairs(df, "k", "id", "t", row_id="row_id")
    assert int(found.count().first().pairs) == 2000 * 1999 // 2
    assert found.links.count() <= 2000 * 11 and found.members.count() <= 2000 * 11
    assert order.monotonic_pairs(df.limit(0), "k", "id", "t", row_id="row_id").pairs().count() == 0


def test_monotonic_pairs_are_made_in_bounded_portions(spark, monkeypatch):
    monkeypatch.setattr(order, "BUNDLE", 4)
    monkeypatch.setattr(order, "PIECE", 8)
    df = spark.range(90).select(
        F.col("id").alias("row_id"), F.lit("one").alias("k"), (F.col("id") % 30).alias("v"), F.pmod(F.col("id") * 37, F.lit(17)).alias("t"))
    rows = [tuple(r) for r in df.collect()]
    for verdict in ("violation", "satisfaction"):
        found = order.monotonic_pairs(df, "k", "v", "t", verdict, row_id="row_id").pairs(F.col("group_key")[0]["val"])
        want = sorted(("one", a[0], b[0]) for a, b in itertools.permutations(rows, 2) if a[2] < b[2] and (b[3] <= a[3]) == (verdict == "violation"))
        assert sorted(tuple(r) for r in found.collect()) == want
        # Nothing is matched and thrown away: what meets are arrays of 4 links and 8 rows, and the last step only reads them off.
        plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert plan[0].startswith("Generate explode") and plan[1].strip().startswith("+- Repartition")
        assert not [x for x in plan if "Join" in x and "place" in x]
