"""Sketches against exact figures, and data made for a given rule."""

import pytest
from helpers import metrics
from pyspark.sql import functions as F

from rulespan.operators import groups, order, rows, sketches, synth, tables


def numbers(spark, n=200_000):
    i = F.col("id")
    return spark.range(0, n, 1, 8).select(
        F.pmod(i, F.lit(4)).alias("part"), F.pmod(i * 7919, F.lit(50_021)).alias("many"), F.when(i % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.pmod(i, F.lit(40)))).alias("few"),
        F.when(i % 10 == 0, F.lit(float("nan"))).when(i % 10 == 1, None).otherwise(F.sqrt(i.cast("double"))).alias("v"), F.lit(None).cast("string").alias("none"))


def test_merged_sketches_keep_their_bounds(spark, tmp_path):
    df = numbers(spark)
    sketches.column_sketches(df.where("part < 2"), ["part"]).write.parquet(str(tmp_path / "s"))
    sketches.column_sketches(df.where("part >= 2"), ["part"]).write.mode("append").parquet(str(tmp_path / "s"))
    merged = sketches.merged_sketches(spark.read.parquet(str(tmp_path / "s")))
    got = {r.column_name: r for r in sketches.approximate_profile(merged, top=2).collect()}
    assert {c: (r.n, r.missing) for c, r in got.items()} == {"many": (200_000, 0), "few": (200_000, 0), "v": (200_000, 40_000), "none": (200_000, 200_000)}
    assert abs(got["many"].distinct_values - 50_021) <= 50_021 * sketches.DISTINCT_ERROR
    assert got["few"].distinct_values == 41 and got["none"].distinct_values == 1
    assert abs(got["v"].distinct_values - 160_001) <= 160_001 * sketches.DISTINCT_ERROR
    exact = df.where("v IS NOT NULL AND NOT isnan(v)")
    for q, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)):
        assert abs(exact.where(F.col("v") <= got["v"][q]).count() / 160_000 - p) <= sketches.RANK_ERROR
    assert [t["value"] for t in got["few"].top_values][0] == "hot"
    assert abs(got["few"].top_values[0]["count"] - df.where("few = 'hot'").count()) == 0
    assert got["none"].top_values == [] and got["none"].q50 is None


def test_sketches_of_odd_tables(spark):
    df = spark.createDataFrame([(1, 0.0, [1]), (2, -0.0, None), (3, None, [1])], "id int, z double, xs array<int>")
    got = {r.column_name: r.distinct_values for r in sketches.approximate_profile(sketches.column_sketches(df)).collect()}
    assert got == {"id": 3, "z": 2, "xs": 2}
    assert sketches.column_sketches(df.limit(0)).count() == 0
    assert sketches.approximate_profile(sketches.merged_sketches(sketches.column_sketches(df.limit(0)))).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000, 4099])
def test_a_permutation_of_any_size(spark, n):
    for seed in (1, 2):
        got = [r.p for r in spark.range(n).select(synth.permuted(F.col("id"), n, seed).alias("p")).collect()]
        assert sorted(got) == list(range(n))
        if n >= 1000:
            # spread like a random order: about half of any stretch lies in the lower half, and few neighbours stay together
            low = sum(p < n // 2 for p in got[: n // 2])
            assert abs(low - n / 4) < 4 * n**0.5 and sum(abs(a - b) == 1 for a, b in zip(got, got[1:])) < 20


C = synth.Condition
EXACT = [
    ("row", {"head": C("price", "<", 100), "body": C("kind", "=", 2)}, lambda t, p: rows.row_rule(t["primary"], p["head"].sql, p["body"].sql, row_id="row_id")),
    ("row", {"head": C("price", "!=", 5)}, lambda t, p: rows.row_rule(t["primary"], p["head"].sql, row_id="row_id")),
    ("unique_key", {"key": ["a", "b"], "body": C("kind", ">=", 3)}, lambda t, p: groups.unique_key(t["primary"], p["key"], body=p["body"].sql, row_id="row_id")),
    ("functional_dependency", {"lhs": ["a", "b"], "rhs": "y", "body": C("kind", "<", 0)}, lambda t, p: groups.functional_dependency(
        t["primary"], p["lhs"], p["rhs"], body=p["body"].sql, row_id="row_id")),
    ("monotonic", {"key": "k", "rank": "r", "value": "x"}, lambda t, p: order.monotonic(t["primary"], p["key"], p["rank"], p["value"], row_id="row_id")),
    ("sum_to_threshold", {"key": "k", "value": "x", "threshold": 500, "body": C("kind", "<=", 1)}, lambda t, p: groups.sum_to_threshold(
        t["primary"], p["key"], p["value"], "<=", p["threshold"], body=p["body"].sql, row_id="row_id")),
    ("references", {"fk": "f", "pk": "id"}, lambda t, p: tables.references(t["primary"], "f", t["secondary"], "id", row_id="row_id")),
]


@pytest.mark.parametrize(("kind", "params", "rule"), EXACT, ids=[f"{k}-{i}" for i, (k, *_) in enumerate(EXACT)])
def test_planted_shares_are_found_exactly(spark, kind, params, rule):
    share = 0.2 if params.get("body") else 0.0
    made = synth.synthesize_rule(spark, kind, params, n=2003, violation_rate=0.13, out_of_scope=share, missing=0.05, seed=9)
    size = 1 if kind in ("row", "references") else synth.GROUP_SIZE
    units = 2003 // size
    lost = round(0.05 * units)
    outside = round(share * (units - lost))
    judged = units - lost - outside
    bad = round(0.13 * judged)
    m = metrics(rule(made, params))
    assert (m.total_rows, m.applicable_rows) == (units * size, judged * size)
    planted = {r.planted: r["count"] for r in made["primary"].groupBy("planted").count().collect()}
    assert planted.get("violation") == bad * size and planted.get("missing") == lost * size and planted.get("outside", 0) == outside * size
    if kind in ("row", "references"):
        assert (m.sat_rows, m.viol_rows) == (judged - bad, bad) and m.confidence == pytest.approx(1 - bad / judged)
    elif kind == "unique_key":
        assert (int(m.sat_groups), int(m.viol_groups), m.viol_rows) == ((judged - bad) * size, bad, bad * size)
    elif kind == "monotonic":
        assert int(m.viol_groups) == bad and m.confidence == pytest.approx(judged / (judged + bad))
    else:
        assert (int(m.sat_groups), int(m.viol_groups)) == (judged - bad, bad)


def test_not_null_data_and_wrong_arguments(spark):
    made = synth.synthesize_rule(spark, "not_null", {"cols": ["c"]}, n=1000, violation_rate=0.25)["primary"]
    assert metrics(rows.not_null_rule(made, "c", row_id="row_id")).viol_rows == 250
    assert synth.synthesize_rule(spark, "row", {"head": C("p", ">", 0)}, n=0)["primary"].count() == 0
    with pytest.raises(ValueError):
        synth.synthesize_rule(spark, "row", {"head": C("p", ">", 0)}, out_of_scope=0.5)
    with pytest.raises(ValueError):
        synth.synthesize_rule(spark, "nothing", {})
    with pytest.raises(ValueError):
        C("p", "like", 1)
