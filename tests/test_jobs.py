"""Two-table rules, generated data, retrieval, ranking and reports on small cases."""

import numpy as np
import pytest
from helpers import metrics, row_sets
from pyspark.sql import functions as F

from rulespan.functions.prep import coerce, compare
from rulespan.operators import custom, groups, order, profile, ranking, report, retrieval, rows, synth, tables
from rulespan.operators.chunks import enabled
from rulespan.plans import job_queries  # noqa: F401  (registers the queries)
from rulespan.plans.registry import QUERIES


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5])
@pytest.mark.parametrize("kind", synth.KINDS)
def test_generated_violations_are_found(spark, kind, rate):
    df = synth.synthesize(spark, kind, 10_000, rate)
    target = spark.range(10_000)
    result = {
        "row": lambda: rows.row_rule(df, "price < 100", "category = 'book'", row_id="row_id"),
        "unique": lambda: groups.unique_key(df, "code", row_id="row_id"),
        "fd": lambda: groups.functional_dependency(df, "unit", "label", row_id="row_id"),
        "sum_to_total": lambda: groups.sum_to_total(df, "unit", "amount", "kind = 'part'", "kind = 'total'", row_id="row_id"),
        "monotonic": lambda: order.monotonic(df, "unit", "position", "salary", row_id="row_id", group_verdict="any_violation"),
        "reference": lambda: tables.references(df, "target", target, "id", row_id="row_id"),
    }[kind]()
    planted = {r.unit for r in df.where("planted").select("unit").distinct().collect()}
    found = {r.unit for r in df.join(result.violations(), "row_id").select("unit").distinct().collect()}
    assert found == planted
    assert len(planted) == rate * df.select("unit").distinct().count()
    if kind not in ("unique",):
        assert metrics(result).confidence == pytest.approx(1 - rate)


def test_sides_do_not_overlap_and_metrics_follow_from_participants(spark):
    df = synth.synthesize(spark, "fd", 1000, 0.3)
    result = groups.functional_dependency(df, "unit", "label", row_id="row_id")
    sets, m = row_sets(result), metrics(result)
    assert not sets["satisfaction"] & sets["violation"]
    assert (len(sets["satisfaction"]), len(sets["violation"])) == (m.sat_rows, m.viol_rows)
    again = custom.custom_rule(lambda d: groups.functional_dependency(d, "unit", "label", row_id="row_id").participants(), df, rule_id=m.rule_id)
    assert metrics(again) == m


def test_ids_of_differing_type(spark):
    left = spark.createDataFrame([(0, "5"), (1, "5.0"), (2, "5.5"), (3, "x"), (4, str(2**53 + 1)), (5, None)], "row int, k string")
    right = spark.createDataFrame([(5,), (2**53 + 1,)], "k bigint")
    sets = row_sets(tables.references(left, "k", right, "k", row_id="row"))
    assert sets == {"satisfaction": {0, 1, 4}}
    floats = spark.createDataFrame([(0, 5.0), (1, float("nan")), (2, 7.0)], "row int, k double")
    assert row_sets(tables.references(floats, "k", right, "k", row_id="row")) == {"satisfaction": {0}, "violation": {2}}


def test_unmatched_rows_and_quantifiers(spark):
    left = spark.createDataFrame([(0, 1, 10), (1, 2, 10), (2, None, 10), (3, 9, 10)], "row int, k int, x int")
    right = spark.createDataFrame([(1, 5), (1, 20), (2, 5)], "k2 int, y int")
    on = [("k", "k2")]
    any_ = tables.quantified_rule(left, right, on, "y > 10", "any", row_id="row", secondary_cols="y")
    assert row_sets(any_) == {"satisfaction": {0}, "violation": {1, 3}}
    all_ = tables.quantified_rule(left, right, on, "y < 10", "all", row_id="row", secondary_cols="y")
    assert row_sets(all_) == {"satisfaction": {1, 3}, "violation": {0}}
    m = metrics(tables.cross_table_rule(left, right, on, "x > hi", row_id="row", secondary_cols="y", aggs={"hi": F.max("y")}))
    assert (m.total_rows, m.applicable_rows, m.sat_rows, m.support) == (4, 2, 1, 0.5)


def test_injection_appends_only(spark):
    base = {"a": spark.createDataFrame([(1, "x")], "id int, name string"), "b": spark.range(1)}
    steps = [
        {"table_to_modify": "a", "record_to_add": {"_id": 7, "id": 2}},
        {"table_to_modify": "zzz", "record_to_add": {"_id": 8}},
        {"table_to_modify": "a"},
    ]
    changed, ids = tables.inject(spark, base, steps)
    assert ids == [7]
    assert sorted(changed["a"].select("id", "name", "_id").collect()) == [(1, "x", None), (2, None, 7)]
    assert changed["b"] is base["b"]


def test_comparison_operators(spark):
    one = spark.range(1)
    cases = [("<", 1, 1, 5, False), ("<=", 1.01, 1, 0.1, True), (">=", 0.95, 1, 0.1, True), ("=", 1.05, 1, 0.1, True), ("!=", 1.05, 1, 0.1, False), (">", 2, 1, 0, True)]
    for op, a, b, tol, want in cases:
        assert one.select(compare(F.lit(a), op, F.lit(b), tol)).first()[0] is want
    with pytest.raises(ValueError):
        compare(F.lit(1), "~", F.lit(1))


def test_coerce_makes_bad_text_null(spark):
    df = coerce(spark.createDataFrame([("1",), ("x",), (None,)], "a string"), {"a": "int"})
    assert [r.a for r in df.collect()] == [1, None, None]


def test_sources_are_enabled_unless_switched_off(spark):
    df = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "s string, enabled boolean")
    assert [r.s for r in enabled(df).collect()] == ["a", "c"]


@pytest.mark.parametrize("max_queries", [100, 7])
def test_top_k_equals_brute_force(spark, max_queries):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(100, 6))
    vectors[7] = vectors[3]  # a tie
    vectors[9] = 0
    df = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(vectors)], "id long, v array<double>, src int")
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norms == 0, 1, norms)
    score = np.round(unit @ unit.T, 9)
    got = retrieval.top_k(df, df, 3, query_id="id", item_id="id", vector="v", source="src", sources=[0, 3], skip_self=True, max_queries=max_queries)
    found = {(r.query_id, r["rank"]): r.item_id for r in got.collect()}
    for q in range(100):
        allowed = [i for i in range(100) if i % 4 in (0, 3) and i != q]
        best = sorted(allowed, key=lambda i: (-score[q, i], i))[:3]
        assert [found[q, n] for n in (1, 2, 3)] == best


def test_top_k_in_tiles_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 40)
    monkeypatch.setattr(retrieval, "LEAST_QUERIES", 20)
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(150, 5)).astype(np.float32)
    vectors[20:60] = vectors[20]  # one vector many times
    vectors[70:90] = vectors[70] * np.float32(2) ** rng.integers(-3, 4, (20, 1))
    vectors[95] = 0
    ids = [int(i) for i in rng.permutation(150)]
    ids[5], ids[21] = ids[4], ids[20]  # repeated ids, with other vectors and with the same one
    rows = [(i, v.tolist()) for i, v in zip(ids, vectors)] + [(ids[0], vectors[0].tolist())] * 2
    odd = [(None, [1.0] * 5), (1001, None), (1002, [1.0, None, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows + odd, "id long, v array<float>").repartition(3)
    unit = np.array([v for _, v in rows], np.float32).astype(np.float64)
    norms = np.linalg.norm(unit, axis=1, keepdims=True)
    unit /= np.where(norms == 0, 1, norms)
    score, own = np.round(unit @ unit.T, 9), np.array([i for i, _ in rows])
    want = {}
    for q in set(own.tolist()):
        pairs = [(-score[a, b], own[b]) for a in np.flatnonzero(own == q) for b in range(len(own)) if own[b] != q]
        want[q] = [item for _, item in sorted(pairs)[:4]]
    for at_a_time in (1, 7, 64):
        got = {}
        for r in retrieval.top_k(df, df, 4, query_id="id", item_id="id", vector="v", skip_self=True, max_queries=at_a_time).orderBy("rank").collect():
            got.setdefault(r.query_id, []).append(r.item_id)
        assert got == want


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("shape", ["spread", "close", "rising"])
def test_best_items_equal_a_full_sort(monkeypatch, ascending, shape):
    for name, value in {"FIRST_ITEMS": 20, "SCORE_CELLS": 400, "EXACT_PAIRS": 30}.items():
        monkeypatch.setattr(retrieval, name, value)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(600, 8))
    if shape == "close":  # what single precision cannot tell apart, and ties
        vectors[:400] = vectors[0] + rng.normal(size=(400, 8)) * 1e-8
        vectors[100:300] = vectors[100]
    elif shape == "rising":
        vectors[:] = vectors[0] + vectors * np.linspace(3, 0.01, 600)[:, None]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    ids = np.arange(600) if ascending else rng.permutation(600)
    best = retrieval._Best(ids[:40], vectors[:40], 5, True)
    for at in range(0, 600, 150):
        best.add(ids[at : at + 150], vectors[at : at + 150], vectors[at : at + 150].astype(np.float32))
    score = np.round(np.einsum("qd,id->qi", vectors[:40], vectors), 9)
    for q in range(40):
        order = [i for i in np.lexsort((ids, -score[q])) if ids[i] != ids[q]][:5]
        assert best.items[q].tolist() == ids[order].tolist()


@pytest.mark.parametrize("name", ["top_k_each", "top_k_each_blocks"])
def test_every_embedding_is_a_query(spark, tmp_path, name):
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=4)], i % 3) for i in range(130)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    asked = QUERIES[name](spark, str(tmp_path)).groupBy("query_id").count().collect()
    assert sorted(tuple(r) for r in asked) == [(i, 5) for i in range(130)]


def test_top_k_plan_does_not_grow_with_the_queries(spark):
    df = spark.range(300).select("id", F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 3)).alias("v"))
    got = retrieval.top_k(df, df, 2, query_id="id", item_id="id", vector="v", skip_self=True, max_queries=3)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert got.count() == 600


def test_url_ranking_is_stable(spark):
    urls = ["http://x.org/a", "ftp://docs.org", "https://docs.python.org/guide", "http://x.org/pandas", "http://y.org/b"]
    df = spark.createDataFrame(list(enumerate(urls)), "pos int, url string")
    got = retrieval.rank_urls(df, "url", "pos", 4).collect()
    assert [(r.pos, r.score) for r in got] == [(2, 18), (3, 5), (0, 0), (4, 0)]


def test_smoothing_equals_the_fold(spark, hot):
    values = [(k, t, None if (t + k) % 5 == 0 else float((t * 37) % 11)) for k in range(3) for t in range(60)]
    df = spark.createDataFrame(values, "k int, t int, v double")
    want = {}
    for k, _, v in values:
        if v is not None:
            want[k] = v if k not in want else 0.7 * want[k] + 0.3 * v
    got = {r.k: r.ema for r in ranking.ema(df, "k", "t", "v").collect()}
    assert got == pytest.approx(want)


def test_quality_score_parts(spark):
    as_of = F.expr("timestamp'2024-03-01 12:00:00'")
    data = [
        ("a", 1.0, 1.0, 10.0, "2024-03-01 00:00:00"), ("b", 0.5, 3.0, 30.0, "2024-02-15 11:00:00"),
        ("c", 0.0, None, 20.0, "2023-01-01 00:00:00"),
    ]
    stats = spark.createDataFrame(data, "id string, success_rate double, execution_time double, memory_usage double, last text".replace("last text", "last_used string"))
    got = {r.id: r.quality_score for r in ranking.quality_score(stats, as_of).collect()}
    assert got == {"a": 100.0, "b": pytest.approx(20 + 10 - 5), "c": pytest.approx(0 + 15 + 10 + 0)}
    equal = {r.id: r.quality_score for r in ranking.quality_score(stats.where("id = 'a'"), as_of).collect()}
    assert equal == {"a": 40 + 15 + 10 + 10}


def test_compare_results_and_pass_rate(spark):
    schema = "rule_id string, verdict string, row_id int"
    actual = spark.createDataFrame([("r", "violation", 1), ("r", "violation", 1), ("r", "satisfaction", 2), ("s", "violation", 1)], schema)
    expected = spark.createDataFrame([("r", "violation", 1), ("r", "satisfaction", 3), ("s", "violation", 1)], schema)
    compared = {r.rule_id: r for r in report.compare_results(actual, expected).collect()}
    assert compared["s"].success and not compared["r"].success
    assert (compared["r"].missing_satisfactions, compared["r"].unexpected_satisfactions, compared["r"].common_rows) == (1, 1, 1)
    rate = report.pass_rate(report.compare_results(actual, expected)).first()
    assert (rate.pass_rate, rate.passed) == (0.5, True)
    assert report.pass_rate(report.compare_results(actual.limit(0), expected.limit(0))).first().pass_rate == 0.0


def test_summary_of_an_empty_log(spark):
    log = spark.createDataFrame([], "rule_id string, status string, seconds double, injected boolean, injected_found boolean")
    summary = report.run_summary(log).first()
    assert (summary.total_rules, summary.average_seconds, summary.injected_found_percent) == (0, None, None)


def test_status_takes_the_first_cause(spark):
    df = spark.createDataFrame(
        [(False, False, 1.0, None, True), (True, False, 1.0, None, True), (True, True, 400.0, "e", True), (True, True, 1.0, "e", False), (True, True, 1.0, None, False), (True, True, 1.0, None, True)],
        "info boolean, loaded boolean, s double, e string, o boolean")
    status = report.run_status(F.col("info"), F.col("loaded"), F.col("s"), F.col("e"), F.col("o"), 300)
    assert [r[0] for r in df.select(status).collect()] == [
        report.STATUS[k] for k in ("missing_info", "load_failed", "timeout", "error", "bad_output", "ok")]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000)
    one = profile.sample_rows(df.repartition(7), 50, "id").collect()
    assert one == profile.sample_rows(df.coalesce(1), 50, "id").collect()
    assert profile.sample_rows(df, 50, "id", seed=1).collect() != one
    assert profile.sample_rows(df.limit(10), 50, "id").count() == 10


@pytest.mark.parametrize("one_pass", [False, True])
def test_profile_counts_missing_as_one_value(spark, one_pass):
    df = spark.createDataFrame([(1, 0.0, None), (1, -0.0, None), (2, float("nan"), "x"), (3, None, "x")], "a int, b double, c string")
    got = {r.column_name: (r.data_type, r.distinct_values) for r in profile.column_profile(df, one_pass=one_pass).collect()}
    assert got == {"a": ("int", 3), "b": ("double", 2), "c": ("string", 2)}
    close = {r.column_name: r.distinct_values for r in profile.column_profile(df, approx=True).collect()}
    assert close == {"a": 3, "b": 2, "c": 2}
    told = {r.column_name: r for r in profile.describe_all(df, one_pass).collect()}
    assert (told["c"].top, told["c"].freq, told["c"].unique, told["c"]["count"]) == ("x", 2, 1, 2)
    assert (told["a"].q50, told["a"].mean, told["a"].max) == (1.5, 1.75, 3.0)


def test_shared_group_rules_equal_single_ones(spark):
    data = [(0, "a", 1.0, 1), (1, "a", None, 2), (2, "b", 5.0, 3), (3, None, 5.0, 4), (4, "c", float("nan"), 5)]
    df = spark.createDataFrame(data, "id int, k string, v double, w int")
    rules = [
        groups.GroupRule("u", "count", "agg_value = 1"),
        groups.GroupRule("s", "sum", "agg_value > 2", "v"),
        groups.GroupRule("m", "max", "agg_value < 3", "w", "w < 5"),
    ]
    got = {r.rule_id: r for r in groups.evaluate_group_rules(df, "k", rules).collect()}
    for rule in rules:
        alone = groups.aggregate_constraint(df, "k", rule.agg, rule.predicate, rule.value, body=rule.body, row_id="id", rule_id=rule.rule_id)
        assert got[rule.rule_id] == metrics(alone)
