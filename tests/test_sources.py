"""Readers and writers, by round trips."""

import json
import time

import pytest
from pyspark.sql import functions as F

from rulespan.operators import groups
from rulespan.operators.ranking import register_new
from rulespan.operators.report import STATUS, overview, run_summary
from rulespan.plans import batch
from rulespan.sources import catalogue, corpus, loader, results, store, tables


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "people.csv").write_text('id,name,score,day\n1,Ann,2.5,2024-01-01\n2,NA,n/a,2024-01-02\n3,"B, ""x""",-3,\n')
    return str(tmp_path)


def test_csv_with_missing_cells(spark, folder):
    df = tables.load_table(spark, folder, "People")
    assert [t for _, t in df.dtypes] == ["bigint", "string", "double", "timestamp"]
    rows = df.orderBy("id").collect()
    assert [r.name for r in rows] == ["Ann", None, 'B, "x"']
    assert [r.score for r in rows] == [2.5, None, -3.0]
    assert rows[2].day is None


def test_csv_parsed_once(spark, folder, tmp_path):
    stored = tables.load_table(spark, folder, "People", store=str(tmp_path / "parsed"))
    plain = tables.load_table(spark, folder, "People")
    assert stored.schema == plain.schema and sorted(map(tuple, stored.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert all("parsed" in f for f in stored.inputFiles())


def test_csv_with_a_schema(spark, folder):
    df = tables.load_table(spark, folder, "people", schema="id int, name string, score string, day date")
    assert [t for _, t in df.dtypes] == ["int", "string", "string", "date"]
    assert df.where("score is null").count() == 1


def test_missing_tables_are_left_out(spark, folder):
    found = tables.load_tables(spark, folder, ["people", "nobody", "people"])
    assert list(found) == ["people"]
    tables.register(found)
    assert spark.sql("select count(*) from people").first()[0] == 3


def test_csv_round_trip(spark, tmp_path):
    df = spark.range(5).selectExpr("id", "id * 1.5 as v")
    tables.write_table(df, str(tmp_path / "t.csv"))
    back = tables.load_table(spark, str(tmp_path), "T")
    assert back.columns == ["id", "v"]
    assert sorted(r.v for r in back.collect()) == [0.0, 1.5, 3.0, 4.5, 6.0]


def test_row_numbers_follow_the_file(spark, tmp_path):
    path = tmp_path / "many.csv"
    path.write_text("v\n" + "\n".join(str(i * 3) for i in range(5000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = spark.read.csv(str(path), header=True, schema="v bigint")
        assert df.rdd.getNumPartitions() > 3
        numbered = tables.with_row_id(df)
        assert numbered.where("v <> row_id * 3").count() == 0
        assert numbered.agg(F.count_distinct("row_id"), F.max("row_id")).first()[:] == (5000, 4999)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_parquet_positions_are_unique(spark, tmp_path):
    spark.range(0, 100, 1, 3).write.parquet(str(tmp_path / "p"))
    df = tables.with_file_position(spark.read.parquet(str(tmp_path / "p")))
    assert df.select("row_id").distinct().count() == 100


RULE = {"rule": "r", "explanation": "e", "rule_type": "row", "relevant_columns": ["v"]}


@pytest.fixture
def rules(tmp_path):
    for dataset, rule_id, check in [
        ("flights", "a", {"kind": "row", "row_id": "id", "params": {"head": "v > 1"}}),
        ("flights", "b", {"kind": "unique_key", "row_id": "id", "params": {"key": "v"}}),
        ("hotels", "c", None),
    ]:
        place = tmp_path / "rules" / dataset / rule_id
        place.mkdir(parents=True)
        text = json.dumps(check) if check else None
        (place / "rule.json").write_text(json.dumps({"rule_id": rule_id, **RULE, "check": text}, indent=1))
        (place / "other.json").write_text("{}")
    return str(tmp_path / "rules")


def test_rule_folders(spark, rules):
    found = catalogue.load_rules(spark, rules)
    assert {(r.dataset, r.rule_id) for r in found.collect()} == {("flights", "a"), ("flights", "b"), ("hotels", "c")}
    done = spark.createDataFrame([("flights", "a")], "dataset string, rule_id string")
    assert {r.rule_id for r in catalogue.pending_rules(found, done).collect()} == {"b", "c"}
    valid, missing = catalogue.split_valid(found, spark.createDataFrame([("flights",)], "dataset string"))
    assert (valid.count(), missing.count()) == (2, 1)
    assert sorted(s.kind for s in batch.specs_from(found)) == ["row", "unique_key"]


def test_multi_table_rules(spark, tmp_path):
    path = tmp_path / "multi.json"
    one = {"table_to_modify": "a", "record_to_add": {"_id": 7, "x": 1}}
    path.write_text(json.dumps([
        {"rule_definition": "d1", "table1": "a", "table2": "b", "violation_rate": 0.25, "violation_data_generator": one},
        {"rule_definition": "d2", "table1": "a", "table2": "b", "violation_rate": 0.0, "violation_data_generator": [one, one]},
    ]))
    rows = catalogue.load_multi_table_rules(spark, str(path)).collect()
    assert [(r.rule_id, r.rule_definition, r.violation_rate) for r in rows] == [("1", "d1", 0.25), ("2", "d2", 0.0)]
    assert [len(json.loads(r.violation_data_generator)) for r in rows] == [1, 2]


def test_injected_records_are_found(spark, tmp_path):
    check = json.dumps({"kind": "references", "row_id": "id", "params": {"fk": "k", "pk": "k2"}})
    def rule(**more):
        return {"rule_definition": "d", "table1": "a", "table2": "b", "check": check, **more}
    bad = {"table_to_modify": "a", "record_to_add": {"_id": 9, "id": 9, "k": 99}}
    good = {"table_to_modify": "a", "record_to_add": {"_id": 8, "id": 8, "k": 1}}
    path = tmp_path / "multi.json"
    path.write_text(json.dumps([
        rule(violation_rate=0.25, violation_data_generator=bad), rule(violation_rate=0.0, violation_data_generator=[good]),
        rule(violation_rate=0.5), {**rule(violation_rate=0.0), "table2": "zzz"}, {**rule(), "table2": None},
        {**rule(violation_rate=0.0), "check": json.dumps({"kind": "odd", "row_id": "id"})},
    ]))
    base = {
        "a": spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "id int, k int"),
        "b": spark.createDataFrame([(1,), (2,)], "k2 int"),
    }
    tests = batch.injection_tests(catalogue.load_multi_table_rules(spark, str(path)))
    log = batch.run_injection_tests(spark, tests, base)
    got = [(r.status, r.injected, r.injected_found, r.violation_rate, r.rate_matches) for r in log.orderBy("rule_id").collect()]
    assert got == [
        (STATUS["ok"], True, True, 0.25, True),
        (STATUS["ok"], True, False, 0.0, True),
        (STATUS["ok"], False, None, 0.0, False),
        (STATUS["load_failed"], False, None, None, False),
        (STATUS["missing_info"], False, None, None, True),
        (STATUS["error"], False, None, None, False),
    ]
    summary = run_summary(log).first()
    assert (summary.total_rules, summary.injected_rules, summary.injected_found_percent) == (6, 2, 50.0)
    assert (summary.ok_rules, summary.skipped_rules, summary.failed_rules) == (3, 2, 1)


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", 1), (1, "a", 2), (2, "b", 1)], "id int, k string, v int")
    result = groups.functional_dependency(df, "k", "v", row_id="id", rule_id="r1")
    results.write_results(result, str(tmp_path / "out"))
    assert results.read_metrics(spark, str(tmp_path / "out")).first().confidence == 0.5
    stored = results.read_participants(spark, str(tmp_path / "out"))
    assert {(r.verdict, r.row_id) for r in stored.collect()} == {("violation", 0), ("violation", 1), ("satisfaction", 2)}


def test_json_has_no_nan(spark):
    df = results.no_nan(spark.createDataFrame([(float("nan"), 1.0)], "a double, b double"))
    assert df.first()[:] == (None, 1.0)


def test_catalogue_run_goes_on_after_a_failure(spark, rules, tmp_path):
    df = spark.createDataFrame([(0, 1), (1, 2), (2, 2)], "id int, v int")
    specs = batch.specs_from(catalogue.load_rules(spark, rules)) + [
        batch.RuleSpec("a2", "flights", "row", "id", {"head": "v < 2"}),
        batch.RuleSpec("bad", "flights", "row", "id", {"head": "nothing > 1"}),
        batch.RuleSpec("lost", "trains", "row", "id", {"head": "v > 1"}),
        batch.RuleSpec("odd", "flights", "no_such_kind", "id"),
    ]
    out = str(tmp_path / "run")
    log = {r.rule_id: r.status for r in batch.run_catalogue(spark, specs, {"flights": df}, out).collect()}
    assert log == {
        "a": STATUS["ok"], "a2": STATUS["ok"], "b": STATUS["ok"],
        "bad": STATUS["error"], "lost": STATUS["load_failed"], "odd": STATUS["error"],
    }
    stored = {r.rule_id: r.confidence for r in spark.read.parquet(out + "/metrics").collect()}
    assert stored == {"a": pytest.approx(2 / 3), "a2": pytest.approx(1 / 3), "b": 0.5}
    again = {r.rule_id for r in batch.run_catalogue(spark, specs, {"flights": df}, out).collect()}
    assert again == {"bad", "lost", "odd"}


def test_corpus_grows_by_new_texts_only(spark, tmp_path):
    path = str(tmp_path / "corpus")
    code = corpus.snippet_text(F.lit("x = 1"), F.lit("Sum"), F.array(F.lit("a"), F.lit("b")), F.lit(1.5), F.lit(None))
    new = spark.range(2).select(F.concat(F.lit("s"), "id").alias("source"), F.lit("code_snippet").alias("source_type"), F.lit("d").alias("description"), code.alias("text"))
    corpus.append_corpus(new.where("source = 's0'"), path)
    corpus.append_corpus(new.where("source = 's1'"), path)
    stored = spark.read.parquet(path).orderBy("source").collect()
    assert [r.source for r in stored] == ["s0", "s1"]
    assert stored[0].chunk == "# Sum\n# Tags: a, b\n# Metrics: Time=1.5s, Memory=N/AMB\n\nx = 1"


def endless(spark):
    """Far more rows than any time limit allows."""
    return spark.range(0, 10**13, 1, 2).selectExpr("cast(pmod(hash(id), 1000) as int) as id", "cast(pmod(hash(id, 1), 7) as int) as k")


def slow(df):
    """A user rule that never ends in time."""
    return endless(df.sparkSession).groupBy("id").agg(F.max("k").alias("k")).select(F.lit("violation").alias("verdict"), F.col("id").alias("row_id"))


def verdictless(df):
    return df.select("id")


def doubled(df):
    return df.where("v > 1").select(F.lit("violation").alias("verdict"), F.col("id").alias("row_id"))


def test_all_outcomes_of_a_run(spark, tmp_path):
    """A slow rule is cancelled at its limit and logged; the others finish beside it."""
    df = spark.createDataFrame([(0, 1), (1, 2), (2, 2)], "id int, v int")
    out = str(tmp_path / "run")
    custom = lambda rule_id: batch.RuleSpec(rule_id, "t", "custom", "id", {"function": rule_id})
    specs = [
        custom("slow"), custom("verdictless"), custom("doubled"), batch.RuleSpec("fine", "t", "unique_key", "id", {"key": "v"}),
        batch.RuleSpec("pairs", "t", "pair_rule", "id", {"match": "v", "head": {"left": "id", "op": "<"}}),
        batch.RuleSpec("broken", "t", "row", "id", {"head": "nothing > 1"}), batch.RuleSpec("lost", "u", "row", "id", {"head": "v > 1"}),
        batch.RuleSpec("none", "", "row", "id"),
    ]
    started = time.monotonic()
    functions = {"slow": slow, "verdictless": verdictless, "doubled": doubled}
    log = {r.rule_id: r for r in batch.run_catalogue(spark, specs, {"t": df}, out, time_limit=15, functions=functions).collect()}
    assert {k: r.status for k, r in log.items()} == {
        "slow": STATUS["timeout"], "verdictless": STATUS["bad_output"], "doubled": STATUS["ok"], "fine": STATUS["ok"],
        "pairs": STATUS["ok"], "broken": STATUS["error"], "lost": STATUS["load_failed"], "none": STATUS["missing_info"]}
    assert log["slow"].seconds >= 15 and time.monotonic() - started < 55
    assert len({r.status for r in log.values()}) == len(STATUS)
    stored = store.ResultStore(spark, out)
    assert {r.rule_id for r in stored.metrics().collect()} == {"doubled", "fine", "pairs"}
    violations = {(r.rule_id, r.row_id) for r in stored.participants().where("verdict = 'violation'").collect()}
    assert violations == {("doubled", "1"), ("doubled", "2"), ("fine", "1"), ("fine", "2")}


def test_injection_tests_have_a_time_limit(spark):
    base = {"a": endless(spark), "b": spark.createDataFrame([(1,)], "k2 int")}
    spec = batch.RuleSpec("r", "a", "references", "id", {"fk": "k", "pk": "k2"}, "b")
    log = batch.run_injection_tests(spark, [batch.InjectionTest(spec)], base, time_limit=3).collect()
    assert [r.status for r in log] == [STATUS["timeout"]]


def test_results_appear_whole_or_not_at_all(spark, tmp_path):
    """A run killed between its data and its commit leaves nothing to read; its rules stay pending; repeats add nothing."""
    df = spark.createDataFrame([(0, "a", 1), (1, "a", 2), (2, "b", 1)], "id int, k string, v int")
    rule = lambda rule_id, row_id="id": groups.functional_dependency(df, "k", "v", row_id=row_id, rule_id=rule_id)
    place = store.ResultStore(spark, str(tmp_path / "store"))
    assert place.metrics() is None and place.participants().count() == 0 and place.commits().count() == 0
    place.stage(rule("killed").metrics, [rule("killed").participants()])
    assert place.metrics().count() == 0 and place.participants().count() == 0
    names = spark.createDataFrame([("killed",), ("two",)], "rule_id string")
    assert {r.rule_id for r in place.pending(names).collect()} == {"killed", "two"}
    first = place.add(["two", "one"], rule("one").metrics.unionAll(rule("two").metrics), [rule("one").participants(), rule("two", ["k", "id"]).participants()])
    place.add(["two"], rule("two").metrics, [rule("two", ["k", "id"]).participants()])
    assert {r.rule_id: r.run for r in place.commits().collect()} == {"one": first, "two": first}
    assert sorted(r.rule_id for r in place.metrics().collect()) == ["one", "two"]
    rows = sorted((r.rule_id, r.verdict, r.row_id) for r in place.participants().collect())
    assert rows[:3] == [("one", "satisfaction", "2"), ("one", "violation", "0"), ("one", "violation", "1")]
    assert rows[3:] == [("two", "satisfaction", '{"k":"b","id":2}'), ("two", "violation", '{"k":"a","id":0}'), ("two", "violation", '{"k":"a","id":1}')]
    assert {r.rule_id for r in place.pending(names).collect()} == {"killed"}


def test_overview_with_run_times(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "a", 2)], "id int, k string, v int")
    result = groups.functional_dependency(df, "k", "v", row_id="id", rule_id="r")
    log = spark.createDataFrame([("r", 1.5, "x"), ("other", 9.0, "y")], "rule_id string, seconds double, status string")
    shown = overview(result.metrics, df, log).collect()
    assert [(r.rule_id, r.violating_rows, r.seconds, r.status) for r in shown] == [("r", 2, 1.5, "x")]
    assert [r.seconds for r in overview(result.metrics, df, log.limit(0)).collect()] == [None]


def test_a_failing_source_is_listed_and_the_others_load(spark, tmp_path):
    docs = tmp_path / "docs" / "deep"
    docs.mkdir(parents=True)
    (docs / "a.md").write_text("# Alpha\n\ntext of alpha")
    (docs.parent / "b.txt").write_text("beta é")
    (docs.parent / "c.bin").write_text("no document")
    (docs.parent / "bad.py").write_bytes(b"\xff\xfe\x00broken")
    (tmp_path / "one.py").write_text("# Sum\n# Tags: a, b\nx = 1\n")
    spark.createDataFrame([("http://x/y", "<p>Hello <b>page</b></p>")], "url string, html string").write.parquet(str(tmp_path / "pages"))
    spark.range(3).write.parquet(str(tmp_path / "odd"))
    settings = spark.createDataFrame([
        ("docs", "documentation", str(tmp_path / "docs"), None, True), ("code", "code_snippet", str(tmp_path / "one.py"), "snippets", None),
        ("site", "web", str(tmp_path / "pages"), "API documentation", True), ("gone", "documentation", str(tmp_path / "nowhere"), "", True),
        ("odd", "web", str(tmp_path / "odd"), "", True), ("kind", "video", str(tmp_path), "", True), ("off", "documentation", str(tmp_path / "docs"), "", False),
    ], "name string, type string, path string, description string, enabled boolean")
    found = loader.load_sources(spark, loader.sources_from(settings))
    assert sorted((r.source, r.text) for r in found.texts.collect()) == [
        ("code", "# Sum\n# Tags: a, b\nx = 1\n"), ("docs", "# Alpha\n\ntext of alpha"), ("docs", "beta é"), ("site", "Hello page")]
    failures = {(r.source, (r.path or "").rsplit("/", 1)[-1]) for r in found.failures.collect()}
    assert failures == {("docs", "bad.py"), ("gone", ""), ("odd", ""), ("kind", "")}
    chunks = {(r.source, r.chunk_no, r.chunk) for r in found.chunks().collect()}
    assert ("site", 0, "Hello page") in chunks and len(chunks) == 4
    nothing = loader.load_sources(spark, [loader.Source("gone", "documentation", str(tmp_path / "nowhere"))])
    assert nothing.texts.count() == 0 and nothing.failures.count() == 1
    # files that are not known yet become entries with what their header says
    files = found.texts.where("source = 'code'").selectExpr("path AS snippet_id", "path AS filepath", "text")
    entries = register_new(files, spark.createDataFrame([("other",)], "snippet_id string"), F.current_timestamp()).collect()
    assert [(r.description, r.tags, r.usage_count) for r in entries] == [("Sum", "a, b", 0)]


def test_appending_the_same_texts_again_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "corpus")
    rows = [("s", "web", "the documentation", "long text " * 400), ("s", "web", "the documentation", "long text " * 400), ("t", "web", "other", "long text " * 400),
            (None, "code_snippet", None, "x = 1"), ("u", "documentation", "", None), ("u", "documentation", "", "")]
    new = spark.createDataFrame(rows, "source string, source_type string, description string, text string")
    corpus.append_corpus(new, path)
    first = sorted(map(tuple, spark.read.parquet(path).select("source", "chunk_no", "chunk").collect()), key=str)
    # sources are cut by their own profiles
    assert {(s, len(c)) for s, n, c in first if n == 0} == {("s", 1499), ("t", 999), (None, 5)}
    corpus.append_corpus(new, path)
    corpus.append_corpus(new.where("source = 's'").unionAll(new.where("source = 't'").withColumn("text", F.lit("more"))), path)
    again = sorted(map(tuple, spark.read.parquet(path).select("source", "chunk_no", "chunk").collect()), key=str)
    assert again == sorted([*first, ("t", 0, "more")], key=str)
