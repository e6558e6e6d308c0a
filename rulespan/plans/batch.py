"""Running a rule catalogue: row rules of a table share a scan, aggregate rules of a key share a shuffle.

Rules that share no work run side by side, each under a job tag of its own, by which a rule that takes longer than its
time limit is cancelled while the others go on. Results go to a ``sources.store.ResultStore``.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.functions.prep import matches, present
from rulespan.model import VERDICTS, RuleResult, as_list, row_id_column
from rulespan.operators import custom, groups, order, outliers, pairs, rows, tables
from rulespan.operators.report import STATUS
from rulespan.sources.store import ResultStore

#: Row rules a table may have in one scan; more are evaluated in several scans.
RULES_PER_SCAN = 100
#: Seconds a rule may take, and rules that run side by side.
TIME_LIMIT, SIDE_BY_SIDE = 300.0, 3
LOG_SCHEMA = "rule_id string, status string, seconds double, error string, injected boolean, injected_found boolean"


@dataclass(frozen=True)
class RuleSpec:
    """A rule as data: what kind of check, on which table, with which parameters.

    Kind ``custom`` names a user function in ``params["function"]``; a run is given the functions.

    ``params`` are the keyword arguments of the operator of that kind, conditions being SQL text. Rules
    over two tables name the second one in ``table2``.
    """

    rule_id: str
    table: str
    kind: str
    row_id: Sequence[str] | str
    params: Mapping = field(default_factory=dict)
    table2: str | None = None

    @staticmethod
    def from_json(rule_id: str, table: str, check: str, table2: str | None = None) -> RuleSpec:
        parsed = json.loads(check)
        return RuleSpec(rule_id, table, parsed["kind"], parsed["row_id"], parsed.get("params", {}), table2)


def _row_rules(spec: RuleSpec, df: DataFrame) -> rows.RowRule:
    p = spec.params
    if spec.kind == "row":
        return rows.RowRule(spec.rule_id, p["head"], p.get("body"), as_list(p["cols"]) if "cols" in p else None)
    if spec.kind == "not_null":
        return rows.RowRule(spec.rule_id, present(df, as_list(p["cols"])), cols=())
    return rows.RowRule(spec.rule_id, matches(p["col"], p["pattern"]), p.get("body"), [p["col"]])


ROW_KINDS = ("row", "not_null", "pattern")
GROUP_KINDS: dict[str, Callable[..., RuleResult]] = {
    "unique_key": groups.unique_key,
    "functional_dependency": groups.functional_dependency,
    "sum_to_total": groups.sum_to_total,
    "sum_to_threshold": groups.sum_to_threshold,
    "aggregate_constraint": groups.aggregate_constraint,
    "monotonic": order.monotonic,
    "outlier": outliers.outlier,
    "pair_rule": pairs.pair_rule,
}
TABLE_KINDS: dict[str, Callable[..., RuleResult]] = {
    "references": tables.references,
    "cross_table_rule": tables.cross_table_rule,
    "quantified_rule": tables.quantified_rule,
}


def evaluate(spec: RuleSpec, tables_by_name: Mapping[str, DataFrame]) -> RuleResult:
    """One rule on its own."""
    df = tables_by_name[spec.table]
    common = {"row_id": spec.row_id, "rule_id": spec.rule_id}
    if spec.kind in ROW_KINDS:
        rule = _row_rules(spec, df)
        return rows.row_rule(df, rule.head, rule.body, cols=rule.cols, **common)
    if spec.kind in GROUP_KINDS:
        return GROUP_KINDS[spec.kind](df, **{**spec.params, **common})
    if spec.kind in TABLE_KINDS:
        return TABLE_KINDS[spec.kind](df, secondary=tables_by_name[spec.table2], **{**spec.params, **common})
    raise ValueError(f"unknown kind {spec.kind!r}")


def specs_from(catalogue: DataFrame) -> list[RuleSpec]:
    """The executable rules of a catalogue (rule_id, dataset, check). Rules are settings, not data.

    Where the catalogue has ``relevant_columns``, missing values in them take a row out of a row rule that names no
    columns of its own.
    """
    relevant = ["relevant_columns"] if "relevant_columns" in catalogue.columns else []
    specs = []
    for r in catalogue.where(F.col("check").isNotNull()).select("rule_id", "dataset", "check", *relevant).toLocalIterator():
        spec = RuleSpec.from_json(r.rule_id, r.dataset, r.check)
        if relevant and r.relevant_columns and spec.kind == "row":
            spec.params.setdefault("cols", list(r.relevant_columns))
        specs.append(spec)
    return specs


def _group_rule(spec: RuleSpec) -> groups.GroupRule | None:
    """The rule as a condition on an aggregate of its groups, if it is one."""
    p = spec.params
    if spec.kind == "unique_key":
        return groups.GroupRule(spec.rule_id, "count", "agg_value = 1", None, p.get("body"))
    if spec.kind == "aggregate_constraint" and isinstance(p.get("predicate"), str):
        return groups.GroupRule(spec.rule_id, p["agg"], p["predicate"], p.get("value"), p.get("body"), p.get("scale"))
    return None


def portions(specs: Sequence[RuleSpec]) -> list[list[RuleSpec]]:
    """Rules that share their work: row rules of one table, and aggregate rules of one table and key."""
    shared: dict[tuple, list[RuleSpec]] = {}
    for i, spec in enumerate(specs):
        if spec.kind in ROW_KINDS:
            together = ("rows", spec.table, tuple(as_list(spec.row_id)))
        elif spec.kind in GROUP_KINDS and _group_rule(spec) is not None:
            together = ("groups", spec.table, tuple(as_list(spec.params["key"])))
        else:
            together = ("alone", i)
        shared.setdefault(together, []).append(spec)
    return [
        some[i : i + RULES_PER_SCAN] for some in shared.values() for i in range(0, len(some), RULES_PER_SCAN)
    ]


def metrics_plan(specs: Sequence[RuleSpec], tables_by_name: Mapping[str, DataFrame]) -> DataFrame:
    """Metrics of many rules as one DataFrame."""
    return reduce(DataFrame.unionByName, [_portion_metrics(some, tables_by_name) for some in portions(specs)])


def _portion_metrics(some: list[RuleSpec], tables_by_name: Mapping[str, DataFrame]) -> DataFrame:
    first = some[0]
    df = tables_by_name.get(first.table)
    if first.kind in ROW_KINDS:
        return rows.evaluate_row_rules(df, [_row_rules(s, df) for s in some], row_id=first.row_id).metrics
    if len(some) > 1:
        return groups.evaluate_group_rules(df, first.params["key"], [_group_rule(s) for s in some])
    return evaluate(first, tables_by_name).metrics


class TimedOut(Exception):
    """A rule took longer than its limit; its jobs were cancelled."""


class BadOutput(Exception):
    """A user rule returned no participant table."""


def timed(spark: SparkSession, work: Callable[[], object], limit: float | None, pool: str | None = None) -> object:
    """Do ``work`` in this thread; all Spark jobs it starts are cancelled once ``limit`` seconds are over.

    Jobs carry a tag of their own, and the name of a scheduler pool if one is given. Work that starts jobs after its limit gets
    them cancelled as well, until it ends.
    """
    sc = spark.sparkContext
    tag, over, ended = f"rulespan-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if ended.wait(limit):
            return
        over.set()
        while not ended.wait(0.2):
            sc.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    sc.addJobTag(tag)
    sc.setLocalProperty("spark.scheduler.pool", pool)
    if limit is not None:
        watcher.start()
    try:
        found = work()
    except Exception as error:
        if over.is_set():
            raise TimedOut(f"longer than {limit} seconds") from error
        raise
    finally:
        ended.set()
        sc.removeJobTag(tag)
        sc.setLocalProperty("spark.scheduler.pool", None)
    if over.is_set():
        raise TimedOut(f"longer than {limit} seconds")
    return found


def run_catalogue(
    spark: SparkSession,
    specs: Sequence[RuleSpec],
    tables_by_name: Mapping[str, DataFrame],
    path: str,
    *,
    verdicts: Sequence[str] = VERDICTS,
    time_limit: float | None = TIME_LIMIT,
    side_by_side: int = SIDE_BY_SIDE,
    functions: Mapping[str, Callable] | None = None,
) -> DataFrame:
    """Evaluate rules and store their metrics and participants (of ``verdicts``) below ``path``; returns the run log.

    Rules that already have a result there are skipped. A rule whose tables are missing, that fails, takes longer than
    ``time_limit`` seconds or (a user function, named among ``functions``) returns no participants is logged and does not
    stop the others. Rules that share a scan or a shuffle share their time; if they miss the limit together they run again
    one by one.
    """
    store = ResultStore(spark, path)
    named = spark.createDataFrame([(s.rule_id,) for s in specs], "rule_id string")
    todo_ids = {r.rule_id for r in store.pending(named).collect()}
    log: list[tuple] = []
    todo = []
    for spec in specs:
        if spec.rule_id not in todo_ids:
            continue
        if not spec.kind or not spec.table:
            log.append((spec.rule_id, STATUS["missing_info"], None, None, False, None))
        elif spec.table not in tables_by_name or (spec.table2 and spec.table2 not in tables_by_name):
            log.append((spec.rule_id, STATUS["load_failed"], None, None, False, None))
        else:
            todo.append(spec)

    def run(numbered: tuple[int, list[RuleSpec]]) -> list[tuple]:
        return _run_portion(numbered[1], tables_by_name, store, verdicts, time_limit, f"rules-{numbered[0] % side_by_side}", functions or {})

    # Each thread only starts jobs; the work is Spark's.
    with ThreadPoolExecutor(max_workers=max(1, side_by_side)) as threads:
        for entries in threads.map(run, enumerate(portions(todo))):
            log += entries
    return spark.createDataFrame(log, LOG_SCHEMA)


def _portion_results(portion: list[RuleSpec], tables_by_name, verdicts, functions) -> tuple[DataFrame, list[DataFrame]]:
    """Metrics of rules that share their work, and their participants."""
    first = portion[0]
    df = tables_by_name.get(first.table)
    if first.kind == "custom":
        try:
            result = custom.custom_rule(functions[first.params["function"]], df, rule_id=first.rule_id)
        except (ValueError, TypeError, AttributeError) as error:
            raise BadOutput(str(error)) from error
        return result.metrics, [result.participants(verdicts)]
    if first.kind in ROW_KINDS:
        result = rows.evaluate_row_rules(df, [_row_rules(s, df) for s in portion], row_id=first.row_id)
        return result.metrics, [result.participants.where(F.col("verdict").isin(*verdicts))]
    results = [evaluate(s, tables_by_name) for s in portion]
    metrics = _portion_metrics(portion, tables_by_name) if len(portion) > 1 else results[0].metrics
    return metrics, [r.participants(verdicts) for r in results]


def _run_portion(portion, tables_by_name, store: ResultStore, verdicts, limit, pool, functions) -> list[tuple]:
    started = time.monotonic()

    def work() -> str:
        return store.stage(*_portion_results(portion, tables_by_name, verdicts, functions))

    try:
        run = timed(store.spark, work, limit, pool)
        store.commit([s.rule_id for s in portion], run)
    except Exception as error:
        if len(portion) > 1:  # find the rule at fault
            return [e for spec in portion for e in _run_portion([spec], tables_by_name, store, verdicts, limit, pool, functions)]
        kind = "timeout" if isinstance(error, TimedOut) else "bad_output" if isinstance(error, BadOutput) else "error"
        return [(portion[0].rule_id, STATUS[kind], time.monotonic() - started, str(error), False, None)]
    seconds = (time.monotonic() - started) / len(portion)
    return [(spec.rule_id, STATUS["ok"], seconds, None, False, None) for spec in portion]


MULTI_LOG_SCHEMA = LOG_SCHEMA + ", violation_rate double, expected_rate double, rate_matches boolean"


@dataclass(frozen=True)
class InjectionTest:
    """A rule with records to append before it runs, and the violation rate its tables should show."""

    spec: RuleSpec
    instructions: Sequence[Mapping] = ()
    expected_rate: float | None = None


def injection_tests(catalogue: DataFrame) -> list[InjectionTest]:
    """The executable rules of a two-table catalogue (see ``sources.catalogue.load_multi_table_rules``)."""
    tests = []
    for r in catalogue.where(F.col("check").isNotNull()).toLocalIterator():
        spec = RuleSpec.from_json(r.rule_id, r.table1, r.check, r.table2)
        tests.append(InjectionTest(spec, json.loads(r.violation_data_generator or "[]"), r.violation_rate))
    return tests


def run_injection_tests(
    spark: SparkSession, tests: Sequence[InjectionTest], tables_by_name: Mapping[str, DataFrame], tol: float = 1e-6,
    *, time_limit: float | None = TIME_LIMIT, side_by_side: int = SIDE_BY_SIDE,
) -> DataFrame:
    """Append each rule's records, evaluate it, and log whether they were found and the rate is as expected.

    The log is what ``report.run_summary`` sums up. Each rule brings one row of metrics and one of hits back. Rules run side
    by side, each for ``time_limit`` seconds at most.
    """
    def run(numbered: tuple[int, InjectionTest]) -> tuple:
        return _run_injection_test(spark, numbered[1], tables_by_name, tol, time_limit, f"rules-{numbered[0] % side_by_side}")

    with ThreadPoolExecutor(max_workers=max(1, side_by_side)) as threads:
        return spark.createDataFrame(list(threads.map(run, enumerate(tests))), MULTI_LOG_SCHEMA)


def _run_injection_test(
    spark: SparkSession, test: InjectionTest, tables_by_name: Mapping[str, DataFrame], tol: float, limit: float | None, pool: str
) -> tuple:
    spec, expected = test.spec, test.expected_rate
    injected = bool(test.instructions)

    def entry(status: str, seconds=None, error=None, found=None, rate=None) -> tuple:
        # Nothing expected and nothing observed agree as well.
        matches = rate is None and expected is None
        if rate is not None and expected is not None:
            matches = abs(rate - expected) < tol
        return (spec.rule_id, STATUS[status], seconds, error, injected, found, rate, expected, matches)

    if not spec.kind or not spec.table or not spec.table2:
        return entry("missing_info")
    if spec.table not in tables_by_name or spec.table2 not in tables_by_name:
        return entry("load_failed")
    started = time.monotonic()

    def work() -> tuple:
        own = {name: tables_by_name[name] for name in (spec.table, spec.table2)}
        changed, _ = tables.inject(spark, own, test.instructions)
        result = evaluate(spec, changed)
        rate = result.metrics.first().violation_rate
        return rate, _any_found(spark, spec, test.instructions, own[spec.table], result) if injected else None

    try:
        rate, found = timed(spark, work, limit, pool)
    except Exception as error:
        return entry("timeout" if isinstance(error, TimedOut) else "error", time.monotonic() - started, str(error))
    return entry("ok", time.monotonic() - started, found=found, rate=rate)


def _any_found(spark, spec: RuleSpec, instructions: Sequence[Mapping], primary: DataFrame, result: RuleResult) -> bool:
    """Whether a record appended to the primary table is among the violations; records are known by their key."""
    key = as_list(spec.row_id)
    records = [i["record_to_add"] for i in instructions if i.get("table_to_modify") == spec.table and i.get("record_to_add")]
    ids = [tuple(r[c] for c in key) for r in records if all(r.get(c) is not None for c in key)]
    if not ids:
        return False
    wanted = spark.createDataFrame(ids, primary.select(*key).schema).select(row_id_column(key).alias("row_id"))
    return tables.injected_found(result.violations(), wanted).first().any_found
