"""Rules over two tables. Verdict rows belong to the primary table, metrics are over its rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespan.functions.prep import FLOATS, in_scope, normalized_pair, present
from rulespan.model import (
    SATISFACTION,
    VIOLATION,
    RuleResult,
    as_column,
    as_list,
    literal,
    participant_rows,
    quoted,
    row_id_column,
)
from rulespan.operators.metrics import finish
from rulespan.operators.pairs import Compare
from rulespan.operators.report import beside
from rulespan.operators.skew import find_hot, join_groups, running

UNMATCHED = ("exclude", "judge")


def _join_keys(
    primary: DataFrame, left: Sequence[str], secondary: DataFrame, right: Sequence[str]
) -> tuple[dict[str, Column], dict[str, Column], list[str]]:
    """The key columns of both sides under shared names, brought to one type where the types differ."""
    if len(left) != len(right):
        raise ValueError("both sides of a join need the same number of columns")
    pairs = [normalized_pair(primary, a, secondary, b) for a, b in zip(left, right)]
    names = [f"_k{i}" for i in range(len(pairs))]
    return dict(zip(names, (p[0] for p in pairs))), dict(zip(names, (p[1] for p in pairs))), names


def _all_present(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])


def references(
    primary: DataFrame,
    fk: str | Sequence[str],
    secondary: DataFrame,
    pk: str | Sequence[str],
    *,
    row_id: str | Sequence[str],
    body: Column | str | None = None,
    rule_id: str = "references",
) -> RuleResult:
    """Every foreign key of the primary table must exist in the secondary table.

    Foreign keys are counted before they are looked up, so what is joined is one row per distinct key,
    however often a key occurs. Ids of differing type are compared as whole numbers; an id that is no whole
    number is out of scope.
    """
    fk, pk = as_list(fk), as_list(pk)
    left, right, names = _join_keys(primary, fk, secondary, pk)
    scope = in_scope(primary, fk, body)
    rows = primary.select(
        row_id_column(row_id).alias("_row"), *[F.when(scope, c).alias(n) for n, c in left.items()]
    ).withColumn("_ok", _all_present(names))
    known = secondary.select(*[c.alias(n) for n, c in right.items()]).where(_all_present(names)).distinct()
    used = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    looked_up = used.join(known.withColumn("_known", F.lit(True)), names, "left").withColumn(
        "verdict", F.when(_all_present(names), F.when(F.col("_known"), F.lit(SATISFACTION)).otherwise(F.lit(VIOLATION)))
    )

    def rows_where(test: Column) -> Column:
        return F.sum(F.when(test, F.col("_n")))

    counts = looked_up.agg(
        F.sum("_n").alias("total_rows"),
        rows_where(F.col("verdict").isNotNull()).alias("applicable_rows"),
        rows_where(F.col("verdict") == SATISFACTION).alias("sat_rows"),
        rows_where(F.col("verdict") == VIOLATION).alias("viol_rows"),
        F.lit(0).alias("sat_groups"),
        F.lit(0).alias("viol_groups"),
    )

    def find(verdicts: Sequence[str]) -> DataFrame:
        judged = rows.where("_ok").drop("_ok")
        wanted = looked_up.where(F.col("verdict").isin(*verdicts)).select(*names, "verdict")
        joined = join_groups(judged, wanted, names, find_hot(judged, names, primary.count()), F.col("_row"))
        return participant_rows(joined, literal(rule_id))

    return RuleResult(rule_id, "row", finish(counts, rule_id, "row"), find)


def cross_table_rule(
    primary: DataFrame,
    secondary: DataFrame,
    on: Sequence[tuple[str, str]],
    head: Column | str,
    body: Column | str | None = None,
    *,
    row_id: str | Sequence[str],
    cols: str | Sequence[str] = (),
    secondary_cols: str | Sequence[str],
    aggs: Mapping[str, Column] | None = None,
    unmatched: str = "exclude",
    rule_id: str = "cross_table_rule",
) -> RuleResult:
    """A row condition over a primary row and what the secondary table says about its key.

    ``on`` pairs primary and secondary key columns. Without ``aggs`` the secondary table has one row per
    key and ``secondary_cols`` are looked up. With ``aggs`` it may have many: it is folded to the named
    aggregates per key before the join. ``head`` and ``body`` see the primary columns and the looked-up
    ones. Primary rows without a match are out of scope, or judged with NULLs (``unmatched="judge"``).
    """
    if unmatched not in UNMATCHED:
        raise ValueError(f"unmatched must be one of {UNMATCHED}")
    cols, secondary_cols = as_list(cols), as_list(secondary_cols)
    fk = [a for a, _ in on]
    left, right, names = _join_keys(primary, fk, secondary, [b for _, b in on])
    looked = secondary.select(*[c.alias(n) for n, c in right.items()], *secondary_cols).where(_all_present(names))
    if aggs is not None:
        looked = looked.groupBy(*names).agg(*[c.alias(n) for n, c in aggs.items()])
    else:
        # The join deals by the key anyway; a key with several rows would multiply primary rows.
        several = F.raise_error(F.lit(f"{rule_id}: the secondary table has several rows for a key; give aggs or use a quantified rule"))
        folded = looked.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*secondary_cols)).alias("_found"))
        found = F.when(F.col("_n") > 1, several).otherwise(F.col("_found"))
        looked = folded.select(*names, found.alias("_found")).select(*names, *[F.col(f"_found.{quoted(c)}").alias(c) for c in secondary_cols])
    looked = looked.withColumn("_matched", F.lit(True))
    # Rows without a key are out of scope either way; left in the join they would all meet in one task.
    upper = primary.count()
    rows = primary.where(present(primary, fk + cols)).withColumns(left).where(_all_present(names))
    how = "inner" if unmatched == "exclude" else "left"
    joined = join_groups(rows, looked, names, find_hot(rows, names, upper), row_id_column(row_id), how)
    scope = F.coalesce(as_column(body), F.lit(False))
    if aggs is None:
        scope = scope & (F.col("_matched").isNull() | present(joined, secondary_cols))
    holds = F.coalesce(as_column(head), F.lit(False))
    judged = joined.where(scope).select(row_id_column(row_id).alias("_row"), holds.alias("_holds"))
    counts = judged.agg(
        F.count(F.lit(1)).alias("applicable_rows"),
        F.count_if("_holds").alias("sat_rows"),
        F.count_if(~F.col("_holds")).alias("viol_rows"),
        F.lit(0).alias("sat_groups"),
        F.lit(0).alias("viol_groups"),
    ).withColumn("total_rows", F.lit(upper))

    def find(verdicts: Sequence[str]) -> DataFrame:
        verdict = f"if(_holds, '{SATISFACTION}', '{VIOLATION}')"
        return participant_rows(judged, literal(rule_id), verdict=verdict).where(F.col("verdict").isin(*verdicts))

    return RuleResult(rule_id, "row", finish(counts, rule_id, "row"), find)


@dataclass(frozen=True)
class Between:
    """A condition on a row of each table: ``value`` of the primary one lies in ``low`` to ``high`` of the secondary one."""

    value: str
    low: str
    high: str


QUANTIFIERS = ("any", "all")


def quantified_rule(
    primary: DataFrame,
    secondary: DataFrame,
    on: Sequence[tuple[str, str]],
    predicate: Column | str | Compare | Between,
    quantifier: str,
    *,
    row_id: str | Sequence[str],
    secondary_cols: str | Sequence[str] = (),
    primary_cols: str | Sequence[str] = (),
    rule_id: str = "quantified_rule",
) -> RuleResult:
    """Any, or all, secondary rows of a primary row fulfil ``predicate``.

    Without secondary rows "any" is violated and "all" holds; a predicate that is unknown for a secondary row isn't
    fulfilled by it. What the predicate reads decides how it is evaluated, each time without forming pairs:

    * columns of the secondary table: folded to a flag per key;
    * ``Compare`` of a primary with a secondary column, or ``Between``: folded to extremes per key, or looked up among the
      key's intervals in sorted order (see ``_in_some_interval``); costs n log n for a key of any size;
    * anything over columns of both (named in ``primary_cols`` and ``secondary_cols``): a semi or anti join on the key
      with the predicate as a further condition, which stops at a row's first hit. Keys with very many rows in both
      tables are better served by the forms above.

    ``Compare`` and ``Between`` may be given as mappings of their fields.
    """
    if quantifier not in QUANTIFIERS:
        raise ValueError(f"quantifier must be one of {QUANTIFIERS}")
    if isinstance(predicate, Mapping):
        predicate = (Between if "value" in predicate else Compare)(**predicate)
    common = {"row_id": row_id, "rule_id": rule_id}
    if isinstance(predicate, Compare):
        return _compared(primary, secondary, on, predicate, quantifier, **common)
    if isinstance(predicate, Between):
        return _between(primary, secondary, on, predicate, quantifier, **common)
    if as_list(primary_cols):
        return _with_residual(primary, secondary, on, predicate, quantifier, as_list(primary_cols), as_list(secondary_cols), **common)
    test = F.coalesce(as_column(predicate), F.lit(False))
    folded = F.bool_or(test) if quantifier == "any" else F.bool_and(test)
    return cross_table_rule(
        primary, secondary, on, F.coalesce(F.col("_quantified"), F.lit(quantifier == "all")),
        secondary_cols=secondary_cols, aggs={"_quantified": folded}, unmatched="judge", **common)


def _compared(primary, secondary, on, head: Compare, quantifier: str, *, row_id, rule_id) -> RuleResult:
    """``primary.left op secondary.right`` for any or all secondary rows, by the smallest and largest value per key."""
    other = head.right or head.left
    looked = secondary.select(*[F.col(b) for _, b in on], F.col(other).alias("_value"))
    if head.op in ("=", "!=") and (head.op == "=") == (quantifier == "any"):
        return _equal(primary, looked, on, head.left, quantifier == "any", row_id=row_id, rule_id=rule_id)
    if head.op == "within" and quantifier == "any":
        near = looked.select(*[b for _, b in on], (F.col("_value") - F.lit(head.tol)).alias("_low"), (F.col("_value") + F.lit(head.tol)).alias("_high"))
        return _between(primary, near, on, Between(head.left, "_low", "_high"), "any", row_id=row_id, rule_id=rule_id)
    own, low, high = F.col(head.left), F.col("_smallest"), F.col("_largest")
    tests = {
        ("<", "any"): own < high, ("<", "all"): own < low, ("<=", "any"): own <= high, ("<=", "all"): own <= low,
        (">", "any"): own > low, (">", "all"): own > high, (">=", "any"): own >= low, (">=", "all"): own >= high,
        ("=", "all"): (own == low) & (own == high), ("!=", "any"): (own != low) | (own != high),
        ("within", "all"): (own >= high - F.lit(head.tol)) & (own <= low + F.lit(head.tol)),
    }
    known = F.col("_value").isNotNull()
    holds = F.coalesce(tests[head.op, quantifier], F.lit(False))
    if quantifier == "all":
        holds = F.when(F.col("_matched").isNull(), F.lit(True)).otherwise((F.col("_unknown") == 0) & holds)
    aggs = {"_smallest": F.min("_value"), "_largest": F.max("_value"), "_unknown": F.count_if(~known)}
    return cross_table_rule(
        primary, looked, on, holds, row_id=row_id, cols=head.left, secondary_cols="_value", aggs=aggs, unmatched="judge", rule_id=rule_id)


def _equal(primary, looked, on, own: str, wanted: bool, *, row_id, rule_id) -> RuleResult:
    """Whether the value is among the key's values: a lookup of (key, value). An unknown value never differs."""
    value = "_own_value"
    left, right = [*[a for a, _ in on], value], [*[b for _, b in on], "_value"]
    found = references(primary.withColumn(value, F.col(own)), left, looked, right, row_id=row_id, rule_id=rule_id)
    if wanted:
        return found
    unknown = looked.where(F.col("_value").isNull()).select(*[b for _, b in on]).distinct()
    return _either_violates(primary, found, unknown, on, own, row_id=row_id, rule_id=rule_id)


def _either_violates(primary, found: RuleResult, unknown: DataFrame, on, own: str, *, row_id, rule_id) -> RuleResult:
    """All values differ from the row's own: violated where one is equal (``found`` satisfied) or unknown."""
    keys = references(primary.withColumn("_own_value", F.col(own)), [a for a, _ in on], unknown, [b for _, b in on], row_id=row_id,
                      body=F.col("_own_value").isNotNull(), rule_id=rule_id)
    hits = found.satisfactions().unionAll(keys.satisfactions()).select("row_id").distinct()
    scope = in_scope(primary, [*[a for a, _ in on], own], None)
    rows = primary.select(row_id_column(row_id).alias("_row"), scope.alias("_ok"))
    judged = rows.join(hits.select(F.col("row_id").alias("_row"), F.lit(True).alias("_hit")), "_row", "left")
    return _row_result(judged, "_hit IS NULL", rule_id)


def _row_result(judged: DataFrame, holds: str, rule_id: str) -> RuleResult:
    """A row rule from one row per primary row: ``_row``, ``_ok`` (in scope) and a test."""
    counts = judged.selectExpr(
        "count(1) as total_rows", "count_if(_ok) as applicable_rows", f"count_if(_ok and {holds}) as sat_rows",
        f"count_if(_ok and not ({holds})) as viol_rows", "0 as sat_groups", "0 as viol_groups")

    def find(verdicts: Sequence[str]) -> DataFrame:
        verdict = f"if({holds}, '{SATISFACTION}', '{VIOLATION}')"
        return participant_rows(judged.where("_ok"), literal(rule_id), verdict=verdict).where(F.col("verdict").isin(*verdicts))

    return RuleResult(rule_id, "row", finish(counts, rule_id, "row"), find)


def _between(primary, secondary, on, head: Between, quantifier: str, *, row_id, rule_id) -> RuleResult:
    """The value in any or all intervals of its key; an interval with an unknown end holds nothing."""
    looked = secondary.select(*[F.col(b) for _, b in on], F.col(head.low).alias("_low"), F.col(head.high).alias("_high"))
    if quantifier == "all":
        whole = F.col("_low").isNotNull() & F.col("_high").isNotNull()
        aggs = {"_from": F.max("_low"), "_to": F.min("_high"), "_unknown": F.count_if(~whole)}
        own = F.col(head.value)
        holds = F.when(F.col("_matched").isNull(), F.lit(True)).otherwise((F.col("_unknown") == 0) & (own >= F.col("_from")) & (own <= F.col("_to")))
        return cross_table_rule(
            primary, looked, on, holds, row_id=row_id, cols=head.value, secondary_cols=["_low", "_high"], aggs=aggs, unmatched="judge", rule_id=rule_id)
    return _row_result(_in_some_interval(primary, looked, on, head.value, row_id), "_in", rule_id)


def _in_some_interval(primary, looked, on, value: str, row_id) -> DataFrame:
    """``_row``, ``_ok`` and ``_in``: whether some interval of the row's key holds its value.

    Values and intervals of a key go in one order, intervals by their low end. The largest high end so far then tells:
    an interval that began and reaches the value holds it.
    """
    left, right, names = _join_keys(primary, [a for a, _ in on], looked, [b for _, b in on])
    scope = in_scope(primary, [*[a for a, _ in on], value], None)
    rows = primary.select(
        row_id_column(row_id).alias("_row"), *[F.when(scope, c).alias(n) for n, c in left.items()], F.when(scope, F.col(value)).alias("_at"), scope.alias("_ok"))
    rows = rows.withColumn("_ok", F.coalesce("_ok", F.lit(False)) & _all_present(names))
    kind = looked.schema["_low"].dataType
    own = rows.where("_ok").select(*names, F.col("_at").alias("_at"), F.lit(1).alias("_kind"), "_row", F.lit(None).cast(looked.schema["_high"].dataType).alias("_high"))
    reach = looked.select(*[c.alias(n) for n, c in right.items()], "_low", "_high").where(_all_present(names) & F.col("_low").isNotNull())
    # one interval for each low end
    reach = reach.groupBy(*names, "_low").agg(F.max("_high").alias("_high")).select(
        *names, F.col("_low").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_high")
    if rows.schema["_at"].dataType != kind:
        both = T.DoubleType() if isinstance(kind, FLOATS) or isinstance(rows.schema["_at"].dataType, FLOATS) else T.DecimalType(38, 6)
        own, reach = (x.withColumn("_at", F.col("_at").cast(both)) for x in (own, reach))
        own, reach = (x.withColumn("_high", F.col("_high").cast(both)) for x in (own, reach))
    events = own.unionByName(reach)
    far = running(events, names, ["_at", "_kind", "_row"], {"_far": ("max", "_high")}, find_hot(events, names))
    inside = far.where("_kind = 1").select("_row", F.lit(True).alias("_ok"), F.coalesce(F.col("_far") >= F.col("_at"), F.lit(False)).alias("_in"))
    outside = rows.where("NOT _ok").select("_row", F.lit(False).alias("_ok"), F.lit(False).alias("_in"))
    return inside.unionAll(outside)


def _with_residual(primary, secondary, on, predicate, quantifier: str, primary_cols, secondary_cols, *, row_id, rule_id) -> RuleResult:
    """A predicate over columns of both tables: semi and anti join on the key, the predicate as a further condition."""
    clash = set(primary_cols) & set(secondary_cols)
    if clash:
        raise ValueError(f"columns of both tables have the same name: {sorted(clash)}; rename one side")
    left, right, names = _join_keys(primary, [a for a, _ in on], secondary, [b for _, b in on])
    scope = in_scope(primary, [*[a for a, _ in on], *primary_cols], None)
    rows = primary.select(row_id_column(row_id).alias("_row"), *[c.alias(n) for n, c in left.items()], *primary_cols, scope.alias("_ok"))
    judged = rows.where(F.col("_ok") & _all_present(names)).drop("_ok")
    looked = secondary.select(*[c.alias(f"{n}_of") for n, c in right.items()], *secondary_cols)
    test = F.coalesce(as_column(predicate), F.lit(False))
    condition = reduce(lambda a, b: a & b, [F.col(n) == F.col(f"{n}_of") for n in names]) & (test if quantifier == "any" else ~test)
    hit, missed = (judged.join(looked, condition, how).select("_row") for how in ("left_semi", "left_anti"))
    satisfied, violated = (hit, missed) if quantifier == "any" else (missed, hit)
    sides = {SATISFACTION: satisfied, VIOLATION: violated}
    counts = rows.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("_ok") & _all_present(names)).alias("applicable_rows"))
    counts = counts.withColumn("_hits", hit.agg(F.count(F.lit(1))).scalar())
    found = "sat_rows" if quantifier == "any" else "viol_rows"
    other = "viol_rows" if quantifier == "any" else "sat_rows"
    counts = counts.selectExpr("*", f"_hits as {found}", f"applicable_rows - _hits as {other}", "0 as sat_groups", "0 as viol_groups")

    def find(verdicts: Sequence[str]) -> DataFrame:
        parts = [participant_rows(sides[v], literal(rule_id), verdict=literal(v)) for v in verdicts]
        return reduce(DataFrame.unionAll, parts)

    return RuleResult(rule_id, "row", finish(counts, rule_id, "row"), find)


def inject(
    spark: SparkSession, tables: Mapping[str, DataFrame], instructions: Sequence[Mapping]
) -> tuple[dict[str, DataFrame], list]:
    """Append the records of ``[{"table_to_modify": ..., "record_to_add": {...}}]`` to their tables.

    Returns the new table set and the ids (``_id``) of the appended records. An instruction that is
    incomplete or names no table of the set is left out. Columns a record lacks become NULL.
    """
    records: dict[str, list[Mapping]] = {}
    ids = []
    for step in instructions:
        name, record = step.get("table_to_modify"), step.get("record_to_add")
        if not name or not record or name not in tables:
            continue
        records.setdefault(name, []).append(record)
        if record.get("_id") is not None:
            ids.append(record["_id"])
    changed = dict(tables)
    for name, added in records.items():
        table = tables[name]
        fields = [f for f in table.schema.fields if any(f.name in r for r in added)]
        extra = sorted({c for r in added for c in r} - {f.name for f in fields})
        rows = [tuple(r.get(f.name) for f in fields) + tuple(r.get(c) for c in extra) for r in added]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        if extra:
            inferred = spark.createDataFrame([tuple(row[len(fields):]) for row in rows], extra)
            schema = ", ".join(filter(None, [schema, *(f"`{f.name}` {f.dataType.simpleString()}" for f in inferred.schema)]))
        changed[name] = table.unionByName(spark.createDataFrame(rows, schema), allowMissingColumns=True)
    return changed, ids


def injected_found(participants: DataFrame, injected: DataFrame) -> DataFrame:
    """One row: how many injected ids there are, how many were reported as violations, and whether any was.

    ``injected`` has one column ``row_id`` of the type of the participants' row ids.
    """
    violating = participants.where(F.col("verdict") == VIOLATION).select("row_id").distinct()
    marked = injected.distinct().join(violating.withColumn("_hit", F.lit(True)), "row_id", "left")
    hits = F.count_if(F.col("_hit").isNotNull())
    return marked.agg(
        F.count(F.lit(1)).alias("injected"), hits.alias("found"), (hits > 0).alias("any_found")
    )


def violation_rate_check(metrics: DataFrame, expected: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Observed against expected violation rate per rule; ``expected`` has rule_id, expected_rate."""
    return beside(metrics.select("rule_id", "violation_rate"), expected.select("rule_id", "expected_rate")).withColumn(
        "rate_matches", F.abs(F.col("violation_rate") - F.col("expected_rate")) < F.lit(tol)
    )
