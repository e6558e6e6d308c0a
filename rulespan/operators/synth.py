"""Test data with a known share of violations: one layout per rule class, or the columns of a given rule."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rulespan.model import as_list

#: Rows per group in the layouts of group rules.
GROUP_SIZE = 5
#: Of any 1000 units in a row, exactly violation_rate * 1000 violate.
CYCLE = 1000
#: A step coprime to the cycle, so consecutive units do not violate together.
STEP = 619

KINDS = ("row", "unique", "fd", "sum_to_total", "monotonic", "reference")


def planted(unit: Column, violation_rate: float, seed: int) -> Column:
    return F.pmod(unit * STEP + seed, F.lit(CYCLE)) < round(violation_rate * CYCLE)


def synthesize_from(ids: DataFrame, kind: str, violation_rate: float, seed: int = 42) -> DataFrame:
    """One generated row per id of the one-column table ``ids`` (0, 1, 2, ... for whole groups).

    Every layout has row_id, unit (the row or group that is judged) and planted (whether it violates):

    row           category, price: books must cost less than 100
    unique        code: unique; a planted unit of two rows shares one
    fd            unit determines label
    sum_to_total  kind, amount: the parts of a unit add up to its total
    monotonic     position, salary: within a unit a higher position earns strictly more
    reference     target: an existing unit number; planted rows refer to a negative one
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; use one of {KINDS}")
    n = F.col("row_id")
    size = {"row": 1, "reference": 1, "unique": 2}.get(kind, GROUP_SIZE)
    base = ids.select(F.col(ids.columns[0]).cast("bigint").alias("row_id"))
    base = base.withColumn("unit", F.floor(n / size).cast("bigint"))
    base = base.withColumn("planted", planted(F.col("unit"), violation_rate, seed))
    place = F.pmod(n, F.lit(size))
    unit, bad, last = F.col("unit"), F.col("planted"), place == size - 1
    columns = {
        "row": {
            "category": F.lit("book"),
            "price": F.when(bad, 100.0 + F.pmod(n, F.lit(50))).otherwise(1.0 + F.pmod(n, F.lit(99))),
        },
        "unique": {"code": F.when(bad, unit * 2).otherwise(n)},
        "fd": {"label": F.concat(F.lit("v"), F.when(bad & last, unit + 1).otherwise(unit).cast("string"))},
        "sum_to_total": {
            "kind": F.when(last, F.lit("total")).otherwise(F.lit("part")),
            "amount": F.when(last, (size - 1) * 10.0 + F.when(bad, 1.0).otherwise(0.0)).otherwise(F.lit(10.0)),
        },
        "monotonic": {
            "position": place.cast("int"),
            "salary": F.when(bad & last, (place - 1) * 100.0).otherwise(place * 100.0),
        },
        "reference": {"target": F.when(bad, -unit - 1).otherwise(unit)},
    }
    return base.withColumns(columns[kind])


def synthesize(spark: SparkSession, kind: str, n: int = 100_000, violation_rate: float = 0.1, seed: int = 42) -> DataFrame:
    """``n`` generated rows, produced on the executors."""
    return synthesize_from(spark.range(n), kind, violation_rate, seed)


#: Rounds of the permutation; each decides for every pair of numbers whether they change places.
ROUNDS = 32


def permuted(number: Column, n: int, seed: int) -> Column:
    """A permutation of 0 to n - 1 that looks random, computed row by row: no sort, no shuffle, any n.

    In each round a key pairs the numbers x and key - x (modulo n), and a hash of the larger one of a pair says whether the
    two change places. Such a round is its own inverse, so all of them together are one to one.
    """
    if n < 1:
        return number
    keys = random.Random(seed)
    rounds = F.array(*[F.struct(F.lit(keys.randrange(n)).cast("long").alias("k"), F.lit(i).alias("i")) for i in range(ROUNDS)])

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(r["k"] - x, F.lit(n).cast("long"))
        return F.when(F.pmod(F.xxhash64(F.greatest(x, other), r["i"], F.lit(seed)), F.lit(2)) == 0, other).otherwise(x)

    return F.aggregate(rounds, number.cast("long"), swap)


@dataclass(frozen=True)
class Condition:
    """A comparison of a column with a number, from which values on both sides can be made."""

    col: str
    op: str
    value: float

    OPS = ("<", "<=", ">", ">=", "=", "!=")

    def __post_init__(self) -> None:
        if self.op not in self.OPS:
            raise ValueError(f"unknown comparison {self.op!r}; use one of {self.OPS}")

    @property
    def sql(self) -> str:
        return f"`{self.col}` {self.op} {self.value!r}"

    def values(self, holds: Column, spread: Column) -> Column:
        """Numbers that fulfil the condition where ``holds`` is true and fail it elsewhere; ``spread`` (0 to 99) varies them."""
        at, away = F.lit(float(self.value)), spread + 1.0
        low, high = at - away, at + away
        good = {"<": low, "<=": at - spread, ">": high, ">=": at + spread, "=": at, "!=": high}[self.op]
        bad = {"<": at + spread, "<=": high, ">": at - spread, ">=": low, "=": low, "!=": at}[self.op]
        return F.when(holds, good).otherwise(bad)


#: Kinds of rules that data can be made for, with the columns of each that may be missing.
RULE_KINDS = ("row", "not_null", "unique_key", "functional_dependency", "monotonic", "sum_to_threshold", "references")


def synthesize_rule(
    spark: SparkSession,
    kind: str,
    params: Mapping,
    row_id: str = "row_id",
    n: int = 100_000,
    violation_rate: float = 0.1,
    out_of_scope: float = 0.0,
    missing: float = 0.0,
    seed: int = 42,
) -> dict[str, DataFrame]:
    """Tables for a given rule: ``primary``, and ``secondary`` where the rule has one.

    ``params`` are the parameters of the rule's kind: ``head`` and ``body`` as ``Condition`` (row), ``cols`` (not_null), ``key``,
    ``lhs`` and ``rhs``, ``rank`` and ``value``, ``threshold``, ``fk`` and ``pk``. Rules judge units: a row, or a group of
    ``GROUP_SIZE`` rows. Of the ``n`` rows, taken in whole units, exactly round(missing * units) have a missing value in a column
    the rule needs, round(out_of_scope * units) of the others fail its body, and of the rest round(violation_rate * rest) violate.
    The rule's support and rates follow from these numbers exactly. Which units they are is a permutation of all units,
    made row by row on the executors. ``planted`` names each row's part: missing, outside, violation or satisfaction.
    """
    if kind not in RULE_KINDS:
        raise ValueError(f"unknown kind {kind!r}; use one of {RULE_KINDS}")
    if out_of_scope and not params.get("body"):
        raise ValueError("rows out of scope need a rule with a body")
    size = {"row": 1, "not_null": 1, "references": 1}.get(kind, GROUP_SIZE)
    units = n // size
    lost = round(missing * units)
    outside = round(out_of_scope * (units - lost))
    bad = round(violation_rate * (units - lost - outside))
    base = spark.range(units * size).select(F.col("id").alias(row_id)).withColumn("_unit", F.floor(F.col(row_id) / size).cast("long"))
    base = base.withColumn("_at", permuted(F.col("_unit"), units, seed))
    part = F.when(F.col("_at") < lost, "missing").when(F.col("_at") < lost + outside, "outside").when(
        F.col("_at") < lost + outside + bad, "violation").otherwise("satisfaction")
    base = base.withColumn("planted", part)
    made = base.withColumns(_rule_columns(kind, params, size, row_id))
    body = params.get("body")
    if body is not None and body.col not in made.columns:
        made = made.withColumn(body.col, body.values(F.col("planted") != "outside", F.pmod(F.col(row_id), F.lit(100))))
    # The missing value is in the first column that the rule needs.
    needed = _needed(kind, params)
    whole = F.col("planted") != "missing"
    made = made.withColumn(needed, F.when(whole, F.col(f"`{needed}`")))
    tables = {"primary": made.drop("_unit", "_at")}
    if kind == "references":
        tables["secondary"] = spark.range(max(1, units)).select(F.col("id").alias(as_list(params["pk"])[0]))
    return tables


def _needed(kind: str, params: Mapping) -> str:
    named = {"row": "head", "not_null": "cols", "unique_key": "key", "functional_dependency": "rhs", "monotonic": "value", "sum_to_threshold": "value", "references": "fk"}
    found = params[named[kind]]
    return found.col if isinstance(found, Condition) else as_list(found)[0]


def _keys(cols: Sequence[str], unit: Column) -> dict[str, Column]:
    """A unit's key in several columns: its number in the first, parts of it in the others."""
    return {c: unit if i == 0 else F.pmod(unit, F.lit(7 * i)) for i, c in enumerate(as_list(cols))}


def _rule_columns(kind: str, params: Mapping, size: int, row_id: str) -> dict[str, Column]:
    unit, place, spread = F.col("_unit"), F.pmod(F.col(row_id), F.lit(size)), F.pmod(F.col(row_id), F.lit(100))
    bad, last = F.col("planted") == "violation", F.pmod(F.col(row_id), F.lit(size)) == size - 1
    if kind == "row":
        return {params["head"].col: params["head"].values(~bad, spread)}
    if kind == "not_null":
        # a missing value is what this rule is about
        return {c: F.when(~bad, F.concat(F.lit("v"), spread)) for c in as_list(params["cols"])}
    if kind == "unique_key":
        # a satisfying unit has a key for each row, a violating one a key for all
        return _keys(params["key"], F.when(bad, unit * size).otherwise(F.col(row_id)))
    if kind == "functional_dependency":
        value = F.concat(F.lit("v"), F.when(bad & last, unit + 1).otherwise(unit))
        return _keys(params["lhs"], unit) | dict.fromkeys(as_list(params["rhs"]), value)
    if kind == "monotonic":
        return _keys(params["key"], unit) | {
            params["rank"]: place.cast("int"), params["value"]: F.when(bad & last, (place - 1) * 100.0).otherwise(place * 100.0)}
    if kind == "sum_to_threshold":
        limit = float(params["threshold"])
        return _keys(params["key"], unit) | {params["value"]: F.lit(limit / size) + F.when(bad & last, 1.0).otherwise(0.0)}
    return {as_list(params["fk"])[0]: F.when(bad, -unit - 1).otherwise(unit)}
