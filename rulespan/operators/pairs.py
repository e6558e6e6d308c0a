"""Pair rules: any two related rows must agree, or compare as a condition says.

The pairs of a group are counted and described, never listed: a group of n rows has n(n-1)/2 of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespan.model import SATISFACTION, VIOLATION, RuleResult, as_list, key_sql, literal, participant_rows
from rulespan.operators.dominance import BELOW, POINT, UP_TO, counted
from rulespan.operators.groups import judgeable, scoped
from rulespan.operators.metrics import GROUP_COUNT_TYPE, finish
from rulespan.operators.skew import find_hot, join_groups
from rulespan.session import checkpointed


def _pairs(n: Column) -> Column:
    """Twice the number of pairs among n rows, wide enough for very large groups."""
    return n.cast("decimal(19,0)") * (n - 1).cast("decimal(19,0)")


#: A comparison read from the other row.
MIRRORED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "=", "!=": "!=", "within": "within"}
#: Rows before a row that fulfil "theirs op ours": whether all rows before it are the start of the sum, and the thresholds
#: that are added or taken off: (sign, kind, sign of the tolerance).
COUNTS = {
    "<": (0, [(1, BELOW, 0)]),
    "<=": (0, [(1, UP_TO, 0)]),
    ">": (1, [(-1, UP_TO, 0)]),
    ">=": (1, [(-1, BELOW, 0)]),
    "=": (0, [(1, UP_TO, 0), (-1, BELOW, 0)]),
    "!=": (1, [(-1, UP_TO, 0), (1, BELOW, 0)]),
    "within": (0, [(1, UP_TO, 1), (-1, BELOW, -1)]),
}


@dataclass(frozen=True)
class Compare:
    """A condition on two rows: ``left`` of the earlier one ``op`` ``right`` (else the same column) of the later one.

    ``op`` is one of < <= > >= = != and "within", which asks for right - tol <= left <= right + tol.
    """

    left: str
    op: str
    right: str | None = None
    tol: float | int = 0

    def __post_init__(self) -> None:
        if self.op not in COUNTS:
            raise ValueError(f"unknown comparison {self.op!r}; use one of {sorted(COUNTS)}")
        if self.tol and self.op != "within":
            raise ValueError("only 'within' takes a tolerance")


def _common_type(df: DataFrame, head: Compare) -> T.DataType:
    """The type both sides are compared in: exact for whole numbers and for sides of one type."""
    left, right = (df.schema[c].dataType for c in (head.left, head.right or head.left))
    whole = all(isinstance(t, T.IntegralType) for t in (left, right)) and float(head.tol).is_integer()
    if head.op != "within" and left == right:
        return left
    return T.DecimalType(22, 0) if whole else T.DoubleType()


def compared_pairs(
    df: DataFrame,
    match: str | Sequence[str],
    head: Compare,
    *,
    row_id: str | Sequence[str],
    order: str | Sequence[str] | None = None,
    body: Column | str | None = None,
    rule_id: str = "pair_rule",
) -> RuleResult:
    """For two rows equal on ``match``, the earlier and the later one in ``order`` must fulfil ``head``.

    Rows of the same place in ``order`` are no pair. For each row its satisfied and violating partners on either side are
    counted (``dominance.counted``), which gives the number of pairs and each row's verdicts; no pair is formed. Those
    counts are made and written when the rule is built. Participants have the roles ``earlier`` and ``later``.
    """
    match = as_list(match)
    order = as_list(order) or as_list(row_id)
    kind = _common_type(df, head)
    right = head.right or head.left
    rows = scoped(df, match, [*match, *order, head.left, right], body, row_id, {
        "_left": F.col(head.left).cast(kind), "_right": F.col(right).cast(kind), "_o": F.struct(*[F.col(c) for c in order])})
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    # The group's hash stands for the group: two of them would have to share 64 bits to be taken as one.
    judged = rows.where("_ok").drop("_ok").withColumn("_g", F.xxhash64(*[F.struct(F.col(c)) for c in match]))

    def side(points: str, thresholds: str, op: str, descending: bool) -> DataFrame:
        """Per row its partners before it (behind it, if descending), and those that fulfil the condition."""
        start, parts = COUNTS[op]
        base = judged.select("_g", "_o", *match, "_row", points, thresholds)
        none = [F.lit(None).cast(judged.schema[c].dataType).alias(c) for c in (*match, "_row")]
        events = [base.select("_g", "_o", F.col(points).alias("_v"), F.lit(POINT).alias("_t"), *none, F.lit(0).alias("_w"))]
        for sign, place, offset in parts:
            threshold = F.col(thresholds) + F.lit(offset * head.tol).cast(kind) if offset and head.tol else F.col(thresholds)
            events.append(base.select("_g", "_o", threshold.cast(kind).alias("_v"), F.lit(place).alias("_t"), *match, "_row", F.lit(sign).alias("_w")))
        found = counted(reduce(DataFrame.unionAll, events), descending)
        kept = F.any_value("_before") if start else F.lit(0)
        return found.groupBy(*match, "_row").agg(F.any_value("_before").alias("_pairs"), (kept + F.sum(F.col("_w") * F.col("_hits"))).alias("_sat"))

    later = side("_left", "_right", head.op, False).select(*match, "_row", F.lit("later").alias("_role"), "_pairs", "_sat")
    earlier = side("_right", "_left", MIRRORED[head.op], True).select(*match, "_row", F.lit("earlier").alias("_role"), "_pairs", "_sat")
    sides = checkpointed(later.unionAll(earlier).where("_pairs > 0"))
    as_later = F.when(F.col("_role") == "later", F.col("_sat")), F.when(F.col("_role") == "later", F.col("_pairs") - F.col("_sat"))
    wide = [F.sum(c.cast("decimal(38,0)")) for c in as_later]
    pairs = sides.agg(wide[0].alias("sat_groups"), wide[1].alias("viol_groups"))
    per_row = sides.groupBy(*match, "_row").agg(F.max(F.col("_sat") > 0).alias("sat"), F.max(F.col("_sat") < F.col("_pairs")).alias("viol"))
    counts = per_row.agg(
        F.count(F.lit(1)).alias("applicable_rows"), F.count_if("sat").alias("sat_rows"), F.count_if("viol").alias("viol_rows"),
    ).withColumn("_units", pairs.select(F.struct("sat_groups", "viol_groups")).scalar())
    metrics = finish(counts.select("*", "_units.*").withColumn("total_rows", total), rule_id, "pair")

    def find(verdicts: Sequence[str]) -> DataFrame:
        told = F.array_compact(F.array(
            F.when((F.col("_sat") > 0) & F.lit(SATISFACTION in verdicts), F.lit(SATISFACTION)),
            F.when((F.col("_sat") < F.col("_pairs")) & F.lit(VIOLATION in verdicts), F.lit(VIOLATION))))
        return participant_rows(
            sides.withColumn("_verdict", F.explode(told)), literal(rule_id), verdict="_verdict", group_key=key_sql(match), role="_role")

    return RuleResult(rule_id, "pair", metrics, find)


def pair_rule(
    df: DataFrame,
    match: str | Sequence[str],
    agree: str | Sequence[str] | None = None,
    head: Compare | None = None,
    *,
    row_id: str | Sequence[str],
    order: str | Sequence[str] | None = None,
    body: Column | str | None = None,
    rule_id: str = "pair_rule",
) -> RuleResult:
    """Two rows equal on ``match`` must be equal on ``agree``, or fulfil ``head``; every such pair is one verdict.

    With ``head`` the pair is an earlier and a later row in ``order`` (the row id, unless given), see ``compared_pairs``.

    Rows of a group fall into blocks by their ``agree`` values. The satisfied pairs are exactly those
    inside a block, the violating ones those across two blocks of a group, so the participant table (group
    key, block as role key, row) determines all pairs while staying as long as the table. A row takes part
    on both sides when it has partners inside and outside its block.
    """
    if (agree is None) == (head is None):
        raise ValueError("give either agree or head")
    if head is not None:
        head = Compare(**head) if isinstance(head, dict) else head
        return compared_pairs(df, match, head, row_id=row_id, order=order, body=body, rule_id=rule_id)
    match, agree = as_list(match), as_list(agree)
    rows = scoped(df, match, match + agree, body, row_id, {c: F.col(c) for c in agree if c not in match})
    extra = [c for c in agree if c not in match]
    blocks = rows.groupBy(*match, *extra).agg(F.count(F.lit(1)).alias("_block"))
    outside, inside = F.col("_group") > F.col("_block"), F.col("_block") > 1
    sizes = blocks.groupBy(*match).agg(
        F.sum("_block").alias("_group"),
        F.sum(_pairs(F.col("_block"))).alias("_same"),
        F.sum(F.when(F.col("_block") > 1, F.col("_block"))).alias("_paired"),
        F.count(F.lit(1)).alias("_blocks"),
    )
    ok = F.expr(judgeable(match))
    counts = sizes.agg(
        F.sum("_group").alias("total_rows"),
        F.sum(F.when(ok & (F.col("_group") > 1), F.col("_group"))).alias("applicable_rows"),
        F.sum(F.when(ok, F.col("_paired"))).alias("sat_rows"),
        # With a second block in the group every row has a partner outside its own.
        F.sum(F.when(ok & (F.col("_blocks") > 1), F.col("_group"))).alias("viol_rows"),
        (F.sum(F.when(ok, F.col("_same"))) / 2).cast(GROUP_COUNT_TYPE).alias("sat_groups"),
        (F.sum(F.when(ok, _pairs(F.col("_group")) - F.col("_same"))) / 2).cast(GROUP_COUNT_TYPE).alias("viol_groups"),
    )
    metrics = finish(counts, rule_id, "pair")

    def find(verdicts: Sequence[str]) -> DataFrame:
        upper = df.count()
        paired = sizes.where(ok & (F.col("_group") > 1)).select(*match, "_group")
        sized = blocks.where(ok)
        sized = join_groups(sized, paired, match, find_hot(sized, match, upper), F.struct(*agree))
        sides = F.array_compact(
            F.array(
                F.when(inside & F.lit(SATISFACTION in verdicts), F.lit(SATISFACTION)),
                F.when(outside & F.lit(VIOLATION in verdicts), F.lit(VIOLATION)),
            )
        )
        sized = sized.withColumn("_sides", sides).where(F.size("_sides") > 0).select(*match, *extra, "_sides")
        in_rule = rows.where("_ok").drop("_ok")
        key = match + extra
        joined = join_groups(in_rule, sized, key, find_hot(in_rule, key, upper), F.col("_row"))
        return participant_rows(
            joined.withColumn("_side", F.explode("_sides")), literal(rule_id), verdict="_side",
            group_key=key_sql(match), role="'block'", role_key=key_sql(agree),
        )

    return RuleResult(rule_id, "pair", metrics, find)
