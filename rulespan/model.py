"""What a rule evaluation returns.

``metrics`` is one row; ``participants`` is long: one row per (verdict, group, representation, role, row).
Nothing is nested, so no group is ever gathered into one value unless ``operators.metrics.nest`` is asked to.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SATISFACTION = "satisfaction"
VIOLATION = "violation"
VERDICTS = (SATISFACTION, VIOLATION)

KEY_TYPE = "array<struct<col:string,val:string>>"
PARTICIPANT_COLUMNS = ["rule_id", "verdict", "group_key", "rep_id", "role", "role_key", "row_id"]
METRIC_COLUMNS = [
    "rule_id", "rule_class", "total_rows", "applicable_rows", "sat_rows", "viol_rows",
    "sat_groups", "viol_groups", "support", "confidence", "violation_rate",
]


@dataclass(frozen=True)
class RuleResult:
    """Metrics of a rule, its per-group table (group rules) and its participants, built on demand."""

    rule_id: str
    rule_class: str
    metrics: DataFrame
    find: Callable[[Sequence[str]], DataFrame]
    groups: DataFrame | None = None

    def participants(self, verdicts: Sequence[str] = VERDICTS) -> DataFrame:
        unknown = set(verdicts) - set(VERDICTS)
        if unknown:
            raise ValueError(f"unknown verdicts: {sorted(unknown)}")
        return self.find(tuple(verdicts))

    def violations(self) -> DataFrame:
        return self.participants([VIOLATION])

    def satisfactions(self) -> DataFrame:
        return self.participants([SATISFACTION])


def as_list(cols: str | Sequence[str] | None) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def as_column(expr: Column | str | None, default: bool = True) -> Column:
    """A condition given as a Column, as SQL text, or left out."""
    if expr is None:
        return F.lit(default)
    return F.expr(expr) if isinstance(expr, str) else expr


def row_id_column(row_id: str | Sequence[str]) -> Column:
    """The row identity: the column itself, or a struct when the key has several columns."""
    names = as_list(row_id)
    return F.col(names[0]) if len(names) == 1 else F.struct(*names)


def quoted(name: str) -> str:
    """A column name in SQL text."""
    return "`" + name.replace("`", "``") + "`"


def literal(value: str) -> str:
    """A string constant in SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def key_sql(cols: Sequence[str]) -> str:
    """``[(col, val), ...]``: group keys and role keys always carry the column name."""
    pairs = [f"named_struct('col', {literal(c)}, 'val', cast({quoted(c)} as string))" for c in cols]
    return f"array({', '.join(pairs)})"


def participant_rows(
    df: DataFrame,
    rule_id: str,
    *,
    verdict: str = "verdict",
    row: str = "_row",
    group_key: str = "null",
    rep_id: str = "null",
    role: str = "null",
    role_key: str = "null",
) -> DataFrame:
    """Project ``df`` to the participant layout; every argument is SQL over the columns of ``df``."""
    return df.selectExpr(
        f"{rule_id} as rule_id",
        f"{verdict} as verdict",
        f"cast({group_key} as {KEY_TYPE}) as group_key",
        f"cast({rep_id} as string) as rep_id",
        f"cast({role} as string) as role",
        f"cast({role_key} as {KEY_TYPE}) as role_key",
        f"{row} as row_id",
    )
