"""Row preparation: null exclusion, rule bodies, id normalisation, typed columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespan.model import as_column

FLOATS = (T.FloatType, T.DoubleType)


def present(df: DataFrame, cols: Sequence[str]) -> Column:
    """True where none of ``cols`` is missing; NaN counts as missing, as NULL does."""
    tests = []
    for name in cols:
        test = F.col(name).isNotNull()
        if isinstance(df.schema[name].dataType, FLOATS):
            test = test & ~F.isnan(name)
        tests.append(test)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def in_scope(df: DataFrame, cols: Sequence[str], body: Column | str | None) -> Column:
    """True for rows a rule looks at: no relevant column missing, and the body (if any) holds.

    Where the body is unknown this is NULL, which every use takes as false; wrapping it would keep it from
    being pushed into the scan.
    """
    scope = present(df, cols)
    return scope if body is None else scope & as_column(body)


def _judges_missing(expr) -> bool:
    return expr.nodeName().lower() in ("isnull", "isnotnull", "coalesce", "isnan", "equalnullsafe", "nvl", "ifnull", "nullif")


def relevant_columns(df: DataFrame, *conditions: Column | str | None) -> list[str]:
    """The top-level columns that conditions read, but for those whose missing values they ask about themselves.

    Columns are known by what a condition resolves to, however it writes them (``A`` for ``a``, ``df.a``). This asks the
    analysed plan, which a Spark Connect session doesn't hand out: name the columns of a rule there.
    """
    found: dict[str, None] = {}
    output = df._jdf.queryExecution().analyzed().output()
    own = {output.apply(i).exprId().id(): name for i, name in enumerate(df.columns)}

    def visit(expr) -> None:
        if _judges_missing(expr):
            return
        if expr.getClass().getSimpleName() == "AttributeReference" and expr.exprId().id() in own:
            found[own[expr.exprId().id()]] = None
        children = expr.children()
        for i in range(children.size()):
            visit(children.apply(i))

    for condition in conditions:
        if condition is not None:
            expressions = df.select(as_column(condition))._jdf.queryExecution().analyzed().expressions()
            for i in range(expressions.size()):
                visit(expressions.apply(i))
    return list(found)


def exclude_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def coerce(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Give mistyped text columns their type; text that does not parse becomes NULL instead of failing."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def normalize_id(col: Column, left: T.DataType, right: T.DataType) -> Column:
    """Bring an id to bigint when the two sides of a comparison differ in type.

    Text goes through decimal and not double, which would lose digits above 2^53. Text that is no whole
    number and NaN become NULL.
    """
    if left == right:
        return col
    number = col.cast("string").try_cast("decimal(38,6)") if not isinstance(left, FLOATS) else col
    whole = F.when(number == F.floor(number), number)
    return whole.try_cast("bigint")


def normalized_pair(
    left: DataFrame, left_col: str, right: DataFrame, right_col: str
) -> tuple[Column, Column]:
    """Both sides of an id comparison as columns of one type."""
    lt, rt = left.schema[left_col].dataType, right.schema[right_col].dataType
    if isinstance(lt, T.IntegralType) and isinstance(rt, T.IntegralType):
        return F.col(left_col).cast("bigint"), F.col(right_col).cast("bigint")
    return normalize_id(F.col(left_col), lt, rt), normalize_id(F.col(right_col), rt, lt)


def matches(col: Column | str, pattern: str) -> Column:
    """Regex test on the text form of a value, whatever its type."""
    value = F.col(col) if isinstance(col, str) else col
    return value.cast("string").rlike(pattern)


COMPARISONS = {
    "<": lambda a, b, tol: a < b + tol,
    "<=": lambda a, b, tol: a <= b + tol,
    ">": lambda a, b, tol: a > b - tol,
    ">=": lambda a, b, tol: a >= b - tol,
    "=": lambda a, b, tol: F.abs(a - b) <= tol,
    "!=": lambda a, b, tol: F.abs(a - b) > tol,
}


def compare(left: Column, op: str, right: Column, tol: float | int = 0) -> Column:
    """``left op right`` where values within ``tol`` count as equal; strict operators take no tolerance."""
    if op not in COMPARISONS:
        raise ValueError(f"unknown comparison {op!r}; use one of {sorted(COMPARISONS)}")
    if op in ("<", ">"):
        tol = 0
    return COMPARISONS[op](left, right, F.lit(tol))
