"""Column expressions shared by the operators.

All of them keep NULL as the only "missing" value: NaN and infinities never enter a
frame (sources convert NaN to NULL, divisions guard the denominator).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clip(value: ColumnLike, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value and keep NULL as NULL (least/greatest alone would skip it)."""
    column = as_col(value)
    bounded = column
    if low is not None:
        bounded = F.greatest(bounded, F.lit(float(low)))
    if high is not None:
        bounded = F.least(bounded, F.lit(float(high)))
    return F.when(column.isNotNull(), bounded)


def ratio(numerator: ColumnLike, denominator: ColumnLike) -> Column:
    """Division that yields NULL for a zero denominator."""
    return as_col(numerator) / F.nullif(as_col(denominator).cast("double"), F.lit(0.0))


def share(part: ColumnLike, whole: ColumnLike, otherwise: float) -> Column:
    """part / whole limited to [0, 1]; `otherwise` when whole is not positive."""
    whole = as_col(whole)
    return F.when(whole > 0, clip(ratio(part, whole), 0.0, 1.0)).otherwise(F.lit(float(otherwise)))


def to_number(column: ColumnLike) -> Column:
    """Lenient conversion to double: text that does not parse and NaN become NULL."""
    value = as_col(column).try_cast("double")
    return F.when(~F.isnan(value), value)


def flag(condition: Column) -> Column:
    """A condition with NULL read as false."""
    return F.coalesce(condition, F.lit(False))


def count_where(condition: Column) -> Column:
    """Number of rows for which a condition holds; 0, never NULL, on an empty input."""
    return F.count(F.when(condition, F.lit(1)))


def total(column: ColumnLike) -> Column:
    """Sum that is 0 for a group without values."""
    return F.coalesce(F.sum(as_col(column)), F.lit(0.0))


def first_rule(rules: list[tuple[Column, str]], default: str) -> Column:
    """The label of the first rule that holds."""
    (condition, label), *rest = rules
    chain = F.when(condition, F.lit(label))
    for condition, label in rest:
        chain = chain.when(condition, F.lit(label))
    return chain.otherwise(F.lit(default))


def require_columns(df: DataFrame, columns, where: str = "input") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{where} lacks the columns {missing}")
    return df


def gate(df: DataFrame, broken: Column, message: ColumnLike) -> DataFrame:
    """The rows unchanged; any action that meets a broken row fails, whichever columns it reads.

    A filter stays in the plan where a checked column would be pruned with the column.
    """
    text = F.lit(message) if isinstance(message, str) else message
    return df.filter(F.when(flag(broken), F.raise_error(text).cast("boolean")).otherwise(F.lit(True)))


def pick_column(df: DataFrame, candidates) -> str | None:
    """First candidate present in the frame, compared without case."""
    present = {name.lower(): name for name in df.columns}
    return next((present[c.lower()] for c in candidates if c.lower() in present), None)


def column_or(df: DataFrame, name: str, default) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)
