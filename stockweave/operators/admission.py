"""Whole-input gates: nothing of an input is released before all of it has been judged.

A filter that fails on a bad row lets an action through that never meets the row, such as `limit(1)`.
Here the input is stored, its rows and violations are counted in the same pass (`DataFrame.observe`
on the writing stage), and the stored copy is handed out only if no rule is broken. Where a copy is
not wanted, `store=False` counts with one aggregate and hands out the input itself.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.exprs import count_where, flag, to_number
from ..plans.lineage import cut

Rules = Mapping[str, Column]


class Refused(ValueError):
    """An input that breaks rules; `reasons` has each with the number of rows that break it."""

    def __init__(self, where: str, reasons: dict[str, int]) -> None:
        self.where, self.reasons = where, reasons
        super().__init__(f"{where}: " + ", ".join(self.written()))

    def written(self) -> list[str]:
        return [name if n is None else f"{name}:{n}" for name, n in sorted(self.reasons.items())]


def _measures(rules: Rules) -> list[Column]:
    return [F.count(F.lit(1)).alias("_rows"), *[count_where(flag(broken)).alias(name) for name, broken in rules.items()]]


def require(df: DataFrame, columns, where: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise Refused(where, {f"missing {c}": None for c in missing})


def judge(found: Mapping[str, int], where: str, empty: str | None) -> None:
    broken = {name: n for name, n in found.items() if name != "_rows" and n}
    if empty and not found["_rows"]:
        broken = {empty: None}
    if broken:
        raise Refused(where, broken)


def admit(df: DataFrame, rules: Rules, where: str, empty: str | None = "empty", store: bool = True) -> DataFrame:
    """The rows, once it is known that none breaks a rule; `empty` names the refusal of an input without rows, None allows it."""
    if not store:
        judge(df.agg(*_measures(rules)).first().asDict(), where, empty)
        return df
    seen = Observation()
    stored = cut(df.observe(seen, *_measures(rules)))
    judge(seen.get, where, empty)
    return stored


def violations(df: DataFrame, rules: Rules) -> DataFrame:
    """(rule, violations, rows): what `admit` judges, as a table, from one aggregate."""
    one = df.agg(*_measures(rules))
    return one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations"), F.col("_rows").alias("rows"))
                                         for name in rules])))


# --- the contracts ---------------------------------------------------------------------------------------

KEY = ("date", "outlet_id", "product_id")


def training_input(df: DataFrame, target: str = "quantity_sold", store: bool = True) -> DataFrame:
    """A training set: key and target columns, rows, no null date, no null target."""
    require(df, [*KEY, target], "training input")
    return admit(df, {"null date": F.col("date").isNull(), f"null {target}": F.col(target).isNull()}, "training input", store=store)


def strict_history(df: DataFrame, target: str = "deconstrained_demand") -> DataFrame:
    """A history with typed date and target; one value that does not convert refuses all of it."""
    require(df, [*KEY, target], "history")
    typed = df.withColumns({"date": F.col("date").cast("string").try_cast("date"), target: to_number(target)})
    return admit(typed, {"invalid date": F.col("date").isNull(), f"invalid {target}": F.col(target).isNull()}, "history", empty=None)


def prepared_history(df: DataFrame, target: str = "quantity_sold") -> DataFrame:
    """A history without its incomplete rows; refused if none is left."""
    require(df, [*KEY, target], "history")
    typed = df.withColumns({"date": F.col("date").cast("string").try_cast("date"), target: to_number(target)})
    return admit(typed.dropna(subset=[*KEY, target]), {}, "history", empty="no complete row")


def learning_data(df: DataFrame, target: str, where: str) -> DataFrame:
    """Key and target columns and at least one row."""
    require(df, [*KEY, target], where)
    return admit(df, {}, where, store=False)


def calendar_input(df: DataFrame) -> DataFrame:
    """Outlet and date columns and at least one row."""
    require(df, ["outlet_id", "date"], "calendar")
    return admit(df, {}, "calendar", store=False)
