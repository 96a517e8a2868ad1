"""Registry of named queries: a Spark callable plus, where SQL can say it, an oracle.

Both sides end in the same projection, written once as a small spec:

    "outlet_id date:d quantity:6 n:i ready:b"

`:d` is an ISO date string, `:<digits>` a rounded double, `:i` a bigint, `:b` a flag as 0/1;
a bare name passes through.

Means over a power of two of rows end exactly in half a unit of the last digit, where the last
bit of a sum decides the rounding. NUDGE, far below any rounding digit and far above that last
bit, is added on both sides so that such ties fall the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


NUDGE = 3e-10


@dataclass(frozen=True)
class Query:
    name: str
    columns: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def _spec(columns: str):
    for item in columns.split():
        name, _, kind = item.partition(":")
        yield name, kind


def project(df: DataFrame, columns: str) -> DataFrame:
    out = []
    for name, kind in _spec(columns):
        c = F.col(name)
        if kind == "d":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "i":
            c = c.cast("bigint")
        elif kind == "b":
            c = c.cast("int").cast("bigint")
        elif kind:
            c = F.round(c.cast("double") + F.lit(NUDGE), int(kind)) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def project_sql(sql: str, columns: str) -> str:
    out = []
    for name, kind in _spec(columns):
        c = f'"{name}"'
        if kind == "d":
            c = f"strftime(CAST({c} AS DATE), '%Y-%m-%d')"
        elif kind == "i":
            c = f"CAST({c} AS BIGINT)"
        elif kind == "b":
            c = f"CAST(CAST({c} AS INTEGER) AS BIGINT)"
        elif kind:
            c = f"round(CAST({c} AS DOUBLE) + {NUDGE:.1e}::DOUBLE, {kind}) + 0.0"
        out.append(f'{c} AS "{name}"')
    return f"SELECT {', '.join(out)}\nFROM (\n{sql}\n) AS answer"


# --- common table expressions of the oracles -------------------------------------------

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (sql.strip(), needs)


def with_ctes(sql: str, *needs: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for parent in CTES[name][1]:
            visit(parent)
        ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return sql
    parts = ",\n".join(f"{name} AS (\n{CTES[name][0]}\n)" for name in ordered)
    return f"WITH {parts}\n{sql}"


def query(name: str, columns: str, sql: str | None = None, needs: tuple[str, ...] | str = ()):
    """Decorator: register `fn(spark, sf_dir)` under `name`."""
    needs = (needs,) if isinstance(needs, str) else needs

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return project(fn(spark, sf_dir), columns)

        oracle = project_sql(with_ctes(sql, *needs), columns) if sql else None
        QUERIES[name] = Query(name, columns, run, oracle)
        return fn

    return register
