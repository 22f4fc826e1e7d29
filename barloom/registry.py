"""Query registry: one entry per operator, with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.scalars import rounded
from barloom.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _names(text: str) -> list[str]:
    return text.split()


def query(name: str, sql: str | None = None, ctes: str = "", r6: str = "", r4: str = "", r9: str = "", stored: bool = False):
    """Register a plan over the test tables.

    ``r6`` and ``r4`` list the double columns rounded to 6 or 4 places on both sides, so that the two
    engines may add in a different order.  A ``sql`` that starts with a comma adds its own CTEs after
    the shared ones named in ``ctes``.  ``stored`` is for plans that pass over the bars several times: the bars
    are then written once and read back.
    """
    digits = {c: 6 for c in _names(r6)} | {c: 4 for c in _names(r4)} | {c: 9 for c in _names(r9)}

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tables = Tables(spark, sf_dir)
            df = fn(tables.store() if stored else tables)
            if not digits:
                return df
            return _rounded(df, digits)

        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, run, _build_sql(sql, _names(ctes), digits))
        return fn

    return wrap


def _rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Doubles of the same number of places go through one array, which keeps the generated code of wide queries small."""
    types = dict(df.dtypes)
    arrays, new = {}, {}
    for c in df.columns:
        if c in digits and types[c] == "double":
            like = arrays.setdefault(digits[c], [])
            new[c] = F.get(f"_round{digits[c]}", F.lit(len(like)))
            like.append(c)
        elif c in digits:
            new[c] = F.round(c, digits[c])
    wide = df.withColumns({f"_round{d}": rounded(like, d) for d, like in arrays.items()})
    return wide.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def _build_sql(sql: str | None, ctes: list[str], digits: dict[str, int]) -> str | None:
    if sql is None:
        return None
    from barloom.plans.oracle import shared_ctes

    head = shared_ctes(ctes)
    body = sql.strip()
    if head:
        body = f"WITH {head}{body}" if body.startswith(",") else f"WITH {head}\n{body}"
    if digits:
        repl = ", ".join(f"round({c}, {d}) AS {c}" for c, d in digits.items())
        body = f"SELECT * REPLACE ({repl}) FROM (\n{body}\n)"
    return body
