"""Registered queries: one Spark plan (and, where SQL can say it, a DuckDB
twin) per operator of the inventory.

Every query reads the driver tables through the adapters, so its work grows
with the input. Parameters (as_of, windows, limits) are fixed here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from certlens import oracle as O

AS_OF = "2024-01-31 00:00:00"
TRAILING_DAYS = 14          # breakdown / ranking windows
STATS_DAYS = 7              # issuer_stats trailing window
ROLLUP_DAYS = 30            # rollup refresh / baseline window
RANGE = ("2024-01-05", "2024-01-18")
LIMIT = 10


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operator: str


REGISTRY: dict[str, Query] = {}


def register(name: str, operator: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, O.with_adapters(sql) if sql is not None else None, operator)
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: q.run for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: q.sql for name, q in REGISTRY.items() if q.sql is not None}


def _load() -> None:
    # Importing the query modules fills REGISTRY.
    from certlens.plans import queries_reports  # noqa: F401
    from certlens.plans import queries_lookup  # noqa: F401
    from certlens.plans import queries_rules  # noqa: F401
    from certlens.plans import queries_snapshots  # noqa: F401
    from certlens.plans import queries_scalars  # noqa: F401
    from certlens.plans import queries_sketches  # noqa: F401
    from certlens.plans import queries_streaming  # noqa: F401
