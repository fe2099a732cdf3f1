"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

# One module for each operator; a module's QUERY is (name, function), its
# ORACLE_SQL the same in DuckDB's SQL, or None.
MODULES = [f"op{n}" for n in range(1, 11)]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [import_module(f"{__package__}.query_{m}").QUERY for m in MODULES]
    return dict(found)


def oracle_sql() -> dict[str, str]:
    out = {}
    for m in MODULES:
        module = import_module(f"{__package__}.query_{m}")
        if module.ORACLE_SQL is not None:
            out[module.QUERY[0]] = module.ORACLE_SQL
    return out
