"""Listings, memberships and row-level changes as DataFrame operations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Eq:
    """column = value; a null value asks for null."""

    column: str
    value: object


@dataclass(frozen=True)
class Among:
    column: str
    values: tuple


@dataclass(frozen=True)
class Compare:
    """column op value, for ``<``, ``<=``, ``>``, ``>=`` and ``!=``."""

    column: str
    op: str
    value: object


def _clause(c: Eq | Among | Compare) -> Column:
    x = F.col(c.column)
    if isinstance(c, Eq):
        return x.eqNullSafe(F.lit(c.value))
    if isinstance(c, Among):
        return x.isin(*c.values)
    v = F.lit(c.value)
    return {"<": x < v, "<=": x <= v, ">": x > v, ">=": x >= v, "!=": x != v}[c.op]


def where(rows: DataFrame, clauses: list[Eq | Among | Compare], order: list[Column] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows that meet every clause; no clause on a column leaves it free."""
    for c in clauses:
        rows = rows.filter(_clause(c))
    rows = rows.orderBy(*order) if order else rows
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The rows of a page counted from 0, with ``has_more``; one row more than the page is fetched to know, and nothing is counted."""
    some = rows.orderBy(*order).offset(number * size).limit(size + 1)
    every = Window.partitionBy(F.lit(1))  # of size + 1 rows at most
    x = some.withColumn("_n", F.row_number().over(every.orderBy(*order))).withColumn("has_more", F.count(F.lit(1)).over(every) > size)
    return x.filter(F.col("_n") <= size).drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """New values win, other rows stay."""
    n = new.select(key, F.col(value).alias("_new"))
    return old.join(n, key, "full").select(key, F.coalesce("_new", value).alias(value))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Delete by key."""
    return rows.join(gone, key, "left_anti")


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """``batch``: consecutive numbers from 0 for groups of ``size`` rows of a dense key from 0."""
    return rows.withColumn("batch", F.floor(F.col(order) / size))


def feedback(value: Column) -> Column:
    """Null stays null, else true for 1."""
    return F.when(value.isNull(), F.lit(None).cast("boolean")).otherwise(value == 1)
