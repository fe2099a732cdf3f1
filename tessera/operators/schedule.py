"""Sliding quotas, debouncing, stale rows and failure streaks over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def earlier_within(scope: list[str], at: str, seconds: int) -> Column:
    """Rows of the scope in the time up to this one, itself not counted; a row exactly that long ago counts."""
    w = Window.partitionBy(*scope).orderBy(F.unix_micros(at)).rangeBetween(-seconds * 1_000_000, 0)
    return F.count(F.lit(1)).over(w) - 1


def debounced(events: DataFrame, scope: list[str], at: str, gap_seconds: int, key: str) -> DataFrame:
    """The first event of each session; every event, kept or not, prolongs its session.

    Scopes are few and logs long, so time is cut first, into days: events are
    compared within a day of a scope, and the first of a day with the last one
    before it, found over the days alone.
    """
    x = events.withColumn("_day", F.floor(F.unix_micros(at) / 86_400_000_000))
    days = x.groupBy(*scope, "_day").agg(F.max(at).alias("_last"))
    days = days.select(*(F.col(c).alias(f"_s{i}") for i, c in enumerate(scope)), F.col("_day").alias("_d"), F.lag("_last").over(Window.partitionBy(*scope).orderBy("_day")).alias("_before"))
    x = x.withColumn("_b", F.lag(at).over(Window.partitionBy(*scope, "_day").orderBy(at, key)))
    on = F.col("_day") == F.col("_d")
    for i, c in enumerate(scope):
        on &= F.col(c).eqNullSafe(F.col(f"_s{i}"))
    x = x.join(days, on, "left").withColumn("_b", F.coalesce("_b", "_before"))
    return x.filter(F.col("_b").isNull() | (F.unix_micros(at) - F.unix_micros("_b") >= gap_seconds * 1_000_000)).select(*events.columns)


def cooled_down(events: DataFrame, scope: list[str], at: str, seconds: int) -> DataFrame:
    """(scope, at) of the events let through: after each, its scope rests for a fixed time, in which others don't count.

    The fold runs in the JVM over the sorted times of a scope.
    """
    gap = seconds * 1_000_000
    times = events.groupBy(*scope).agg(F.array_sort(F.collect_list(F.unix_micros(at))).alias("_t"))
    kept = F.aggregate("_t", F.array().cast("array<bigint>"), lambda out, t: F.when((F.size(out) == 0) | (t - F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0)) >= gap), F.concat(out, F.array(t))).otherwise(out))
    return times.select(*scope, F.explode(kept).alias("_m")).select(*scope, F.timestamp_micros("_m").alias(at))


def stale(rows: DataFrame, due: str, now: Column) -> DataFrame:
    return rows.filter(F.col(due) <= now)


def failing(runs: DataFrame, scope: list[str], at: str, key: str, failed: Column, k: int = 5) -> DataFrame:
    """Scopes whose last ``k`` runs all failed; with fewer runs none has."""
    w = Window.partitionBy(*scope).orderBy(F.desc(at), F.desc(key))
    last = runs.withColumn("_failed", failed).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)
    return last.groupBy(*scope).agg(F.count_if("_failed").alias("failures")).filter(F.col("failures") >= k)


def next_due(at: Column, stale_after_ms: Column) -> Column:
    return at + F.make_dt_interval(secs=stale_after_ms / 1000)
