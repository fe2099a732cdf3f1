"""Streaming forms of the event operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def unique_calls(events: DataFrame, keys: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark's delay."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def debounced_stream(events: DataFrame, key: str, at: str, gap_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """(key, at) of the first event of each session; every event prolongs its session.

    The state of a key is the time of its last event; it goes when the
    watermark has passed that by the gap, as the next event is a first one then.
    The watermark runs on a copy of the time a day later, since Spark's own begins
    at the epoch and would take events at it as late.
    """
    day = 86_400_000
    kind = f"{key} {dict(events.dtypes)[key]}, {at} timestamp"

    def keep(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = pd.concat([p[at] for p in parts]).sort_values()
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        out = []
        for t in times:
            if last is None or (t - last).total_seconds() >= gap_seconds:
                out.append(t)
            last = t if last is None else max(last, t)
        state.update((int(last.value // 1000),))
        state.setTimeoutTimestamp(max(int(last.value // 1_000_000) + day + gap_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [name[0]] * len(out), at: pd.Series(out, dtype="datetime64[ns]")})

    grouped = events.select(key, at, (F.col(at) + F.make_dt_interval(days=F.lit(1))).alias("_due")).withWatermark("_due", delay).groupBy(key)
    return grouped.applyInPandasWithState(keep, kind, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)
