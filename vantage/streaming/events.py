"""Breakout attempts and weekly bars from a stream of daily bars."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vantage.operators.machine import COLUMNS, CONTEXT, STALE_DAYS, Bar, Monitor

_NAMES = [k.split()[0] for k in COLUMNS.split(", ")]


def _known(row, column: str) -> float | None:
    value = getattr(row, column, None)
    return None if value is None or np.isnan(value) else value


def event_stream(bars: DataFrame, boundaries: DataFrame) -> DataFrame:
    """As machine.histories(), from a stream of bars: each level's monitor is kept as state between batches.

    The bars of a batch meet the levels of their series by instrument; a level sees each session once and in order as long as a
    batch does not hold sessions before those of the one before it.

    A level whose structure is no longer observed and that has no attempt under way is done: its state is dropped, and its
    later bars are passed over.  One without an attempt, or defeated, while its structure is still observed is kept until a timer at the end of
    the observations.
    """
    fields = ["level", "tolerance", "atr", "confidence", "touches", "frozen_on", "seen", *({"quality"} & set(boundaries.columns))]
    timed = bars.withColumn("_time", F.timestamp_seconds(F.unix_date("session_date").cast("long") * 86_400)).withWatermark("_time", "0 days")
    fed = timed.join(boundaries.select("instrument_id", "key", *fields), "instrument_id").where(F.col("session_date") > F.col("frozen_on"))

    def fold(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        x = pd.concat(list(parts)).sort_values("session_date")
        monitor, was = pickle.loads(state.get[0]) if state.exists else (None, {})
        rows, over = [], False
        for r in x.itertuples():
            day = np.datetime64(r.session_date, "D")
            seen = np.sort(np.asarray(r.seen, dtype="datetime64[D]"))
            last = int(seen[-1].astype(int)) + STALE_DAYS
            over = day.astype(int) > last and (monitor is None or monitor.attempt is None)
            if over:
                break  # no attempt is open and none can be opened any more
            if monitor is None:
                monitor = Monitor(r.level, r.tolerance, r.atr, r.confidence, int(r.touches), getattr(r, "quality", 40.0))
            watched = bool((day - seen[np.searchsorted(seen, day, side="right") - 1]).astype(int) <= STALE_DAYS)
            for number, now, reason in monitor.take(Bar(day, r.open, r.high, r.low, r.close, r.volume, r.average_volume, *(_known(r, c) for c in CONTEXT)), watched):
                rows.append((group[0], group[1], number, r.session_date, was.get(number), now, reason, r.level, r.close))
                was = {number: now}  # only the attempt under way can still change
        if over:
            if state.exists:
                state.remove()
        elif monitor is not None:
            state.update((pickle.dumps((monitor, was)),))
            if monitor.attempt is None:
                state.setTimeoutTimestamp(max((last + 1) * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=_NAMES)

    return fed.groupBy("instrument_id", "key").applyInPandasWithState(fold, COLUMNS, "memory binary", "append", GroupStateTimeout.EventTimeTimeout)


def weekly_stream(bars: DataFrame, late: str = "14 days") -> DataFrame:
    """Weekly bars from a stream of daily bars (event_time); a week is final once the watermark has passed it."""
    w = F.window("event_time", "7 days", startTime="4 days")
    return (
        bars.withWatermark("event_time", late)
        .groupBy("instrument_id", w.alias("w"))
        .agg(F.min_by("open", "event_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "event_time").alias("close"), F.sum("volume").alias("volume"))
        .select("instrument_id", F.to_date("w.start").alias("period_start"), "open", "high", "low", "close", "volume")
    )
