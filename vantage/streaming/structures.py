"""Tracked identities from a stream of sightings and closes, with a state that stays bounded.

A series' state is its tracker and the rows that the watermark hasn't passed yet; those are held back and taken in order of
their session, so the order of arrival within the allowed delay doesn't matter.  Two event-time timers keep a series going when
nothing of its own arrives: one for the next session held back, and one for the day on which a silent series is over.  Then its
identities expire on the days on which grace or carry ran out, and the state is dropped.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vantage.operators.tracker import Sighting, Tracker
from vantage.operators.tracking import FIELDS, HISTORY, NAMES, sightings, step_rows

DAY_MS = 86_400_000


class Held:
    """A tracker with the rows of sessions that aren't complete yet."""

    def __init__(self) -> None:
        self.tracker = Tracker()
        self.closes: dict[int, float] = {}
        self.sighted: dict[int, list[Sighting]] = defaultdict(list)

    def take(self, x: pd.DataFrame) -> None:
        for day, close, *rest in x[["day", "close", *FIELDS]].itertuples(index=False):
            if rest[0] is None:
                self.closes[int(day)] = close
            else:
                self.sighted[int(day)].append(Sighting(*rest[:-1], int(rest[-1])))

    def advance(self, upto: int) -> list:
        """Steps of all sessions up to a day, in order.  A sighting on a day without a close is no session and goes."""
        steps = []
        for day in sorted(d for d in self.closes if d <= upto):
            steps += self.tracker.observe(day, self.closes.pop(day), sorted(self.sighted.pop(day, ())))
        for day in [d for d in self.sighted if d <= upto]:
            del self.sighted[day]
        over = self.tracker.over()
        if over is not None and upto >= over and not self.closes:
            steps += self.tracker.finish()
        return steps

    def next_day(self) -> int | None:
        """The day on which this has to be looked at again though nothing arrives."""
        waiting = [*self.closes, *self.sighted]
        if waiting:
            return min(waiting)
        return self.tracker.over()


def track_stream(found: DataFrame, sessions: DataFrame, delay: str = "0 days") -> DataFrame:
    """As tracking.track(), from a stream of sightings and one of sessions (instrument_id, session_date, close).

    A session is read once the watermark, ``delay`` behind the latest date of either stream, has reached its date.
    """
    seen = sightings(found).withColumn("close", F.lit(None).cast("double"))
    none = {"key": "string", "family": "string", "state": "string", "quality": "double", "level": "double", "invalidation": "double", "start": "int"}
    bars = sessions.select("instrument_id", F.unix_date("session_date").alias("day"), "close", *(F.lit(None).cast(t).alias(n) for n, t in none.items()))
    both = bars.unionByName(seen).withColumn("event_time", F.timestamp_seconds(F.col("day").cast("long") * 86_400)).withWatermark("event_time", delay)

    def fold(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else Held()
        for x in parts:
            held.take(x.astype(object).where(x.notna(), None))
        steps = held.advance(state.getCurrentWatermarkMs() // DAY_MS)
        then = held.next_day()
        if then is None:
            state.remove()
        else:
            state.update((pickle.dumps(held),))
            state.setTimeoutTimestamp(max(then * DAY_MS, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(step_rows(group[0], steps), columns=NAMES)

    return both.groupBy("instrument_id").applyInPandasWithState(fold, HISTORY, "memory binary", "append", GroupStateTimeout.EventTimeTimeout)
