"""Breakout attempts at frozen levels: thirteen states, advanced one session at a time, in batch or from a stream.

A ``Monitor`` follows one level.  It opens an attempt while the structure behind the level is being observed, feeds it every
session, and opens the next one after an attempt has ended.  Its memory is a few numbers, so the same fold runs over a whole
series or picks up where a stream left off.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.functions.scalar import identity
from vantage.operators.breakout import BALANCED, CANDLE, CONFIRMATION, FOLLOW_THROUGH, QUALITY, RETEST

TERMINAL = ("failed_breakout", "expired")
RETESTING = ("retest_pending", "retest_holding", "retest_confirmed")
# Fixed values of the default configuration.
APPROACHING, PENDING, CONFIRMED, RETESTED = 40, 15, 30, 25
MOST_REJECTIONS, CLOSES_INSIDE, DECISIVE, ADVERSE, STALE_DAYS = 3, 2, 1.2, 2.5, 25
DETACHED = 40.0  # quality taken for a level that belongs to no structure


def _covered(later: bool, retested: bool) -> bool:
    have = {"close_acceptance": True, "follow_through": later, "volume_persistence": later, "retest_quality": retested}
    return 100 * sum(CONFIRMATION[k] for k, there in have.items() if there) >= BALANCED["coverage"]


#: Whether enough of the evidence is there, by sessions after the break and a retest.
_COVERED = {(later, retested): _covered(later, retested) for later in (False, True) for retested in (False, True)}


def _ramp(x: float, zero: float, full: float, floor: float = 0.0) -> float:
    return min(max(floor + (100 - floor) * (x - zero) / (full - zero), floor), 100.0)


@dataclass
class Bar:
    day: np.datetime64
    open: float
    high: float
    low: float
    close: float
    volume: float
    average_volume: float
    relative_strength: float | None = None
    market_context: float | None = None
    sector_context: float | None = None


class Line:
    """The bars of a series as lists, with the shape of each; ``first`` is the position before which a monitor knows no close."""

    def __init__(self, days, open, high, low, close, volume, average_volume, relative_strength, market_context, sector_context, first: int = 0) -> None:  # noqa: A002
        self.columns, self.high, self.close, self.first = (days, open, high, low, close, volume, average_volume, relative_strength, market_context, sector_context), high, close, first
        o, h, lo, c = (np.array(x, float) for x in (open, high, low, close))
        span = h - lo
        with np.errstate(all="ignore"):
            self.wick = np.where(span > 0, (h - np.where(c > o, c, o)) / span, 0.0).tolist()
            self.place = np.where(span > 0, (c - lo) / span, 1.0).tolist()
        self._bars: dict[int, Bar] = {}

    def bar(self, t: int) -> Bar:
        if t not in self._bars:
            self._bars[t] = Bar(*(c[t] for c in self.columns))
        return self._bars[t]


@dataclass
class Pullback:
    low: float
    sessions: int = 0
    below: int = 0
    volume: float = 0.0
    spread: float = 0.0
    recovered: int = 0

    def take(self, bar: Bar, level: float) -> None:
        self.sessions += 1
        self.below += bar.close < level
        self.volume += bar.volume
        self.spread += bar.high - bar.low
        if bar.low < self.low or self.sessions == 1:
            self.low, self.recovered = bar.low, 0
        self.recovered += bar.close > level

    def quality(self, undercut: float, volume: float, atr: float) -> float:
        under = _ramp(undercut, 0.6, 0.0, 10.0) * (0.5 if self.below > 3 else 1.0)
        dry = _ramp(self.volume / self.sessions / volume, 1.5, 0.45, 5.0) if volume > 0 else 50.0
        quiet = _ramp(self.spread / self.sessions / atr, 2.0, 0.6, 5.0) if atr > 0 else 50.0
        return under * RETEST["undercut"] + dry * RETEST["volume"] + quiet * RETEST["range"] + _ramp(self.recovered, 0, 1) * RETEST["recovery"]


@dataclass
class Attempt:
    number: int
    state: str = "not_approaching"
    reason: str = "opened"
    age: int = 0
    close: float = 0.0
    low: float = 0.0
    volume: float = 0.0
    quality: float = 0.0
    relative_volume: float | None = None
    since: int = 0
    spread: float = 0.0
    floor_low: float = 0.0
    later_top: float = -math.inf
    later_low: float = math.inf
    later_spread: float = 0.0
    later_volume: float = 0.0
    closes: int = 0
    run: int = 0
    inside: int = 0
    pullback: Pullback | None = None
    retest_quality: float | None = None
    held: bool = False


@dataclass
class Monitor:
    """One level with its attempts; ``take`` feeds a session and returns (attempt, state, reason) of every change of state."""

    level: float
    tolerance: float
    atr: float
    confidence: float = 50.0
    touches: int = 2
    quality: float = DETACHED
    attempt: Attempt | None = None
    number: int = 0
    rejections: int = 0
    previous_close: float | None = None
    closed: bool = False

    def take(self, bar: Bar, watched: bool, lost: bool = False) -> list[tuple[int, str, str]]:
        """``watched``: the structure behind the level has been observed lately.  ``lost``: its identity has ended, and with it any attempt."""
        out, now = [], self.attempt
        if not self.closed and (now is not None or watched):
            was = None
            if now is None:
                self.number += 1
                now = self.attempt = Attempt(self.number)
                self._advance(now, bar)
            else:
                was = now.state
                if watched or (now.since and not lost):
                    self._advance(now, bar)
                else:
                    now.state, now.reason = "expired", "timed_out"
            if now.state != was:
                out.append((now.number, now.state, now.reason))
            if now.state == "rejected":
                self.rejections += 1
                if self.rejections >= MOST_REJECTIONS:
                    out.append((now.number, "failed_breakout", "repeated_rejection"))
                    self.closed = True
            if now.state in TERMINAL or now.state == "rejected":
                self.attempt = None
        self.previous_close = bar.close
        return out

    def follow(self, line: Line, i: int, watched: bytes, lost: bool = False) -> tuple[list[tuple[int, int, str, str]], int]:
        """One attempt, opened at position i: (position, attempt, state, reason) of its changes, and the position after it.

        As take() session by session; ``lost``: an attempt ends wherever it isn't watched, also after the break.
        """
        out, was, age = [], None, 0
        self.number += 1
        level, atr, number = self.level, self.atr, self.number
        top, edge = level * (1 + self.tolerance), level * (1 - self.tolerance)
        high, close, wick, place = line.high, line.close, line.wick, line.place
        for t in range(i, len(close)):
            if age and not watched[t]:
                return self._ended(out, was, t, "expired", "timed_out")
            age += 1
            h, c = high[t], close[t]
            if c > top:
                break
            if h > top and c < level and (wick[t] >= 0.5 or place[t] <= 0.35):
                return self._ended(out, was, t, "rejected", "rejected_at_boundary")
            if age - 1 > APPROACHING:
                return self._ended(out, was, t, "expired", "timed_out")
            apart = (level - c) / atr if atr > 0 else None
            if h > top:
                state, reason = "intraday_break", "penetrated_intraday"
            elif edge <= h <= top or (apart is not None and abs(apart) <= 0.4):
                state, reason = "testing_resistance", "touched_boundary"
            elif (apart is None or apart <= 2.5) and (level - c) / level <= 0.12:
                state, reason = "approaching", "entered_approach"
            else:
                state, reason = "not_approaching", "left_approach"
            if state != was:
                out.append((t, number, state, reason))
                was = state
        else:
            return out, len(close)
        a = self.attempt = Attempt(number, age=age - 1)
        for t in range(t, len(close)):
            bar = line.bar(t)
            if a.since and lost and not watched[t]:
                return self._ended(out, was, t, "expired", "timed_out")
            if not a.since:
                self.previous_close = close[t - 1] if t > line.first else None
            self._advance(a, bar)
            if a.state in TERMINAL:
                return self._ended(out, was, t, a.state, a.reason)
            if a.state != was:
                out.append((t, number, a.state, a.reason))
                was = a.state
        return out, len(close)

    def _ended(self, out: list, was: str | None, t: int, state: str, reason: str) -> tuple[list, int]:
        if state != was:
            out.append((t, self.number, state, reason))
        if state == "rejected":
            self.rejections += 1
            if self.rejections >= MOST_REJECTIONS:
                out.append((t, self.number, "failed_breakout", "repeated_rejection"))
                self.closed = True
        self.attempt = None
        return out, t + 1

    def _advance(self, a: Attempt, bar: Bar) -> None:
        a.age += 1
        if a.since:
            self._after(a, bar)
        else:
            self._before(a, bar)

    def _before(self, a: Attempt, bar: Bar) -> None:
        top, span = self.level * (1 + self.tolerance), bar.high - bar.low
        wick = (bar.high - max(bar.open, bar.close)) / span if span > 0 else 0.0
        place = (bar.close - bar.low) / span if span > 0 else 1.0
        if bar.close > top:
            a.state, a.reason = "closed_above", "qualifying_close"
            a.close, a.low, a.volume, a.since, a.closes, a.run = bar.close, bar.low, bar.volume, 1, 1, 1
            a.floor_low, a.spread = bar.low, span
            a.relative_volume = bar.volume / bar.average_volume if bar.average_volume > 0 else None
            a.quality = self._quality(bar, place, wick, a.relative_volume)
            return
        if bar.high > top and bar.close < self.level and (wick >= 0.5 or place <= 0.35):
            a.state, a.reason = "rejected", "rejected_at_boundary"
            return
        apart = (self.level - bar.close) / self.atr if self.atr > 0 else None
        touching = self.level * (1 - self.tolerance) <= bar.high <= top
        if bar.high > top:
            a.state, a.reason = "intraday_break", "penetrated_intraday"
        elif touching or (apart is not None and abs(apart) <= 0.4):
            a.state, a.reason = "testing_resistance", "touched_boundary"
        elif (apart is None or apart <= 2.5) and (self.level - bar.close) / self.level <= 0.12:
            a.state, a.reason = "approaching", "entered_approach"
        else:
            a.state, a.reason = "not_approaching", "left_approach"
        if a.age - 1 > APPROACHING:
            a.state, a.reason = "expired", "timed_out"

    def _quality(self, bar: Bar, place: float, wick: float, relative: float | None) -> float:
        span = bar.high - bar.low
        was = bar.close if self.previous_close is None else self.previous_close
        true = max(span, abs(bar.high - was), abs(bar.low - was)) if self.previous_close is not None else span
        body = abs(bar.close - bar.open) / span if span > 0 else 1.0
        shape = _ramp(place, 0.25, 0.85) * CANDLE["close_location"] + _ramp(body, 0, 0.6) * CANDLE["body"] + _ramp(wick, 0.5, 0) * CANDLE["upper_wick"]
        shape += (_ramp(true / self.atr, 0, 1.5) if self.atr > 0 else 50.0) * CANDLE["range"]
        beyond = (bar.close - self.level * (1 + self.tolerance)) / self.atr if self.atr > 0 else 0.0
        over = max(0.0, (bar.close - self.level) / self.atr - 1) if self.atr > 0 else 0.0
        parts = {
            "boundary_quality": self.confidence * 0.4 + _ramp(self.touches, 0, 5) * 0.3 + self.quality * 0.3,
            "penetration": _ramp(beyond, 0, 0.75) * 0.65 + _ramp(over, 3, 0) * 0.35,
            "candle_quality": shape,
            "volume_confirmation": None if relative is None else _ramp(relative, 0.7, 1.8),
            "relative_strength": bar.relative_strength,
            "market_context": bar.market_context,
            "sector_context": bar.sector_context,
        }
        have = {k: v for k, v in parts.items() if v is not None}
        return sum(v * QUALITY[k] for k, v in have.items()) / sum(QUALITY[k] for k in have)

    def _after(self, a: Attempt, bar: Bar) -> None:
        was = a.state
        a.since += 1
        above = bar.close > self.level * (1 + self.tolerance)
        a.closes += above
        a.run = a.run + 1 if above else 0
        a.inside = a.inside + 1 if bar.close < self.level * (1 - self.tolerance) else 0
        a.floor_low = min(a.floor_low, bar.low)
        a.later_top, a.later_low = max(a.later_top, bar.close), min(a.later_low, bar.low)
        a.spread += bar.high - bar.low
        a.later_spread += bar.high - bar.low
        a.later_volume += bar.volume
        if self.atr > 0 and (self.level - bar.close) / self.atr >= DECISIVE:
            a.state, a.reason = "failed_breakout", "closed_back_inside"
            return
        if self.atr > 0 and (a.close - a.floor_low) / self.atr >= ADVERSE:
            a.state, a.reason = "failed_breakout", "adverse_excursion"
            return
        moved = self._retest(a, bar, was)
        if a.state in TERMINAL:
            return
        if a.pullback is None and a.state not in RETESTING:
            if a.inside >= CLOSES_INSIDE:
                a.state, a.reason = "failed_breakout", "closed_back_inside"
                return
            if bar.low < a.low and a.inside:
                a.state, a.reason = "failed_breakout", "broke_breakout_low"
                return
        if not moved:
            path = self._path(a)
            if path and was != "confirmed":
                a.state, a.reason = "confirmed", path
            elif was != "confirmed":
                a.state, a.reason = "confirmation_pending", "awaiting_evidence"
        self._expire(a)

    def _retest(self, a: Attempt, bar: Bar, was: str) -> bool:
        """Whether the retest decides the state of this session."""
        if was == "retest_confirmed":
            return False
        if a.pullback is None:
            fell = bar.close < a.close and ((a.close - bar.close) / self.atr >= 0.5 if self.atr > 0 else bar.close < a.close * 0.98)
            if not fell:
                return False
            a.pullback = Pullback(bar.low)
        p = a.pullback
        p.take(bar, self.level)
        undercut = max(0.0, self.level - p.low) / self.atr if self.atr > 0 else 0.0
        a.retest_quality, a.held = p.quality(undercut, a.volume, self.atr), p.recovered > 0
        if undercut > 0.6 or p.below > 3:
            a.state, a.reason, a.pullback = "failed_breakout", "closed_back_inside", None
        elif was == "retest_holding":
            if a.held:
                a.state, a.reason, a.pullback = "retest_confirmed", "retest_recovered", None
        elif p.low <= self.level * (1 + self.tolerance):
            a.state, a.reason = "retest_holding", "retest_reached_level"
        elif was == "retest_pending" and bar.close >= a.close:
            a.state, a.reason, a.pullback = "confirmation_pending", "awaiting_evidence", None
        else:
            a.state, a.reason = "retest_pending", "pullback_started"
        return True

    def _path(self, a: Attempt) -> str | None:
        n = a.since - 1
        if not _COVERED[n > 0, a.retest_quality is not None]:
            return None
        if a.closes >= BALANCED["closes"] and a.quality >= BALANCED["quality"] and a.relative_volume is not None and a.relative_volume >= BALANCED["relative_volume"]:
            if n and n >= BALANCED["follow_sessions"] and self._follow(a, n) >= BALANCED["follow"]:
                return "momentum"
        if a.retest_quality is not None and a.held and a.retest_quality >= BALANCED["retest"]:
            return "retest"
        if a.run >= BALANCED["acceptance_closes"] and (self.atr <= 0 or a.spread / a.since / self.atr <= BALANCED["acceptance_range"]):
            return "acceptance"
        return None

    def _follow(self, a: Attempt, n: int) -> float:
        atr = self.atr
        terms = {
            "progress": _ramp((a.later_top - a.close) / atr, 0, 1) if atr > 0 else 50.0,
            "adverse": _ramp(max(0.0, (a.close - a.later_low) / atr), 1, 0) if atr > 0 else 50.0,
            "expansion": _ramp(a.later_spread / n / atr, 0, 1.2) if atr > 0 else 50.0,
            "volume": _ramp(a.later_volume / n / a.volume, 0, 0.7) if a.volume > 0 else 50.0,
        }
        return sum(v * FOLLOW_THROUGH[k] for k, v in terms.items())

    def _expire(self, a: Attempt) -> None:
        limit = {"confirmation_pending": PENDING, "confirmed": CONFIRMED}.get(a.state)
        if a.state in RETESTING and a.pullback is not None and a.pullback.sessions > RETESTED:
            a.state, a.reason = "expired", "timed_out"
        elif limit is not None and a.since - 1 > limit:
            a.state, a.reason = "expired", "resolved" if a.state == "confirmed" else "timed_out"


CONTEXT = ("relative_strength", "market_context", "sector_context")
COLUMNS = "instrument_id int, key string, attempt int, session_date date, from_state string, to_state string, reason string, level double, close double"
_NAMES = [k.split()[0] for k in COLUMNS.split(", ")]


def followed(line: Line, m: Monitor, first: int, days: np.ndarray, seen: np.ndarray) -> Iterator[tuple[int, int, str | None, str, str, float]]:
    """(attempt, position, from, to, reason, level) of all attempts at a level from position ``first`` on; ``seen``: days on which its structure was observed, in order."""
    last = seen[np.searchsorted(seen, days[first:], side="right") - 1]
    watched = bytes(first) + (days[first:] - last <= STALE_DAYS).tobytes()
    line.first, t = first, watched.find(1, first)
    while t >= 0 and not m.closed:
        changes, t = m.follow(line, t, watched)
        was = None
        for at, number, state, reason in changes:
            yield number, at, was, state, reason, m.level
            was = state
        t = watched.find(1, t)


def histories(bars: DataFrame, boundaries: DataFrame) -> DataFrame:
    """State history of every attempt at every level, over all sessions after it was frozen.

    bars: instrument_id, session_date, open, high, low, close, volume, average_volume and, where known, the context scores
    relative_strength, market_context and sector_context (0 to 100).  boundaries: instrument_id, key, level,
    tolerance, atr, confidence, touches, frozen_on and seen, the dates on which the structure was observed; quality, that of the
    structure, where the levels belong to one.
    """

    def fold(group: tuple, b: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("session_date")
        days = b["session_date"].to_numpy().astype("datetime64[D]")
        known = [b[c].astype(object).where(b[c].notna(), None).tolist() if c in b else [None] * len(b) for c in CONTEXT]
        line = Line(days, *(b[c].to_numpy(float).tolist() for c in ("open", "high", "low", "close", "volume", "average_volume")), *known)
        rows, close, day = [], line.close, days.astype(int)
        for r in edges.sort_values(["frozen_on", "key"]).itertuples():
            seen = np.sort(np.asarray(r.seen, dtype="datetime64[D]"))
            first = int(np.searchsorted(days, np.datetime64(r.frozen_on, "D"), side="right"))
            m = Monitor(r.level, r.tolerance, r.atr, r.confidence, int(r.touches), getattr(r, "quality", DETACHED))
            rows += [(group[0], r.key, number, days[t].item(), was, to, reason, level, close[t]) for number, t, was, to, reason, level in followed(line, m, first, day, seen.astype(int))]
        return pd.DataFrame(rows, columns=_NAMES)

    return bars.groupBy("instrument_id").cogroup(boundaries.groupBy("instrument_id")).applyInPandas(fold, COLUMNS)


def with_event_key(history: DataFrame) -> DataFrame:
    return history.withColumn("event_key", identity(F.col("instrument_id"), F.lit("1d"), F.col("key"), F.col("attempt")))


def active(history: DataFrame) -> DataFrame:
    """Attempts that are still going, with the state they are in."""
    now = history.groupBy("instrument_id", "key", "attempt").agg(F.max_by("to_state", "session_date").alias("state"), F.max("session_date").alias("since"))
    return now.where(~F.col("state").isin(*TERMINAL, "rejected"))


def defeated(history: DataFrame, most: int = MOST_REJECTIONS) -> DataFrame:
    """Levels that were rejected so often that no further attempt opens."""
    n = history.where("to_state = 'rejected'").groupBy("instrument_id", "key").agg(F.count(F.lit(1)).alias("rejections"))
    return n.where(F.col("rejections") >= most)
