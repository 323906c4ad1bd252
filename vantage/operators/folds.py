"""Folds over the structures of a series, in the task that sweeps them.

A series has some six sightings a session.  What is asked of them (spans, pairs of families, histories of identities, attempts
at levels) is far less, so sightings are folded where they are found and are neither shuffled nor stored.  Results are those of
the operators on the table of sightings, which tests compare.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions.scalar import identity, identity_of
from vantage.operators import machine
from vantage.operators.breakout import zone_of
from vantage.operators.features import atr
from vantage.operators.structure import _BARS, FAMILIES, LEAST_QUALITY, WARM_UP, Walk, states_of
from vantage.operators.sweep import spread
from vantage.operators.tracker import Sighting, Step, Tracker
from vantage.operators.tracking import HISTORY

KINDS = ["RELATED_TO", "CONTAINS", "NESTED_IN", "OVERLAPS"]
EARLY = ("MATURE", "NEAR_BREAKOUT")
_CODES = {f: n for n, f in enumerate(FAMILIES)}


@dataclass
class Series:
    """Bars of a series in order, and its sightings by session and key."""

    instrument: int
    days: np.ndarray  # since 1970
    bars: dict[str, np.ndarray]
    atr: np.ndarray
    t: np.ndarray
    of: np.ndarray  # number of the structure
    state: np.ndarray
    level: np.ndarray
    floor: np.ndarray
    quality: np.ndarray
    touches: np.ndarray
    confidence: np.ndarray
    keys: list[str]  # of each structure, as are the next two
    family: list[str]
    first: list[int]

    @classmethod
    def of_bars(cls, instrument: int, days: np.ndarray, bars: dict[str, np.ndarray], timeframe: str = "1d", least: float = LEAST_QUALITY) -> Series:
        span, at = atr(bars["high"], bars["low"], bars["close"]), np.arange(WARM_UP, len(days))
        t, family, first, level, floor, quality, touches, confidence = Walk(bars, span).swept(at, at)
        keep = quality >= least
        t, family, first, level, floor, quality, touches, confidence = (x[keep] for x in (t, family, first, level, floor, quality, touches, confidence))
        state = states_of(family, bars["close"][t], level, floor, quality)
        codes = np.fromiter(map(_CODES.__getitem__, family.tolist()), int, len(family))
        each, of = np.unique(codes * max(len(days), 1) + first, return_inverse=True)
        names, firsts = [FAMILIES[c] for c in (each // max(len(days), 1)).tolist()], (each % max(len(days), 1)).tolist()
        starts = days[firsts].astype("datetime64[D]").astype(str).tolist() if firsts else []
        keys = [identity_of(instrument, f, timeframe, start) for f, start in zip(names, starts, strict=True)]
        place = np.empty(len(keys), int)
        place[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
        order = np.lexsort((place[of], t))
        return cls(instrument, days, bars, span, *(x[order] for x in (t, of, state, level, floor, quality, touches, confidence)), keys, names, firsts)

    def sightings(self) -> Iterator[list[Sighting]]:
        """Those of each session, by key."""
        if not self.keys:
            return iter([[]] * len(self.days))
        keys, family, start = (np.array(x, kind)[self.of].tolist() for x, kind in ((self.keys, object), (self.family, object), (self.days[self.first], int)))
        columns = keys, family, self.state.tolist(), self.quality.tolist(), self.level.tolist(), self.floor.tolist(), start, self.touches.tolist(), self.confidence.tolist()
        every, cuts = list(map(partial(tuple.__new__, Sighting), zip(*columns, strict=True))), np.searchsorted(self.t, np.arange(len(self.days) + 1)).tolist()
        return (every[a:b] for a, b in zip(cuts, cuts[1:], strict=False))


def each(bars: DataFrame, fold: Callable[[Series, pa.Table], dict[str, list | np.ndarray]], schema: str, also: tuple[str, ...] = (), keys: tuple[str, ...] = ("instrument_id",)) -> DataFrame:
    """Columns (with days as numbers) that ``fold`` makes of each series; ``also`` are columns of ``bars`` that it reads besides."""
    names, kind = [k.split()[0] for k in schema.split(", ")], _arrow(schema)

    def run(key: tuple, x: pa.Table) -> pa.Table:
        day = x.column("day").to_numpy()
        x = x.take(pa.array(np.argsort(day, kind="stable")))
        series = Series.of_bars(key[0].as_py(), x.column("day").to_numpy(), {k: np.asarray(x.column(k).to_numpy(), float) for k in _BARS})
        found = fold(series, x)
        n = max((len(v) for v in found.values()), default=0)
        return pa.table({k: pa.array(found[k] if k in found else [series.instrument] * n, kind.field(k).type, from_pandas=True) for k in names}, kind)

    return bars.select(*keys, F.unix_date("session_date").alias("day"), *_BARS, *also).groupBy(*keys).applyInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    return pa.schema([(k.split()[0], kinds[k.split()[1]]) for k in schema.split(", ")])


def _dated(df: DataFrame, schema: str) -> DataFrame:
    """Numbers of days as the dates that ``schema`` asks for."""
    return df.select(*(F.date_from_unix_date(n).alias(n) if kind == "date" else F.col(n) for n, kind in (k.split() for k in schema.split(", "))))


_SPANS = "instrument_id int, family string, start_date date, end_date date, n long"


def spans(bars: DataFrame) -> DataFrame:
    """Each structure with its first and last date and the number of its sightings."""

    def fold(s: Series, _: pa.Table) -> dict:
        last = np.zeros(len(s.keys), int)
        np.maximum.at(last, s.of, s.t)
        return {"family": s.family, "start_date": s.days[s.first] if s.first else [], "end_date": s.days[last], "n": np.bincount(s.of, minlength=len(s.keys))}

    found = _dated(each(bars, fold, _SPANS.replace(" date,", " int,")), _SPANS)
    return found.withColumn("key", identity(F.col("instrument_id"), F.col("family"), F.lit("1d"), F.col("start_date")))


def related(bars: DataFrame) -> DataFrame:
    """How many pairs of structures of one series there are of each kind; see tracking.relationships()."""

    def fold(s: Series, _: pa.Table) -> dict:
        last = np.zeros(len(s.keys), int)
        np.maximum.at(last, s.of, s.t)
        of_key = np.empty(len(s.keys), int)
        of_key[sorted(range(len(s.keys)), key=s.keys.__getitem__)] = np.arange(len(s.keys))
        first, last, family = s.days[s.first].astype(int) if s.first else np.zeros(0, int), s.days[last].astype(int), np.array([_CODES[f] for f in s.family], int)
        order = np.lexsort((of_key, first))
        first, last, family, of_key = (x[order] for x in (first, last, family, of_key))
        # those that start later, or on the same day with a greater key, while this one is under way
        i, j = spread(np.arange(1, len(first) + 1), np.searchsorted(first, last, side="right"))
        both, ahead = np.minimum(last[i], last[j]) - first[j] + 1, of_key[i] < of_key[j]
        x, y = both / (last - first + 1)[i], both / (last - first + 1)[j]
        alike = (x >= 0.85) & (y >= 0.85)
        kind = np.select((alike & (family[i] != family[j]), alike, np.where(ahead, y, x) >= 0.8, np.where(ahead, x, y) >= 0.8, np.maximum(x, y) >= 0.25), (0, len(KINDS), 1, 2, 3), len(KINDS))
        kinds = np.bincount(kind, minlength=len(KINDS) + 1)[:-1]
        return {"kind": KINDS, "n": kinds}

    return each(bars, fold, "kind string, n long").groupBy("kind").agg(F.sum("n").alias("n")).where("n > 0")


def coexisting(bars: DataFrame) -> DataFrame:
    """How often two families fire on one series and session; see tracking.coexistence()."""
    names = sorted(FAMILIES)

    def fold(s: Series, _: pa.Table) -> dict:
        fires = np.zeros((len(s.days), len(names)), int)
        if len(s.t):
            fires[s.t, np.array([names.index(f) for f in s.family])[s.of]] = 1
        both = fires.T @ fires
        pairs = [(a, b, both[i, j]) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and both[i, j]]
        return dict(zip(("family", "other", "n"), zip(*pairs, strict=True), strict=True)) if pairs else {}

    return each(bars, fold, "family string, other string, n long").groupBy("family", "other").agg(F.sum("n").alias("n"))


def tracked(s: Series, tracker: Tracker) -> Iterator[tuple[int, list[Step]]]:
    """Position and steps of each session."""
    close = s.bars["close"].tolist()
    for t, (day, sightings) in enumerate(zip(s.days.tolist(), s.sightings(), strict=True)):
        yield t, tracker.observe(day, close[t] if close[t] == close[t] else None, sightings)


def track(bars: DataFrame, until: Column | None = None) -> DataFrame:
    """State history of each identity, as tracking.track() of the sightings of ``bars``."""

    def fold(s: Series, x: pa.Table) -> dict:
        tracker = Tracker()
        steps = [step for _, found in tracked(s, tracker) for step in found]
        end = x.column("end")[0].as_py() if len(x) else None
        if end is not None and tracker.over() is not None and end >= tracker.over():
            steps += tracker.finish()
        names = ("key", "family", "session_date", "from_state", "to_state", "reason", "quality")
        return dict(zip(names, zip(*steps, strict=True), strict=True)) if steps else {}

    end = F.lit(None).cast("int") if until is None else F.unix_date(until)
    return _dated(each(bars.withColumn("end", end), fold, HISTORY.replace(" date,", " int,"), ("end",)), HISTORY)


def boundaries(s: Series) -> Iterator[tuple[str, machine.Monitor, int, np.ndarray]]:
    """Key, monitor, position of the freezing and positions at which the structure was seen, of each level that is watched.

    Levels are frozen at the first early sighting of a structure, with the ATR of that session and the zone around them.
    """
    early = np.isin(s.state, EARLY)
    watched = np.flatnonzero(early | (s.state == "BROKEN_OUT_UNCONFIRMED"))
    by = watched[np.argsort(s.of[watched], kind="stable")]  # sessions of each structure in order
    for own in np.split(by, np.flatnonzero(np.diff(s.of[by])) + 1) if len(by) else ():
        begun = own[early[own]]
        if len(begun) and not np.isnan(s.atr[s.t[begun[0]]]):
            i = begun[0]
            level, span, confidence = float(s.level[i]), float(s.atr[s.t[i]]), float(s.confidence[i])
            yield s.keys[s.of[i]], machine.Monitor(level, zone_of(level, span, confidence), span, confidence, int(s.touches[i]), float(s.quality[i])), int(s.t[i]), s.t[own]


def histories(bars: DataFrame) -> DataFrame:
    """State history of every attempt at every level of the structures of ``bars``; see machine.histories() for its further columns."""

    def fold(s: Series, x: pa.Table) -> dict:
        known = lambda k: [None if v is None or v != v else v for v in x.column(k).to_pylist()]
        columns = [known(k) if k in x.column_names else [None] * len(x) for k in ("average_volume", *machine.CONTEXT)]
        line = machine.Line(s.days.astype("datetime64[D]"), *(s.bars[k].tolist() for k in _BARS), *columns)
        rows = [(key, *row) for key, monitor, frozen, seen in boundaries(s) for row in machine.followed(line, monitor, frozen + 1, s.days, s.days[seen])]
        if not rows:
            return {}
        key, number, at, was, to, reason, level = (list(c) for c in zip(*rows, strict=True))
        return {"key": key, "attempt": number, "session_date": s.days[at], "from_state": was, "to_state": to, "reason": reason, "level": level, "close": s.bars["close"][at]}

    also = tuple(c for c in ("average_volume", *machine.CONTEXT) if c in bars.columns)
    return _dated(each(bars, fold, machine.COLUMNS.replace(" date,", " int,"), also), machine.COLUMNS)
