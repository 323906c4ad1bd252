"""Pivots, lines, levels, and chart structures found from them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions.scalar import identity
from vantage.operators import sweep
from vantage.operators.families import FINDERS, Chart, Found, share
from vantage.operators.features import atr, series, true_ranges

LEFT = RIGHT = 3
ATR_SESSIONS = 14
FAMILIES = ("flat_base", "tight_consolidation", "double_bottom", "ascending_triangle", "volatility_contraction", *FINDERS)
#: Bars that a family needs before its first session.  Fixed values.
WARM = dict.fromkeys(FAMILIES, 60) | {"cup_handle": 90, "inverse_head_shoulders": 90, "base_on_base": 100, "breakout_retest": 100}
#: Sessions back to which pivots take part; the longest structure (a cup with its handle) spans 239.
REACH = 300
#: Bars before a block that its sessions may read: pivots in reach, and the trend before them.
OVERLAP = REACH + 64
WARM_UP = 60
BLOCK = 640


def swings(bars: DataFrame, left: int = LEFT, right: int = RIGHT) -> DataFrame:
    """Pivot highs and lows; strict on the left, ties to the earlier bar; knowable only ``right`` sessions later."""
    w = series()
    before, after = w.rowsBetween(-left, -1), w.rowsBetween(1, right)
    whole = (F.count(F.lit(1)).over(before) == left) & (F.count(F.lit(1)).over(after) == right)
    high = whole & (F.max("high").over(before) < F.col("high")) & (F.max("high").over(after) <= F.col("high"))
    low = whole & (F.min("low").over(before) > F.col("low")) & (F.min("low").over(after) >= F.col("low"))
    marked = bars.withColumns({"is_high": high, "is_low": low, "confirmed_date": F.lead("session_date", right).over(w)})
    both = F.array_compact(F.array(F.when(F.col("is_high"), F.struct(F.lit("high").alias("kind"), F.col("high").alias("price"))), F.when(F.col("is_low"), F.struct(F.lit("low").alias("kind"), F.col("low").alias("price")))))
    return marked.select("instrument_id", "session_date", "confirmed_date", F.explode(both).alias("x")).select("instrument_id", "session_date", "confirmed_date", "x.kind", "x.price")


def confirmed(pivots: DataFrame, as_of: Column) -> DataFrame:
    return pivots.where(F.col("confirmed_date") <= as_of)


def provisional(bars: DataFrame, right: int = RIGHT) -> DataFrame:
    """Highest high and lowest low of the tail that can't be confirmed yet."""
    tail = Window.partitionBy("instrument_id").orderBy(F.desc("session_date"))
    return bars.withColumn("_n", F.row_number().over(tail)).where(F.col("_n") <= right).groupBy("instrument_id").agg(F.max("high").alias("high"), F.min("low").alias("low"))


def extreme_pivots(pivots: DataFrame) -> DataFrame:
    """Highest high and lowest low of each series, ties to the earlier."""
    early = -F.unix_date("session_date")
    highs, lows = F.col("kind") == "high", F.col("kind") == "low"
    return pivots.groupBy("instrument_id").agg(
        F.max_by("session_date", F.when(highs, F.struct("price", early))).alias("highest_on"), F.max(F.when(highs, F.col("price"))).alias("highest"),
        F.max_by("session_date", F.when(lows, F.struct(-F.col("price"), early))).alias("lowest_on"), F.min(F.when(lows, F.col("price"))).alias("lowest"),
    )


def prior_trend(bars: DataFrame, n: int = 60) -> DataFrame:
    """Slope (share of the mean a session) and fit of closes over the trailing n sessions."""
    w = series()
    t = w.rowsBetween(-(n - 1), 0)
    x = F.row_number().over(w).cast("double")
    numbered = bars.withColumn("_x", x)
    return numbered.select("instrument_id", "session_date", F.when(F.col("_x") >= n, F.regr_slope("close", "_x").over(t) / F.avg("close").over(t)).alias("slope"), F.when(F.col("_x") >= n, F.regr_r2("close", "_x").over(t)).alias("fit"))


_LEVEL = "instrument_id int, touches long, level double, first_touch date, last_touch date, spread double"


def horizontal_levels(pivots: DataFrame, kind: str = "high", tolerance: float = 0.015, recent: int | None = None) -> DataFrame:
    """Each series' level: pivots within the tolerance of an anchor, most members wins, ties to the higher mean (lower for support).

    All pivots given take part, or the ``recent`` last ones of each series.  Sorted by price, the members of an anchor are one
    run, so counts and means come from positions and running sums, without a self-join.
    """
    p = pivots.where(F.col("kind") == kind)
    if recent is not None:
        last = Window.partitionBy("instrument_id").orderBy(F.desc("session_date"))
        p = p.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= recent)
    sign = 1 if kind == "high" else -1

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["price", "session_date"])
        price, days = x["price"].to_numpy(float), x["session_date"].to_numpy()
        reach = price * tolerance
        first = np.searchsorted(price, price - reach * (1 + 1e-9), side="left")
        while (out := price - price[first] > reach).any():  # the comparison itself decides at the edges
            first += out
        end = np.searchsorted(price, price + reach * (1 + 1e-9), side="right")
        while (out := price[end - 1] - price > reach).any():
            end -= out
        sums = np.concatenate(([0], np.cumsum(price.astype(np.longdouble))))
        touches, level = end - first, ((sums[end] - sums[first]) / (end - first)).astype(float)
        i = np.lexsort((sign * level, touches))[-1]
        own = slice(first[i], end[i])
        row = (key[0], touches[i], level[i], min(days[own]), max(days[own]), price[own].std())
        return pd.DataFrame([row], columns=[k.split()[0] for k in _LEVEL.split(", ")])

    best = p.select("instrument_id", "session_date", "price").groupBy("instrument_id").applyInPandas(run, _LEVEL)
    tight = 1 - F.least(F.col("spread") / (F.col("level") * tolerance), F.lit(1.0))
    confidence = 100 * (0.65 * F.least(F.col("touches") / 4, F.lit(1.0)) + 0.35 * tight)
    return best.select("instrument_id", "touches", "level", "first_touch", "last_touch", confidence.alias("confidence"))


def consolidation(bars: DataFrame, n: int = 40) -> DataFrame:
    """Shape of the last n sessions of each series: depth, slope, mean range, late over early range and volume."""
    tail = Window.partitionBy("instrument_id").orderBy(F.desc("session_date"))
    x = bars.withColumn("_k", F.row_number().over(tail)).where(F.col("_k") <= n).withColumn("_r", F.col("high") - F.col("low")).withColumn("_late", F.col("_k") <= n // 2)
    return x.groupBy("instrument_id").agg(
        (1 - F.min("low") / F.max("high")).alias("depth"),
        (-F.regr_slope("close", F.col("_k").cast("double")) / F.avg("close")).alias("slope"),
        F.avg(F.col("_r") / F.col("close")).alias("mean_range"),
        (F.avg(F.when(F.col("_late"), F.col("_r"))) / F.avg(F.when(~F.col("_late"), F.col("_r")))).alias("range_contraction"),
        (F.avg(F.when(F.col("_late"), F.col("volume"))) / F.avg(F.when(~F.col("_late"), F.col("volume")))).alias("volume_contraction"),
        (F.stddev_pop("close") / F.avg("close")).alias("dispersion"),
    )


def contractions(pivots: DataFrame) -> DataFrame:
    """Each pivot high with the next pivot low of its series: the depth of that pullback."""
    w = Window.partitionBy("instrument_id").orderBy("session_date", "kind").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("kind") == "low", F.struct("session_date", "price")), ignorenulls=True).over(w)
    return pivots.withColumn("_low", nxt).where("kind = 'high' and _low is not null").select("instrument_id", F.col("session_date").alias("high_on"), F.col("_low.session_date").alias("low_on"), (1 - F.col("_low.price") / F.col("price")).alias("depth"))


def _pivots(x: np.ndarray, left: int, right: int) -> np.ndarray:
    n = len(x)
    if n <= left + right:
        return np.zeros(0, int)
    highest = lambda size: np.lib.stride_tricks.sliding_window_view(x, size).max(axis=1)
    own = x[left : n - right]
    return left + np.flatnonzero((own > highest(left)[: len(own)]) & (own >= highest(right)[left + 1 :][: len(own)]))


def _flat_base(s: Chart, end: int) -> Iterator[Found]:
    """One for each ceiling of the last 65 sessions: its earliest touch without a higher high since."""
    for ceiling in s.highs[(s.highs >= end - 64) & (s.highs <= end)][::-1].tolist():
        top, a = s.high[ceiling : end + 1].max(), ceiling
        if s.high[ceiling] < top * 0.98:
            continue
        for i in s.highs[(s.highs < ceiling) & (s.highs >= end - 64)][::-1].tolist():
            if s.high[i] > top:
                break
            if s.high[i] >= top * 0.98:
                a = i
        floor = s.low[a : end + 1].min()
        depth = 1 - floor / top
        if a > end - 19 or depth > 0.2:
            continue
        touches = int((s.high[s.highs[s.highs >= a]] >= top * 0.98).sum())
        yield a, float(top), floor, {"depth": 1 - depth / 0.2, "touches": share(touches, 1, 4), "duration": share(end + 1 - a, 15, 35)}


def _tight(s: Chart, end: int) -> Iterator[Found]:
    a, stop = end - 14, end + 1
    if a < 30:
        return
    top, floor = s.high[a:stop].max(), s.low[a:stop].min()
    depth, was = 1 - floor / top, 1 - s.low[a - 30 : a].min() / s.high[a - 30 : a].max()
    if depth <= 0.12 and was > 0 and depth <= 0.6 * was:
        yield a, float(top), floor, {"contraction": 1 - depth / (0.6 * was), "tightness": 1 - depth / 0.12, "volume": share(s.volume[a - 30 : a].mean() / max(s.volume[a:stop].mean(), 1e-9), 0.8, 1.5)}


def _double_bottom(s: Chart, end: int) -> Iterator[Found]:
    lows = s.lows[s.lows >= end - 119].tolist()
    for b in reversed(lows):
        for a in lows:
            if a >= b - 10:
                break
            if ("bottoms", a, b) not in s.memo:
                s.memo["bottoms", a, b] = _bottoms(s, a, b)
            if s.memo["bottoms", a, b] is not None:
                yield s.memo["bottoms", a, b]


def _bottoms(s: Chart, a: int, b: int) -> Found | None:
    if abs(s.low[b] / s.low[a] - 1) > 0.06 or s.low[a : b + 1].min() < min(s.low[a], s.low[b]) * 0.97:
        return None
    top = s.high[a:b].max()
    rally, drop = top / s.low[a] - 1, 1 - s.low[a] / s.high[max(0, a - 60) : a + 1].max()
    if rally < 0.06 or drop < 0.12:
        return None
    return a, float(top), min(s.low[a], s.low[b]), {"symmetry": 1 - abs(s.low[b] / s.low[a] - 1) / 0.06, "rally": share(rally, 0.06, 0.2), "decline": share(drop, 0.12, 0.3)}


def _triangle(s: Chart, end: int) -> Iterator[Found]:
    """One for each set of pivot highs near an anchor, the set with the latest touch first, larger sets before smaller."""
    highs = s.highs[s.highs >= end - 99]
    if len(highs) < 2:
        return
    price = s.high[highs]
    near = np.abs(price[None] / price[:, None] - 1) <= 0.015
    sets = sorted({tuple(highs[n].tolist()) for n in near if n.sum() > 1}, key=lambda own: (-own[-1], -len(own), own))
    for own in sets:
        a, level, at = own[0], float(s.high[list(own)].mean()), s.high[list(own)]
        lows = s.lows[s.lows > a]
        if max(np.diff(own)) > 25 or len(lows) < 2 or (np.diff(s.low[lows]) <= 0).any():
            continue
        yield a, level, s.low[lows[-1]], {"flatness": 1 - float(at.std() / (0.015 * level)), "touches": share(len(own), 1, 4), "rising": share(len(lows), 1, 4)}


def _vcp(s: Chart, end: int) -> Iterator[Found]:
    """One for each high that none of the later ones exceeds, with pullbacks that shrink from there on; the latest start first."""
    highs = s.highs[s.highs >= end - 119]
    after = np.searchsorted(s.lows, highs, side="right")
    highs, after = highs[after < len(s.lows)], after[after < len(s.lows)]
    depths, prices = 1 - s.low[s.lows[after]] / s.high[highs], s.high[highs]
    for top in range(len(highs) - 2, -1, -1):
        if depths[top + 1] >= depths[top]:
            return  # no earlier start has shrinking pullbacks either
        if prices[top] < prices[top:].max() or depths[top] > 0.4:
            continue
        floor = s.low[highs[top] : end + 1].min()
        yield int(highs[top]), float(prices[top]), float(floor), {"count": share(len(highs) - top, 1, 4), "tightening": 1 - depths[-1] / depths[top], "depth": 1 - depths[top] / 0.4}


_FIND = dict(zip(FAMILIES[:5], (_flat_base, _tight, _double_bottom, _triangle, _vcp), strict=True)) | FINDERS
_SWEEP = dict(zip(FAMILIES[:5], (sweep.flat_base, sweep.tight_consolidation, sweep.double_bottom, sweep.ascending_triangle, sweep.volatility_contraction), strict=True)) | sweep.SWEEPS
_SWEEP["base_on_base"] = partial(sweep.base_on_base, reach=REACH - RIGHT)
_INSTANCE = "instrument_id int, session_date date, family string, start_date date, level double, invalidation double, quality double, touches int, confidence double, close double, atr double"
_BARS = ("open", "high", "low", "close", "volume")


class Walk:
    """A series (or a stretch of it) read session by session: its pivots stand in one index, of which a session sees those confirmed by then."""

    def __init__(self, bars: dict[str, np.ndarray], atr_values: np.ndarray) -> None:
        self.bars, self.atr = bars, atr_values
        self.highs, self.lows = _pivots(bars["high"], LEFT, RIGHT), _pivots(-bars["low"], LEFT, RIGHT)
        self.memo: dict = {}

    def sighted(self, t: int, age: int) -> Iterator[tuple[str, int, float, float, float, int, float]]:
        """Family, first position, level, invalidation, quality, touches and confidence of every structure seen at position t, one for each family and start.

        ``age`` is the session's number in its series, which decides whether a family's warm-up is met.
        """
        end = t - RIGHT
        highs, lows = (p[np.searchsorted(p, t - REACH) : np.searchsorted(p, end, side="right")] for p in (self.highs, self.lows))
        chart = Chart(*(self.bars[k][: t + 1] for k in _BARS), self.atr[: t + 1], highs, lows, self.memo)
        for family in FAMILIES:
            if age < WARM[family]:
                continue
            starts = set()
            for first, level, floor, parts in _FIND[family](chart, end):
                if first in starts:
                    continue
                starts.add(first)
                if floor < level:
                    level, floor = round(float(level), 6), round(float(floor), 6)
                    yield family, first, level, floor, round(100 * float(np.mean(list(parts.values()))), 4), *self._tested(chart, first, level)

    def swept(self, at: np.ndarray, ages: np.ndarray) -> tuple[np.ndarray, ...]:
        """As sighted() of all positions ``at`` (without a gap) and their ages, in columns with the position first; see the sweep."""
        whole = sweep.Stretch.of(Chart(*(self.bars[k] for k in _BARS), self.atr, self.highs, self.lows))
        found = []
        with np.errstate(all="ignore"):
            for n, family in enumerate(FAMILIES):
                ends = at[ages >= WARM[family]] - RIGHT
                rows = _SWEEP[family](whole, ends) if len(ends) else ()
                if len(rows) and len(rows[0]):
                    once = np.sort(np.unique(rows[0] * len(self.atr) + rows[1], return_index=True)[1])
                    once = once[rows[3][once] < rows[2][once]]
                    found.append((rows[0][once], np.full(len(once), n), *(x[once] for x in rows[1:])))
            if not found:
                none, nothing = np.zeros(0, int), np.zeros(0)
                return none, np.zeros(0, object), none, nothing, nothing, nothing, none, nothing
            end, n, first, level, floor, quality = (np.concatenate(x) for x in zip(*found, strict=True))
            level = sweep.rounded(level, 6)
            touches, confidence = sweep.tested(whole.chart, end, first, level)
            floor, quality, confidence = sweep.rounded(floor, 6), sweep.rounded(quality, 4), sweep.rounded(confidence, 4)
        return end + RIGHT, np.array(FAMILIES, object)[n], first, level, floor, quality, touches, confidence

    @staticmethod
    def _tested(chart: Chart, first: int, level: float) -> tuple[int, float]:
        """Confirmed highs of the structure within 1.5 % of its level, and how certain they make it."""
        price = chart.high[chart.highs[chart.highs >= first]]
        price = price[np.abs(price - level) <= level * 0.015]
        if not len(price):
            return 1, 35.0
        tight = 1 - min(float(price.std()) / (level * 0.015), 1.0)
        return len(price), round(100 * (0.65 * min(len(price) / 4, 1.0) + 0.35 * tight), 4)


def series_atr(x: pd.DataFrame) -> np.ndarray:
    return atr(*(x[k].to_numpy(float) for k in ("high", "low", "close")))


_PLACED = "instrument_id int, session_date date, open double, high double, low double, close double, volume double, position long, atr double"


def placed(bars: DataFrame) -> DataFrame:
    """Bars with their number in the series and the recursive ATR, which is the one thing that takes a series whole."""

    def spans(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("session_date")
        return x.assign(position=np.arange(len(x)), atr=series_atr(x))

    names = [k.split()[0] for k in _PLACED.split(", ")][:7]
    return bars.select(*names).groupBy("instrument_id").applyInPandas(spans, _PLACED)


def detect(bars: DataFrame) -> DataFrame:
    """Structures of each family as seen at every session of each series, one for each structural start.

    Geometry ends RIGHT bars before the session, where pivots are confirmed; quality is the mean of the family's components, 0 to 100.
    Pivots of the last REACH sessions take part, more than any family's longest structure; a head and shoulders or a retest is
    reported for RECENT sessions after its last pivot.  Sessions are dealt by (series, block of BLOCK sessions) with the OVERLAP
    bars before, so a series is read by many tasks.
    """
    return sightings(placed(bars))


def sightings(numbered: DataFrame) -> DataFrame:
    """As detect(), of bars that have their position and ATR already."""

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("position")
        days, at = x["session_date"].to_numpy(), x["position"].to_numpy()
        walk = Walk({k: x[k].to_numpy(float) for k in _BARS}, x["atr"].to_numpy(float))
        own = np.flatnonzero((at >= WARM_UP) & (at // BLOCK == key[1]))
        t, family, first, *rest = walk.swept(own, at[own])
        columns = (np.full(len(t), key[0]), days[t], family, days[first], *rest, walk.bars["close"][t], walk.atr[t])
        return pd.DataFrame(dict(zip((k.split()[0] for k in _INSTANCE.split(", ")), columns, strict=True)))

    block = F.explode(F.sequence(F.floor(F.col("position") / BLOCK), F.floor((F.col("position") + OVERLAP) / BLOCK)))
    tasks = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: rows are few and work is much, so they mustn't be coalesced by size
    return numbered.withColumn("block", block).repartition(tasks, "instrument_id", "block").groupBy("instrument_id", "block").applyInPandas(run, _INSTANCE)


def skipped(bars: DataFrame) -> DataFrame:
    """instrument_id, family and missing of every family that a series is too short for."""
    n = bars.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n"))
    need = F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.lit(k + 1).alias("need")) for f, k in WARM.items()))).alias("x")
    return n.select("instrument_id", "n", need).where("n < x.need").select("instrument_id", "x.family", (F.col("x.need") - F.col("n")).alias("missing"))


def rescan_state(bars: DataFrame, sessions: int = 1) -> DataFrame:
    """What a later rescan of the last ``sessions`` sessions of each series needs besides its last bars: the number and the ATR of the bar before them."""
    last = Window.partitionBy("instrument_id").orderBy(F.desc("position"))
    return placed(bars).withColumn("_k", F.row_number().over(last)).where(F.col("_k") == sessions + OVERLAP + 1).select("instrument_id", "position", "close", "atr")


def detect_latest(bars: DataFrame, sessions: int = 1, state: DataFrame | None = None) -> DataFrame:
    """Structures seen at the last sessions of each series, from the last OVERLAP bars before them and ``state`` (see rescan_state()) alone.

    The smoothed range goes on from the stored one, so the result is that of a full scan in every column.  Without a stored state
    it is computed from all bars first.
    """
    state = rescan_state(bars, sessions) if state is None else state
    last = Window.partitionBy("instrument_id").orderBy(F.desc("session_date"))
    tail = bars.withColumn("_k", F.row_number().over(last)).where(F.col("_k") <= sessions + OVERLAP)

    def go_on(key: tuple, x: pd.DataFrame, was: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("session_date")
        if len(was):
            whole = pd.DataFrame({k: np.concatenate(([was["close"].iloc[0]], x[k].to_numpy(float))) for k in ("high", "low", "close")})
            ranges = true_ranges(*(whole[k].to_numpy() for k in ("high", "low", "close")))[1:]
            span, out = float(was["atr"].iloc[0]), []
            for r in ranges:
                span += 1 / ATR_SESSIONS * (r - span)
                out.append(span)
            return x.assign(position=np.arange(len(x)) + int(was["position"].iloc[0]) + 1, atr=out)
        return x.assign(position=np.arange(len(x)), atr=series_atr(x))

    names = [k.split()[0] for k in _PLACED.split(", ")][:7]
    numbered = tail.select(*names).groupBy("instrument_id").cogroup(state.groupBy("instrument_id")).applyInPandas(go_on, _PLACED)
    recent = tail.where(F.col("_k") <= sessions).select("instrument_id", "session_date")
    return sightings(numbered).join(recent, ["instrument_id", "session_date"], "left_semi")


def across_timeframes(daily: DataFrame, weekly: DataFrame) -> DataFrame:
    """Edges between structures of two timeframes (instrument_id, key, start_date, end_date) with real overlap: the coarser contains the finer.

    A pair meets once, on instrument and the year in which the later of the two starts: a structure of one side comes to the year of
    its start and looks for those of the other that are under way there and started before.  So no pair is kept to be compared
    with others, and what is shuffled grows with the structures, not with their pairs.
    """
    days = lambda x, y: F.datediff(y, x) + 1
    both = days(F.greatest("a.start_date", "b.start_date"), F.least("a.end_date", "b.end_date"))
    part = F.greatest(both / days(F.col("a.start_date"), F.col("a.end_date")), both / days(F.col("b.start_date"), F.col("b.end_date")))
    starts = lambda x: x.withColumn("_y", F.year("start_date"))
    under_way = lambda x: x.withColumn("_y", F.explode(F.sequence(F.year("start_date"), F.year("end_date"))))

    def met(a: DataFrame, b: DataFrame, order: Column) -> DataFrame:
        meet = (F.col("a.instrument_id") == F.col("b.instrument_id")) & (F.col("a._y") == F.col("b._y")) & order & (part >= 0.25)
        return a.alias("a").join(b.alias("b"), meet).select(F.col("a.key").alias("from_key"), F.col("b.key").alias("to_key"), F.lit("CONTAINS").alias("kind"))

    later = met(under_way(weekly), starts(daily), F.col("a.start_date") <= F.col("b.start_date"))
    return later.unionByName(met(starts(weekly), under_way(daily), F.col("b.start_date") < F.col("a.start_date")))


#: Least quality of a structure, and of one past forming; buffer over the level of a break, and distance below it of an approach.
LEAST_QUALITY, MATURE_QUALITY, BREAK_BUFFER, NEAR = 25.0, 45.0, 0.002, 0.03


def with_state(found: DataFrame, least: float = LEAST_QUALITY) -> DataFrame:
    """Identity and state of each structure; weak ones go."""
    c, level = F.col("close"), F.col("level")
    near = (c >= level * (1 - NEAR)) & (F.col("family") != "breakout_retest")  # a retest's level has been crossed before
    state = (
        F.when(c < F.col("invalidation"), "INVALIDATED").when(F.col("quality") < MATURE_QUALITY, "FORMING").when(c > level * (1 + BREAK_BUFFER), "BROKEN_OUT_UNCONFIRMED").when(near, "NEAR_BREAKOUT").otherwise("MATURE")
    )
    return found.where(F.col("quality") >= least).withColumn("state", state).withColumn("key", identity(F.col("instrument_id"), F.col("family"), F.lit("1d"), F.col("start_date")))


def state_of(family: str, close: float, level: float, floor: float, quality: float) -> str:
    """As with_state(), for one structure inside a fold."""
    if close < floor:
        return "INVALIDATED"
    if quality < MATURE_QUALITY:
        return "FORMING"
    if close > level * (1 + BREAK_BUFFER):
        return "BROKEN_OUT_UNCONFIRMED"
    return "NEAR_BREAKOUT" if close >= level * (1 - NEAR) and family != "breakout_retest" else "MATURE"


def states_of(family: np.ndarray, close: np.ndarray, level: np.ndarray, floor: np.ndarray, quality: np.ndarray) -> np.ndarray:
    """As state_of(), of many."""
    near = (close >= level * (1 - NEAR)) & (family != "breakout_retest")
    names = ("INVALIDATED", "FORMING", "BROKEN_OUT_UNCONFIRMED", "NEAR_BREAKOUT")
    return np.select((close < floor, quality < MATURE_QUALITY, close > level * (1 + BREAK_BUFFER), near), names, "MATURE").astype(object)


def violations(found: DataFrame) -> DataFrame:
    """Structures whose geometry can't be; must be empty."""
    return found.where((F.col("invalidation") >= F.col("level")) | (F.col("level") <= 0) | (F.col("start_date") >= F.col("session_date")) | F.isnan("level"))


def family_counts(found: DataFrame, number: Column | None = None) -> DataFrame:
    """Count for every family, also those with nothing; ``number``: how many the rows of a family stand for, if not one each."""
    families = found.sparkSession.createDataFrame([(f,) for f in FAMILIES], "family string")
    return families.join(found.groupBy("family").agg((F.count(F.lit(1)) if number is None else number).alias("n"), F.count_distinct("instrument_id").alias("instruments")), "family", "left").na.fill(0)
