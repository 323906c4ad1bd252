"""Chart structures built on an advance, on rims, on shoulders or on two bases: what each looks for at one session.

A finder gets the bars up to the session (positions from 0), the confirmed pivots among them and the last position at which
pivots are confirmed.  It yields (first position, resistance, invalidation, component scores from 0 to 1) of every structure
that passes its gates, the most recently completed first.  What depends on older pivots alone is kept in the chart's memo, so
a session only looks at what its new pivots and bars can change.  The gates are fixed values of the default configuration.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

Found = tuple[int, float, float, dict[str, float]]
#: Sessions for which a shape that needs no further bar is reported after its last pivot.
RECENT = 60


@dataclass
class Chart:
    open: np.ndarray
    high: np.ndarray
    low: np.ndarray
    close: np.ndarray
    volume: np.ndarray
    atr: np.ndarray
    highs: np.ndarray
    lows: np.ndarray
    memo: dict = field(default_factory=dict)


def share(value: float, zero: float, full: float) -> float:
    """0 at ``zero``, 1 at ``full``, straight between."""
    return float(min(max((value - zero) / (full - zero), 0.0), 1.0))


def held(value: float, low: float, best_low: float, best_high: float, high: float) -> float:
    """1 in the best range, falling to 0 at the outer bounds."""
    return share(value, low, best_low) if value < best_low else 1 - share(value, best_high, high) if value > best_high else 1.0


def _drift(chart: Chart, at: int, n: int = 60) -> float | None:
    """Gain over the n sessions up to a position; nothing where there are fewer than ten."""
    first = max(0, at - n + 1)
    return None if at - first < 9 else float(chart.close[at] / chart.close[first] - 1)


def _advances(chart: Chart, end: int, sessions: tuple[int, int], rest: tuple[int, int]) -> Iterator[tuple[int, int, float]]:
    """(origin, peak, gain) of the advances from a confirmed low to the highest high since; newest origin first, each peak once."""
    known = set()
    for origin in chart.lows[chart.lows >= 20][::-1].tolist():
        peak = origin + int(chart.high[origin : end + 1].argmax())
        if peak not in known and sessions[0] <= peak - origin <= sessions[1] and rest[0] <= end - peak <= rest[1]:
            known.add(peak)
            yield origin, peak, float(chart.high[peak] / chart.low[origin] - 1)


def _dry(chart: Chart, first: int, peak: int, end: int) -> float:
    """How far volume falls off after the peak."""
    return 1 - share(chart.volume[peak + 1 : end + 1].mean() / max(chart.volume[first : peak + 1].mean(), 1e-9), 0.6, 1.3)


def bull_flag(chart: Chart, end: int) -> Iterator[Found]:
    for origin, peak, gain in _advances(chart, end, (3, 40), (3, 30)):
        base, top = chart.low[origin], chart.high[peak]
        steps = np.diff(chart.close[origin : peak + 1])
        total = chart.close[peak] - base
        in_atr = base * gain / chart.atr[origin] if chart.atr[origin] > 0 else 0.0
        if gain < 0.08 or in_atr < 3 or total <= 0 or steps.max() / total > 0.75 or end - peak > 2.5 * (peak - origin):
            continue
        flag = slice(peak + 1, end + 1)
        low = chart.low[flag].min()
        back, width = (top - low) / (top - base), (chart.high[flag].max() - low) / top
        slope = np.polyfit(np.arange(end - peak), chart.close[flag], 1)[0] / chart.close[flag].mean()
        if back > 0.62 or width > 0.2:
            continue
        parts = {
            "flagpole": (share(gain, 0.08, 0.25) + share(in_atr, 3, 8)) / 2,
            "consolidation": (held(slope, -0.012, -0.004, 0.0005, 0.006) + 1 - share(width, 0.08, 0.2)) / 2,
            "retracement": held(back, 0.02, 0.15, 0.4, 0.62),
            "duration": held(end - peak, 2, 5, 15, 31),
            "volume_structure": _dry(chart, origin, peak, end),
        }
        yield origin, float(chart.high[flag].max()), float(low), parts


def pennant(chart: Chart, end: int) -> Iterator[Found]:
    for origin, peak, gain in _advances(chart, end, (3, 25), (5, 25)):
        if gain < 0.1 or end - peak > 1.2 * (peak - origin):
            continue
        flag, third = slice(peak + 1, end + 1), max(2, (end - peak) // 3)
        tops = chart.high[flag][:third].max(), chart.high[flag][-third:].max()
        floors = chart.low[flag][:third].min(), chart.low[flag][-third:].min()
        closing = 1 - (tops[1] - floors[1]) / (tops[0] - floors[0])
        steep = sorted((tops[0] - tops[1], floors[1] - floors[0]))
        if closing < 0.35 or steep[0] <= 0 or steep[1] > 3 * steep[0]:
            continue
        parts = {"impulse": share(gain, 0.1, 0.3), "convergence": share(closing, 0.35, 0.45), "symmetry": 1 - share(steep[1] / steep[0], 1, 3), "duration": held(end - peak, 4, 6, 15, 26), "volume": _dry(chart, origin, peak, end)}
        yield origin, float(chart.high[flag].max()), float(chart.low[flag].min()), parts


def high_tight_flag(chart: Chart, end: int) -> Iterator[Found]:
    for origin, peak, gain in _advances(chart, end, (8, 50), (4, 25)):
        low = chart.low[peak + 1 : end + 1].min()
        depth = 1 - low / chart.high[peak]
        if gain >= 0.7 and depth <= 0.25:
            parts = {"advance": share(gain, 0.7, 1.1), "depth": 1 - share(depth, 0.12, 0.25), "duration": held(end - peak, 3, 6, 18, 26), "volume": _dry(chart, origin, peak, end)}
            yield origin, float(chart.high[peak]), float(low), parts


def cup_handle(chart: Chart, end: int) -> Iterator[Found]:
    for right in chart.highs[(chart.highs <= end - 4) & (chart.highs >= end - 35)][::-1].tolist():
        prior = chart.highs[(chart.highs >= right - 200) & (chart.highs < right)]
        if not len(prior):
            continue
        left = int(prior[chart.high[prior] >= chart.high[prior].max() * 0.97][0])
        inside = chart.lows[(chart.lows > left) & (chart.lows < right)]
        rim = chart.high[left]
        if not 25 <= right - left <= 200 or not len(inside) or abs(chart.high[right] / rim - 1) > 0.2:
            continue
        bottom = int(inside[chart.low[inside].argmin()])
        depth = 1 - chart.low[bottom] / rim
        handle = chart.low[right + 1 : end + 1].min()
        drop = (chart.high[right] - handle) / (chart.high[right] - chart.low[bottom])
        floor = chart.low[bottom] + 0.33 * (rim - chart.low[bottom])
        rounded = float((chart.close[left : right + 1] <= floor).mean())
        if not 0.1 <= depth <= 0.45 or drop > 1:
            continue
        parts = {"depth": held(depth, 0.1, 0.14, 0.32, 0.45), "symmetry": 1 - share(abs(chart.high[right] / rim - 1), 0, 0.2), "roundness": share(rounded, 0.05, 0.2), "handle": 1 - share(drop, 0.15, 0.4), "duration": held(right - left, 24, 35, 120, 201)}
        yield left, float(chart.high[right]), float(min(handle, floor)), parts


def _shoulders(chart: Chart, right: int) -> Found | None:
    """The shape whose right shoulder a confirmed low is; no later bar changes it."""
    before = chart.lows[np.searchsorted(chart.lows, right - 160) : np.searchsorted(chart.lows, right)]
    if len(before) < 2:
        return None
    head = int(before[chart.low[before].argmin()])
    lefts = before[before < head]
    if not len(lefts):
        return None
    left = int(lefts[chart.low[lefts].argmin()])
    shoulder = min(chart.low[left], chart.low[right])
    prominence = 1 - chart.low[head] / shoulder
    if right - left < 20 or prominence < 0.04:
        return None
    necks = [chart.highs[np.searchsorted(chart.highs, a, side="right") : np.searchsorted(chart.highs, b)] for a, b in ((left, head), (head, right))]
    fall = _drift(chart, left)
    high = chart.high[max(0, left - 60) : left + 1].max()
    if not all(len(n) for n in necks) or fall is None or fall > -0.05 or 1 - chart.low[left] / high < 0.1:
        return None
    neck = [float(chart.high[n].max()) for n in necks]
    sides = sorted((head - left, right - head))
    parts = {"prominence": share(prominence, 0.04, 0.12), "shoulders": 1 - share(abs(chart.low[left] / chart.low[right] - 1), 0.02, 0.4), "timing": 1 - share(sides[1] / sides[0], 1, 2.5), "neckline": 1 - share(abs(neck[0] / neck[1] - 1), 0.01, 0.1), "decline": share(1 - chart.low[left] / high, 0.1, 0.25)}
    return left, max(neck), float(chart.low[head]), parts


def inverse_head_shoulders(chart: Chart, end: int) -> Iterator[Found]:
    for right in chart.lows[::-1].tolist():
        if right < end - RECENT:
            return
        if ("shoulders", right) not in chart.memo:
            chart.memo["shoulders", right] = _shoulders(chart, right)
        found = chart.memo["shoulders", right]
        if found is not None:
            yield found


def base_on_base(chart: Chart, end: int) -> Iterator[Found]:
    def opening(ceiling: int, tops: np.ndarray) -> int:
        """The earliest pivot at a ceiling's level without a higher one since."""
        level, first = chart.high[ceiling], ceiling
        for i in tops[tops < ceiling][::-1].tolist():
            if chart.high[i] > level * 1.015:
                break
            if chart.high[i] >= level * 0.985:
                first = i
        return first

    for ceiling in chart.highs[::-1].tolist():
        if ceiling < end - 80:
            return
        second = opening(ceiling, chart.highs)
        earlier = chart.highs[(chart.highs < second) & (chart.highs >= second - 80)]
        if not len(earlier) or not 12 <= end - second + 1 <= 80:
            continue
        first = opening(int(earlier[chart.high[earlier].argmax()]), chart.highs)
        rise = _drift(chart, first)
        if not 12 <= second - first <= 80 or rise is None or rise < 0.15:
            continue
        tops, floors = ((chart.high[a:b].max(), chart.low[a:b].min()) for a, b in ((first, second), (second, end + 1)))
        (top1, low1), (top2, low2) = tops, floors
        ahead, under = top2 / top1 - 1, 1 - low2 / low1
        depths = 1 - low1 / top1, 1 - low2 / top2
        if max(depths) > 0.22 or not -0.03 <= ahead <= 0.15 or under > 0.03:
            continue
        parts = {"depth": 1 - share(max(depths), 0.11, 0.22), "ceiling": 1 - share(abs(ahead - 0.05), 0.02, 0.1), "support": 1 - share(under, -0.02, 0.03), "prior_trend": share(rise, 0.15, 0.4), "tightening": 1 - share(depths[1] / max(depths[0], 1e-9), 0.6, 1.4)}
        yield first, float(top2), float(low2), parts


def _tested_level(chart: Chart, anchor: int) -> tuple[float, int, int, int] | None:
    """Level, first and last touch and touches of the pivots up to an anchor, if price respected it."""
    own = chart.highs[np.searchsorted(chart.highs, anchor - 90) : np.searchsorted(chart.highs, anchor, side="right")]
    price = chart.high[own]
    near = np.abs(price[:, None] - price[None]) <= price[:, None] * 0.015
    n = near.sum(axis=1)
    if n.max() < 3:
        return None
    level, best = max(((float(price[near[i]].mean()), i) for i in np.flatnonzero(n == n.max()).tolist()), key=lambda x: x[0])
    touched = own[near[best]]
    first, last = int(touched[0]), int(touched[-1])
    if last - first < 20 or (chart.close[first : last + 1] < level).mean() < 0.85:
        return None
    return level, first, last, len(touched)


def breakout_retest(chart: Chart, end: int) -> Iterator[Found]:
    for anchor in chart.highs[chart.highs < end - 2][::-1].tolist():
        if anchor < end - 60 - RECENT:
            return
        if ("level", anchor) not in chart.memo:
            chart.memo["level", anchor] = _tested_level(chart, anchor)
        if chart.memo["level", anchor] is None:
            continue
        level, first, last, touches = chart.memo["level", anchor]
        over = np.flatnonzero(chart.close[last + 1 : end + 1] > level * 1.005)
        if last >= end or not len(over):
            continue
        broke = last + 1 + int(over[0])
        peak = broke + int(chart.high[broke : min(end, broke + 30) + 1].argmax())
        if not chart.atr[broke] > 0 or chart.high[peak] - level < chart.atr[broke] or (chart.close[broke : peak + 1] > level).sum() < 3:
            continue
        lows = chart.lows[(chart.lows >= peak + 2) & (chart.lows <= min(end, peak + 30))]
        back = lows[(chart.low[lows] >= level * 0.93) & (chart.low[lows] <= level * 1.04)]
        if not len(back):
            continue
        low = chart.low[back[0]]
        parts = {"level": share(touches, 2, 5), "span": share(last - first, 20, 60), "excursion": share((chart.high[peak] - level) / chart.atr[broke], 1, 4), "proximity": 1 - share(abs(low / level - 1), 0.015, 0.04), "hold": float((chart.close[back[0] : end + 1] >= level * 0.97).mean())}
        yield first, float(chart.high[peak]), float(min(low, level * 0.97)), parts


FINDERS: dict[str, Callable[[Chart, int], Iterator[Found]]] = {
    f.__name__: f for f in (bull_flag, pennant, cup_handle, high_tight_flag, inverse_head_shoulders, base_on_base, breakout_retest)
}
