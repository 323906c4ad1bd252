"""Column expressions shared by the operators."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def covers(on: Column, valid_from: Column, valid_to: Column) -> Column:
    """Half-open interval membership; no end means still valid."""
    return (valid_from <= on) & (valid_to.isNull() | (valid_to > on))


def fixed(x: Column, digits: int = 6) -> Column:
    """A double cut to so many decimals the same way in every engine."""
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + F.lit(0.5)) / scale


def let(x: Column, then) -> Column:
    """``then`` of a value that it uses more than once, evaluated once and written once in the plan."""
    return F.element_at(F.transform(F.array(x), then), 1)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def scaled(x: Column, low: float, high: float) -> Column:
    """0 at ``low``, 1 at ``high``, straight between."""
    return clamp((x - low) / (high - low), 0.0, 1.0)


def ramp(x: Column, low: float, high: float) -> Column:
    """Score 0 to 100, rising from ``low`` to ``high``."""
    return scaled(x, low, high) * 100


def decay(x: Column, full: float, zero: float) -> Column:
    """Score 100 up to ``full``, falling to 0 at ``zero``."""
    return (1 - scaled(x, full, zero)) * 100


def band(x: Column, low: float, best_low: float, best_high: float, high: float) -> Column:
    """Score 100 within the best range, falling to 0 at the outer bounds."""
    return F.when(x.isNotNull(), F.least(ramp(x, low, best_low), decay(x, best_high, high)))


def step(x: Column, *steps: tuple[float, float]) -> Column:
    """Score of the highest threshold reached; 0 below all."""
    out = F.lit(0.0)
    for at, score in sorted(steps):
        out = F.when(x >= at, F.lit(float(score))).otherwise(out)
    return out


def ramp_between(x: Column, zero: float | Column, full: float | Column, floor: float = 0.0, cap: float = 100.0) -> Column:
    """``floor`` at ``zero``, ``cap`` at ``full`` (on either side of it), straight between and level outside; null stays null."""
    share = (x - zero) / (full - zero)
    return F.when(x.isNotNull(), F.greatest(F.least(floor + (cap - floor) * share, F.lit(cap)), F.lit(floor)))


def between(x: Column, ideal_low: float, ideal_high: float, low: float, high: float, floor: float = 0.0) -> Column:
    """100 in the ideal range, falling to ``floor`` at the outer bounds."""
    return F.when(x < ideal_low, ramp_between(x, low, ideal_low, floor)).when(x > ideal_high, ramp_between(x, high, ideal_high, floor)).when(x.isNotNull(), 100.0)


def piecewise(x: Column, points: list[tuple[float, float]]) -> Column:
    """Straight lines through the points, level outside them; a missing value takes the first."""
    out = F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(points[:-1], points[1:], strict=True))):
        out = F.when(x <= x1, y0 + (y1 - y0) * (x - x0) / (x1 - x0)).otherwise(out)
    return F.when(x.isNull() | F.isnan(x) | (x <= points[0][0]), float(points[0][1])).otherwise(out)


def structure_confidence(coverage: Column, scores: Column, sessions: Column, least: int) -> Column:
    """0 to 100: .45 share of the weight that was available, .35 agreement of the component scores, .20 maturity."""
    have = F.filter(scores, lambda v: v.isNotNull())
    mean = F.aggregate(have, F.lit(0.0), lambda a, v: a + v) / F.size(have)
    spread = F.sqrt(F.aggregate(have, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / F.size(have))
    agreement = F.when(F.size(have) >= 2, clamp(1 - spread / 30, 0.0, 1.0)).otherwise(0.5)
    return clamp((0.45 * coverage + 0.35 * agreement + 0.2 * clamp(sessions / (2.0 * least), 0.0, 1.0)) * 100, 0.0, 100.0)


def weighted(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean over the parts that are not null; null when none is."""
    have = [(v, w) for v, w in parts.values()]
    total = sum((F.when(v.isNotNull(), F.lit(float(w))).otherwise(0.0) for v, w in have), F.lit(0.0))
    mass = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in have), F.lit(0.0))
    return F.when(total > 0, mass / total)


def listed(**conditions: Column) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items())))


def identity(*parts: Column, size: int = 24) -> Column:
    """A stable key from the parts."""
    return F.substring(F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256), 1, size)


def identity_of(*parts: object, size: int = 24) -> str:
    """As identity(), of plain values inside a fold."""
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:size]


def digest(x: Column, digits: int = 4) -> Column:
    """A double cut to few decimals at a point that averages of round numbers never meet, so engines agree on it."""
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + F.lit(0.4871)) / scale


def digest_sql(x: str, digits: int = 4) -> str:
    return f"floor(({x}) * 1e{digits} + 4871e-4) / 1e{digits}"
