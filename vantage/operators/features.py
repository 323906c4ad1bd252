"""Causal features per series: window expressions, and one grouped kernel for true recursions.

Row i depends on rows up to i only, and a window that isn't full gives null, never a short window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16
_KEYS: ContextVar[tuple[str, ...]] = ContextVar("series_keys", default=("instrument_id",))


def keys() -> tuple[str, ...]:
    """The columns that make a series, for every window and kernel."""
    return _KEYS.get()


@contextmanager
def keyed(*names: str) -> Iterator[None]:
    """Within it, a series is what shares these columns; with the episode among them, nothing reaches across a structural break."""
    token = _KEYS.set(names)
    try:
        yield
    finally:
        _KEYS.reset(token)


def series() -> Window:
    return Window.partitionBy(*keys()).orderBy("session_date")


def trailing(n: int):
    return series().rowsBetween(-(n - 1), 0)


def prior(n: int):
    return series().rowsBetween(-n, -1)


def warm(n: int, x: Column) -> Column:
    """Null before the n-th row of the series."""
    return F.when(F.row_number().over(series()) >= n, x)


def full(n: int, x: Column, y: Column) -> Column:
    """y where the last n values of x are all there."""
    return F.when(F.count(x).over(trailing(n)) >= n, y)


def sma(x: Column, n: int) -> Column:
    """A missing value counts as 0; the divisor stays n."""
    return warm(n, F.sum(F.coalesce(x, F.lit(0.0))).over(trailing(n)) / n)


def rate_of_change(x: Column, n: int) -> Column:
    was = F.lag(x, n).over(series())
    return F.when(was != 0, x / was - 1)


def true_range() -> Column:
    was = F.lag("close", 1).over(series())
    return F.when(was.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - was), F.abs(F.col("low") - was)))


def log_return() -> Column:
    was = F.lag("close", 1).over(series())
    return F.when((was > 0) & (F.col("close") > 0), F.log(F.col("close") / was))


def realized_volatility(r: Column, n: int, per_year: int = 252) -> Column:
    return full(n, r, F.stddev_samp(r).over(trailing(n)) * math.sqrt(per_year))


def bollinger(x: Column, n: int = 20, k: float = 2.0) -> dict[str, Column]:
    middle, width = warm(n, F.avg(x).over(trailing(n))), F.stddev_pop(x).over(trailing(n)) * k
    return {"middle": middle, "upper": middle + width, "lower": middle - width, "bandwidth": F.when(middle != 0, 2 * width / middle)}


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def on_balance_step() -> Column:
    """What a session adds to on-balance volume; sum it over the series so far."""
    return F.coalesce(F.signum(F.col("close") - F.lag("close", 1).over(series())) * F.col("volume"), F.lit(0.0))


def relative_volume(n: int = 20) -> Column:
    """Against the n sessions before; today is not part of its own average."""
    mean = F.avg("volume").over(prior(n))
    return warm(n + 1, F.when(mean > 0, F.col("volume") / mean))


def average_dollar_volume(n: int) -> Column:
    return warm(n, F.avg(typical_price() * F.col("volume")).over(trailing(n)))


def rolling_vwap(n: int) -> Column:
    total = F.sum("volume").over(trailing(n))
    return warm(n, F.when(total > 0, F.sum(typical_price() * F.col("volume")).over(trailing(n)) / total))


def rolling_max(x: Column, n: int) -> Column:
    return warm(n, F.max(x).over(trailing(n)))


def rolling_min(x: Column, n: int) -> Column:
    return warm(n, F.min(x).over(trailing(n)))


def distance_from(x: Column, reference: Column) -> Column:
    return F.when(reference > 0, x / reference - 1)


def slope(x: Column, n: int) -> Column:
    was = F.lag(x, n).over(series())
    return F.when(was != 0, (x / was - 1) / n)


def contraction(x: Column, short: int, long: int) -> Column:
    base = sma(x, long)
    return F.when(base > 0, sma(x, short) / base)


def percent_rank(x: Column, n: int) -> Column:
    """Share of the other values of the last n that are at most x, ties within rounding counted in; two values at least."""
    seen = F.collect_list(x).over(trailing(n))
    least = F.abs(x) * (32 * EPS)
    below = F.size(F.filter(seen, lambda v: v <= x + least))
    return warm(n, F.when(x.isNotNull() & (F.size(seen) >= 2), (below - 1) / (F.size(seen) - 1)))


def gap_flag(threshold: float) -> Column:
    """1 where the open lies beyond the threshold from the close before; its moving average is the gap frequency."""
    was = F.lag("close", 1).over(series())
    return F.when(was > 0, (F.abs(F.col("open") / was - 1) > threshold).cast("double"))


def _seeded(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """Exponential smoothing from the mean of the first n defined values on."""
    out = np.full(len(x), np.nan)
    good = np.flatnonzero(~np.isnan(x))
    if len(good) < n:
        return out
    first = good[0] + n - 1
    value = x[good[0] : first + 1].mean()
    value, smooth = float(value), []
    for v in x[first:].tolist()[1:]:  # plain floats: the same sums as numpy's scalars at a fifth of their time
        value += alpha * (v - value)
        smooth.append(value)
    out[first], out[first + 1 :] = x[good[0] : first + 1].mean(), smooth
    return out


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return _seeded(x, n, 2 / (n + 1))


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return _seeded(x, n, 1 / n)


def rsi(close: np.ndarray, n: int = 14) -> np.ndarray:
    move = np.diff(close, prepend=np.nan)
    up, down = wilder(np.where(np.isnan(move), np.nan, np.maximum(move, 0)), n), wilder(np.where(np.isnan(move), np.nan, np.maximum(-move, 0)), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 100 - 100 / (1 + up / down)
    out[(down == 0) & (up > 0)] = 100
    out[(down == 0) & (up == 0)] = 50
    return out


def macd(close: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    line = ema(close, fast) - ema(close, slow)
    smooth = ema(line, signal)
    return line, smooth, line - smooth


def true_ranges(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    was = np.concatenate(([np.nan], close[:-1]))
    return np.where(np.isnan(was), np.nan, np.maximum(high - low, np.maximum(np.abs(high - was), np.abs(low - was))))


def atr(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> np.ndarray:
    return wilder(true_ranges(high, low, close), n)


def adx(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ADX, +DI and -DI; moves that differ by rounding only count for neither side.

    Undefined where the smoothed range is 0, ADX also where there is no movement either way, and all in a series of 2 n sessions or fewer.
    """
    none = np.full(len(close), np.nan)
    if len(close) < 2 * n + 1:
        return none, none.copy(), none.copy()
    up, down = np.diff(high, prepend=np.nan), -np.diff(low, prepend=np.nan)
    size = np.maximum(np.abs(high), np.abs(low))
    tie = 32 * EPS * np.maximum(size, np.concatenate(([0.0], size[:-1])))
    plus = np.where((up > down + tie) & (up > tie), up, 0.0)
    minus = np.where((down > up + tie) & (down > tie), down, 0.0)
    plus[:1], minus[:1] = np.nan, np.nan
    span = wilder(true_ranges(high, low, close), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        p, m = (np.where(span > 0, 100 * wilder(x, n) / span, np.nan) for x in (plus, minus))
        dx = np.where(p + m > 0, 100 * np.abs(p - m) / (p + m), np.nan)
    return wilder(dx, n), p, m


RECURSIVE = ("ema_12", "ema_26", "wilder_14", "rsi_14", "macd", "macd_signal", "macd_histogram", "atr_14", "atr_percent", "adx_14", "plus_di", "minus_di")


def _with_features(x: DataFrame, windows: tuple[str, ...] = ()) -> DataFrame:
    """``x`` with all recursive features, behind those of ``windows``, each series in one Arrow batch; rows that stand partitioned by series aren't shuffled again."""

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t.column("session_date")))
        at = lambda k: t.column(k).to_numpy().astype(float)
        h, lo, c = at("high"), at("low"), at("close")
        a = atr(h, lo, c)
        with np.errstate(all="ignore"):
            percent = np.where(c > 0, a / c * 100, np.nan)
            found = windowed(at("open"), h, lo, c, at("volume"), at("r")) if windows else {}
            found |= zip(RECURSIVE, (ema(c, 12), ema(c, 26), wilder(c, 14), rsi(c), *macd(c), a, percent, *adx(h, lo, c)), strict=True)
        new = [pa.array(y, pa.float64(), mask=np.isnan(y)) for y in found.values()]
        return pa.Table.from_arrays([*t.columns, *new], names=[*t.column_names, *found])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema)
    return x.groupBy(*keys()).applyInArrow(run, f"{kinds}, " + ", ".join(f"{n} double" for n in (*windows, *RECURSIVE)))


def recursive_features(bars: DataFrame) -> DataFrame:
    """All recursive features of each series in one pass over one shuffle."""
    return _with_features(bars.select(*keys(), "session_date", "high", "low", "close")).drop("high", "low", "close")


def window_features(bars: DataFrame) -> DataFrame:
    """The non-recursive features; all windows share one partitioning and order, so one sort serves them."""
    c, v = F.col("close"), F.col("volume")
    staged = bars.withColumns({"tr": true_range(), "r": log_return(), "obv_step": on_balance_step(), "gap": gap_flag(0.01)}).withColumn("obv", F.sum("obv_step").over(series().rowsBetween(Window.unboundedPreceding, 0)))
    out = {f"sma_{n}": sma(c, n) for n in (10, 20, 50, 100, 200)}
    out |= {f"roc_{n}": rate_of_change(c, n) for n in (5, 20, 60, 120, 252)}
    out |= {f"volatility_{n}": realized_volatility(F.col("r"), n) for n in (20, 60)}
    out |= {f"bollinger_{k}": x for k, x in bollinger(c).items()}
    out |= {f"high_{n}": rolling_max(F.col("high"), n) for n in (20, 60, 252)}
    out |= {f"low_{n}": rolling_min(F.col("low"), n) for n in (20, 60, 252)}
    out |= {f"relative_volume_{n}": relative_volume(n) for n in (20, 50)}
    out |= {"sma_volume_20": sma(v, 20)}
    out |= {"dollar_volume_20": average_dollar_volume(20), "vwap_20": rolling_vwap(20), "range_contraction": contraction(F.col("tr"), 10, 50)}
    staged = staged.withColumns(out)
    more = {f"distance_sma_{n}": distance_from(c, F.col(f"sma_{n}")) for n in (20, 50, 100, 200)}
    more |= {f"slope_sma_{n}": slope(F.col(f"sma_{n}"), 10) for n in (20, 50, 100, 200)}
    more |= {"distance_high_252": distance_from(c, F.col("high_252")), "distance_low_252": distance_from(c, F.col("low_252"))}
    more |= {"obv_slope": slope(F.abs(F.col("obv")) + 1, 20), "volume_momentum": rate_of_change(F.col("sma_volume_20"), 20)}
    more |= {"volatility_percentile": percent_rank(F.col("volatility_20"), 120), "gap_frequency_60": sma(F.col("gap"), 60)}
    return staged.withColumns(more).drop("r", "obv_step", "gap")


def _lagged(x: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    out[n:] = x[: len(x) - n] if n < len(x) else out[n:]
    return out


def _last(x: np.ndarray, n: int, start: int = 0) -> Iterator[tuple[np.ndarray, slice]]:
    """The values of x ``k`` rows before each row, oldest first, for k = start + n - 1 .. start, and the rows that have one."""
    for k in range(min(start + n, len(x)) - 1, start - 1, -1):
        yield x[: len(x) - k], slice(k, None)


def _warm(x: np.ndarray, n: int) -> np.ndarray:
    x[: n - 1] = np.nan
    return x


def _total(x: np.ndarray, n: int, start: int = 0) -> np.ndarray:
    """Sums of the last n values, in their order, as a sliding window adds them up; a missing value adds nothing."""
    x, out = np.where(np.isnan(x), 0.0, x), np.zeros(len(x))
    for values, rows in _last(x, n, start):
        out[rows] += values
    return out


def _average(x: np.ndarray, n: int, start: int = 0) -> np.ndarray:
    """Means of those of the last n values that are there."""
    there = ~np.isnan(x)
    return _total(x, n, start) / (n if there.all() else _total(there.astype(float), n, start))


def _extreme(x: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """Largest or smallest of the last n values (the shorter start is left out), from stretches that double."""
    out, width = x, 1
    while width < n:
        step = min(width, n - width)
        out = np.concatenate([out[:step], pick(out[step:], out[: len(out) - step])]) if step < len(out) else out
        width += step
    return _warm(out.copy(), n)


def _deviation(x: np.ndarray, n: int, less: int) -> tuple[np.ndarray, np.ndarray]:
    """Standard deviations of the last n values by Welford's updates, in the order of the rows, and how many values are there."""
    count, mean, square = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    gaps = np.isnan(x)
    for values, rows in _last(x, n):
        there = ~gaps[: len(values)]
        values = values if there.all() else np.where(there, values, mean[rows])
        count[rows] += there
        delta = values - mean[rows]
        part = delta / np.maximum(count[rows], 1)
        mean[rows] += part
        square[rows] += delta * (delta - part)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(count > less, np.sqrt(square / (count - less)), np.nan), count


def _share_below(x: np.ndarray, n: int) -> np.ndarray:
    least, below, seen = x + np.abs(x) * (32 * EPS), np.zeros(len(x)), np.zeros(len(x))
    for values, rows in _last(x, n):
        below[rows] += values <= least[rows]
        seen[rows] += ~np.isnan(values)
    return _warm(np.where(~np.isnan(x) & (seen >= 2), (below - 1) / (seen - 1), np.nan), n)


def windowed(o: np.ndarray, h: np.ndarray, lo: np.ndarray, c: np.ndarray, v: np.ndarray, r: np.ndarray) -> dict[str, np.ndarray]:
    """``window_features`` of one series in the order of its sessions, value by value those of the window expressions; r: log returns.

    A sliding window of Spark adds its rows up anew at every row, one by one; here an offset of the window is one vector over the series.
    """
    was = _lagged(c, 1)
    typical = (h + lo + c) / 3
    tr = np.where(np.isnan(was), np.nan, np.fmax(h - lo, np.fmax(np.abs(h - was), np.abs(lo - was))))
    step = np.sign(c - was) * v
    gap = np.where(was > 0, (np.abs(o / was - 1) > 0.01).astype(float), np.nan)
    mean = lambda x, n: _warm(_total(x, n) / n, n)
    change = lambda x, n: np.where(_lagged(x, n) != 0, x / _lagged(x, n) - 1, np.nan)
    away = lambda x, base: np.where(base > 0, x / base - 1, np.nan)
    out = {"tr": tr, "obv": np.cumsum(np.where(np.isnan(step), 0.0, step))}
    out |= {f"sma_{n}": mean(c, n) for n in (10, 20, 50, 100, 200)}
    out |= {f"roc_{n}": change(c, n) for n in (5, 20, 60, 120, 252)}
    for n in (20, 60):
        spread, count = _deviation(r, n, 1)
        out[f"volatility_{n}"] = np.where(count >= n, spread * math.sqrt(252), np.nan)
    middle, width = _warm(_average(c, 20), 20), _deviation(c, 20, 0)[0] * 2.0
    out |= {"bollinger_middle": middle, "bollinger_upper": middle + width, "bollinger_lower": middle - width, "bollinger_bandwidth": np.where(middle != 0, 2 * width / middle, np.nan)}
    out |= {f"high_{n}": _extreme(h, n, np.fmax) for n in (20, 60, 252)}
    out |= {f"low_{n}": _extreme(lo, n, np.fmin) for n in (20, 60, 252)}
    for n in (20, 50):
        usual = _average(v, n, 1)
        out[f"relative_volume_{n}"] = _warm(np.where(usual > 0, v / usual, np.nan), n + 1)
    total, ranges = _total(v, 20), mean(tr, 50)
    out |= {"sma_volume_20": mean(v, 20), "dollar_volume_20": _warm(_average(typical * v, 20), 20)}
    out["vwap_20"] = _warm(np.where(total > 0, _total(typical * v, 20) / total, np.nan), 20)
    out["range_contraction"] = np.where(ranges > 0, mean(tr, 10) / ranges, np.nan)
    out |= {f"distance_sma_{n}": away(c, out[f"sma_{n}"]) for n in (20, 50, 100, 200)}
    out |= {f"slope_sma_{n}": change(out[f"sma_{n}"], 10) / 10 for n in (20, 50, 100, 200)}
    out |= {"distance_high_252": away(c, out["high_252"]), "distance_low_252": away(c, out["low_252"])}
    out |= {"obv_slope": change(np.abs(out["obv"]) + 1, 20) / 20, "volume_momentum": change(out["sma_volume_20"], 20)}
    return out | {"volatility_percentile": _share_below(out["volatility_20"], 120), "gap_frequency_60": mean(gap, 60)}


with np.errstate(all="ignore"):
    WINDOWED = tuple(windowed(*[np.zeros(0)] * 6))


def feature_set(bars: DataFrame) -> DataFrame:
    """Window and recursive features of every bar, side by side, in one pass over one shuffle."""
    return _with_features(bars.withColumn("r", log_return()), WINDOWED).drop("r")


def long_form(features: DataFrame, names: list[str]) -> DataFrame:
    """instrument_id, session_date, feature, value."""
    return features.unpivot(["instrument_id", "session_date"], names, "feature", "value")
