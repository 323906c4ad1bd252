"""Structures, tracked identities, events and levels against plain loops and planted answers."""

import datetime as dt

import numpy as np
import pytest

from vantage.operators import structure as P
from vantage.operators import tracking as K
from vantage.operators.families import FINDERS, Chart
from vantage.sources.fixtures import frame

DAY0 = dt.date(2020, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def bars(spark, sf):
    return frame(spark, sf, "bars").where("instrument_id <= 2").cache()


def test_every_session_is_read(bars):
    """Against a reading that cuts each session's bars and pivots anew and keeps nothing between sessions."""
    found = {(r.instrument_id, r.session_date, r.family, r.start_date): (r.level, r.invalidation, r.quality, r.atr) for r in P.detect(bars).collect()}
    expected = {}
    for instrument, x in bars.where("instrument_id = 1").toPandas().sort_values("session_date").groupby("instrument_id"):
        days = x["session_date"].to_numpy()
        o, h, lo, c, v = (x[k].to_numpy(float) for k in ("open", "high", "low", "close", "volume"))
        span = P.atr(h, lo, c)
        every_high, every_low = P._pivots(h, P.LEFT, P.RIGHT), P._pivots(-lo, P.LEFT, P.RIGHT)
        for t in range(60, len(x)):
            highs, lows = (p[(p <= t - P.RIGHT) & (p >= t - P.REACH)] for p in (every_high, every_low))
            chart = Chart(o[: t + 1], h[: t + 1], lo[: t + 1], c[: t + 1], v[: t + 1], span[: t + 1], highs, lows)
            for family in P.FAMILIES:
                if t < P.WARM[family]:
                    continue
                for first, level, floor, parts in P._FIND[family](chart, t - P.RIGHT):
                    if floor < level:
                        expected.setdefault((instrument, days[t], family, days[first]), (round(float(level), 6), round(float(floor), 6), round(100 * float(np.mean(list(parts.values()))), 4), span[t]))
    assert len(expected) > 1000 and {k: x for k, x in found.items() if k[0] == 1} == expected
    starts = {}
    for i, on, family, start in found:
        starts.setdefault((i, on, family), set()).add(start)
    assert max(map(len, starts.values())) > 1


def test_long_and_concurrent_structures(spark):
    """A cup of 190 sessions, and two bases that are both alive."""
    legs = [(0, 80), (40, 100), (70, 78), (50, 77), (70, 99), (6, 94), (8, 97)]
    cup = _frame(spark, legs)
    seen = {(r.family, (r.start_date - DAY0).days) for r in P.detect(cup).collect()}
    assert any(f == "cup_handle" and abs(n - 40) <= 1 for f, n in seen)
    two = [(0, 60), (40, 100), (9, 93), (9, 99.8), (9, 94), (9, 92), (9, 97), (5, 94), (5, 96.8), (5, 93.5), (5, 96.9), (5, 95), (5, 96)]
    rows = P.detect(_frame(spark, two)).where("family = 'flat_base'").collect()
    last = max(r.session_date for r in rows)
    assert len({r.start_date for r in rows if r.session_date == last}) >= 2


def _frame(spark, legs):
    price = [legs[0][1]]
    for n, to in legs[1:]:
        price += np.linspace(price[-1], to, n + 1)[1:].tolist()
    rows = [(1, day(n), p * 0.999, p * 1.004, p * 0.996, float(p), 100.0) for n, p in enumerate(np.asarray(price, float).tolist())]
    return spark.createDataFrame(rows, "instrument_id int, session_date date, open double, high double, low double, close double, volume double")


def test_merged_spans(spark):
    rows = [(1, "f", "long", day(0), day(99)), (1, "f", "inside", day(10), day(50)), (1, "f", "mostly", day(90), day(101)), (1, "f", "half", day(60), day(140)), (1, "g", "other", day(10), day(50))]
    got = {r.key: r.into for r in K.merged(spark.createDataFrame(rows, "instrument_id int, family string, key string, start_date date, end_date date")).collect()}
    assert got == {"long": "long", "inside": "long", "mostly": "long", "half": "half", "other": "other"}


def chart(*legs):
    """A chart along straight legs (sessions, price at the end), with its confirmed pivots."""
    price = [legs[0][1]]
    for n, to in legs[1:]:
        price += np.linspace(price[-1], to, n + 1)[1:].tolist()
    c = np.array(price)
    high, low = c * 1.004, c * 0.996
    return Chart(c * 0.999, high, low, c, np.full(len(c), 100.0), np.full(len(c), 1.5), P._pivots(high, 3, 3), P._pivots(-low, 3, 3)), len(c) - 4


SHAPES = {
    "bull_flag": [(0, 100), (22, 90), (10, 115), (10, 110), (4, 111)],
    "pennant": [(0, 100), (22, 90), (14, 115), (2, 106), (2, 114), (3, 108), (3, 112), (3, 109.5), (2, 110.5), (1, 110)],
    "high_tight_flag": [(0, 100), (22, 90), (25, 170), (8, 160), (4, 164)],
    "cup_handle": [(0, 80), (25, 100), (25, 80), (15, 79), (25, 99), (6, 94), (5, 97)],
    "inverse_head_shoulders": [(0, 130), (45, 100), (8, 108), (8, 92), (9, 108), (8, 100), (6, 107)],
    "base_on_base": [(0, 70), (60, 100), (5, 93), (7, 100), (5, 94), (5, 99), (3, 103), (5, 97), (6, 103), (5, 98), (4, 101)],
    "breakout_retest": [(0, 90), (10, 100), (8, 93), (10, 100), (8, 93), (10, 100), (8, 95), (12, 108), (8, 101), (6, 105)],
}


@pytest.mark.parametrize("family", sorted(SHAPES))
def test_families_find_what_they_name(family):
    c, end = chart(*SHAPES[family])
    first, level, invalidation, parts = next(FINDERS[family](c, end))
    assert 0 <= first < end and invalidation < level and all(0 <= x <= 1 for x in parts.values())
    flat, last = chart((0, 100), (120, 100.5))
    assert next(FINDERS[family](flat, last), None) is None


def test_latest_scan_is_the_end_of_the_full_one(bars):
    full = {tuple(r) for r in P.detect(bars).collect()}
    last = {r.instrument_id: r.d for r in bars.groupBy("instrument_id").agg({"session_date": "max"}).withColumnRenamed("max(session_date)", "d").collect()}
    for sessions in (1, 5):
        days = {i: sorted({r[1] for r in bars.where(f"instrument_id = {i}").select("instrument_id", "session_date").collect()})[-sessions:] for i in last}
        state = P.rescan_state(bars, sessions)
        tail = bars.join(spark_cut(bars, sessions + P.OVERLAP), "instrument_id").where("session_date >= cut").drop("cut")
        assert {tuple(r) for r in P.detect_latest(tail, sessions, state).collect()} == {r for r in full if r[1] in days[r[0]]}


def spark_cut(bars, keep):
    """The first of the last ``keep`` sessions of each series: a rescan needs no bar before it."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.partitionBy("instrument_id").orderBy(F.desc("session_date"))
    return bars.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep).groupBy("instrument_id").agg(F.min("session_date").alias("cut"))


@pytest.mark.parametrize("kind", ["high", "low"])
def test_levels_take_all_pivots(spark, kind):
    """Five early touches of one level win over 30 later pivots, each alone."""
    prices = [100.0, 100.5, 101.0, 99.8, 100.2] + [200 * 1.1**n for n in range(30)]
    pivots = spark.createDataFrame([(1, day(n), kind, p) for n, p in enumerate(prices)], "instrument_id int, session_date date, kind string, price double")
    r = P.horizontal_levels(pivots, kind).first()
    assert (r.touches, r.first_touch, r.last_touch) == (5, day(0), day(4)) and abs(r.level - 100.3) < 1e-9
