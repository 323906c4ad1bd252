"""One small test for each finding of the third round."""

import datetime as dt
import time

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from vantage.llm import vector_search
from vantage.operators import profiles as P
from vantage.operators import screens as O
from vantage.operators import structure as ST


def test_lots_are_matched_without_a_shrinking_frame(spark):
    """a frame up to the last row is read anew for every row, so work grew with the square of a series' fills."""
    on = dt.date(2020, 1, 1)
    rows = [(1, i, on + dt.timedelta(days=i), "buy" if i % 2 == 0 else "sell", i % 5 + 1, 10.0 + i) for i in range(40)]
    lots = O.matched_lots(spark.createDataFrame(rows, "instrument_id int, fill_id long, session_date date, side string, quantity long, price double"))
    assert "unboundedfollowing" not in lots._jdf.queryExecution().toString().lower()
    units = {side: [i for _, i, _, s, n, _ in rows if s == side for _ in range(n)] for side in ("buy", "sell")}
    found = [pair for r in lots.orderBy("closed_on", "buy_fill", "sell_fill").collect() for pair in [(r.buy_fill, r.sell_fill)] * r.quantity]
    assert sorted(found) == sorted(zip(units["buy"], units["sell"], strict=False))


def test_a_line_through_one_bar_has_no_confidence(spark):
    """the smaller of 100 and null is 100 in Spark."""
    rows = spark.createDataFrame([(2, 1.0), (2, None), (None, 1.0), (4, 0.0)], "touches int, fit double")
    assert [r.c for r in rows.select(P.boundary_confidence(F.col("touches"), F.col("fit")).alias("c")).collect()] == [67.5, None, None, 65.0]


def test_the_nearest_are_found_in_tight_clusters(spark):
    """rows of a cluster share a code, so a short list by the codes held any of them."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4, 16))[rng.integers(0, 4, 8_000)] + 1e-3 * rng.normal(size=(8_000, 16))
    x[::1000] *= 50
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}))
    found = vector_search.nearest(frame, every=400).toPandas().sort_values(["query_id", "rank"])
    for q, own in found.groupby("query_id"):
        score = (x * x[q]).sum(axis=1)
        score[q] = -np.inf
        assert own.vec_id.tolist() == np.lexsort((np.arange(len(x)), -score))[:20].tolist()
    assert len(found) == 20 * 20


def test_all_sessions_are_swept_at_once():
    """Every session was read on its own; the sweep must find the same, many times as fast."""
    rng, seen, times = np.random.default_rng(5), set(), [0.0, 0.0]
    for k in range(10):
        n = 400 + 37 * k
        c = np.round(100 * np.exp(np.cumsum(rng.normal(0.001, 0.01 + 0.004 * k, n)) + 0.4 * np.sin(np.arange(n) / (8 + 3 * k))), k % 3) + 1
        o = np.concatenate((c[:1], c[:-1]))
        x = pd.DataFrame({"open": o, "high": np.maximum(o, c) + np.round(rng.random(n) * c * 0.02, 1), "low": np.round(np.minimum(o, c) * 0.99, 2), "close": c, "volume": np.round(rng.random(n) * 100, k % 4)})
        walk = lambda: ST.Walk({name: x[name].to_numpy(float) for name in ST._BARS}, ST.series_atr(x))  # noqa: B023, E731
        at, start = np.arange(60, n), time.perf_counter()
        t, family, first, *rest = walk().swept(at, at)
        times[0] += time.perf_counter() - start
        start, plain = time.perf_counter(), walk()
        expected = sorted((i, *row) for i in at.tolist() for row in plain.sighted(i, i))
        times[1] += time.perf_counter() - start
        assert sorted(zip(t.tolist(), family, first.tolist(), *rest, strict=True)) == expected
        seen |= set(family)
    assert len(seen) >= 11 and times[0] < times[1] / 4
    assert len(ST.Walk({name: np.ones(5) for name in ST._BARS}, np.ones(5)).swept(np.arange(0), np.arange(0))[0]) == 0


def test_edges_between_timeframes_meet_once(spark):
    """pairs met in every year that they shared and all went through a shuffle to become distinct."""
    rng, zero = np.random.default_rng(8), dt.date(1995, 1, 1)
    spans = lambda name: [(int(i % 3), f"{name}{i}", int(a), int(a + n)) for i, a, n in zip(range(90), rng.integers(0, 2500, 90), rng.integers(0, 1500, 90), strict=True)]
    daily, weekly = spans("d"), spans("w") + [(0, "same", 100, 400), (0, "day", 364, 364)]
    daily += [(0, "equal", 100, 400)]
    frame = lambda rows: spark.createDataFrame([(i, k, zero + dt.timedelta(a), zero + dt.timedelta(b)) for i, k, a, b in rows], "instrument_id int, key string, start_date date, end_date date")
    found = ST.across_timeframes(frame(daily), frame(weekly))
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    both = lambda a, b, x, y: min(b, y) - max(a, x) + 1
    expected = [(w, d, "CONTAINS") for j, w, x, y in weekly for i, d, a, b in daily if i == j and max(both(a, b, x, y) / (y - x + 1), both(a, b, x, y) / (b - a + 1)) >= 0.25]
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected) and len(expected) > 500
