"""Queries that failed at 6 GB: structures are folded where they are found, and nothing of the size of the sightings is stored."""

import dataclasses

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vantage import registry
from vantage.operators import breakout as BR
from vantage.operators import families as FA
from vantage.operators import features as X
from vantage.operators import folds as FO
from vantage.operators import machine as M
from vantage.operators import scan as S
from vantage.operators import structure as P
from vantage.operators import sweep
from vantage.operators import tracking as K
from vantage.sources.fixtures import frame


@pytest.fixture(scope="module")
def bars(spark, sf):
    return frame(spark, sf, "bars").where("instrument_id <= 3").localCheckpoint()


@pytest.fixture(scope="module")
def found(bars):
    return P.with_state(P.detect(bars)).localCheckpoint()


def _rows(df, *columns):
    return sorted(map(repr, df.select(*(columns or df.columns)).collect()))


@pytest.mark.parametrize("name", ["b18_active", "b19_defeated", "b26_event_states", "k05_tracked", "k09_tracked", "k11_believed_tracked", "v12_churn_tracked"])
def test_sightings_are_not_stored(spark, sf, name):
    """all sightings went to a checkpoint first, of the attempts' histories there was a second one."""
    assert "Scan ExistingRDD" not in registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_folds_are_those_of_the_sightings(bars, found):
    spans = found.groupBy("instrument_id", "key", "family", "start_date").agg(F.max("session_date").alias("end_date"), F.count(F.lit(1)).alias("n"))
    assert _rows(FO.spans(bars).select(*spans.columns)) == _rows(spans) and spans.count() > 50
    assert _rows(FO.coexisting(bars)) == _rows(K.coexistence(found))
    assert _rows(K.churn_of(FO.spans(bars))) == _rows(K.churn(found))
    assert _rows(K.concentration(FO.spans(bars), F.sum("n"))) == _rows(K.concentration(found))
    assert _rows(P.family_counts(FO.spans(bars), F.sum("n"))) == _rows(P.family_counts(found))
    until = F.lit("2001-12-31").cast("date")
    assert _rows(FO.track(bars, until)) == _rows(K.track(found, bars, until)) and _rows(FO.track(bars)) == _rows(K.track(found, bars))


def test_attempts_are_those_of_the_levels(bars, found):
    early = "state in ('MATURE', 'NEAR_BREAKOUT')"
    watched = found.where(f"{early} or state = 'BROKEN_OUT_UNCONFIRMED'").withColumn("_early", F.when(F.expr(early), F.col("session_date")))
    edge = watched.groupBy("instrument_id", "key").agg(*(F.min_by(c, "_early").alias(c) for c in ("level", "atr", "quality", "confidence", "touches")), F.min("_early").alias("frozen_on"), F.collect_set("session_date").alias("seen"))
    edge = edge.where("frozen_on is not null and atr is not null").withColumn("tolerance", BR.zone(F.col("level"), F.col("atr"), F.col("confidence")))
    b = bars.withColumn("average_volume", F.coalesce(F.avg("volume").over(X.prior(20)), F.lit(0.0))).withColumn("relative_strength", F.when(F.dayofmonth("session_date") % 2 == 0, 55.0))
    assert _rows(FO.histories(b)) == _rows(M.histories(b, edge)) and FO.histories(b).count() > 100


def test_an_attempt_is_followed_as_it_is_taken():
    """Levels, atr and watching of all kinds: the run over lists against the monitor fed session by session."""
    rng, seen = np.random.default_rng(11), set()
    for k in range(150):
        n = 160
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.008 + 0.004 * (k % 4), n)))
        o = np.concatenate((c[:1], c[:-1]))
        h, lo = np.maximum(o, c) * (1 + 0.01 * rng.random(n)), np.minimum(o, c) * (1 - 0.01 * rng.random(n))
        columns = [np.arange(n).astype("datetime64[D]"), *(x.tolist() for x in (o, h, lo, c, rng.random(n) * 100)), [50.0] * n, *([None] * n for _ in range(3))]
        line, watched = M.Line(*columns), (rng.random(n) < (0.9, 1.1)[k % 2]).tobytes()
        fresh = M.Monitor(float(c[20] * 1.02), 0.003 + 0.004 * rng.random(), (2.0, 0.0)[k % 5 == 4], 60.0, 3, 55.0)
        for lost in (False, True):
            taken, followed, t = [], [], 0
            m, f = dataclasses.replace(fresh), dataclasses.replace(fresh)
            for i in range(n):
                taken += [(i, *x) for x in m.take(line.bar(i), bool(watched[i]), lost and not watched[i])]
            while (t := watched.find(1, t)) >= 0 and not f.closed:
                out, t = f.follow(line, t, watched, lost)
                followed += out
            assert followed == taken and (m.number, m.rejections, m.closed) == (f.number, f.rejections, f.closed)
            seen |= {x[2] for x in taken}
    assert len(seen) == 13


def test_rounding_and_level_tests_are_the_plain_ones():
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.random(5000) * 1000, np.arange(2000) / 16 + 0.5e-6, [0.5e-6, 2.5e-6, -1e-9, np.nan, np.inf, 1e300, 1e15 + 0.3]))
    for digits in (4, 6):
        assert list(map(repr, sweep.rounded(x, digits).tolist())) == [repr(round(v, digits)) for v in x.tolist()]
    c = np.round(100 + 4 * np.sin(np.arange(500) / 5) + rng.random(500), 1)
    bars = pd.DataFrame({"open": c, "high": c + 0.5, "low": c - 0.5, "close": c, "volume": 1.0})
    walk = P.Walk({k: bars[k].to_numpy(float) for k in P._BARS}, P.series_atr(bars))
    chart = FA.Chart(*(walk.bars[k] for k in P._BARS), walk.atr, walk.highs, walk.lows)
    plain = [(a, *x) for a in walk.highs.tolist() if (x := FA._tested_level(chart, a)) is not None]
    assert sweep._tested_levels(chart, walk.highs) == plain and plain


def test_chunks_of_a_scan_read_their_own_rows(spark, bars, tmp_path, monkeypatch):
    """Each chunk derived all series anew and kept its own."""
    plans, walked = [], S.walked
    monkeypatch.setattr(S, "walked", lambda own, timeframe: (plans.append(own._jdf.queryExecution().optimizedPlan().toString()), walked(own, timeframe))[1])
    calendar = bars.select("session_date").distinct().withColumn("session_ord", F.row_number().over(Window.orderBy("session_date")))
    S.scan_snapshot(bars, calendar, f"{tmp_path}/scan", chunks=2)
    assert len(plans) == 2 and not any("Window" in p or "Join" in p for p in plans)
    assert S.ledger(spark, f"{tmp_path}/scan").count() >= 3 and S.rows_of(spark, f"{tmp_path}/scan", "event").count() > 100


def test_relations_are_counted_where_the_structures_are(bars):
    """all pairs went through a join by bins."""
    expected = K.relationships(FO.spans(bars)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    assert _rows(FO.related(bars)) == _rows(expected) and expected.count() == 4


def test_long_spans_are_not_copied_to_every_bin(spark):
    """a span of years was shuffled and sorted once for every 64 days of it."""
    rng = np.random.default_rng(4)
    first = rng.integers(-3000, 3000, 300)
    rows = [(int(i % 3), f"k{i}", "fg"[i % 2], int(s), int(s + n)) for i, (s, n) in enumerate(zip(first, np.concatenate((rng.integers(0, 90, 150), rng.integers(0, 5000, 150))), strict=True))] + [(0, "z", "f", -200_000, 300_000)]
    days = spark.createDataFrame(rows, "instrument_id int, key string, family string, s int, e int")
    assert K.starting(days).count() == len(rows) * len(K.BIN_DAYS) and K.lasting(days).where("key <> 'z'").count() <= 2 * (len(rows) - 1)
    spans = days.select("instrument_id", "key", "family", F.date_from_unix_date("s").alias("start_date"), F.date_from_unix_date("e").alias("end_date"))
    expected = []
    for i, a, f, s, e in rows:
        for j, b, g, x, y in rows:
            both = min(e, y) - max(s, x) + 1
            if i == j and a < b and both > 0:
                p, q = both / (e - s + 1), both / (y - x + 1)
                kind = ("RELATED_TO" if f != g else None) if p >= 0.85 and q >= 0.85 else "CONTAINS" if q >= 0.8 else "NESTED_IN" if p >= 0.8 else "OVERLAPS" if max(p, q) >= 0.25 else None
                expected += [(a, b, kind, max(p, q))] if kind else []
    assert sorted(map(tuple, K.relationships(spans).collect())) == sorted(expected) and len(expected) > 1000
