"""The snapshot scan: resumed against unbroken, episodes, and its parts against the operators that stand alone."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.functions.scalar import identity, identity_of
from vantage.operators import breakout as B
from vantage.operators import scan as S
from vantage.operators import structure as P
from vantage.operators import tracking as K
from vantage.operators.machine import TERMINAL

DAY0 = dt.date(2020, 1, 1)
BARS = "instrument_id int, session_date date, open double, high double, low double, close double, volume double, session_ord int"


@pytest.fixture(scope="module")
def market(spark):
    """Five series of 420 sessions; the fourth misses 30 sessions, and what follows is another price level."""
    rng = np.random.default_rng(12)
    rows, days = [], [DAY0 + dt.timedelta(days=n // 5 * 7 + n % 5) for n in range(420)]
    for i in (1, 2, 3, 4, 5):
        price = 100 * np.exp(np.cumsum(rng.normal(0.0004, 0.013, 420)) + 0.08 * np.sin(np.arange(420) / (9 + i)))
        for n, p in enumerate(price.tolist()):
            if i == 4 and 180 <= n < 210:
                continue
            p *= 7 if i == 4 and n >= 210 else 1
            rows.append((i, days[n], p * 0.998, p * 1.012, p * 0.988, p, float(rng.integers(50, 300)), n))
    bars = spark.createDataFrame(rows, BARS).cache()
    return bars, bars.select("session_date", "session_ord").distinct()


@pytest.fixture(scope="module")
def unbroken(spark, market, tmp_path_factory):
    folder = f"{tmp_path_factory.mktemp('scan')}/whole"
    S.scan_snapshot(*market, folder, chunks=3)
    return folder


def content(spark, folder):
    return [sorted((tuple(r) for r in df.collect()), key=str) for df in (S.rows_of(spark, folder, "structure"), S.rows_of(spark, folder, "event"), S.ledger(spark, folder).drop("run", "batch"))]


def test_a_stopped_run_goes_on(spark, market, unbroken, tmp_path):
    """Stopped after a chunk's rows and before its entries, twice, then finished: the rows of an unbroken run, none twice."""
    folder = f"{tmp_path}/broken"
    for _ in range(2):
        with pytest.raises(RuntimeError):
            S.scan_snapshot(*market, folder, chunks=3, stop_after=2)
    named = S.ledger(spark, folder).select("instrument_id").distinct().count()
    assert named < 5 and {r.instrument_id for r in S.rows_of(spark, folder, "structure").collect()} <= {r.instrument_id for r in S.ledger(spark, folder).collect()}
    S.scan_snapshot(*market, folder, chunks=3)
    assert content(spark, folder) == content(spark, unbroken)
    S.scan_snapshot(*market, folder, chunks=3)  # nothing is left to do
    assert content(spark, folder) == content(spark, unbroken)


def test_a_forced_run_replaces(spark, market, unbroken, tmp_path):
    folder = f"{tmp_path}/twice"
    S.scan_snapshot(*market, folder, chunks=1)
    S.scan_snapshot(*market, folder, chunks=2, force=True)
    assert content(spark, folder) == content(spark, unbroken)
    assert {r.batch for r in S.ledger(spark, folder).collect()} == {2}


def test_ledger(spark, unbroken):
    entries = {(r.instrument_id, r.episode_id): r for r in S.ledger(spark, unbroken).collect()}
    assert sorted(entries) == [(1, 0), (2, 0), (3, 0), (4, 0), (4, 1), (5, 0)]
    assert [entries[k].n_sessions for k in sorted(entries)] == [420, 420, 420, 180, 210, 420]
    structures, events = S.rows_of(spark, unbroken, "structure"), S.rows_of(spark, unbroken, "event")
    born = {(r.instrument_id, r.episode_id): r["count"] for r in structures.where("from_state is null").groupBy("instrument_id", "episode_id").count().collect()}
    opened = {(r.instrument_id, r.episode_id): r["count"] for r in events.where("from_state is null").groupBy("instrument_id", "episode_id").count().collect()}
    assert {k: (r.n_structures, r.n_events) for k, r in entries.items()} == {k: (born.get(k, 0), opened.get(k, 0)) for k in entries}
    assert sum(born.values()) > 100 and sum(opened.values()) > 50


def test_structures_are_those_of_the_scan_and_the_tracker(spark, market, unbroken):
    """In a series without breaks the walk gives what detection and tracking give one after the other."""
    bars = market[0].where("instrument_id <= 3")
    tracked = K.track(P.with_state(P.detect(bars)), bars)
    columns = ["instrument_id", "key", "family", "session_date", "from_state", "to_state", "reason", "quality"]
    got = S.rows_of(spark, unbroken, "structure").where("instrument_id <= 3").select(columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, tracked.select(columns).collect()), key=str)


def test_nothing_reaches_across_a_break(spark, market, unbroken, tmp_path):
    """The episode after the break gives what its bars alone give."""
    bars, calendar = market
    alone = f"{tmp_path}/alone"
    S.scan_snapshot(bars.where("instrument_id = 4 and session_ord >= 210"), calendar, alone, chunks=1)
    for kind in ("structure", "event"):
        own = S.rows_of(spark, alone, kind).drop("episode_id")
        later = S.rows_of(spark, unbroken, kind).where("instrument_id = 4 and episode_id = 1").drop("episode_id")
        assert own.count() > 0 and sorted(map(tuple, own.collect()), key=str) == sorted(map(tuple, later.collect()), key=str)


def test_attempts_follow_identities(spark, unbroken):
    """An attempt opens while its identity is alive in a monitored state, ends with it at the latest, and one is open at a time."""
    lives = {}
    for r in S.rows_of(spark, unbroken, "structure").orderBy("session_date").collect():
        lives.setdefault((r.instrument_id, r.key), []).append((r.session_date, r.to_state))
    attempts = {}
    for r in S.rows_of(spark, unbroken, "event").orderBy("session_date").collect():
        attempts.setdefault((r.instrument_id, r.key), []).append(r)
    assert attempts
    for at, own in attempts.items():
        live = lives[at]
        over = next((d for d, state in live if state in ("INVALIDATED", "EXPIRED")), None)
        for r in own:
            state = [s for d, s in live if d <= r.session_date][-1]
            if r.from_state is None:
                assert state in S.MONITORED
            assert over is None or r.session_date <= over
        numbers = [r.attempt for r in own if r.from_state is None]
        assert numbers == list(range(1, len(numbers) + 1))
        last = own[-1]
        assert over is None or last.to_state in (*TERMINAL, "rejected")
        for a, b in zip(own, own[1:]):
            assert a.attempt == b.attempt and b.from_state == a.to_state or b.attempt == a.attempt + 1 and a.to_state in (*TERMINAL, "rejected")
            assert a.attempt != b.attempt or (a.level, a.tolerance) == (b.level, b.tolerance)


def test_folds_and_columns_agree(spark):
    rows = [(f, c, 100.0, 90.0, q, 2.5, k) for f in ("flat_base", "breakout_retest") for c in (89.0, 95.0, 97.0, 98.5, 100.1, 100.3) for q in (30.0, 60.0) for k in (20.0, 80.0)]
    df = spark.createDataFrame(rows, "family string, close double, level double, invalidation double, quality double, atr double, confidence double").withColumns({"instrument_id": F.lit(7), "start_date": F.lit("2020-02-03").cast("date")})
    for r in P.with_state(df).withColumn("zone", B.zone(F.col("level"), F.col("atr"), F.col("confidence"))).withColumn("id", identity(F.col("instrument_id"), F.col("family"), F.lit("1d"), F.col("start_date"))).collect():
        assert r.state == P.state_of(r.family, r.close, r.level, r.invalidation, r.quality)
        assert r.zone == pytest.approx(B.zone_of(r.level, r.atr, r.confidence), rel=1e-15)
        assert r.id == r.key == identity_of(7, r.family, "1d", np.datetime64("2020-02-03"))
