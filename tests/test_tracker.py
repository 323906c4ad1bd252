"""The tracker against cases worked by hand, its batch fold, and its stream against the batch across a restart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vantage.operators import tracker as T
from vantage.operators import tracking as K
from vantage.streaming.structures import track_stream

DAY0 = dt.date(2020, 1, 6)  # a Monday
FOUND = "instrument_id int, session_date date, key string, family string, state string, quality double, level double, invalidation double, start_date date"
SESSIONS = "instrument_id int, session_date date, close double"


def day(n):
    return DAY0 + dt.timedelta(days=n)


def seen(state, base="a", family="flat_base", level=110.0, floor=90.0, start=0):
    return T.Sighting(base, family, state, 60.0, level, floor, start)


def walk(days, tracker=None):
    """days: (day, close, [sightings]); returns (day, key, was, to, reason)."""
    tracker = tracker or T.Tracker()
    return [(s.day, s.key, s.was, s.to, s.reason) for n, close, sighted in days for s in tracker.observe(n, close, sighted)]


def test_legal_edges_move_one_identity():
    got = walk([(0, 100, [seen("FORMING")]), (1, 100, [seen("MATURE")]), (2, 108, [seen("NEAR_BREAKOUT")]), (3, 100, [seen("MATURE")]), (4, 111, [seen("BROKEN_OUT_UNCONFIRMED")])])
    assert [(n, was, to) for n, _, was, to, _ in got] == [(0, None, "FORMING"), (1, "FORMING", "MATURE"), (2, "MATURE", "NEAR_BREAKOUT"), (3, "NEAR_BREAKOUT", "MATURE"), (4, "MATURE", "BROKEN_OUT_UNCONFIRMED")]
    assert {k for _, k, *_ in got} == {"a"}


def test_an_illegal_edge_forks():
    got = walk([(0, 111, [seen("BROKEN_OUT_UNCONFIRMED")]), (1, 105, [seen("MATURE")]), (2, 105, [seen("MATURE")])])
    assert got == [(0, "a", None, "BROKEN_OUT_UNCONFIRMED", "detected"), (1, "a", "BROKEN_OUT_UNCONFIRMED", "EXPIRED", "superseded"), (1, "a:1970-01-02", None, "MATURE", "detected")]
    retest = walk([(0, 100, [seen("MATURE", family="breakout_retest")]), (1, 109, [seen("NEAR_BREAKOUT", family="breakout_retest")])])
    assert [r[4] for r in retest] == ["detected", "superseded", "detected"]


def test_a_second_life_and_none_that_begins_over():
    got = walk([(0, 100, [seen("MATURE")]), (1, 89, [seen("INVALIDATED")]), (2, 89, [seen("INVALIDATED")]), (3, 100, [seen("MATURE")]), (4, 100, [seen("MATURE")])])
    assert got == [(0, "a", None, "MATURE", "detected"), (1, "a", "MATURE", "INVALIDATED", "advanced"), (3, "a:1970-01-04", None, "MATURE", "detected")]
    assert walk([(0, 89, [seen("INVALIDATED")]), (1, 89, [seen("INVALIDATED")])]) == [(0, "a", None, "INVALIDATED", "detected")]


def test_the_unseen_are_resolved_from_their_levels():
    assert walk([(0, 100, [seen("MATURE")]), (1, 89, [])])[1] == (1, "a", "MATURE", "INVALIDATED", "support_broken")
    assert walk([(0, 100, [seen("MATURE")]), (1, 110, [])]) == [(0, "a", None, "MATURE", "detected")]
    got = walk([(0, 100, [seen("MATURE")]), (1, 110.01, []), (2, 89, [])])
    assert [r[2:] for r in got[1:]] == [("MATURE", "BROKEN_OUT_UNCONFIRMED", "carried_forward"), ("BROKEN_OUT_UNCONFIRMED", "INVALIDATED", "support_broken")]
    crossed = walk([(0, 100, [seen("MATURE", level=80.0, floor=90.0)]), (1, 85, [])])  # invalidation comes first
    assert crossed[1][3] == "INVALIDATED"


@pytest.mark.parametrize("state, close, last", [("MATURE", 100, 5), ("NEAR_BREAKOUT", 108, 5), ("BROKEN_OUT_UNCONFIRMED", 112, 15)])
def test_grace_and_carry(state, close, last):
    """Three sessions of grace are five days, as six count four sessions; ten of carry are fifteen."""
    assert len(walk([(0, close, [seen(state)]), (last, close, [])])) == 1
    got = walk([(0, close, [seen(state)]), (last + 1, close, [])])
    assert got[1][3:] == ("EXPIRED", "timed_out" if state == "BROKEN_OUT_UNCONFIRMED" else "lost")
    assert walk([(0, 100, [seen("MATURE")]), (3, 111, []), (18, 111, [])])[2:] == []  # carried from the day on which the level was cleared
    assert T.Life("a", seen(state), state, 0).due() == last + 1


def test_a_silent_series_is_over():
    got = walk([(0, 100, [seen("MATURE"), seen("BROKEN_OUT_UNCONFIRMED", "b")]), (T.SILENCE + 1, 89, [seen("MATURE")])])
    assert got[2:] == [(6, "a", "MATURE", "EXPIRED", "lost"), (16, "b", "BROKEN_OUT_UNCONFIRMED", "EXPIRED", "timed_out"), (32, "a:1970-02-02", None, "MATURE", "detected")]


def test_memory_is_bounded_and_keys_never_repeat():
    t = T.Tracker()
    keys, sizes = [], []
    for n in range(6_000):
        sighted = [seen("MATURE", f"k{n}", start=n - 30)] + [seen("MATURE", f"k{n - back}", start=n - back - 30) for back in (20, 690, 720) if n % 7 == 0]
        keys += [s.key for s in t.observe(n, 100.0, sighted) if s.was is None]
        sizes.append(len(t.ended) + len(t.lives))
    assert len(keys) == len(set(keys)) and max(sizes) < 900


@pytest.fixture(scope="module")
def walked(spark):
    """Three series over 260 days with holes, one of them ending early, with sightings in runs of states."""
    rng = random.Random(11)
    sessions, found = [], []
    for i in (1, 2, 3):
        price = 100.0
        for n in range(260):
            if n % 7 > 4 or (i == 2 and 100 <= n < 150) or (i == 3 and n > 120) or rng.random() < 0.03:
                continue
            price *= 1 + rng.gauss(0, 0.02)
            sessions.append((i, day(n), price))
            for k in range(6):
                if rng.random() < 0.5:
                    state = rng.choice(["FORMING", "MATURE", "NEAR_BREAKOUT", "BROKEN_OUT_UNCONFIRMED"] + ["INVALIDATED"] * (rng.random() < 0.1))
                    found.append((i, day(n), f"p{i}-{k}-{n // 60}", rng.choice(["flat_base", "breakout_retest"][: 1 + k % 2]), state, 50.0 + k, 104.0 + 3 * k, 88.0 - k, day(n // 60 * 60)))
    return spark.createDataFrame(found, FOUND), spark.createDataFrame(sessions, SESSIONS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_batch_fold_is_the_tracker(spark, walked):
    found, sessions = walked
    want = []
    days = lambda d: (d - T.ZERO).days
    for i in (1, 2, 3):
        sighted = {}
        for r in found.where(F.col("instrument_id") == i).orderBy("session_date", "key").collect():
            sighted.setdefault(r.session_date, []).append(T.Sighting(r.key, r.family, r.state, r.quality, r.level, r.invalidation, days(r.start_date)))
        t, steps = T.Tracker(), []
        for r in sessions.where(F.col("instrument_id") == i).orderBy("session_date").collect():
            steps += t.observe(days(r.session_date), r.close, sighted.get(r.session_date, ()))
        if i == 3:
            steps += t.finish()
        want += K.step_rows(i, steps)
    got = rows(K.track(found, sessions, F.lit(day(259))))
    assert got == sorted(want, key=str) and {r[6] for r in got} == {"detected", "advanced", "superseded", "support_broken", "carried_forward", "lost", "timed_out"}
    keys = [(r[0], r[1]) for r in got if r[4] is None]
    assert len(keys) == len(set(keys))


def test_the_stream_gives_what_the_batch_gives_across_a_restart(spark, walked, tmp_path):
    """Rows arrive out of order within the delay, and the query is started anew for every file."""
    found, sessions = walked
    end = sessions.limit(0).union(spark.createDataFrame([(9, day(400), 1.0)], SESSIONS))  # another series goes on and moves the clock
    rng = random.Random(3)

    def arrivals(df, name):
        parts = [[] for _ in range(9)]
        for r in df.collect():
            late = (r.session_date - DAY0).days + rng.randrange(8)
            parts[min(late // 33, 8)].append(tuple(r))
        for n, part in enumerate(parts):
            spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/part={n}")

    arrivals(found, "found")
    arrivals(sessions, "sessions")
    end.coalesce(1).write.parquet(f"{tmp_path}/sessions/part=9")
    found.limit(0).coalesce(1).write.parquet(f"{tmp_path}/found/part=9")
    import shutil

    for n in range(10):
        for name in ("found", "sessions"):
            shutil.copytree(f"{tmp_path}/{name}/part={n}", f"{tmp_path}/in/{name}", dirs_exist_ok=True)
        source = [spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in/{name}") for df, name in ((found, "found"), (sessions, "sessions"))]
        query = track_stream(*source, delay="14 days").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(300)
        state = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    got = rows(spark.read.parquet(f"{tmp_path}/out"))
    assert got == rows(K.track(found, sessions, F.lit(day(386))))
    assert state[-1] <= 1  # the silent series are closed and their state is gone; the clock's own bar waits
