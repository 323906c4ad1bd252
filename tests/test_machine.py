"""Breakout attempts step by step, and the stream against the batch."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.operators import machine as M
from vantage.operators.audits import EVENT_EDGES
from vantage.streaming.events import event_stream, weekly_stream

DAY0 = dt.date(2020, 1, 1)


def run(bars, watched=True, level=100.0, atr=2.0):
    """States after each session; a bar is its close, or (open, high, low, close, volume)."""
    m, out, state = M.Monitor(level, 0.003, atr), [], None
    for i, b in enumerate(bars):
        o, h, lo, c, v = (b, b + 0.2, b - 0.2, b, 200.0) if isinstance(b, (int, float)) else b
        for change in m.take(M.Bar(np.datetime64(DAY0) + i, o, h, lo, c, v, 100.0), watched):
            state = change[1]
        out.append(state)
    return out


def test_before_a_breakout():
    assert run([90, 96, 99.9, (99, 101, 98.9, 100.1, 9), 101]) == ["not_approaching", "approaching", "testing_resistance", "intraday_break", "closed_above"]
    assert run([(99, 102, 98, 98.5, 9)]) == ["rejected"]
    assert run([97] * 42)[-1] == "expired" and "expired" not in run([97] * 41)


def test_momentum_confirms_and_resolves():
    strong = (99.5, 102.2, 99.4, 102.1, 300.0)
    states = run([strong, 102.5, 103, 103.2, *[104] * 40])
    assert states[0] == "closed_above" and states[1] == "confirmation_pending" and states[2] == "confirmed" and "expired" in states


def test_failures():
    assert run([101, 97.5])[-1] == "failed_breakout"  # decisive close below
    assert run([101, 100.2, 99.65], atr=20.0)[-1] == "failed_breakout"  # under the breakout's low and back inside
    assert run([(101, 101.2, 90, 101, 9), 100.2, 99.65, 99.65], atr=20.0)[2:] == ["confirmation_pending", "failed_breakout"]  # two closes back inside
    assert run([101, (101, 101, 95.9, 100.8, 9)])[-1] == "failed_breakout"  # adverse excursion
    rejected = (99, 102, 98, 98.5, 9)
    assert run([rejected, rejected, rejected, 101]) == ["rejected", "rejected", "failed_breakout", "failed_breakout"]


def test_a_retest_holds_and_is_confirmed():
    states = run([102, (101.5, 101.5, 100.9, 100.95, 50), (100.6, 100.7, 99.9, 100.0, 40), (100, 100.9, 99.95, 100.8, 60), (101, 102, 100.9, 101.9, 90)])
    assert states[1:4] == ["retest_pending", "retest_holding", "retest_confirmed"] and states[4] in ("confirmed", "confirmation_pending")


def test_nothing_opens_unobserved():
    assert run([99, 101], watched=False) == [None, None]


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in (1, 2, 3):
        price = 100 * np.exp(np.cumsum(rng.normal(0, 0.012, 400)))
        rows += [(i, DAY0 + dt.timedelta(days=n), p * 0.998, p * 1.012, p * 0.988, float(p), float(rng.integers(50, 300)), 100.0) for n, p in enumerate(price.tolist())]
    bars = spark.createDataFrame(rows, "instrument_id int, session_date date, open double, high double, low double, close double, volume double, average_volume double")
    edges = [(i, f"k{i}{j}", 100.0 + 4 * j, 0.004, 2.0, 60.0, 3, DAY0 + dt.timedelta(days=20 * j), [DAY0 + dt.timedelta(days=20 * j + 3 * k) for k in range(60)]) for i in (1, 2, 3) for j in range(4)]
    return bars, spark.createDataFrame(edges, "instrument_id int, key string, level double, tolerance double, atr double, confidence double, touches int, frozen_on date, seen array<date>")


def test_histories_keep_to_the_edges(tables):
    rows = M.histories(*tables).collect()
    assert len(rows) > 100 and {r.to_state for r in rows} >= {"closed_above", "rejected", "failed_breakout", "expired"}
    assert not [(r.from_state, r.to_state) for r in rows if r.from_state is not None and r.to_state not in EVENT_EDGES[r.from_state]]


def test_the_stream_gives_what_the_batch_gives(spark, tables, tmp_path):
    bars, edges = tables
    batch = sorted(map(tuple, M.histories(bars, edges).collect()), key=str)
    for part in range(4):
        own = bars.where((F.datediff("session_date", F.lit(DAY0)) / 100).cast("int") == part)
        own.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")
    query = event_stream(stream, edges).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
    assert got == batch


def test_weeks_from_a_stream(spark, tables, tmp_path):
    bars = tables[0].withColumn("event_time", F.col("session_date").cast("timestamp"))
    bars.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(bars.schema).parquet(f"{tmp_path}/in")
    query = weekly_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = {(r.instrument_id, r.period_start): (r.open, r.high, r.low, r.close, r.volume) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {}
    for i, x in tables[0].toPandas().sort_values("session_date").groupby("instrument_id"):
        for w, y in x.groupby(x.session_date.map(lambda d: d - dt.timedelta(days=d.weekday()))):
            want[i, w] = (y.open.iloc[0], y.high.max(), y.low.min(), y.close.iloc[-1], y.volume.sum())
    assert len(got) > 150 and all(got[k] == pytest.approx(want[k]) for k in got)


def test_quality_has_seven_components_where_the_context_is_known():
    bar = lambda **known: M.Bar(np.datetime64("2020-01-02"), 100.0, 104.0, 99.5, 103.5, 200.0, 100.0, **known)
    monitor = lambda **known: M.Monitor(100.0, 0.002, 2.0, 80.0, 4, **known)

    def quality(m, b):
        assert [state for _, state, _ in m.take(b, True)] == ["closed_above"]
        return m.attempt.quality

    # by hand: boundary 80 * 0.4 + 80 * 0.3 + 70 * 0.3 = 77, penetration (103.5 - 100.2) / 2 over 0.75 ATR and 0.75 ATR too far
    candle = 100 * 0.45 + 100 * 0.25 + (0.5 - 0.5 / 4.5) / 0.5 * 100 * 0.15 + 100 * 0.15
    four = {"boundary_quality": 77.0, "penetration": 100 * 0.65 + 75 * 0.35, "candle_quality": candle, "volume_confirmation": 100.0}
    seven = four | {"relative_strength": 20.0, "market_context": 30.0, "sector_context": 40.0}
    mean = lambda parts: sum(v * M.QUALITY[k] for k, v in parts.items()) / sum(M.QUALITY[k] for k in parts)
    over = max(0.0, 3.5 / 2 - 1)
    four["penetration"] = seven["penetration"] = 65 + (1 - over / 3) * 100 * 0.35
    assert quality(monitor(quality=70.0), bar()) == pytest.approx(mean(four))
    assert quality(monitor(quality=70.0), bar(relative_strength=20.0, market_context=30.0, sector_context=40.0)) == pytest.approx(mean(seven))
    # a level without a structure counts as one of quality 40
    assert quality(monitor(), bar()) == pytest.approx(mean(four | {"boundary_quality": 68.0}))


def test_context_reaches_the_fold(spark, tables):
    bars, edges = tables
    known = bars.withColumns({"relative_strength": F.lit(0.0), "market_context": F.when(F.col("instrument_id") == 1, F.lit(0.0)), "sector_context": F.lit(None).cast("double")})
    momentum = lambda b: M.histories(b, edges).where("reason = 'momentum'").count()
    assert momentum(known) < momentum(bars)  # attempts that the weakest context holds back go other ways
