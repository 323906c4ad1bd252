"""Properties of the feature layer: causality, scale invariance, kernels against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.operators import features as X
from vantage.sources.fixtures import frame


@pytest.fixture(scope="module")
def bars(spark, sf):
    return frame(spark, sf, "bars").where("instrument_id <= 3").cache()


def _table(df, columns):
    p = df.select("instrument_id", "session_date", *columns).toPandas().sort_values(["instrument_id", "session_date"])
    return p.set_index(["instrument_id", "session_date"])


COLUMNS = ["sma_20", "roc_20", "volatility_20", "bollinger_bandwidth", "relative_volume_20", "vwap_20", "slope_sma_20", "volatility_percentile", "rsi_14", "macd_signal", "atr_14", "adx_14"]


def test_no_look_ahead(bars):
    cut = bars.agg(F.expr("percentile_approx(session_date, 0.6)")).first()[0]
    whole, prefix = _table(X.feature_set(bars), COLUMNS), _table(X.feature_set(bars.where(F.col("session_date") <= cut)), COLUMNS)
    same = whole.loc[prefix.index].astype(float)
    np.testing.assert_allclose(same.to_numpy(), prefix.astype(float).to_numpy(), rtol=1e-12)


def test_scale_invariance(bars):
    scaled = bars.select("instrument_id", "session_date", *((F.col(c) * 8).alias(c) for c in ("open", "high", "low", "close")), "volume")
    free = ["roc_20", "volatility_20", "bollinger_bandwidth", "slope_sma_20", "rsi_14", "adx_14"]
    a, b = _table(X.feature_set(bars), free).astype(float), _table(X.feature_set(scaled), free).astype(float)
    np.testing.assert_allclose(a.to_numpy(), b.to_numpy(), rtol=1e-9)


def test_partitioning_changes_nothing(bars):
    a, b = _table(X.feature_set(bars), COLUMNS).astype(float), _table(X.feature_set(bars.repartition(7, "volume")), COLUMNS).astype(float)
    np.testing.assert_allclose(a.to_numpy(), b.to_numpy(), rtol=0, atol=0)


def test_kernels():
    x = np.array([1.0, 2, 3, 4, 5, 4, 3])
    assert np.isnan(X.ema(x, 3)[:2]).all() and X.ema(x, 3)[2] == 2 and X.ema(x, 3)[3] == 3
    assert X.rsi(np.arange(20.0))[-1] == 100 and X.rsi(np.ones(20))[-1] == 50
    flat = np.full(60, 10.0)
    a, p, m = X.adx(flat + 1, flat - 1, flat)
    assert np.isnan(a).all() and p[-1] == 0 and m[-1] == 0  # no movement either way
    assert all(np.isnan(y).all() for y in X.adx(flat, flat, flat)) and all(np.isnan(y).all() for y in X.adx(x, x - 1, x))
    rise = np.arange(60.0)
    assert X.adx(rise + 1, rise, rise + 0.5)[0][-1] == pytest.approx(100)


def test_smoothing_against_plain_loops():
    x = np.random.default_rng(2).normal(100, 3, 80)
    value, smooth = x[:12].mean(), [x[:12].mean()]
    for v in x[12:]:
        value = value + 2 / 13 * (v - value)
        smooth.append(value)
    np.testing.assert_allclose(X.ema(x, 12)[11:], smooth, rtol=1e-12)
    high, low = x + 1, x - 1
    ranges = [max(h - lo, abs(h - c), abs(lo - c)) for h, lo, c in zip(high[1:], low[1:], x[:-1])]
    value, spans = np.mean(ranges[:14]), [np.mean(ranges[:14])]
    for v in ranges[14:]:
        value = value + (v - value) / 14
        spans.append(value)
    np.testing.assert_allclose(X.atr(high, low, x)[14:], spans, rtol=1e-12)
    line, signal, rest = X.macd(x)
    np.testing.assert_allclose(line[25:], X.ema(x, 12)[25:] - X.ema(x, 26)[25:])
    np.testing.assert_allclose(rest[40:], line[40:] - signal[40:])


def test_greatest_does_not_fill_the_first_true_range(bars):
    first = bars.groupBy("instrument_id").agg(F.min("session_date").alias("session_date"))
    assert bars.withColumn("tr", X.true_range()).join(first, ["instrument_id", "session_date"]).where("tr is not null").count() == 0


def test_episodes_are_series_of_their_own(spark, bars):
    """A relisted series: after its break every feature, windowed or recursive, is what the bars after the break alone give."""
    from vantage.operators.asof import BREAK_SESSIONS, by_episode

    ordered = bars.select("session_date").distinct().orderBy("session_date").collect()
    days = [r.session_date for r in ordered]
    calendar = spark.createDataFrame([(d, n) for n, d in enumerate(days)], "session_date date, session_ord int")
    first, last = days[150], days[150 + BREAK_SESSIONS + 5]
    gone = (F.col("instrument_id") == 2) & (F.col("session_date") >= first) & (F.col("session_date") < last)
    cut = bars.where(~gone).withColumn("close", F.when((F.col("instrument_id") == 2) & (F.col("session_date") >= last), F.col("close") * 9).otherwise(F.col("close")))
    out = by_episode(cut, calendar, X.feature_set).cache()
    assert {(r.instrument_id, r.episode_id) for r in out.select("instrument_id", "episode_id").distinct().collect()} == {(1, 0), (2, 0), (2, 1), (3, 0)}
    names = [c for c in out.columns if c not in ("instrument_id", "session_date", "episode_id")]
    for own, alone in ((out.where("episode_id = 1"), cut.where((F.col("instrument_id") == 2) & (F.col("session_date") >= last))), (out.where("instrument_id = 1"), cut.where("instrument_id = 1"))):
        a, b = _table(own, names).astype(float), _table(X.feature_set(alone), names).astype(float)
        assert len(a) > 100
        np.testing.assert_allclose(a.to_numpy(), b.to_numpy(), rtol=1e-12)
    assert X.keys() == ("instrument_id",)


def test_the_feature_set_is_one_shuffle(bars):
    plan = X.feature_set(bars)._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert plan.count("Exchange hashpartitioning(instrument_id") <= 1 and "Join" not in plan  # none where the cached rows lie by instrument already
