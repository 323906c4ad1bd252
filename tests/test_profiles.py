"""Touches against a plain loop, and score curves by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantage.functions import scalar as S
from vantage.operators import breakout as B
from vantage.operators import profiles as P


def loop(highs, level, share=0.015, apart=2):
    kept = []
    for k, h in enumerate(highs):
        off = abs(h - level)
        if off > level * share:
            continue
        if kept and k - kept[-1] < apart:
            if off < abs(highs[kept[-1]] - level):
                kept[-1] = k
            continue
        kept.append(k)
    return kept


def test_touches(spark):
    rng = np.random.default_rng(4)
    data = {b: (100 + rng.normal(0, 2, 60)).round(2).tolist() for b in range(40)}
    rows = [(1, b, k, h, 100.0) for b, x in data.items() for k, h in enumerate(x)]
    out = P.touches(spark.createDataFrame(rows, "instrument_id int, block int, k int, high double, level double")).collect()
    assert {r.block: r.touches for r in out} == {b: loop(x, 100.0) for b, x in data.items()}


def test_curves(spark):
    x = F.col("x")
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.25, 1.0, 2.0, None)], "x double")
    got = df.select(S.ramp_between(x, 0.0, 1.0).alias("r"), S.ramp_between(x, 1.0, 0.0, floor=10.0).alias("d"), S.between(x, 0.0, 1.0, -1.0, 3.0).alias("b"), S.piecewise(x, [(0.0, 0.0), (0.5, 80.0), (1.0, 100.0)]).alias("p")).collect()
    assert [r.r for r in got] == [0, 0, 25, 100, 100, None] and [r.d for r in got] == [100, 100, 77.5, 10, 10, None]
    assert [r.b for r in got] == [0, 100, 100, 100, 50, None] and [r.p for r in got] == [0, 0, 40, 100, 100, 0]


def test_zone_and_gaps(spark):
    df = spark.createDataFrame([(100.0, 2.0, 100.0), (100.0, 50.0, 0.0), (100.0, None, 50.0)], "level double, atr double, confidence double")
    assert [r[0] for r in df.select(B.zone(F.col("level"), F.col("atr"), F.col("confidence"))).collect()] == pytest.approx([0.002, 0.02, 0.00195])
    gaps = spark.createDataFrame([(None,), (0.1,), (0.5,), (1.5,), (3.0,), (9.0,)], "g double").select(B.gap_class(F.col("g"))).collect()
    assert [r[0] for r in gaps] == ["none", "none", "small", "moderate", "large", "extreme"]
