"""Profiles of stretches of a series: impulse, pullback, volume, volatility, relative strength, duration, lines and touches.

A stretch is named by a column (``block``), so each profile is one grouped aggregate over rows that carry it, and a whole
universe is measured in one shuffle by (series, block).  ``k`` numbers the sessions of a stretch from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = ("instrument_id", "block")


def stretches(bars: DataFrame, n: int, baseline: int = 20) -> DataFrame:
    """Bars dealt into stretches of n sessions, with k, the close before within the stretch, and the mean volume of the sessions before it."""
    w = Window.partitionBy("instrument_id").orderBy("session_date")
    x = bars.withColumn("_i", F.row_number().over(w) - 1).withColumn("_mean", F.avg("volume").over(w.rowsBetween(-baseline, -1)))
    x = x.withColumns({"block": F.floor(F.col("_i") / n).cast("int"), "k": (F.col("_i") % n).cast("int")})
    inside = Window.partitionBy(*BY).orderBy("k")
    return x.withColumns({"was": F.lag("close").over(inside), "baseline": F.first("_mean").over(inside)}).drop("_i", "_mean")


def line(x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Slope, value at x = 0 and fit of a least-squares line; a line through two points has no fit to speak of, 0."""
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    slope = F.regr_slope(y, x)
    fit = F.when(n == 2, F.lit(0.0)).when(n > 2, F.coalesce(F.regr_r2(y, x), F.lit(0.0)))
    return slope, F.regr_intercept(y, x), F.when(F.regr_syy(y, x) > 0, fit).otherwise(F.when(n >= 2, F.lit(0.0)))


def _first(c: str) -> Column:
    return F.min_by(c, "k")


def _last(c: str) -> Column:
    return F.max_by(c, "k")


def _unit(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def impulse(x: DataFrame) -> DataFrame:
    """The advance from the first low to the highest high: gain, rate, up days, closing strength, volume, and what one session or gap made of it."""
    span = F.when(F.col("high") > F.col("low"), (F.col("close") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.5)
    step = F.col("close") - F.col("was")
    out = x.groupBy(*BY).agg(
        (F.count(F.lit(1)) - 1).alias("sessions"),
        _first("low").alias("low"),
        F.max("high").alias("high"),
        F.avg((F.col("close") > F.col("open")).cast("double")).alias("up_day_fraction"),
        F.avg(span).alias("closing_strength"),
        F.coalesce(F.avg("volume") / F.max(F.when(F.col("baseline") > 0, F.col("baseline"))), F.lit(1.0)).alias("volume_ratio"),
        (_last("close") - _first("low")).alias("_total"),
        F.max(step).alias("_step"),
        F.max(F.col("open") - F.col("was")).alias("_gap"),
        F.avg(F.when(step.isNotNull(), (step > 0).cast("double"))).alias("_up"),
        _first("atr").alias("_atr"),
    )
    rises = F.col("_total") > 0
    return (
        out.where((F.col("sessions") > 0) & (F.col("low") > 0))
        .withColumn("gain", F.col("high") / F.col("low") - 1)
        .withColumns(
            {
                "gain_atr": F.coalesce(F.col("low") * F.col("gain") / F.when(F.col("_atr") > 0, F.col("_atr")), F.lit(0.0)),
                "rate_per_session": F.pow(1 + F.col("gain"), 1 / F.col("sessions")) - 1,
                "largest_session_share": F.when(rises, _unit(F.col("_step") / F.col("_total"))).otherwise(1.0),
                "largest_gap_share": F.when(rises, _unit(F.col("_gap") / F.col("_total"))).otherwise(0.0),
                "persistence": F.when(rises, F.col("_up")).otherwise(0.0),
            }
        )
        .drop("_total", "_step", "_gap", "_up", "_atr")
    )


def pullback(x: DataFrame, legs: DataFrame) -> DataFrame:
    """Each stretch after an impulse (the block before): depth, retracement of it, worst fall from the running peak, undercut."""
    before = legs.select("instrument_id", (F.col("block") + 1).alias("block"), F.col("low").alias("from_low"), F.col("high").alias("from_high"))
    y = x.join(before, list(BY))
    peak = F.greatest(F.max("close").over(Window.partitionBy(*BY).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)), F.col("from_high"))
    y = y.withColumn("_fall", (peak - F.col("low")) / peak)
    top, low, height = F.greatest(F.max("high"), F.max("from_high")), F.min("low"), F.max("from_high") - F.max("from_low")
    return y.groupBy(*BY).agg(
        F.count(F.lit(1)).alias("sessions"),
        ((top - low) / top).alias("depth"),
        F.coalesce((top - low) / F.when(_first("atr") > 0, _first("atr")), F.lit(0.0)).alias("depth_atr"),
        F.when(height > 0, (F.max("from_high") - low) / height).otherwise(0.0).alias("retracement"),
        F.max("_fall").alias("worst_fall"),
        (low < F.max("from_low")).alias("undercut"),
    )


def volume_profile(x: DataFrame, late: int = 3) -> DataFrame:
    """Mean against the sessions before, up against down, slope, on-balance change, the last sessions against all, and the share of dry sessions."""
    v, c, o = F.col("volume"), F.col("close"), F.col("open")
    last = F.max("k").over(Window.partitionBy(*BY))
    y = x.withColumn("_late", F.col("k") > last - late)
    mean, base = F.avg(v), F.max(F.when(F.col("baseline") > 0, F.col("baseline")))
    slope = F.when((F.count(v) >= 3) & (mean > 0), line(F.col("k").cast("double"), v)[0] / mean).otherwise(0.0)
    down = F.sum(F.when(c < o, v).otherwise(0.0))
    return y.groupBy(*BY).agg(
        mean.alias("mean_volume"),
        F.coalesce(mean / base, F.lit(1.0)).alias("ratio"),
        F.when(down > 0, F.sum(F.when(c >= o, v).otherwise(0.0)) / down).otherwise(2.0).alias("up_down_ratio"),
        slope.alias("slope_per_session"),
        F.sum(F.coalesce(F.signum(c - F.col("was")), F.lit(0.0)) * v).alias("obv_change"),
        F.when(mean > 0, F.avg(F.when(F.col("_late"), v)) / mean).otherwise(1.0).alias("late_ratio"),
        F.coalesce(F.avg(F.when(F.col("baseline") > 0, (v < F.col("baseline")).cast("double"))), F.lit(0.0)).alias("dry_fraction"),
    )


def volatility_profile(x: DataFrame) -> DataFrame:
    """Ranges of the later half against the earlier, the same for ATR, dispersion of closes, and the share of sessions with a narrower range."""
    inside = Window.partitionBy(*BY)
    span, c = F.col("high") - F.col("low"), F.when(F.col("close") > 0, F.col("close"))
    half = F.floor(F.count(F.lit(1)).over(inside) / 2)
    y = x.withColumns({"_r": span, "_early": F.col("k") < half}).withColumn("_narrower", (F.col("_r") < F.lag("_r").over(inside.orderBy("k"))).cast("double"))
    part = lambda of, early: F.avg(F.when(F.col("_early") == early, of))
    ratio = F.coalesce(part(F.col("_r"), False) / F.nullif(part(F.col("_r"), True), F.lit(0)), F.lit(1.0))
    atr = part(F.col("atr"), False) / F.nullif(part(F.col("atr"), True), F.lit(0))
    return y.groupBy(*BY).agg(
        F.count(F.lit(1)).alias("sessions"), F.avg(F.col("_r") / c).alias("mean_range"), F.coalesce(atr, ratio).alias("atr_ratio"), ratio.alias("range_ratio"),
        (F.stddev_pop("close") / F.avg("close")).alias("dispersion"), F.max(F.col("_r") / c).alias("max_range"), F.coalesce(F.avg("_narrower"), F.lit(0.0)).alias("narrowing"),
    ).where(F.col("sessions") >= 4)


def strength_profile(x: DataFrame) -> DataFrame:
    """Return of the stretch against ``bench``: excess, whether the ratio ends at its high, and the ratio's slope."""
    ratio = F.col("close") / F.col("bench")
    first = lambda c: F.min_by(c, "k")
    own, other = F.max_by("close", "k") / first("close") - 1, F.max_by("bench", "k") / first("bench") - 1
    slope = F.when((F.count(F.lit(1)) >= 3) & (F.avg(ratio) > 0), line(F.col("k").cast("double"), ratio)[0] / F.avg(ratio)).otherwise(0.0)
    return x.groupBy(*BY).agg(F.count(F.lit(1)).alias("sessions"), own.alias("own_return"), other.alias("bench_return"), (own - other).alias("excess"), (F.max_by(ratio, F.col("k")) >= F.max(ratio) * 0.995).alias("at_high"), slope.alias("ratio_slope")).where(F.col("sessions") > 1)


def duration(sessions: Column, reference: Column, least: int, most: int, most_ratio: float | None = None) -> dict[str, Column]:
    """Ratio to a reference stretch, too short, too extended."""
    ratio = F.coalesce(sessions / F.nullif(reference, F.lit(0)), F.lit(0.0))
    extended = sessions > most
    return {"ratio": ratio, "too_short": sessions < least, "too_extended": extended if most_ratio is None else extended | (ratio > most_ratio)}


def boundary_confidence(touches: Column, tightness: Column) -> Column:
    """0 to 100: .65 touches (four are full), .35 tightness; null where either is (``least`` alone would pass a null over)."""
    whole = F.least(F.lit(100.0), 100 * (0.65 * F.least(touches / 4, F.lit(1.0)) + 0.35 * tightness))
    return F.when(touches.isNotNull() & tightness.isNotNull(), whole)


def sloped_boundary(pivots: DataFrame) -> DataFrame:
    """Regression line through the pivots of one kind of each stretch: level at the first, slope a session, fit, confidence.

    pivots: instrument_id, block, k, session_date, price.
    """
    anchor = F.min("k").over(Window.partitionBy(*BY))
    x = pivots.withColumn("_x", (F.col("k") - anchor).cast("double"))
    slope, level, fit = line(F.col("_x"), F.col("price"))
    out = x.groupBy(*BY).agg(F.count(F.lit(1)).alias("points"), F.min("session_date").alias("anchor_date"), F.max("session_date").alias("end_date"), slope.alias("slope_per_session"), level.alias("level"), fit.alias("fit"))
    return out.where(F.col("points") >= 2).withColumn("confidence", boundary_confidence(F.col("points"), _unit(F.col("fit"))))


def single_extreme(x: DataFrame) -> DataFrame:
    """The highest high of each stretch as a boundary of low confidence; ties to the earlier session."""
    top = F.max_by("session_date", F.struct("high", -F.col("k")))
    return x.groupBy(*BY).agg(F.max("high").alias("level"), top.alias("anchor_date"), F.min("session_date").alias("start_date"), F.max("session_date").alias("end_date")).withColumn("confidence", F.lit(25.0))


def touches(x: DataFrame, share: float = 0.015, apart: int = 2) -> DataFrame:
    """Sessions of each stretch whose high lies within a share of ``level``, at least ``apart`` sessions from each other, the closer one kept.

    Only the sessions near the level are gathered, at most one stretch's worth a row, and folded in order.
    """
    near = x.where((F.col("level") > 0) & (F.abs(F.col("high") - F.col("level")) <= F.col("level") * share))
    listed = near.groupBy(*BY).agg(F.max("level").alias("level"), F.array_sort(F.collect_list(F.struct("k", F.abs(F.col("high") - F.col("level")).alias("off")))).alias("_near"))

    def step(kept: Column, now: Column) -> Column:
        last = F.element_at(kept, -1)
        closer = F.when(now["off"] < last["off"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(now))).otherwise(kept)
        return F.when((F.size(kept) > 0) & (now["k"] - F.get(kept, F.size(kept) - 1)["k"] < apart), closer).otherwise(F.concat(kept, F.array(now)))

    fold = F.aggregate("_near", F.array().cast("array<struct<k:int,off:double>>"), step)
    return listed.select(*BY, "level", F.transform(fold, lambda t: t["k"]).alias("touches"))


def contraction_summary(legs: DataFrame) -> DataFrame:
    """Sequence of pullback depths of each series (instrument_id, high_on, depth): count, progression, share that tightens, last over first."""
    w = Window.partitionBy("instrument_id").orderBy("high_on")
    x = legs.withColumn("_step", F.col("depth") - F.lag("depth").over(w))
    first, last = F.min_by("depth", "high_on"), F.max_by("depth", "high_on")
    return x.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("legs"), F.coalesce(F.avg("_step"), F.lit(0.0)).alias("progression"), F.coalesce(F.avg((F.col("_step") < 0).cast("double")), F.lit(0.0)).alias("monotonic"),
        F.when((F.count(F.lit(1)) >= 2) & (first > 0), last / first).otherwise(1.0).alias("tightening"), last.alias("final_depth"),
    )
