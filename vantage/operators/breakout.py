"""Readings around a breakout level: zone, approach, penetration, candle, volume, acceptance, follow-through, retest, scores, paths.

Every reading is a projection, a window over a series, or an aggregate over the sessions after an event, so a universe of
any size is one shuffle by series.  Rows carry the level that was frozen when it was found: ``level``, ``atr``,
``tolerance`` (share of the level), ``confidence`` (0 to 100), ``touches``.  A reading that cannot be told is null, never 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions.scalar import between, let, listed, ramp_between, weighted
from vantage.operators.features import prior, series, trailing, true_range

# Fixed values of the default configuration.
ZONE = {"least": 0.0015, "atr": 0.1, "most": 0.02, "widening": 1.6}
DETACHED = 40.0
APPROACH = {"atr": 2.5, "share": 0.12, "testing_atr": 0.4, "lookback": 10, "baseline": 30}
CANDLE = {"close_location": 0.45, "body": 0.25, "upper_wick": 0.15, "range": 0.15}
RELATIVE_VOLUME_FULL = {"high_tight_flag": 2.2, "flat_base": 1.5, "vcp": 2.0, "tight_consolidation": 1.5, "breakout_retest": 1.4}
FOLLOW_THROUGH = {"progress": 0.4, "adverse": 0.25, "expansion": 0.15, "volume": 0.2}
RETEST = {"undercut": 0.3, "volume": 0.25, "range": 0.15, "recovery": 0.3}
QUALITY = {"boundary_quality": 0.16, "penetration": 0.16, "candle_quality": 0.22, "volume_confirmation": 0.24, "relative_strength": 0.1, "market_context": 0.06, "sector_context": 0.06}
CONFIRMATION = {"close_acceptance": 0.3, "follow_through": 0.3, "volume_persistence": 0.15, "retest_quality": 0.15, "relative_strength_after": 0.1}
REGIME_SCORES = {"BULL_TRENDING": 90.0, "BULL_CHOPPY": 70.0, "NEUTRAL": 50.0, "HIGH_VOLATILITY": 40.0, "BEAR_CHOPPY": 30.0, "BEAR_TRENDING": 15.0}
BALANCED = {"closes": 1, "follow_sessions": 2, "follow": 55.0, "relative_volume": 1.3, "quality": 60.0, "acceptance_closes": 4, "acceptance_range": 1.0, "retest": 55.0, "coverage": 50.0}


def zone(level: Column, atr: Column, confidence: Column) -> Column:
    """Half width of the zone around a level, a share of it; wider where the level is less certain."""
    base = F.greatest(F.lit(ZONE["least"]), F.coalesce(ZONE["atr"] * atr / level, F.lit(0.0)))
    return F.least(F.lit(ZONE["most"]), base * (ZONE["widening"] - (ZONE["widening"] - 1) * confidence / 100))


def zone_of(level: float, atr: float, confidence: float) -> float:
    """As zone(), for one level inside a fold."""
    base = max(ZONE["least"], ZONE["atr"] * atr / level)
    return min(ZONE["most"], base * (ZONE["widening"] - (ZONE["widening"] - 1) * confidence / 100))


def frozen_boundaries(levels: DataFrame) -> DataFrame:
    """Levels of structures as boundaries to watch: zone, ATR as of the freezing, whether an attempt may open, and why not.

    levels: key, side (resistance or support), kind (structural or research), level, atr, confidence, touches, quality.  A support
    line is refused, as penetration above it means nothing; so is a level that is no positive number.  An attempt may open
    only at a structural level that belongs to an identity; what belongs to none counts as of quality ``DETACHED``.
    """
    attached = F.coalesce(F.col("key") != "", F.lit(False))
    good = F.coalesce((F.col("level") > 0) & ~F.isnan("level"), F.lit(False))
    refused = F.when(F.coalesce(F.col("side") != "resistance", F.lit(True)), "not_resistance").when(~good, "no_level")
    width = F.when(refused.isNull(), zone(F.col("level"), F.col("atr"), F.coalesce("confidence", F.lit(0.0))))
    eligible = refused.isNull() & attached & F.coalesce(F.col("kind") == "structural", F.lit(False))
    return levels.withColumns({"tolerance": width, "pattern_quality": F.when(attached, F.col("quality")).otherwise(F.lit(DETACHED)), "attached": attached, "eligible": eligible, "refused": refused})


def level_on(level: Column, slope: Column, sessions: Column) -> Column:
    """The level of a sloped boundary so many sessions after its anchor."""
    return level + slope * sessions


def geometry(x: DataFrame) -> DataFrame:
    """threshold and floor of the zone, distance of the close in share and ATR, and whether the zone holds it."""
    c, level = F.col("close"), F.col("level")
    top, bottom = level * (1 + F.col("tolerance")), level * (1 - F.col("tolerance"))
    return x.withColumns({"threshold": top, "floor": bottom, "distance": (c - level) / level, "distance_atr": F.when(F.col("atr") > 0, (c - level) / F.col("atr")), "contains": c.between(bottom, top)})


def touches_in(level: Column, highs: Column, share: float) -> Column:
    """How many of an array of highs lie within a share of the level."""
    return F.size(F.filter(highs, lambda h: F.abs(h - level) <= level * share))


def rolling_boundary(bars: DataFrame, n: int = 60, period: int = 14, share: float = 0.015) -> DataFrame:
    """Bars with the boundary that stood before each: highest high of the n sessions before, its touches, ATR, confidence and zone."""
    span = F.avg("_tr").over(prior(period))
    x = bars.withColumn("_tr", true_range()).withColumns({"level": F.max("high").over(prior(n)), "atr": F.when(F.count("_tr").over(prior(period)) >= period, span), "_highs": F.collect_list("high").over(prior(n)), "_n": F.row_number().over(series())})
    x = x.where(F.col("_n") > n).withColumn("touches", touches_in(F.col("level"), F.col("_highs"), share).cast("long"))
    x = x.withColumn("confidence", F.least(F.lit(100.0), 100 * (0.65 * F.least(F.col("touches") / 4, F.lit(1.0)) + 0.175)))
    return x.withColumn("tolerance", zone(F.col("level"), F.col("atr"), F.col("confidence"))).drop("_tr", "_highs", "_n")


def approach(x: DataFrame) -> DataFrame:
    """Distance, rate of approach, compression and volume against a longer baseline, and whether the level is approached or tested."""
    n, base = APPROACH["lookback"], APPROACH["baseline"]
    c, level, atr = F.col("close"), F.col("level"), F.when(F.col("atr") > 0, F.col("atr"))
    mean = lambda of, k: F.avg(of).over(trailing(k))
    whole = F.row_number().over(series()) >= base
    span = F.col("high") - F.col("low")
    d, d_atr = (level - c) / level, (level - c) / atr
    ratio = lambda of: F.when(whole & (mean(of, base) > 0), mean(of, n) / mean(of, base))
    inside = F.col("high").between(level * (1 - F.col("tolerance")), level * (1 + F.col("tolerance")))
    return x.withColumns(
        {
            "close_distance": d,
            "high_distance": (level - F.col("high")) / level,
            "close_distance_atr": d_atr,
            "approach_rate_atr": (c - F.lag("close", n - 1).over(series())) / atr,
            "compression_ratio": ratio(span),
            "approach_volume_ratio": ratio(F.col("volume")),
            "is_approaching": F.coalesce(d_atr <= APPROACH["atr"], F.lit(True)) & (d <= APPROACH["share"]),
            "is_testing": F.coalesce(F.abs(d_atr) <= APPROACH["testing_atr"], F.lit(False)) | inside,
            "approach_score": F.when(d_atr.isNull(), ramp_between(d, APPROACH["share"], 0.0)).otherwise(ramp_between(d_atr, APPROACH["atr"], 0.0)),
        }
    )


def gap_class(gap_atr: Column) -> Column:
    return F.when(gap_atr.isNull() | (gap_atr < 0.25), "none").when(gap_atr < 1, "small").when(gap_atr < 2, "moderate").when(gap_atr < 4, "large").otherwise("extreme")


def penetration(x: DataFrame) -> DataFrame:
    """Touched, crossed within the session, closed above, gapped above; how far in ATR, the gap's class, and scores."""
    c, h, o, level, atr = F.col("close"), F.col("high"), F.col("open"), F.col("level"), F.when(F.col("atr") > 0, F.col("atr"))
    top, bottom, was = level * (1 + F.col("tolerance")), level * (1 - F.col("tolerance")), F.lag("close").over(series())
    beyond, above = (c - top) / atr, (c - level) / atr
    extension = F.when(above.isNotNull(), F.greatest(F.lit(0.0), above - 1.0))
    return x.withColumns(
        {
            "touched": h.between(bottom, top) | level.between(F.col("low"), h),
            "penetrated": h > top,
            "closed_above": c > top,
            "gapped_above": (o > top) & (was.isNull() | (was <= top)),
            "close_above_atr": above,
            "penetration_atr": beyond,
            "extension_atr": extension,
            "gap_class": gap_class((o - was) / atr),
            "penetration_score": F.when(atr.isNull(), ramp_between((c - top) / level, 0.0, F.greatest(F.col("tolerance"), F.lit(1e-6)) * 4)).otherwise(ramp_between(beyond, 0.0, 0.75)),
            "extension_score": F.coalesce(ramp_between(extension, 3.0, 0.0), F.lit(100.0)),
        }
    )


def candle(x: DataFrame) -> DataFrame:
    """Where the close lies in the session's range, body and wicks, range against ATR, and the blended score."""
    h, lo, c, o = (F.col(n) for n in ("high", "low", "close", "open"))
    span = F.when(h - lo > 0, h - lo)
    place, body = F.coalesce((c - lo) / span, F.lit(1.0)), F.coalesce(F.abs(c - o) / span, F.lit(1.0))
    upper, lower = F.coalesce((h - F.greatest(o, c)) / span, F.lit(0.0)), F.coalesce((F.least(o, c) - lo) / span, F.lit(0.0))
    wide = F.coalesce(true_range(), h - lo) / F.when(F.col("atr") > 0, F.col("atr"))
    score = (
        ramp_between(place, 0.25, 0.85) * CANDLE["close_location"]
        + ramp_between(body, 0.0, 0.6) * CANDLE["body"]
        + ramp_between(upper, 0.5, 0.0) * CANDLE["upper_wick"]
        + F.coalesce(ramp_between(wide, 0.0, 1.5), F.lit(50.0)) * CANDLE["range"]
    )
    return x.withColumns({"close_location": place, "body_fraction": body, "upper_wick": upper, "lower_wick": lower, "range_over_atr": wide, "candle_score": score})


def middle(values: Column) -> Column:
    """Median of an array."""
    n = F.size(values)
    return let(F.sort_array(values), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def volume_reading(x: DataFrame, average: int = 20, median: int = 50, family: str | None = None) -> DataFrame:
    """Against the sessions before (at least five): relative volume, median, percentile, share of up volume, and the score."""
    v = F.col("volume")
    enough = F.count(v).over(prior(average)) >= 5
    mean, total = F.avg(v).over(prior(average)), F.sum(v).over(prior(average))
    up = F.sum(F.when(F.col("close") >= F.col("open"), v).otherwise(0.0)).over(prior(average))
    seen = F.collect_list(v).over(prior(average))
    relative = F.when(enough & (mean > 0), v / mean)
    return x.withColumns(
        {
            "average_volume": F.when(enough, mean),
            "median_volume": F.when(enough, middle(F.collect_list(v).over(prior(median)))),
            "relative_volume": relative,
            "volume_percentile": F.when(enough, F.size(F.filter(seen, lambda s: s <= v)) / F.size(seen) * 100),
            "up_volume_fraction": F.when(enough & (total > 0), up / total),
            "volume_score": ramp_between(relative, 0.7, RELATIVE_VOLUME_FULL.get(family or "", 1.8)),
        }
    )


def rejection(x: DataFrame) -> DataFrame:
    """Cleared within the session, closed below the level, with a long upper wick or a low close; needs candle() and volume_reading()."""
    level = F.col("level")
    below = F.col("close") < level
    rejected = (F.col("high") > level * (1 + F.col("tolerance"))) & below & ((F.col("upper_wick") >= 0.5) | (F.col("close_location") <= 0.35))
    score = ramp_between(F.col("upper_wick"), 0.0, 1.0) * 0.4 + ramp_between(F.col("close_location"), 1.0, 0.0) * 0.35 + F.coalesce(ramp_between(F.col("relative_volume"), 0.5, 1.5), F.lit(50.0)) * 0.25
    return x.withColumns({"rejected": rejected, "closed_below": below, "rejection_score": F.when(rejected, score).otherwise(0.0)})


def boundary_quality(confidence: Column, touches: Column, pattern_quality: Column | None = None) -> Column:
    pattern = F.lit(40.0) if pattern_quality is None else F.coalesce(pattern_quality, F.lit(40.0))
    return confidence * 0.4 + ramp_between(touches.cast("double"), 0.0, 5.0) * 0.3 + pattern * 0.3


def compression_score(ratio: Column) -> Column:
    return F.coalesce(between(ratio, 0.45, 0.8, 0.15, 1.4, floor=20.0), F.lit(50.0))


def events_of(x: DataFrame) -> DataFrame:
    """The sessions that close above their boundary after one that did not; x as of penetration() with ``n``, the session's number in the series."""
    was = F.lag("closed_above").over(series())
    return x.withColumn("_was", F.coalesce(was, F.lit(False))).where(F.col("closed_above") & ~F.col("_was")).drop("_was")


def sessions_after(events: DataFrame, bars: DataFrame, most: int) -> DataFrame:
    """Each event (instrument_id, n, level, atr, tolerance, breakout_close, breakout_volume) with up to ``most`` later bars; k counts from 1.

    The sessions wanted are listed by number, so the join is on equality and one event adds ``most`` rows.
    """
    wanted = events.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("_at", F.col("n") + F.col("k"))
    later = bars.select(F.col("instrument_id").alias("_i"), F.col("n").alias("_m"), "session_date", "open", "high", "low", "close", "volume")
    return wanted.join(later, (F.col("instrument_id") == F.col("_i")) & (F.col("_at") == F.col("_m"))).drop("_i", "_m", "_at")


def acceptance(after: DataFrame, closes: int = 4) -> DataFrame:
    """Closes above the zone, the run of them at the end, mean distance and range in ATR, and the score."""
    above = F.col("close") > F.col("level") * (1 + F.col("tolerance"))
    atr = F.when(F.col("atr") > 0, F.col("atr"))
    out = after.groupBy("instrument_id", "event_date").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(above).alias("closes_above"),
        (F.max("k") - F.coalesce(F.max(F.when(~above, F.col("k"))), F.lit(0))).cast("long").alias("consecutive"),
        F.avg((F.col("close") - F.col("level")) / atr).alias("mean_above_atr"),
        F.avg((F.col("high") - F.col("low")) / atr).alias("range_ratio"),
    )
    return out.withColumn("acceptance_score", ramp_between(F.col("consecutive").cast("double"), 0.0, float(closes)))


def follow_through(after: DataFrame) -> DataFrame:
    """Progress and adverse move in ATR, higher closes, range and volume against the breakout bar; no later session, no row."""
    atr = F.max(F.when(F.col("atr") > 0, F.col("atr")))
    start = F.max("breakout_close")
    out = after.groupBy("instrument_id", "event_date").agg(
        F.count(F.lit(1)).alias("sessions"),
        ((F.max("close") - start) / atr).alias("progress_atr"),
        F.when(atr.isNotNull(), F.greatest(F.lit(0.0), (start - F.min("low")) / atr)).alias("adverse_atr"),
        F.count_if(F.col("close") > F.col("breakout_close")).alias("higher_closes"),
        (F.avg(F.col("high") - F.col("low")) / atr).alias("range_expansion"),
        (F.avg("volume") / F.max(F.when(F.col("breakout_volume") > 0, F.col("breakout_volume")))).alias("volume_hold"),
    )
    half = F.lit(50.0)
    score = (
        F.coalesce(ramp_between(F.col("progress_atr"), 0.0, 1.0), half) * FOLLOW_THROUGH["progress"]
        + F.coalesce(ramp_between(F.col("adverse_atr"), 1.0, 0.0), half) * FOLLOW_THROUGH["adverse"]
        + F.coalesce(ramp_between(F.col("range_expansion"), 0.0, 1.2), half) * FOLLOW_THROUGH["expansion"]
        + F.coalesce(ramp_between(F.col("volume_hold"), 0.0, 0.7), half) * FOLLOW_THROUGH["volume"]
    )
    return out.withColumn("follow_score", score)


def is_pullback(close: Column, breakout_close: Column, atr: Column) -> Column:
    """A close so far under the breakout's that a retest begins."""
    return (close < breakout_close) & F.when(F.coalesce(atr > 0, F.lit(False)), (breakout_close - close) / atr >= 0.5).otherwise(close < breakout_close * 0.98)


def retest(after: DataFrame) -> DataFrame:
    """The pullback of each event from its first session on: low, undercut, sessions below, contraction, recovery, quality, failed, expired."""
    pulled = is_pullback(F.col("close"), F.col("breakout_close"), F.col("atr"))
    event = Window.partitionBy("instrument_id", "event_date")
    x = after.withColumn("_from", F.min(F.when(pulled, F.col("k"))).over(event)).where(F.col("k") >= F.col("_from"))
    x = x.withColumn("_low", F.min(F.struct("low", "k")).over(event))
    level, atr = F.col("level"), F.when(F.col("atr") > 0, F.col("atr"))
    since = F.col("k") >= F.col("_low.k")
    out = x.groupBy("instrument_id", "event_date").agg(
        F.min("session_date").alias("started"),
        F.min("low").alias("low"),
        F.coalesce(F.greatest(F.lit(0.0), F.max(level - F.col("low")) / F.max(atr)), F.lit(0.0)).alias("undercut_atr"),
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(F.col("close") < level).alias("sessions_below"),
        (F.avg("volume") / F.max(F.when(F.col("breakout_volume") > 0, F.col("breakout_volume")))).alias("volume_ratio"),
        F.avg((F.col("high") - F.col("low")) / atr).alias("range_ratio"),
        F.count_if(since & (F.col("close") > level)).alias("recovery_closes"),
        F.min(F.when(since & (F.col("close") > level), F.col("session_date"))).alias("recovered"),
    )
    under = ramp_between(F.col("undercut_atr"), 0.6, 0.0, floor=10.0) * F.when(F.col("sessions_below") > 3, 0.5).otherwise(1.0)
    half = F.lit(50.0)
    quality = (
        under * RETEST["undercut"]
        + F.coalesce(ramp_between(F.col("volume_ratio"), 1.5, 0.45, floor=5.0), half) * RETEST["volume"]
        + F.coalesce(ramp_between(F.col("range_ratio"), 2.0, 0.6, floor=5.0), half) * RETEST["range"]
        + ramp_between(F.col("recovery_closes").cast("double"), 0.0, 1.0) * RETEST["recovery"]
    )
    return out.withColumns({"retest_quality": quality, "failed": (F.col("undercut_atr") > 0.6) | (F.col("sessions_below") > 3), "expired": F.col("sessions") > 25})


def strength_at(x: DataFrame, n: int = 60, least: int = 10) -> DataFrame:
    """Relative strength at each session against ``bench``: rank of the ratio in its window, and whether it is high before or with price."""
    ratio, c = F.col("close") / F.col("bench"), F.col("close")
    w, many = trailing(n), F.row_number().over(series())
    y = x.withColumns({"ratio": ratio, "_n": many}).withColumns({"_seen": F.collect_list("ratio").over(w), "_top": F.max("ratio").over(w), "_high": F.max("close").over(w)})
    rs_high, price_high = F.col("ratio") >= F.col("_top") - 1e-12, c >= F.col("_high") - 1e-12
    return (
        y.withColumns(
            {
                "rs_percentile": F.when(many >= least, F.size(F.filter("_seen", lambda s: s <= F.col("ratio"))) / F.size("_seen") * 100),
                "near_rs_high": F.col("ratio") >= F.col("_top") * 0.98,
                "rs_high_before_price": rs_high & ~price_high,
                "rs_high_with_price": rs_high & price_high,
            }
        )
        .withColumn("rs_score", rs_points(F.col("rs_percentile"), F.col("rs_high_before_price"), F.col("rs_high_with_price"), F.col("near_rs_high")))
        .drop("_seen", "_top", "_high", "_n")
    )


def rs_points(percentile: Column, before: Column, with_price: Column, near: Column) -> Column:
    return F.when(percentile.isNotNull(), F.least(F.lit(100.0), percentile + F.when(before, 20.0).when(with_price, 10.0).when(near, 5.0).otherwise(0.0)))


def regime_score(regime: Column, confidence: Column | None = None) -> Column:
    return F.coalesce(*(F.when(regime == k, F.lit(v)) for k, v in REGIME_SCORES.items()))


def composite(parts: dict[str, Column], weights: dict[str, float]) -> tuple[Column, Column]:
    """Weighted mean over the components that are there, and the share of the weight that they carry, 0 to 100."""
    clipped = {n: (F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(100.0)), F.lit(0.0))), weights[n]) for n, v in parts.items()}
    have = sum((F.when(v.isNotNull(), F.lit(w)).otherwise(0.0) for v, w in clipped.values()), F.lit(0.0))
    return F.coalesce(weighted(clipped), F.lit(0.0)), have / sum(weights.values()) * 100


def breakout_quality(x: DataFrame, boundary: Column, relative: Column, market: Column, sector: Column) -> DataFrame:
    """Quality and coverage of a breakout at its qualifying close, with evidence for and against; needs the readings above."""
    parts = {
        "boundary_quality": boundary,
        "penetration": F.col("penetration_score") * 0.65 + F.col("extension_score") * 0.35,
        "candle_quality": F.col("candle_score"),
        "volume_confirmation": F.col("volume_score"),
        "relative_strength": relative,
        "market_context": market,
        "sector_context": sector,
    }
    score, coverage = composite(parts, QUALITY)
    supporting = listed(boundary=boundary >= 70, cleared=F.col("penetration_score") >= 70, closed_high=F.col("close_location") >= 0.8, volume=F.col("relative_volume") >= 1.5)
    against = listed(boundary=boundary < 50, extended=F.col("extension_score") < 50, closed_low=F.col("close_location") <= 0.4, volume=F.col("relative_volume") < 1.0)
    return x.withColumns({"quality": F.round(score, 10), "coverage": F.round(coverage, 6), "supporting": supporting, "contradicting": against, "components": F.array(*parts.values())})


def confirmation(x: DataFrame) -> DataFrame:
    """Confirmation score and coverage over acceptance, follow-through, volume, retest and strength after; missing ones are left out."""
    parts = {"close_acceptance": F.col("acceptance_score"), "follow_through": F.col("follow_score"), "volume_persistence": ramp_between(F.col("volume_hold"), 0.4, 1.0), "retest_quality": F.col("retest_quality"), "relative_strength_after": F.col("rs_after")}
    score, coverage = composite(parts, CONFIRMATION)
    return x.withColumns({"confirmation": F.round(score, 10), "confirmation_coverage": F.round(coverage, 6)})


def identification_confidence(x: DataFrame, pattern_quality: Column | None = None) -> Column:
    """How sure it is that this is a breakout: boundary, definition, pattern, coverage, decisiveness, agreement of components."""
    attached = pattern_quality is not None
    definition = F.least(F.lit(100.0), F.col("touches") * 25.0) * (1.0 if attached else 0.6)
    decisive = F.when(F.col("penetration_atr").isNull(), F.when(F.col("closed_above"), 60.0).otherwise(30.0)).otherwise(F.greatest(F.least(F.col("penetration_atr") / 0.5, F.lit(1.0)), F.lit(0.0)) * 100)
    have = F.filter("components", lambda v: v.isNotNull())
    mean = F.aggregate(have, F.lit(0.0), lambda a, v: a + v) / F.size(have)
    spread = F.sqrt(F.aggregate(have, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / F.size(have))
    agreement = F.when(F.size(have) >= 2, F.greatest(F.least(100 - spread * 2, F.lit(100.0)), F.lit(0.0))).otherwise(50.0)
    pattern = pattern_quality if attached else F.lit(40.0)
    value = F.col("confidence") * 0.2 + definition * 0.15 + pattern * 0.15 + F.col("coverage") * 0.2 + decisive * 0.15 + agreement * 0.15
    return F.greatest(F.least(value, F.lit(100.0)), F.lit(0.0))


def confirmation_path(x: DataFrame, p: dict[str, float] = BALANCED) -> DataFrame:
    """momentum, retest or acceptance, the first whose conditions all hold (none, and null under too little evidence), with what blocks each."""
    follow = F.coalesce(F.col("follow_score") < p["follow"], F.lit(True)) & (F.lit(p["follow_sessions"]) > 0)
    blocks = {
        "momentum": listed(closes=F.col("closes_above") < p["closes"], quality=F.col("quality") < p["quality"], volume=F.coalesce(F.col("relative_volume") < p["relative_volume"], F.lit(True)), sessions=F.col("sessions") < p["follow_sessions"], follow_through=(F.col("sessions") >= p["follow_sessions"]) & follow),
        "retest": listed(no_pullback=F.col("retest_quality").isNull(), not_recovered=F.col("retest_quality").isNotNull() & F.col("recovered").isNull(), quality=F.col("retest_quality") < p["retest"]),
        "acceptance": listed(closes=F.col("consecutive") < p["acceptance_closes"], range=F.col("range_ratio") > p["acceptance_range"]),
    }
    path = F.lit("none")
    for name, why in reversed(list(blocks.items())):
        path = F.when(F.size(why) == 0, name).otherwise(path)
    out = x.withColumns({f"blocked_{n}": why for n, why in blocks.items()})
    return out.withColumn("path", F.when(F.col("confirmation_coverage") >= p["coverage"], path))


def merge_evidence(parts: Column) -> Column:
    """Evidence of all components in order, each once."""
    return F.array_distinct(F.flatten(parts))


def evidence_bundle(x: DataFrame) -> DataFrame:
    """What a reader of a breakout has and lacks, by name; lacking is no judgement, only an absence."""
    items = {"quality": "quality", "acceptance": "acceptance_score", "follow_through": "follow_score", "volume": "volume_hold", "retest": "retest_quality", "relative_strength": "rs_after"}
    have = listed(**{n: F.col(c).isNotNull() for n, c in items.items()})
    lack = listed(**{n: F.col(c).isNull() for n, c in items.items()})
    return x.withColumns({"has": have, "lacks": lack, "complete": F.size(lack) == 0})
