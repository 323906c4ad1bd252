"""Cross-sections by date: benchmark-relative strength, ranks, breadth, sectors, regimes, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions.scalar import listed, scaled, weighted

# Fixed values of the default strategy; every operator takes its own as parameters.
LOOKBACKS = (20, 60, 120, 250)
RS_WEIGHTS = {20: 0.15, 60: 0.25, 120: 0.3, 250: 0.3}
SECTOR_WEIGHTS = {"relative_return": 0.25, "absolute_return": 0.15, "relative_momentum": 0.2, "breadth_above_50dma": 0.2, "breadth_above_200dma": 0.1, "participation": 0.1}
VOLATILITY_BANDS = {"LOW": 0.2, "NORMAL": 0.6, "ELEVATED": 0.8, "HIGH": 0.95}
SIGNALS = {"primary_trend": 0.3, "benchmark_agreement": 0.15, "ma_slope": 0.15, "breadth_above_200dma": 0.15, "new_high_low": 0.1, "sector_participation": 0.1, "volatility": 0.05}
REGIMES = {"BULL_TRENDING": 0.6, "BULL_CHOPPY": 0.25, "NEUTRAL": -0.1, "BEAR_CHOPPY": -0.35, "BEAR_TRENDING": -0.65}
VOLATILITY_SCORES = {"LOW": 0.5, "NORMAL": 0.25, "ELEVATED": -0.25, "HIGH": -0.7, "EXTREME": -1.0}


MEASURES = ("relative", "excess", "ratio_trend", "ratio_momentum")


def compared(bars: DataFrame, benchmarks: DataFrame, lookbacks: tuple[int, ...] = LOOKBACKS, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """instrument_id, benchmark_id, session_date and a column <measure>_<lookback> each, null where the shared history is too short.

    Benchmarks have a row a session and go to every task, so the bars of a series are shuffled once, before they meet them.
    """
    bench = benchmarks.select("benchmark_id", "session_date", F.col("close").alias("bench"))
    both = bars.select("instrument_id", "session_date", "close").repartition("instrument_id").join(F.broadcast(bench), "session_date")
    w = Window.partitionBy("instrument_id", "benchmark_id").orderBy("session_date")

    def at(k: int) -> dict[str, Column]:
        rs, rb = F.col("close") / F.lag("close", k).over(w) - 1, F.col("bench") / F.lag("bench", k).over(w) - 1
        middle = F.lag("ratio", k - (k + 1) // 2).over(w)
        was = F.lag("ratio", k).over(w)
        return {"relative": (1 + rs) / (1 + rb) - 1, "excess": rs - rb, "ratio_trend": (F.col("ratio") / was - 1) / k, "ratio_momentum": F.col("ratio") / middle - middle / was}

    staged = both.withColumn("ratio", F.col("close") / F.col("bench"))
    return staged.select("instrument_id", "benchmark_id", "session_date", *(at(k)[m].alias(f"{m}_{k}") for k in lookbacks for m in measures))


def compare_to_benchmarks(bars: DataFrame, benchmarks: DataFrame, lookbacks: tuple[int, ...] = LOOKBACKS) -> DataFrame:
    """Relative return, excess, ratio trend and ratio momentum per benchmark and lookback, over shared sessions only."""
    each = F.array(*(F.struct(F.lit(k).alias("lookback"), *(F.col(f"{m}_{k}").alias(m) for m in MEASURES)) for k in lookbacks))
    long = compared(bars, benchmarks, lookbacks).select("instrument_id", "benchmark_id", "session_date", F.explode(each).alias("x"))
    return long.select("instrument_id", "benchmark_id", "session_date", "x.*").where("relative is not null")


def by_lookback(wide: DataFrame, keys: list[str], measure: str, name: str, lookbacks: tuple[int, ...] = LOOKBACKS) -> DataFrame:
    """keys, lookback and ``name`` of the columns <measure>_<lookback>."""
    return wide.select(*keys, *(F.col(f"{measure}_{k}").alias(str(k)) for k in lookbacks)).unpivot(keys, [str(k) for k in lookbacks], "lookback", name).withColumn("lookback", F.col("lookback").cast("int"))


def beats_all(bars: DataFrame, benchmarks: DataFrame, lookbacks: tuple[int, ...] = LOOKBACKS) -> DataFrame:
    """Whether a security is ahead of every benchmark that it can be compared to, per date and lookback."""
    keys = ["instrument_id", "session_date"]
    least = compared(bars, benchmarks, lookbacks, ("relative",)).groupBy(*keys).agg(*(F.min(f"relative_{k}").alias(f"relative_{k}") for k in lookbacks))
    return by_lookback(least, keys, "relative", "least", lookbacks).where("least is not null").select(*keys, "lookback", (F.col("least") > 1e-9).alias("beats_all"))


def rank_cross_section(values: DataFrame, roster: DataFrame, by: tuple[str, ...], value: str = "value", least: int = 5) -> DataFrame:
    """Share of peers at or below each member's value; a member without a value keeps a null rank, too small a roster gives none.

    values: instrument_id, ``by`` columns, value.  roster: instrument_id and the ``by`` columns it depends on.
    """
    return ranked_members(roster.join(values, ["instrument_id", *by], "left"), by, value, least)


def ranked_members(members: DataFrame, by: tuple[str, ...], value: str = "value", least: int = 5) -> DataFrame:
    """As rank_cross_section, of members that have their value (or null) beside them; one shuffle and one sort serve both counts."""
    w = Window.partitionBy(*by)
    good = F.when(F.col(value).isNotNull() & ~F.isnan(value), 1)
    upto = w.orderBy(F.asc_nulls_last(value)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = members.withColumn("_upto", F.count(good).over(upto)).withColumn("roster_size", F.count(good).over(w))
    return counted.withColumn("percentile", F.when(good.isNotNull() & (F.col("roster_size") >= least), F.col("_upto") / F.col("roster_size"))).drop("_upto")


def strays(values: DataFrame, roster: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Values of instruments outside the roster: an error list, not something to pass over."""
    return values.join(roster, ["instrument_id", *by], "left_anti")


def rs_score(percentiles: dict[int, Column]) -> Column:
    return F.round(weighted({str(k): (p, RS_WEIGHTS[k]) for k, p in percentiles.items()}) * 100, 4)


def breadth(features: DataFrame, roster: DataFrame, periods: tuple[int, ...] = (50, 200), least: int = 5) -> DataFrame:
    """One row a date: advances and declines, volumes, share above each moving average over those that have one, new highs and lows.

    features: instrument_id, session_date, close, previous, volume, sma_<n>, high_252, low_252.
    """
    x = roster.join(features, ["instrument_id", "session_date"], "left")
    up, down = F.col("close") > F.col("previous"), F.col("close") < F.col("previous")
    share = [
        (F.count_if(F.col("close") > F.col(f"sma_{n}")) / F.when(F.count(f"sma_{n}") > 0, F.count(f"sma_{n}"))).alias(f"above_{n}") for n in periods
    ]
    out = x.groupBy("session_date").agg(
        F.count_if(up).alias("advances"),
        F.count_if(down).alias("declines"),
        F.count_if(F.col("close") == F.col("previous")).alias("unchanged"),
        F.sum(F.when(up, F.col("volume")).otherwise(0.0)).alias("up_volume"),
        F.sum(F.when(down, F.col("volume")).otherwise(0.0)).alias("down_volume"),
        *share,
        F.count_if(F.col("close") >= F.col("high_252")).alias("new_highs"),
        F.count_if(F.col("close") <= F.col("low_252")).alias("new_lows"),
        F.count(F.lit(1)).alias("roster_size"),
        F.count("close").alias("with_data"),
        roster_digest().alias("roster_digest"),
    )
    return out.withColumn("delta", F.col("advances") - F.col("declines")).withColumn("low_confidence", F.col("with_data") < least)


def roster_digest() -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_set("instrument_id")), lambda i: i.cast("string")), ","), 256)


def breadth_ratios(b: DataFrame) -> DataFrame:
    active = F.col("advances") + F.col("declines")
    return b.select(
        "session_date",
        F.when(F.col("declines") > 0, F.col("advances") / F.col("declines")).when(F.col("advances") > 0, F.lit(float("inf"))).alias("advance_decline"),
        F.when(F.col("down_volume") > 0, F.col("up_volume") / F.col("down_volume")).alias("volume_ratio"),
        F.when(F.col("with_data") > 0, active / F.col("with_data")).alias("participation"),
        (F.col("new_highs") - F.col("new_lows")).alias("high_low_spread"),
    )


def advance_decline_line(b: DataFrame) -> DataFrame:
    """Cumulative; one row a date, so a single ordered window is small."""
    return b.select("session_date", F.sum("delta").over(Window.orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0)).alias("ad_line"))


def thrust(b: DataFrame, n: int = 10) -> DataFrame:
    w = Window.orderBy("session_date")
    share = F.col("advances") / F.when(F.col("advances") + F.col("declines") > 0, F.col("advances") + F.col("declines"))
    return b.withColumn("_s", share).select("session_date", F.when(F.row_number().over(w) >= n, F.avg("_s").over(w.rowsBetween(-(n - 1), 0))).alias("thrust"))


def dispersion(values: DataFrame, by: tuple[str, ...], value: str, least: int = 20) -> DataFrame:
    return values.groupBy(*by).agg(F.count(value).alias("n"), F.when(F.count(value) >= least, F.stddev_samp(value)).alias("dispersion"))


def sector_strength(features: DataFrame, market: DataFrame, least: int = 5, weights: dict[str, float] = SECTOR_WEIGHTS) -> DataFrame:
    """Returns over 20 and 60 sessions, absolute and relative to the market, momentum, breadth, score 0 to 100 and labels per date and sector.

    features: session_date, sector, roc_20, roc_60, above_50, above_200, at_high, at_low (booleans, null if unknown), relative_volume.
    market: session_date, market_20, market_60.  A sector of fewer than ``least`` members gets neither score nor labels.
    """
    share = lambda c: F.avg(F.col(c).cast("double"))
    s = features.where("sector is not null").groupBy("session_date", "sector").agg(
        F.count(F.lit(1)).alias("members"),
        F.avg("roc_20").alias("return_20"),
        F.avg("roc_60").alias("return_60"),
        share("above_50").alias("above_50"),
        share("above_200").alias("above_200"),
        F.avg((F.col("roc_20") > 0).cast("double")).alias("participation"),
        share("at_high").alias("leadership"),
        F.avg("relative_volume").alias("volume_ratio"),
        F.count_if("at_high").alias("new_highs"),
        F.count_if("at_low").alias("new_lows"),
    )
    s = s.join(market, "session_date", "left")
    for n in (20, 60):
        s = s.withColumn(f"relative_{n}", F.when(F.col(f"market_{n}") > -1, (1 + F.col(f"return_{n}")) / (1 + F.col(f"market_{n}")) - 1))
    s = s.withColumn("momentum", F.col("relative_20") - F.col("relative_60"))
    factors = {
        "relative_return": scaled(F.col("relative_20"), -0.1, 0.1),
        "absolute_return": scaled(F.col("return_20"), -0.15, 0.15),
        "relative_momentum": scaled(F.col("momentum"), -0.05, 0.05),
        "breadth_above_50dma": F.col("above_50"),
        "breadth_above_200dma": F.col("above_200"),
        "participation": F.col("participation"),
    }
    enough = F.col("members") >= least
    trend = F.when(F.col("momentum").isNull(), "unknown").when(F.col("momentum") > 0.02, "improving").when(F.col("momentum") < -0.02, "deteriorating").otherwise("stable")
    breadth = F.when(F.col("above_50").isNull(), "unknown").when(F.col("above_50") >= 0.7, "strong").when(F.col("above_50") >= 0.45, "mixed").otherwise("weak")
    led = F.col("leadership").isNull() | (F.col("leadership") >= 0.15)
    part = F.when(F.col("participation").isNull(), "unknown").when((F.col("participation") >= 0.65) & led, "broad").when(F.col("participation") >= 0.45, "moderate").otherwise("narrow")
    return s.withColumns(
        {
            "score": F.when(enough, F.round(100 * weighted({n: (v, weights[n]) for n, v in factors.items()}), 4)),
            "trend": F.when(enough, trend),
            "breadth_status": F.when(enough, breadth),
            "participation_status": F.when(enough, part),
        }
    )


def ranked_sectors(s: DataFrame) -> DataFrame:
    """Rank 1 is the best score of the date; sectors without a score keep a null rank."""
    w = Window.partitionBy("session_date", F.col("score").isNull()).orderBy(F.desc("score"), "sector")
    return s.withColumn("rank", F.when(F.col("score").isNotNull(), F.row_number().over(w)))


def volatility_regime(v: DataFrame, bands: dict[str, float] = VOLATILITY_BANDS) -> DataFrame:
    """Band of the percentile of the benchmark's own trailing volatility, what supports and contradicts it, and how central it lies.

    v: session_date, volatility, percentile, atr_percent, gap_frequency, dispersion, expansion (null if unknown).  Without a percentile the
    regime is UNKNOWN with confidence 0; absolute levels never decide.
    """
    p = F.col("percentile")
    edges = [0.0, *bands.values(), 1.0]
    regime, low, high = F.lit("EXTREME"), F.lit(edges[-2]), F.lit(edges[-1])
    for i, (name, top) in reversed(list(enumerate(bands.items()))):
        regime, low, high = F.when(p < top, name).otherwise(regime), F.when(p < top, edges[i]).otherwise(low), F.when(p < top, top).otherwise(high)
    known = p.isNotNull() & ~F.isnan(p)
    r, wide = F.col("regime"), F.col("dispersion") > 0.3
    calm, wild = r.isin("LOW", "NORMAL"), r.isin("HIGH", "EXTREME")
    supporting = listed(
        percentile=known,
        volatility=known & F.col("volatility").isNotNull(),
        atr=known & F.col("atr_percent").isNotNull(),
        expanding=known & (F.col("expansion") > 1.15),
        contracting=known & (F.col("expansion") < 0.85) & ~r.isin("ELEVATED", "HIGH", "EXTREME"),
        gaps=known & (F.col("gap_frequency") > 0.25),
        dispersion=known & wide & ~calm,
    )
    contradicting = listed(
        contracting=known & (F.col("expansion") < 0.85) & r.isin("ELEVATED", "HIGH", "EXTREME"), rare_gaps=known & (F.col("gap_frequency") < 0.05) & wild, dispersion=known & wide & calm
    )
    central = 1 - 2 * F.abs((p - F.col("_low")) / (F.col("_high") - F.col("_low")) - 0.5)
    confidence = F.bround(F.greatest(F.lit(0.0), 50 + 50 * F.greatest(central, F.lit(0.0)) - 12 * F.size("contradicting"))).cast("int")
    return (
        v.withColumns({"regime": F.when(known, regime).otherwise("UNKNOWN"), "_low": low, "_high": high})
        .withColumns({"supporting": supporting, "contradicting": contradicting})
        .withColumn("confidence", F.when(known, confidence).otherwise(0))
        .drop("_low", "_high")
    )


def benchmark_trends(benchmarks: DataFrame, fast: int = 50, slow: int = 200, slope_over: int = 20) -> DataFrame:
    """session_date and trends, an array (benchmark_id, above_fast, above_slow, stacked, slope) of all benchmarks; null where history is short.

    benchmarks: benchmark_id, session_date, close.
    """
    w = Window.partitionBy("benchmark_id").orderBy("session_date")
    mean = lambda n: F.when(F.row_number().over(w) >= n, F.avg("close").over(w.rowsBetween(-(n - 1), 0)))
    x = benchmarks.withColumns({"fast": mean(fast), "slow": mean(slow)}).withColumn("was", F.lag("fast", slope_over).over(w))
    facts = F.struct(
        "benchmark_id", (F.col("close") > F.col("fast")).alias("above_fast"), (F.col("close") > F.col("slow")).alias("above_slow"), (F.col("fast") > F.col("slow")).alias("stacked"),
        F.when(F.col("was") != 0, (F.col("fast") / F.col("was") - 1) / slope_over).alias("slope"),
    )
    return x.groupBy("session_date").agg(F.array_sort(F.collect_list(facts)).alias("trends"))


def market_regime(m: DataFrame, weights: dict[str, float] = SIGNALS, regimes: dict[str, float] = REGIMES) -> DataFrame:
    """Seven signed signals in [-1, 1], their weighted composite, the regime, and evidence filed by agreement with it.

    m: session_date, trends (of benchmark_trends; the first is the primary one), above_200, new_highs, new_lows, sectors_above, sectors,
    volatility_regime.  Signals that can't be told are left out.  Extreme volatility with a composite under the neutral threshold is
    HIGH_VOLATILITY whatever the trend.  Confidence is .45 distance from a threshold, .35 share of agreeing weight, .2 coverage,
    less .04 for every fact of a benchmark that points the other way.
    """
    clip = lambda x: F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)))
    sign = lambda flag, size: F.when(flag, size).when(~flag, -size)
    first = F.get("trends", F.lit(0))
    told = F.filter(F.transform("trends", lambda t: t["above_slow"]), lambda x: x.isNotNull())
    spread = F.col("new_highs") + F.col("new_lows")
    values = {
        "primary_trend": clip(sign(first["above_slow"], 0.5) + sign(first["above_fast"], 0.3) + F.coalesce(sign(first["stacked"], 0.2), F.lit(0.0))),
        "benchmark_agreement": F.when(F.size(told) > 0, 2.0 * F.size(F.filter(told, lambda x: x)) / F.size(told) - 1),
        "ma_slope": clip(first["slope"] / 0.001),
        "breadth_above_200dma": clip((F.col("above_200") - 0.5) / 0.3),
        "new_high_low": F.when(spread == 0, 0.0).otherwise((F.col("new_highs") - F.col("new_lows")) / F.nullif(spread, F.lit(0))),
        "sector_participation": clip((F.col("sectors_above") / F.nullif("sectors", F.lit(0)) - 0.5) / 0.35),
        "volatility": F.coalesce(*(F.when(F.col("volatility_regime") == n, F.lit(v)) for n, v in VOLATILITY_SCORES.items())),
    }
    have = F.array(*(F.struct(F.lit(n).alias("name"), v.cast("double").alias("score"), F.lit(weights[n]).alias("weight")) for n, v in values.items()))
    mass = lambda of: F.aggregate("signals", F.lit(0.0), lambda acc, s: acc + of(s))
    c, key = F.col("composite"), F.col("_sign")
    regime = F.lit(list(regimes)[-1])
    for name, least in reversed(list(regimes.items())):
        regime = F.when(c >= least, name).otherwise(regime)
    facts = F.flatten(F.transform("trends", lambda t: F.array(sign(t["above_fast"], 1), sign(t["above_slow"], 1), F.when(t["slope"] != 0, F.signum(t["slope"]).cast("int")))))
    opposing = F.size(F.filter(facts, lambda x: x.isNotNull() & (x != key)))
    edge = F.least(F.array_min(F.array(*(F.abs(c - t) for t in regimes.values()))) / 0.15, F.lit(1.0))
    agreeing = mass(lambda s: F.when((s["score"] != 0) & ((s["score"] > 0) == (c > 0)), s["weight"]).otherwise(0.0)) / mass(lambda s: s["weight"])
    blended = 0.45 * edge + 0.35 * agreeing + 0.2 * F.least(F.size("signals") / 6, F.lit(1.0)) - 0.04 * opposing
    names = lambda test: F.transform(F.filter("signals", test), lambda s: s["name"])
    return (
        m.withColumn("signals", F.filter(have, lambda s: s["score"].isNotNull()))
        .withColumn("composite", F.when(F.size("signals") > 0, F.round(mass(lambda s: s["weight"] * s["score"]) / mass(lambda s: s["weight"]), 6)))
        .withColumn("_sign", F.signum("composite").cast("int"))
        .withColumn("regime", F.when(c.isNull(), "UNKNOWN").when((F.col("volatility_regime") == "EXTREME") & (c < regimes["NEUTRAL"]), "HIGH_VOLATILITY").otherwise(regime))
        .withColumn("supporting", names(lambda s: s["score"] * F.col("_sign") > 0))
        .withColumn("contradicting", names(lambda s: s["score"] * F.col("_sign") <= 0))
        .withColumn("opposing", opposing)
        .withColumn("confidence", F.when(F.size("signals") > 0, F.bround(100 * F.greatest(F.least(blended, F.lit(1.0)), F.lit(0.0))).cast("int")).otherwise(0))
        .drop("_sign")
    )


def unreconciled(m: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Rows whose recorded signals don't give their (rounded) composite; empty when all is well."""
    total = F.aggregate("signals", F.lit(0.0), lambda acc, s: acc + s["weight"])
    mass = F.aggregate("signals", F.lit(0.0), lambda acc, s: acc + s["weight"] * s["score"])
    return m.where(F.abs(mass / total - F.col("composite")) > tolerance)


def eligibility(per_instrument: DataFrame, least_sessions: int, features: list[str]) -> DataFrame:
    """INELIGIBLE, DATA_ELIGIBLE or FEATURE_READY with reasons, missing features and sessions still to go.

    per_instrument: instrument_id, n_sessions, last_close, share_zero_volume and the latest value of each feature.
    """
    reasons = listed(too_short=F.col("n_sessions") < least_sessions, bad_price=~F.coalesce(F.col("last_close") > 0, F.lit(False)), illiquid=F.col("share_zero_volume") > 0.2)
    missing = listed(**{f: F.col(f).isNull() for f in features})
    return (
        per_instrument.withColumn("reasons", reasons)
        .withColumn("missing", missing)
        .withColumn("state", F.when(F.size("reasons") > 0, "INELIGIBLE").when(F.size("missing") > 0, "DATA_ELIGIBLE").otherwise("FEATURE_READY"))
        .withColumn("sessions_until_ready", F.greatest(F.lit(least_sessions) - F.col("n_sessions"), F.lit(0)))
    )
