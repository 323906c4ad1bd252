"""Screens and summaries over features and series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions.scalar import listed, scaled, weighted


def liquidity_screen(latest: DataFrame, low: float = 5.0, high: float = 10_000.0, dollar_volume: float = 1e4, sessions: int = 252) -> DataFrame:
    """Every instrument with the reasons that reject it; none means it passes."""
    why = listed(price_low=F.col("close") < low, price_high=F.col("close") > high, thin=F.coalesce(F.col("dollar_volume") < dollar_volume, F.lit(True)), short_history=F.col("n_sessions") < sessions)
    return latest.withColumn("rejected_by", why).withColumn("passed", F.size("rejected_by") == 0)


def fundamental_screen(series: DataFrame, growth: float = 0.0, quarters: int = 4) -> DataFrame:
    """Year-on-year growth of the newest quarter against the same quarter a year before."""
    w = Window.partitionBy("instrument_id", "metric").orderBy("period_end")
    last = Window.partitionBy("instrument_id", "metric").orderBy(F.desc("period_end"))
    x = series.withColumn("yoy", F.col("value") / F.lag("value", 4).over(w) - 1).withColumn("_n", F.row_number().over(last)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("instrument_id", "metric")))
    return x.where("_n = 1").select("instrument_id", "metric", "period_end", "yoy", (F.coalesce(F.col("yoy") > growth, F.lit(False)) & (F.col("n") >= quarters)).alias("passed"))


#: Least growth of revenue and earnings, most debt to equity, least return on equity, quarters needed.  Fixed values.
FUNDAMENTAL = {"revenue_growth": 0.10, "earnings_growth": 0.15, "debt_to_equity": 2.0, "return_on_equity": 0.10, "quarters": 4}


def quality_screen(facts: DataFrame) -> DataFrame:
    """Growth, leverage and return of each instrument's newest quarter, with the reasons that reject it.

    facts: instrument_id, metric (revenue, net_income, equity, debt), period_end, value, one row each.  Growth is against the same
    quarter a year before, over the size of that; the return is four quarters' income over the newest equity.  Instruments with
    fewer quarters of revenue than needed aren't eligible, which is no rejection.  A value that is missing rejects nothing, nor
    does a ratio to equity that isn't positive, except that the latter counts as too much debt.
    """
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m)
    q = facts.groupBy("instrument_id", "period_end").agg(*map(pick, ("revenue", "net_income", "equity", "debt")))
    w = Window.partitionBy("instrument_id").orderBy("period_end")
    grown = lambda m: (F.col(m) - F.lag(m, 4).over(w)) / F.nullif(F.abs(F.lag(m, 4).over(w)), F.lit(0))
    year = F.when(F.count("net_income").over(w.rowsBetween(-3, 0)) == 4, F.sum("net_income").over(w.rowsBetween(-3, 0)))
    owned = F.when(F.col("equity") > 0, F.col("equity"))
    x = q.withColumns({"revenue_growth": grown("revenue"), "earnings_growth": grown("net_income"), "debt_to_equity": F.col("debt") / owned, "return_on_equity": year / owned, "quarters": F.count("revenue").over(w)})
    last = x.groupBy("instrument_id").agg(F.max_by(F.struct(*[c for c in x.columns if c != "instrument_id"]), "period_end").alias("x")).select("instrument_id", "x.*")
    f = FUNDAMENTAL
    why = listed(
        revenue_growth=F.coalesce(F.col("revenue_growth") < f["revenue_growth"], F.lit(False)), earnings_growth=F.coalesce(F.col("earnings_growth") < f["earnings_growth"], F.lit(False)),
        leverage=F.coalesce((F.col("debt_to_equity") > f["debt_to_equity"]) | (F.col("equity") <= 0), F.lit(False)), return_on_equity=F.coalesce(F.col("return_on_equity") < f["return_on_equity"], F.lit(False)),
    )
    eligible = F.col("quarters") >= f["quarters"]
    return last.withColumns({"eligible": eligible, "rejected_by": F.when(eligible, why).otherwise(F.array().cast("array<string>"))}).withColumn("passed", eligible & (F.size("rejected_by") == 0))


def technical_screen(features: DataFrame) -> DataFrame:
    ok = (F.col("close") > F.col("sma_50")) & (F.col("sma_50") > F.col("sma_200")) & (F.col("close") >= 1.25 * F.col("low_252")) & (F.col("close") >= 0.75 * F.col("high_252"))
    return features.withColumn("passed", F.coalesce(ok, F.lit(False)))


def opportunities(features: DataFrame, k: int = 5, least: float = 40.0) -> DataFrame:
    """Top k scores of each session."""
    s = weighted({"trend": (scaled(F.col("roc_60"), -0.1, 0.2), 0.5), "volume": (scaled(F.col("relative_volume_20"), 0.5, 2.0), 0.2), "near_high": (scaled(F.col("distance_high_252"), -0.3, 0.0), 0.3)}) * 100
    w = Window.partitionBy("session_date").orderBy(F.desc("score"), "instrument_id")
    return features.withColumn("score", F.round(s, 4)).where(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def performance(equity: DataFrame, per_year: int = 252) -> DataFrame:
    """Growth, drawdown and ratios of each equity series (instrument_id, session_date, close)."""
    w = Window.partitionBy("instrument_id").orderBy("session_date")
    x = equity.withColumn("r", F.col("close") / F.lag("close").over(w) - 1).withColumn("dd", 1 - F.col("close") / F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    a = x.groupBy("instrument_id").agg(
        F.count("r").alias("n"), F.min_by("close", "session_date").alias("first"), F.max_by("close", "session_date").alias("last"), F.max("dd").alias("max_drawdown"), F.avg("r").alias("mean"),
        F.stddev_samp("r").alias("sd"), F.sqrt(F.avg(F.when(F.col("r").isNotNull(), F.pow(F.least(F.col("r"), F.lit(0.0)), 2)))).alias("downside"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"),
        F.sum(F.when(F.col("r") > 0, F.col("r"))).alias("gains"), F.sum(F.when(F.col("r") < 0, -F.col("r"))).alias("losses"),
    )
    cagr = F.pow(F.col("last") / F.col("first"), per_year / F.col("n")) - 1
    return a.select("instrument_id", "n", cagr.alias("cagr"), "max_drawdown", (F.col("mean") / F.col("sd") * math.sqrt(per_year)).alias("sharpe"), (F.col("mean") / F.col("downside") * math.sqrt(per_year)).alias("sortino"), (cagr / F.col("max_drawdown")).alias("calmar"), "win_rate", (F.col("gains") / F.col("losses")).alias("profit_factor"))


def walk_forward(calendar: DataFrame, train: int, test: int, anchored: bool = False) -> DataFrame:
    """Windows over session numbers; the test part starts strictly after the train part."""
    last = calendar.agg(F.max("session_ord").alias("last"))
    w = last.select(F.explode(F.sequence(F.lit(0), F.floor((F.col("last") - train - test) / test))).alias("fold"))
    first = F.lit(1) if anchored else F.col("fold") * test + 1
    return w.select(F.col("fold").cast("int").alias("fold"), first.cast("int").alias("train_first"), (F.col("fold") * test + train).cast("int").alias("train_last"), (F.col("fold") * test + train + 1).cast("int").alias("test_first"), (F.col("fold") * test + train + test).cast("int").alias("test_last"))


def matched_lots(fills: DataFrame) -> DataFrame:
    """Closed trades from fills (instrument_id, fill_id, session_date, side buy or sell, quantity, price), first in, first out.

    The k-th unit bought closes with the k-th unit sold, whichever came first: a long trade if bought first (ties of the date
    count as long), otherwise a short one.  Both sides' running quantities cut the units into pieces, so one sort of a series
    matches its lots; units that the other side doesn't reach stay open and don't come out.  Fills of quantity 0 or null go.
    """
    w = Window.partitionBy("instrument_id", "side").orderBy("session_date", "fill_id")
    ends = fills.where("quantity > 0").withColumn("upto", F.sum("quantity").over(w))
    own = lambda side: F.when(F.col("side") == side, F.struct(F.col("session_date").alias("on"), "price", "fill_id"))
    # a piece ends where a lot of either side ends; the lot that covers it is the next one of that side to end
    # (read from the last piece on: a frame that grows is carried along, one that shrinks is read anew for every row)
    onward = Window.partitionBy("instrument_id").orderBy(F.desc("upto"), F.desc("side")).rowsBetween(Window.unboundedPreceding, 0)
    sides = ends.withColumns({"bought": F.last(own("buy"), ignorenulls=True).over(onward), "sold": F.last(own("sell"), ignorenulls=True).over(onward)})
    n = F.col("upto") - F.coalesce(F.lag("upto").over(Window.partitionBy("instrument_id").orderBy("upto", "side")), F.lit(0))
    pieces = sides.withColumn("n", n).where("n > 0 and bought is not null and sold is not null")
    long = F.col("bought.on") <= F.col("sold.on")
    at = lambda name: (F.when(long, F.col(f"bought.{name}")).otherwise(F.col(f"sold.{name}")), F.when(long, F.col(f"sold.{name}")).otherwise(F.col(f"bought.{name}")))
    opened, closed = at("on"), at("price")
    return pieces.select(
        "instrument_id", F.when(long, "long").otherwise("short").alias("side"), opened[0].alias("opened_on"), opened[1].alias("closed_on"), F.col("n").alias("quantity"),
        closed[0].alias("entry"), closed[1].alias("exit"), (F.col("n") * (F.col("sold.price") - F.col("bought.price"))).alias("profit"), F.col("bought.fill_id").alias("buy_fill"), F.col("sold.fill_id").alias("sell_fill"),
    )


def trade_metrics(trades: DataFrame, fills: DataFrame, equity: DataFrame) -> DataFrame:
    """Closed trades of each series: count, win rate, average win and loss, expectancy, profit factor, sessions held; turnover of its fills against the mean of equity (instrument_id, session_date, close)."""
    win, loss = F.when(F.col("profit") > 0, F.col("profit")), F.when(F.col("profit") < 0, -F.col("profit"))
    t = trades.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("trades"), F.avg((F.col("profit") > 0).cast("double")).alias("win_rate"), F.avg(win).alias("average_win"), F.avg(loss).alias("average_loss"), F.avg("profit").alias("expectancy"),
        (F.sum(win) / F.sum(loss)).alias("profit_factor"), F.avg(F.datediff("closed_on", "opened_on")).alias("days_held"),
    )
    traded = fills.where("quantity > 0").groupBy("instrument_id").agg(F.sum(F.col("quantity") * F.col("price")).alias("traded"))
    capital = equity.groupBy("instrument_id").agg(F.avg("close").alias("capital"))
    return traded.join(capital, "instrument_id").join(t, "instrument_id", "left").select("instrument_id", F.coalesce("trades", F.lit(0)).alias("trades"), "win_rate", "average_win", "average_loss", "expectancy", "profit_factor", "days_held", (F.col("traded") / F.col("capital")).alias("turnover"))
