"""Queries over pivots, structures, tracking, events, audits and screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.functions.scalar import digest, digest_sql
from vantage.operators import breakout as BR
from vantage.operators import features as X
from vantage.operators import folds as FO
from vantage.operators import machine as MA
from vantage.operators import screens as O
from vantage.operators import structure as P
from vantage.operators import tracking as K
from vantage.registry import register
from vantage.sources.fixtures import frame, once, with_tables
from vantage.sources.staging import staged_file

D = digest_sql


def _bars(s, d):
    return frame(s, d, "bars")


_SW = """b as (select *, lead(session_date, 3) over w as confirmed_date, count(*) over l as nl, count(*) over r as nr, max(high) over l as hl, max(high) over r as hr, min(low) over l as ll, min(low) over r as lr from bars
  window w as (partition by instrument_id order by session_date), l as (partition by instrument_id order by session_date rows between 3 preceding and 1 preceding), r as (partition by instrument_id order by session_date rows between 1 following and 3 following)),
sw as (select instrument_id, session_date, confirmed_date, 'high' as kind, high as price from b where nl = 3 and nr = 3 and hl < high and hr <= high
  union all select instrument_id, session_date, confirmed_date, 'low', low from b where nl = 3 and nr = 3 and ll > low and lr >= low)
"""
_ON = "1999-06-30"
register("p01_swings", lambda s, d: P.swings(_bars(s, d)), with_tables("bars", "with " + _SW + "select * from sw"))
register("p02_confirmed", lambda s, d: P.confirmed(P.swings(_bars(s, d)), F.lit(_ON).cast("date")).groupBy("instrument_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("session_date").alias("last_on")),
         with_tables("bars", "with " + _SW + f"select instrument_id, kind, count(*) as n, max(session_date) as last_on from sw where confirmed_date <= date '{_ON}' group by 1, 2"))
register("p03_provisional", lambda s, d: P.provisional(_bars(s, d)), with_tables("bars", "select instrument_id, max(high) as high, min(low) as low from (select *, row_number() over (partition by instrument_id order by session_date desc) as n from bars) x where n <= 3 group by 1"))
register("p04_extreme_pivots", lambda s, d: P.extreme_pivots(P.swings(_bars(s, d))), with_tables("bars", "with " + _SW + """, h as (select *, row_number() over (partition by instrument_id, kind order by case when kind = 'high' then -price else price end, session_date) as n from sw)
select instrument_id, max(session_date) filter (kind = 'high') as highest_on, max(price) filter (kind = 'high') as highest, max(session_date) filter (kind = 'low') as lowest_on, max(price) filter (kind = 'low') as lowest from h where n = 1 group by 1"""))
register("p07_resistance", lambda s, d: P.horizontal_levels(P.swings(_bars(s, d)), recent=24).select("instrument_id", "touches", digest(F.col("level")).alias("level"), "first_touch", "last_touch"),
         with_tables("bars", "with " + _SW + f""", p as (select * from (select *, row_number() over (partition by instrument_id order by session_date desc) as n from sw where kind = 'high') x where n <= 24),
c as (select a.instrument_id, a.session_date as anchor, count(*) as touches, avg(b.price) as level, min(b.session_date) as first_touch, max(b.session_date) as last_touch from p a join p b on a.instrument_id = b.instrument_id and abs(b.price - a.price) <= a.price * 15e-3 group by 1, 2)
select instrument_id, touches, {D('level')} as level, first_touch, last_touch from (select *, row_number() over (partition by instrument_id order by touches desc, level desc, anchor desc) as k from c) y where k = 1"""))
register("p10_support", lambda s, d: P.horizontal_levels(P.swings(_bars(s, d)), "low", recent=24).select("instrument_id", "touches", digest(F.col("level")).alias("level")),
         with_tables("bars", "with " + _SW + f""", p as (select * from (select *, row_number() over (partition by instrument_id order by session_date desc) as n from sw where kind = 'low') x where n <= 24),
c as (select a.instrument_id, a.session_date as anchor, count(*) as touches, avg(b.price) as level from p a join p b on a.instrument_id = b.instrument_id and abs(b.price - a.price) <= a.price * 15e-3 group by 1, 2)
select instrument_id, touches, {D('level')} as level from (select *, row_number() over (partition by instrument_id order by touches desc, level, anchor desc) as k from c) y where k = 1"""))
_CLUSTERS = """, c as (select a.instrument_id, a.session_date as anchor, count(*) as touches, avg(b.price) as level, min(b.session_date) as first_touch, max(b.session_date) as last_touch
  from sw a join sw b on a.instrument_id = b.instrument_id and a.kind = b.kind and abs(b.price - a.price) <= a.price * 15e-3 where a.kind = '{kind}' group by 1, 2)
select instrument_id, touches, {level} as level, first_touch, last_touch from (select *, row_number() over (partition by instrument_id order by touches desc, level {order}, anchor desc) as k from c) y where k = 1"""
for _name, _kind, _order in (("p07_resistance_all_pivots", "high", "desc"), ("p10_support_all_pivots", "low", "asc")):
    register(_name, lambda s, d, kind=_kind: P.horizontal_levels(P.swings(_bars(s, d)), kind).select("instrument_id", "touches", digest(F.col("level")).alias("level"), "first_touch", "last_touch"),
             with_tables("bars", "with " + _SW + _CLUSTERS.format(kind=_kind, level=D("level"), order=_order)))
register("p12_consolidation", lambda s, d: P.consolidation(_bars(s, d)).select("instrument_id", *(digest(F.col(c), 5).alias(c) for c in ("depth", "slope", "mean_range", "range_contraction", "volume_contraction", "dispersion"))),
         with_tables("bars", f"""with x as (select * from (select *, row_number() over (partition by instrument_id order by session_date desc) as k from bars) y where k <= 40)
select instrument_id, {D('1 - min(low) / max(high)', 5)} as depth, {D('-regr_slope(close, k) / avg(close)', 5)} as slope, {D('avg((high - low) / close)', 5)} as mean_range, {D('avg(high - low) filter (k <= 20) / avg(high - low) filter (k > 20)', 5)} as range_contraction,
{D('avg(volume) filter (k <= 20) / avg(volume) filter (k > 20)', 5)} as volume_contraction, {D('stddev_pop(close) / avg(close)', 5)} as dispersion from x group by 1"""))
register("p15_contractions", lambda s, d: P.contractions(P.swings(_bars(s, d))).select("instrument_id", "high_on", "low_on", digest(F.col("depth"), 6).alias("depth")),
         with_tables("bars", "with " + _SW + f""", n as (select *, min(case when kind = 'low' then session_date end) over (partition by instrument_id order by session_date, kind rows between 1 following and unbounded following) as low_on from sw)
select n.instrument_id, n.session_date as high_on, n.low_on, {D('1 - l.price / n.price', 6)} as depth from n join sw l on l.instrument_id = n.instrument_id and l.session_date = n.low_on and l.kind = 'low' where n.kind = 'high'"""))
register("p19_prior_trend", lambda s, d: P.prior_trend(_bars(s, d)).select("instrument_id", "session_date", digest(F.col("slope"), 5).alias("slope"), digest(F.col("fit"), 3).alias("fit")),
         with_tables("bars", f"""with n as (select *, row_number() over (partition by instrument_id order by session_date)::double as x from bars)
select instrument_id, session_date, {D('case when x >= 60 then regr_slope(close, x) over w / avg(close) over w end', 5)} as slope, {D('case when x >= 60 then regr_r2(close, x) over w end', 3)} as fit from n window w as (partition by instrument_id order by session_date rows 59 preceding)"""))


def _observed(s, d, rows):
    return frame(s, d, "observations").where(rows).groupBy("instrument_id", "key").agg(F.min("session_date").alias("start_date"), F.max("session_date").alias("end_date"))


register("d13_scan", lambda s, d: P.with_state(P.detect(_bars(s, d))))
register("d13_skips", lambda s, d: P.skipped(_bars(s, d)), with_tables("bars", "with n as (select instrument_id, count(*) as n from bars group by 1), w as (select * from (values " + ", ".join(f"('{f}', {k + 1})" for f, k in P.WARM.items()) + ") v(family, need)) select instrument_id, family, need - n as missing from n cross join w where n < need"))
register("d14_latest", lambda s, d: P.detect_latest(_bars(s, d)))


def _weekly_bars(s, d):
    from vantage.operators.bars import aggregate_daily, completed_only

    weeks = completed_only(aggregate_daily(_bars(s, d), frame(s, d, "calendar"), "1w", F.lit("2001-12-31").cast("date")))
    return weeks.select("instrument_id", F.col("period_end").alias("session_date"), "open", "high", "low", "close", "volume")


def _d15(s, d):
    span = lambda b: staged_file(FO.spans(b))
    return P.across_timeframes(span(_bars(s, d)), span(_weekly_bars(s, d)))


register("d15_timeframes", _d15)
register("d15_timeframe_edges", lambda s, d: P.across_timeframes(_observed(s, d, "seq % 2 = 0"), _observed(s, d, "seq % 2 = 1")),
         with_tables("observations", """with a as (select instrument_id, key, min(session_date) as s, max(session_date) as e from observations where seq % 2 = 1 group by 1, 2), b as (select instrument_id, key, min(session_date) as s, max(session_date) as e from observations where seq % 2 = 0 group by 1, 2)
select a.key as from_key, b.key as to_key, 'CONTAINS' as kind from a join b on a.instrument_id = b.instrument_id and a.s <= b.e and b.s <= a.e where greatest((least(a.e, b.e) - greatest(a.s, b.s) + 1) / (a.e - a.s + 1)::double, (least(a.e, b.e) - greatest(a.s, b.s) + 1) / (b.e - b.s + 1)::double) >= 25e-2"""))
register("d13_family_counts", lambda s, d: P.family_counts(FO.spans(_bars(s, d)), F.sum("n")))
register("p24_violations", lambda s, d: P.violations(P.detect(_bars(s, d))).select("instrument_id", "session_date", "family"))
_EARLY = "1995-04-14"
register("d13_skips_on_a_date", lambda s, d: P.skipped(_bars(s, d).where(F.col("session_date") <= F.lit(_EARLY).cast("date"))),
         with_tables("bars", f"with n as (select instrument_id, count(*) as n from bars where session_date <= date '{_EARLY}' group by 1), w as (select * from (values " + ", ".join(f"('{f}', {k + 1})" for f, k in P.WARM.items()) + ") v(family, need)) select instrument_id, family, need - n as missing from n cross join w where n < need"))


def _faulty(s, d):
    """Observed structures with planted faults: an invalidation above the level, a start on the session itself, a level of 0 and one that is no number."""
    seq, level = F.col("seq"), F.col("quality") + 50
    found = frame(s, d, "observations").select("instrument_id", "session_date", "family", "seq", "quality", F.when(seq % 13 == 0, 0.0).when(seq % 17 == 0, float("nan")).otherwise(level).alias("level"), F.date_sub("session_date", (seq % 20).cast("int")).alias("start_date"))
    return found.withColumn("invalidation", F.when(seq % 11 == 0, level + 1).when(seq % 13 == 0, -1.0).otherwise(level - 10))


register("p24_planted", lambda s, d: P.violations(_faulty(s, d)).select("seq"),
         with_tables("observations", "select seq from observations where seq % 13 = 0 or seq % 17 = 0 or seq % 11 = 0 or seq % 20 = 0"))


def _end(s, d):
    """The last session of the market: series that fell silent before it are over."""
    return F.lit(frame(s, d, "bars").agg(F.max("session_date")).first()[0])


def _tracked(s, d):
    return FO.track(_bars(s, d), _end(s, d))


register("k02_tracked", _tracked)
register("k05_tracked", lambda s, d: FO.related(_bars(s, d)))
register("k09_tracked", lambda s, d: FO.coexisting(_bars(s, d)))
register("k11_believed_tracked", lambda s, d: K.believed(_tracked(s, d), F.lit(_ON).cast("date")))
register("v11_concentration", lambda s, d: K.concentration(FO.spans(_bars(s, d)), F.sum("n")))
register("v12_churn_tracked", lambda s, d: K.churn_of(FO.spans(_bars(s, d))))


def _followed(bars):
    return bars.withColumn("average_volume", F.coalesce(F.avg("volume").over(X.prior(20)), F.lit(0.0))).select("instrument_id", "session_date", "open", "high", "low", "close", "volume", "average_volume")


def _with_context(s, d):
    """Bars with what was known at each session: the series' own strength, the market's regime and its sector's score, each 0 to 100; null where it can't be told.

    Bars are derived once and shuffled once more, by instrument; what the market and its sectors have is a few rows a session and goes to every task.
    """
    from vantage.plans.q_cross import _regime, _sector_of, _sectors

    g = once(s, d, "bars", "benchmarks", "calendar")
    bench = frame(s, d, "benchmarks", g).where("benchmark_id = 101").select("session_date", digest(F.col("close"), 5).alias("bench"))
    bars = BR.strength_at(_followed(frame(s, d, "bars", g)).join(F.broadcast(bench), "session_date")).withColumnRenamed("rs_score", "relative_strength")
    sectors = staged_file(_sectors(s, d, g).select("session_date", "sector", "above_50", F.col("score").alias("sector_context")))
    regimes = F.create_map(*(F.lit(x) for pair in BR.REGIME_SCORES.items() for x in pair))
    market = staged_file(_regime(s, d, g, sectors).select("session_date", F.try_element_at(regimes, F.col("regime")).alias("market_context")))
    return _sector_of(s, d, bars, g).join(F.broadcast(market), "session_date", "left").join(F.broadcast(sectors.drop("above_50")), ["session_date", "sector"], "left")


def _events(s, d):
    """Histories of all attempts."""
    return FO.histories(_with_context(s, d))


register("b17_events", lambda s, d: MA.with_event_key(_events(s, d)))
register("b18_active", lambda s, d: MA.active(_events(s, d)))
register("b19_defeated", lambda s, d: MA.defeated(_events(s, d)))
register("b26_event_states", lambda s, d: _events(s, d).groupBy("to_state").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("instrument_id", "key", "attempt").alias("attempts")))


def _recent_high(s, d):
    """Levels for which SQL knows the answer to every step before a close above: the highest high of each series' first 60 sessions."""
    x = _bars(s, d).withColumns({"n": F.row_number().over(X.series()), "tr": X.true_range()})
    return x.where("n <= 60").groupBy("instrument_id").agg(F.max("high").alias("level"), F.max("session_date").alias("frozen_on"), F.avg("tr").alias("atr")).withColumns({"key": F.lit("first"), "confidence": F.lit(50.0), "touches": F.lit(2)}).withColumn("tolerance", BR.zone(F.col("level"), F.col("atr"), F.col("confidence"))).withColumn("seen", F.sequence("frozen_on", F.date_add("frozen_on", 4000)))


def _first_attempts(s, d):
    h = MA.histories(_followed(_bars(s, d)), _recent_high(s, d)).where("attempt = 1")
    early = ("not_approaching", "approaching", "testing_resistance", "intraday_break", "closed_above", "rejected")
    return h.where(F.col("to_state").isin(*early)).select("instrument_id", "session_date", "to_state")


register("b30_first_attempts", _first_attempts, with_tables("bars", """with n as (select *, row_number() over w as n, case when lag(close) over w is not null then greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) end as tr from bars window w as (partition by instrument_id order by session_date)),
l as (select instrument_id, max(high) as level, max(session_date) as frozen_on, avg(tr) as atr from n where n <= 60 group by 1), z as (select *, least(2e-2, greatest(15e-4, 1e-1 * atr / level) * 13e-1) as tolerance from l),
p as (select b.*, level, atr, tolerance, level * (1 + tolerance) as top, row_number() over (partition by b.instrument_id order by b.session_date) as age from bars b join z using (instrument_id) where b.session_date > frozen_on),
s as (select *, case when close > top then 'closed_above' when high > top and close < level and ((high - greatest(open, close)) / nullif(high - low, 0) >= 5e-1 or (close - low) / nullif(high - low, 0) <= 35e-2) then 'rejected' when age - 1 > 40 then 'expired' when high > top then 'intraday_break'
  when high between level * (1 - tolerance) and top or abs((level - close) / atr) <= 4e-1 then 'testing_resistance' when (level - close) / atr <= 25e-1 and (level - close) / level <= 12e-2 then 'approaching' else 'not_approaching' end as st from p),
e as (select *, min(case when st in ('closed_above', 'rejected', 'expired') then age end) over (partition by instrument_id) as ends, lag(st) over (partition by instrument_id order by age) as was from s)
select instrument_id, session_date, st as to_state from e where age <= coalesce(ends, 1000000) and st <> 'expired' and (was is null or was <> st)"""))


def _latest(s, d):
    from vantage.operators.asof import newest

    f = X.window_features(_bars(s, d)).withColumn("n_sessions", F.row_number().over(X.series())).select("instrument_id", "session_date", "close", "n_sessions", F.col("dollar_volume_20").alias("dollar_volume"))
    return newest(f, ["instrument_id"], "session_date")


register("o01_liquidity_screen", lambda s, d: O.liquidity_screen(_latest(s, d), low=100.0, dollar_volume=2500.0).select("instrument_id", F.array_join("rejected_by", ",").alias("rejected_by"), "passed"),
         with_tables("bars", """with l as (select instrument_id, count(*) as n, arg_max(close, session_date) as close from bars group by 1), v as (select instrument_id, avg((high + low + close) / 3 * volume) as dv from (select *, row_number() over (partition by instrument_id order by session_date desc) as k from bars) x where k <= 20 group by 1),
r as (select instrument_id, concat_ws(',', case when close < 100 then 'price_low' end, case when close > 10000 then 'price_high' end, case when dv < 2500 then 'thin' end, case when n < 252 then 'short_history' end) as rejected_by from l join v using (instrument_id))
select *, rejected_by = '' as passed from r"""))
register("o02_fundamental_screen", lambda s, d: O.fundamental_screen(frame(s, d, "fundamentals").where("not is_restatement")).select("instrument_id", "metric", "period_end", digest(F.col("yoy"), 6).alias("yoy"), "passed"),
         with_tables("fundamentals", f"""with f as (select *, value / lag(value, 4) over w - 1 as yoy, row_number() over (partition by instrument_id, metric order by period_end desc) as k, count(*) over (partition by instrument_id, metric) as n from fundamentals where not is_restatement window w as (partition by instrument_id, metric order by period_end))
select instrument_id, metric, period_end, {D('yoy', 6)} as yoy, coalesce(yoy > 0, false) and n >= 4 as passed from f where k = 1"""))
register("o02_quality_screen", lambda s, d: O.quality_screen(frame(s, d, "statements")).select("instrument_id", "period_end", *(digest(F.col(c), 5).alias(c) for c in ("revenue_growth", "earnings_growth", "debt_to_equity", "return_on_equity")), "eligible", F.array_join("rejected_by", ",").alias("rejected_by"), "passed"),
         with_tables("statements", f"""with q as (select instrument_id, period_end, max(value) filter (metric = 'revenue') as r, max(value) filter (metric = 'net_income') as i, max(value) filter (metric = 'equity') as e, max(value) filter (metric = 'debt') as b from statements group by 1, 2),
x as (select *, (r - lag(r, 4) over w) / nullif(abs(lag(r, 4) over w), 0) as rg, (i - lag(i, 4) over w) / nullif(abs(lag(i, 4) over w), 0) as ig, case when e > 0 then b / e end as de, case when count(i) over y = 4 and e > 0 then sum(i) over y / e end as roe, count(r) over w as n, row_number() over (partition by instrument_id order by period_end desc) as k
  from q window w as (partition by instrument_id order by period_end), y as (partition by instrument_id order by period_end rows 3 preceding)),
z as (select *, case when n >= 4 then concat_ws(',', case when rg < 1e-1 then 'revenue_growth' end, case when ig < 15e-2 then 'earnings_growth' end, case when de > 2 or e <= 0 then 'leverage' end, case when roe < 1e-1 then 'return_on_equity' end) else '' end as rejected_by from x where k = 1)
select instrument_id, period_end, {D('rg', 5)} as revenue_growth, {D('ig', 5)} as earnings_growth, {D('de', 5)} as debt_to_equity, {D('roe', 5)} as return_on_equity, n >= 4 as eligible, rejected_by, n >= 4 and rejected_by = '' as passed from z"""))
register("b02_boundaries", lambda s, d: BR.frozen_boundaries(frame(s, d, "levels")).select("seq", digest(F.col("tolerance"), 7).alias("tolerance"), "pattern_quality", "attached", "eligible", "refused"),
         with_tables("levels", f"""with r as (select *, key <> '' as attached, case when side <> 'resistance' then 'not_resistance' when level <= 0 then 'no_level' end as refused from levels)
select seq, {D('case when refused is null then least(2e-2, greatest(15e-4, coalesce(1e-1 * atr / nullif(level, 0), 0)) * (16e-1 - 6e-1 * confidence / 100)) end', 7)} as tolerance, case when attached then quality else 40 end as pattern_quality, attached, attached and refused is null and kind = 'structural' as eligible, refused from r"""))
register("o05_performance", lambda s, d: O.performance(_bars(s, d)).select("instrument_id", "n", *(digest(F.col(c)).alias(c) for c in ("cagr", "max_drawdown", "sharpe", "sortino", "win_rate", "profit_factor")), digest(F.col("calmar"), 3).alias("calmar")),
         with_tables("bars", f"""with r as (select *, close / lag(close) over w - 1 as r, 1 - close / max(close) over w as dd from bars window w as (partition by instrument_id order by session_date))
select instrument_id, count(r) as n, {D('power(arg_max(close, session_date) / arg_min(close, session_date), 252.0::double / count(r)) - 1')} as cagr, {D('max(dd)')} as max_drawdown, {D('avg(r) / stddev_samp(r) * sqrt(252)')} as sharpe, {D('avg(r) / sqrt(avg(power(least(r, 0), 2)) filter (r is not null)) * sqrt(252)')} as sortino,
{D('avg(case when r > 0 then 1.0::double when r is not null then 0 end)')} as win_rate, {D('sum(r) filter (r > 0) / -sum(r) filter (r < 0)')} as profit_factor,
{D('(power(arg_max(close, session_date) / arg_min(close, session_date), 252.0::double / count(r)) - 1) / max(dd)', 3)} as calmar from r group by 1"""))


def _lots(s, d):
    return O.matched_lots(frame(s, d, "fills"))


_LOTS = """c as (select *, sum(quantity) over (partition by instrument_id, side order by session_date, fill_id) as upto from fills where quantity > 0), r as (select *, upto - quantity as frm from c),
t as (select b.instrument_id, case when b.session_date <= s.session_date then 'long' else 'short' end as side, least(b.session_date, s.session_date) as opened_on, greatest(b.session_date, s.session_date) as closed_on, (least(b.upto, s.upto) - greatest(b.frm, s.frm))::bigint as quantity,
  case when b.session_date <= s.session_date then b.price else s.price end as entry, case when b.session_date <= s.session_date then s.price else b.price end as exit, b.price as bp, s.price as sp, b.fill_id as buy_fill, s.fill_id as sell_fill
  from r b join r s on b.instrument_id = s.instrument_id and b.side = 'buy' and s.side = 'sell' and b.frm < s.upto and s.frm < b.upto)
"""
register("o05_closed_trades", lambda s, d: _lots(s, d).select("instrument_id", "side", "opened_on", "closed_on", "quantity", "entry", "exit", "buy_fill", "sell_fill"),
         with_tables("fills", "with " + _LOTS + "select instrument_id, side, opened_on, closed_on, quantity, entry, exit, buy_fill, sell_fill from t"))
register("o05_trade_metrics", lambda s, d: O.trade_metrics(_lots(s, d), frame(s, d, "fills"), _bars(s, d)).select("instrument_id", "trades", *(digest(F.col(c), n).alias(c) for c, n in (("win_rate", 5), ("average_win", 1), ("average_loss", 1), ("expectancy", 1), ("profit_factor", 4), ("days_held", 3), ("turnover", 1)))),
         with_tables("fills bars", "with " + _LOTS + f""", q as (select *, quantity * (sp - bp) as profit from t), m as (select instrument_id, count(*) as trades, avg((profit > 0)::int) as win_rate, avg(profit) filter (profit > 0) as average_win, avg(-profit) filter (profit < 0) as average_loss, avg(profit) as expectancy,
  sum(profit) filter (profit > 0) / sum(-profit) filter (profit < 0) as profit_factor, avg(closed_on - opened_on) as days_held from q group by 1), v as (select instrument_id, sum(quantity * price) as traded from fills where quantity > 0 group by 1), k as (select instrument_id, avg(close) as capital from bars group by 1)
select v.instrument_id, coalesce(trades, 0) as trades, {D('win_rate', 5)} as win_rate, {D('average_win', 1)} as average_win, {D('average_loss', 1)} as average_loss, {D('expectancy', 1)} as expectancy, {D('profit_factor', 4)} as profit_factor, {D('days_held', 3)} as days_held, {D('traded / capital', 1)} as turnover
from v join k using (instrument_id) left join m using (instrument_id)"""))
register("o06_walk_forward", lambda s, d: O.walk_forward(frame(s, d, "calendar"), 500, 100),
         with_tables("calendar", "select f::int as fold, (f * 100 + 1)::int as train_first, (f * 100 + 500)::int as train_last, (f * 100 + 501)::int as test_first, (f * 100 + 600)::int as test_last from (select unnest(range(0, (select (max(session_ord) - 600) // 100 + 1 from calendar))) as f) x"))


def _v02(s, d):
    """Window features, and one planted feature that looks a session ahead, over all bars and over those up to a cut."""
    cut = F.lit("1998-12-31").cast("date")
    names = ["sma_20", "roc_20", "volatility_20", "relative_volume_20", "peek"]
    computed = lambda b: X.long_form(X.window_features(b).withColumn("peek", F.lead("close").over(X.series())), names)
    whole = computed(_bars(s, d)).where(F.col("session_date") <= cut)
    prefix = computed(_bars(s, d).where(F.col("session_date") <= cut)).withColumnRenamed("value", "v")
    j = whole.join(prefix, ["instrument_id", "session_date", "feature"], "full_outer")
    return j.where(~(F.abs(F.col("value") - F.col("v")) <= 1e-9 * F.abs("v")) | (F.col("value").isNull() != F.col("v").isNull())).select("instrument_id", "session_date", "feature")


register("v02_look_ahead", _v02, with_tables("bars", "select instrument_id, max(session_date) as session_date, 'peek' as feature from bars where session_date <= date '1998-12-31' and instrument_id in (select instrument_id from bars where session_date > date '1998-12-31') group by 1"))
