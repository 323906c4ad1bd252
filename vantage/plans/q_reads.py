"""Queries over the point-in-time reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.functions.scalar import fixed
from vantage.operators import asof
from vantage.registry import register
from vantage.sources.fixtures import frame, with_tables

AS_OF = "1997-06-30 22:00:00"
DAY = "1997-06-30"


def _clock():
    return F.lit(AS_OF).cast("timestamp")

_HIST = f"""with v as (select * from bar_facts where knowledge_time <= timestamp '{AS_OF}'),
h as (select * from (select *, row_number() over (partition by instrument_id, session_date order by knowledge_time desc) as rn from v) x where rn = 1 and quality <> 'suspect')
"""


def _r01(spark, d):
    return asof.history(frame(spark, d, "bar_facts"), _clock(), limit=250).select("instrument_id", "session_date", "close", "volume")


register("r01_history", _r01, with_tables("bar_facts", _HIST + "select instrument_id, session_date, close, volume from (select *, row_number() over (partition by instrument_id order by session_date desc) as k from h) y where k <= 250"))


register("r01_history_whole", lambda spark, d: asof.history(frame(spark, d, "bar_facts"), _clock(), limit=None).select("instrument_id", "session_date", "close", "volume"),
         with_tables("bar_facts", _HIST + "select instrument_id, session_date, close, volume from h"))


def _r02(spark, d):
    return asof.latest(frame(spark, d, "bar_facts"), _clock()).select("instrument_id", "session_date", "close")


register("r02_latest", _r02, with_tables("bar_facts", _HIST + "select instrument_id, max(session_date) as session_date, arg_max(close, session_date) as close from h group by instrument_id"))


def _r03(spark, d):
    seen = asof.visible(frame(spark, d, "splits"), F.lit("1999-12-31").cast("timestamp"))
    out = asof.split_adjusted(frame(spark, d, "bars"), seen)
    return out.select("instrument_id", "session_date", fixed(F.col("close")).alias("close"), fixed(F.col("volume")).alias("volume"))


register("r03_split_adjusted", _r03, with_tables("bars splits", """
with f as (select b.instrument_id, b.session_date, b.close, b.volume,
  coalesce((select product(s.ratio) from splits s where s.instrument_id = b.instrument_id and s.ex_date > b.session_date and s.knowledge_time <= timestamp '1999-12-31'), 1.0) as k from bars b)
select instrument_id, session_date, floor(close / k * 1e6 + 0.5::double) / 1e6 as close, floor(volume * k * 1e6 + 0.5::double) / 1e6 as volume from f"""))


def _r03b(spark, d):
    out = asof.total_return_adjusted(frame(spark, d, "bars"), frame(spark, d, "dividends"))
    return out.select("instrument_id", "session_date", fixed(F.col("close")).alias("close"))


register("r03_total_return", _r03b, with_tables("bars dividends", """
with r as (select instrument_id, ex_date, (close - cash_amount) / close as ratio from (
  select v.instrument_id, v.ex_date, v.cash_amount, (select arg_max(b.close, b.session_date) from bars b where b.instrument_id = v.instrument_id and b.session_date < v.ex_date) as close from dividends v) x where close > 0)
select b.instrument_id, b.session_date, floor(b.close * coalesce((select product(r.ratio) from r where r.instrument_id = b.instrument_id and r.ex_date > b.session_date), 1.0) * 1e6 + 0.5::double) / 1e6 as close from bars b"""))


def _r04(spark, d):
    return asof.newest(asof.visible(frame(spark, d, "splits"), F.lit("1998-12-31").cast("timestamp")), ["instrument_id", "ex_date"], "knowledge_time")


register("r04_actions", _r04, with_tables("splits", "select instrument_id, ex_date, ratio, knowledge_time from splits where knowledge_time <= timestamp '1998-12-31'"))


def _r05(spark, d):
    asked = frame(spark, d, "first_sessions").select(F.explode(F.array(F.concat(F.lit("t"), "instrument_id"), F.concat(F.lit("n"), "instrument_id"))).alias("ticker"), F.lit(DAY).cast("date").alias("on"))
    return asof.resolve_tickers(asked, frame(spark, d, "mappings"))


register("r05_resolve_ticker", _r05, with_tables("mappings", f"""
with a as (select upper(p || instrument_id) as ticker, date '{DAY}' as "on" from first_sessions, (values ('t'), ('n')) v(p))
select a.ticker, a."on", m.instrument_id, m.instrument_id is not null as resolved
from a left join mappings m on upper(m.ticker) = a.ticker and m.valid_from <= a."on" and (m.valid_to is null or m.valid_to > a."on")"""))


def _r06(spark, d):
    asked = frame(spark, d, "first_sessions").select("instrument_id", F.lit(DAY).cast("date").alias("on"))
    return asof.interval_at(asked, frame(spark, d, "mappings"), "on", ["instrument_id"]).select("instrument_id", "ticker")


register("r06_ticker_for", _r06, with_tables("mappings", f"select instrument_id, ticker from mappings where valid_from <= date '{DAY}' and (valid_to is null or valid_to > date '{DAY}')"))


def _r07(spark, d):
    days = frame(spark, d, "calendar").where("session_ord % 20 = 0").select("session_date")
    return asof.sessions_within(frame(spark, d, "universe"), days).select("session_date", "universe", "instrument_id")


register("r07_universe", _r07, with_tables("calendar universe", """
select session_date, universe, instrument_id from calendar join universe on valid_from <= session_date and (valid_to is null or valid_to > session_date) where session_ord % 20 = 0"""))


def _r07_all(spark, d):
    return asof.sessions_within(frame(spark, d, "universe"), frame(spark, d, "calendar").select("session_date")).select("session_date", "universe", "instrument_id")


register("r07_universe_all_sessions", _r07_all, with_tables("calendar universe", """
select session_date, universe, instrument_id from calendar join universe on valid_from <= session_date and (valid_to is null or valid_to > session_date)"""))


def _r08(spark, d):
    asked = frame(spark, d, "first_sessions").select("instrument_id", F.explode(F.array(*(F.lit(x).cast("date") for x in ("1997-06-30", "1998-06-30")))).alias("on"))
    return asof.interval_at(asked, frame(spark, d, "sectors"), "on", ["instrument_id"], "left").select("instrument_id", "on", "sector", "industry")


register("r08_classification", _r08, with_tables("sectors", """
select f.instrument_id, d as "on", s.sector, s.industry from first_sessions f cross join (values (date '1997-06-30'), (date '1998-06-30')) v(d)
left join sectors s on s.instrument_id = f.instrument_id and s.valid_from <= d and (s.valid_to is null or s.valid_to > d)"""))


def _r09(spark, d):
    on = F.lit(DAY).cast("date")
    s = asof.members(frame(spark, d, "sectors"), on)
    return s.join(asof.members(frame(spark, d, "universe"), on).select("instrument_id"), "instrument_id", "left_semi").select("sector", "instrument_id")


register("r09_sector_members", _r09, with_tables("sectors universe", f"""
select sector, instrument_id from sectors s where valid_from <= date '{DAY}' and (valid_to is null or valid_to > date '{DAY}')
and exists (select 1 from universe u where u.instrument_id = s.instrument_id and u.valid_from <= date '{DAY}' and (u.valid_to is null or u.valid_to > date '{DAY}'))"""))


def _r10(spark, d):
    v = asof.visible(frame(spark, d, "fundamentals"), _clock())
    return asof.newest(v, ["instrument_id", "metric"], F.struct("knowledge_time", "period_end")).select("instrument_id", "metric", "period_end", "value")


register("r10_latest_metric", _r10, with_tables("fundamentals", f"""
select instrument_id, metric, period_end, value from (select *, row_number() over (partition by instrument_id, metric order by knowledge_time desc, period_end desc) as k
from fundamentals where knowledge_time <= timestamp '{AS_OF}') x where k = 1"""))


def _r11(spark, d):
    return asof.series_of_metric(frame(spark, d, "fundamentals"), _clock()).select("instrument_id", "metric", "fiscal_year", "fiscal_period", "period_end", "value", "is_restatement")


register("r11_metric_series", _r11, with_tables("fundamentals", f"""
with k as (select * from (select *, row_number() over (partition by instrument_id, metric, fiscal_year, fiscal_period order by knowledge_time desc) as a from fundamentals where knowledge_time <= timestamp '{AS_OF}') x where a = 1)
select instrument_id, metric, fiscal_year, fiscal_period, period_end, value, is_restatement from (select *, row_number() over (partition by instrument_id, metric order by period_end desc) as n from k) y where n <= 8"""))


def _r12(spark, d):
    return asof.next_scheduled(frame(spark, d, "earnings"), F.lit("1997-07-15").cast("timestamp")).select("instrument_id", "fiscal_year", "fiscal_period", "scheduled_date")


register("r12_next_earnings", _r12, with_tables("earnings", f"""
select instrument_id, fiscal_year, fiscal_period, scheduled_date from (select *, row_number() over (partition by instrument_id order by scheduled_date, knowledge_time desc) as k
from earnings where knowledge_time <= timestamp '1997-07-15' and scheduled_date between date '1997-07-15' and date '1997-07-15' + 45) x where k = 1"""))


def _r15(spark, d):
    return asof.causal_knowledge(frame(spark, d, "bar_facts")).select("instrument_id", "session_date", F.unix_timestamp("evaluated_at").alias("evaluated_at"), "n_known")


register("r15_causal_feed", _r15, with_tables("bar_facts", """
with f as (select instrument_id, session_date, min(greatest(knowledge_time, event_time)) as e from bar_facts group by 1, 2)
select b.instrument_id, b.session_date, cast(epoch(f.e) as bigint) as evaluated_at, count(*) filter (b.knowledge_time <= f.e) as n_known
from bar_facts b join f using (instrument_id, session_date) group by b.instrument_id, b.session_date, f.e"""))


def _r16(spark, d):
    return asof.prefix_mode(frame(spark, d, "bar_facts"))


register("r16_prefix_mode", _r16, with_tables("bar_facts", """
with f as (select instrument_id, session_date, count(*) as n, min(knowledge_time) as k, max(event_time) as e from bar_facts group by 1, 2),
g as (select *, coalesce(k < greatest(lag(k) over w, lag(e) over w), false) as early from f window w as (partition by instrument_id order by session_date))
select instrument_id, count(*) filter (n > 1) as revised, count(*) filter (early) as early,
case when count(*) filter (n > 1) = 0 and count(*) filter (early) = 0 then 'verified_prefix' else 'per_session_read' end as mode from g group by instrument_id"""))


def _r17(spark, d):
    return frame(spark, d, "bar_facts").select("instrument_id", "session_date").distinct()


register("r17_sessions", _r17, with_tables("bar_facts", "select distinct instrument_id, session_date from bar_facts"))


def _r18(spark, d):
    out = asof.episodes(frame(spark, d, "gappy_bars"))
    return out.groupBy("instrument_id", "episode_id").agg(F.min("session_date").alias("first_date"), F.max("session_date").alias("last_date"), F.count(F.lit(1)).alias("n_sessions"))


register("r18_episodes", _r18, with_tables("gappy_bars", """
with g as (select *, session_ord - lag(session_ord) over (partition by instrument_id order by session_ord) - 1 as gap from gappy_bars),
e as (select *, sum(case when gap >= 21 then 1 else 0 end) over (partition by instrument_id order by session_ord rows unbounded preceding)::bigint as episode_id from g)
select instrument_id, episode_id, min(session_date) as first_date, max(session_date) as last_date, count(*) as n_sessions from e group by 1, 2"""))


def _r19(spark, d):
    calendar = frame(spark, d, "calendar")
    df = asof.shifted(frame(spark, d, "first_sessions"), calendar, 5, "first_date")
    return asof.sessions_between(df, calendar, "first_date", "last_date").select("instrument_id", "first_date", F.col("shifted").alias("fifth_after"), "n_sessions")


register("r19_session_arithmetic", _r19, with_tables("first_sessions calendar", """
select f.instrument_id, f.first_date, s.session_date as fifth_after, b.session_ord - a.session_ord + 1 as n_sessions
from first_sessions f join calendar a on a.session_date = f.first_date join calendar b on b.session_date = f.last_date left join calendar s on s.session_ord = a.session_ord + 5"""))


def _flagship(spark, d):
    """Top decile of 60-session strength against the whole market, among the roster that existed on the day."""
    return top_decile(spark, d, k=60)


def share_at_or_below(x, value: str, name: str, width: float = 1e-3):
    """Adds the share of all rows whose value is at most the row's: counts of value bins in order, and ranks inside each bin.

    Only the bins, a row for each ``width`` of the value's range, meet in one ordered window.
    """
    from pyspark.sql import Window

    binned = x.withColumn("_bin", F.floor(F.col(value) / width))
    counts = binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("_c"))
    order = Window.orderBy("_bin")
    upto = counts.select("_bin", (F.sum("_c").over(order) - F.col("_c")).alias("_before"), F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"), "_c")
    inside = F.cume_dist().over(Window.partitionBy("_bin").orderBy(value)) * F.col("_c")
    return binned.join(upto, "_bin").withColumn(name, (F.col("_before") + F.round(inside)) / F.col("_all")).drop("_bin", "_before", "_all", "_c")


def top_decile(spark, d, k: int):
    from pyspark.sql import Window

    bars = asof.history(frame(spark, d, "bar_facts"), _clock())
    bench = frame(spark, d, "benchmarks").where("benchmark_id = 101").select("session_date", F.col("close").alias("b"))
    both = bars.join(bench, "session_date")
    w = Window.partitionBy("instrument_id").orderBy("session_date")
    rel = (F.col("close") / F.lag("close", k).over(w)) / (F.col("b") / F.lag("b", k).over(w)) - 1
    last = asof.newest(both.withColumn("strength", rel).select("instrument_id", "session_date", "strength"), ["instrument_id"], "session_date")
    roster = asof.members(frame(spark, d, "universe"), F.lit(DAY).cast("date")).select("instrument_id")
    ranked = roster.join(last, "instrument_id", "left").where("strength is not null")
    ranked = share_at_or_below(ranked, "strength", "pct")
    return ranked.where("pct > 0.9").select("instrument_id", "session_date", fixed(F.col("strength")).alias("strength"), fixed(F.col("pct")).alias("pct"))


register("flagship_top_decile", _flagship, with_tables("bar_facts benchmarks universe", _HIST + f""",
j as (select h.instrument_id, h.session_date, h.close, b.close as b from h join benchmarks b on b.session_date = h.session_date and b.benchmark_id = 101),
s as (select *, (close / lag(close, 60) over w) / (b / lag(b, 60) over w) - 1 as strength from j window w as (partition by instrument_id order by session_date)),
l as (select instrument_id, max(session_date) as session_date, arg_max(coalesce(strength, 'nan'::double), session_date) as strength from s group by 1),
r as (select l.* from l join universe u using (instrument_id) where not isnan(strength) and u.valid_from <= date '{DAY}' and (u.valid_to is null or u.valid_to > date '{DAY}')),
p as (select *, cume_dist() over (order by strength) as pct from r)
select instrument_id, session_date, floor(strength * 1e6 + 0.5::double) / 1e6 as strength, floor(pct * 1e6 + 0.5::double) / 1e6 as pct from p where pct > 0.9"""))
