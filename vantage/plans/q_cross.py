"""Queries over cross-sections, breadth, sectors, regimes and eligibility."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vantage.functions.scalar import digest, digest_sql
from vantage.operators import cross as C
from vantage.operators import features as X
from vantage.operators.asof import sessions_within
from vantage.registry import register
from vantage.sources.fixtures import frame, once, with_tables

D = digest_sql


def _roster(s, d, g=None):
    return sessions_within(frame(s, d, "universe", g), frame(s, d, "calendar", g).select("session_date")).select("instrument_id", "session_date")


def _relative(s, d, g=None):
    g = g or once(s, d, "bars", "benchmarks")
    return C.compare_to_benchmarks(frame(s, d, "bars", g), frame(s, d, "benchmarks", g))


_ROSTER = "roster as (select u.instrument_id, c.session_date from calendar c join universe u on u.valid_from <= c.session_date and (u.valid_to is null or u.valid_to > c.session_date))"
_PAIR = """j as (select b.instrument_id, m.benchmark_id, b.session_date, b.close, m.close as bench, b.close / m.close as ratio from bars b join benchmarks m using (session_date))"""
_LAGS = " union all ".join(
    f"select j.*, {k} as lookback, lag(close, {k}) over w as c0, lag(bench, {k}) over w as b0, lag(ratio, {k}) over w as r0, lag(ratio, {k - (k + 1) // 2}) over w as rm from j window w as (partition by instrument_id, benchmark_id order by session_date)"
    for k in C.LOOKBACKS
)
_REL = _PAIR + f""",
k as (select unnest({list(C.LOOKBACKS)}) as lookback),
r as (select instrument_id, benchmark_id, session_date, lookback, (close / c0) / (bench / b0) - 1 as relative, (close / c0 - 1) - (bench / b0 - 1) as excess,
  (ratio / r0 - 1) / lookback as ratio_trend, ratio / rm - rm / r0 as ratio_momentum from ({_LAGS}) x where c0 is not null)
"""
_RELT = "bars benchmarks"


register("x01_aligned", lambda s, d: frame(s, d, "bars").join(frame(s, d, "benchmarks").where("benchmark_id = 101").select("session_date", F.col("close").alias("bench")), "session_date").select("instrument_id", "session_date", "close", digest(F.col("bench")).alias("bench")),
         with_tables(_RELT, f"select b.instrument_id, session_date, b.close, {D('m.close')} as bench from bars b join benchmarks m using (session_date) where benchmark_id = 101"))
register("x02_benchmark_comparison", lambda s, d: _relative(s, d).where("benchmark_id = 101").select("instrument_id", "session_date", "lookback", *(digest(F.col(c), 6).alias(c) for c in ("relative", "excess", "ratio_trend", "ratio_momentum"))),
         with_tables(_RELT, "with " + _REL + f"select instrument_id, session_date, lookback, {', '.join(f'{D(c, 6)} as {c}' for c in ('relative', 'excess', 'ratio_trend', 'ratio_momentum'))} from r where benchmark_id = 101"))
register("x02_comparison_all_benchmarks", lambda s, d: _relative(s, d).select("instrument_id", "benchmark_id", "session_date", "lookback", *(digest(F.col(c), 6).alias(c) for c in ("relative", "excess", "ratio_trend", "ratio_momentum"))),
         with_tables(_RELT, "with " + _REL + f"select instrument_id, benchmark_id, session_date, lookback, {', '.join(f'{D(c, 6)} as {c}' for c in ('relative', 'excess', 'ratio_trend', 'ratio_momentum'))} from r"))
register("x03_all_benchmarks", lambda s, d: _relative(s, d).groupBy("session_date", "benchmark_id", "lookback").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("relative") > 1e-9).alias("ahead")),
         with_tables(_RELT, "with " + _REL + "select session_date, benchmark_id, lookback, count(*) as n, count(*) filter (relative > 1e-9) as ahead from r group by 1, 2, 3"))


def _to_index(s, d, g):
    """Each bar's relative strength against the index, a column a lookback, cut to six decimals."""
    index = frame(s, d, "benchmarks", g).where("benchmark_id = 101")
    x = C.compared(frame(s, d, "bars", g), index, measures=("relative",))
    return x.select("instrument_id", "session_date", *(digest(F.col(f"relative_{k}"), 6).alias(f"relative_{k}") for k in C.LOOKBACKS))


def _ranked(s, d, g=None):
    g = g or once(s, d, "bars", "benchmarks", "calendar")
    keys = ["instrument_id", "session_date"]
    return C.ranked_members(C.by_lookback(_roster(s, d, g).join(_to_index(s, d, g), keys, "left"), keys, "relative", "value"), ("session_date", "lookback"))


_RANK = _ROSTER + ", " + _REL + f""",
v as (select instrument_id, session_date, lookback, {D('relative', 6)} as value from r where benchmark_id = 101),
x as (select ro.instrument_id, ro.session_date, k.lookback, v.value from roster ro cross join k left join v on v.instrument_id = ro.instrument_id and v.session_date = ro.session_date and v.lookback = k.lookback),
p as (select *, count(value) over (partition by session_date, lookback) as roster_size, cume_dist() over (partition by session_date, lookback, value is not null order by value) as cd from x),
q as (select *, case when value is not null and roster_size >= 5 then cd end as percentile from p)
"""
_RANKT = "bars benchmarks calendar universe"


def _strays(s, d):
    g = once(s, d, "bars", "benchmarks", "calendar")
    return C.strays(_relative(s, d, g).where("lookback = 20 and benchmark_id = 101").select("instrument_id", "session_date"), _roster(s, d, g), ("session_date",))


register("x04_percentile_rank", lambda s, d: _ranked(s, d).select("instrument_id", "session_date", "lookback", "roster_size", digest(F.col("percentile"), 6).alias("percentile")),
         with_tables(_RANKT, "with " + _RANK + f"select instrument_id, session_date, lookback, roster_size, {D('percentile', 6)} as percentile from q"))
register("x04_strays", _strays,
         with_tables(_RANKT, "with " + _ROSTER + ", " + _REL + "select instrument_id, session_date from r where lookback = 20 and benchmark_id = 101 and not exists (select 1 from roster o where o.instrument_id = r.instrument_id and o.session_date = r.session_date)"))


def _sector_of(s, d, df, g=None):
    from vantage.operators.asof import interval_at

    return interval_at(df, frame(s, d, "sectors", g).select("instrument_id", "sector", "industry", "valid_from", "valid_to"), "session_date", ["instrument_id"], "left").drop("valid_from", "valid_to")


def _x05(s, d, g=None):
    g = g or once(s, d, "bars", "benchmarks")
    v = _sector_of(s, d, _to_index(s, d, g).select("instrument_id", "session_date", F.col("relative_60").alias("value")).where("value is not null"), g)
    w = Window.partitionBy("session_date", "sector")
    return v.select("instrument_id", "session_date", "sector", digest(F.when(F.col("sector").isNotNull(), F.cume_dist().over(w.orderBy("value"))), 6).alias("percentile"))


_SEC = "left join sectors s on s.instrument_id = v.instrument_id and s.valid_from <= v.session_date and (s.valid_to is null or s.valid_to > v.session_date)"
register("x05_rank_in_sector", _x05, with_tables("bars benchmarks sectors", "with " + _REL + f""", v as (select instrument_id, session_date, {D('relative', 6)} as value from r where benchmark_id = 101 and lookback = 60)
select v.instrument_id, v.session_date, s.sector, {D('case when s.sector is not null then cume_dist() over (partition by v.session_date, s.sector order by value) end', 6)} as percentile from v {_SEC}"""))


def _x06(s, d):
    wide = _ranked(s, d).groupBy("instrument_id", "session_date").agg(*(F.max(F.when(F.col("lookback") == k, F.col("percentile"))).alias(f"p{k}") for k in C.LOOKBACKS))
    return wide.select("instrument_id", "session_date", digest(C.rs_score({k: F.col(f"p{k}") for k in C.LOOKBACKS}), 3).alias("score"))


register("x06_rs_score", _x06, with_tables(_RANKT, "with " + _RANK + f""", y as (select instrument_id, session_date, sum(percentile * case lookback when 20 then 15e-2 when 60 then 25e-2 else 3e-1 end) as m, sum(case when percentile is not null then case lookback when 20 then 15e-2 when 60 then 25e-2 else 3e-1 end end) as t from q group by 1, 2)
select instrument_id, session_date, {D('round(m / t * 100, 4)', 3)} as score from y"""))


def _x07(s, d):
    g = once(s, d, "bars", "benchmarks")
    return C.beats_all(frame(s, d, "bars", g), frame(s, d, "benchmarks", g))


register("x07_beats_all", _x07,
         with_tables(_RELT, "with " + _REL + "select instrument_id, session_date, lookback, bool_and(relative > 1e-9) as beats_all from r group by 1, 2, 3"))


def _breadth_input(s, d, g=None):
    b = frame(s, d, "bars", g).withColumns({"previous": F.lag("close", 1).over(X.series()), "sma_50": X.sma(F.col("close"), 50), "sma_200": X.sma(F.col("close"), 200), "high_252": X.rolling_max(F.col("close"), 252), "low_252": X.rolling_min(F.col("close"), 252)})
    return b.withColumns({"sma_50": digest(F.col("sma_50")), "sma_200": digest(F.col("sma_200"))})


def _breadth(s, d, g=None):
    return C.breadth(_breadth_input(s, d, g), _roster(s, d, g))


def _t(n):
    return f"over (partition by instrument_id order by session_date rows between {n - 1} preceding and current row)"


_B = _ROSTER + f""",
n as (select *, row_number() over w as i, lag(close) over w as previous, sum(close) {_t(50)} / 50 as a, sum(close) {_t(200)} / 200 as b, max(close) {_t(252)} as h, min(close) {_t(252)} as l from bars window w as (partition by instrument_id order by session_date)),
f as (select instrument_id, session_date, close, volume, previous, case when i >= 50 then {D('a')} end as sma_50, case when i >= 200 then {D('b')} end as sma_200, case when i >= 252 then h end as high_252, case when i >= 252 then l end as low_252 from n),
m as (select o.session_date, count(*) filter (close > previous) as advances, count(*) filter (close < previous) as declines, count(*) filter (close = previous) as unchanged,
  sum(case when close > previous then volume else 0 end) as up_volume, sum(case when close < previous then volume else 0 end) as down_volume,
  count(*) filter (close > sma_50) / nullif(count(sma_50), 0)::double as above_50, count(*) filter (close > sma_200) / nullif(count(sma_200), 0)::double as above_200,
  count(*) filter (close >= high_252) as new_highs, count(*) filter (close <= low_252) as new_lows, count(*) as roster_size, count(close) as with_data,
  sha256(array_to_string(list_sort(list(distinct o.instrument_id)), ',')) as roster_digest
  from roster o left join f on f.instrument_id = o.instrument_id and f.session_date = o.session_date group by 1)
"""
_BT = "bars calendar universe"
_BCOLS = ["session_date", "advances", "declines", "unchanged", "up_volume", "down_volume", "new_highs", "new_lows", "roster_size", "with_data"]
register("x08_breadth", lambda s, d: _breadth(s, d).select(*_BCOLS, digest(F.col("above_50"), 6).alias("above_50"), digest(F.col("above_200"), 6).alias("above_200"), "delta", "low_confidence"),
         with_tables(_BT, "with " + _B + f"select {', '.join(_BCOLS)}, {D('above_50', 6)} as above_50, {D('above_200', 6)} as above_200, advances - declines as delta, with_data < 5 as low_confidence from m"))
register("x09_breadth_ratios", lambda s, d: C.breadth_ratios(_breadth(s, d)).select("session_date", *(digest(F.col(c), 5).alias(c) for c in ("volume_ratio", "participation")), (F.col("advance_decline") > 1).alias("ahead"), "high_low_spread"),
         with_tables(_BT, "with " + _B + f"select session_date, {D('up_volume / nullif(down_volume, 0)', 5)} as volume_ratio, {D('(advances + declines) / nullif(with_data, 0)::double', 5)} as participation, case when declines > 0 then advances > declines when advances > 0 then true end as ahead, new_highs - new_lows as high_low_spread from m"))
register("x10_advance_decline_line", lambda s, d: C.advance_decline_line(_breadth(s, d)), with_tables(_BT, "with " + _B + "select session_date, sum(advances - declines) over (order by session_date)::bigint as ad_line from m"))
register("x11_thrust", lambda s, d: C.thrust(_breadth(s, d)).select("session_date", digest(F.col("thrust"), 5).alias("thrust")),
         with_tables(_BT, "with " + _B + f"select session_date, {D('case when row_number() over w >= 10 then avg(advances / nullif(advances + declines, 0)::double) over (order by session_date rows 9 preceding) end', 5)} as thrust from m window w as (order by session_date)"))


def _sector_input(s, d, g=None):
    c = F.col("close")
    b = frame(s, d, "bars", g).withColumns(
        {"roc_20": X.rate_of_change(c, 20), "roc_60": X.rate_of_change(c, 60), "sma_50": digest(X.sma(c, 50)), "sma_200": digest(X.sma(c, 200)), "high_252": X.rolling_max(c, 252), "low_252": X.rolling_min(c, 252), "relative_volume": X.relative_volume(20)}
    )
    return _sector_of(s, d, b.withColumns({"above_50": c > F.col("sma_50"), "above_200": c > F.col("sma_200"), "at_high": c >= F.col("high_252"), "at_low": c <= F.col("low_252")}), g)


def _market(s, d, g=None):
    w = Window.partitionBy("benchmark_id").orderBy("session_date")
    back = lambda n: (F.col("close") / F.lag("close", n).over(w) - 1).alias(f"market_{n}")
    return frame(s, d, "benchmarks", g).where("benchmark_id = 101").select("session_date", back(20), back(60))


def _sectors(s, d, g=None):
    return C.sector_strength(_sector_input(s, d, g), _market(s, d, g))


_S = f"""n as (select *, row_number() over w as i, close / lag(close, 20) over w - 1 as roc_20, close / lag(close, 60) over w - 1 as roc_60, sum(close) {_t(50)} / 50 as a, sum(close) {_t(200)} / 200 as b, max(close) {_t(252)} as h, min(close) {_t(252)} as l,
  avg(volume) over (partition by instrument_id order by session_date rows between 20 preceding and 1 preceding) as av from bars window w as (partition by instrument_id order by session_date)),
v as (select instrument_id, session_date, roc_20, roc_60, close > case when i >= 50 then {D('a')} end as above_50, close > case when i >= 200 then {D('b')} end as above_200, close >= case when i >= 252 then h end as at_high, close <= case when i >= 252 then l end as at_low, case when i > 20 then volume / av end as relative_volume from n),
mk as (select session_date, close / lag(close, 20) over (order by session_date) - 1 as market_20, close / lag(close, 60) over (order by session_date) - 1 as market_60 from benchmarks where benchmark_id = 101),
g as (select v.session_date, s.sector, count(*) as members, avg(roc_20) as return_20, avg(roc_60) as return_60, avg(above_50::int) as above_50, avg(above_200::int) as above_200, avg((roc_20 > 0)::int) as participation, avg(at_high::int) as leadership, avg(relative_volume) as volume_ratio,
  count(*) filter (at_high) as new_highs, count(*) filter (at_low) as new_lows from v {_SEC} where s.sector is not null group by 1, 2),
h as (select g.*, (1 + return_20) / (1 + market_20) - 1 as relative_20, (1 + return_60) / (1 + market_60) - 1 as relative_60 from g left join mk using (session_date)),
z as (select *, relative_20 - relative_60 as momentum from h),
y as (select *, case when members >= 5 then round(100 * (coalesce(25e-2 * (case when relative_20 is not null then greatest(least((relative_20 + 1e-1) / 2e-1, 1), 0) end), 0) + coalesce(15e-2 * (case when return_20 is not null then greatest(least((return_20 + 15e-2) / 3e-1, 1), 0) end), 0)
  + coalesce(2e-1 * (case when momentum is not null then greatest(least((momentum + 5e-2) / 1e-1, 1), 0) end), 0) + coalesce(2e-1 * above_50, 0) + coalesce(1e-1 * above_200, 0) + coalesce(1e-1 * participation, 0))
  / nullif(case when relative_20 is not null then 25e-2 else 0 end + case when return_20 is not null then 15e-2 else 0 end + case when momentum is not null then 2e-1 else 0 end + case when above_50 is not null then 2e-1 else 0 end + case when above_200 is not null then 1e-1 else 0 end + case when participation is not null then 1e-1 else 0 end, 0), 4) end as score,
  case when members >= 5 then case when momentum is null then 'unknown' when momentum > 2e-2 then 'improving' when momentum < -2e-2 then 'deteriorating' else 'stable' end end as trend,
  case when members >= 5 then case when above_50 is null then 'unknown' when above_50 >= 7e-1 then 'strong' when above_50 >= 45e-2 then 'mixed' else 'weak' end end as breadth_status,
  case when members >= 5 then case when participation is null then 'unknown' when participation >= 65e-2 and (leadership is null or leadership >= 15e-2) then 'broad' when participation >= 45e-2 then 'moderate' else 'narrow' end end as participation_status from z)
"""
_ST = "bars sectors benchmarks"
_SC = ("return_20", "return_60", "relative_20", "relative_60", "momentum", "above_50", "above_200", "participation", "leadership", "volume_ratio")
register("x12_sector_aggregate", lambda s, d: _sectors(s, d).select("session_date", "sector", "members", "new_highs", "new_lows", *(digest(F.col(c), 5).alias(c) for c in _SC)),
         with_tables(_ST, "with " + _S + f"select session_date, sector, members, new_highs, new_lows, {', '.join(f'{D(c, 5)} as {c}' for c in _SC)} from y"))
register("x13_sector_score", lambda s, d: _sectors(s, d).select("session_date", "sector", digest(F.col("score"), 3).alias("score")), with_tables(_ST, "with " + _S + f"select session_date, sector, {D('score', 3)} as score from y"))
register("x14_sector_labels", lambda s, d: _sectors(s, d).select("session_date", "sector", "trend", "breadth_status", "participation_status"), with_tables(_ST, "with " + _S + "select session_date, sector, trend, breadth_status, participation_status from y"))


def _x15(s, d):
    scored = _sectors(s, d).withColumn("score", digest(F.col("score"), 3))
    return C.ranked_sectors(scored).select("session_date", "sector", "rank")


register("x15_sector_rank", _x15, with_tables(_ST, "with " + _S + f", q as (select session_date, sector, {D('score', 3)} as score from y) select session_date, sector, case when score is not null then cast(row_number() over (partition by session_date, score is null order by score desc, sector) as int) end as rank from q"))


def _volatility(s, d, g=None):
    b = frame(s, d, "benchmarks", g).where("benchmark_id = 101").select(F.col("benchmark_id").alias("instrument_id"), "session_date", "close")
    v = b.withColumns({"r": X.log_return(), "was": F.lag("close", 1).over(X.series())}).withColumns({"volatility": digest(X.realized_volatility(F.col("r"), 20), 6), "slow": X.realized_volatility(F.col("r"), 60)})
    v = v.withColumns({"percentile": X.percent_rank(F.col("volatility"), 252), "expansion": digest(F.col("volatility") / F.col("slow"), 5), "atr_percent": F.lit(None).cast("double")})
    v = v.withColumn("gap_frequency", X.warm(21, F.avg((F.abs(F.col("close") / F.col("was") - 1) > 0.02).cast("double")).over(X.trailing(20))))
    r = frame(s, d, "bars", g).withColumn("roc", X.rate_of_change(F.col("close"), 20))
    return C.volatility_regime(v.join(C.dispersion(r, ("session_date",), "roc", 20).select("session_date", digest(F.col("dispersion"), 5).alias("dispersion")), "session_date", "left"))


_V = f"""vb as (select session_date, close, ln(close / lag(close) over (order by session_date)) as r, abs(close / lag(close) over (order by session_date) - 1) > 2e-2 as gap from benchmarks where benchmark_id = 101),
vv as (select session_date, {D('case when count(r) over k >= 20 then stddev_samp(r) over k * sqrt(252) end', 6)} as volatility, case when count(r) over k2 >= 60 then stddev_samp(r) over k2 * sqrt(252) end as slow,
  case when count(r) over k >= 20 then avg(gap::int) over k end as gap_frequency from vb window k as (order by session_date rows 19 preceding), k2 as (order by session_date rows 59 preceding)),
vu as (select *, row_number() over (order by session_date) as i, list(volatility) filter (volatility is not null) over (order by session_date rows 251 preceding) as seen from vv),
vd as (select session_date, {D('case when count(roc) >= 20 then stddev_samp(roc) end', 5)} as dispersion from (select session_date, close / lag(close, 20) over (partition by instrument_id order by session_date) - 1 as roc from bars) group by 1),
vw as (select session_date, volatility, gap_frequency, dispersion, {D('volatility / slow', 5)} as expansion, case when i >= 252 and volatility is not null and len(seen) >= 2 then (len(list_filter(seen, lambda z: z <= volatility * (1 + 7e-15))) - 1) / (len(seen) - 1)::double end as percentile from vu left join vd using (session_date)),
vx as (select *, case when percentile is null then 'UNKNOWN' when percentile < 2e-1 then 'LOW' when percentile < 6e-1 then 'NORMAL' when percentile < 8e-1 then 'ELEVATED' when percentile < 95e-2 then 'HIGH' else 'EXTREME' end as regime,
  case when percentile < 2e-1 then 1 - 2 * abs(percentile / 2e-1 - 5e-1) when percentile < 6e-1 then 1 - 2 * abs((percentile - 2e-1) / 4e-1 - 5e-1) when percentile < 8e-1 then 1 - 2 * abs((percentile - 6e-1) / 2e-1 - 5e-1)
       when percentile < 95e-2 then 1 - 2 * abs((percentile - 8e-1) / 15e-2 - 5e-1) else 1 - 2 * abs((percentile - 95e-2) / 5e-2 - 5e-1) end as central from vw),
vy as (select *, case when percentile is null then '' else concat_ws(',', case when expansion < 85e-2 and regime in ('ELEVATED', 'HIGH', 'EXTREME') then 'contracting' end, case when gap_frequency < 5e-2 and regime in ('HIGH', 'EXTREME') then 'rare_gaps' end,
  case when dispersion > 3e-1 and regime in ('LOW', 'NORMAL') then 'dispersion' end) end as contradicting,
  case when percentile is null then '' else concat_ws(',', 'percentile', 'volatility', case when expansion > 115e-2 then 'expanding' end, case when expansion < 85e-2 and regime in ('LOW', 'NORMAL') then 'contracting' end, case when gap_frequency > 25e-2 then 'gaps' end,
  case when dispersion > 3e-1 and regime not in ('LOW', 'NORMAL') then 'dispersion' end) end as supporting from vx),
vz as (select *, case when percentile is null then 0 else cast(round_even(greatest(0, 50 + 50 * greatest(central, 0) - 12 * case when contradicting = '' then 0 else len(string_split(contradicting, ',')) end), 0) as int) end as confidence from vy)
"""
register("x16_volatility_regime", lambda s, d: _volatility(s, d).select("session_date", "regime", "confidence", digest(F.col("percentile"), 5).alias("percentile"), F.array_join("supporting", ",").alias("supporting"), F.array_join("contradicting", ",").alias("contradicting")),
         with_tables("bars benchmarks", "with " + _V + f"select session_date, regime, confidence, {D('percentile', 5)} as percentile, supporting, contradicting from vz"))
register("x17_dispersion", lambda s, d: C.dispersion(frame(s, d, "bars").withColumn("roc", X.rate_of_change(F.col("close"), 20)), ("session_date",), "roc", 20).select("session_date", "n", digest(F.col("dispersion"), 6).alias("dispersion")),
         with_tables("bars", f"with r as (select session_date, close / lag(close, 20) over (partition by instrument_id order by session_date) - 1 as roc from bars) select session_date, count(roc) as n, {D('case when count(roc) >= 20 then stddev_samp(roc) end', 6)} as dispersion from r group by 1"))


def _regime(s, d, g=None, scores=None):
    trends = C.benchmark_trends(frame(s, d, "benchmarks", g).withColumn("close", digest(F.col("close"), 5)))
    sectors = (_sectors(s, d, g) if scores is None else scores).groupBy("session_date").agg(F.count_if(F.col("above_50") > 0.5).alias("sectors_above"), F.count("above_50").alias("sectors"))
    volatile = _volatility(s, d, g).select("session_date", F.col("regime").alias("volatility_regime"))
    return C.market_regime(_breadth(s, d, g).join(trends, "session_date").join(sectors, "session_date", "left").join(volatile, "session_date", "left"))


_R = _B + ", " + ", ".join(x for x in (_S.replace("n as (", "sn as (", 1).replace(" from n),", " from sn),", 1).replace("v as (", "sv as (", 1).replace("from v ", "from sv v ", 1).strip(), _V.strip())) + f""",
bt as (select benchmark_id, session_date, {D('close', 5)} as close from benchmarks),
tr as (select *, row_number() over w as i, avg(close) over (partition by benchmark_id order by session_date rows 49 preceding) as fa, avg(close) over (partition by benchmark_id order by session_date rows 199 preceding) as sl from bt window w as (partition by benchmark_id order by session_date)),
ts as (select benchmark_id, session_date, close, case when i >= 50 then fa end as fast, case when i >= 200 then sl end as slow from tr),
tt as (select *, close > fast as above_fast, close > slow as above_slow, fast > slow as stacked, (fast / lag(fast, 20) over (partition by benchmark_id order by session_date) - 1) / 20 as slope from ts),
ta as (select session_date, max(case when above_slow then 5e-1 else -5e-1 end + case when above_fast then 3e-1 else -3e-1 end + case when stacked then 2e-1 else -2e-1 end) filter (benchmark_id = 101 and above_slow is not null and above_fast is not null) as s1,
  2e0 * count(*) filter (above_slow) / nullif(count(above_slow), 0) - 1 as s2, max(greatest(least(slope / 1e-3, 1), -1)) filter (benchmark_id = 101 and slope is not null) as s3,
  count(*) filter (above_fast) + count(*) filter (above_slow) + count(*) filter (slope > 0) as ups, count(*) filter (not above_fast) + count(*) filter (not above_slow) + count(*) filter (slope < 0) as downs from tt group by 1),
se as (select session_date, count(*) filter (above_50 > 5e-1) as sectors_above, count(above_50) as sectors from y group by 1),
sg as (select m.session_date, vz.regime as volatility_regime, s1, s2, s3, greatest(least((above_200 - 5e-1) / 3e-1, 1), -1) + 0 * above_200 as s4, case when new_highs + new_lows = 0 then 0 else (new_highs - new_lows) / (new_highs + new_lows)::double end as s5,
  case when sectors > 0 then greatest(least((sectors_above / sectors::double - 5e-1) / 35e-2, 1), -1) end as s6, case vz.regime when 'LOW' then 5e-1 when 'NORMAL' then 25e-2 when 'ELEVATED' then -25e-2 when 'HIGH' then -7e-1 when 'EXTREME' then -1e0 end as s7, ups, downs
  from m join ta using (session_date) left join se using (session_date) left join vz using (session_date)),
sl as (select session_date, volatility_regime, ups, downs, unnest([{{'n': 'primary_trend', 's': s1, 'w': 3e-1}}, {{'n': 'benchmark_agreement', 's': s2, 'w': 15e-2}}, {{'n': 'ma_slope', 's': s3, 'w': 15e-2}}, {{'n': 'breadth_above_200dma', 's': s4, 'w': 15e-2}}, {{'n': 'new_high_low', 's': s5, 'w': 1e-1}}, {{'n': 'sector_participation', 's': s6, 'w': 1e-1}}, {{'n': 'volatility', 's': s7, 'w': 5e-2}}]) as g, unnest([1, 2, 3, 4, 5, 6, 7]) as o from sg),
sc as (select session_date, round(sum(g.w * g.s) / sum(g.w) filter (g.s is not null), 6) as composite from sl group by 1),
sr as (select sl.session_date, any_value(composite) as composite, any_value(volatility_regime) as vr, count(g.s) as n, sum(g.w) filter (g.s <> 0 and (g.s > 0) = (composite > 0)) as agreeing, sum(g.w) filter (g.s is not null) as total,
  string_agg(g.n, ',' order by o) filter (g.s * sign(composite) > 0) as supporting, string_agg(g.n, ',' order by o) filter (g.s * sign(composite) <= 0) as contradicting, any_value(case when composite > 0 then downs when composite < 0 then ups else ups + downs end) as opposing from sl join sc using (session_date) group by 1),
rg as (select *, case when composite is null then 'UNKNOWN' when vr = 'EXTREME' and composite < -1e-1 then 'HIGH_VOLATILITY' when composite >= 6e-1 then 'BULL_TRENDING' when composite >= 25e-2 then 'BULL_CHOPPY' when composite >= -1e-1 then 'NEUTRAL' when composite >= -35e-2 then 'BEAR_CHOPPY' else 'BEAR_TRENDING' end as regime,
  case when n > 0 then cast(round_even(100 * greatest(least(45e-2 * least(least(abs(composite - 6e-1), abs(composite - 25e-2), abs(composite + 1e-1), abs(composite + 35e-2), abs(composite + 65e-2)) / 15e-2, 1) + 35e-2 * coalesce(agreeing, 0) / total + 2e-1 * least(n / 6e0, 1) - 4e-2 * opposing, 1), 0), 0) as int) else 0 end as confidence from sr)
"""
_RT = "bars calendar universe sectors benchmarks"
register("x18_market_regime", lambda s, d: _regime(s, d).select("session_date", "regime", digest(F.col("composite"), 4).alias("composite"), F.array_join("supporting", ",").alias("supporting"), F.array_join("contradicting", ",").alias("contradicting"), "opposing", "confidence"),
         with_tables(_RT, "with " + _R + f"select session_date, regime, {D('composite', 4)} as composite, coalesce(supporting, '') as supporting, coalesce(contradicting, '') as contradicting, opposing, confidence from rg"))


def _planted(s, d):
    """Recorded regimes of which every 97th session's composite was changed after the fact."""
    return _regime(s, d).withColumn("composite", F.when(F.unix_date("session_date") % 97 == 0, F.col("composite") + 0.01).otherwise(F.col("composite")))


register("x19_unreconciled", lambda s, d: C.unreconciled(_planted(s, d)).select("session_date"), with_tables(_RT, "with " + _R + "select session_date from rg where composite is not null and (session_date - date '1970-01-01') % 97 = 0"))
register("x21_roster_digest", lambda s, d: _roster(s, d).groupBy("session_date").agg(C.roster_digest().alias("roster_digest")),
         with_tables("calendar universe", "with " + _ROSTER + " select session_date, sha256(array_to_string(list_sort(list(distinct instrument_id)), ',')) as roster_digest from roster group by 1"))


def _eligible(s, d):
    c = F.col("close")
    f = frame(s, d, "dirty_bars").where("line in (1, 5)").withColumns({"sma_200": X.sma(c, 200), "roc_252": X.rate_of_change(c, 252)})
    per = f.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max_by("close", "session_date").alias("last_close"), F.avg((F.col("volume") == 0).cast("double")).alias("share_zero_volume"), *(F.max_by(x, "session_date").alias(x) for x in ("sma_200", "roc_252")))
    return C.eligibility(per, 1450, ["sma_200", "roc_252"])


_E = """n as (select instrument_id, count(*) as n_sessions, avg((volume = 0)::int) > 2e-1 as idle from dirty_bars where line in (1, 5) group by 1),
e as (select * exclude (idle), case when n_sessions < 1450 or idle then 'INELIGIBLE' when n_sessions < 253 then 'DATA_ELIGIBLE' else 'FEATURE_READY' end as state,
  concat_ws(',', case when n_sessions < 1450 then 'too_short' end, case when idle then 'illiquid' end) as reasons, concat_ws(',', case when n_sessions < 200 then 'sma_200' end, case when n_sessions < 253 then 'roc_252' end) as missing, greatest(1450 - n_sessions, 0) as sessions_until_ready from n)
"""
register("e01_eligibility", lambda s, d: _eligible(s, d).select("instrument_id", "n_sessions", "state", F.array_join("reasons", ",").alias("reasons"), F.array_join("missing", ",").alias("missing"), "sessions_until_ready"), with_tables("dirty_bars", "with " + _E + "select instrument_id, n_sessions, state, reasons, missing, sessions_until_ready from e"))
register("e02_partition", lambda s, d: _eligible(s, d).groupBy("state").agg(F.count(F.lit(1)).alias("n")), with_tables("dirty_bars", "with " + _E + "select state, count(*) as n from e group by 1"))
register("e03_blocking_features", lambda s, d: _eligible(s, d).select(F.explode("missing").alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n")), with_tables("dirty_bars", "with " + _E + "select feature, count(*) as n from (select unnest(string_split(missing, ',')) as feature from e where missing <> '') x group by 1"))
register("e04_sessions_until_ready", lambda s, d: _eligible(s, d).select("instrument_id", "sessions_until_ready"), with_tables("dirty_bars", "with " + _E + "select instrument_id, sessions_until_ready from e"))
register("e07_rosters", lambda s, d: _eligible(s, d).where("state <> 'INELIGIBLE'").select("instrument_id", (F.col("state") == "FEATURE_READY").alias("scannable")), with_tables("dirty_bars", "with " + _E + "select instrument_id, state = 'FEATURE_READY' as scannable from e where state <> 'INELIGIBLE'"))
