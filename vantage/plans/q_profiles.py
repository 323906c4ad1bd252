"""Queries over profiles of stretches, lines, touches and score curves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vantage.functions import scalar as S
from vantage.functions.scalar import digest, digest_sql
from vantage.operators import features as X
from vantage.operators import profiles as P
from vantage.operators import structure as T
from vantage.plans.q_breakout import ramp
from vantage.registry import register
from vantage.sources.fixtures import frame, with_tables

D = digest_sql
N = 40


def _stretches(s, d):
    span = F.avg("_tr").over(X.prior(14))
    b = frame(s, d, "bars").withColumn("_tr", X.true_range()).withColumn("atr", F.when(F.count("_tr").over(X.prior(14)) >= 14, span)).drop("_tr")
    return P.stretches(b, N)


def _out(df, measured, exact=(), digits=5):
    return df.select(*P.BY, *exact, *(digest(F.col(c), digits).alias(c) for c in measured))


def _cols(names, digits=5):
    return ", ".join(f"{D(c, digits)} as {c}" for c in names)


_ST = f"""w1 as (select *, row_number() over w - 1 as i, lag(close) over w as pc, avg(volume) over (partition by instrument_id order by session_date rows between 20 preceding and 1 preceding) as vm from bars window w as (partition by instrument_id order by session_date)),
w2 as (select *, case when pc is not null then greatest(high - low, abs(high - pc), abs(low - pc)) end as tr, (i // {N})::int as block, (i % {N})::int as k from w1),
w3 as (select *, case when count(tr) over p >= 14 then avg(tr) over p end as atr from w2 window p as (partition by instrument_id order by session_date rows between 14 preceding and 1 preceding)),
st as (select *, lag(close) over b as was, first_value(vm) over b as baseline from w3 window b as (partition by instrument_id, block order by k))
"""
_I = ("low", "high", "gain", "gain_atr", "rate_per_session", "up_day_fraction", "closing_strength", "volume_ratio", "largest_session_share", "largest_gap_share", "persistence")
_IM = """ia as (select instrument_id, block, count(*) - 1 as sessions, arg_min(low, k) as low, max(high) as high, avg((close > open)::int) as up_day_fraction, avg(case when high > low then (close - low) / (high - low) else 5e-1 end) as closing_strength, coalesce(avg(volume) / nullif(max(baseline), 0), 1) as volume_ratio,
  arg_max(close, k) - arg_min(low, k) as total, max(close - was) as step, max(open - was) as gap, avg((close > was)::int) as up, max(case when k = 0 then atr end) as atr from st group by 1, 2),
im as (select *, high / low - 1 as gain, coalesce(low * (high / low - 1) / nullif(atr, 0), 0) as gain_atr, power(high / low, 1e0 / sessions) - 1 as rate_per_session, case when total > 0 then greatest(least(step / total, 1), 0) else 1 end as largest_session_share,
  case when total > 0 then greatest(least(gap / total, 1), 0) else 0 end as largest_gap_share, case when total > 0 then up else 0 end as persistence from ia where sessions > 0)
"""
register("p13_impulse", lambda s, d: _out(P.impulse(_stretches(s, d)), _I, ("sessions",)), with_tables("bars", "with " + _ST + ", " + _IM + f"select instrument_id, block, sessions, {_cols(_I)} from im"))


def _p14(s, d):
    x = _stretches(s, d)
    return _out(P.pullback(x, P.impulse(x)), ("depth", "depth_atr", "retracement", "worst_fall"), ("sessions", "undercut"))


register("p14_pullback", _p14, with_tables("bars", "with " + _ST + ", " + _IM + f""", pa as (select st.*, im.low as from_low, im.high as from_high, greatest(max(st.close) over (partition by st.instrument_id, st.block order by st.k), im.high) as peak from st join im on im.instrument_id = st.instrument_id and im.block + 1 = st.block),
pb as (select instrument_id, block, count(*) as sessions, greatest(max(high), max(from_high)) as top, min(low) as bottom, max(case when k = 0 then atr end) as atr, max(from_high) as fh, max(from_low) as fl, max((peak - low) / peak) as worst_fall from pa group by 1, 2),
pc as (select *, (top - bottom) / top as depth, coalesce((top - bottom) / nullif(atr, 0), 0) as depth_atr, case when fh > fl then (fh - bottom) / (fh - fl) else 0 end as retracement from pb)
select instrument_id, block, sessions, bottom < fl as undercut, {_cols(('depth', 'depth_atr', 'retracement', 'worst_fall'))} from pc"""))
_V = ("mean_volume", "ratio", "up_down_ratio", "slope_per_session", "late_ratio", "dry_fraction")
register("p16_volume", lambda s, d: _out(P.volume_profile(_stretches(s, d)), _V, ("obv_change",)), with_tables("bars", "with " + _ST + f""", va as (select *, k > max(k) over (partition by instrument_id, block) - 3 as late from st),
vb as (select instrument_id, block, avg(volume) as mean_volume, coalesce(avg(volume) / nullif(max(baseline), 0), 1) as ratio, case when sum(case when close < open then volume else 0 end) > 0 then sum(case when close >= open then volume else 0 end) / sum(case when close < open then volume else 0 end) else 2 end as up_down_ratio,
  case when count(*) >= 3 and avg(volume) > 0 then regr_slope(volume, k) / avg(volume) else 0 end as slope_per_session, sum(coalesce(sign(close - was), 0) * volume) as obv_change, case when avg(volume) > 0 then avg(volume) filter (late) / avg(volume) else 1 end as late_ratio, coalesce(avg((volume < baseline)::int) filter (baseline > 0), 0) as dry_fraction from va group by 1, 2)
select instrument_id, block, obv_change, {_cols(_V)} from vb"""))
_W = ("mean_range", "atr_ratio", "range_ratio", "dispersion", "max_range", "narrowing")
register("p17_volatility", lambda s, d: _out(P.volatility_profile(_stretches(s, d)), _W, ("sessions",)), with_tables("bars", "with " + _ST + f""", oa as (select *, k < count(*) over (partition by instrument_id, block) // 2 as early, high - low as r, (high - low) < lag(high - low) over (partition by instrument_id, block order by k) as narrower from st),
ob as (select instrument_id, block, count(*) as sessions, avg(r / close) as mean_range, coalesce(avg(r) filter (not early) / nullif(avg(r) filter (early), 0), 1) as range_ratio, avg(atr) filter (not early) / nullif(avg(atr) filter (early), 0) as ar, stddev_pop(close) / avg(close) as dispersion, max(r / close) as max_range, coalesce(avg(narrower::int), 0) as narrowing from oa group by 1, 2),
oc as (select *, coalesce(ar, range_ratio) as atr_ratio from ob where sessions >= 4) select instrument_id, block, sessions, {_cols(_W)} from oc"""))


def _p18(s, d):
    bench = frame(s, d, "benchmarks").where("benchmark_id = 101").select("session_date", digest(F.col("close"), 5).alias("bench"))
    return _out(P.strength_profile(_stretches(s, d).join(bench, "session_date")), ("own_return", "bench_return", "excess", "ratio_slope"), ("sessions", "at_high"))


register("p18_relative_strength", _p18, with_tables("bars benchmarks", "with " + _ST + f""", ra as (select st.*, {D('m.close')}0 as x0, floor(m.close * 1e5 + 4871e-4) / 1e5 as bench from st join benchmarks m on m.session_date = st.session_date and benchmark_id = 101),
rb as (select instrument_id, block, count(*) as sessions, arg_max(close, k) / arg_min(close, k) - 1 as own_return, arg_max(bench, k) / arg_min(bench, k) - 1 as bench_return, arg_max(close / bench, k) >= max(close / bench) * 995e-3 as at_high, case when count(*) >= 3 then regr_slope(close / bench, k) / avg(close / bench) else 0 end as ratio_slope from ra group by 1, 2),
rc as (select *, own_return - bench_return as excess from rb where sessions > 1) select instrument_id, block, sessions, at_high, {_cols(('own_return', 'bench_return', 'excess', 'ratio_slope'))} from rc""".replace(f"{D('m.close')}0 as x0, ", "")))


def _p20(s, d):
    x = _stretches(s, d).groupBy(*P.BY).agg(F.count(F.lit(1)).alias("sessions"))
    before = F.lag("sessions").over(Window.partitionBy("instrument_id").orderBy("block"))
    return _out(x.withColumn("reference", F.coalesce(before, F.lit(0))).withColumns(P.duration(F.col("sessions"), F.col("reference"), 20, 60, 0.9)), ("ratio",), ("sessions", "too_short", "too_extended"))


register("p20_duration", _p20, with_tables("bars", "with " + _ST + f""", da as (select instrument_id, block, count(*) as sessions from st group by 1, 2), db as (select *, coalesce(lag(sessions) over (partition by instrument_id order by block), 0) as reference from da),
dc as (select *, coalesce(sessions / nullif(reference, 0)::double, 0) as ratio from db) select instrument_id, block, sessions, sessions < 20 as too_short, sessions > 60 or ratio > 9e-1 as too_extended, {D('ratio', 5)} as ratio from dc"""))


def _lines(s, d):
    slope, level, fit = P.line(F.col("k").cast("double"), F.col("close"))
    return _stretches(s, d).groupBy(*P.BY).agg(slope.alias("slope"), level.alias("level"), fit.alias("fit"))


register("p06_line_fit", lambda s, d: _out(_lines(s, d), ("slope", "level", "fit"), digits=4),
         with_tables("bars", "with " + _ST + f", la as (select instrument_id, block, regr_slope(close, k) as slope, regr_intercept(close, k) as level, case when count(*) = 2 or (count(*) > 2 and regr_syy(close, k) = 0) then 0 when count(*) > 2 then regr_r2(close, k) end as fit from st group by 1, 2) select instrument_id, block, {_cols(('slope', 'level', 'fit'), 4)} from la"))


def _p08(s, d):
    pivots = T.swings(frame(s, d, "bars")).where("kind = 'high'").select("instrument_id", "session_date", "price")
    return _out(P.sloped_boundary(_stretches(s, d).select(*P.BY, "k", "session_date").join(pivots, ["instrument_id", "session_date"])), ("slope_per_session", "level", "fit", "confidence"), ("points", "anchor_date", "end_date"), 3)


_HIGHS = """pv as (select instrument_id, session_date, high as price from (select *, count(*) over l as nl, count(*) over r as nr, max(high) over l as hl, max(high) over r as hr from bars
  window l as (partition by instrument_id order by session_date rows between 3 preceding and 1 preceding), r as (partition by instrument_id order by session_date rows between 1 following and 3 following)) where nl = 3 and nr = 3 and hl < high and hr <= high)"""
register("p08_sloped_boundary", _p08, with_tables("bars", "with " + _ST + ", " + _HIGHS + f""", ha as (select st.instrument_id, block, k - min(k) over (partition by st.instrument_id, block) as x, session_date, price from st join pv using (instrument_id, session_date)),
hb as (select instrument_id, block, count(*) as points, min(session_date) as anchor_date, max(session_date) as end_date, regr_slope(price, x) as slope_per_session, regr_intercept(price, x) as level, case when count(*) > 2 and regr_syy(price, x) > 0 then regr_r2(price, x) else 0 end as fit from ha group by 1, 2),
hc as (select *, least(100, 100 * (65e-2 * least(points / 4e0, 1) + 35e-2 * greatest(least(fit, 1), 0))) as confidence from hb where points >= 2) select instrument_id, block, points, anchor_date, end_date, {_cols(('slope_per_session', 'level', 'fit', 'confidence'), 3)} from hc"""))
register("p09_single_extreme", lambda s, d: P.single_extreme(_stretches(s, d)), with_tables("bars", "with " + _ST + "select instrument_id, block, max(high) as level, arg_max(session_date, (high, -k)) as anchor_date, min(session_date) as start_date, max(session_date) as end_date, 25e0 as confidence from st group by 1, 2"))


def _p05(s, d):
    x = _stretches(s, d)
    level = x.groupBy(*P.BY).agg(F.max("high").alias("level"))
    return P.touches(x.join(level, list(P.BY))).select(*P.BY, F.size("touches").alias("n"), F.array_join(F.transform("touches", lambda k: k.cast("string")), ",").alias("touches"))


register("p05_touches", _p05)
register("p11_boundary_confidence", lambda s, d: _out(_lines(s, d).withColumn("confidence", P.boundary_confidence(F.lit(2), F.col("fit"))), ("confidence",)),
         with_tables("bars", "with " + _ST + f", la as (select instrument_id, block, case when count(*) = 2 or (count(*) > 2 and regr_syy(close, k) = 0) then 0 when count(*) > 2 then regr_r2(close, k) end as fit from st group by 1, 2) select instrument_id, block, {D('100 * (325e-3 + 35e-2 * fit)', 5)} as confidence from la"))


def _p15(s, d):
    legs = T.contractions(T.swings(frame(s, d, "bars")))
    return P.contraction_summary(legs).select("instrument_id", "legs", *(digest(F.col(c), 5).alias(c) for c in ("progression", "monotonic", "tightening", "final_depth")))


def _p15_sql():
    from vantage.plans.q_structure import _SW

    return with_tables("bars", "with " + _SW + f""", n as (select *, min(case when kind = 'low' then session_date end) over (partition by instrument_id order by session_date, kind rows between 1 following and unbounded following) as low_on from sw),
g as (select n.instrument_id, n.session_date as high_on, 1 - l.price / n.price as depth from n join sw l on l.instrument_id = n.instrument_id and l.session_date = n.low_on and l.kind = 'low' where n.kind = 'high'),
h as (select *, depth - lag(depth) over (partition by instrument_id order by high_on) as step from g),
e as (select instrument_id, count(*) as legs, coalesce(avg(step), 0) as progression, coalesce(avg((step < 0)::int), 0) as monotonic, case when count(*) >= 2 and arg_min(depth, high_on) > 0 then arg_max(depth, high_on) / arg_min(depth, high_on) else 1 end as tightening, arg_max(depth, high_on) as final_depth from h group by 1)
select instrument_id, legs, {_cols(('progression', 'monotonic', 'tightening', 'final_depth'))} from e""")


register("p15_contraction_sequence", _p15, _p15_sql())


def _curves(s, d):
    f = frame(s, d, "bars").withColumn("x", X.rate_of_change(F.col("close"), 20)).where("x is not null")
    x = F.col("x")
    return f.select("instrument_id", "session_date", *(digest(c, 3).alias(n) for n, c in {"ramp": S.ramp_between(x, -0.1, 0.1), "decay": S.ramp_between(x, 0.2, 0.0), "band": S.between(x, 0.0, 0.05, -0.1, 0.2, 20.0), "piecewise": S.piecewise(x, [(-0.1, 0.0), (0.0, 40.0), (0.1, 100.0)])}.items()))


register("p21_score_curves", _curves, with_tables("bars", f"""with r as (select instrument_id, session_date, close / lag(close, 20) over (partition by instrument_id order by session_date) - 1 as x from bars),
c as (select *, {ramp('x', '-1e-1', '1e-1')} as ramp, {ramp('x', '2e-1', '0')} as decay, case when x < 0 then {ramp('x', '-1e-1', '0', 20)} when x > 5e-2 then {ramp('x', '2e-1', '5e-2', 20)} else 100 end as band, case when x <= -1e-1 then 0 when x <= 0 then 40 * (x + 1e-1) / 1e-1 when x <= 1e-1 then 40 + 60 * x / 1e-1 else 100 end as piecewise from r where x is not null)
select instrument_id, session_date, {', '.join(f'{D(n, 3)} as {n}' for n in ('ramp', 'decay', 'band', 'piecewise'))} from c"""))


def _scored(s, d):
    v = P.volatility_profile(_stretches(s, d))
    parts = {"tight": (S.ramp_between(F.col("range_ratio"), 1.5, 0.5), 0.5), "calm": (S.ramp_between(F.col("dispersion"), 0.2, 0.0), 0.3), "atr": (F.when(F.col("sessions") >= 30, S.ramp_between(F.col("atr_ratio"), 1.5, 0.5)), 0.2)}
    have = sum((F.when(x.isNotNull(), w).otherwise(0.0) for x, w in parts.values()), F.lit(0.0))
    return v.withColumns({"score": S.weighted(parts), "confidence": S.structure_confidence(have, F.array(*(x for x, _ in parts.values())), F.col("sessions"), 30)})


_SQ = f"""oa as (select *, k < count(*) over (partition by instrument_id, block) // 2 as early, high - low as r from st),
ob as (select instrument_id, block, count(*) as sessions, coalesce(avg(r) filter (not early) / nullif(avg(r) filter (early), 0), 1) as range_ratio, avg(atr) filter (not early) / nullif(avg(atr) filter (early), 0) as ar, stddev_pop(close) / avg(close) as dispersion from oa group by 1, 2),
oc as (select *, {ramp('range_ratio', '15e-1', '5e-1')} as a, {ramp('dispersion', '2e-1', '0')} as b, case when sessions >= 30 then {ramp('coalesce(ar, range_ratio)', '15e-1', '5e-1')} end as c from ob where sessions >= 4),
od as (select *, (5e-1 * a + 3e-1 * b + coalesce(2e-1 * c, 0)) / (8e-1 + case when c is not null then 2e-1 else 0 end) as score, 8e-1 + case when c is not null then 2e-1 else 0 end as have, list_filter([a, b, c], lambda q: q is not null) as v from oc),
oe as (select *, greatest(least(1 - sqrt(list_sum(list_transform(v, lambda q: (q - list_avg(v)) * (q - list_avg(v)))) / len(v)) / 30, 1), 0) as agreement from od)
"""
register("p22_composite", lambda s, d: _out(_scored(s, d), ("score",), digits=3), with_tables("bars", "with " + _ST + ", " + _SQ + f"select instrument_id, block, {D('score', 3)} as score from oe"))
register("p23_confidence", lambda s, d: _out(_scored(s, d), ("confidence",), digits=3), with_tables("bars", "with " + _ST + ", " + _SQ + f"select instrument_id, block, {D('greatest(least(100 * (45e-2 * have + 35e-2 * agreement + 2e-1 * least(sessions / 6e1, 1)), 100), 0)', 3)} as confidence from oe"))
