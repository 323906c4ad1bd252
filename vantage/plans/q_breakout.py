"""Queries over breakout readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.functions.scalar import digest, digest_sql
from vantage.operators import breakout as B
from vantage.operators import features as X
from vantage.registry import register
from vantage.sources.fixtures import frame, once, with_tables
from vantage.sources.staging import staged_file

D = digest_sql
KEY = ("instrument_id", "session_date")
EVENT = ("instrument_id", "event_date")


def ramp(x: str, zero: str, full: str, floor: int = 0) -> str:
    return f"case when ({x}) is not null then greatest(least({floor} + {100 - floor} * (({x}) - ({zero})) / (({full}) - ({zero})), 100), {floor}) end"


def _numbered(s, d, g=None):
    return frame(s, d, "bars", g).withColumn("n", F.row_number().over(X.series()))


def _rolling(s, d, g=None):
    return B.rolling_boundary(_numbered(s, d, g))


def _digested(df, keys, exact, measured, digits=4):
    return df.select(*keys, *exact, *(digest(F.col(c), digits).alias(c) for c in measured))


def _measured(names, digits=4):
    return ", ".join(f"{D(c, digits)} as {c}" for c in names)


_RB = """w1 as (select *, row_number() over w as n, lag(close) over w as was from bars window w as (partition by instrument_id order by session_date)),
w2 as (select *, case when was is not null then greatest(high - low, abs(high - was), abs(low - was)) end as tr from w1),
w3 as (select *, max(high) over p60 as level, case when count(tr) over p14 >= 14 then avg(tr) over p14 end as atr, list(high) over p60 as highs from w2
  window p60 as (partition by instrument_id order by session_date rows between 60 preceding and 1 preceding), p14 as (partition by instrument_id order by session_date rows between 14 preceding and 1 preceding)),
w4 as (select * exclude (highs), len(list_filter(highs, lambda h: abs(h - level) <= level * 15e-3)) as touches from w3 where n > 60),
w5 as (select *, least(1e2, 100 * (65e-2 * least(touches / 4e0, 1) + 175e-3)) as confidence from w4),
rb as (select * exclude (was), lag(close) over (partition by instrument_id order by session_date) as was, least(2e-2, greatest(15e-4, coalesce(1e-1 * atr / level, 0)) * (16e-1 - 6e-1 * confidence / 100)) as tolerance from w5)
"""
register("b01_zone", lambda s, d: _digested(_rolling(s, d), KEY, ("touches",), ("level", "tolerance", "confidence"), 6), with_tables("bars", "with " + _RB + f"select instrument_id, session_date, touches, {_measured(('level', 'tolerance', 'confidence'), 6)} from rb"))
_G = ("threshold", "floor", "distance", "distance_atr")
register("b29_geometry", lambda s, d: _digested(B.geometry(_rolling(s, d)), KEY, ("contains",), _G),
         with_tables("bars", "with " + _RB + f", g as (select *, level * (1 + tolerance) as threshold, level * (1 - tolerance) as floor, (close - level) / level as distance, (close - level) / atr as distance_atr from rb) select instrument_id, session_date, close between floor and threshold as contains, {_measured(_G)} from g"))
_A = ("close_distance", "high_distance", "close_distance_atr", "approach_rate_atr", "compression_ratio", "approach_volume_ratio", "approach_score")
_AP = f"""ap as (select *, (level - close) / level as close_distance, (level - high) / level as high_distance, (level - close) / atr as close_distance_atr, (close - lag(close, 9) over w) / atr as approach_rate_atr,
  case when row_number() over w >= 30 then avg(high - low) over k10 / avg(high - low) over k30 end as compression_ratio, case when row_number() over w >= 30 then avg(volume) over k10 / avg(volume) over k30 end as approach_volume_ratio from rb
  window w as (partition by instrument_id order by session_date), k10 as (partition by instrument_id order by session_date rows 9 preceding), k30 as (partition by instrument_id order by session_date rows 29 preceding)),
aq as (select *, {ramp('close_distance_atr', '25e-1', '0')} as approach_score, coalesce(close_distance_atr <= 25e-1, true) and close_distance <= 12e-2 as is_approaching, coalesce(abs(close_distance_atr) <= 4e-1, false) or high between level * (1 - tolerance) and level * (1 + tolerance) as is_testing from ap)
"""
register("b03_approach", lambda s, d: _digested(B.approach(_rolling(s, d)), KEY, ("is_approaching", "is_testing"), _A), with_tables("bars", "with " + _RB + ", " + _AP + f"select instrument_id, session_date, is_approaching, is_testing, {_measured(_A)} from aq"))
_PN = ("close_above_atr", "penetration_atr", "extension_atr", "penetration_score", "extension_score")
_PF = ("touched", "penetrated", "closed_above", "gapped_above", "gap_class")
_PE = f"""pa as (select *, level * (1 + tolerance) as top, (close - level) / atr as close_above_atr, (close - level * (1 + tolerance)) / atr as penetration_atr, case when atr is not null then greatest(0, (close - level) / atr - 1) end as extension_atr, (open - was) / atr as gap from rb),
pe as (select *, high between level * (1 - tolerance) and top or level between low and high as touched, high > top as penetrated, close > top as closed_above, open > top and (was is null or was <= top) as gapped_above,
  case when gap is null or gap < 25e-2 then 'none' when gap < 1 then 'small' when gap < 2 then 'moderate' when gap < 4 then 'large' else 'extreme' end as gap_class,
  {ramp('penetration_atr', '0', '75e-2')} as penetration_score, {ramp('extension_atr', '3', '0')} as extension_score from pa)
"""
register("b04_penetration", lambda s, d: _digested(B.penetration(_rolling(s, d)), KEY, _PF, _PN), with_tables("bars", "with " + _RB + ", " + _PE + f"select instrument_id, session_date, {', '.join(_PF)}, {_measured(_PN)} from pe"))
_CN = ("close_location", "body_fraction", "upper_wick", "lower_wick", "range_over_atr", "candle_score")


def _candle(source: str) -> str:
    return f"""ca as (select *, coalesce((close - low) / nullif(high - low, 0), 1) as close_location, coalesce(abs(close - open) / nullif(high - low, 0), 1) as body_fraction, coalesce((high - greatest(open, close)) / nullif(high - low, 0), 0) as upper_wick,
  coalesce((least(open, close) - low) / nullif(high - low, 0), 0) as lower_wick, case when was is null then high - low else greatest(high - low, abs(high - was), abs(low - was)) end / atr as range_over_atr from {source}),
cb as (select *, {ramp('close_location', '25e-2', '85e-2')} * 45e-2 + {ramp('body_fraction', '0', '6e-1')} * 25e-2 + {ramp('upper_wick', '5e-1', '0')} * 15e-2 + coalesce({ramp('range_over_atr', '0', '15e-1')}, 50) * 15e-2 as candle_score from ca)
"""


register("b05_candle", lambda s, d: _digested(B.candle(_rolling(s, d)), KEY, (), _CN), with_tables("bars", "with " + _RB + ", " + _candle("rb") + f"select instrument_id, session_date, {_measured(_CN)} from cb"))
_VN = ("average_volume", "median_volume", "relative_volume", "volume_percentile", "up_volume_fraction", "volume_score")


def _volume(source: str) -> str:
    return f"""va as (select *, case when count(volume) over a20 >= 5 then avg(volume) over a20 end as average_volume, case when count(volume) over a20 >= 5 then median(volume) over a50 end as median_volume, list(volume) over a20 as seen,
  case when count(volume) over a20 >= 5 then sum(case when close >= open then volume else 0 end) over a20 / nullif(sum(volume) over a20, 0) end as up_volume_fraction from {source}
  window a20 as (partition by instrument_id order by session_date rows between 20 preceding and 1 preceding), a50 as (partition by instrument_id order by session_date rows between 50 preceding and 1 preceding)),
vb as (select *, volume / nullif(average_volume, 0) as relative_volume, case when len(seen) >= 5 then len(list_filter(seen, lambda q: q <= volume)) / len(seen)::double * 100 end as volume_percentile from va),
vc as (select *, {ramp('relative_volume', '7e-1', '18e-1')} as volume_score from vb)
"""


register("b06_volume", lambda s, d: _digested(B.volume_reading(_numbered(s, d)), KEY, (), _VN), with_tables("bars", "with " + _volume("bars") + f"select instrument_id, session_date, {_measured(_VN)} from vc"))
_RJ = f"""rj as (select *, close < level as closed_below, high > level * (1 + tolerance) and close < level and (upper_wick >= 5e-1 or close_location <= 35e-2) as rejected,
  {ramp('upper_wick', '0', '1')} * 4e-1 + {ramp('close_location', '1', '0')} * 35e-2 + coalesce({ramp('relative_volume', '5e-1', '15e-1')}, 50) * 25e-2 as score from vc)
"""
register("b09_rejection", lambda s, d: _digested(B.rejection(B.volume_reading(B.candle(_rolling(s, d)))).where("rejected or closed_below"), KEY, ("rejected", "closed_below"), ("rejection_score",)),
         with_tables("bars", "with " + _RB + ", " + _candle("rb") + ", " + _volume("cb") + ", " + _RJ + f"select instrument_id, session_date, rejected, closed_below, {D('case when rejected then score else 0 end')} as rejection_score from rj where rejected or closed_below"))


def _b10(s, d):
    x = B.approach(_rolling(s, d))
    return _digested(x.withColumns({"boundary_quality": B.boundary_quality(F.col("confidence"), F.col("touches")), "compression": B.compression_score(F.col("compression_ratio"))}), KEY, (), ("boundary_quality", "compression"))


_BQ = f"confidence * 4e-1 + {ramp('touches', '0', '5')} * 3e-1 + 12"
_CP = f"case when compression_ratio is null then 50 when compression_ratio < 45e-2 then {ramp('compression_ratio', '15e-2', '45e-2', 20)} when compression_ratio > 8e-1 then {ramp('compression_ratio', '14e-1', '8e-1', 20)} else 100 end"
register("b10_boundary_quality", _b10, with_tables("bars", "with " + _RB + ", " + _AP + f"select instrument_id, session_date, {D(_BQ)} as boundary_quality, {D(_CP)} as compression from aq"))


def _events(s, d, g=None):
    e = B.events_of(B.volume_reading(B.candle(B.penetration(_rolling(s, d, g)))))
    return e.withColumnsRenamed({"session_date": "event_date"}).withColumns({"breakout_close": F.col("close"), "breakout_volume": F.col("volume")})


_CARRIED = ("instrument_id", "event_date", "n", "level", "atr", "tolerance", "breakout_close", "breakout_volume")


def _after(s, d, most):
    return B.sessions_after(_events(s, d).select(*_CARRIED), _numbered(s, d), most)


_EV = _RB + ", " + _PE + ", " + _candle("pe") + ", " + _volume("cb") + """,
ea as (select *, coalesce(lag(closed_above) over (partition by instrument_id order by session_date), false) as before from vc),
ev as (select * exclude (session_date), session_date as event_date, close as breakout_close, volume as breakout_volume from ea where closed_above and not before),
nb as (select *, row_number() over (partition by instrument_id order by session_date) as n from bars)
"""


def _later(most: int) -> str:
    return f"af as (select e.instrument_id, e.event_date, e.level, e.atr, e.tolerance, e.breakout_close, e.breakout_volume, b.n - e.n as k, b.session_date, b.high, b.low, b.close, b.volume from ev e join nb b on b.instrument_id = e.instrument_id and b.n between e.n + 1 and e.n + {most})"


_AC = f"""ac as (select instrument_id, event_date, count(*) as sessions, count(*) filter (close > level * (1 + tolerance)) as closes_above, max(k) - coalesce(max(k) filter (not (close > level * (1 + tolerance))), 0) as consecutive, avg((close - level) / atr) as mean_above_atr, avg((high - low) / atr) as range_ratio from af group by 1, 2),
ad as (select *, {ramp('consecutive', '0', '4')} as acceptance_score from ac)
"""
_FT = f"""fa as (select instrument_id, event_date, count(*) as sessions, (max(close) - max(breakout_close)) / max(atr) as progress_atr, greatest(0, (max(breakout_close) - min(low)) / max(atr)) + 0 * max(atr) as adverse_atr, count(*) filter (close > breakout_close) as higher_closes,
  avg(high - low) / max(atr) as range_expansion, avg(volume) / nullif(max(breakout_volume), 0) as volume_hold from af group by 1, 2),
fb as (select *, coalesce({ramp('progress_atr', '0', '1')}, 50) * 4e-1 + coalesce({ramp('adverse_atr', '1', '0')}, 50) * 25e-2 + coalesce({ramp('range_expansion', '0', '12e-1')}, 50) * 15e-2 + coalesce({ramp('volume_hold', '0', '7e-1')}, 50) * 2e-1 as follow_score from fa)
"""
_RT = f"""ra as (select *, min(k) filter (close < breakout_close and case when atr > 0 then (breakout_close - close) / atr >= 5e-1 else close < breakout_close * 98e-2 end) over (partition by instrument_id, event_date) as begins from af),
rc as (select *, first_value(k) over (partition by instrument_id, event_date order by low, k) as low_k from ra where k >= begins),
rd as (select instrument_id, event_date, min(session_date) as started, min(low) as low, coalesce(greatest(0, max(level - low) / max(atr)) + 0 * max(atr), 0) as undercut_atr, count(*) as sessions, count(*) filter (close < level) as sessions_below, avg(volume) / nullif(max(breakout_volume), 0) as volume_ratio,
  avg((high - low) / atr) as range_ratio, count(*) filter (k >= low_k and close > level) as recovery_closes, min(session_date) filter (k >= low_k and close > level) as recovered from rc group by 1, 2),
re as (select *, undercut_atr > 6e-1 or sessions_below > 3 as failed, sessions > 25 as expired, {ramp('undercut_atr', '6e-1', '0', 10)} * case when sessions_below > 3 then 5e-1 else 1 end * 3e-1 + coalesce({ramp('volume_ratio', '15e-1', '45e-2', 5)}, 50) * 25e-2
  + coalesce({ramp('range_ratio', '2', '6e-1', 5)}, 50) * 15e-2 + {ramp('recovery_closes', '0', '1')} * 3e-1 as retest_quality from rd)
"""
_AN, _FN, _RN = ("mean_above_atr", "range_ratio", "acceptance_score"), ("progress_atr", "adverse_atr", "range_expansion", "volume_hold", "follow_score"), ("low", "undercut_atr", "volume_ratio", "range_ratio", "retest_quality")
register("b07_acceptance", lambda s, d: _digested(B.acceptance(_after(s, d, 10)), EVENT, ("sessions", "closes_above", "consecutive"), _AN), with_tables("bars", "with " + _EV + ", " + _later(10) + ", " + _AC + f"select instrument_id, event_date, sessions, closes_above, consecutive, {_measured(_AN)} from ad"))
register("b08_follow_through", lambda s, d: _digested(B.follow_through(_after(s, d, 10)), EVENT, ("sessions", "higher_closes"), _FN), with_tables("bars", "with " + _EV + ", " + _later(10) + ", " + _FT + f"select instrument_id, event_date, sessions, higher_closes, {_measured(_FN)} from fb"))
_RX = ("started", "sessions", "sessions_below", "recovery_closes", "recovered", "failed", "expired")
register("b11_retest", lambda s, d: _digested(B.retest(_after(s, d, 30)), EVENT, _RX, _RN), with_tables("bars", "with " + _EV + ", " + _later(30) + ", " + _RT + f"select instrument_id, event_date, {', '.join(_RX)}, {_measured(_RN)} from re"))


def _strength(s, d, g=None):
    bench = frame(s, d, "benchmarks", g).where("benchmark_id = 101").select("session_date", digest(F.col("close"), 5).alias("bench"))
    return B.strength_at(frame(s, d, "bars", g).join(bench, "session_date"))


_SF = ("near_rs_high", "rs_high_before_price", "rs_high_with_price")
_SA = f"""sa as (select b.instrument_id, b.session_date, b.close, b.close / m.bench as ratio from bars b join (select session_date, {D('close', 5)} as bench from benchmarks where benchmark_id = 101) m using (session_date)),
sb as (select *, row_number() over w as n, list(ratio) over k as seen, max(ratio) over k as top, max(close) over k as high from sa window w as (partition by instrument_id order by session_date), k as (partition by instrument_id order by session_date rows 59 preceding)),
sc as (select instrument_id, session_date, case when n >= 10 then len(list_filter(seen, lambda q: q <= ratio)) / len(seen)::double * 100 end as rs_percentile, ratio >= top * 98e-2 as near_rs_high, ratio >= top - 1e-12 and not close >= high - 1e-12 as rs_high_before_price, ratio >= top - 1e-12 and close >= high - 1e-12 as rs_high_with_price from sb),
sd as (select *, case when rs_percentile is not null then least(100, rs_percentile + case when rs_high_before_price then 20 when rs_high_with_price then 10 when near_rs_high then 5 else 0 end) end as rs_score from sc)
"""
register("b12_relative_strength", lambda s, d: _digested(_strength(s, d), KEY, _SF, ("rs_percentile", "rs_score")), with_tables("bars benchmarks", "with " + _SA + f"select instrument_id, session_date, {', '.join(_SF)}, {_measured(('rs_percentile', 'rs_score'))} from sd"))


def _quality(s, d, g=None, events=None):
    e = (_events(s, d, g) if events is None else events).join(_strength(s, d, g).select("instrument_id", F.col("session_date").alias("event_date"), "rs_score"), ["instrument_id", "event_date"], "left")
    none = F.lit(None).cast("double")
    x = B.breakout_quality(e, B.boundary_quality(F.col("confidence"), F.col("touches")), F.col("rs_score"), none, none)
    return x.withColumn("identification", B.identification_confidence(x))


_QP = {"c1": (_BQ, "16e-2"), "c2": ("penetration_score * 65e-2 + extension_score * 35e-2", "16e-2"), "c3": ("candle_score", "22e-2"), "c4": ("volume_score", "24e-2"), "c5": ("rs_score", "1e-1")}
_QU = f"""qa as (select ev.*, rs_score from ev left join sd on sd.instrument_id = ev.instrument_id and sd.session_date = ev.event_date),
qb as (select *, {', '.join(f'{x} as {n}' for n, (x, _) in _QP.items())} from qa),
qc as (select *, ({' + '.join(f'coalesce({n} * {w}, 0)' for n, (_, w) in _QP.items())}) / nullif({' + '.join(f'case when {n} is not null then {w} else 0 end' for n, (_, w) in _QP.items())}, 0) as quality,
  ({' + '.join(f'case when {n} is not null then {w} else 0 end' for n, (_, w) in _QP.items())}) * 100 as coverage, list_filter([{', '.join(_QP)}], lambda q: q is not null) as have from qb),
qd as (select *, concat_ws(',', case when c1 >= 70 then 'boundary' end, case when penetration_score >= 70 then 'cleared' end, case when close_location >= 8e-1 then 'closed_high' end, case when relative_volume >= 15e-1 then 'volume' end) as supporting,
  concat_ws(',', case when c1 < 50 then 'boundary' end, case when extension_score < 50 then 'extended' end, case when close_location <= 4e-1 then 'closed_low' end, case when relative_volume < 1 then 'volume' end) as contradicting,
  case when len(have) >= 2 then greatest(least(100 - 2 * sqrt(list_sum(list_transform(have, lambda q: (q - list_avg(have)) * (q - list_avg(have)))) / len(have)), 100), 0) else 50 end as agreement from qc),
qe as (select *, greatest(least(confidence * 2e-1 + least(100, touches * 25) * 6e-1 * 15e-2 + 6 + coverage * 2e-1 + case when penetration_atr is null then case when closed_above then 60 else 30 end else greatest(least(penetration_atr / 5e-1, 1), 0) * 100 end * 15e-2 + agreement * 15e-2, 100), 0) as identification from qd)
"""
_QT = "bars benchmarks"
register("b13_breakout_quality", lambda s, d: _digested(_quality(s, d).withColumns({"supporting": F.array_join("supporting", ","), "contradicting": F.array_join("contradicting", ",")}), EVENT, ("supporting", "contradicting"), ("quality", "coverage")),
         with_tables(_QT, "with " + _EV + ", " + _SA + ", " + _QU + f"select instrument_id, event_date, supporting, contradicting, {_measured(('quality', 'coverage'))} from qd"))
register("b15_identification", lambda s, d: _digested(_quality(s, d), EVENT, (), ("identification",)), with_tables(_QT, "with " + _EV + ", " + _SA + ", " + _QU + f"select instrument_id, event_date, {D('identification')} as identification from qe"))


def _confirmed(s, d):
    keys = ["instrument_id", "event_date"]
    g = once(s, d, "bars", "benchmarks")
    events = staged_file(_events(s, d, g))
    later = B.sessions_after(events.select(*_CARRIED), _numbered(s, d, g), 30)
    after = later.where("k <= 10")
    out = _quality(s, d, g, events).select(*keys, "quality", "relative_volume").join(B.acceptance(after).drop("sessions"), keys, "left").join(B.follow_through(after), keys, "left").join(B.retest(later).select(*keys, "retest_quality", "recovered"), keys, "left")
    return B.confirmation_path(B.confirmation(out.withColumn("rs_after", F.lit(None).cast("double"))))


_CW = {"acceptance_score": "3e-1", "follow_score": "3e-1", "persistence": "15e-2", "retest_quality": "15e-2"}
_CO = f"""ga as (select qd.instrument_id, qd.event_date, quality, relative_volume, closes_above, consecutive, ad.range_ratio, acceptance_score, fb.sessions, follow_score, {ramp('volume_hold', '4e-1', '1')} as persistence, retest_quality, recovered
  from qd left join ad using (instrument_id, event_date) left join fb using (instrument_id, event_date) left join re using (instrument_id, event_date)),
gb as (select *, coalesce(({' + '.join(f'coalesce({n} * {w}, 0)' for n, w in _CW.items())}) / nullif({' + '.join(f'case when {n} is not null then {w} else 0 end' for n, w in _CW.items())}, 0), 0) as confirmation, ({' + '.join(f'case when {n} is not null then {w} else 0 end' for n, w in _CW.items())}) * 100 as confirmation_coverage from ga),
gc as (select *, closes_above >= 1 and quality >= 60 and relative_volume >= 13e-1 and sessions >= 2 and follow_score >= 55 as m, retest_quality >= 55 and recovered is not null as r, consecutive >= 4 and not coalesce(range_ratio > 1, false) as a from gb)
"""


def _co(most_retest: str) -> str:
    second = _later(30).replace("af as (", "af30 as (", 1)
    return "with " + _EV + ", " + _SA + ", " + _QU + ", " + _later(10) + ", " + second + ", " + _AC + ", " + _FT + ", " + _RT.replace(" from af)", " from af30)", 1) + ", " + _CO + most_retest


register("b14_confirmation", lambda s, d: _digested(_confirmed(s, d), EVENT, (), ("confirmation", "confirmation_coverage")), with_tables(_QT, _co(f"select instrument_id, event_date, {_measured(('confirmation', 'confirmation_coverage'))} from gb")))
register("b16_confirmation_path", lambda s, d: _confirmed(s, d).select(*EVENT, "path"), with_tables(_QT, _co("select instrument_id, event_date, case when confirmation_coverage >= 50 then case when coalesce(m, false) then 'momentum' when coalesce(r, false) then 'retest' when coalesce(a, sessions is null and false) then 'acceptance' else 'none' end end as path from gc")))


def _b28(s, d):
    e = frame(s, d, "earnings").select(F.col("instrument_id").alias("_i"), "scheduled_date", "knowledge_time")
    x = _events(s, d).select("instrument_id", "event_date")
    known = (F.col("instrument_id") == F.col("_i")) & (F.col("knowledge_time") <= F.col("event_date").cast("timestamp")) & (F.col("scheduled_date") >= F.col("event_date"))
    return x.join(e, known, "left").groupBy("instrument_id", "event_date").agg(F.min("scheduled_date").alias("next_earnings")).withColumn("days", F.datediff("next_earnings", "event_date")).withColumn("near", F.coalesce(F.col("days") <= 10, F.lit(False)))


register("b23_evidence", lambda s, d: B.evidence_bundle(_confirmed(s, d)).select(*EVENT, F.array_join("has", ",").alias("has"), F.array_join("lacks", ",").alias("lacks"), "complete"),
         with_tables(_QT, _co("select instrument_id, event_date, concat_ws(',', case when quality is not null then 'quality' end, case when acceptance_score is not null then 'acceptance' end, case when follow_score is not null then 'follow_through' end, case when persistence is not null then 'volume' end, case when retest_quality is not null then 'retest' end) as has, concat_ws(',', case when quality is null then 'quality' end, case when acceptance_score is null then 'acceptance' end, case when follow_score is null then 'follow_through' end, case when persistence is null then 'volume' end, case when retest_quality is null then 'retest' end, 'relative_strength') as lacks, false as complete from gb")))
register("b28_earnings_proximity", _b28, with_tables("bars earnings", "with " + _EV + "select ev.instrument_id, ev.event_date, min(scheduled_date) as next_earnings, (min(scheduled_date) - ev.event_date)::int as days, coalesce(min(scheduled_date) - ev.event_date <= 10, false) as near from ev left join earnings e on e.instrument_id = ev.instrument_id and e.knowledge_time <= ev.event_date::timestamp and e.scheduled_date >= ev.event_date group by 1, 2"))
register("b31_merged_evidence", lambda s, d: _quality(s, d).select(*EVENT, F.array_join(B.merge_evidence(F.array("contradicting", "supporting", "contradicting")), ",").alias("evidence")),
         with_tables(_QT, "with " + _EV + ", " + _SA + ", " + _QU + "select instrument_id, event_date, array_to_string(list_filter(list_concat(string_split(contradicting, ','), list_filter(string_split(supporting, ','), lambda q: not list_contains(string_split(contradicting, ','), q))), lambda q: q <> ''), ',') as evidence from qd"))
register("b32_atr", lambda s, d: X.recursive_features(frame(s, d, "bars")).groupBy("instrument_id").agg(F.max_by("atr_14", "session_date").alias("atr")).select("instrument_id", digest(F.col("atr"), 6).alias("atr")),
         with_tables("bars", f"with w1 as (select *, row_number() over w as i, lag(close) over w as was, count(*) over (partition by instrument_id) as n from bars window w as (partition by instrument_id order by session_date)), w2 as (select *, greatest(high - low, abs(high - was), abs(low - was)) as tr from w1 where was is not null) select instrument_id, {D('case when max(n) >= 15 then avg(tr) filter (i <= 15) * power(13 / 14e0, max(n) - 15) + coalesce(sum(tr / 14 * power(13 / 14e0, n - i)) filter (i > 15), 0) end', 6)} as atr from w2 group by 1"))
