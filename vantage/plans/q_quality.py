"""Queries over data quality and corporate-action reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.functions.scalar import digest, digest_sql
from vantage.operators import quality as Q
from vantage.registry import register
from vantage.sources.fixtures import frame, with_tables

_FIRST, _LAST = "1996-01-01", "2001-12-31"


def _a():
    return F.lit(_FIRST).cast("date")


def _z():
    return F.lit(_LAST).cast("date")



def _find(name, fn, sql, tables="dirty_bars"):
    register(name, fn, with_tables(tables, sql))


def _bars(s, d):
    return frame(s, d, "dirty_bars")


def _f(check, severity, detail="''"):
    return f"select '{check}' as \"check\", {severity} as severity, instrument_id, session_date, cast({detail} as varchar) as detail"


_DUP = _f("duplicate", "case when k = 1 then 'INFO' else 'REJECT' end", "n") + " from (select instrument_id, session_date, count(*) as n, count(distinct (open, high, low, close, volume)) as k from dirty_bars group by 1, 2) x where n > 1"
_OHLC = _f("ohlc", "'REJECT'") + " from dirty_bars where high < greatest(open, close, low) or low > least(open, close, high)"
_POS = _f("price_not_positive", "'REJECT'", "concat_ws(',', case when open <= 0 then 'open' end, case when high <= 0 then 'high' end, case when low <= 0 then 'low' end, case when close <= 0 then 'close' end)") + " from dirty_bars where open <= 0 or high <= 0 or low <= 0 or close <= 0"
_VOL = _f("volume_range", "'REJECT'") + " from dirty_bars where volume < 0 or volume > 1e11"


def _run(check, same, keep, least):
    return _f(check, "'WARN'", "n") + f""" from (select instrument_id, r, min(session_date) as session_date, count(*) as n from (
select *, sum(case when i > 1 and s is not distinct from p then 0 else 1 end) over (partition by instrument_id order by session_date, line) as r from (
select *, {same} as s, lag({same}) over w as p, row_number() over w as i from dirty_bars window w as (partition by instrument_id order by session_date, line)) a) b where {keep} group by 1, 2) c where n >= {least}"""


_ZERO = _run("zero_volume_run", "volume = 0", "volume = 0", 3)
_STALE = _run("stale_price", "(open, high, low, close)", "true", 5)
_SPIKE = _f("volume_spike", "'WARN'") + " from dirty_bars join (select instrument_id, median(volume) as m from dirty_bars where volume > 0 group by 1) y using (instrument_id) where volume > 50 * m"
_MOVES = "select d.*, close / was - 1 as move, s.ratio from (select *, lag(close) over (partition by instrument_id order by session_date, line) as was from dirty_bars) d left join splits s on s.instrument_id = d.instrument_id and s.ex_date = d.session_date where was > 0 and close > 0"
_JUMP = _f("unexplained_jump", "'WARN'") + f" from ({_MOVES}) m where abs(move) >= 5e-1 and ratio is null"
_STILL = _f("split_without_move", "'WARN'") + f" from ({_MOVES}) m where ratio is not null and abs((1 + move) * ratio - 1) > 25e-2"
_EXT = _f("extreme_move", "'WARN'") + " from (select *, lag(close) over (partition by instrument_id order by session_date, line) as was from dirty_bars) d where was > 0 and abs(close / was - 1) > 8e-1"
_ALL = " union all ".join((_DUP, _OHLC, _POS, _VOL, _ZERO, _SPIKE, _STALE, _JUMP, _STILL, _EXT))

_find("q01_duplicates", lambda s, d: Q.duplicates(_bars(s, d)), _DUP)
_find("q02_ohlc", lambda s, d: Q.ohlc(_bars(s, d)), _OHLC)
_find("q03_positive_prices", lambda s, d: Q.positive_prices(_bars(s, d)), _POS)
_find("q04_volume", lambda s, d: Q.volume(_bars(s, d)), " union all ".join((_VOL, _ZERO, _SPIKE)))
_find("q05_timestamps", lambda s, d: Q.timestamps(frame(s, d, "bar_facts").withColumn("knowledge_time", F.when(F.col("instrument_id") == 7, F.col("event_time") - F.expr("interval 1 hour")).otherwise(F.col("knowledge_time"))), F.lit("2001-06-01").cast("timestamp")),
      _f("known_before_event", "'REJECT'") + " from bar_facts where instrument_id = 7 union all " + _f("future_event", "'REJECT'") + " from bar_facts where event_time > timestamp '2001-06-01'", "bar_facts")
_MISS = """with span as (select instrument_id, min(session_date) as a, max(session_date) as b from gappy_bars group by 1),
m as (select s.instrument_id, c.session_date, c.session_ord from span s join calendar c on c.session_date between a and b where not exists (select 1 from gappy_bars g where g.instrument_id = s.instrument_id and g.session_date = c.session_date)),
r as (select instrument_id, session_ord - row_number() over (partition by instrument_id order by session_ord) as g from m),
n as (select instrument_id, g, count(*) as n from r group by 1, 2),
p as (select instrument_id, sum(n)::bigint as missing, max(n) as longest, count(*) filter (n >= 21) as st, count(*) filter (n < 21) as sc from n group by 1)
"""
_find("q06_missing_sessions", lambda s, d: Q.missing_sessions(frame(s, d, "gappy_bars"), frame(s, d, "calendar")), _MISS + "select * from m", "gappy_bars")
_find("q07_action_cross_check", lambda s, d: Q.moves(_bars(s, d), frame(s, d, "splits")), _JUMP + " union all " + _STILL, "dirty_bars splits")
_find("q08_extreme_moves", lambda s, d: Q.extreme_moves(_bars(s, d)), _EXT)
_find("q09_stale_prices", lambda s, d: Q.stale_prices(_bars(s, d)), _STALE)
_find("q10_mapping_overlaps", lambda s, d: Q.mapping_overlaps(frame(s, d, "mappings")), """
with p as (select a.instrument_id as first_id, b.instrument_id as second_id, a.ticker as first_ticker, b.ticker as second_ticker from mappings a join mappings b
  on a.valid_from < coalesce(b.valid_to, date '9999-12-31') and b.valid_from < coalesce(a.valid_to, date '9999-12-31'))
select 'shared_ticker' as kind, * from p where first_ticker = second_ticker and first_id < second_id union all select 'two_tickers', * from p where first_id = second_id and first_ticker < second_ticker""", "mappings")
_find("q11_report", lambda s, d: Q.report(_bars(s, d), frame(s, d, "splits")).groupBy("check", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("instrument_id").alias("instruments")),
      f'select "check", severity, count(*) as n, count(distinct instrument_id) as instruments from ({_ALL}) z group by 1, 2', "dirty_bars splits")
_find("q11_blocking", lambda s, d: Q.blocking(Q.report(_bars(s, d), frame(s, d, "splits"))), f"select instrument_id, count(*) as rejections from ({_ALL}) z where severity = 'REJECT' group by 1", "dirty_bars splits")
_find("q12_gap_shape", lambda s, d: Q.gap_shape(frame(s, d, "gappy_bars"), frame(s, d, "calendar")),
      _MISS + "select i.instrument_id, coalesce(missing, 0) as missing, coalesce(longest, 0) as longest, case when missing is null then 'complete' when st = 0 then 'scattered' when sc = 0 then 'structural' else 'mixed' end as shape from (select distinct instrument_id from gappy_bars) i left join p using (instrument_id)", "gappy_bars")

_find("c02_cumulative_factor", lambda s, d: Q.reconstructed(frame(s, d, "bars"), frame(s, d, "splits")).select("instrument_id", "session_date", digest(F.col("factor"), 6).alias("factor")),
      f"select b.instrument_id, b.session_date, {digest_sql('coalesce((select product(ratio) from splits s where s.instrument_id = b.instrument_id and s.ex_date > b.session_date), 1.0)', 6)} as factor from bars b", "bars splits")
_find("c03_reconstructed", lambda s, d: Q.reconstructed(frame(s, d, "bars"), frame(s, d, "splits")).where("factor <> 1").select("instrument_id", "session_date", digest(F.col("raw_close"), 3).alias("raw_close")),
      f"with f as (select b.*, coalesce((select product(ratio) from splits s where s.instrument_id = b.instrument_id and s.ex_date > b.session_date), 1.0) as factor from bars b) select instrument_id, session_date, {digest_sql('close * factor', 3)} as raw_close from f where factor <> 1", "bars splits")


def _both(s, d):
    return frame(s, d, "splits").select("instrument_id", "ex_date", "ratio").unionByName(frame(s, d, "splits_other"))


_find("c04_schedule_consistency", lambda s, d: Q.schedule_consistency(_both(s, d), _a(), _z()), f"""
with u as (select instrument_id, ex_date, ratio from splits union all select * from splits_other),
g as (select instrument_id, ex_date, cast(count(*) as int) as n, count(distinct ratio) as k, min(ratio) as lo, max(ratio) as hi from u group by 1, 2),
p as (select instrument_id, ex_date, n, concat_ws(',', case when n > 1 and k = 1 then 'duplicate' end, case when k > 1 and abs(lo * hi - 1) <= 1e-6 then 'reciprocal' end, case when k > 1 then 'conflict' end,
  case when hi > 1000 or lo < 1e-3 then 'implausible' end, case when ex_date < date '{_FIRST}' or ex_date > date '{_LAST}' then 'outside' end) as problems from g)
select * from p where problems <> ''""", "splits splits_other")
_find("c05_census", lambda s, d: Q.census(_both(s, d), frame(s, d, "first_sessions")), """
with u as (select instrument_id, ex_date from splits union all select instrument_id, ex_date from splits_other)
select instrument_id, count(*) as total, count(*) filter (ex_date < first_date) as before, count(*) filter (ex_date between first_date and last_date) as inside, count(*) filter (ex_date > last_date) as "after" from u join first_sessions using (instrument_id) group by 1""", "splits_other")
_find("c06_compare_schedules", lambda s, d: Q.compare_schedules(frame(s, d, "splits"), frame(s, d, "splits_other"), _a(), _z()), f"""
select instrument_id, ex_date, a.ratio as a, b.ratio as b, case when ex_date < date '{_FIRST}' or ex_date > date '{_LAST}' then 'outside_coverage' when b.ratio is null then 'missing_from_second' when a.ratio is null then 'missing_from_first'
  when abs(a.ratio / b.ratio - 1) <= 1e-6 then 'agree' when abs(a.ratio * b.ratio - 1) <= 1e-6 then 'reciprocal' else 'conflict' end as status
from splits a full outer join splits_other b using (instrument_id, ex_date)""", "splits splits_other")
_find("c01_multiplier", lambda s, d: frame(s, d, "splits").withColumn("convention", F.when(F.col("instrument_id") % 8 == 0, "old_per_new").otherwise("new_per_old")).select("instrument_id", "ex_date", "convention", digest(Q.multiplier(F.col("ratio"), F.col("convention")), 6).alias("multiplier")),
      f"select instrument_id, ex_date, case when instrument_id % 8 = 0 then 'old_per_new' else 'new_per_old' end as convention, {digest_sql('case when instrument_id % 8 = 0 then 1 / ratio else ratio end', 6)} as multiplier from splits", "splits")
