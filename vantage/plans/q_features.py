"""Queries over time buckets and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.functions.scalar import digest, digest_sql
from vantage.operators import bars as B
from vantage.operators import features as X
from vantage.registry import register
from vantage.sources.fixtures import frame, once, with_tables

AS_OF = "2001-06-13"


def _on():
    return F.lit(AS_OF).cast("date")



def _sql_periods(unit: str) -> str:
    return f"""with e as (select cast(date_trunc('{unit}', session_date) as date) as period_start, max(session_date) as scheduled_end from calendar group by 1),
f as (select instrument_id, cast(date_trunc('{unit}', session_date) as date) as period_start, arg_min(open, session_date) as open, max(high) as high, min(low) as low,
  arg_max(close, session_date) as close, sum(volume) as volume, count(*) as n_sessions, max(session_date) as period_end from bars group by 1, 2),
p as (select f.*, scheduled_end <= date '{AS_OF}' as complete from f join e using (period_start))
"""


_COLS = "instrument_id, period_start, open, high, low, close, volume, n_sessions, period_end"


def _periods(spark, d, timeframe):
    return B.aggregate_daily(frame(spark, d, "bars"), frame(spark, d, "calendar"), timeframe, _on())


for _name, _tf, _unit in (("t01_weekly", "1w", "week"), ("t01_monthly", "1mo", "month")):
    register(_name, lambda s, d, tf=_tf: _periods(s, d, tf).select(*_COLS.split(", "), "complete"), with_tables("bars calendar", _sql_periods(_unit) + f"select {_COLS}, complete from p"))
register(
    "t02_completeness",
    lambda s, d: _periods(s, d, "1mo").groupBy("period_start", "scheduled_end", "complete").agg(F.count(F.lit(1)).alias("n")),
    with_tables("bars calendar", _sql_periods("month").replace("scheduled_end <=", "scheduled_end, scheduled_end <=") + "select period_start, scheduled_end, complete, count(*) as n from p group by 1, 2, 3"),
)
register("t03_completed_only", lambda s, d: B.completed_only(_periods(s, d, "1w")).select(*_COLS.split(", ")), with_tables("bars calendar", _sql_periods("week") + f"select {_COLS} from p where complete"))
register(
    "t04_intraday",
    lambda s, d: B.aggregate_intraday(frame(s, d, "ticks"), 240).select("instrument_id", "session_date", "bucket", "open", "high", "low", "close", "volume"),
    with_tables("ticks", """
with b as (select *, cast(floor((epoch_us(event_time) - 1 - epoch_us(cast(session_date as timestamp))) / (240 * 60000000.0::double)) as int) as bucket from ticks)
select instrument_id, session_date, bucket, arg_min(price, (event_time, event_id)) as open, max(price) as high, min(price) as low, arg_max(price, (event_time, event_id)) as close, sum(volume) as volume
from b group by 1, 2, 3"""),
)
register(
    "t05_align_to_daily",
    lambda s, d: B.align_to_daily(frame(s, d, "bars"), _periods(s, d, "1w")).select("instrument_id", "session_date", "ended", "higher_close"),
    with_tables("bars calendar", _sql_periods("week") + """select b.instrument_id, b.session_date, p.period_end as ended, p.close as higher_close
from bars b asof left join (select * from p where complete) p on p.instrument_id = b.instrument_id and p.period_end <= b.session_date"""),
)
register(
    "t07_two_timeframes",
    lambda s, d: B.completed_only(_periods(s, d, "1w")).withColumn("timeframe", F.lit("1w")).unionByName(B.completed_only(_periods(s, d, "1mo")).withColumn("timeframe", F.lit("1mo"))).select("instrument_id", "timeframe", "period_end", "close"),
    with_tables("bars calendar", _sql_periods("week") + ", " + _sql_periods("month").replace("with e as", "e2 as").replace("f as (", "f2 as (", 1).replace("p as (", "p2 as (", 1).replace("select f.*", "select f2.*").replace("from f join e using", "from f2 join e2 using")
                + "select instrument_id, '1w' as timeframe, period_end, close from p where complete union all select instrument_id, '1mo', period_end, close from p2 where complete"),
)
register(
    "t08_no_future",
    lambda s, d: B.no_future(B.completed_only(_periods(s, d, "1mo")), _on()),
    with_tables("bars calendar", _sql_periods("month") + f"select coalesce(bool_and(period_end <= date '{AS_OF}'), true) as causal, count(*) as n_bars from p where complete"),
)
_CURVE = """with v as (select instrument_id, session_date, cast(floor((epoch(event_time) - epoch(cast(session_date as timestamp))) / 3600.0::double) as int) as bucket, sum(volume) as v from ticks group by 1, 2, 3),
g as (select d.instrument_id, d.session_date, h as bucket, coalesce(v.v, 0) as v from (select distinct instrument_id, session_date from v) d cross join (select unnest(range(24))::int as h) left join v on v.instrument_id = d.instrument_id and v.session_date = d.session_date and v.bucket = h),
c as (select *, sum(v) over (partition by instrument_id, session_date order by bucket) / sum(v) over (partition by instrument_id, session_date) as f from g),
a as (select instrument_id, bucket, avg(f) as m, count(*) as n_sessions from c group by 1, 2 having count(*) >= 3),
k as (select instrument_id, bucket, n_sessions, case when bucket = 23 then 1.0::double else max(m) over (partition by instrument_id order by bucket) end as share from a)
"""
register(
    "t09_volume_curve",
    lambda s, d: B.volume_curve(frame(s, d, "ticks")).select("instrument_id", "bucket", "n_sessions", digest(F.col("share")).alias("share")),
    with_tables("ticks", _CURVE + f"select instrument_id, bucket, n_sessions, {digest_sql('share')} as share from k"),
)


def _t10(s, d):
    asked = frame(s, d, "ticks").select("instrument_id").distinct().select("instrument_id", F.explode(F.array(F.lit(90), F.lit(615), F.lit(1290))).alias("minute"))
    return B.expected_fraction(asked, B.volume_curve(frame(s, d, "ticks"))).select("instrument_id", "minute", digest(F.col("expected")).alias("expected"))


register("t10_expected_fraction", _t10, with_tables("ticks", _CURVE + f"""
select x.instrument_id, x.minute, {digest_sql('coalesce(l.share, 0) + (h.share - coalesce(l.share, 0)) * (x.minute / 60.0::double - floor(x.minute / 60.0::double))')} as expected
from (select distinct instrument_id, m as minute from ticks cross join (values (90), (615), (1290)) v(m)) x
join k h on h.instrument_id = x.instrument_id and h.bucket = x.minute // 60 left join k l on l.instrument_id = x.instrument_id and l.bucket = x.minute // 60 - 1"""))


# Features: (query, {column: (expression over the stages before it, SQL, digits)})
def _t(n: int) -> str:
    return f"over (partition by instrument_id order by session_date rows between {n - 1} preceding and current row)"


def _p(n: int) -> str:
    return f"over (partition by instrument_id order by session_date rows between {n} preceding and 1 preceding)"


def _w(n: int, x: str) -> str:
    return f"case when row_number() over w >= {n} then {x} end"


def _lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) over w"


_TR = f"case when {_lag('close')} is not null then greatest(high - low, abs(high - {_lag('close')}), abs(low - {_lag('close')})) end"
_TP = "(high + low + close) / 3"


def _feature(name: str, stages: list[tuple[str, object, str]], out: str, digits: int = 4) -> None:
    """Stages are (column, Column factory, SQL), each over those before; ``out`` names the result."""

    def query(spark, d):
        df = frame(spark, d, "bars")
        for column, make, _ in stages:
            df = df.withColumn(column, make())
        return df.select("instrument_id", "session_date", digest(F.col(out), digits).alias("value"))

    head = "bars"
    ctes = []
    for i, (column, _, sql) in enumerate(stages):
        ctes.append(f"x{i} as (select *, {sql} as {column} from {head} window w as (partition by instrument_id order by session_date))")
        head = f"x{i}"
    register(name, query, with_tables("bars", "with " + ",\n".join(ctes) + f"\nselect instrument_id, session_date, {digest_sql(out, digits)} as value from {head}"))


_feature("i01_sma", [("y", lambda: X.sma(F.col("close"), 20), _w(20, f"sum(close) {_t(20)} / 20"))], "y")
_feature("i06_rate_of_change", [("y", lambda: X.rate_of_change(F.col("close"), 60), f"close / {_lag('close', 60)} - 1")], "y", 6)
_feature("i07_true_range", [("y", X.true_range, _TR)], "y")
_feature("i09_realized_volatility", [("r", X.log_return, f"ln(close / {_lag('close')})"), ("y", lambda: X.realized_volatility(F.col("r"), 20), f"case when count(r) {_t(20)} >= 20 then stddev_samp(r) {_t(20)} * sqrt(252) end")], "y", 6)
_feature("i10_bollinger", [("y", lambda: X.bollinger(F.col("close"))["bandwidth"], _w(20, f"4 * stddev_pop(close) {_t(20)} / avg(close) {_t(20)}"))], "y", 6)
_feature("i12_typical_price", [("y", X.typical_price, _TP)], "y", 3)
_feature("i13_on_balance_volume", [("s", X.on_balance_step, f"coalesce(sign(close - {_lag('close')}) * volume, 0)"), ("y", lambda: F.sum("s").over(X.series()), "sum(s) over w")], "y", 0)
_feature("i14_relative_volume", [("y", lambda: X.relative_volume(20), _w(21, f"volume / avg(volume) {_p(20)}"))], "y")
_feature("i15_dollar_volume", [("y", lambda: X.average_dollar_volume(20), _w(20, f"avg({_TP} * volume) {_t(20)}"))], "y", 2)
_feature("i16_vwap", [("y", lambda: X.rolling_vwap(20), _w(20, f"sum({_TP} * volume) {_t(20)} / sum(volume) {_t(20)}"))], "y")
_feature("i18_rolling_extremes", [("h", lambda: X.rolling_max(F.col("high"), 60), _w(60, f"max(high) {_t(60)}")), ("l", lambda: X.rolling_min(F.col("low"), 60), _w(60, f"min(low) {_t(60)}")), ("y", lambda: F.col("h") - F.col("l"), "h - l")], "y")
_feature("i19_distance", [("m", lambda: X.sma(F.col("close"), 50), _w(50, f"sum(close) {_t(50)} / 50")), ("y", lambda: X.distance_from(F.col("close"), F.col("m")), "case when m > 0 then close / m - 1 end")], "y", 6)
_feature("i20_slope", [("m", lambda: X.sma(F.col("close"), 50), _w(50, f"sum(close) {_t(50)} / 50")), ("y", lambda: X.slope(F.col("m"), 10), f"(m / {_lag('m', 10)} - 1) / 10")], "y", 6)
_feature("i21_contraction", [("tr", X.true_range, _TR), ("y", lambda: X.contraction(F.col("tr"), 10, 50), f"({_w(10, f'sum(coalesce(tr, 0)) {_t(10)} / 10')}) / ({_w(50, f'sum(coalesce(tr, 0)) {_t(50)} / 50')})")], "y", 5)
_feature("i22_percent_rank", [("y", lambda: X.percent_rank(F.col("close"), 60), _w(60, f"(len(list_filter(list(close) {_t(60)}, lambda v: v <= close + abs(close) * 7.105427357601002e-15)) - 1) / (len(list(close) {_t(60)}) - 1.0::double)"))], "y", 6)
_feature("i23_gap_frequency", [("g", lambda: X.gap_flag(0.01), f"case when {_lag('close')} > 0 then cast(abs(open / {_lag('close')} - 1) > 0.01::double as double) end"), ("y", lambda: X.sma(F.col("g"), 60), _w(60, f"sum(coalesce(g, 0)) {_t(60)} / 60"))], "y", 5)


def _i17(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("instrument_id", "session_date").orderBy("event_time", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    out = frame(s, d, "ticks").withColumn("v", F.sum(F.col("price") * F.col("volume")).over(w) / F.sum("volume").over(w))
    return out.select("instrument_id", "event_id", digest(F.col("v")).alias("value"))


register("i17_session_vwap", _i17, with_tables("ticks", f"""
select instrument_id, event_id, {digest_sql('sum(price * volume) over w / sum(volume) over w')} as value from ticks
window w as (partition by instrument_id, session_date order by event_time, event_id rows unbounded preceding)"""))


def _recursive(*names):
    def query(s, d):
        return X.recursive_features(frame(s, d, "bars")).select("instrument_id", "session_date", *(digest(F.col(n)).alias(n) for n in names))

    return query


_SMOOTH = """with recursive n as (select *, row_number() over (partition by instrument_id order by session_date) as i, avg(close) over (partition by instrument_id order by session_date rows between {k} preceding and current row) as m from bars),
e as (select instrument_id, session_date, i, m as y from n where i = {n}
      union all select n.instrument_id, n.session_date, n.i, e.y + {a} * (n.close - e.y) from e join n on n.instrument_id = e.instrument_id and n.i = e.i + 1)
select n.instrument_id, n.session_date, {y} as {name} from n left join e using (instrument_id, i)"""
for _q, _name, _n, _a in (("i02_ema", "ema_12", 12, "2.0::double / 13"), ("i03_wilder", "wilder_14", 14, "1.0::double / 14")):
    _sql = with_tables("bars", "with " + _SMOOTH[len("with recursive "):].format(k=_n - 1, n=_n, a=_a, y=digest_sql("e.y"), name=_name))
    register(_q, _recursive(_name), "with recursive " + _sql[5:])
register("i04_rsi", _recursive("rsi_14"))
register("i05_macd", _recursive("macd", "macd_signal", "macd_histogram"))
register("i08_atr", _recursive("atr_14", "atr_percent"))
register("i11_adx", _recursive("adx_14", "plus_di", "minus_di"))
register("i24_feature_set", lambda s, d: X.feature_set(frame(s, d, "bars")))


def _i25(s, d):
    from vantage.operators.asof import newest

    f = X.window_features(frame(s, d, "bars")).select("instrument_id", "session_date", "sma_20", "roc_20", "high_252")
    out = newest(f, ["instrument_id"], "session_date")
    return out.select("instrument_id", "session_date", *(digest(F.col(c)).alias(c) for c in ("sma_20", "roc_20", "high_252")))


register("i25_latest_features", _i25, with_tables("bars", f"""
with f as (select instrument_id, session_date, {_w(20, f'sum(close) {_t(20)} / 20')} as a, close / {_lag('close', 20)} - 1 as b, {_w(252, f'max(high) {_t(252)}')} as c,
  row_number() over (partition by instrument_id order by session_date desc) as k from bars window w as (partition by instrument_id order by session_date))
select instrument_id, session_date, {digest_sql('a')} as sma_20, {digest_sql('b')} as roc_20, {digest_sql('c')} as high_252 from f where k = 1"""))
_WARM = {"sma_200": 200, "roc_252": 253, "high_60": 60}


def _i26(s, d):
    f = X.window_features(frame(s, d, "bars")).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(c) for c in _WARM))
    spec = F.map_from_arrays(F.array(*map(F.lit, _WARM)), F.array(*(F.lit(n) for n in _WARM.values())))
    long = f.unpivot(["instrument_id", "n"], list(_WARM), "feature", "defined")
    return long.withColumn("warmup", F.element_at(spec, F.col("feature"))).withColumn("available", F.col("n") >= F.col("warmup"))


register("i26_availability", _i26, with_tables("bars", """
with n as (select instrument_id, count(*) as n from bars group by 1)
select instrument_id, n, feature, greatest(n - warmup + 1, 0) as defined, warmup, n >= warmup as available from n cross join (values ('sma_200', 200), ('roc_252', 253), ('high_60', 60)) v(feature, warmup)"""))


def _i29(s, d):
    names = ["sma_200", "roc_60", "high_252"]
    f = X.window_features(frame(s, d, "bars"))
    missing = F.array_compact(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n in names)))
    return f.select("instrument_id", "session_date", F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("complete"))


register("i29_completeness", _i29, with_tables("bars", """
with n as (select *, row_number() over (partition by instrument_id order by session_date) as i from bars)
select instrument_id, session_date, concat_ws(',', case when i < 200 then 'sma_200' end, case when i < 61 then 'roc_60' end, case when i < 252 then 'high_252' end) as missing, i >= 252 as complete from n"""))


def _by_episode(s, d):
    """Window features of each unbroken stretch of series that have gaps."""
    from vantage.operators.asof import by_episode

    return by_episode(frame(s, d, "gappy_bars"), frame(s, d, "calendar"), lambda b: X.window_features(b).select("instrument_id", "episode_id", "session_date", "sma_20", "roc_5"))


register("r18_features_by_episode", lambda s, d: _by_episode(s, d).select("instrument_id", "episode_id", "session_date", *(digest(F.col(c)).alias(c) for c in ("sma_20", "roc_5"))),
         with_tables("gappy_bars", f"""with g as (select *, case when session_ord - lag(session_ord) over (partition by instrument_id order by session_ord) - 1 >= 21 then 1 else 0 end as brk from gappy_bars), e as (select *, sum(brk) over (partition by instrument_id order by session_ord)::bigint as episode_id from g),
n as (select *, row_number() over w as i, avg(close) over (partition by instrument_id, episode_id order by session_date rows 19 preceding) as a, close / lag(close, 5) over w - 1 as r from e window w as (partition by instrument_id, episode_id order by session_date))
select instrument_id, episode_id, session_date, {digest_sql('case when i >= 20 then a end')} as sma_20, {digest_sql('r')} as roc_5 from n"""))


def _all_by_episode(s, d):
    """The whole feature set of each episode of series that have gaps."""
    from vantage.operators.asof import by_episode

    given = once(s, d, "bars", "calendar")
    return by_episode(frame(s, d, "gappy_bars", given), given["calendar"], X.feature_set)


register("r18_feature_set_by_episode", _all_by_episode)
