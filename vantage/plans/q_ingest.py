"""Queries over ingest: coercion, validation, knowledge time, idempotent append, digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.operators import ingest as I
from vantage.registry import register
from vantage.sources.fixtures import frame, with_tables



def _export():
    return F.lit("2001-06-30").cast("date")



def _dirty(s, d):
    """The rows of the table dirty_bars, each bar read once and followed by the faulty lines that are made of it."""
    c = {n: F.col(n) for n in ("instrument_id", "session_date", "open", "high", "low", "close", "volume")}
    i, day, lit = c["instrument_id"], F.dayofmonth("session_date"), lambda x: F.lit(float(x))
    line = lambda n, **other: F.struct(*((c | other)[k].alias(k) for k in c), F.lit(n).alias("line"))
    odd = F.when(day == 20, 2e5).when(day == 21, -1.0).otherwise(1e2)
    made = F.array(
        line(1),
        F.when((i == 1) & (day == 3), line(2, high=c["low"], low=c["high"])),
        F.when((i == 2) & (day == 4), line(3)),
        F.when((i == 3) & (day == 5), line(4, low=lit(0), close=lit(-1))),
        F.when((i == 4) & (F.month("session_date") == 2), line(5, instrument_id=F.lit(26), open=lit(10), high=lit(10), low=lit(10), close=lit(10), volume=lit(0))),
        F.when(i == 5, line(6, instrument_id=F.lit(27), open=lit(10), high=lit(11), low=lit(9), close=F.when(day == 15, 25.0).otherwise(10.0), volume=odd)),
    )
    return frame(s, d, "bars").select(F.explode(made).alias("x")).where("x is not null").select("x.*")


def _raw(s, d):
    """Delivered text cells: the dirty bars with every kind of formatting that coercion knows."""
    b = _dirty(s, d)
    i = F.col("instrument_id")
    day = F.when(i % 3 == 0, F.date_format("session_date", "yyyy/MM/dd")).when(i % 3 == 1, F.date_format("session_date", "yyyyMMdd")).otherwise(F.col("session_date").cast("string"))
    money = lambda c: F.col(c).cast("decimal(28,4)").cast("string")
    close = F.when(i % 5 == 1, F.concat(F.lit(" $"), money("close"))).when(i % 5 == 2, F.concat(F.lit("("), money("close"), F.lit(")"))).when((i == 9) & (F.dayofmonth("session_date") == 1), F.lit("12%")).otherwise(money("close"))
    return b.select(i.cast("string").alias("id"), day.alias("date"), money("open").alias("open"), money("high").alias("high"), money("low").alias("low"), close.alias("close"), F.col("volume").cast("decimal(28,0)").cast("string").alias("vol"), F.lit("x").alias("note"), "line")


def _typed(s, d):
    return I.normalised(I.mapped(_raw(s, d), "daily_bars"), "daily_bars")


_K = "case when instrument_id % 5 = 1 then 'symbols' when instrument_id % 5 = 2 then 'accounting_negative' end"
_CLOSE = "case when instrument_id % 5 = 2 then -close else close end"
_BADC = "((instrument_id = 9 and extract(day from session_date) = 1) or (instrument_id % 5 = 2 and close < 0))"
_TYPED = f"t as (select instrument_id, session_date, line, open, high, low, volume, {_CLOSE} as close, {_BADC} as unreadable, case when instrument_id % 3 = 2 then null when instrument_id % 3 = 0 then 'slashes' else 'packed_date' end as df, case when not {_BADC} and not (instrument_id = 9 and extract(day from session_date) = 1) then {_K} end as cf from dirty_bars)"
register("s04_mapping_report", lambda s, d: I.mapping_report(_raw(s, d), "daily_bars").join(_raw(s, d).agg(F.count(F.lit(1)).alias("rows"))), with_tables("dirty_bars", "select 'note' as \"column\", 'unused' as problem, count(*) as rows from dirty_bars"))
register("s05_coercion", lambda s, d: _typed(s, d).select(F.explode("corrections").alias("c")).groupBy(F.col("c.field").alias("field"), F.col("c.rule").alias("rule")).agg(F.count(F.lit(1)).alias("n")),
         with_tables("dirty_bars", "with " + _TYPED + " select 'session_date' as field, df as rule, count(*) as n from t where df is not null group by 2 union all select 'close', cf, count(*) from t where cf is not null group by 2"))
register("s05_unreadable", lambda s, d: _typed(s, d).where(F.size("errors") > 0).select("instrument_id", "session_date", "line", F.array_join("errors", ",").alias("errors")),
         with_tables("dirty_bars", "with " + _TYPED + " select instrument_id::bigint as instrument_id, session_date, line::varchar::int as line, 'unreadable:close' as errors from t where unreadable"))


def _imported(s, d):
    return I.import_bars(_raw(s, d), _export())


register("s06_validation", lambda s, d: I.validated_bars(_typed(s, d).where(F.size("errors") == 0)).select("instrument_id", "session_date", "line", F.array_join("reasons", ",").alias("reasons"), F.array_join("flags", ",").alias("flags")),
         with_tables("dirty_bars", "with " + _TYPED + """ select instrument_id::bigint as instrument_id, session_date, line, concat_ws(',', case when least(open, high, low, close) <= 0 then 'price_not_positive' end, case when high < greatest(open, close, low) then 'high_below' end,
case when low > least(open, close) then 'low_above' end, case when volume < 0 then 'negative_volume' end) as reasons, concat_ws(',', case when volume = 0 then 'no_volume' end, case when high = low then 'flat' end) as flags from t where not unreadable"""))
register("s07_cross_row_checks", lambda s, d: _imported(s, d).where("stage = 'validate'").select(F.explode("reasons").alias("reason")).where("reason in ('duplicate_key', 'after_export', 'spike')").groupBy("reason").agg(F.count(F.lit(1)).alias("n")),
         with_tables("dirty_bars", "with " + _TYPED + """, g as (select *, row_number() over (partition by instrument_id, session_date order by line) as nth, lag(close) over (partition by instrument_id order by session_date, line) as was from t where not unreadable)
select 'duplicate_key' as reason, count(*) as n from g where nth > 1 having count(*) > 0 union all select 'after_export', count(*) from g where session_date > date '2001-06-30' having count(*) > 0
union all select 'spike', count(*) from g where greatest(close / was, was / close) > 10 having count(*) > 0"""))
register("s09_import_counters", lambda s, d: I.counters(_imported(s, d)))


def _s08(s, d):
    f = frame(s, d, "fundamentals").withColumn("reported_at", F.when(F.col("instrument_id") % 2 == 0, F.col("knowledge_time")).otherwise(F.lit(None).cast("timestamp"))).drop("knowledge_time")
    out = I.knowledge_time("fundamental", f, _export(), estimate=True)
    return out.select("instrument_id", "fiscal_year", "fiscal_period", "is_restatement", F.unix_timestamp("knowledge_time").alias("known_at"), "knowledge_source")


register("s08_knowledge_time", _s08, with_tables("fundamentals", """
select instrument_id, fiscal_year, fiscal_period, is_restatement, cast(epoch(case when instrument_id % 2 = 0 then knowledge_time else cast(period_end + case when fiscal_period = 'Q4' then 90 else 45 end as timestamp) end) as bigint) as known_at,
case when instrument_id % 2 = 0 then 'reported' else 'estimated' end as knowledge_source from fundamentals"""))
_KEY = ["instrument_id", "session_date", "knowledge_time"]
register("s12_idempotent_append", lambda s, d: I.fresh(frame(s, d, "bar_facts"), frame(s, d, "bar_facts").where("instrument_id % 2 = 0"), _KEY).select("instrument_id", "session_date", F.unix_timestamp("knowledge_time").alias("k")),
         with_tables("bar_facts", "select instrument_id, session_date, cast(epoch(knowledge_time) as bigint) as k from bar_facts where instrument_id % 2 <> 0"))
register("s13_row_digest", lambda s, d: frame(s, d, "splits").select("instrument_id", "ex_date", I.row_digest(["instrument_id", "ex_date"]).alias("digest")),
         with_tables("splits", "select instrument_id, ex_date, sha256('ex_date=' || ex_date || '|instrument_id=' || instrument_id) as digest from splits"))
register("s13_snapshot", lambda s, d: I.snapshot_id(frame(s, d, "bars"), ["instrument_id", "session_date", "volume"]))


def _vendor(s, d):
    b = frame(s, d, "dirty_bars").join(frame(s, d, "splits").select("instrument_id", F.col("ex_date").alias("session_date"), "ratio"), ["instrument_id", "session_date"], "left")
    x = F.struct(F.when(F.col("line") == 4, F.lit("n/a")).otherwise(F.col("session_date").cast("string")).alias("date"), "open", "high", "low", "close", "volume", F.coalesce("ratio", F.lit(1.0)).alias("split"), F.lit(0.0).alias("cash"))
    raw = b.groupBy(F.concat(F.lit("S"), "instrument_id").alias("symbol"), F.year("session_date").alias("y")).agg(F.to_json(F.collect_list(x)).alias("payload"))
    return I.vendor_prices(raw)


register("s14_vendor_bars", lambda s, d: _vendor(s, d)["bars"], with_tables("dirty_bars", "select 'S' || instrument_id as symbol, session_date, open, high, low, close, volume from (select *, row_number() over (partition by instrument_id, session_date order by open, high, low, close, volume) as k from dirty_bars where line <> 4) x where k = 1"))
register("s14_vendor_splits", lambda s, d: _vendor(s, d)["splits"], with_tables("dirty_bars splits", "select 'S' || instrument_id as symbol, ex_date, ratio from splits where (instrument_id, ex_date) in (select instrument_id, session_date from dirty_bars where line <> 4)"))
register("s14_vendor_rejects", lambda s, d: _vendor(s, d)["rejects"].groupBy("symbol", "reason").agg(F.count(F.lit(1)).alias("n")), with_tables("dirty_bars", "select 'S' || instrument_id as symbol, 'bad_date' as reason, count(*) as n from dirty_bars where line = 4 group by 1"))
register("s15_surrogate_ids", lambda s, d: I.surrogate_ids(frame(s, d, "mappings").select(F.col("ticker").alias("symbol"))), with_tables("mappings", "select ticker as symbol, cast(row_number() over (order by ticker) as int) as instrument_id from (select distinct ticker from mappings) x"))


def _s17(s, d):
    return frame(s, d, "bars").groupBy("instrument_id").agg(F.min("session_date").alias("first_date"), F.max("session_date").alias("last_date")).withColumn("covered", (F.col("first_date") <= F.lit("1995-06-30").cast("date")) & (F.col("last_date") >= F.lit("2001-06-30").cast("date")))


register("s17_coverage", _s17, with_tables("bars", "select instrument_id, min(session_date) as first_date, max(session_date) as last_date, min(session_date) <= date '1995-06-30' and max(session_date) >= date '2001-06-30' as covered from bars group by 1"))
