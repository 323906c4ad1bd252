"""Queries over materialised results, assembled results, capabilities, delivered packages and screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.functions.scalar import covers, digest, digest_sql
from vantage.operators import bars as B
from vantage.operators import cross as C
from vantage.operators import features as X
from vantage.operators import ingest as I
from vantage.operators import materialised as M
from vantage.operators import screens as O
from vantage.operators import tracking as K
from vantage.plans import q_cross as QC
from vantage.plans.q_ingest import _imported
from vantage.registry import register
from vantage.sources.fixtures import frame, once, with_tables
from vantage.sources.staging import shared_path

D = digest_sql
_ON = "1999-06-30"


def _on():
    return F.lit(_ON).cast("date")


def _values(s, d):
    return X.long_form(X.window_features(frame(s, d, "bars")), ["sma_20", "roc_60"])


_VA = """n as (select *, row_number() over w as i, avg(close) over (partition by instrument_id order by session_date rows 19 preceding) as a, close / lag(close, 60) over w - 1 as r from bars window w as (partition by instrument_id order by session_date)),
va as (select instrument_id, session_date, 'sma_20' as feature, case when i >= 20 then a end as value from n union all select instrument_id, session_date, 'roc_60', r from n)
"""
register("r13_series", lambda s, d: M.feature_series(_values(s, d), F.col("instrument_id") % 2 == 0, "sma_20").select("instrument_id", "session_date", digest(F.col("value")).alias("value")),
         with_tables("bars", "with " + _VA + f"select instrument_id, session_date, {D('value')} as value from va where feature = 'sma_20' and instrument_id % 2 = 0"))
register("r13_cross_section", lambda s, d: M.cross_section(_values(s, d), frame(s, d, "universe").where(covers(_on(), F.col("valid_from"), F.col("valid_to"))), "roc_60", F.lit("1999-06-28").cast("date")).select("instrument_id", digest(F.col("value")).alias("value")),
         with_tables("bars universe", "with " + _VA + f"select instrument_id, {D('value')} as value from va where feature = 'roc_60' and session_date = date '1999-06-28' and instrument_id in (select instrument_id from universe where valid_from <= date '{_ON}' and (valid_to is null or valid_to > date '{_ON}'))"))
register("r13_latest", lambda s, d: M.latest_value(_values(s, d), _on()).select("instrument_id", "feature", "as_of", digest(F.col("value")).alias("value")),
         with_tables("bars", "with " + _VA + f", l as (select instrument_id, feature, max(session_date) as as_of, arg_max(value, session_date) as value from va where session_date <= date '{_ON}' and value is not null group by 1, 2) select instrument_id, feature, as_of, {D('value')} as value from l"))


def _r14(s, d):
    asked = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("on")).distinct()
    return M.latest_state(C.breadth(QC._breadth_input(s, d), QC._roster(s, d)).select("session_date", "advances", "declines"), asked, ["advances", "declines"])


register("r14_latest_breadth", _r14, with_tables(QC._BT, "with " + QC._B + ", q as (select distinct cast(o_orderdate as date) as \"on\" from orders) select q.\"on\", m.session_date, m.advances, m.declines from q asof left join m on m.session_date <= q.\"on\""))


def _x20(s, d):
    g = once(s, d, "bars", "benchmarks", "calendar")
    x = C.compared(frame(s, d, "bars", g), frame(s, d, "benchmarks", g), measures=("relative",))
    r = M.strength_results(x, QC._ranked(s, d, g), QC._x05(s, d, g).withColumnRenamed("percentile", "in_sector"), lambda at: C.rs_score({k: at(k) for k in C.LOOKBACKS}), C.LOOKBACKS)
    return r.select("instrument_id", "session_date", "roster_size", "sector", F.size("percentiles").alias("lookbacks"), F.coalesce(F.size("comparisons"), F.lit(-1)).alias("comparisons"), digest(F.col("score"), 3).alias("score"), digest(F.col("in_sector"), 5).alias("in_sector"))


register("x20_strength_results", _x20, with_tables(QC._RANKT + " sectors", "with " + QC._RANK + f""", sc as (select instrument_id, session_date, max(roster_size) as roster_size, count(*)::int as lookbacks, sum(percentile * case lookback when 20 then 15e-2 when 60 then 25e-2 else 3e-1 end) / sum(case when percentile is not null then case lookback when 20 then 15e-2 when 60 then 25e-2 else 3e-1 end end) as score from q group by 1, 2),
cm as (select instrument_id, session_date, count(*)::int as comparisons from r group by 1, 2), sv as (select instrument_id, session_date, {D('relative', 6)} as value from r where benchmark_id = 101 and lookback = 60),
ss as (select v.instrument_id, v.session_date, s.sector, case when s.sector is not null then cume_dist() over (partition by v.session_date, s.sector order by value) end as in_sector from sv v {QC._SEC})
select sc.instrument_id, sc.session_date, roster_size, sector, lookbacks, coalesce(comparisons, -1) as comparisons, {D('round(score * 100, 4)', 3)} as score, {D(D('in_sector', 6), 5)} as in_sector from sc left join cm using (instrument_id, session_date) left join ss using (instrument_id, session_date)"""))


def _capable(s, d):
    b = frame(s, d, "bars").groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n_sessions"))
    flag = lambda t, c: frame(s, d, t).select("instrument_id").distinct().withColumn(c, F.lit(True))
    x = b.withColumn("has_bars", F.lit(True)).join(flag("splits", "has_splits"), "instrument_id", "left").join(flag("fundamentals", "has_fundamentals"), "instrument_id", "left").join(flag("sectors", "has_sector"), "instrument_id", "left")
    return M.capabilities(x)


_CA = """cb as (select instrument_id, count(*) as n from bars group by 1), cc as (select cb.*, instrument_id in (select instrument_id from splits) as sp, instrument_id in (select instrument_id from fundamentals) as fu, instrument_id in (select instrument_id from sectors) as se from cb),
cd as (select instrument_id, concat_ws(',', 'price', case when n >= 252 then 'features' end, case when sp then 'adjustment' end, case when fu then 'fundamentals' end, case when se and n >= 60 then 'sector_rank' end) as capabilities, concat_ws(',', case when n < 252 then 'features' end, case when not sp then 'adjustment' end, case when not fu then 'fundamentals' end, case when not (se and n >= 60) then 'sector_rank' end) as lacking from cc)
"""
_CT = "bars splits fundamentals sectors"
register("e06_capabilities", lambda s, d: _capable(s, d).select("instrument_id", F.array_join("capabilities", ",").alias("capabilities"), F.array_join("lacking", ",").alias("lacking")), with_tables(_CT, "with " + _CA + "select * from cd"))
register("e06_counts", lambda s, d: _capable(s, d).select(F.explode("capabilities").alias("capability")).groupBy("capability").agg(F.count(F.lit(1)).alias("n")), with_tables(_CT, "with " + _CA + "select unnest(string_split(capabilities, ',')) as capability, count(*) as n from cd group by 1"))
register("b25_targets", lambda s, d: M.with_capability(_capable(s, d), "adjustment").select("instrument_id"), with_tables(_CT, "with " + _CA + "select instrument_id from cd where list_contains(string_split(capabilities, ','), 'adjustment')"))
register("i28_declared", lambda s, d: M.declared(X.window_features(frame(s, d, "bars")), ["sma_20", "roc_60"]).select("instrument_id", "session_date", *(digest(F.col(c)).alias(c) for c in ("sma_20", "roc_60"))),
         with_tables("bars", "with " + _VA + f"select instrument_id, session_date, {D('case when i >= 20 then a end')} as sma_20, {D('r')} as roc_60 from n"))


def _unread(s, d):
    names = ["sma_20", "sma_50", "roc_60", "obv_slope"]
    catalogue = frame(s, d, "bars").select(F.explode(F.array(*map(F.lit, names))).alias("feature")).distinct()
    return M.unconsumed(catalogue, _values(s, d).select("feature"))


register("i28_unconsumed", _unread, with_tables("bars", "select f as feature from (values ('sma_50'), ('obv_slope')) v(f) where exists (select 1 from bars)"))
_AS = "2001-06-13"


def _weekly(s, d):
    return B.aggregate_daily(frame(s, d, "bars"), frame(s, d, "calendar"), "1w", F.lit(_AS).cast("date"))


_WK = f"""we as (select cast(date_trunc('week', session_date) as date) as period_start, max(session_date) as scheduled_end from calendar group by 1),
wf as (select instrument_id, cast(date_trunc('week', session_date) as date) as period_start, arg_min(open, session_date) as open, max(high) as high, min(low) as low, arg_max(close, session_date) as close, sum(volume) as volume, max(session_date) as period_end from bars group by 1, 2),
wp as (select wf.*, scheduled_end <= date '{_AS}' as complete from wf join we using (period_start))
"""
register("t06_as_bars", lambda s, d: M.as_bars(_weekly(s, d))[0], with_tables("bars calendar", "with " + _WK + "select instrument_id, period_end as session_date, open, high, low, close, volume from wp where complete"))
register("t06_refused", lambda s, d: M.as_bars(_weekly(s, d))[1], with_tables("bars calendar", "with " + _WK + "select instrument_id, period_start from wp where not complete"))
register("s18_decimals", lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", M.quantised(F.col("o_totalprice") / 7, 2).cast("double").alias("cash"), M.quantised(F.col("o_totalprice") / 7, 4).cast("double").alias("price"), digest(M.percent_change(F.col("o_totalprice"), F.lit(1000.0)), 4).alias("change")),
         f"select o_orderkey, round_even((o_totalprice / 7e0)::decimal(28, 10)::double, 2) as cash, round_even((o_totalprice / 7e0)::decimal(28, 10)::double, 4) as price, {D('(o_totalprice - 1000) / 1e3', 4)} as change from orders")


def _payloads(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    k = F.col("p_partkey")
    record = F.struct(
        F.when(k % 11 == 0, F.lit("soon")).otherwise(F.lit("1998-03-02")).alias("date"), F.when(k % 3 == 0, (k % 5).cast("double")).alias("numerator"), F.when(k % 3 == 0, F.lit(2.0)).alias("denominator"),
        F.when(k % 3 == 1, F.concat((k % 4 + 1).cast("string"), F.lit(":"), F.lit("3"))).when(k % 3 == 2, F.lit("x")).alias("ratio"),
    )
    return p.groupBy(F.concat(F.lit("B"), k % 50).alias("symbol")).agg(F.to_json(F.collect_list(record)).alias("payload"))


register("s19_split_events", lambda s, d: M.split_events(_payloads(s, d)).groupBy("symbol", "ex_date", F.round("ratio", 6).alias("ratio"), "rejected").agg(F.count(F.lit(1)).alias("n")),
         """with r as (select 'B' || p_partkey % 50 as symbol, case when p_partkey % 11 <> 0 then date '1998-03-02' end as ex_date, case p_partkey % 3 when 0 then (p_partkey % 5)::double when 1 then (p_partkey % 4 + 1)::double end as t, case p_partkey % 3 when 0 then 2e0 when 1 then 3e0 end as b from part),
e as (select *, case when ex_date is null then 'bad_date' when t is null or b is null then 'no_ratio' when t <= 0 or b <= 0 then 'not_positive' when t = b then 'no_change' end as rejected from r)
select symbol, ex_date, round(case when rejected is null then t / b end, 6) as ratio, rejected, count(*) as n from e group by all""")


def _enriched(s, d):
    return M.enriched(frame(s, d, "bars"), frame(s, d, "splits").select("instrument_id", "ex_date", "ratio"), frame(s, d, "splits_other"))


register("c07_merged", lambda s, d: _enriched(s, d)[0], with_tables("bars splits splits_other", "select instrument_id, ex_date, ratio, 'own' as source from splits union all select o.instrument_id, o.ex_date, o.ratio, 'other' from splits_other o where not exists (select 1 from splits s where s.instrument_id = o.instrument_id and s.ex_date = o.ex_date) and instrument_id in (select instrument_id from bars)"))
register("c07_status", lambda s, d: _enriched(s, d)[1], with_tables("bars splits splits_other", """with c as (select distinct instrument_id from bars), ad as (select o.instrument_id, count(*) as added from splits_other o where not exists (select 1 from splits s where s.instrument_id = o.instrument_id and s.ex_date = o.ex_date) group by 1),
cl as (select distinct s.instrument_id from splits s join splits_other o using (instrument_id, ex_date) where abs(s.ratio / o.ratio - 1) > 1e-6) select instrument_id, case when instrument_id in (select * from cl) then 'conflict' when added > 0 then 'enriched' when instrument_id in (select instrument_id from splits) then 'unchanged' else 'no_actions' end as status, coalesce(added, 0) as added from c left join ad using (instrument_id)"""))
register("c08_ratio_equality", lambda s, d: frame(s, d, "splits").join(frame(s, d, "splits_other").withColumnRenamed("ratio", "other"), ["instrument_id", "ex_date"]).select("instrument_id", "ex_date", (F.abs(F.col("ratio") / F.col("other") - 1) <= 1e-6).alias("equal"), (F.abs(F.col("ratio") * F.col("other") - 1) <= 1e-6).alias("reciprocal")),
         with_tables("splits splits_other", "select instrument_id, ex_date, abs(s.ratio / o.ratio - 1) <= 1e-6 as equal, abs(s.ratio * o.ratio - 1) <= 1e-6 as reciprocal from splits s join splits_other o using (instrument_id, ex_date)"))
register("r20_covers", lambda s, d: frame(s, d, "mappings").select("ticker", "instrument_id", covers(_on(), F.col("valid_from"), F.col("valid_to")).alias("valid")), with_tables("mappings", f"select ticker, instrument_id, valid_from <= date '{_ON}' and (valid_to is null or valid_to > date '{_ON}') as valid from mappings"))
register("k01_identity", lambda s, d: frame(s, d, "observations").select("seq", K.identity(F.col("instrument_id"), F.col("family"), F.lit("1d"), F.col("session_date")).alias("identity")), with_tables("observations", "select seq, substr(sha256(concat_ws('|', instrument_id, family, '1d', session_date)), 1, 24) as identity from observations"))
register("b20_event_identity", lambda s, d: frame(s, d, "event_history").select("seq", K.event_identity(F.col("instrument_id"), F.col("session_date"), F.col("seq") % 3 + 1).alias("identity")), with_tables("event_history", "select seq, substr(sha256(concat_ws('|', instrument_id, '1d', session_date, seq % 3 + 1)), 1, 24) as identity from event_history"))


def _spans(s, d):
    return frame(s, d, "observations").groupBy("instrument_id", "key", "family").agg(F.min("session_date").alias("start_date"), F.max("session_date").alias("end_date"))


register("k07_merged", lambda s, d: K.merged(_spans(s, d)))
register("k05_relationships", lambda s, d: K.relationships(_spans(s, d)).select("from_key", "to_key", "kind", digest(F.col("overlap"), 6).alias("overlap")),
         with_tables("observations", f"""with sp as (select instrument_id, key, family, min(session_date) as s, max(session_date) as e from observations group by 1, 2, 3),
p as (select a.key as from_key, b.key as to_key, a.family as fa, b.family as fb, (least(a.e, b.e) - greatest(a.s, b.s) + 1) / (a.e - a.s + 1)::double as pa, (least(a.e, b.e) - greatest(a.s, b.s) + 1) / (b.e - b.s + 1)::double as pb from sp a join sp b on a.instrument_id = b.instrument_id and a.key < b.key and a.s <= b.e and b.s <= a.e),
q as (select *, case when pa >= 85e-2 and pb >= 85e-2 then case when fa <> fb then 'RELATED_TO' end when pb >= 8e-1 then 'CONTAINS' when pa >= 8e-1 then 'NESTED_IN' when greatest(pa, pb) >= 25e-2 then 'OVERLAPS' end as kind from p)
select from_key, to_key, kind, {D('greatest(pa, pb)', 6)} as overlap from q where kind is not null"""))
register("k09_coexistence", lambda s, d: K.coexistence(frame(s, d, "observations")), with_tables("observations", "with f as (select distinct instrument_id, session_date, family from observations) select a.family, b.family as other, count(*) as n from f a join f b using (instrument_id, session_date) where a.family < b.family group by 1, 2"))


def _wide(s, d):
    f = X.window_features(frame(s, d, "bars"))
    return f.withColumns({c: digest(F.col(c), 4) for c in ("sma_50", "sma_200", "low_252", "high_252")})


_TF = f"""n as (select *, row_number() over w as i, {D('avg(close) over k50')} as a, {D('avg(close) over k200')} as b, {D('max(high) over k252')} as h, {D('min(low) over k252')} as l, close / lag(close, 60) over w - 1 as r60, volume / nullif(avg(volume) over p20, 0) as rv, max(high) over k252 as hh from bars
  window w as (partition by instrument_id order by session_date), k50 as (partition by instrument_id order by session_date rows 49 preceding), k200 as (partition by instrument_id order by session_date rows 199 preceding), k252 as (partition by instrument_id order by session_date rows 251 preceding), p20 as (partition by instrument_id order by session_date rows between 20 preceding and 1 preceding))
"""
register("o03_technical_screen", lambda s, d: O.technical_screen(_wide(s, d)).select("instrument_id", "session_date", "passed"), with_tables("bars", "with " + _TF + "select instrument_id, session_date, coalesce(i >= 252 and close > a and a > b and close >= 125e-2 * l and close >= 75e-2 * h, false) as passed from n"))


def _o04(s, d):
    f = X.window_features(frame(s, d, "bars")).select("instrument_id", "session_date", "roc_60", "relative_volume_20", "distance_high_252")
    return O.opportunities(f).select("instrument_id", "session_date", "rank", digest(F.col("score"), 2).alias("score"))


register("o04_opportunities", _o04, with_tables("bars", "with " + _TF + f""", c as (select instrument_id, session_date, case when r60 is not null then greatest(least((r60 + 1e-1) / 3e-1, 1), 0) end as x, case when i >= 21 then greatest(least((rv - 5e-1) / 15e-1, 1), 0) end as y, case when i >= 252 then greatest(least((close / hh - 1 + 3e-1) / 3e-1, 1), 0) end as z from n),
s as (select *, round(100 * (coalesce(5e-1 * x, 0) + coalesce(2e-1 * y, 0) + coalesce(3e-1 * z, 0)) / nullif(case when x is not null then 5e-1 else 0 end + case when y is not null then 2e-1 else 0 end + case when z is not null then 3e-1 else 0 end, 0), 4) as score from c)
select instrument_id, session_date, rank::int as rank, {D('score', 2)} as score from (select *, row_number() over (partition by session_date order by score desc, instrument_id) as rank from s where score >= 40) where rank <= 5"""))


def _delivered(s, d):
    """Bars written as gzipped CSV in contract order, and read again as text cells."""
    path = shared_path(s, "delivered")
    I.write_delimited(frame(s, d, "bars"), path, ["instrument_id", "session_date", "open", "high", "low", "close", "volume"])
    return I.read_delimited(s, path)


register("s01_delimited", lambda s, d: _delivered(s, d).select("instrument_id", "session_date", F.col("close").cast("double").alias("close")), with_tables("bars", "select instrument_id::varchar as instrument_id, session_date::varchar as session_date, close from bars"))
register("s16_export", lambda s, d: s.createDataFrame([(i, c) for i, c in enumerate(_delivered(s, d).columns)], "place int, name string").join(_delivered(s, d).agg(F.count(F.lit(1)).alias("n"))), with_tables("bars", "select i - 1 as place, name, n from (select count(*) as n from bars) cross join (values (1, 'instrument_id'), (2, 'session_date'), (3, 'open'), (4, 'high'), (5, 'low'), (6, 'close'), (7, 'volume')) v(i, name)"))
register("s02_parquet_text", lambda s, d: I.read_parquet_as_text(s, f"{d}/supplier.parquet").select("s_suppkey", "s_name", "s_nationkey"), "select s_suppkey::varchar as s_suppkey, s_name, s_nationkey::varchar as s_nationkey from supplier")
register("s03_row_counts", lambda s, d: s.read.parquet(f"{d}/supplier.parquet").agg(F.count(F.lit(1)).alias("n")).withColumn("header", F.lit(",".join(s.read.parquet(f"{d}/supplier.parquet").columns))), "select count(*) as n, (select string_agg(column_name, ',' order by ordinal_position) from information_schema.columns where table_name = 'supplier') as header from supplier")


def _sunk(s, d):
    """Imported rows written as facts and quarantine, read again and counted."""
    path = shared_path(s, "import")
    rows = _imported(s, d)
    I.write_import(rows, path)
    facts = s.read.parquet(f"{path}/facts").agg(F.count(F.lit(1)).alias("n")).withColumn("sink", F.lit("facts"))
    return facts.unionByName(s.read.parquet(f"{path}/quarantine").groupBy("stage").agg(F.count(F.lit(1)).alias("n")).select(F.col("stage").alias("sink"), "n"))


register("s10_sinks", _sunk)


def _s11(s, d):
    """Dated rows split into the tables that hold them: instruments, sessions, prices."""
    rows = _imported(s, d).where("stage = 'dated'")
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit(name))
    return one("instruments", rows.select("instrument_id").distinct()).unionByName(one("sessions", rows.select("session_date").distinct())).unionByName(one("prices", rows))


register("s11_tables", _s11)


def _q13(s, d):
    g = once(s, d, "bars", "calendar")
    return M.snapshot_audits(frame(s, d, "bar_facts", g), frame(s, d, "fundamentals"), _imported(s, d)).where("check <> 'quarantine'").select("check", "measured", "ok")


register("q13_snapshot_audits", _q13,
         with_tables("bar_facts fundamentals", """with j as (select close, lag(close) over (partition by instrument_id order by session_date, knowledge_time) as was from bar_facts)
select 'rows' as "check", count(*)::double as measured, count(*) > 0 as ok from bar_facts union all select 'knowledge_order', count(*)::double, count(*) = 0 from bar_facts where knowledge_time < event_time
union all select 'filed_after_period', count(*)::double, count(*) = 0 from fundamentals where knowledge_time::date < period_end union all select 'jumps', count(*)::double, count(*) = 0 from j where greatest(close / was, was / close) > 19e-1
union all select 'duplicates', count(*)::double, count(*) = 0 from (select 1 from bar_facts group by instrument_id, session_date having count(*) > 1)"""))
register("s04_delivered_mapping", lambda s, d: I.mapping_report(_delivered(s, d).withColumnRenamed("close", "last"), "daily_bars"), with_tables("bars", "select c as \"column\", p as problem from (values ('close', 'missing_required'), ('last', 'unused')) v(c, p) where exists (select 1 from bars)"))
