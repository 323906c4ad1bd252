"""Point-in-time market tables derived from the star-schema tables, in SQL that Spark and DuckDB both read.

Each named table is a common table expression over the ones it needs.  ``frame`` gives it as a DataFrame,
``with_tables`` as the head of a DuckDB statement, so that an operator and its oracle start from the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vantage.sources.staging import staged_file

_TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "instruments_a_brand": ((), "select greatest(cast(count(*) / 2000 as bigint), 1) as g from part"),
    "listed_parts": (("instruments_a_brand",), """
        select p_partkey, cast(cast(substr(p_brand, 7) as int) + 25 * (p_partkey % g) as int) as instrument_id from part cross join instruments_a_brand"""),
    "daily_flow": (("listed_parts",), """
        select instrument_id, cast(l_shipdate as date) as session_date, count(*) as n,
               sum(cast(floor(l_discount * 100 + 5e-1) as bigint)) as disc, sum(cast(floor(l_tax * 100 + 5e-1) as bigint)) as tax,
               sum(cast(floor(l_quantity + 5e-1) as bigint)) as volume
        from lineitem join listed_parts on l_partkey = p_partkey group by 1, 2"""),
    "daily_return": (("daily_flow",), """
        select instrument_id, session_date, volume, cast(floor(4e3 * (cast(disc as double) / n - 5e0) + 5e-1) as bigint) as r_micro,
               50 + cast(floor(2e1 * tax / n + 5e-1) as bigint) as spread_bp from daily_flow"""),
    "daily_close": (("daily_return",), """
        select *, cast(floor(1e6 * exp(cum / 1e6) + 5e-1) as bigint) as c4 from (
          select *, sum(r_micro) over (partition by instrument_id order by session_date rows unbounded preceding) as cum from daily_return) x"""),
    "bars": (("daily_close",), """
        select instrument_id, session_date, o4 / 1e4 as open, floor(greatest(o4, c4) * (10000 + spread_bp) / 1e4 + 5e-1) / 1e4 as high,
               floor(least(o4, c4) * (10000 - spread_bp) / 1e4) / 1e4 as low, c4 / 1e4 as close, cast(volume as double) as volume
        from (select *, coalesce(lag(c4) over (partition by instrument_id order by session_date), cast(1000000 as bigint)) as o4 from daily_close) x"""),
    "calendar": (("bars",), """
        select session_date, cast(row_number() over (order by session_date) as int) as session_ord,
               cast(session_date as timestamp) + interval '870' minute as open_utc, cast(session_date as timestamp) + interval '21' hour as close_utc
        from (select distinct session_date from bars) x"""),
    "bar_facts": (("bars", "calendar"), """
        select b.instrument_id, b.session_date, b.open, b.high, b.low, b.close, b.volume, c.close_utc as event_time,
               c.close_utc + interval '20' minute as knowledge_time, 'ok' as quality
        from bars b join calendar c on b.session_date = c.session_date
        union all
        select b.instrument_id, b.session_date, b.open, b.high, b.low, floor(b.close * 1.001e0 * 1e4 + 5e-1) / 1e4, b.volume, c.close_utc,
               c.close_utc + interval '4340' minute, case when b.instrument_id = 10 then 'suspect' else 'ok' end
        from bars b join calendar c on b.session_date = c.session_date where b.instrument_id % 5 = 0 and c.session_ord % 50 = 0"""),
    "first_sessions": (("bars",), """
        select instrument_id, min(session_date) as first_date, max(session_date) as last_date from bars group by instrument_id"""),
    "universe": (("first_sessions",), """
        select 'core' as universe, instrument_id, first_date as valid_from,
               case when instrument_id % 7 = 0 then date '2000-01-01' end as valid_to from first_sessions"""),
    "sectors": (("first_sessions",), """
        select f.instrument_id, 'region' as scheme, r.r_name as sector, 'industry-' || cast(f.instrument_id % 3 as varchar(9)) as industry,
               f.first_date as valid_from, case when f.instrument_id % 11 = 0 then date '1998-01-01' end as valid_to
        from first_sessions f join region r on r.r_regionkey = f.instrument_id % 5 where f.instrument_id <> 25
        union all
        select f.instrument_id, 'region', r.r_name, 'industry-' || cast(f.instrument_id % 3 as varchar(9)), date '1998-01-01', cast(null as date)
        from first_sessions f join region r on r.r_regionkey = (f.instrument_id + 1) % 5 where f.instrument_id % 11 = 0"""),
    "mappings": (("first_sessions",), """
        select instrument_id, 'T' || cast(instrument_id as varchar(9)) as ticker, first_date as valid_from,
               case when instrument_id % 4 = 1 then date '1996-01-01' end as valid_to from first_sessions
        union all
        select instrument_id, 'N' || cast(instrument_id as varchar(9)), date '1996-01-01', cast(null as date) from first_sessions where instrument_id % 4 = 1
        union all
        select instrument_id, 'T2', date '1997-01-01', date '1997-06-01' from first_sessions where instrument_id = 3"""),
    "splits": (("first_sessions",), """
        select instrument_id, date '1998-06-01' as ex_date, 2e0 as ratio, cast('1998-05-22 00:00:00' as timestamp) as knowledge_time from first_sessions where instrument_id % 4 = 0
        union all
        select instrument_id, date '1999-03-01', 1e-1, cast('1999-02-19 00:00:00' as timestamp) from first_sessions where instrument_id % 6 = 0
        union all
        select instrument_id, date '1995-03-01', 2e0, cast('1995-02-20 00:00:00' as timestamp) from first_sessions where instrument_id % 4 = 0"""),
    "splits_other": (("splits",), """
        select instrument_id, ex_date, case when instrument_id = 8 then 1e0 / ratio when instrument_id = 16 then 3e0 else ratio end as ratio
        from splits where instrument_id <> 12
        union all
        select 2, date '1996-02-01', 2e0"""),
    "dividends": (("bars",), """
        select instrument_id, min(session_date) as ex_date, 25e-2 as cash_amount from bars
        where instrument_id % 3 = 0 and session_date >= make_date(cast(extract(year from session_date) as int), 3, 1)
        group by instrument_id, extract(year from session_date)"""),
    "fundamental_quarters": ((), """
        select c_nationkey + 1 as instrument_id, cast(extract(year from o_orderdate) as int) as fiscal_year,
               cast(extract(quarter from o_orderdate) as int) as quarter, sum(cast(floor(o_totalprice * 100 + 5e-1) as bigint)) as cents
        from orders join customer on o_custkey = c_custkey group by 1, 2, 3"""),
    "fundamentals": (("fundamental_quarters",), """
        select instrument_id, 'revenue' as metric, fiscal_year, 'Q' || cast(quarter as varchar(1)) as fiscal_period,
               cast(make_date(fiscal_year, quarter * 3, 28) as date) as period_end, cast(cents as bigint) as value,
               cast(make_date(fiscal_year, quarter * 3, 28) as timestamp) + interval '1080' hour as knowledge_time, false as is_restatement
        from fundamental_quarters
        union all
        select instrument_id, 'revenue', fiscal_year, 'Q' || cast(quarter as varchar(1)), cast(make_date(fiscal_year, quarter * 3, 28) as date),
               cast(floor(cents * 1.02e0 + 5e-1) as bigint), cast(make_date(fiscal_year, quarter * 3, 28) as timestamp) + interval '3240' hour, true
        from fundamental_quarters where instrument_id % 3 = 0"""),
    "statements": (("fundamental_quarters",), """
        select instrument_id, 'revenue' as metric, cast(make_date(fiscal_year, quarter * 3, 28) as date) as period_end, cast(cents as double) as value from fundamental_quarters
        union all select instrument_id, 'net_income', cast(make_date(fiscal_year, quarter * 3, 28) as date), cast(cents as double) * (instrument_id % 7 - 1) / 4e1 from fundamental_quarters
        union all select instrument_id, 'equity', cast(make_date(fiscal_year, quarter * 3, 28) as date), cast(cents as double) * (instrument_id % 6 - 1) / 2e0 from fundamental_quarters
        union all select instrument_id, 'debt', cast(make_date(fiscal_year, quarter * 3, 28) as date), cast(cents as double) * (instrument_id % 5) / 1e0 from fundamental_quarters where instrument_id % 8 <> 0"""),
    "levels": ((), """
        select cast(o_orderkey as bigint) as seq, case when o_orderkey % 10 = 0 then '' else 'p' || cast(o_custkey as varchar(20)) end as key, case when o_orderkey % 7 = 0 then 'support' else 'resistance' end as side,
               case when o_orderkey % 6 = 0 then 'research' else 'structural' end as kind, case when o_orderkey % 23 = 0 then 0e0 else cast(o_custkey % 300 + 1 as double) end as level, case when o_orderkey % 19 <> 0 then cast(o_orderkey % 90 as double) / 1e1 end as atr,
               cast(o_orderkey % 101 as double) as confidence, cast(o_orderkey % 6 as int) as touches, cast(o_custkey % 101 as double) as quality from orders"""),
    "earnings": (("fundamental_quarters",), """
        select instrument_id, fiscal_year, 'Q' || cast(quarter as varchar(1)) as fiscal_period,
               cast(cast(make_date(fiscal_year, quarter * 3, 28) as timestamp) + interval '720' hour as date) as scheduled_date,
               cast(make_date(fiscal_year, quarter * 3, 28) as timestamp) + interval '384' hour as knowledge_time from fundamental_quarters"""),
    "benchmarks": (("bars",), """
        select cast(101 as int) as benchmark_id, session_date, cast(sum(cast(floor(close * 1e4 + 5e-1) as bigint)) as double) / count(*) / 1e4 as close from bars group by session_date
        union all
        select 101 + cast(2 - instrument_id % 2 as int), session_date, cast(sum(cast(floor(close * 1e4 + 5e-1) as bigint)) as double) / count(*) / 1e4
        from bars group by session_date, instrument_id % 2"""),
    "ticks": ((), """
        select cast(user_id as bigint) as instrument_id, cast(ts as date) as session_date, cast(ts as timestamp) as event_time, event_id,
               cast(value as double) as price, 1e0 as volume from events"""),
    "dirty_bars": (("bars",), """
        select instrument_id, session_date, open, high, low, close, volume, 1 as line from bars
        union all select instrument_id, session_date, open, low, high, close, volume, 2 from bars where instrument_id = 1 and extract(day from session_date) = 3
        union all select instrument_id, session_date, open, high, low, close, volume, 3 from bars where instrument_id = 2 and extract(day from session_date) = 4
        union all select instrument_id, session_date, open, high, 0e0, -1e0, volume, 4 from bars where instrument_id = 3 and extract(day from session_date) = 5
        union all select 26, session_date, 1e1, 1e1, 1e1, 1e1, 0e0, 5 from bars where instrument_id = 4 and extract(month from session_date) = 2
        union all select 27, session_date, 1e1, 11e0, 9e0, case when extract(day from session_date) = 15 then 25e0 else 1e1 end,
                         case when extract(day from session_date) = 20 then 2e5 when extract(day from session_date) = 21 then -1e0 else 1e2 end, 6
                  from bars where instrument_id = 5"""),
    "gappy_bars": (("bars", "calendar"), """
        select b.*, c.session_ord from bars b join calendar c on b.session_date = c.session_date
        where not (b.instrument_id = 3 and c.session_ord between 100 and 159)"""),
    "filings": ((), """
        select cast(o_custkey as bigint) as cik, 'Customer ' || cast(o_custkey as varchar(20)) as name, cast(o_orderdate as date) as filed_at,
               case o_orderpriority when '1-URGENT' then case when o_orderkey % 3 = 0 then '25-NSE' else '25' end when '2-HIGH' then case when o_orderkey % 5 = 0 then '10-QSB' else '10-Q' end
                    when '3-MEDIUM' then case when o_orderkey % 7 = 0 then '20-F' else '10-K' end when '4-NOT SPECIFIED' then case o_orderkey % 4 when 0 then '8-A12B' when 1 then 'S-4' when 2 then 'UPLOAD' else '8-K' end
                    else case when o_orderkey % 2 = 0 then '15-12G' else '15-12B' end end as form_type,
               cast(o_orderkey as bigint) as accession from orders"""),
    "mapping_candidates": ((), """
        select cast(c_custkey as bigint) as cik, case when c_custkey % 11 = 0 then ' t' else 'T' end || cast(c_custkey as varchar(20)) as ticker,
               case c_custkey % 7 when 0 then 'manual_filing_citation' when 1 then 'sec_company_tickers' when 2 then 'filing_document_text' when 3 then 'submissions_former_names' when 4 then 'full_text_search' else 'name_match' end as evidence,
               case when c_custkey % 14 = 0 then 'p. 3' else '' end as citation from customer where c_custkey % 13 <> 0
        union all
        select c_custkey, 'X' || cast(c_custkey as varchar(20)), case when c_custkey % 2 = 0 then 'sec_company_tickers' else 'name_match' end, '' from customer where c_custkey % 4 = 0 and c_custkey % 13 <> 0"""),
    "trusts": ((), """
        select cast(c_custkey as bigint) as cik, 'Trust No. ' || cast(c_custkey as varchar(20)) as name, 'S' || cast(c_custkey as varchar(20)) as symbol,
               case when c_custkey % 2 = 0 then 'NYSE Arca, Inc.' else 'Nasdaq Stock Market' end as exchange, cast(c_custkey % 4 as int) as n_rows, cast(c_custkey % 3 as int) as layout,
               case when c_custkey % 11 = 0 then 'scattered' when c_custkey % 7 = 0 then 'untitled' when c_custkey % 5 = 0 then 'ticker' when c_custkey % 13 = 0 then 'name' else 'narrow' end as flaw from customer"""),
    "prospectuses": (("trusts",), """
        select cik, '<html><head><style>td {color: red}</style></head><body><table><tr><td>A.</td><td>Exact name of Trust:</td><td>' || name || case when cik % 9 = 0 then ' (formerly known as Old Trust ' || cast(cik as varchar(20)) || ')' else '' end || '</td></tr>' || chr(10)
               || case when cik % 3 = 0 then '<tr><td></td><td></td><td>(formerly known as  First' || chr(10) || 'Trust ' || cast(cik as varchar(20)) || ' &amp; Co. prior to 2010)</td></tr>' else '' end || '</table><p>' || name || ' ("' || symbol || '" or the "Trust")</p>'
               || '<p>Principal U.S. Listing Exchange for ' || name || ':</p><p>' || exchange || ' under the symbol "' || symbol || '"</p><p>Fund</p><table>'
               || '<tr>' || case when flaw = 'scattered' then '<th>Fund</th><th>Fee</th><th>Principal Listing Exchange</th><th>Ticker Symbol</th>' when flaw = 'untitled' then '<th>Fund</th><th>Principal Listing Exchange</th><th>Fee</th>'
                                when layout = 0 then '<th>Fund</th><th>Principal U.S. Listing Exchange</th><th>Ticker</th>' when layout = 1 then '<th>Ticker Symbol</th><th>Fund Name</th><th>Principal Listing Exchange</th>' else '<th> Principal US Listing Exchange</th><th>symbol</th><th>FUNDS</th>' end || '</tr>'
               || case when n_rows >= 1 then '<tr><td>' || case layout when 0 then name || ' A</td><td>' || exchange || '</td><td>' || symbol || 'A' when 1 then symbol || 'A</td><td>' || name || ' A</td><td>' || exchange else exchange || '</td><td>' || symbol || 'A</td><td>' || name || ' A' end || '</td></tr>' else '' end
               || case when n_rows >= 2 then '<tr><td>' || case layout when 0 then name || ' B</td><td>' || exchange || '</td><td>' || symbol || 'B' when 1 then symbol || 'B</td><td>' || name || ' B</td><td>' || exchange else exchange || '</td><td>' || symbol || 'B</td><td>' || name || ' B' end || '</td></tr>' else '' end
               || case when flaw = 'ticker' then '<tr><td>see note</td><td>see note</td><td>see note</td></tr>' when flaw = 'name' then '<tr><td>123</td><td>123</td><td>123</td></tr>' else '' end || '</table><p>End of the table.</p>'
               || '<table><tr><td>Late</td><td>Late</td><td>Late</td></tr></table></body></html>' as html from trusts"""),
    "fills": (("listed_parts",), """
        select instrument_id, cast(l_orderkey * 8 + l_linenumber as bigint) as fill_id, cast(l_shipdate as date) as session_date, case when (l_orderkey + l_linenumber) % 2 = 0 then 'buy' else 'sell' end as side,
               cast(floor(l_quantity + 5e-1) as bigint) as quantity, floor(cast(l_extendedprice as double) * 100 + 5e-1) / 1e2 as price from lineitem join listed_parts on l_partkey = p_partkey"""),
    "observations": ((), """
        select cast(o_custkey % 97 + 1 as int) as instrument_id, 'p' || cast(o_custkey as varchar(20)) || case when o_custkey % 10 = 0 then ':1996-01-01' else '' end as key,
               case o_custkey % 4 when 0 then 'flat_base' when 1 then 'vcp' when 2 then 'breakout_retest' else 'pennant' end as family, cast(o_orderdate as date) as session_date, cast(o_orderkey as bigint) as seq,
               case o_orderpriority when '1-URGENT' then 'FORMING' when '2-HIGH' then 'MATURE' when '3-MEDIUM' then 'NEAR_BREAKOUT' when '4-NOT SPECIFIED' then 'BROKEN_OUT_UNCONFIRMED' else case when o_orderkey % 2 = 0 then 'INVALIDATED' else 'EXPIRED' end end as to_state,
               cast(o_orderkey % 101 as double) as quality, cast(o_custkey % 61 + 40 as double) as coverage, cast(case when o_orderkey % 9 = 0 then o_orderkey % 5 + 1 else -(o_orderkey % 30) end as int) as known_after from orders"""),
    "event_history": ((), """
        select cast(o_custkey % 97 + 1 as int) as instrument_id, 'e' || cast(o_custkey as varchar(20)) as event_key, cast(o_orderdate as date) as session_date, cast(o_orderkey as bigint) as seq,
               case o_orderkey % 13 when 0 then 'not_approaching' when 1 then 'approaching' when 2 then 'testing_resistance' when 3 then 'intraday_break' when 4 then 'closed_above' when 5 then 'confirmation_pending' when 6 then 'confirmed'
                    when 7 then 'retest_pending' when 8 then 'retest_holding' when 9 then 'retest_confirmed' when 10 then 'rejected' when 11 then 'failed_breakout' else 'expired' end as to_state from orders"""),
    "reviews": ((), """
        select doc_id, 'r1' as reviewer, 1 as revision, cast(quality as int) as label from labels
        union all select doc_id, 'r2', 1, cast(case when doc_id % 9 = 0 then 1 - quality else quality end as int) from labels
        union all select doc_id, 'r1', 2, cast(1 - quality as int) from labels where doc_id % 10 = 0"""),
}

RAW = ("lineitem", "part", "orders", "customer", "region", "nation", "supplier", "events", "labels", "pages", "documents")


def _needed(name: str, found: list[str], given: tuple[str, ...] = ()) -> list[str]:
    for other in () if name in given else _TABLES[name][0]:
        _needed(other, found, given)
    if name not in found:
        found.append(name)
    return found


def with_tables(names: str, body: str) -> str:
    """A statement whose named tables (space-separated) stand before ``body``; body may begin with its own ``with``."""
    found: list[str] = []
    for name in names.split():
        _needed(name, found)
    head = ",\n".join(f"{n} as ({_TABLES[n][1]})" for n in found)
    body = body.strip()
    return f"with {head}" + (",\n" + body[5:] if body.lower().startswith("with ") else "\n" + body)


def frame(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """The named table over the Parquet tables in ``sf_dir``; tables that are ``given`` aren't derived anew."""
    given = given or {}
    if name in given:
        return given[name]
    found: list[str] = []
    views = {n: f"{n}_{uuid.uuid4().hex}" for n in given}
    for n, view in views.items():
        given[n].createOrReplaceTempView(view)
    _needed(name, found, tuple(given))
    sql = "with " + ",\n".join(f"{n} as ({f'select * from {views[n]}' if n in views else _TABLES[n][1]})" for n in found) + f"\nselect * from {name}"
    for raw in RAW:
        if raw in sql:
            spark.read.parquet(f"{sf_dir}/{raw}.parquet").createOrReplaceTempView(raw)
    out = spark.sql(sql)
    for view in views.values():
        spark.catalog.dropTempView(view)
    return out


def once(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named tables written once and read again, each from those before it: to be given to ``frame`` by a query that reads them more than once."""
    given: dict[str, DataFrame] = {}
    for name in names:
        given[name] = staged_file(frame(spark, sf_dir, name, given))
    return given
