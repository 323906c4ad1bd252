"""Queries over filings, exits, survivorship and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.operators import filings as L
from vantage.registry import register
from vantage.sources.fixtures import frame, with_tables



def _on():
    return F.lit("2001-12-31").cast("date")



def _lines(s, d):
    f = frame(s, d, "filings")
    good = f.select(F.concat_ws("|", "cik", "name", "form_type", "filed_at", F.concat(F.lit("edgar/data/"), "cik", F.lit("/"), "accession", F.lit(".txt"))).alias("line"))
    junk = f.where("accession % 50 = 0").select(F.explode(F.array(F.lit(""), F.lit("-----"), F.lit("CIK|Company Name|Form Type|Date Filed|Filename"), F.concat(F.lit("x|"), "name"), F.concat(F.lit("abc|n|25|1999-01-01|p/"), "accession", F.lit(".txt")), F.concat_ws("|", F.lit("7"), "name", F.lit("25"), F.lit("1999-13-01"), F.lit("p")))).alias("line"))
    return good.unionByName(junk)


register("f01_parsed_index", lambda s, d: L.parsed_index(_lines(s, d)).where("skip_reason is null").select("cik", "name", "form_type", "filed_at", "accession"), with_tables("filings", "select cik, name, form_type, filed_at, accession from filings"))
_HEADER = "Form Type   Company Name                                                  CIK         Date Filed  File Name"


def _fixed_lines(s, d):
    f = frame(s, d, "filings")
    good = f.select(F.format_string("%-12s%-62s%-12s%-12s%s", "form_type", "name", F.col("cik").cast("string"), F.col("filed_at").cast("string"), F.concat(F.lit("edgar/data/"), F.col("accession").cast("string"), F.lit(".txt"))).alias("line"))
    junk = f.where("accession % 50 = 0").select(F.explode(F.array(F.lit(""), F.lit("-----"), F.lit(_HEADER), F.format_string("%-12s%-62s%-12s%-12s%s", F.lit("25"), F.col("name"), F.lit("abc"), F.lit("1999-01-01"), F.lit("p")))).alias("line"))
    return good.unionByName(junk)


register("f01_fixed_width", lambda s, d: L.parsed_fixed_width(_fixed_lines(s, d), _HEADER).where("skip_reason is null").select("cik", "name", "form_type", "filed_at", "accession"), with_tables("filings", "select cik, name, form_type, filed_at, accession from filings"))
register("f01_fixed_width_skips", lambda s, d: L.parsed_fixed_width(_fixed_lines(s, d), _HEADER).groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n")),
         with_tables("filings", "with j as (select count(*) as n from filings where accession % 50 = 0) select r as skip_reason, n from j cross join (values ('blank'), ('rule'), ('header'), ('cik')) v(r) where n > 0 union all select null, count(*) from filings"))
register("f22_skip_reasons", lambda s, d: L.parsed_index(_lines(s, d)).groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n")),
         with_tables("filings", "with j as (select count(*) as n from filings where accession % 50 = 0) select r as skip_reason, n from j cross join (values ('blank'), ('rule'), ('header'), ('layout'), ('cik'), ('date')) v(r) where n > 0 union all select null, count(*) from filings"))
register("f02_missing_quarters", lambda s, d: L.missing_quarters(frame(s, d, "filings"), "1994-01-01", "2002-12-31"), with_tables("filings", "select cast(q as date) as quarter from (select unnest(generate_series(timestamp '1994-01-01', timestamp '2002-12-31', interval 3 month)) as q) x where q not in (select date_trunc('quarter', filed_at) from filings)"))


def _evidence(s, d):
    return L.classified(frame(s, d, "filings"))


_EV = """e as (select *, case when form_type in ('8-A12B', '8-A12G') then 'birth' when form_type in ('25', '25-NSE', '15-12B', '15-12G', '15-15D', '15F-12B', '15F-12G') then 'exit_confirming' when form_type = '8-K' then 'exit_candidate' when form_type in ('S-4', 'DEFM14A', 'SC 14D9') then 'transaction_pointer'
  when form_type in ('10-K', '10-K405', '10-KSB', '10-K/A', '10-Q', '10-QSB', '10-Q/A', '20-F', '40-F') then 'periodic' else 'irrelevant' end as kind,
  case when form_type in ('25', '25-NSE') then 'exchange_delisting' when form_type like '15%' then 'registration_termination' end as evidence from filings)"""
_TL = _EV + """,
p as (select cik, arg_max(name, (filed_at, accession)) as name, min(filed_at) as first_seen, max(filed_at) as last_seen, count(*) as n, max(filed_at) filter (kind = 'periodic') as last_periodic, min(filed_at) filter (form_type = '8-A12B') as listing_start, count(*) filter (kind = 'exit_confirming') as confirming from e group by 1),
x as (select e.cik, min(filed_at) as first_exit, max(filed_at) as last_exit, count(distinct evidence) as exit_forms, count(*) as standing from e join p using (cik) where kind = 'exit_confirming' and (last_periodic is null or filed_at >= last_periodic) group by 1),
r as (select cik, name, listing_start, first_seen, last_seen, case when exit_forms >= 2 then 'extinguished' when standing > 0 then 'exited' when last_seen <= date '1999-12-31' then 'cessation_candidate' else 'reporting' end as status,
  case when exit_forms >= 2 then last_exit when standing > 0 then first_exit end as exit_date, confirming - coalesce(standing, 0) as superseded from p left join x using (cik))
"""


def _exits(s, d):
    return L.resolved_exits(L.timelines(_evidence(s, d)), _on())


register("f03_form_classes", lambda s, d: _evidence(s, d).groupBy("form_type", "kind", "scope", "evidence", "era").agg(F.count(F.lit(1)).alias("n")),
         with_tables("filings", "with " + _EV + """ select form_type, kind, case when form_type in ('8-A12B', '25', '25-NSE') then 'exchange_listing' when form_type = '8-A12G' then 'security_class' when kind = 'periodic' or form_type like '15%' then 'sec_reporting' end as scope, evidence,
case when form_type in ('25', '25-NSE') and filed_at < date '2005-12-01' then 'sparse_before_electronic' when form_type = '8-K' and filed_at < date '2004-08-23' then 'old_item_scheme' end as era, count(*) as n from e group by all"""))
register("f04_evidence", lambda s, d: L.lifecycle_evidence(_evidence(s, d)).select("cik", "accession", "kind"), with_tables("filings", "with " + _EV + " select cik, accession, kind from e where kind <> 'irrelevant'"))
register("f05_timelines", lambda s, d: L.timelines(_evidence(s, d)).select("cik", "name", "first_seen", "last_seen", "n", "last_periodic", "first_exit", "last_exit"), with_tables("filings", "with " + _TL + "select cik, name, first_seen, last_seen, n, last_periodic, first_exit, last_exit from p left join x using (cik)"))
register("f06_exits", _exits, with_tables("filings", "with " + _TL + "select * from r"))
def _misdated(s, d):
    """Exits of which every tenth issuer's was dated to its first filing."""
    return _exits(s, d).withColumn("exit_date", F.when(F.col("exit_date").isNotNull() & (F.col("cik") % 10 == 0), F.col("first_seen")).otherwise(F.col("exit_date")))


register("f07_contradicted", lambda s, d: L.contradicted(_misdated(s, d), _evidence(s, d)), with_tables("filings", "with " + _TL + "select cik from r join p using (cik) where exit_date is not null and p.last_periodic > case when cik % 10 = 0 then r.first_seen else exit_date end"))
register("f08_counts", lambda s, d: _exits(s, d).groupBy("status", F.year("exit_date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.sum("superseded").alias("superseded")),
         with_tables("filings", "with " + _TL + "select status, cast(extract(year from exit_date) as int) as year, count(*) as n, sum(superseded)::bigint as superseded from r group by 1, 2"))
register("f09_lifespans", lambda s, d: L.lifespans(_exits(s, d)), with_tables("filings", "with " + _TL + ", y as (select (exit_date - first_seen) / 365.25::double as y from r where exit_date is not null) select case when y < 1 then '<1y' when y < 3 then '1-3y' when y < 10 then '3-10y' else '>10y' end as bucket, count(*) as n from y group by 1"))
register("f10_cohort_survival", lambda s, d: L.cohort_survival(_exits(s, d)), with_tables("filings", "with " + _TL + """, h as (select *, coalesce(listing_start, first_seen) as birth from r cross join (values (3), (5), (10)) v(hz))
select cast(extract(year from birth) as int) as cohort, hz as horizon, count(*) as n, sum(case when exit_date is null or (exit_date - birth) / 365.25::double > hz then 1 else 0 end)::bigint as alive from h group by 1, 2"""))
register("f17_html_text", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", L.html_text(F.col("html")).alias("text")).select("page_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256")),
         r"""with a as (select page_id, regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g') as x from pages), b as (select page_id, regexp_replace(x, '(?i)</?(p|div|br|tr|li|h[1-6]|table|ul|ol)[^>]*>', chr(10), 'g') as x from a),
c as (select page_id, replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as x from b),
d as (select page_id, trim(regexp_replace(regexp_replace(x, '[ \t\r\f]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g')) as x from c) select page_id, length(x) as n_chars, sha256(x) as text_sha256 from d""")
register("f21_filings_of_issuer", lambda s, d: _evidence(s, d).where("cik % 97 = 1").select("cik", "filed_at", "form_type", "accession"), with_tables("filings", "select cik, filed_at, form_type, accession from filings where cik % 97 = 1"))
register("f21_filings_of_all_issuers", lambda s, d: _evidence(s, d).select("cik", "filed_at", "form_type", "accession").orderBy("cik", "filed_at", "accession"), with_tables("filings", "select cik, filed_at, form_type, accession from filings order by cik, filed_at, accession"))


def _f21b(s, d):
    e = _evidence(s, d)
    extra = e.groupBy("cik").agg(F.max("name").alias("name"), F.max("accession").alias("accession")).select("cik", "name", F.lit("2001-12-30").cast("date").alias("filed_at"), F.lit("10-K").alias("form_type"), "accession")
    was, now = _exits(s, d), L.resolved_exits(L.timelines(e.unionByName(L.classified(extra))), _on())
    return was.join(now.select("cik", F.col("status").alias("counterfactual")), "cik").groupBy("status", "counterfactual").agg(F.count(F.lit(1)).alias("n"))


register("f21_counterfactual", _f21b, with_tables("filings", "with " + _TL + "select status, 'reporting' as counterfactual, count(*) as n from r group by 1"))


def _pages(s, d):
    """The prospectuses, dealt by issuer before their text is made: the table of issuers is one small file, so one task would parse all pages."""
    return frame(s, d, "prospectuses", {"trusts": frame(s, d, "trusts").repartition("cik")})


register("f24_listing_rows", lambda s, d: L.listing_rows(_pages(s, d)),
         with_tables("trusts", """with n as (select *, least(n_rows, 2) as k from trusts where flaw <> 'untitled')
select cik, 1 as row, null::varchar as fund, null::varchar as exchange, null::varchar as ticker, 'scattered' as reason from n where flaw = 'scattered'
union all select cik, i::int, name || chr((64 + i)::int) , exchange, symbol || chr((64 + i)::int), null from (select cik, name || ' ' as name, exchange, symbol, k, unnest(range(1, k + 1)) as i from n where flaw <> 'scattered') x
union all select cik, k + 1, null, null, null, flaw from n where flaw <> 'scattered'"""))
register("f24_trust_identity", lambda s, d: L.trust_identity(_pages(s, d)).select("cik", "exact_name", F.array_join("former_names", "; ").alias("former_names"), F.array_join("shorthands", "; ").alias("shorthands"), "listing_exchange", "listing_symbol"),
         with_tables("trusts", """select cik, name as exact_name, concat_ws('; ', case when cik % 9 = 0 then 'Old Trust ' || cik end, case when cik % 3 = 0 then 'First Trust ' || cik || ' & Co. prior to 2010' end) as former_names, symbol as shorthands, exchange as listing_exchange, symbol as listing_symbol from trusts"""))
register("f26_paths", lambda s, d: L.parsed_index(_lines(s, d)).where("skip_reason is null").groupBy("cik").agg(F.min("accession").alias("first_accession"), F.count(F.lit(1)).alias("n")), with_tables("filings", "select cik, min(accession) as first_accession, count(*) as n from filings group by 1"))

_LAT = "l as (select doc_id, reviewer, arg_max(label, revision) as label, max(revision) as revision from reviews group by 1, 2), a as (select doc_id, count(distinct reviewer) as reviewers, count(distinct label) as labels from l group by 1)"
register("l01_next_revision", lambda s, d: L.next_revisions(frame(s, d, "reviews"), frame(s, d, "reviews").where("reviewer = 'r2'").select("doc_id", F.lit("r1").alias("reviewer"), "label")),
         with_tables("reviews", "select doc_id, 'r1' as reviewer, label, cast(case when doc_id % 10 = 0 then 3 else 2 end as int) as revision from reviews where reviewer = 'r2'"))
register("l02_latest_labels", lambda s, d: L.latest_labels(frame(s, d, "reviews")), with_tables("reviews", "with " + _LAT + " select * from l"))
register("l03_agreement", lambda s, d: L.agreement(frame(s, d, "reviews")), with_tables("reviews", "with " + _LAT + " select count(*) as examples, count(*) filter (labels = 1) as unanimous, count(*) filter (labels > 1) as contested from a where reviewers >= 2"))


def _items(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", (F.col("n_chars") % 101).cast("int").alias("quality"))


register("l04_borderline", lambda s, d: L.review_queue(_items(s, d), "borderline", 50), "select doc_id, cast(n_chars % 101 as int) as quality from documents order by abs(n_chars % 101 - 60), doc_id limit 50")
register("l04_highest", lambda s, d: L.review_queue(_items(s, d), "highest", 50), "select doc_id, cast(n_chars % 101 as int) as quality from documents order by quality desc, doc_id limit 50")
register("l04_stratified", lambda s, d: L.review_queue(_items(s, d), "stratified", 10), "select doc_id, quality, band from (select *, row_number() over (partition by band order by md5(doc_id || '|0'), doc_id) as n from (select doc_id, cast(n_chars % 101 as int) as quality, cast(least(n_chars % 101 // 20, 4) as int) as band from documents)) where n <= 10")
register("l04_random", lambda s, d: L.review_queue(_items(s, d), "random", 50, seed=3), "select doc_id, cast(n_chars % 101 as int) as quality from documents order by md5(doc_id || '|3'), doc_id limit 50")
register("l04_lowest", lambda s, d: L.review_queue(_items(s, d), "lowest", 50), "select doc_id, cast(n_chars % 101 as int) as quality from documents order by quality, doc_id limit 50")


def _mappings(s, d):
    return L.resolved_mappings(frame(s, d, "mapping_candidates"))


def _listed(s, d):
    return frame(s, d, "mapping_candidates").where("cik % 3 = 0").select("ticker")


_MP = """mr as (select cik, upper(trim(ticker)) as ticker, citation, list_position(['manual_filing_citation', 'sec_company_tickers', 'filing_document_text', 'submissions_former_names', 'full_text_search', 'name_match'], evidence) - 1 as rank, evidence from mapping_candidates),
mb as (select cik, rank, any_value(evidence) as evidence, count(distinct ticker) as tickers, min(ticker) as ticker, min(nullif(citation, '')) as citation from mr group by 1, 2 qualify rank = min(rank) over (partition by cik)),
mp as (select cik, evidence, case when tickers > 1 then 'ambiguous' when rank = 0 and citation is null then 'ambiguous' when rank = 0 then 'manual_verified' when rank >= 4 then 'ambiguous' else 'resolved' end as status, ticker as t from mb),
mm as (select cik, case when status in ('resolved', 'manual_verified') then t end as ticker, status, evidence from mp)
"""
_CV = """cv as (select count(l.ticker) as matched, count(m.cik) as resolved, count(*) as issuers from r left join (select cik, ticker from mm where status in ('resolved', 'manual_verified')) m using (cik) left join (select distinct upper(trim(ticker)) as ticker from mapping_candidates where cik % 3 = 0) l on l.ticker = m.ticker),
cw as (select *, matched / nullif(resolved, 0)::double as matched_coverage, matched / nullif(issuers, 0)::double as bounded_coverage from cv)
"""
_MT = "filings mapping_candidates"
register("f13_mappings", _mappings, with_tables("mapping_candidates", "with " + _MP + "select * from mm"))
register("f14_mapping_counts", lambda s, d: L.mapping_counts(_exits(s, d), _mappings(s, d)), with_tables(_MT, "with " + _TL + ", " + _MP + "select coalesce(mm.status, 'unresolved') as status, count(*) as n from r left join mm using (cik) group by 1"))
register("f14_reach", lambda s, d: L.mapping_reach(_exits(s, d), _mappings(s, d)), with_tables(_MT, "with " + _TL + ", " + _MP + "select count(*) as supplied, count(r.cik) as matched, count(*) - count(r.cik) as unmatched from mm left join r using (cik)"))
register("f11_coverage", lambda s, d: L.coverage(_exits(s, d), _mappings(s, d), _listed(s, d)).select("matched", "resolved", "issuers", *(F.round(c, 6).alias(c) for c in ("matched_coverage", "bounded_coverage", "uncertainty"))),
         with_tables(_MT, "with " + _TL + ", " + _MP + ", " + _CV + "select matched, resolved, issuers, round(matched_coverage, 6) as matched_coverage, round(bounded_coverage, 6) as bounded_coverage, round(matched_coverage - bounded_coverage, 6) as uncertainty from cw"))
register("f12_corpus_class", lambda s, d: L.corpus_class(L.coverage(_exits(s, d), _mappings(s, d), _listed(s, d)), 28, 30).select("issuers", "grade"),
         with_tables(_MT, "with " + _TL + ", " + _MP + ", " + _CV + "select issuers, case when bounded_coverage >= 45e-2 then 'materially_survivorship_corrected' when bounded_coverage >= 25e-2 then 'partially_survivorship_corrected' when bounded_coverage is not null then 'survivor_biased' end as grade from cw"))


def _terms(s, d):
    return frame(s, d, "filings").select("cik").distinct().where("cik % 2 = 0").select(F.concat(F.lit("c"), "cik").alias("control"), F.concat(F.lit("CUSTOMER, "), "cik").alias("term"))


register("f15_name_matches", lambda s, d: L.name_matches(frame(s, d, "filings"), _terms(s, d)), with_tables("filings", "select 'c' || cik as control, cik, name, min(filed_at) as first_filed, max(filed_at) as last_filed, count(*) as filings from filings where cik % 2 = 0 group by 1, 2, 3"))


def _submissions(s, d):
    """Full submission texts of all filings; every seventh has a second filer, every tenth a form that differs from its index row."""
    f = frame(s, d, "filings")
    a = F.col("accession")
    form = F.when(a % 10 == 0, F.lit("X-1")).otherwise(F.col("form_type"))
    second = F.when(a % 7 == 0, F.concat(F.lit("FILER:\n  CENTRAL INDEX KEY:  "), (F.col("cik") + 1).cast("string"), F.lit("\n"))).when(a % 7 == 1, F.lit("SUBJECT PERSON:\n  CENTRAL INDEX KEY:  5\n")).otherwise("")
    head = F.concat(F.lit("FORM TYPE:   "), form, F.lit("\nFILED AS OF DATE:  "), F.date_format("filed_at", "yyyyMMdd"), F.lit("\nFILER:\n  CENTRAL INDEX KEY:  "), F.col("cik").cast("string"), F.lit("\n"), second)
    doc = lambda kind, body: F.concat(F.lit("<DOCUMENT>\n<TYPE>"), kind, F.lit("\n<TEXT>\n"), body, F.lit("</TEXT>\n</DOCUMENT>\n"))
    return f.select("accession", F.concat(head, doc(F.col("form_type"), F.col("name")), F.when(a % 3 == 0, doc(F.lit("EX-99"), F.lit("more"))).otherwise("")).alias("text"))


register("f16_documents", lambda s, d: L.submission_documents(_submissions(s, d)), with_tables("filings", "select accession, 0 as nth, form_type as type, name as body from filings union all select accession, 1, 'EX-99', 'more' from filings where accession % 3 = 0"))
register("f16_header_mismatches", lambda s, d: L.header_mismatches(L.submission_headers(_submissions(s, d)), frame(s, d, "filings")), with_tables("filings", "select accession, 'form_type' as field, 'X-1' as header, form_type as \"index\" from filings where accession % 10 = 0"))
_EN = "en as (select accession, 'FILER' as role, cik, false as unknown_role from filings union all select accession, 'FILER', cik + 1, false from filings where accession % 7 = 0 union all select accession, 'SUBJECT PERSON', 5, true from filings where accession % 7 = 1)"
register("f23_entities", lambda s, d: L.entities_by_role(L.submission_headers(_submissions(s, d))), with_tables("filings", "with " + _EN + " select * from en"))
register("f25_primary_keys", lambda s, d: L.primary_keys(L.entities_by_role(L.submission_headers(_submissions(s, d))))[0], with_tables("filings", "select accession, cik from filings where accession % 7 <> 0"))
register("f25_refused", lambda s, d: L.primary_keys(L.entities_by_role(L.submission_headers(_submissions(s, d))))[1], with_tables("filings", "select accession, 2 as n from filings where accession % 7 = 0"))


def _raw_index(s, d):
    """The lines read by one pattern, apart from the parser."""
    p = r"^(\d+)\|[^|]*\|([^|]+)\|(\d{4}-\d{2}-\d{2})\|.*?(\d+)\.txt$"
    part = lambda i: F.regexp_extract("line", p, i)
    x = _lines(s, d).where(F.col("line").rlike(p)).select(part(4).cast("long").alias("accession"), part(1).cast("long").alias("cik"), part(2).alias("form_type"), F.try_to_date(part(3), "yyyy-MM-dd").alias("filed_at"))
    return x.where("accession % 40 <> 0").withColumn("form_type", F.when(F.col("accession") % 60 == 1, F.lit("?")).otherwise(F.col("form_type")))


register("f20_index_audit", lambda s, d: L.index_audit(_raw_index(s, d), L.parsed_index(_lines(s, d)).where("skip_reason is null")),
         with_tables("filings", "select cast(date_trunc('quarter', filed_at) as date) as quarter, count(*) filter (accession % 40 <> 0) as both, 0 as only_raw, count(*) filter (accession % 40 = 0) as only_parsed, count(*) filter (accession % 60 = 1 and accession % 40 <> 0) as differ from filings group by 1"))


def _controls(s, d):
    m = frame(s, d, "mapping_candidates").groupBy("cik").agg(F.min("ticker").alias("ticker"))
    c = F.col("cik")
    return m.select("ticker", F.when(c % 3 == 0, F.array(F.concat(F.lit("A"), c.cast("string")))).otherwise(F.array().cast("array<string>")).alias("aliases"), F.when(c % 2 == 0, F.lit("1994-01-01").cast("date")).alias("first_trade"),
                    F.when(c % 5 != 0, F.lit("1998-06-30").cast("date")).alias("last_trade"), F.concat(F.lit("level-"), (c % 4).cast("string")).alias("difficulty"), "cik")


def _observed(s, d):
    c = _controls(s, d).where("cik % 3 = 1")
    f = frame(s, d, "filings").groupBy("cik").agg(F.min("filed_at").alias("first_session"), F.max("filed_at").alias("last_session"), (F.count(F.lit(1)) * 40).alias("bars"))
    return c.select("cik", "ticker").join(f, "cik").select("ticker", "first_session", "last_session", "bars")


def _outcomes(s, d):
    words = F.array(*(F.lit(w) for w in ("not_found", "plan_restricted", "empty", "unreachable", "odd")))
    return _controls(s, d).where("cik % 3 <> 1 and cik % 7 <> 0").select("ticker", F.get(words, (F.col("cik") % 5).cast("int")).alias("outcome"))


_RO = """co as (select cik, min(ticker) as ticker, case when cik % 2 = 0 then date '1994-01-01' end as first_trade, case when cik % 5 <> 0 then date '1998-06-30' end as last_trade from mapping_candidates group by 1),
ob as (select cik, min(filed_at) as first_session, max(filed_at) as last_session, count(*) * 40 as bars from filings where cik % 3 = 1 group by 1),
rs as (select co.ticker, cik, coalesce(first_trade, last_trade - 366) as required_start, case when bars is not null then case when bars < 252 or coalesce(last_trade - last_session > 21, false) or coalesce(last_session - last_trade > 92, false) then 'INSUFFICIENT_HISTORY' else 'COVERED' end
  when coalesce(first_trade, last_trade - 366) < date '1994-06-01' then 'REQUEST_WINDOW_EXCLUDED' when cik % 3 = 1 or cik % 7 = 0 then case when cik % 3 = 0 then 'WRONG_ALIAS' else 'UNRESOLVED' end
  when cik % 5 = 0 then case when cik % 3 = 0 then 'WRONG_ALIAS' else 'NOT_FOUND' end when cik % 5 = 1 then 'PLAN_RESTRICTED' when cik % 5 = 2 then 'PROVIDER_HISTORY_UNAVAILABLE' when cik % 5 = 3 then 'PROVIDER_ERROR' else 'UNRESOLVED' end as status from co left join ob using (cik))
"""
register("q14_roster_status", lambda s, d: L.roster_status(_controls(s, d), _observed(s, d), _outcomes(s, d), F.lit("1994-06-01").cast("date")), with_tables(_MT, "with " + _RO + "select ticker, required_start, status, status = 'COVERED' as covered from rs"))
register("q15_difficulty", lambda s, d: L.difficulty_index(_controls(s, d)).select("difficulty", F.size("tickers").alias("n"), F.sha2(F.array_join("tickers", ","), 256).alias("tickers"), "gap"),
         with_tables(_MT, "with " + _RO + "select 'level-' || cik % 4 as difficulty, count(*) as n, sha256(string_agg(ticker, ',' order by ticker)) as tickers, count(last_trade) as gap from co group by 1"))


def _f18(s, d):
    e = _exits(s, d).select("cik", F.col("status").alias("exit_status"), "exit_date")
    return _controls(s, d).select("cik", "ticker").join(e, "cik", "left").select("cik", "ticker", "exit_status", "exit_date", F.col("exit_status").isNull().alias("unresolved"), (F.col("exit_status") == "cessation_candidate").alias("awaiting"))


register("f18_controls_with_evidence", _f18, with_tables(_MT, "with " + _TL + ", " + _RO + "select cik, ticker, r.status as exit_status, exit_date, r.status is null as unresolved, r.status = 'cessation_candidate' as awaiting from co left join r using (cik)"))
register("f19_handoff", lambda s, d: _f18(s, d).select(F.when(F.col("unresolved"), F.lit(None).cast("long")).otherwise(F.col("cik")).alias("key"), "ticker", F.when(F.col("unresolved"), "no_evidence").alias("refused")),
         with_tables(_MT, "with " + _TL + ", " + _RO + "select case when r.status is not null then cik end as key, ticker, case when r.status is null then 'no_evidence' end as refused from co left join r using (cik)"))
