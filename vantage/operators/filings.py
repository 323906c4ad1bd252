"""Filing index text, issuer timelines, exits, survivorship; review labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What each form says about an issuer: role, scope, evidence of an exit.  Fixed values.
FORMS = {
    "8-A12B": ("birth", "exchange_listing", None),
    "8-A12G": ("birth", "security_class", None),
    "25": ("exit_confirming", "exchange_listing", "exchange_delisting"),
    "25-NSE": ("exit_confirming", "exchange_listing", "exchange_delisting"),
    "15-12B": ("exit_confirming", "sec_reporting", "registration_termination"),
    "15-12G": ("exit_confirming", "sec_reporting", "registration_termination"),
    "15-15D": ("exit_confirming", "sec_reporting", "registration_termination"),
    "15F-12B": ("exit_confirming", "sec_reporting", "registration_termination"),
    "15F-12G": ("exit_confirming", "sec_reporting", "registration_termination"),
    "8-K": ("exit_candidate", None, None),
    "S-4": ("transaction_pointer", None, None),
    "DEFM14A": ("transaction_pointer", None, None),
    "SC 14D9": ("transaction_pointer", None, None),
}
PERIODIC = ("10-K", "10-K405", "10-KSB", "10-K/A", "10-Q", "10-QSB", "10-Q/A", "20-F", "40-F")
NUMBERED_8K, ELECTRONIC_25 = "2004-08-23", "2005-12-01"


def parsed_index(lines: DataFrame) -> DataFrame:
    """Pipe-separated index lines (line) to fields, or a skip_reason; nothing disappears silently."""
    p = F.split("line", r"\|", -1)
    fields = lines.withColumn("_n", F.size(p)).select(
        "*", F.trim(F.get(p, F.lit(0))).alias("_cik"), F.trim(F.get(p, F.lit(1))).alias("name"), F.trim(F.get(p, F.lit(2))).alias("form_type"), F.trim(F.get(p, F.lit(3))).alias("_date"), F.trim(F.get(p, F.lit(4))).alias("path")
    )
    day = F.try_to_date("_date", "yyyy-MM-dd")
    reason = (
        F.when(F.trim("line") == "", "blank")
        .when(F.col("line").rlike(r"^-+$"), "rule")
        .when(F.col("_n") != 5, "layout")
        .when(F.col("_cik") == "CIK", "header")
        .when(~F.col("_cik").rlike(r"^\d+$"), "cik")
        .when(day.isNull(), "date")
    )
    accession = F.regexp_extract("path", r"(\d+)\.txt$", 1)
    return fields.select("line", F.when(reason.isNull(), F.col("_cik").cast("long")).alias("cik"), F.when(reason.isNull(), F.col("name")).alias("name"), F.when(reason.isNull(), F.col("form_type")).alias("form_type"), F.when(reason.isNull(), day).alias("filed_at"), F.when(reason.isNull(), accession.try_cast("long")).alias("accession"), reason.alias("skip_reason"))


def parsed_fixed_width(lines: DataFrame, header: str) -> DataFrame:
    """Fixed-width index lines (line) by the columns of their header line, or a skip_reason."""
    names = {"form_type": "Form Type", "name": "Company Name", "cik": "CIK", "filed_at": "Date Filed", "path": "File Name"}
    starts = sorted((header.index(title), c) for c, title in names.items())
    ends = [at for at, _ in starts[1:]] + [None]
    part = {c: F.trim(F.substring(F.col("line"), at + 1, (end - at) if end else 2000)) for (at, c), end in zip(starts, ends, strict=True)}
    cells = lines.select("line", *(x.alias(f"_{c}") for c, x in part.items()))
    day = F.try_to_date("_filed_at", "yyyy-MM-dd")
    reason = (
        F.when(F.trim("line") == "", "blank").when(F.col("line").rlike(r"^-+$"), "rule").when(F.col("line") == header, "header")
        .when(~F.col("_cik").rlike(r"^\d+$"), "cik").when(day.isNull(), "date")
    )
    kept = lambda x: F.when(reason.isNull(), x)
    return cells.select("line", kept(F.col("_cik").try_cast("long")).alias("cik"), kept(F.col("_name")).alias("name"), kept(F.col("_form_type")).alias("form_type"), kept(day).alias("filed_at"), kept(F.regexp_extract("_path", r"(\d+)\.txt$", 1).try_cast("long")).alias("accession"), reason.alias("skip_reason"))


def classified(filings: DataFrame) -> DataFrame:
    """Adds kind (role of the form), scope, evidence and an era note; a form that is in no table is irrelevant."""
    form = F.upper(F.trim("form_type"))
    rows = FORMS | {f: ("periodic", "sec_reporting", None) for f in PERIODIC}
    pick = lambda i: F.element_at(F.create_map(*(F.lit(x) for f, v in rows.items() for x in (f, v[i]))), form)
    era = F.when(form.isin("25", "25-NSE") & (F.col("filed_at") < ELECTRONIC_25), "sparse_before_electronic").when((form == "8-K") & (F.col("filed_at") < NUMBERED_8K), "old_item_scheme")
    return filings.withColumns({"kind": F.coalesce(pick(0), F.lit("irrelevant")), "scope": pick(1), "evidence": pick(2), "era": era})


def lifecycle_evidence(classified_rows: DataFrame) -> DataFrame:
    """Rows that say something about an issuer's life."""
    return classified_rows.where("kind <> 'irrelevant'")


def missing_quarters(filings: DataFrame, first: str, last: str) -> DataFrame:
    wanted = filings.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 3 months"))).alias("quarter"))
    have = filings.select(F.to_date(F.date_trunc("quarter", "filed_at")).alias("quarter")).distinct()
    return wanted.join(have, "quarter", "left_anti")


def timelines(evidence: DataFrame) -> DataFrame:
    """One row an issuer; all of it conditional aggregates, no sequential state."""
    periodic, confirming = F.col("kind") == "periodic", F.col("kind") == "exit_confirming"
    per = evidence.groupBy("cik").agg(
        F.max_by("name", F.struct("filed_at", "accession")).alias("name"), F.min("filed_at").alias("first_seen"), F.max("filed_at").alias("last_seen"), F.count(F.lit(1)).alias("n"), F.max(F.when(periodic, F.col("filed_at"))).alias("last_periodic"),
        F.min(F.when(F.col("form_type") == "8-A12B", F.col("filed_at"))).alias("listing_start"),
    )
    standing = evidence.where(confirming).join(per.select("cik", "last_periodic"), "cik").where(F.col("last_periodic").isNull() | (F.col("filed_at") >= F.col("last_periodic")))
    exits = standing.groupBy("cik").agg(F.min("filed_at").alias("first_exit"), F.max("filed_at").alias("last_exit"), F.count_distinct("evidence").alias("exit_forms"), F.count(F.lit(1)).alias("standing"))
    total = evidence.where(confirming).groupBy("cik").agg(F.count(F.lit(1)).alias("confirming"))
    return per.join(exits, "cik", "left").join(total, "cik", "left")


def resolved_exits(t: DataFrame, as_of: Column, quiet_quarters: int = 8) -> DataFrame:
    """Exit status and date; a cessation is never dated; exits before the last periodic report are superseded."""
    quiet = F.months_between(as_of, "last_seen") >= 3 * quiet_quarters
    status = F.when(F.col("exit_forms") >= 2, "extinguished").when(F.col("standing") > 0, "exited").when(quiet, "cessation_candidate").otherwise("reporting")
    date = F.when(F.col("exit_forms") >= 2, F.col("last_exit")).when(F.col("standing") > 0, F.col("first_exit"))
    return t.select("cik", "name", "listing_start", "first_seen", "last_seen", status.alias("status"), date.alias("exit_date"), (F.coalesce("confirming", F.lit(0)) - F.coalesce("standing", F.lit(0))).alias("superseded"))


def contradicted(exits: DataFrame, evidence: DataFrame) -> DataFrame:
    """Dated exits after which the issuer still filed periodic reports; must be empty."""
    later = evidence.where(F.col("kind") == "periodic").groupBy("cik").agg(F.max("filed_at").alias("p"))
    return exits.where(F.col("exit_date").isNotNull()).join(later, "cik").where(F.col("p") > F.col("exit_date")).select("cik")


def lifespans(exits: DataFrame) -> DataFrame:
    """Issuers with a dated exit by the years from first seen to it."""
    years = F.datediff("exit_date", "first_seen") / 365.25
    bucket = F.when(years < 1, "<1y").when(years < 3, "1-3y").when(years < 10, "3-10y").otherwise(">10y")
    return exits.where("exit_date is not null").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def cohort_survival(exits: DataFrame, horizons: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """Of each year of listing (or of first being seen), the share still there after each horizon."""
    birth = F.coalesce("listing_start", "first_seen")
    h = exits.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    alive = (F.col("exit_date").isNull() | (F.datediff("exit_date", birth) / 365.25 > F.col("horizon"))).cast("int")
    return h.groupBy(F.year(birth).alias("cohort"), "horizon").agg(F.count(F.lit(1)).alias("n"), F.sum(alive).alias("alive"))


def html_text(html: Column) -> Column:
    """Text of a page: scripts and styles go, block tags become line breaks, other tags go, spaces collapse."""
    x = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    x = F.regexp_replace(x, r"(?i)</?(p|div|br|tr|li|h[1-6]|table|ul|ol)[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[ \t\r\f]+", " "), r"\s*\n\s*", "\n"))


def latest_labels(reviews: DataFrame, key: str = "doc_id") -> DataFrame:
    return reviews.groupBy(key, "reviewer").agg(F.max_by("label", "revision").alias("label"), F.max("revision").alias("revision"))


def next_revisions(stored: DataFrame, incoming: DataFrame, key: str = "doc_id") -> DataFrame:
    """Incoming labels numbered after those stored for the same example and reviewer."""
    have = stored.groupBy(key, "reviewer").agg(F.max("revision").alias("_m"))
    w = Window.partitionBy(key, "reviewer").orderBy("label")
    return incoming.join(have, [key, "reviewer"], "left").withColumn("revision", (F.coalesce("_m", F.lit(0)) + F.row_number().over(w)).cast("int")).drop("_m")


def agreement(reviews: DataFrame, key: str = "doc_id") -> DataFrame:
    per = latest_labels(reviews, key).groupBy(key).agg(F.count_distinct("reviewer").alias("reviewers"), F.count_distinct("label").alias("labels"))
    multi = per.where("reviewers >= 2")
    return multi.agg(F.count(F.lit(1)).alias("examples"), F.count_if(F.col("labels") == 1).alias("unanimous"), F.count_if(F.col("labels") > 1).alias("contested"))


def review_queue(items: DataFrame, strategy: str, limit: int, seed: int = 0) -> DataFrame:
    """items: doc_id, quality (0 to 100).  A sampling operator: the limit is its purpose."""
    mixed = F.md5(F.concat_ws("|", "doc_id", F.lit(seed)))
    if strategy == "random":
        return items.orderBy(mixed, "doc_id").limit(limit)
    if strategy == "borderline":
        return items.orderBy(F.abs(F.col("quality") - 60), "doc_id").limit(limit)
    if strategy in ("highest", "lowest"):
        return items.orderBy(F.desc("quality") if strategy == "highest" else F.asc("quality"), "doc_id").limit(limit)
    band = F.least(F.floor(F.col("quality") / 20), F.lit(4)).cast("int")
    w = Window.partitionBy("band").orderBy(mixed, "doc_id")
    return items.withColumn("band", band).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


RANKS = ("manual_filing_citation", "sec_company_tickers", "filing_document_text", "submissions_former_names", "full_text_search", "name_match")
INSUFFICIENT = ("full_text_search", "name_match")


def resolved_mappings(candidates: DataFrame) -> DataFrame:
    """One ticker an issuer by the best-ranked evidence: resolved, manual_verified (needs a citation) or ambiguous.

    candidates: cik, ticker, evidence, citation.  Evidence that can't establish a mapping alone leaves it ambiguous.
    """
    rank = F.array_position(F.array(*map(F.lit, RANKS)), F.col("evidence")) - 1
    ticker = F.upper(F.trim("ticker"))
    per = candidates.groupBy("cik", rank.alias("rank")).agg(F.count_distinct(ticker).alias("tickers"), F.min(ticker).alias("ticker"), F.min(F.when(F.col("citation") != "", F.col("citation"))).alias("citation"))
    best = per.groupBy("cik").agg(F.min_by(F.struct("rank", "tickers", "ticker", "citation"), "rank").alias("b")).select("cik", "b.*")
    evidence = F.element_at(F.array(*map(F.lit, RANKS)), (F.col("rank") + 1).cast("int"))
    status = (
        F.when(F.col("tickers") > 1, "ambiguous").when((F.col("rank") == 0) & F.col("citation").isNull(), "ambiguous").when(F.col("rank") == 0, "manual_verified")
        .when(evidence.isin(*INSUFFICIENT), "ambiguous").otherwise("resolved")
    )
    out = best.withColumn("evidence", evidence).withColumn("status", status)
    return out.select("cik", F.when(F.col("status").isin("resolved", "manual_verified"), F.col("ticker")).alias("ticker"), "status", "evidence")


def mapping_counts(exits: DataFrame, mappings: DataFrame) -> DataFrame:
    """Issuers by mapping status; those without a mapping are unresolved."""
    return exits.select("cik").join(mappings, "cik", "left").groupBy(F.coalesce("status", F.lit("unresolved")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def mapping_reach(exits: DataFrame, mappings: DataFrame) -> DataFrame:
    """How many of the supplied mappings meet an issuer."""
    m = mappings.join(exits.select("cik", F.lit(1).alias("hit")), "cik", "left")
    return m.agg(F.count(F.lit(1)).alias("supplied"), F.count("hit").alias("matched"), F.count_if(F.col("hit").isNull()).alias("unmatched"))


def coverage(exits: DataFrame, mappings: DataFrame, roster: DataFrame) -> DataFrame:
    """Matched, resolved and all issuers; share of the resolved (upper bound) and of all (lower bound), and what lies between."""
    tickers = roster.select(F.upper(F.trim("ticker")).alias("ticker")).distinct().withColumn("listed", F.lit(1))
    have = mappings.where(F.col("status").isin("resolved", "manual_verified")).join(tickers, "ticker", "left")
    x = exits.select("cik").join(have.select("cik", F.lit(1).alias("resolved"), "listed"), "cik", "left")
    out = x.agg(F.count("listed").alias("matched"), F.count("resolved").alias("resolved"), F.count(F.lit(1)).alias("issuers"))
    upper, lower = F.col("matched") / F.nullif("resolved", F.lit(0)), F.col("matched") / F.nullif("issuers", F.lit(0))
    return out.withColumns({"matched_coverage": upper, "bounded_coverage": lower, "uncertainty": upper - lower})


def corpus_class(bounds: DataFrame, passed: int, total: int, research_grade: float | None = None) -> DataFrame:
    """Grade of a roster by its lower bound and the controls passed; the top grade needs a threshold that somebody has set."""
    low = F.col("bounded_coverage")
    best = (low >= research_grade) if research_grade is not None and passed == total else F.lit(False)
    grade = F.when((low >= 0.45) & best, "survivorship_safe_research_grade").when(low >= 0.45, "materially_survivorship_corrected").when(low >= 0.25, "partially_survivorship_corrected").when(low.isNotNull(), "survivor_biased")
    return bounds.withColumn("grade", grade)


def name_matches(names: DataFrame, controls: DataFrame) -> DataFrame:
    """Registrants whose name holds every word of a control's term, with first and last filing.

    names: cik, name, filed_at.  controls: control, term.  The join is on each term's rarest word, so a word that stands in
    every name brings no rows together.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda w: w != ""))
    spans = names.groupBy("cik", "name").agg(F.min("filed_at").alias("first_filed"), F.max("filed_at").alias("last_filed"), F.count(F.lit(1)).alias("filings")).withColumn("words", words(F.col("name")))
    spread = spans.select("*", F.explode("words").alias("word"))
    asked = controls.withColumn("need", words(F.col("term"))).select("*", F.explode("need").alias("word"))
    common = spread.join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(common, "word").groupBy("control").agg(F.min_by(F.struct("word", "need"), F.struct("n", "word")).alias("b")).select("control", "b.*")
    hits = spread.join(rarest, "word").where(F.size(F.array_except("need", "words")) == 0)
    return hits.select("control", "cik", "name", "first_filed", "last_filed", "filings")


def submission_documents(filings: DataFrame) -> DataFrame:
    """Documents of full submission texts (accession, text): nth, type and body of each."""
    parts = F.filter(F.split("text", "<DOCUMENT>"), lambda p: p.contains("</DOCUMENT>"))
    x = filings.select("accession", F.posexplode(parts).alias("nth", "part"))
    body = F.regexp_extract("part", r"(?s)<TEXT>\n?(.*?)</TEXT>", 1)
    return x.select("accession", "nth", F.regexp_extract("part", r"<TYPE>([^\n]*)", 1).alias("type"), body.alias("body"))


def submission_headers(filings: DataFrame) -> DataFrame:
    """Header fields of full submission texts: form, date, and the entities with their roles."""
    head = F.substring_index("text", "<DOCUMENT>", 1)
    entity = F.transform(F.regexp_extract_all(head, F.lit(r"(?m)^([A-Z][A-Z -]*):\n\s+CENTRAL INDEX KEY:\s+\d+"), F.lit(0)), lambda e: F.struct(F.regexp_extract(e, "^([A-Z -]+):", 1).alias("role"), F.regexp_extract(e, r"(\d+)$", 1).cast("long").alias("cik")))
    return filings.select("accession", F.regexp_extract(head, r"(?m)^FORM TYPE:\s+(\S+)", 1).alias("form_type"), F.try_to_date(F.regexp_extract(head, r"FILED AS OF DATE:\s+(\d{8})", 1), "yyyyMMdd").alias("filed_at"), entity.alias("entities"))


ROLES = ("FILER", "SUBJECT COMPANY", "FILED BY", "ISSUER", "REPORTING-OWNER")


def entities_by_role(headers: DataFrame) -> DataFrame:
    """One row an entity of a submission; a role that is in no table is flagged, not dropped."""
    return headers.select("accession", F.explode("entities").alias("e")).select("accession", "e.role", "e.cik", (~F.col("e.role").isin(*ROLES)).alias("unknown_role"))


def header_mismatches(headers: DataFrame, index: DataFrame) -> DataFrame:
    """accession, field, header and index value wherever the header of a submission differs from its index row."""
    h = headers.select("accession", F.get("entities", F.lit(0))["cik"].cast("string").alias("h_cik"), F.col("form_type").alias("h_form_type"), F.col("filed_at").cast("string").alias("h_filed_at"))
    both = index.select("accession", F.col("cik").cast("string").alias("cik"), "form_type", F.col("filed_at").cast("string").alias("filed_at")).join(h, "accession")
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"h_{c}").alias("header"), F.col(c).alias("index")) for c in ("cik", "form_type", "filed_at")))
    return both.select("accession", F.explode(F.filter(pairs, lambda p: ~p["header"].eqNullSafe(p["index"]))).alias("p")).select("accession", "p.*")


def primary_keys(entities: DataFrame, role: str = "FILER") -> tuple[DataFrame, DataFrame]:
    """(accession, cik) where exactly one entity has the role, and the accessions refused because several have."""
    per = entities.where(F.col("role") == role).groupBy("accession").agg(F.count_distinct("cik").alias("n"), F.min("cik").alias("cik"))
    return per.where("n = 1").select("accession", "cik"), per.where("n > 1").select("accession", "n")


def index_audit(raw: DataFrame, parsed: DataFrame) -> DataFrame:
    """Per quarter: rows that an independent reading of the lines and the parser both see, rows only one sees, rows that differ, duplicates.

    raw and parsed: accession, cik, form_type, filed_at.
    """
    n = raw.select("accession", F.struct("cik", "form_type", "filed_at").alias("r"), F.col("filed_at").alias("rd")).join(parsed.select("accession", F.struct("cik", "form_type", "filed_at").alias("p"), F.col("filed_at").alias("pd")), "accession", "full_outer")
    n = n.withColumn("quarter", F.to_date(F.date_trunc("quarter", F.coalesce("rd", "pd"))))
    return n.groupBy("quarter").agg(F.count_if(F.col("r").isNotNull() & F.col("p").isNotNull()).alias("both"), F.count_if(F.col("p").isNull()).alias("only_raw"), F.count_if(F.col("r").isNull()).alias("only_parsed"), F.count_if(F.col("r") != F.col("p")).alias("differ"))


LEAST_SESSIONS, TAIL_DAYS, REUSE_DAYS = 252, 21, 92
OUTCOMES = {
    "not_found": "NOT_FOUND", "unavailable_historically": "PROVIDER_HISTORY_UNAVAILABLE", "plan_restricted": "PLAN_RESTRICTED", "ambiguous": "AMBIGUOUS", "empty": "PROVIDER_HISTORY_UNAVAILABLE",
    "rejected": "NOT_FOUND", "unreachable": "PROVIDER_ERROR", "rate_limited": "PROVIDER_ERROR", "quota_exhausted": "PROVIDER_ERROR", "malformed": "PROVIDER_ERROR",
}


def roster_status(controls: DataFrame, observed: DataFrame, outcomes: DataFrame, requested_start: Column) -> DataFrame:
    """Each control's state among ten, its required start and whether it counts as covered; only COVERED does.

    controls: ticker, aliases (array), first_trade, last_trade.  observed: ticker, first_session, last_session, bars.
    outcomes: ticker, outcome, the provider's word on a requested symbol.
    """
    required = F.coalesce("first_trade", F.date_sub("last_trade", int(LEAST_SESSIONS * 365.25 / 252) + 1))
    seen = outcomes.select(F.col("ticker").alias("_t")).unionByName(observed.select(F.col("ticker").alias("_t"))).distinct()
    tried = controls.select("ticker", F.explode("aliases").alias("_t")).join(seen, "_t").select("ticker", F.lit(True).alias("alias_tried")).distinct()
    x = controls.join(observed, "ticker", "left").join(outcomes, "ticker", "left").join(tried, "ticker", "left").withColumn("required_start", required)
    late, over = F.datediff("last_trade", "last_session"), F.datediff("last_session", "last_trade")
    short = (F.col("bars") < LEAST_SESSIONS) | F.coalesce(late > TAIL_DAYS, F.lit(False)) | F.coalesce(over > REUSE_DAYS, F.lit(False))
    untried = (F.size("aliases") > 0) & F.col("alias_tried").isNull()
    said = F.element_at(F.create_map(*(F.lit(v) for pair in OUTCOMES.items() for v in pair)), F.lower("outcome"))
    status = (
        F.when(F.col("bars").isNotNull(), F.when(short, "INSUFFICIENT_HISTORY").otherwise("COVERED"))
        .when(F.col("required_start") < requested_start, "REQUEST_WINDOW_EXCLUDED")
        .when(F.col("outcome").isNull(), F.when(untried, "WRONG_ALIAS").otherwise("UNRESOLVED"))
        .when(said.isNull(), "UNRESOLVED")
        .when((said == "NOT_FOUND") & untried, "WRONG_ALIAS")
        .otherwise(said)
    )
    return x.select("ticker", "required_start", status.alias("status"), (status == "COVERED").alias("covered"))


def difficulty_index(controls: DataFrame) -> DataFrame:
    """Tickers of each difficulty, and how many of them a source without delisted names cannot supply."""
    return controls.groupBy("difficulty").agg(F.array_sort(F.collect_set("ticker")).alias("tickers"), F.count_if(F.col("last_trade").isNotNull()).alias("gap"))


_ROW, _CELL = "\u241e", "\u241f"
# Fixed formats of prospectuses.
NAME_LABEL = r"(?i)Exact\s+name\s+of\s+(?:the\s+)?(?:Trust|Fund|Registrant|Issuer)[^:]{0,60}:"
LISTING_LABEL = r"(?i)Principal\s+(?:U\.?\s*S\.?\s+)?Listing\s+Exchange[^:]{0,160}:"
HEADINGS = {"fund": r"(?i)^Funds?(?:\s+Name)?$", "exchange": r"(?i)^Principal\s+(?:U\.?\s*S\.?\s+)?Listing\s+Exchange$", "ticker": r"(?i)^(?:Ticker|Trading)?\s*(?:Ticker|Symbol)$"}
TICKER = r"^[A-Za-z0-9.\-]{1,10}$"
FORMER = r"(?i)formerly\s+known\s+as\s+([^)\u241e\u241f]{1,300})"
SHORTHAND = r"(?i)\(\s*[\"\u201c]\s*([A-Za-z0-9.\-]{1,10})\s*[\"\u201d]\s+or\s+the\s+[\"\u201c]\s*(?:Trust|Fund|Company|Registrant|Partnership)\s*[\"\u201d]\s*\)"
SYMBOL = r"(?i)^(.*?)\s+under\s+the\s+(?:market\s+|trading\s+)?symbol\s+[\"\u201c]([A-Za-z0-9.\-]{1,10})[\"\u201d]"


def table_rows(html: Column) -> Column:
    """A page as rows of its non-empty cells: table rows, and every other block as a row of one cell."""
    x = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?i)</t[dh]\s*>", _CELL)
    x = F.regexp_replace(x, r"(?i)</?(?:tr|p|div|table|ul|ol|li|br|h[1-6]|html|body)\b[^>]*>", _ROW)
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&reg;", "\u00ae"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(sign))
    cells = lambda row: F.filter(F.transform(F.split(row, _CELL), lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))), lambda c: c != "")
    return F.filter(F.transform(F.split(x, _ROW), cells), lambda r: F.size(r) > 0)


def _first(values: Column, test) -> Column:
    """Place (from 1) of the first element that passes, 0 if none does."""
    return F.coalesce(F.array_position(F.transform(values, lambda v: F.coalesce(test(v), F.lit(False))), True), F.lit(0).cast("long"))


def listing_rows(pages: DataFrame) -> DataFrame:
    """Rows of the first fund / exchange / ticker table of each page (html), joined to its headings by position.

    The three headings stand side by side, in any order; a row's values have the places of their headings counted from the
    leftmost.  The table ends at the first row that can't be one of it, which comes out with its reason and without values:
    ``narrow``, ``ticker`` or ``name``.  Headings that don't stand side by side give one row with ``scattered``.  A page is
    read within its own row; nothing is shuffled.  Null and empty pages have no table.
    """
    rows = pages.withColumn("_rows", F.coalesce(table_rows(F.col("html")), F.array().cast("array<array<string>>"))).drop("html")
    at = lambda cells, name: _first(cells, lambda c: c.rlike(HEADINGS[name]))
    headed = lambda cells: (at(cells, "fund") > 0) & (at(cells, "exchange") > 0) & (at(cells, "ticker") > 0)
    found = rows.withColumn("_at", _first(F.col("_rows"), headed)).where("_at > 0").withColumn("_head", F.get("_rows", (F.col("_at") - 1).cast("int")))
    found = found.withColumns({f"_{n}": at(F.col("_head"), n).cast("int") for n in HEADINGS})
    places = [F.col(f"_{n}") for n in HEADINGS]
    found = found.withColumns({"_base": F.least(*places), "_side": F.greatest(*places) - F.least(*places) == 2})
    value = lambda cells, n: F.get(cells, F.col(f"_{n}") - F.col("_base"))
    lettered = lambda c: c.rlike(r"\p{L}")
    problem = lambda c: (
        F.when(F.size(c) < 3, "narrow").when(~value(c, "ticker").rlike(TICKER), "ticker").when(~lettered(value(c, "fund")) | ~lettered(value(c, "exchange")), "name")
    )
    body = F.slice("_rows", (F.col("_at") + 1).cast("int"), F.size("_rows"))
    read = F.transform(body, lambda c: F.struct(value(c, "fund").alias("fund"), value(c, "exchange").alias("exchange"), value(c, "ticker").alias("ticker"), problem(c).alias("reason")))
    found = found.withColumn("_read", read)
    upto = _first(F.col("_read"), lambda r: r["reason"].isNotNull()).cast("int")
    none = F.lit(None).cast("string")
    kept = F.when(upto > 0, F.slice("_read", 1, upto)).otherwise(F.col("_read"))
    scattered = F.array(F.struct(none.alias("fund"), none.alias("exchange"), none.alias("ticker"), F.lit("scattered").alias("reason")))
    own = [c for c in rows.columns if c != "_rows"]
    out = found.select(*own, F.posexplode(F.when(F.col("_side"), kept).otherwise(scattered)).alias("row", "x"))
    good = lambda n: F.when(F.col("x.reason").isNull(), F.col(f"x.{n}")).alias(n)
    return out.select(*own, (F.col("row") + 1).alias("row"), *(good(n) for n in HEADINGS), F.col("x.reason").alias("reason"))


def trust_identity(pages: DataFrame) -> DataFrame:
    """What each page (html) says of its fund or trust, as written: legal name beside its label, former names, shorthands, principal listing.

    A value stands in the block of its label or in one of the two after it; another label's block is no value.
    """
    rows = pages.withColumn("_rows", F.coalesce(table_rows(F.col("html")), F.array().cast("array<array<string>>"))).drop("html")
    own = [c for c in rows.columns if c != "_rows"]
    flat = rows.withColumn("_blocks", F.flatten("_rows")).withColumn("_text", F.array_join(F.transform("_rows", lambda r: F.array_join(r, _CELL)), _ROW))
    labelled = lambda b: b.rlike(NAME_LABEL) | b.rlike(LISTING_LABEL)

    def beside(label: str) -> Column:
        at = _first(F.col("_blocks"), lambda b: b.rlike(label))
        inline = F.trim(F.regexp_replace(F.get("_blocks", (at - 1).cast("int")), f"^.*?{label}", ""))
        after = F.filter(F.slice("_blocks", (at + 1).cast("int"), F.lit(2)), lambda b: ~labelled(b) & b.rlike(r"\p{L}"))
        return F.when(at > 0, F.when(inline != "", inline).otherwise(F.get(after, F.lit(0))))

    name, listing = beside(NAME_LABEL), beside(LISTING_LABEL)
    found = flat.select(*own, "_text", F.trim(F.regexp_replace(name, r"(?i)\s*\(\s*formerly.*$", "")).alias("exact_name"), listing.alias("_listing"))
    part = lambda i: F.nullif(F.trim(F.regexp_extract("_listing", SYMBOL, i)), F.lit(""))
    every = lambda pattern: F.array_distinct(F.transform(F.regexp_extract_all("_text", F.lit(pattern), 1), lambda x: F.trim(x)))
    return found.select(*own, "exact_name", every(FORMER).alias("former_names"), every(SHORTHAND).alias("shorthands"), part(1).alias("listing_exchange"), part(2).alias("listing_symbol"))
