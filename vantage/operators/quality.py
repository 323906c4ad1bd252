"""Data-quality findings, corporate-action reconciliation, gap shapes.

Every check returns findings of one shape: check, severity, instrument_id, session_date, detail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.operators.asof import sessions_within
from vantage.functions.scalar import listed

INFO, WARN, REJECT = "INFO", "WARN", "REJECT"
PRICES = ("open", "high", "low", "close")


def _finding(df: DataFrame, check: str, severity: Column | str, detail: Column | None = None) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(F.lit(check).alias("check"), level.alias("severity"), "instrument_id", "session_date", (detail if detail is not None else F.lit("")).cast("string").alias("detail"))


def duplicates(bars: DataFrame) -> DataFrame:
    """The same session twice: an identical replay is noted, a conflict is rejected."""
    kinds = F.count_distinct(F.struct(*PRICES, "volume"))
    return _finding(bars.groupBy("instrument_id", "session_date").agg(F.count(F.lit(1)).alias("n"), kinds.alias("k")).where("n > 1"), "duplicate", F.when(F.col("k") == 1, INFO).otherwise(REJECT), F.col("n"))


def ohlc(bars: DataFrame) -> DataFrame:
    bad = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high"))
    return _finding(bars.where(bad), "ohlc", REJECT)


def positive_prices(bars: DataFrame) -> DataFrame:
    fields = listed(**{p: F.col(p) <= 0 for p in PRICES})
    return _finding(bars.withColumn("_f", fields).where(F.size("_f") > 0), "price_not_positive", REJECT, F.array_join("_f", ","))


def runs(bars: DataFrame, same: Column, least: int, keep: Column | None = None) -> DataFrame:
    """Runs of at least ``least`` consecutive sessions of a series for which ``same`` doesn't change (and ``keep`` holds)."""
    w = Window.partitionBy("instrument_id").orderBy("session_date", "line")
    new = F.coalesce((~same.eqNullSafe(F.lag("_same").over(w))).cast("int"), F.lit(1))
    marked = bars.withColumn("_same", same).withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    if keep is not None:
        marked = marked.where(keep)
    return marked.groupBy("instrument_id", "_run").agg(F.min("session_date").alias("session_date"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def volume(bars: DataFrame, absurd: float = 1e11, spike: float = 50.0, zero_run: int = 3) -> DataFrame:
    """Negative or absurd volumes, runs without volume, and spikes against the exact median of the positive ones."""
    median = bars.where("volume > 0").groupBy("instrument_id").agg(F.median("volume").alias("m"))
    spikes = bars.join(median, "instrument_id").where(F.col("volume") > spike * F.col("m"))
    return (
        _finding(bars.where((F.col("volume") < 0) | (F.col("volume") > absurd)), "volume_range", REJECT)
        .unionByName(_finding(runs(bars, F.col("volume") == 0, zero_run, F.col("volume") == 0), "zero_volume_run", WARN, F.col("n")))
        .unionByName(_finding(spikes, "volume_spike", WARN))
    )


def stale_prices(bars: DataFrame, least: int = 5) -> DataFrame:
    return _finding(runs(bars, F.struct(*PRICES), least), "stale_price", WARN, F.col("n"))


def moves(bars: DataFrame, actions: DataFrame, jump: float = 0.5) -> DataFrame:
    """Jumps that no recorded action explains, and recorded splits without a move."""
    w = Window.partitionBy("instrument_id").orderBy("session_date", "line")
    m = bars.withColumn("_was", F.lag("close").over(w)).where("_was > 0 and close > 0").withColumn("_move", F.col("close") / F.col("_was") - 1)
    j = m.join(actions.select("instrument_id", F.col("ex_date").alias("session_date"), "ratio"), ["instrument_id", "session_date"], "left")
    unexplained = j.where((F.abs("_move") >= jump) & F.col("ratio").isNull())
    unmoved = j.where(F.col("ratio").isNotNull() & (F.abs((1 + F.col("_move")) * F.col("ratio") - 1) > 0.25))
    return _finding(unexplained, "unexplained_jump", WARN).unionByName(_finding(unmoved, "split_without_move", WARN))


def extreme_moves(bars: DataFrame, limit: float = 0.8) -> DataFrame:
    w = Window.partitionBy("instrument_id").orderBy("session_date", "line")
    m = bars.withColumn("_was", F.lag("close").over(w)).where("_was > 0")
    return _finding(m.where(F.abs(F.col("close") / F.col("_was") - 1) > limit), "extreme_move", WARN)


def timestamps(facts: DataFrame, now: Column) -> DataFrame:
    early = facts.where("knowledge_time < event_time")
    future = facts.where(F.col("event_time") > now)
    drift = facts.where(F.abs(F.datediff(F.to_date("event_time"), "session_date")) > 1)
    return _finding(early, "known_before_event", REJECT).unionByName(_finding(future, "future_event", REJECT)).unionByName(_finding(drift, "session_drift", WARN))


def missing_sessions(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Exchange sessions between a series' first and last bar for which it has none."""
    span = bars.groupBy("instrument_id").agg(F.min("session_date").alias("valid_from"), F.date_add(F.max("session_date"), 1).alias("valid_to"))
    expected = sessions_within(span, calendar.select("session_date", "session_ord"))
    return expected.join(bars.select("instrument_id", "session_date"), ["instrument_id", "session_date"], "left_anti").select("instrument_id", "session_date", "session_ord")


def gap_shape(bars: DataFrame, calendar: DataFrame, structural: int = 21) -> DataFrame:
    """complete, scattered, structural or mixed per series, by the runs of missing sessions."""
    w = Window.partitionBy("instrument_id").orderBy("session_ord")
    gaps = missing_sessions(bars, calendar).withColumn("_g", F.col("session_ord") - F.row_number().over(w)).groupBy("instrument_id", "_g").agg(F.count(F.lit(1)).alias("n"))
    per = gaps.groupBy("instrument_id").agg(F.sum("n").alias("missing"), F.max("n").alias("longest"), F.count_if(F.col("n") >= structural).alias("_s"), F.count_if(F.col("n") < structural).alias("_r"))
    out = bars.select("instrument_id").distinct().join(per, "instrument_id", "left")
    shape = F.when(F.col("missing").isNull(), "complete").when(F.col("_s") == 0, "scattered").when(F.col("_r") == 0, "structural").otherwise("mixed")
    return out.select("instrument_id", F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("longest", F.lit(0)).alias("longest"), shape.alias("shape"))


def mapping_overlaps(mappings: DataFrame) -> DataFrame:
    """One ticker for two instruments, or one instrument under two tickers, at the same time."""
    a, b = mappings.alias("a"), mappings.alias("b")
    forever = F.lit("9999-12-31").cast("date")
    meet = (F.col("a.valid_from") < F.coalesce("b.valid_to", forever)) & (F.col("b.valid_from") < F.coalesce("a.valid_to", forever))
    tickers = a.join(b, (F.col("a.ticker") == F.col("b.ticker")) & (F.col("a.instrument_id") < F.col("b.instrument_id")) & meet)
    names = a.join(b, (F.col("a.instrument_id") == F.col("b.instrument_id")) & (F.col("a.ticker") < F.col("b.ticker")) & meet)
    pick = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("a.instrument_id").alias("first_id"), F.col("b.instrument_id").alias("second_id"), F.col("a.ticker").alias("first_ticker"), F.col("b.ticker").alias("second_ticker"))
    return pick(tickers, "shared_ticker").unionByName(pick(names, "two_tickers"))


def report(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """All bar checks; one shape of finding."""
    out = duplicates(bars)
    for more in (ohlc(bars), positive_prices(bars), volume(bars), stale_prices(bars), moves(bars, actions), extreme_moves(bars)):
        out = out.unionByName(more)
    return out


def blocking(findings: DataFrame) -> DataFrame:
    """Instruments with at least one rejection."""
    return findings.where(F.col("severity") == REJECT).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("rejections"))


def agree(a: Column, b: Column) -> Column:
    return F.abs(a / b - 1) <= 1e-6


def reciprocal(a: Column, b: Column) -> Column:
    return F.abs(a * b - 1) <= 1e-6


def multiplier(value: Column, convention: Column) -> Column:
    """Shares after for one share before, from a vendor's convention."""
    return F.when(convention == "new_per_old", value).when(convention == "old_per_new", 1 / value)


def compare_schedules(a: DataFrame, b: DataFrame, first: Column, last: Column) -> DataFrame:
    """Two vendors' splits on (instrument, date): agree, reciprocal, conflict, missing from one, outside coverage."""
    j = a.select("instrument_id", "ex_date", F.col("ratio").alias("a")).join(b.select("instrument_id", "ex_date", F.col("ratio").alias("b")), ["instrument_id", "ex_date"], "full_outer")
    x, y = F.col("a"), F.col("b")
    status = (
        F.when((F.col("ex_date") < first) | (F.col("ex_date") > last), "outside_coverage")
        .when(y.isNull(), "missing_from_second")
        .when(x.isNull(), "missing_from_first")
        .when(agree(x, y), "agree")
        .when(reciprocal(x, y), "reciprocal")
        .otherwise("conflict")
    )
    return j.withColumn("status", status)


def schedule_consistency(splits: DataFrame, first: Column, last: Column) -> DataFrame:
    """Problems within one schedule: same-day duplicates and conflicts, implausible ratios, dates outside coverage."""
    days = splits.groupBy("instrument_id", "ex_date").agg(F.collect_list("ratio").alias("r"), F.count_distinct("ratio").alias("k"))
    r = F.col("r")
    problems = listed(
        duplicate=(F.size(r) > 1) & (F.col("k") == 1),
        reciprocal=F.exists(r, lambda x: F.exists(r, lambda y: reciprocal(x, y) & ~agree(x, y))),
        conflict=(F.col("k") > 1),
        implausible=F.exists(r, lambda x: (x > 1000) | (x < 0.001)),
        outside=(F.col("ex_date") < first) | (F.col("ex_date") > last),
    )
    return days.select("instrument_id", "ex_date", F.size("r").alias("n"), F.array_join(problems, ",").alias("problems")).where("problems <> ''")


def census(splits: DataFrame, spans: DataFrame) -> DataFrame:
    """Splits before, in and after each series' coverage (instrument_id, first_date, last_date)."""
    j = splits.join(spans, "instrument_id")
    e = F.col("ex_date")
    return j.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(e < F.col("first_date")).alias("before"), F.count_if(e.between(F.col("first_date"), F.col("last_date"))).alias("inside"), F.count_if(e > F.col("last_date")).alias("after"))


def reconstructed(adjusted: DataFrame, splits: DataFrame) -> DataFrame:
    """Raw prices from split-adjusted ones: times all splits after the session."""
    from vantage.operators.asof import split_adjusted

    f = split_adjusted(adjusted.select("instrument_id", "session_date", "close"), splits).select("instrument_id", "session_date", "factor")
    return adjusted.join(f, ["instrument_id", "session_date"]).select("instrument_id", "session_date", (F.col("close") * F.col("factor")).alias("raw_close"), "factor")
