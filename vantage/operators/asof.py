"""Point-in-time reads: visibility, revisions, interval and as-of joins, adjustment, episodes, session arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions.scalar import covers

BREAK_SESSIONS = 21


def visible(facts: DataFrame, as_of: Column) -> DataFrame:
    """Facts that were knowable at ``as_of``."""
    return facts.where(F.col("knowledge_time") <= as_of)


def newest(df: DataFrame, keys: Sequence[str], order: Column | str) -> DataFrame:
    """The row with the greatest ``order`` of each key; partial aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_x"))
    return best.select(*keys, *(F.col(f"_x.{c}").alias(c) for c in rest))


def history(facts: DataFrame, as_of: Column, include_suspect: bool = False, limit: int | None = None) -> DataFrame:
    """Bars as they stood at ``as_of``: newest visible revision of each session; ``limit`` keeps the most recent."""
    out = newest(visible(facts, as_of), ["instrument_id", "session_date"], "knowledge_time")
    if not include_suspect:
        out = out.where("quality <> 'suspect'")
    if limit is not None:
        tail = Window.partitionBy("instrument_id").orderBy(F.desc("session_date"))
        out = out.withColumn("_n", F.row_number().over(tail)).where(F.col("_n") <= limit).drop("_n")
    return out


def latest(facts: DataFrame, as_of: Column) -> DataFrame:
    """The most recent visible bar of each instrument."""
    return newest(history(facts, as_of), ["instrument_id"], "session_date")


def split_adjusted(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Bars with prices divided and volume multiplied by all splits after their session; on the ex-date itself nothing changes."""
    listed = splits.groupBy("instrument_id").agg(F.array_sort(F.collect_list(F.struct("ex_date", "ratio"))).alias("_splits"))
    after = F.filter("_splits", lambda s: s["ex_date"] > F.col("session_date"))
    factor = F.aggregate(after, F.lit(1.0), lambda acc, s: acc * s["ratio"])
    out = bars.join(listed, "instrument_id", "left").withColumn("factor", F.coalesce(factor, F.lit(1.0)))
    prices = {c: (F.col(c) / F.col("factor")).alias(c) for c in ("open", "high", "low", "close") if c in bars.columns}
    return out.select(*(prices.get(c, (F.col(c) * F.col("factor")).alias(c) if c == "volume" else F.col(c)) for c in bars.columns), "factor")


def total_return_factors(bars: DataFrame, dividends: DataFrame) -> DataFrame:
    """instrument_id, ex_date and factor (reference - cash) / reference, the reference being the close before the ex-date."""
    pre = asof_join(dividends.select("instrument_id", "ex_date", "cash_amount"), bars.select("instrument_id", "session_date", "close"), "ex_date", "session_date", ["instrument_id"], ["close"], strict=True)
    return pre.where(F.col("close") > 0).select("instrument_id", "ex_date", ((F.col("close") - F.col("cash_amount")) / F.col("close")).alias("ratio"))


def total_return_adjusted(bars: DataFrame, dividends: DataFrame) -> DataFrame:
    """Closes times the factors of all later dividends."""
    listed = total_return_factors(bars, dividends).groupBy("instrument_id").agg(F.array_sort(F.collect_list(F.struct("ex_date", "ratio"))).alias("_cash"))
    after = F.filter("_cash", lambda s: s["ex_date"] > F.col("session_date"))
    factor = F.aggregate(after, F.lit(1.0), lambda acc, s: acc * s["ratio"])
    return (
        bars.join(listed, "instrument_id", "left")
        .withColumn("factor", F.coalesce(factor, F.lit(1.0)))
        .select("instrument_id", "session_date", (F.col("close") * F.col("factor")).alias("close"), "factor")
    )


def asof_join(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str, keys: Sequence[str], take: Sequence[str], strict: bool = False
) -> DataFrame:
    """Each left row with the columns ``take`` of the last right row at or before it (before it, if ``strict``).

    Both sides are united and sorted once by key and time, so the cost is one shuffle whatever the ranges are.
    """
    order = F.lit(0 if strict else 1)
    a = left.select("*", F.col(left_on).alias("_t"), order.alias("_o"), F.lit(None).cast(_struct(right, take)).alias("_x"))
    b = right.select(
        *(F.col(k) if k in keys else F.lit(None).cast(left.schema[k].dataType).alias(k) for k in left.columns),
        F.col(right_on).alias("_t"),
        F.lit(1 if strict else 0).alias("_o"),
        F.struct(*take).alias("_x"),
    )
    w = Window.partitionBy(*keys).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    marked = a.withColumn("_left", F.lit(True)).unionByName(b.withColumn("_left", F.lit(False))).withColumn("_x", F.last("_x", ignorenulls=True).over(w))
    return marked.where("_left").select(*left.columns, *(F.col(f"_x.{c}").alias(c) for c in take))


def _struct(df: DataFrame, columns: Sequence[str]) -> str:
    return "struct<" + ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in columns) + ">"


def interval_at(df: DataFrame, intervals: DataFrame, on: str, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows of ``df`` with the interval of ``intervals`` that covers the date ``on``; the equality on ``keys`` carries the join."""
    i = intervals.alias("_i")
    match = covers(F.col(on), F.col("_i.valid_from"), F.col("_i.valid_to"))
    for k in keys:
        match = match & (df[k] == F.col(f"_i.{k}"))
    return df.join(i, match, how).select(*(df[c] for c in df.columns), *(F.col(f"_i.{c}") for c in intervals.columns if c not in keys))


def resolve_tickers(asked: DataFrame, mappings: DataFrame) -> DataFrame:
    """ticker, on, instrument_id and resolved: an unknown ticker is an error row, not a silent null."""
    m = mappings.withColumn("ticker", F.upper("ticker")).select("ticker", "instrument_id", "valid_from", "valid_to")
    found = interval_at(asked.withColumn("ticker", F.upper("ticker")), m, "on", ["ticker"], "left")
    return found.select("ticker", "on", "instrument_id", F.col("instrument_id").isNotNull().alias("resolved"))


def members(universe: DataFrame, on: Column) -> DataFrame:
    """Members on a date, survivors and casualties alike."""
    return universe.where(covers(on, F.col("valid_from"), F.col("valid_to")))


def series_of_metric(fundamentals: DataFrame, as_of: Column, periods: int = 8) -> DataFrame:
    """Newest visible revision of each fiscal period, the last ``periods`` of each metric."""
    kept = newest(visible(fundamentals, as_of), ["instrument_id", "metric", "fiscal_year", "fiscal_period"], "knowledge_time")
    w = Window.partitionBy("instrument_id", "metric").orderBy(F.desc("period_end"))
    return kept.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= periods).drop("_n")


def next_scheduled(earnings: DataFrame, as_of: Column, horizon_days: int = 45) -> DataFrame:
    """The next announcement of each instrument within the horizon, as known."""
    day = F.to_date(as_of)
    near = visible(earnings, as_of).where((F.col("scheduled_date") >= day) & (F.col("scheduled_date") <= F.date_add(day, horizon_days)))
    return newest(near, ["instrument_id"], F.struct(-F.unix_date("scheduled_date"), "knowledge_time"))


def episodes(sessions: DataFrame, break_sessions: int = BREAK_SESSIONS) -> DataFrame:
    """Adds episode_id: a new one after at least ``break_sessions`` missing exchange sessions (session_ord)."""
    w = Window.partitionBy("instrument_id").orderBy("session_ord")
    gap = F.col("session_ord") - F.lag("session_ord").over(w) - 1
    return sessions.withColumn("_new", F.coalesce((gap >= break_sessions).cast("int"), F.lit(0))).withColumn("episode_id", F.sum("_new").over(w)).drop("_new")


def prefix_mode(facts: DataFrame) -> DataFrame:
    """Whether one read and prefixes of it equal reads session by session.

    Not so where a session was revised, or a bar was knowable before the evaluation instant of the session before.
    """
    firsts = facts.groupBy("instrument_id", "session_date").agg(F.count(F.lit(1)).alias("n"), F.min("knowledge_time").alias("k"), F.max("event_time").alias("e"))
    w = Window.partitionBy("instrument_id").orderBy("session_date")
    early = F.col("k") < F.greatest(F.lag("k").over(w), F.lag("e").over(w))
    per = firsts.withColumn("early", F.coalesce(early, F.lit(False)))
    return per.groupBy("instrument_id").agg(F.count_if(F.col("n") > 1).alias("revised"), F.count_if("early").alias("early")).select(
        "instrument_id", "revised", "early", F.when((F.col("revised") == 0) & (F.col("early") == 0), "verified_prefix").otherwise("per_session_read").alias("mode")
    )


def shifted(df: DataFrame, calendar: DataFrame, n: int, on: str = "session_date") -> DataFrame:
    """Adds ``shifted``: the session n sessions after (before, if negative) that of ``on``; two equi-joins on the small calendar."""
    here = calendar.select(F.col("session_date").alias("_d"), F.col("session_ord").alias("_o"))
    there = calendar.select(F.col("session_date").alias("shifted"), F.col("session_ord").alias("_to"))
    return df.join(here, F.col(on) == F.col("_d"), "left").join(there, F.col("_o") + n == F.col("_to"), "left").drop("_d", "_o", "_to")


def sessions_between(df: DataFrame, calendar: DataFrame, first: str, last: str) -> DataFrame:
    """Adds n_sessions: sessions from ``first`` to ``last``, both included."""
    counted = calendar.select("session_date", "session_ord")
    a, b = counted.select(F.col("session_date").alias("_a"), F.col("session_ord").alias("_i")), counted.select(F.col("session_date").alias("_b"), F.col("session_ord").alias("_j"))
    return df.join(a, F.col(first) == F.col("_a"), "left").join(b, F.col(last) == F.col("_b"), "left").withColumn("n_sessions", F.col("_j") - F.col("_i") + 1).drop("_a", "_b", "_i", "_j")


def causal_knowledge(facts: DataFrame) -> DataFrame:
    """For every session the first instant at which it can be evaluated, and how many revisions were known then."""
    first = facts.groupBy("instrument_id", "session_date").agg(F.min(F.greatest("knowledge_time", "event_time")).alias("evaluated_at"))
    return facts.join(first, ["instrument_id", "session_date"]).groupBy("instrument_id", "session_date", "evaluated_at").agg(F.count_if(F.col("knowledge_time") <= F.col("evaluated_at")).alias("n_known"))


def sessions_within(intervals: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every row of ``intervals`` (valid_from, valid_to) with each session that it covers.

    Both sides meet on the month, an equality, so the join shuffles like any other however many intervals there are.
    """
    month = lambda c: F.trunc(c, "month")
    last = calendar.agg(F.max("session_date")).scalar()
    until = F.least(F.coalesce(F.col("valid_to"), last), last)
    spread = intervals.where(F.col("valid_from") <= until).withColumn("_month", F.explode(F.sequence(month("valid_from"), month(until), F.expr("interval 1 month"))))
    days = calendar.withColumn("_of", month("session_date"))
    return spread.join(days, (F.col("_month") == F.col("_of")) & covers(F.col("session_date"), F.col("valid_from"), F.col("valid_to"))).drop("_month", "_of")


def by_episode(bars: DataFrame, calendar: DataFrame, compute) -> DataFrame:
    """What ``compute`` makes of each unbroken stretch of a series, with episode_id; no window or recursion reaches across a structural break.

    While ``compute`` builds its plan, instrument and episode are the key of every series, so bars are dealt by both and an
    instrument of many episodes is many series.
    """
    from vantage.operators.features import keyed

    numbered = bars.join(calendar.select("session_date", "session_ord"), "session_date") if "session_ord" not in bars.columns else bars
    split = episodes(numbered).drop("session_ord")
    with keyed("instrument_id", "episode_id"):
        return compute(split)
