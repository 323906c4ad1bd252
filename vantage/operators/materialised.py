"""Reads of materialised results, results assembled per security, capabilities, declared feature sets, package merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_series(values: DataFrame, instrument: Column, feature: str) -> DataFrame:
    """One feature of some instruments from the long table (instrument_id, session_date, feature, value)."""
    return values.where((F.col("feature") == feature) & instrument)


def cross_section(values: DataFrame, roster: DataFrame, feature: str, on: Column) -> DataFrame:
    """A feature over an explicit roster on a date; a member without a value has no row, never a default."""
    return values.where((F.col("feature") == feature) & (F.col("session_date") == on)).join(roster.select("instrument_id").distinct(), "instrument_id")


def latest_value(values: DataFrame, on: Column) -> DataFrame:
    """The newest value of each instrument and feature at or before a date."""
    return values.where((F.col("session_date") <= on) & F.col("value").isNotNull()).groupBy("instrument_id", "feature").agg(F.max_by("value", "session_date").alias("value"), F.max("session_date").alias("as_of"))


def latest_state(states: DataFrame, asked: DataFrame, columns: list[str]) -> DataFrame:
    """asked (on) with the newest state (session_date, columns) at or before each date.

    States and questions are put side by side and sorted once by month and the month's last state is carried on, so no
    question is compared with every state.
    """
    month = lambda c: F.trunc(c, "month")
    per_month = states.groupBy(month("session_date").alias("m")).agg(F.max_by(F.struct("session_date", *columns), "session_date").alias("s"))
    earlier = asked.select("on").distinct().join(per_month, F.col("m") < month("on"), "left").groupBy("on").agg(F.max("s").alias("before"))
    inside = asked.select("on").distinct().join(states.withColumn("m", month("session_date")), (F.col("m") == month("on")) & (F.col("session_date") <= F.col("on")), "left").groupBy("on").agg(F.max_by(F.struct("session_date", *columns), "session_date").alias("now"))
    return earlier.join(inside, "on").withColumn("s", F.coalesce("now", "before")).select("on", "s.*")


def strength_results(compared: DataFrame, percentiles: DataFrame, groups: DataFrame, score, lookbacks: tuple[int, ...]) -> DataFrame:
    """One row per security and date: comparisons by benchmark and lookback, percentiles by lookback, sector percentile, roster size, score.

    compared: as of cross.compared, columns relative_<lookback> a benchmark.  score: a column, given a function from lookback to percentile.
    """
    keys = ["instrument_id", "session_date"]
    entry = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    of_benchmark = F.array_compact(F.array(*(F.when(F.col(f"relative_{k}").isNotNull(), entry(F.concat_ws(":", "benchmark_id", F.lit(k)), F.col(f"relative_{k}"))) for k in lookbacks)))
    c = compared.select(*keys, of_benchmark.alias("x")).where(F.size("x") > 0).groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.flatten(F.collect_list("x")))).alias("comparisons"))
    at = {k: F.max(F.when(F.col("lookback") == k, F.col("percentile"))).alias(f"p{k}") for k in lookbacks}
    p = percentiles.groupBy(*keys).agg(*at.values(), F.max("roster_size").alias("roster_size"))
    by = F.map_from_arrays(F.array(*map(F.lit, lookbacks)), F.array(*(F.col(f"p{k}") for k in lookbacks)))
    p = p.select(*keys, "roster_size", by.alias("percentiles"), score(lambda k: F.col(f"p{k}")).alias("score"))
    return p.join(c, keys, "left").join(groups, keys, "left")


def capabilities(per_instrument: DataFrame) -> DataFrame:
    """Flags and what keeps the others off; per_instrument: has_bars, n_sessions, has_splits, has_fundamentals, has_sector."""
    rules = {
        "price": F.col("has_bars"), "features": F.col("n_sessions") >= 252, "adjustment": F.col("has_splits"), "fundamentals": F.col("has_fundamentals"), "sector_rank": F.col("has_sector") & (F.col("n_sessions") >= 60),
    }
    have = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(n)) for n, rule in rules.items())))
    lack = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(n)) for n, rule in rules.items())))
    return per_instrument.withColumns({"capabilities": have, "lacking": lack})


def with_capability(x: DataFrame, name: str) -> DataFrame:
    return x.where(F.array_contains("capabilities", name))


def declared(features: DataFrame, names: list[str]) -> DataFrame:
    """The declared features only; a name that the table doesn't have is an error."""
    missing = [n for n in names if n not in features.columns]
    if missing:
        raise ValueError(f"undeclared or unknown features: {missing}")
    return features.select("instrument_id", "session_date", *names)


def unconsumed(catalogue: DataFrame, sets: DataFrame) -> DataFrame:
    """Features of the catalogue (feature) that no set (consumer, feature) reads."""
    return catalogue.join(sets.select("feature").distinct(), "feature", "left_anti")


def as_bars(aggregated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Finished periods as bar rows, and the unfinished ones that are refused."""
    bars = aggregated.where("complete").select("instrument_id", F.col("period_end").alias("session_date"), "open", "high", "low", "close", "volume")
    return bars, aggregated.where("not complete").select("instrument_id", "period_start")


def quantised(x: Column, digits: int) -> Column:
    """A decimal rounded half to even at so many digits."""
    return F.bround(x.cast("decimal(28,10)"), digits)


def percent_change(now: Column, was: Column) -> Column:
    return F.when(was != 0, (now - was) / was)


def basis_points(x: Column) -> Column:
    return quantised(x * 10_000, 2)


def split_events(payloads: DataFrame) -> DataFrame:
    """Vendor payloads (symbol, payload json array of date, numerator, denominator or ratio 'a:b') to events or explained rejects."""
    kind = "array<struct<date:string,numerator:double,denominator:double,ratio:string>>"
    x = payloads.select("symbol", F.explode(F.from_json("payload", kind)).alias("x")).select("symbol", "x.*")
    parts = F.split("ratio", ":")
    top = F.coalesce("numerator", F.get(parts, F.lit(0)).try_cast("double"))
    bottom = F.coalesce("denominator", F.get(parts, F.lit(1)).try_cast("double"))
    day = F.try_to_date("date", "yyyy-MM-dd")
    why = F.when(day.isNull(), "bad_date").when(top.isNull() | bottom.isNull(), "no_ratio").when((top <= 0) | (bottom <= 0), "not_positive").when(top == bottom, "no_change")
    return x.select("symbol", day.alias("ex_date"), F.when(why.isNull(), top / bottom).alias("ratio"), why.alias("rejected"))


def enriched(prices: DataFrame, own: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One vendor's splits completed by another's for the symbols that have prices, and each symbol's status.

    own and other: instrument_id, ex_date, ratio.  The own vendor's row stands where both have the date.
    """
    covered = prices.select("instrument_id").distinct()
    keys = ["instrument_id", "ex_date"]
    added = other.join(own, keys, "left_anti").join(covered, "instrument_id", "left_semi")
    merged = own.withColumn("source", F.lit("own")).unionByName(added.withColumn("source", F.lit("other")))
    clash = own.join(other.withColumnRenamed("ratio", "r"), keys).where(F.abs(F.col("ratio") / F.col("r") - 1) > 1e-6).select("instrument_id").distinct().withColumn("clash", F.lit(True))
    n = added.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("added"))
    o = own.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("own"))
    status = covered.join(n, "instrument_id", "left").join(o, "instrument_id", "left").join(clash, "instrument_id", "left")
    word = F.when(F.col("clash"), "conflict").when(F.col("added") > 0, "enriched").when(F.col("own") > 0, "unchanged").otherwise("no_actions")
    return merged, status.select("instrument_id", word.alias("status"), F.coalesce("added", F.lit(0)).cast("long").alias("added"))


def snapshot_audits(bars: DataFrame, fundamentals: DataFrame, imported: DataFrame, most_quarantined: float = 0.05, jump: float = 1.9) -> DataFrame:
    """check, measured and ok for a snapshot: rows there, quarantine rate, knowledge after the event, periods filed after their end, jumps, duplicates.

    bars: instrument_id, session_date, close, event_time, knowledge_time.  imported: stage.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("instrument_id").orderBy("session_date", "knowledge_time")
    was = F.lag("close").over(w)
    leap = F.greatest(F.col("close") / was, was / F.col("close")) > jump
    nth = F.row_number().over(Window.partitionBy("instrument_id", "session_date").orderBy("knowledge_time"))
    n = {"rows": F.count(F.lit(1)), "knowledge_order": F.count_if(F.col("knowledge_time") < F.col("event_time")), "jumps": F.count_if("_leap"), "duplicates": F.count_if(F.col("_nth") == 2)}
    counted = bars.withColumn("_leap", leap).withColumn("_nth", nth).agg(*(c.cast("double").alias(name) for name, c in n.items()))  # one pass: both windows share a shuffle and a sort
    of_bars = counted.unpivot([], list(n), "check", "measured").withColumn("ok", F.when(F.col("check") == "rows", F.col("measured") > 0).otherwise(F.col("measured") == 0))
    quarantine = imported.agg(F.avg((F.col("stage") != "dated").cast("double")).alias("measured")).select(F.lit("quarantine").alias("check"), "measured", (F.col("measured") <= most_quarantined).alias("ok"))
    late = fundamentals.agg(F.count_if(F.to_date("knowledge_time") < F.col("period_end")).cast("double").alias("measured")).select(F.lit("filed_after_period").alias("check"), "measured", (F.col("measured") == 0).alias("ok"))
    return of_bars.unionByName(quarantine).unionByName(late)
