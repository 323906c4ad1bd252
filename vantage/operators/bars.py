"""Time-bucket aggregation of bars and alignment of coarser series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.operators.asof import asof_join


def period_start(timeframe: str, day: Column) -> Column:
    """First day of the ISO week or calendar month."""
    return F.to_date(F.date_trunc({"1w": "week", "1mo": "month"}[timeframe], day))


def aggregate_daily(bars: DataFrame, calendar: DataFrame, timeframe: str, as_of: Column) -> DataFrame:
    """Weekly or monthly bars; ``complete`` once the period's last scheduled session has passed, whatever the data hold."""
    start = period_start(timeframe, F.col("session_date")).alias("period_start")
    ends = calendar.groupBy(start).agg(F.max("session_date").alias("scheduled_end"))
    folded = bars.groupBy("instrument_id", start).agg(
        F.min_by("open", "session_date").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "session_date").alias("close"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("n_sessions"),
        F.max("session_date").alias("period_end"),
    )
    return folded.join(ends, "period_start").withColumn("complete", F.col("scheduled_end") <= as_of)


def completed_only(bars: DataFrame) -> DataFrame:
    return bars.where("complete")


def aggregate_intraday(ticks: DataFrame, minutes: int, open_minute: int = 0) -> DataFrame:
    """Bars anchored to the session open; ticks are stamped at their close, so one on a boundary belongs to the bar before."""
    opened = F.unix_micros(F.col("session_date").cast("timestamp")) + open_minute * 60_000_000
    bucket = F.floor((F.unix_micros("event_time") - 1 - opened) / (minutes * 60_000_000))
    order = F.struct("event_time", "event_id")
    return ticks.groupBy("instrument_id", "session_date", bucket.cast("int").alias("bucket")).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("volume").alias("volume"),
    )


def align_to_daily(daily: DataFrame, higher: DataFrame) -> DataFrame:
    """Each session with the last completed higher bar that ended on or before it."""
    done = completed_only(higher).select("instrument_id", F.col("period_end").alias("ended"), F.col("close").alias("higher_close"))
    return asof_join(daily.select("instrument_id", "session_date"), done, "session_date", "ended", ["instrument_id"], ["ended", "higher_close"])


def no_future(higher: DataFrame, as_of: Column) -> DataFrame:
    """One row: whether no aggregated bar reaches past the boundary."""
    return higher.agg(F.coalesce(F.bool_and(F.col("period_end") <= as_of), F.lit(True)).alias("causal"), F.count(F.lit(1)).alias("n_bars"))


def volume_curve(ticks: DataFrame, minutes: int = 60, least_sessions: int = 3) -> DataFrame:
    """Mean cumulative share of a session's volume by bucket, made monotone; instruments with too few sessions have none."""
    buckets = 24 * 60 // minutes
    per = ticks.groupBy("instrument_id", "session_date", F.floor((F.unix_timestamp("event_time") - F.unix_timestamp(F.col("session_date").cast("timestamp"))) / (60 * minutes)).cast("int").alias("bucket")).agg(F.sum("volume").alias("v"))
    days = per.groupBy("instrument_id", "session_date").agg(F.sum("v").alias("total"), F.map_from_entries(F.collect_list(F.struct("bucket", "v"))).alias("m"))
    grid = days.select("instrument_id", "session_date", "total", "m", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    upto = F.aggregate(F.sequence(F.lit(0), F.col("bucket")), F.lit(0.0), lambda acc, i: acc + F.coalesce(F.element_at("m", i), F.lit(0.0)))
    curve = grid.groupBy("instrument_id", "bucket").agg(F.avg(upto / F.col("total")).alias("share"), F.count(F.lit(1)).alias("n_sessions")).where(F.col("n_sessions") >= least_sessions)
    w = Window.partitionBy("instrument_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("share", F.when(F.col("bucket") == buckets - 1, F.lit(1.0)).otherwise(F.max("share").over(w)))


def expected_fraction(asked: DataFrame, curve: DataFrame, minutes: int = 60) -> DataFrame:
    """asked (instrument_id, minute of the session) with the interpolated share of volume expected by then."""
    at = F.col("minute") / minutes
    a = asked.withColumn("k", F.floor(at).cast("int"))
    before = curve.select("instrument_id", (F.col("bucket") + 1).alias("k"), F.col("share").alias("lo"))
    here = curve.select("instrument_id", F.col("bucket").alias("k"), F.col("share").alias("hi"))
    both = a.join(here, ["instrument_id", "k"]).join(before, ["instrument_id", "k"], "left")
    lo = F.coalesce("lo", F.lit(0.0))
    return both.select("instrument_id", "minute", (lo + (F.col("hi") - lo) * (at - F.col("k"))).alias("expected"))
