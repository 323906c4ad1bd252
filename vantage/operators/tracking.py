"""Tracked identities, relationships, breakout events, and audits over their histories."""

from __future__ import annotations

import datetime as dt
import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.functions.scalar import identity
from vantage.operators.tracker import EDGES, TERMINAL, ZERO, Sighting, Step, Tracker  # noqa: F401

HISTORY = "instrument_id int, key string, family string, session_date date, from_state string, to_state string, reason string, quality double"
NAMES = [k.split()[0] for k in HISTORY.split(", ")]
#: Widths of bins in which spans meet.
BIN_DAYS = (64, 256, 1024, 4096, 16384, 65536)
FIELDS = ("key", "family", "state", "quality", "level", "invalidation", "start")


def sightings(found: DataFrame) -> DataFrame:
    """instrument_id, day and what a tracker reads of each structure."""
    return found.select("instrument_id", F.unix_date("session_date").alias("day"), "key", "family", "state", "quality", "level", "invalidation", F.unix_date("start_date").alias("start"))


def step_rows(instrument: int, steps: list[Step]) -> list[tuple]:
    return [(instrument, s.key, s.family, ZERO + dt.timedelta(days=s.day), s.was, s.to, s.reason, s.quality) for s in steps]


def track(found: DataFrame, sessions: DataFrame, until: Column | None = None) -> DataFrame:
    """State history of each identity, folded over every session of its series; see the tracker for the rules.

    found: instrument_id, session_date, key, family, state, quality, level, invalidation, start_date.  sessions: instrument_id,
    session_date, close, also those on which nothing was found.  With ``until`` (one date for all), series that have been
    silent by then are closed; otherwise what lives at the end of a series stays open.
    """

    def fold(group: tuple, x: pd.DataFrame, calendar: pd.DataFrame) -> pd.DataFrame:
        by_day = defaultdict(list)
        for day, *rest in x.sort_values(["day", "key"])[["day", *FIELDS]].itertuples(index=False):
            by_day[day].append(Sighting(*rest))
        closes = calendar.sort_values("day").drop_duplicates("day")
        tracker, steps = Tracker(), []
        for day, close in zip(closes["day"].tolist(), closes["close"].tolist(), strict=True):
            steps += tracker.observe(day, None if close is None or math.isnan(close) else close, by_day[day])
        end = closes["end"].iloc[0] if len(closes) else None
        if end is not None and not pd.isna(end) and tracker.over() is not None and end >= tracker.over():
            steps += tracker.finish()
        return pd.DataFrame(step_rows(group[0], steps), columns=NAMES)

    end = F.lit(None).cast("int") if until is None else F.unix_date(until)
    days = sessions.select("instrument_id", F.unix_date("session_date").alias("day"), "close", end.alias("end"))
    return sightings(found).groupBy("instrument_id").cogroup(days.groupBy("instrument_id")).applyInPandas(fold, HISTORY)


def merged(spans: DataFrame, containment: float = 0.8) -> DataFrame:
    """Spans of one family and series that lie mostly inside a longer one go into it; the longest is taken first.

    spans: instrument_id, family, key, start_date, end_date.  Returns each key with the key that stands for it.
    """
    kinds = "instrument_id int, family string, key string, into string"

    def fold(x: pd.DataFrame) -> pd.DataFrame:
        first, last = (pd.to_datetime(x[c]).to_numpy().astype("datetime64[D]").astype(int) for c in ("start_date", "end_date"))
        order = sorted(range(len(x)), key=lambda i: (first[i] - last[i], first[i], x["key"].iloc[i]))
        kept, into = [], {}
        for i in order:
            home = next((k for k in kept if (min(last[i], last[k]) - max(first[i], first[k]) + 1) >= containment * (last[i] - first[i] + 1)), None)
            if home is None:
                kept.append(i)
            into[i] = i if home is None else home
        return pd.DataFrame({"instrument_id": x["instrument_id"], "family": x["family"], "key": x["key"], "into": [x["key"].iloc[into[i]] for i in range(len(x))]})

    return spans.groupBy("instrument_id", "family").applyInPandas(fold, kinds)


def believed(history: DataFrame, as_of: Column) -> DataFrame:
    """The state each identity had on a date."""
    seen = history.where(F.col("session_date") <= as_of)
    return seen.groupBy("key", "instrument_id", "family").agg(F.max_by("to_state", "session_date").alias("state"), F.max("session_date").alias("since"))


def _bin_of(day: str) -> Column:
    return F.floor(F.col(day) / F.col("_wide"))


def lasting(days: DataFrame) -> DataFrame:
    """Spans (s, e) in the bins that they touch: one or two of the least width that holds them, more only beyond the greatest width."""
    wide = F.coalesce(*(F.when(F.col("e") - F.col("s") < w, w) for w in BIN_DAYS[:-1]), F.lit(BIN_DAYS[-1]))
    return days.withColumn("_wide", wide).withColumn("_bin", F.explode(F.sequence(_bin_of("s"), _bin_of("e"))))


def starting(days: DataFrame) -> DataFrame:
    """Spans in the bin of their start, of each width."""
    return days.withColumn("_wide", F.explode(F.array(*map(F.lit, BIN_DAYS)))).withColumn("_bin", _bin_of("s"))


def relationships(spans: DataFrame) -> DataFrame:
    """Pairs of structures of one series whose spans overlap: near-identical of two families, containing, nested, overlapping.

    Near-identical spans of one family are one structure read twice and get no edge.

    spans: instrument_id, key, family, start_date, end_date.  A pair meets once, in the bin of days in which the later of the two
    starts: each span looks there for those that are under way.  Bins are as wide as the earlier span is long, or up to four times
    as wide, so work follows the overlaps and a span is copied some eight times, however long it is.
    """
    days = spans.select("instrument_id", "key", "family", F.unix_date("start_date").alias("s"), F.unix_date("end_date").alias("e"))
    later, under_way = starting(days).alias("y"), lasting(days).alias("x")
    before = (F.col("x.s") < F.col("y.s")) | ((F.col("x.s") == F.col("y.s")) & (F.col("x.key") < F.col("y.key")))
    meet = (F.col("x.instrument_id") == F.col("y.instrument_id")) & (F.col("x._wide") == F.col("y._wide")) & (F.col("x._bin") == F.col("y._bin")) & before & (F.col("x.e") >= F.col("y.s"))
    both = F.least("x.e", "y.e") - F.col("y.s") + 1  # x starts first, so the pair begins with y
    share = lambda which: both / (F.col(f"{which}.e") - F.col(f"{which}.s") + 1)
    pairs = under_way.join(later, meet).select(
        F.col("x.key").alias("kx"), F.col("y.key").alias("ky"), (F.col("x.key") < F.col("y.key")).alias("first"), (F.col("x.family") != F.col("y.family")).alias("unlike"), share("x").alias("px"), share("y").alias("py")
    )
    first, of_from, of_to = F.col("first"), F.when(F.col("first"), F.col("px")).otherwise(F.col("py")), F.when(F.col("first"), F.col("py")).otherwise(F.col("px"))
    kind = (
        F.when((F.col("px") >= 0.85) & (F.col("py") >= 0.85), F.when(F.col("unlike"), "RELATED_TO"))
        .when(of_to >= 0.8, "CONTAINS").when(of_from >= 0.8, "NESTED_IN").when(F.greatest("px", "py") >= 0.25, "OVERLAPS")
    )
    ends = F.when(first, F.col("kx")).otherwise(F.col("ky")), F.when(first, F.col("ky")).otherwise(F.col("kx"))
    return pairs.select(ends[0].alias("from_key"), ends[1].alias("to_key"), kind.alias("kind"), F.greatest("px", "py").alias("overlap")).where("kind is not null")


def coexistence(found: DataFrame) -> DataFrame:
    """How often two families fire on one series and session."""
    f = found.select("instrument_id", "session_date", "family").distinct()
    a, b = f, f.withColumnRenamed("family", "other")
    return a.join(b, ["instrument_id", "session_date"]).where("family < other").groupBy("family", "other").agg(F.count(F.lit(1)).alias("n"))


def event_identity(instrument: Column, anchor: Column, attempt: Column) -> Column:
    return identity(instrument, F.lit("1d"), anchor, attempt)


def churn(history: DataFrame) -> DataFrame:
    """Observations per identity: quantiles by position int(q * (n - 1)) of the sorted counts, and the share observed once."""
    return churn_of(history.groupBy("key").agg(F.count(F.lit(1)).alias("n")))


def churn_of(identities: DataFrame) -> DataFrame:
    """As churn(), of identities with their number of observations, n."""
    counts = identities.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    w = Window.orderBy("n")  # distinct counts only, a handful of rows
    ranked = counts.withColumn("upto", F.sum("k").over(w)).withColumn("total", F.sum("k").over(Window.partitionBy(F.lit(1))))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(q * (F.col("total") - 1)), F.col("n")))
    return ranked.agg(F.max("total").alias("identities"), at(0.5).alias("median"), at(0.9).alias("p90"), (F.sum(F.when(F.col("n") == 1, F.col("k")).otherwise(0)) / F.max("total")).alias("single_share"))


def concentration(found: DataFrame, number: Column | None = None) -> DataFrame:
    """Share of each series in all detections, and whether it is more than a quarter; ``number``: how many the rows of a series stand for, if not one each."""
    per = found.groupBy("instrument_id").agg((F.count(F.lit(1)) if number is None else number).alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("instrument_id", "n", (F.col("n") / F.col("total")).alias("share"), (F.col("n") > 0.25 * F.col("total")).alias("flagged"))
