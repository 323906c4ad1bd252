"""Audits over stored histories of structures and breakout events: legality, causality, distribution, stability, concentration, scope.

Every audit returns the rows or counts that a reader judges; what must be empty is empty on a sound history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.operators.tracking import EDGES, TERMINAL

#: Legal edges of a breakout event; a state may also stay as it is, except that terminal states end the history.  Fixed values.
_EARLY = ("not_approaching", "approaching", "testing_resistance", "intraday_break", "closed_above", "rejected", "expired")
_RETEST = ("retest_pending", "retest_holding", "failed_breakout", "expired")
EVENT_EDGES = {
    "not_approaching": _EARLY,
    "approaching": _EARLY,
    "testing_resistance": _EARLY,
    "intraday_break": _EARLY,
    "closed_above": ("closed_above", "confirmation_pending", "confirmed", *_RETEST),
    "confirmation_pending": ("confirmation_pending", "confirmed", *_RETEST),
    "confirmed": ("confirmed", *_RETEST),
    "retest_pending": ("confirmation_pending", "confirmed", *_RETEST),
    "retest_holding": ("retest_holding", "retest_confirmed", "failed_breakout", "expired"),
    "retest_confirmed": ("retest_confirmed", "confirmation_pending", "confirmed", *_RETEST),
    "rejected": ("rejected", "failed_breakout", "expired"),
}
FAMILY_STATES = {"breakout_retest": ("FORMING", "MATURE", "BROKEN_OUT_UNCONFIRMED", *TERMINAL)}


def steps(history: DataFrame, key: str, state: str = "to_state") -> DataFrame:
    """Adds from_state, the state of the same key before; rows in order of session and seq."""
    w = Window.partitionBy(key).orderBy("session_date", "seq")
    return history.withColumn("from_state", F.lag(state).over(w))


def _legal(pairs: dict[str, tuple[str, ...]], was: Column, now: Column) -> Column:
    out = F.lit(False)
    for state, others in pairs.items():
        out = F.when(was == state, now.isin(*others)).otherwise(out)
    return out


def illegal_structure_steps(history: DataFrame) -> DataFrame:
    """Steps outside the table of edges, or into a state that the family can't have; history as of steps()."""
    was, now = F.col("from_state"), F.col("to_state")
    allowed = F.lit(True)
    for family, states in FAMILY_STATES.items():
        allowed = F.when(F.col("family") == family, now.isin(*states)).otherwise(allowed)
    return history.where(was.isNotNull() & (was != now) & ~(_legal(EDGES, was, now) & allowed))


def illegal_event_steps(history: DataFrame) -> DataFrame:
    was, now = F.col("from_state"), F.col("to_state")
    return history.where(was.isNotNull() & (was != now) & ~_legal(EVENT_EDGES, was, now))


def net_steps(history: DataFrame, key: str = "key") -> DataFrame:
    """One change per key and session: from the first state of the day to the last, by seq."""
    return history.groupBy(key, "session_date").agg(F.min_by("from_state", "seq").alias("from_state"), F.max_by("to_state", "seq").alias("to_state"), F.count(F.lit(1)).alias("collapsed"))


def state_on(history: DataFrame, asked: DataFrame, key: str = "event_key") -> DataFrame:
    """asked (key, on) with the state of the key on that date; null where it had none yet."""
    h = history.select(F.col(key).alias("_k"), "session_date", "seq", "to_state")
    x = asked.join(h, (F.col(key) == F.col("_k")) & (F.col("session_date") <= F.col("on")), "left")
    return x.groupBy(key, "on").agg(F.max_by("to_state", F.struct("session_date", "seq")).alias("state"))


def current(history: DataFrame, key: str = "key") -> DataFrame:
    """The newest row of each key with its first session and number of observations."""
    return history.groupBy(key).agg(
        F.max_by(F.struct(*[c for c in history.columns if c != key]), F.struct("session_date", "seq")).alias("x"), F.min("session_date").alias("first_session"), F.count(F.lit(1)).alias("observations")
    ).select(key, "x.*", "first_session", "observations")


def screenable(now: DataFrame, least: float = 60.0) -> DataFrame:
    """Established structures over a quality floor."""
    return now.where(F.col("to_state").isin("MATURE", "NEAR_BREAKOUT", "BROKEN_OUT_UNCONFIRMED") & (F.col("quality") >= least))


def advanced(stored: DataFrame, incoming: DataFrame, key: str = "key") -> DataFrame:
    """Observations not stored yet, by key, session and seq: writing them twice adds nothing."""
    return incoming.join(stored.select(key, "session_date", "seq"), [key, "session_date", "seq"], "left_anti")


def new_edges(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Relationship edges (from_key, to_key, kind) not stored yet, each once."""
    keys = ["from_key", "to_key", "kind"]
    return incoming.select(*keys).distinct().join(stored.select(*keys), keys, "left_anti")


def superseded_edges(history: DataFrame) -> DataFrame:
    """An identity that ended and the next one of the same base key."""
    base = F.substring_index("key", ":", 1)
    per = history.groupBy(base.alias("base"), "key").agg(F.min("session_date").alias("first"), F.max("session_date").alias("last"))
    w = Window.partitionBy("base").orderBy("first", "key")
    return per.withColumn("to_key", F.lead("key").over(w)).where("to_key is not null").select(F.col("key").alias("from_key"), "to_key", F.lit("SUPERSEDED_BY").alias("kind"))


def detection_rate(history: DataFrame, scope: DataFrame) -> DataFrame:
    """First detections of each family per instrument-year of scanned history; scope: instrument_id, first_date, last_date."""
    years = scope.agg((F.sum(F.datediff("last_date", "first_date")) / 365.25).alias("years"))
    n = history.groupBy("family").agg(F.count_distinct("key").alias("identities"))
    return n.join(F.broadcast(years)).withColumn("per_year", F.col("identities") / F.col("years"))  # one row of totals


def early_detections(history: DataFrame) -> DataFrame:
    """Structures first seen before what they are made of was known; known_through: the end frozen at insert."""
    first = history.groupBy("key").agg(F.min_by(F.struct("session_date", "known_through"), F.struct("session_date", "seq")).alias("x")).select("key", "x.*")
    return first.where(F.col("session_date") < F.col("known_through"))


def score_distribution(history: DataFrame) -> DataFrame:
    """Quality and coverage of each family, and whether at least 20 rows all score the same."""
    q = F.col("quality")
    return history.groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), F.min(q).alias("low"), F.avg(q).alias("mean"), F.max(q).alias("high"), F.min("coverage").alias("least_coverage"), F.avg("coverage").alias("mean_coverage"),
        ((F.count(F.lit(1)) >= 20) & (F.max(q) - F.min(q) < 1e-9)).alias("constant"),
    )


def identity_stability(history: DataFrame, least: float = 2.0) -> DataFrame:
    """Identities, observations of each, the share seen once, the share with a re-mint suffix, and whether they are re-minted too often."""
    per = history.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("identities"), F.sum("n").alias("observations"), F.avg("n").alias("mean"), F.avg((F.col("n") == 1).cast("double")).alias("single_share"),
        F.avg(F.col("key").rlike(r":\d{4}-\d{2}-\d{2}$").cast("double")).alias("forked_share"), (F.avg("n") < least).alias("flagged"),
    )


def concentration(history: DataFrame, scanned: DataFrame, instrument_share: float = 0.25, session_share: float = 0.05) -> DataFrame:
    """What supplies too much of all detections, by instrument and by first session, and scanned instruments that supply nothing."""
    first = history.groupBy("key").agg(F.min("session_date").alias("session_date"), F.min("instrument_id").alias("instrument_id"))
    total = first.agg(F.count(F.lit(1)).alias("total"))

    def share(by: str, kind: str, most: float) -> DataFrame:
        per = first.groupBy(by).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total))  # one row of totals
        return per.where(F.col("n") > most * F.col("total")).select(F.lit(kind).alias("kind"), F.col(by).cast("string").alias("what"), "n")

    silent = scanned.join(first, "instrument_id", "left_anti").select(F.lit("silent").alias("kind"), F.col("instrument_id").cast("string").alias("what"), F.lit(0).cast("long").alias("n"))
    return share("instrument_id", "instrument", instrument_share).unionByName(share("session_date", "session", session_share)).unionByName(silent)


def identity_churn(history: DataFrame) -> DataFrame:
    """Per family: identities, re-minted ones, the element at int(q * (n - 1)) of the sorted observations and lifespans, the share seen once, and crowded bases."""
    per = history.groupBy("family", "key").agg(F.count(F.lit(1)).alias("obs"), F.datediff(F.max("session_date"), F.min("session_date")).alias("life"))
    counts = per.groupBy("family", "obs").agg(F.count(F.lit(1)).alias("c"))
    lives = per.groupBy("family", "life").agg(F.count(F.lit(1)).alias("c"))

    def quantile(table: DataFrame, value: str, q: float, name: str) -> DataFrame:
        w = Window.partitionBy("family").orderBy(value)
        upto = table.withColumn("_u", F.sum("c").over(w)).withColumn("_t", F.sum("c").over(Window.partitionBy("family")))
        return upto.where(F.col("_u") > F.floor(q * (F.col("_t") - 1))).groupBy("family").agg(F.min(value).alias(name))

    base = per.groupBy("family", F.substring_index("key", ":", 1).alias("base")).agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(F.count_if(F.col("n") > 1).alias("crowded"))
    out = per.groupBy("family").agg(F.count(F.lit(1)).alias("identities"), F.count_if(F.col("key").contains(":")).alias("forked"), F.avg((F.col("obs") <= 1).cast("double")).alias("single_share"))
    for table, value, q, name in ((counts, "obs", 0.5, "obs_median"), (counts, "obs", 0.9, "obs_p90"), (counts, "obs", 0.99, "obs_p99"), (lives, "life", 0.5, "life_median")):
        out = out.join(quantile(table, value, q, name), "family")
    return out.join(base, "family")


def event_causality(history: DataFrame, events: DataFrame) -> DataFrame:
    """Observations before their event was opened, and sessions with more than one; events: event_key, opened_session."""
    early = history.join(events, "event_key").where(F.col("session_date") < F.col("opened_session")).select("event_key", "session_date", F.lit("before_opening").alias("problem"))
    twice = history.groupBy("event_key", "session_date").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("event_key", "session_date", F.lit("several_in_a_session").alias("problem"))
    return early.distinct().unionByName(twice)


def transition_counts(history: DataFrame) -> DataFrame:
    return history.groupBy(F.coalesce("from_state", F.lit("new")).alias("from_state"), "to_state").agg(F.count(F.lit(1)).alias("n"))


def scan_scope(requested: DataFrame, ledger: DataFrame) -> DataFrame:
    """Requested instruments with what became of them: completed (with span), failed or unscanned; ledger: instrument_id, outcome, first_date, last_date."""
    x = requested.join(ledger, "instrument_id", "left")
    status = F.when(F.col("outcome") == "done", "completed").when(F.col("outcome").isNotNull(), "failed").otherwise("unscanned")
    return x.withColumn("status", status).groupBy("status").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.when(F.col("outcome") == "done", F.datediff("last_date", "first_date"))) / 365.25).alias("years"))


def monotone(series: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Per group whether a swept series never rises and whether it never falls."""
    w = Window.partitionBy(by).orderBy(order)
    x = series.withColumn("_d", F.col(value) - F.lag(value).over(w))
    return x.groupBy(by).agg(F.coalesce(F.bool_and(F.col("_d") <= 0), F.lit(True)).alias("non_increasing"), F.coalesce(F.bool_and(F.col("_d") >= 0), F.lit(True)).alias("non_decreasing"))


def tally(checks: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """Outcome of all checks: phase, status (pass where a check found nothing) and how many; each check is counted where it runs, nothing is collected."""
    out = None
    for name, (phase, found) in checks.items():
        one = found.agg(F.count(F.lit(1)).alias("found")).select(F.lit(name).alias("check"), F.lit(phase).alias("phase"), F.when(F.col("found") == 0, "pass").otherwise("fail").alias("status"), "found")
        out = one if out is None else out.unionByName(one)
    return out
