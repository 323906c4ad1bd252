"""The snapshot scan: every series walked session by session, with a ledger from which a stopped run goes on.

A walk takes one unbroken episode of one series: structures are sighted, the tracker moves their identities, and a monitor
follows the level of each identity that is mature, near its level or past it.  Running attempts are advanced before new ones
open, and an attempt ends with its identity.  Levels are frozen for an attempt when it opens: the level itself, the ATR of
that session, touches, certainty and quality of the structure.  Tracker, monitors and indicators start anew after a
structural break, so nothing reaches across one.

Series are dealt to chunks by a hash of their id; a chunk's rows are committed together, and only then its entries in the
ledger.  A run that was stopped leaves rows that no entry names, which readers pass over; the next run takes the series that
have no entry yet.  A forced run walks all series again and its entries replace the older ones.  Walking is deterministic, so a
stopped and resumed run gives the rows of an unbroken one.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage.operators import folds
from vantage.operators.asof import episodes
from vantage.operators.breakout import zone_of
from vantage.operators.machine import CONTEXT, STALE_DAYS, Line, Monitor
from vantage.operators.tracker import Tracker
from vantage.sources.staging import shared_path

MONITORED = ("MATURE", "NEAR_BREAKOUT", "BROKEN_OUT_UNCONFIRMED")
VOLUME_SESSIONS = 20
SERIES_A_CHUNK, MOST_CHUNKS = 1_000, 64
STRUCTURES = "instrument_id int, timeframe string, episode_id long, key string, family string, session_date date, from_state string, to_state string, reason string, quality double"
EVENTS = "instrument_id int, timeframe string, episode_id long, key string, attempt int, session_date date, from_state string, to_state string, reason string, level double, tolerance double, close double"
LEDGER = "instrument_id int, timeframe string, episode_id long, first_session date, last_session date, n_sessions int, n_sightings int, n_structures int, n_events int"
_KINDS = {"structure": STRUCTURES, "event": EVENTS, "ledger": LEDGER}


def _fields(schema: str) -> dict[str, str]:
    return dict(k.split() for k in schema.split(", "))


_ALL = {"kind": "string"} | {n: t for schema in _KINDS.values() for n, t in _fields(schema).items()}


def walk(s: folds.Series) -> tuple[list[tuple], list[tuple], int]:
    """Steps of the tracker (see tracker.Step), rows (key, attempt, position, from, to, reason, level, tolerance) of the machine, and how many identities began.

    Identities don't depend on attempts, so the tracker goes first and leaves the sessions on which each is monitored, with what it
    was then; each level is followed along these afterwards.
    """
    tracker, steps, begun, watched, n = Tracker(), [], 0, defaultdict(list), len(s.days)
    days = s.days.tolist()
    for t, found in folds.tracked(s, tracker):
        if found:
            steps += found
            begun += len({x.key for x in found if x.was is None})
        stale = days[t] - STALE_DAYS
        for life in tracker.lives.values():
            if life.state in MONITORED and life.seen >= stale:
                watched[life.key].append((t, life.sighting))
    volume = s.bars["volume"]
    mean = [0.0, *(float(volume[:t].mean()) for t in range(1, min(n, VOLUME_SESSIONS)))][:n]
    if n > VOLUME_SESSIONS:
        mean += np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(volume, VOLUME_SESSIONS)[:-1]).mean(axis=1).tolist()
    line = Line(s.days.astype("datetime64[D]"), *(s.bars[k].tolist() for k in ("open", "high", "low", "close", "volume")), mean, *([None] * n for _ in CONTEXT))
    events = []
    for key, own in watched.items():
        frozen, mask = dict(own), np.zeros(n, bool)
        mask[list(frozen)] = True
        mask, monitor, t = mask.tobytes(), None, own[0][0]
        while t >= 0 and not (monitor is not None and monitor.closed):
            x, span = frozen[t], float(s.atr[t])
            level = (x.level, zone_of(x.level, s.atr[t], x.confidence), span, x.confidence, x.touches, x.quality)
            if monitor is None:
                monitor = Monitor(*level)
            monitor.level, monitor.tolerance, monitor.atr, monitor.confidence, monitor.touches, monitor.quality = level
            changes, t = monitor.follow(line, t, mask, lost=True)
            was = None
            for at, number, state, reason in changes:
                events.append((key, number, at, was, state, reason, monitor.level, monitor.tolerance))
                was = state
            t = mask.find(1, t)
    return steps, events, begun


def walked(bars: DataFrame, timeframe: str = "1d") -> DataFrame:
    """Rows of kind structure, event and ledger from ``bars`` (with episode_id), one walk for each episode."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "date": pa.date32()}
    schema = pa.schema([(n, kinds[t]) for n, t in _ALL.items()])

    def table(kind: str, n: int, head: dict, columns: dict) -> pa.Table:
        def column(f: pa.Field) -> pa.Array:
            if f.name in columns:
                x = columns[f.name]
                return pa.array(x, pa.int32()).cast(f.type) if f.type == pa.date32() else pa.array(x, f.type)
            return pa.repeat(pa.scalar(head[f.name], f.type), n) if f.name in head else pa.nulls(n, f.type)

        head = head | {"kind": kind}
        return pa.table([column(f) for f in schema], schema)

    def run(key: tuple, x: pa.Table) -> pa.Table:
        day, first = np.unique(x.column("day").to_numpy(), return_index=True)
        x = x.take(pa.array(first))
        s = folds.Series.of_bars(key[0].as_py(), day, {k: np.asarray(x.column(k).to_numpy(), float) for k in ("open", "high", "low", "close", "volume")}, timeframe)
        steps, events, begun = walk(s)
        head = {"instrument_id": s.instrument, "timeframe": timeframe, "episode_id": key[1].as_py()}
        parts = [table("ledger", 1, head, {"first_session": day[:1], "last_session": day[-1:], "n_sessions": [len(day)], "n_sightings": [len(s.t)], "n_structures": [begun], "n_events": [sum(e[3] is None for e in events)]})]
        if steps:
            parts.append(table("structure", len(steps), head, dict(zip(("key", "family", "session_date", "from_state", "to_state", "reason", "quality"), zip(*steps, strict=True), strict=True))))
        if events:
            columns = dict(zip(("key", "attempt", "at", "from_state", "to_state", "reason", "level", "tolerance"), map(list, zip(*events, strict=True)), strict=True))
            at = columns.pop("at")
            parts.append(table("event", len(events), head, columns | {"session_date": day[at], "close": s.bars["close"][at]}))
        return pa.concat_tables(parts)

    read = bars.select("instrument_id", "episode_id", F.unix_date("session_date").alias("day"), "open", "high", "low", "close", "volume")
    return read.groupBy("instrument_id", "episode_id").applyInArrow(run, ", ".join(f"{n} {t}" for n, t in _ALL.items()))


def _read(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    empty = spark.createDataFrame([], f"{schema}, batch long, run string")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(empty.schema).parquet(f"{folder}/{name}") if there else empty


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The newest entry of each series and episode."""
    every = _read(spark, folder, "ledger", LEDGER)
    newest = every.groupBy("instrument_id", "timeframe").agg(F.max("batch").alias("batch"))
    return every.join(newest, ["instrument_id", "timeframe", "batch"], "left_semi")


def rows_of(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Rows of kind structure or event that the ledger names."""
    named = ledger(spark, folder).select("instrument_id", "timeframe", "run").distinct()
    return _read(spark, folder, f"rows/kind={kind}", _KINDS[kind]).join(named, ["instrument_id", "timeframe", "run"], "left_semi").select(*_fields(_KINDS[kind]))


def scan_snapshot(bars: DataFrame, calendar: DataFrame, folder: str, timeframe: str = "1d", chunks: int | None = None, force: bool = False, stop_after: int | None = None) -> None:
    """Walks all series of ``bars`` that the ledger in ``folder`` doesn't name yet, or all with ``force``.

    There is a chunk for every ``SERIES_A_CHUNK`` series, ``MOST_CHUNKS`` at most, so what a lost run repeats stays a small share.
    ``stop_after`` chunks the run breaks off between a chunk's rows and its entries, as a lost driver would.
    """
    spark = bars.sparkSession
    done = ledger(spark, folder)
    batch = (done.agg(F.max("batch")).first()[0] or 0) + 1
    named = done.where(F.col("timeframe") == timeframe).select("instrument_id").distinct()
    numbered = bars if "session_ord" in bars.columns else bars.join(calendar.select("session_date", "session_ord"), "session_date")
    waiting = episodes(numbered) if force else episodes(numbered).join(named, "instrument_id", "left_anti")
    n = waiting.select("instrument_id").distinct().count()
    if not n:
        return
    chunks = chunks or min(-(-n // SERIES_A_CHUNK), MOST_CHUNKS)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number: rows are few and work is much
    waiting = waiting.withColumn("chunk", F.pmod(F.xxhash64("instrument_id"), F.lit(chunks)))
    if chunks > 1:  # each chunk reads its own rows, the tables behind them are read once
        path = shared_path(spark, "waiting")
        waiting.write.partitionBy("chunk").parquet(path)
        waiting = spark.read.schema(waiting.schema).parquet(path)
    for chunk in range(chunks):
        own = waiting.where(F.col("chunk") == chunk).repartition(tasks, "instrument_id", "episode_id")
        run = uuid.uuid4().hex
        walked(own, timeframe).withColumns({"batch": F.lit(batch).cast("long"), "run": F.lit(run)}).write.partitionBy("kind").mode("append").parquet(f"{folder}/rows")
        if stop_after is not None and chunk + 1 >= stop_after:
            raise RuntimeError(f"stopped in chunk {chunk}")
        entries = _read(spark, folder, "rows/kind=ledger", LEDGER).where(F.col("run") == run)
        entries.write.mode("append").parquet(f"{folder}/ledger")
