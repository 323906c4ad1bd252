"""Queries over the snapshot scan of series that have gaps."""

from __future__ import annotations

from vantage.operators import scan as S
from vantage.registry import register
from vantage.sources.fixtures import frame, once, with_tables
from vantage.sources.staging import shared_folder

_FINISHED: set[str] = set()


def _scanned(s, d):
    """The folder of the session's scan over the tables in ``d``; the ledger there lets a stopped scan go on."""
    folder = f"{shared_folder(s)}/scan-{s.sparkContext.applicationId}-{d.strip('/').replace('/', '_').replace(':', '')}"
    if folder not in _FINISHED:
        g = once(s, d, "bars", "calendar")
        S.scan_snapshot(frame(s, d, "gappy_bars", g), frame(s, d, "calendar", g), folder)
        _FINISHED.add(folder)
    return folder


register("b24_ledger", lambda s, d: S.ledger(s, _scanned(s, d)).select("instrument_id", "timeframe", "episode_id", "first_session", "last_session", "n_sessions"),
         with_tables("gappy_bars", """with g as (select *, case when session_ord - lag(session_ord) over (partition by instrument_id order by session_ord) - 1 >= 21 then 1 else 0 end as brk from gappy_bars),
e as (select *, sum(brk) over (partition by instrument_id order by session_ord)::bigint as episode_id from g)
select instrument_id, '1d' as timeframe, episode_id, min(session_date) as first_session, max(session_date) as last_session, count(*)::int as n_sessions from e group by 1, 2, 3"""))
register("b24_structures", lambda s, d: S.rows_of(s, _scanned(s, d), "structure"))
register("b24_events", lambda s, d: S.rows_of(s, _scanned(s, d), "event"))
