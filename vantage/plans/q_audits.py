"""Queries over audits of stored histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.functions.scalar import digest, digest_sql
from vantage.operators import audits as A
from vantage.operators import features as X
from vantage.operators import tracking as K
from vantage.registry import register
from vantage.sources.fixtures import frame, once, with_tables

D = digest_sql


def _history(s, d):
    return A.steps(frame(s, d, "observations"), "key").withColumn("known_through", F.date_add("session_date", F.col("known_after")))


def _events(s, d):
    return A.steps(frame(s, d, "event_history"), "event_key")


_H = "h as (select *, session_date + known_after as known_through, lag(to_state) over (partition by key order by session_date, seq) as from_state from observations)"
_E = "ev as (select *, lag(to_state) over (partition by event_key order by session_date, seq) as from_state from event_history)"
_T = "observations"


def _edges(table) -> str:
    pairs = [(a, b) for a, more in table.items() for b in more]
    return "legal as (select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in pairs) + ") v(a, b))"


register("k04_illegal_steps", lambda s, d: A.illegal_structure_steps(_history(s, d)).select("key", "seq", "from_state", "to_state"),
         with_tables(_T, "with " + _H + ", " + _edges(K.EDGES) + " select key, seq, from_state, to_state from h where from_state is not null and from_state <> to_state and (not exists (select 1 from legal where a = from_state and b = to_state) or (family = 'breakout_retest' and to_state = 'NEAR_BREAKOUT'))"))
register("b22_illegal_steps", lambda s, d: A.illegal_event_steps(_events(s, d)).select("event_key", "seq", "from_state", "to_state"),
         with_tables("event_history", "with " + _E + ", " + _edges(A.EVENT_EDGES) + " select event_key, seq, from_state, to_state from ev where from_state is not null and from_state <> to_state and not exists (select 1 from legal where a = from_state and b = to_state)"))
register("k08_net_steps", lambda s, d: A.net_steps(_history(s, d)), with_tables(_T, "with " + _H + " select key, session_date, arg_min(from_state, seq) as from_state, arg_max(to_state, seq) as to_state, count(*) as collapsed from (select * replace (coalesce(from_state, '~') as from_state) from h) group by 1, 2").replace("arg_min(from_state, seq) as from_state", "nullif(arg_min(from_state, seq), '~') as from_state"))
_ON = "1996-06-30"
register("k11_believed", lambda s, d: K.believed(_history(s, d).select("key", "instrument_id", "family", "session_date", "to_state"), F.lit(_ON).cast("date")).select("key", "instrument_id", "family", "since"),
         with_tables(_T, f"select key, instrument_id, family, max(session_date) as since from observations where session_date <= date '{_ON}' group by 1, 2, 3"))


def _asked(s, d):
    return frame(s, d, "event_history").select("event_key").distinct().withColumn("on", F.lit(_ON).cast("date"))


register("b21_state_on", lambda s, d: A.state_on(_events(s, d), _asked(s, d)), with_tables("event_history", f"select k.event_key, date '{_ON}' as \"on\", arg_max(to_state, (session_date, seq)) as state from (select distinct event_key from event_history) k left join event_history h on h.event_key = k.event_key and session_date <= date '{_ON}' group by 1"))
register("k13_screenable", lambda s, d: A.screenable(A.current(_history(s, d))).select("key", "to_state", "quality", "first_session", "observations"),
         with_tables(_T, "with c as (select key, arg_max(to_state, (session_date, seq)) as to_state, arg_max(quality, (session_date, seq)) as quality, min(session_date) as first_session, count(*) as observations from observations group by 1) select * from c where to_state in ('MATURE', 'NEAR_BREAKOUT', 'BROKEN_OUT_UNCONFIRMED') and quality >= 60"))
register("k13_state_tally", lambda s, d: A.current(_history(s, d)).groupBy("to_state").agg(F.count(F.lit(1)).alias("n")), with_tables(_T, "with c as (select key, arg_max(to_state, (session_date, seq)) as to_state from observations group by 1) select to_state, count(*) as n from c group by 1"))
register("k10_advanced", lambda s, d: A.advanced(_history(s, d).where("seq % 3 = 0"), _history(s, d)).select("key", "seq"), with_tables(_T, "select key, seq from observations where seq % 3 <> 0"))
register("b27_advanced", lambda s, d: A.advanced(_events(s, d).where("seq % 4 = 0"), _events(s, d), "event_key").select("event_key", "seq"), with_tables("event_history", "select event_key, seq from event_history where seq % 4 <> 0"))


def _edge_rows(s, d):
    k = F.col("seq")
    return frame(s, d, "observations").select(F.col("key").alias("from_key"), F.concat(F.lit("q"), k % 7).alias("to_key"), F.when(k % 2 == 0, "RELATED_TO").otherwise("OVERLAPS").alias("kind"), k.alias("seq"))


register("k12_new_edges", lambda s, d: A.new_edges(_edge_rows(s, d).where("seq % 5 = 0"), _edge_rows(s, d)),
         with_tables(_T, "with e as (select key as from_key, 'q' || seq % 7 as to_key, case when seq % 2 = 0 then 'RELATED_TO' else 'OVERLAPS' end as kind, seq from observations) select distinct from_key, to_key, kind from e except select from_key, to_key, kind from e where seq % 5 = 0"))


def _forks(s, d):
    return frame(s, d, "observations").withColumn("key", F.concat(F.substring_index("key", ":", 1), F.when(F.year("session_date") % 2 == 0, F.concat(F.lit(":"), F.year("session_date"), F.lit("-01-01"))).otherwise("")))


register("k06_superseded", lambda s, d: A.superseded_edges(_forks(s, d)),
         with_tables(_T, """with f as (select split_part(key, ':', 1) as base, split_part(key, ':', 1) || case when extract(year from session_date) % 2 = 0 then ':' || extract(year from session_date) || '-01-01' else '' end as key, session_date from observations),
p as (select base, key, min(session_date) as first from f group by 1, 2), n as (select key as from_key, lead(key) over (partition by base order by first, key) as to_key from p) select from_key, to_key, 'SUPERSEDED_BY' as kind from n where to_key is not null"""))


def _scope(s, d):
    return frame(s, d, "observations").groupBy("instrument_id").agg(F.min("session_date").alias("first_date"), F.max("session_date").alias("last_date"))


_SC = "sc as (select instrument_id, min(session_date) as first_date, max(session_date) as last_date from observations group by 1)"
register("v04_detection_rate", lambda s, d: A.detection_rate(_history(s, d), _scope(s, d)).select("family", "identities", digest(F.col("per_year"), 5).alias("per_year")),
         with_tables(_T, "with " + _SC + f", y as (select sum(last_date - first_date) / 365.25::double as years from sc) select family, count(distinct key) as identities, {D('count(distinct key) / max(years)', 5)} as per_year from observations cross join y group by 1"))
register("v05_early_detections", lambda s, d: A.early_detections(_history(s, d)), with_tables(_T, "with " + _H + ", f as (select key, arg_min(session_date, (session_date, seq)) as session_date, arg_min(known_through, (session_date, seq)) as known_through from h group by 1) select * from f where session_date < known_through"))
_SD = ("low", "mean", "high", "least_coverage", "mean_coverage")
register("v09_scores", lambda s, d: A.score_distribution(_history(s, d)).select("family", "n", "constant", *(digest(F.col(c)).alias(c) for c in _SD)),
         with_tables(_T, f"with q as (select family, count(*) as n, min(quality) as low, avg(quality) as mean, max(quality) as high, min(coverage) as least_coverage, avg(coverage) as mean_coverage from observations group by 1) select family, n, n >= 20 and high - low < 1e-9 as constant, {', '.join(f'{D(c)} as {c}' for c in _SD)} from q"))
register("v10_stability", lambda s, d: A.identity_stability(_history(s, d)).select("identities", "observations", "flagged", *(digest(F.col(c), 5).alias(c) for c in ("mean", "single_share", "forked_share"))),
         with_tables(_T, f"with p as (select key, count(*) as n from observations group by 1) select count(*) as identities, sum(n)::bigint as observations, avg(n) < 2 as flagged, {D('avg(n)', 5)} as mean, {D('avg((n = 1)::int)', 5)} as single_share, {D(chr(40) + 'avg(regexp_matches(key, ' + chr(39) + ':[0-9]{4}-[0-9]{2}-[0-9]{2}$' + chr(39) + ')::int)' + chr(41), 5)} as forked_share from p"))


def _scanned(s, d):
    return s.range(1, 121).select(F.col("id").cast("int").alias("instrument_id")).join(frame(s, d, "observations").agg(F.max("instrument_id").alias("top")), F.col("instrument_id") <= F.col("top") + 5).select("instrument_id")


register("v11_findings", lambda s, d: A.concentration(_history(s, d), _scanned(s, d), instrument_share=0.012, session_share=0.002),
         with_tables(_T, """with f as (select key, min(session_date) as session_date, min(instrument_id) as instrument_id from observations group by 1), t as (select count(*) as total from f)
select 'instrument' as kind, instrument_id::varchar as what, count(*) as n from f group by 2 having count(*) > 12e-3 * (select total from t) union all select 'session', session_date::varchar, count(*) from f group by 2 having count(*) > 2e-3 * (select total from t)
union all select 'silent', i::varchar, 0 from (select unnest(range(1, 121)) as i) where i <= (select max(instrument_id) + 5 from observations) and i not in (select instrument_id from f)"""))
_CH = ("obs_median", "obs_p90", "obs_p99", "life_median")
register("v12_churn", lambda s, d: A.identity_churn(_history(s, d)).select("family", "identities", "forked", "crowded", digest(F.col("single_share"), 5).alias("single_share"), *(F.col(c).cast("long").alias(c) for c in _CH)),
         with_tables(_T, f"""with p as (select family, key, count(*) as obs, max(session_date) - min(session_date) as life from observations group by 1, 2), b as (select family, count(*) filter (n > 1) as crowded from (select family, split_part(key, ':', 1) as base, count(*) as n from p group by 1, 2) group by 1),
q as (select family, count(*) as identities, count(*) filter (contains(key, ':')) as forked, avg((obs <= 1)::int) as single_share, list_sort(list(obs)) as o, list_sort(list(life)) as l from p group by 1)
select family, identities, forked, crowded, {D('single_share', 5)} as single_share, o[floor(5e-1 * (identities - 1))::int + 1]::bigint as obs_median, o[floor(9e-1 * (identities - 1))::int + 1]::bigint as obs_p90, o[floor(99e-2 * (identities - 1))::int + 1]::bigint as obs_p99, l[floor(5e-1 * (identities - 1))::int + 1]::bigint as life_median from q join b using (family)"""))


def _opened(s, d):
    return frame(s, d, "event_history").groupBy("event_key").agg(F.min("session_date").alias("f")).select("event_key", F.when(F.length("event_key") % 2 == 0, F.date_add("f", 200)).otherwise(F.col("f")).alias("opened_session"))


register("v13_causality", lambda s, d: A.event_causality(_events(s, d), _opened(s, d)),
         with_tables("event_history", """with o as (select event_key, min(session_date) + case when length(event_key) % 2 = 0 then 200 else 0 end as opened from event_history group by 1)
select distinct h.event_key, session_date, 'before_opening' as problem from event_history h join o using (event_key) where session_date < opened union all select event_key, session_date, 'several_in_a_session' from event_history group by 1, 2 having count(*) > 1"""))
register("v13_transitions", lambda s, d: A.transition_counts(_events(s, d)), with_tables("event_history", "with " + _E + " select coalesce(from_state, 'new') as from_state, to_state, count(*) as n from ev group by 1, 2"))
register("v06_state_distribution", lambda s, d: A.current(_events(s, d), "event_key").groupBy("to_state").agg(F.count(F.lit(1)).alias("events"), F.sum("observations").alias("observations")),
         with_tables("event_history", "with c as (select event_key, arg_max(to_state, (session_date, seq)) as to_state, count(*) as observations from event_history group by 1) select to_state, count(*) as events, sum(observations)::bigint as observations from c group by 1"))


def _ledger(s, d):
    i = F.col("instrument_id")
    return _scope(s, d).where(i % 10 != 0).select("instrument_id", F.when(i % 7 == 0, "error").otherwise("done").alias("outcome"), "first_date", "last_date")


register("v14_scope", lambda s, d: A.scan_scope(_scope(s, d).select("instrument_id"), _ledger(s, d)).select("status", "n", digest(F.col("years"), 5).alias("years")),
         with_tables(_T, "with " + _SC + f", l as (select *, case when instrument_id % 10 = 0 then 'unscanned' when instrument_id % 7 = 0 then 'failed' else 'completed' end as status from sc) select status, count(*) as n, {D(chr(40) + 'sum(last_date - first_date) filter (status = ' + chr(39) + 'completed' + chr(39) + ') / 365.25::double' + chr(41), 5)} as years from l group by 1"))
register("v19_exposure", lambda s, d: _scope(s, d).agg(F.count(F.lit(1)).alias("instruments"), digest(F.sum(F.datediff("last_date", "first_date")) / 365.25, 5).alias("years")), with_tables(_T, "with " + _SC + f" select count(*) as instruments, {D('sum(last_date - first_date) / 365.25::double', 5)} as years from sc"))
register("v16_monotone", lambda s, d: A.monotone(X.window_features(frame(s, d, "bars")).where("sma_200 is not null").select("instrument_id", "session_date", "high_252", "obv"), "instrument_id", "session_date", "high_252"),
         with_tables("bars", """with n as (select instrument_id, session_date, row_number() over w as i, max(high) over (partition by instrument_id order by session_date rows 251 preceding) as h from bars window w as (partition by instrument_id order by session_date)),
m as (select instrument_id, session_date, case when i >= 252 then h end as h from n where i >= 200), d as (select instrument_id, h - lag(h) over (partition by instrument_id order by session_date) as d from m)
select instrument_id, coalesce(bool_and(d <= 0), true) as non_increasing, coalesce(bool_and(d >= 0), true) as non_decreasing from d group by 1"""))


def _v18(s, d):
    return A.tally({"illegal_structure_steps": ("structures", A.illegal_structure_steps(_history(s, d))), "early_detections": ("structures", A.early_detections(_history(s, d))), "illegal_event_steps": ("events", A.illegal_event_steps(_events(s, d))), "event_causality": ("events", A.event_causality(_events(s, d), frame(s, d, "event_history").groupBy("event_key").agg(F.min("session_date").alias("opened_session"))))}).select("check", "phase", "status")


register("v18_all_checks", _v18, with_tables(_T, "select * from (values ('illegal_structure_steps', 'structures', 'fail'), ('early_detections', 'structures', 'fail'), ('illegal_event_steps', 'events', 'fail'), ('event_causality', 'events', 'fail')) v(\"check\", phase, status) where exists (select 1 from observations)"))


def _v01(s, d):
    names = ["sma_50", "roc_20", "bollinger_bandwidth", "volatility_percentile"]
    fault = F.when(F.col("instrument_id") % 5 == 0, F.col("close") + 1).otherwise(F.col("close"))  # a feature that comes out otherwise the second time
    keys, g = ["instrument_id", "session_date"], once(s, d, "bars")
    bars = frame(s, d, "bars", g)
    a, b = (X.window_features(x).withColumn("planted", p).select(*keys, *names, "planted") for x, p in ((bars, F.col("close")), (bars.repartition(7, "session_date"), fault)))
    j = a.join(b.withColumnsRenamed({n: f"{n}_again" for n in (*names, "planted")}), keys, "full_outer")  # a row a bar, not one a feature
    unlike = lambda x, y: ~F.col(x).eqNullSafe(F.col(y)) & ~(F.abs(F.col(x) - F.col(y)) <= 1e-12 * F.abs(x))
    counted = j.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(unlike(n, f"{n}_again")).alias(n) for n in (*names, "planted")))
    return counted.where("n > 0").unpivot(["n"], [*names, "planted"], "feature", "differ").select("feature", "n", "differ")


register("v01_determinism", _v01, with_tables("bars", "select f as feature, count(*) as n, count(*) filter (f = 'planted' and instrument_id % 5 = 0) as differ from bars cross join (values ('sma_50'), ('roc_20'), ('bollinger_bandwidth'), ('volatility_percentile'), ('planted')) v(f) group by 1"))
_WARM = {"sma_20": 20, "sma_200": 200, "roc_60": 61, "high_252": 252, "volatility_20": 21, "relative_volume_20": 21}


def _v03(s, d):
    f = X.window_features(frame(s, d, "bars")).withColumn("i", F.row_number().over(X.series()))
    return X.long_form(f.drop("i"), list(_WARM)).join(f.select("instrument_id", "session_date", "i"), ["instrument_id", "session_date"]).where("value is not null").groupBy("feature", "instrument_id").agg(F.min("i").alias("first")).groupBy("feature").agg(F.min("first").cast("long").alias("earliest"), F.max("first").cast("long").alias("latest"))


register("v03_warm_up", _v03, with_tables("bars", "with n as (select count(*) as n from bars group by instrument_id) select f as feature, w::bigint as earliest, w::bigint as latest from (values " + ", ".join(f"('{k}', {v})" for k, v in _WARM.items()) + ") v(f, w) where exists (select 1 from n where n.n >= w)"))
_SCALE = {"roc_20": "invariant", "distance_sma_50": "invariant", "range_contraction": "invariant", "sma_50": "proportional", "high_252": "proportional", "dollar_volume_20": "proportional", "relative_volume_20": "invariant", "obv_slope": "invariant"}


def _v07(s, d, k=8.0):
    b = frame(s, d, "bars")
    big = b.select("instrument_id", "session_date", *((F.col(c) * k).alias(c) for c in ("open", "high", "low", "close")), "volume")
    j = X.long_form(X.window_features(b), list(_SCALE)).join(X.long_form(X.window_features(big), list(_SCALE)).withColumnRenamed("value", "scaled"), ["instrument_id", "session_date", "feature"]).where("value is not null")
    close = lambda x: F.abs(F.col("scaled") - x) <= 1e-9 * F.abs(x) + 1e-12
    per = j.groupBy("feature").agg(F.bool_and(close(F.col("value"))).alias("same"), F.bool_and(close(F.col("value") * k)).alias("times"))
    return per.select("feature", F.when(F.col("same"), "invariant").when(F.col("times"), "proportional").otherwise("sensitive").alias("found"))


_SCQ = " union all ".join(f"select '{k}' as feature, '{v}' as found" for k, v in _SCALE.items())
register("v07_scale", _v07, with_tables("bars", f"with n as (select max(n) as n from (select count(*) as n from bars group by instrument_id)) select q.* from ({_SCQ}) q cross join n where n.n >= 252"))
register("v08_scale_eligible", lambda s, d: _v07(s, d).select("feature", (F.col("found") != "sensitive").alias("eligible")), with_tables("bars", f"with n as (select max(n) as n from (select count(*) as n from bars group by instrument_id)) select q.feature, true as eligible from ({_SCQ}) q cross join n where n.n >= 252"))


def _v15(s, d):
    b = frame(s, d, "bars")
    wobble = (F.pmod(F.xxhash64("instrument_id", "session_date", F.lit(7)), F.lit(2001)) - 1000) / 1e6  # up to a tenth of a percent
    noisy = b.withColumns({c: F.col(c) * (1 + wobble) for c in ("open", "high", "low", "close")})
    # a feature that hangs on the last digit of the price can't be stable
    read = lambda x: X.long_form(X.window_features(x).withColumn("planted", F.pmod(F.floor(F.col("close") * 1e4), F.lit(97)).cast("double")), ["sma_50", "roc_60", "planted"])
    j = read(b).join(read(noisy).withColumnRenamed("value", "noisy"), ["instrument_id", "session_date", "feature"]).where("value is not null")
    return j.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.abs(F.col("noisy") - F.col("value")) <= 0.0021 * (1 + F.abs("value"))).alias("stable"))


register("v15_perturbed", _v15, with_tables("bars", "with i as (select row_number() over (partition by instrument_id order by session_date) as i from bars) select 'sma_50' as feature, count(*) as n, true as stable from i where i >= 50 having count(*) > 0 union all select 'roc_60', count(*), true from i where i > 60 having count(*) > 0 union all select 'planted', count(*), false from i having count(*) > 0"))
