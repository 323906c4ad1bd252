"""Queries whose work per row grew: each derives its tables once and shuffles them as often as it must."""

import re

import pytest
from pyspark.sql import functions as F

from vantage import registry
from vantage.operators import cross as C
from vantage.operators import ingest as I
from vantage.operators import tracking as K
from vantage.plans import q_ingest
from vantage.sources.fixtures import frame


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["x20_strength_results", "x04_percentile_rank", "x06_rs_score", "x07_beats_all"])
def test_bars_are_derived_once_for_strength(spark, sf, name):
    assert _plan(registry.queries()[name](spark, sf)).count("l_shipdate") == 0


def test_members_without_a_number_rank_behind_all(spark):
    rows = [(i, "d", v) for i, v in enumerate([3.0, 1.0, 1.0, None, float("nan"), 2.0, 5.0])]
    got = {r.instrument_id: (r.roster_size, r.percentile) for r in C.ranked_members(spark.createDataFrame(rows, "instrument_id int, session_date string, value double"), ("session_date",)).collect()}
    assert got == {0: (5, 0.8), 1: (5, 0.4), 2: (5, 0.4), 3: (5, None), 4: (5, None), 5: (5, 0.6), 6: (5, 1.0)}


def test_dirty_lines_are_made_in_one_pass(spark, sf):
    got, table = q_ingest._dirty(spark, sf), frame(spark, sf, "dirty_bars")
    assert _plan(got).count("l_shipdate") < _plan(table).count("l_shipdate")
    assert got.exceptAll(table).count() == 0 and table.exceptAll(got).count() == 0


@pytest.mark.parametrize("name", ["s05_coercion", "s07_cross_row_checks", "s09_import_counters", "q13_snapshot_audits"])
def test_an_import_writes_nothing_between_its_stages(spark, sf, name):
    assert "Scan ExistingRDD" not in registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_cells_are_read_as_before_and_odd_rows_lie_apart(spark):
    cells = [" 12.5", "12.5 ", "+3", "-0.25", "12\n", "(7)", "1,234.5", "12%", "1e3", "9" * 30, "", None]
    value, rule = I.coerced("decimal", F.col("x"))
    got = [(None if r.v is None else float(r.v), r.r) for r in spark.createDataFrame([(c,) for c in cells], "x string").select(value.alias("v"), rule.alias("r")).collect()]
    assert got == [(12.5, "trimmed"), (12.5, "trimmed"), (3.0, None), (-0.25, None), (12.0, "symbols"), (-7.0, "accounting_negative"), (1234.5, "thousands")] + [(None, None)] * 5
    rows = [("1", "2000-01-03", "1", "1", "1", "1", "0", 1), ("1", "2000-01-03", "1", "1", "1", "x", "0", 2), ("1", "2000-01-03", "1", "1", "1", "1", "0", 3), ("1", "2000-01-04", "99", "99", "99", "99", "1", 4)]
    out = I.import_bars(spark.createDataFrame(rows, "id string, date string, open string, high string, low string, close string, vol string, line int"), F.lit("2001-06-30").cast("date"))
    assert {r.line: (r.stage, r.reason) for r in out.collect()} == {1: ("dated", ""), 2: ("normalize", "unreadable:close"), 3: ("validate", "duplicate_key"), 4: ("validate", "spike")}


def test_pairs_of_spans_carry_plain_columns(spark):
    days = "instrument_id int, key string, family string, start_date date, end_date date"
    rows = [(1, "a", "f", "2000-01-01", "2000-06-30"), (1, "b", "g", "2000-01-01", "2000-06-30"), (1, "c", "f", "2000-03-01", "2000-03-31"), (2, "d", "f", "2000-01-01", "2000-06-30")]
    out = K.relationships(spark.createDataFrame(rows, days.replace("date date", "date string")).selectExpr("instrument_id", "key", "family", "date(start_date) start_date", "date(end_date) end_date"))
    assert sorted((r.from_key, r.to_key, r.kind) for r in out.collect()) == [("a", "b", "RELATED_TO"), ("a", "c", "CONTAINS"), ("b", "c", "CONTAINS")]
    assert "struct" not in _plan(out)


@pytest.mark.parametrize("name", ["b16_confirmation_path", "v01_determinism"])
def test_bars_are_derived_once_for_audits_and_confirmation(spark, sf, name):
    assert _plan(registry.queries()[name](spark, sf)).count("l_shipdate") == 0


def test_the_feature_set_gives_what_the_windows_give_without_sliding_frames(spark, sf):
    """Value by value, with gaps in each column; and no window that adds its rows up anew at every row."""
    import pandas as pd

    from vantage.operators import features as X

    odd = {"open": 7, "high": 11, "low": 13, "close": 17, "volume": 19}
    day = F.dayofyear("session_date")
    bars = frame(spark, sf, "bars").where("instrument_id <= 2")
    gaps = bars.select("instrument_id", "session_date", *(F.when(day % k != 3, F.col(c)).alias(c) for c, k in odd.items()))
    short = bars.orderBy("session_date", "instrument_id").limit(45)
    for b in (bars, gaps, short):
        b = b.localCheckpoint()
        table = lambda df: df.toPandas().sort_values(["instrument_id", "session_date"]).reset_index(drop=True)
        want, got = table(X.window_features(b)), table(X.feature_set(b))
        assert list(got.columns) == [*want.columns, *X.RECURSIVE] and len(want)
        pd.testing.assert_frame_equal(got[list(want.columns)], want, check_exact=True)
    frames = set(re.findall(r"specifiedwindowframe\(RowFrame, ([^)]*)\)", _plan(X.feature_set(bars))))
    assert frames <= {"-1, -1", "unboundedpreceding$("} and "collect_list" not in _plan(X.feature_set(bars)), frames


def test_bars_are_derived_once_for_the_feature_set_of_episodes(spark, sf):
    assert _plan(registry.queries()["r18_feature_set_by_episode"](spark, sf)).count("l_shipdate") == 0
