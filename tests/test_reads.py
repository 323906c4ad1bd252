"""Planted answers for as-of reads, ingest and quality."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from vantage.operators import asof, ingest, quality

D = dt.date


def test_visibility_and_revisions(spark):
    t = lambda h: dt.datetime(2020, 1, 2, h)
    facts = spark.createDataFrame([(1, D(2020, 1, 2), 10.0, t(21), t(21), "ok"), (1, D(2020, 1, 2), 11.0, t(21), t(23), "ok"), (1, D(2020, 1, 1), 9.0, t(1), t(1), "suspect")], "instrument_id int, session_date date, close double, event_time timestamp, knowledge_time timestamp, quality string")
    at = lambda h: asof.history(facts, F.lit(t(h))).select("close").collect()
    assert [r.close for r in at(22)] == [10.0] and [r.close for r in at(23)] == [11.0] and at(20) == []
    assert asof.history(facts, F.lit(t(23)), include_suspect=True).count() == 2


def test_asof_join_is_backward_and_strict_on_demand(spark):
    left = spark.createDataFrame([(1, D(2020, 1, 5)), (1, D(2020, 1, 1)), (2, D(2020, 1, 5))], "instrument_id int, d date")
    right = spark.createDataFrame([(1, D(2020, 1, 5), 5.0), (1, D(2020, 1, 2), 2.0)], "instrument_id int, s date, v double")
    run = lambda strict: {(r.instrument_id, r.d.day): r.v for r in asof.asof_join(left, right, "d", "s", ["instrument_id"], ["v"], strict).collect()}
    assert run(False) == {(1, 5): 5.0, (1, 1): None, (2, 5): None}
    assert run(True) == {(1, 5): 2.0, (1, 1): None, (2, 5): None}


def test_split_on_its_own_ex_date_changes_nothing(spark):
    bars = spark.createDataFrame([(1, D(2020, 1, i), 100.0, 10.0) for i in (1, 2, 3)], "instrument_id int, session_date date, close double, volume double")
    splits = spark.createDataFrame([(1, D(2020, 1, 2), 2.0)], "instrument_id int, ex_date date, ratio double")
    out = {r.session_date.day: (r.close, r.volume) for r in asof.split_adjusted(bars, splits).collect()}
    assert out == {1: (50.0, 20.0), 2: (100.0, 10.0), 3: (100.0, 10.0)}


def test_coercion(spark):
    cells = [" $1,234.50", "(12.5)", "12,5", "7%", "", "1e5", None]
    df = spark.createDataFrame([(c,) for c in cells], "x string")

    def read(decimal_comma):
        value, rule = ingest.coerced("decimal", F.col("x"), decimal_comma)
        return [(None if r.v is None else float(r.v), r.r) for r in df.select(value.alias("v"), rule.alias("r")).collect()]

    none = (None, None)
    assert read(False) == [(1234.5, "thousands"), (-12.5, "accounting_negative"), none, none, none, none, none]
    assert read(True) == [none, none, (12.5, "decimal_comma"), none, none, none, none]


def test_appending_twice_adds_nothing(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    first = ingest.fresh(a, a.limit(0), ["k"])
    assert first.count() == 2 and ingest.fresh(a, first, ["k"]).count() == 0


def test_snapshot_ignores_order(spark):
    a = spark.createDataFrame([(i, i * 2) for i in range(50)], "a int, b int")
    one, two = (ingest.snapshot_id(x, ["a", "b"]).first().snapshot for x in (a, a.orderBy(F.desc("a")).repartition(3)))
    assert one == two != ingest.snapshot_id(a.where("a > 0"), ["a", "b"]).first().snapshot


def test_zero_volume_runs(spark):
    rows = [(1, D(2020, 1, i), 1, 0.0 if i in (2, 3, 4, 7) else 5.0) for i in range(1, 9)]
    bars = spark.createDataFrame(rows, "instrument_id int, session_date date, line int, volume double")
    assert [(r.session_date.day, r.n) for r in quality.runs(bars, F.col("volume") == 0, 3, F.col("volume") == 0).collect()] == [(2, 3)]


def test_closed_trades_against_a_ledger_of_lots(spark):
    """First in, first out, a unit at a time; short where the sale came first; what stays open doesn't come out."""
    import random
    from collections import deque

    from vantage.operators import screens

    rng = random.Random(4)
    fills = [(i, n, D(2020, 1, 1 + rng.randrange(28)), rng.choice(["buy", "sell"]), rng.randrange(0, 6), float(rng.randrange(50, 150))) for i in (1, 2) for n in range(60)] + [(3, 1, D(2020, 1, 1), "buy", 5, 10.0), (4, 1, D(2020, 1, 1), "sell", None, 10.0)]
    df = spark.createDataFrame(fills, "instrument_id int, fill_id long, session_date date, side string, quantity long, price double")
    want = {}
    for i in (1, 2, 3):
        units = {side: deque((on, n, price) for _, n, on, s, q, price in sorted((f for f in fills if f[0] == i and f[3] == side), key=lambda f: (f[2], f[1])) for _ in range(q or 0)) for side in ("buy", "sell")}
        while units["buy"] and units["sell"]:
            b, s = units["buy"].popleft(), units["sell"].popleft()
            key = (i, "long" if b[0] <= s[0] else "short", b[1], s[1])
            want[key] = want.get(key, 0) + 1
    got = screens.matched_lots(df).collect()
    assert {(r.instrument_id, r.side, r.buy_fill, r.sell_fill): r.quantity for r in got} == want and len(got) == len(want)
    price = {(f[0], f[1]): f[5] for f in fills}
    assert all(r.profit == pytest.approx(r.quantity * (price[r.instrument_id, r.sell_fill] - price[r.instrument_id, r.buy_fill])) and r.opened_on <= r.closed_on for r in got)


def test_pages_of_funds(spark):
    """A table beside prose, headings in any order and case, a value after a spacer, and pages without anything."""
    from vantage.operators import filings

    head = "<tr><td>Ticker</td><td>Fund Name</td><td>Principal U. S. Listing Exchange</td></tr>"
    rows = "<tr><td>ABC</td><td>First &amp; Co</td><td>NYSE</td></tr><tr><td></td></tr><tr><td>D.E-1</td><td>Second</td><td>CBOE</td><td>x</td></tr>"
    pages = [(1, None), (2, ""), (3, "<p>no table</p>"), (4, f"<div>Fund<table>{head}{rows}<tr><td>too</td><td>few</td></tr><tr><td>XYZ</td><td>Late</td><td>NYSE</td></tr></table></div>")]
    pages += [(5, f"<table>{head}<tr><td>not a ticker</td><td>a</td><td>b</td></tr></table>"), (6, "<p>Exact Name of Fund:</p><p>&nbsp;</p><p>The Fund (formerly  known as Older)</p><p>Principal Listing Exchange:</p><p>NYSE under the symbol &quot;TF&quot;</p>"), (7, "<p>Exact name of Trust: Inline Trust</p><p>Exact name of Trust:</p>")]
    df = spark.createDataFrame(pages, "cik long, html string")
    got = sorted((r.cik, r.row, r.fund, r.exchange, r.ticker, r.reason) for r in filings.listing_rows(df).collect())
    assert got == [(4, 1, "First & Co", "NYSE", "ABC", None), (4, 2, "Second", "CBOE", "D.E-1", None), (4, 3, None, None, None, "narrow"), (5, 1, None, None, None, "ticker")]
    who = {r.cik: (r.exact_name, r.former_names, r.listing_exchange, r.listing_symbol) for r in filings.trust_identity(df).collect()}
    assert who[6] == ("The Fund", ["Older"], "NYSE", "TF") and who[7][0] == "Inline Trust" and who[1] == who[3] == (None, [], None, None)


def test_surrogate_ids_of_symbols_with_a_common_beginning(spark, monkeypatch):
    monkeypatch.setattr(ingest, "GROUP_SYMBOLS", 7)
    names = [f"AA{n}" for n in range(40)] + ["A", "AA", "B", "C1", None, "AA3", "é"]
    got = {r.symbol: r.instrument_id for r in ingest.surrogate_ids(spark.createDataFrame([(n,) for n in names], "symbol string"), 5).collect()}
    assert got == {n: 5 + i for i, n in enumerate(sorted({n for n in names if n}))}
