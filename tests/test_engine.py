"""Exact-number fixtures of the ranking, the grid and the scalar features."""

import datetime as dt

import pytest

from candlework.functions import ladders
from candlework.operators import exits, features, options, strategies
from candlework.sources import bars as src


def bars_of(spark, ticker, rows):
    day = dt.date(2026, 1, 1)
    return spark.createDataFrame([(ticker, day + dt.timedelta(i), *map(float, x), float(x[3]), 1000) for i, x in enumerate(rows)], src.ADJUSTABLE)


def flat(spark, ticker, closes):
    return bars_of(spark, ticker, [(c, c, c, c) for c in closes])


def test_ranking(spark):
    both = flat(spark, "GOOD3", (10, 9.7, 10.1, 9.7, 10.0)).unionByName(flat(spark, "BAD3", (10, 9.7, 9.6, 9.3, 9.1)))
    rows = strategies.rank(both, -2.0).collect()
    assert [r.ticker for r in rows] == ["GOOD3", "BAD3"]
    assert (rows[0].occurrences, rows[0].successful, rows[1].successful) == (2, 2, 0)
    down = strategies.rank(both.where("ticker = 'BAD3'"), -2.0, 0.0, "down").collect()
    assert len(down) == 1 and down[0].successful == 2


def test_grid_of_level_two(spark):
    bars = bars_of(spark, "INTRA3", [(100, 100, 100, 100), (98, 101, 94, 99), (101, 106, 100, 104), (102, 103, 97, 98), (99, 100, 98, 100)])
    rows = {r.strategy_code: r for r in strategies.summarize(bars, strategies.grid((2.0,))).collect()}
    assert len(rows) == 10
    touch = rows["intraday_queda_2_close_d1"]
    assert touch.trades == 2 and touch.profitable == 1 and touch.net_return_pct == pytest.approx(4.2389, abs=5e-4)
    assert rows["gap_baixa_2_close_d0"].avg_return_pct == pytest.approx(1.0204, abs=5e-4)
    assert rows["close_alta_2_reversao"].net_return_pct == pytest.approx(5.7692, abs=5e-4)
    good = [c for c, r in rows.items() if r.success_rate_pct >= 50 and (r.pf_is_inf or (r.profit_factor or 0) >= 1) and r.avg_return_pct >= 0.5 and r.net_return_pct > 0]
    assert sorted(good) == ["close_alta_2_reversao", "close_queda_2_reversao", "gap_baixa_2_close_d0", "intraday_alta_2_close_d1", "intraday_queda_2_close_d1"]


def test_definitions():
    assert len(strategies.grid()) == 50 and len(options.grid()) == 136 and len({s["strategy_code"] for s in options.grid()}) == 136
    assert len(features.FEATURES) == 50 and len(features.PAIRABLE) == 34 and len(features.OPTION_KEYS) == 20
    assert len(exits.percent_templates()) == 20 and len(exits.atr_templates()) == 24 and len(options.templates()) == 6


def test_scalars():
    assert features.ema([100.0] * 30, 9)[-1] == pytest.approx(100)
    fall, rise = features.rsi([200.0 - 2 * i for i in range(30)]), features.rsi([100.0 + 2 * i for i in range(30)])
    assert fall[25] < 30 and rise[25] > 70 and fall[13] is None
    assert ladders.codes("rsi") == ["oversold", "low", "neutral_low", "neutral_high", "high", "overbought"]


def test_scanned_averages_equal_the_recursions(spark):
    import random

    draw, rows, day = random.Random(2), [], dt.date(2010, 1, 1)
    series = {"LONG": 1500, "BLOCK": 64, "NEXT": 65, "SHORT": 14, "TINY": 3, "FLAT": 200, "UP": 300}
    for name, n in series.items():
        c = 50.0
        for i in range(n):
            c = 50.0 if name == "FLAT" else c + 1 if name == "UP" else max(1.0, c * (1 + draw.uniform(-0.04, 0.04)))
            rows.append((name, day + dt.timedelta(i), c))
    got = features.sequential(spark.createDataFrame(rows, "ticker string, trade_date date, close double")).orderBy("ticker", "trade_date").collect()
    for name in series:
        closes = [c for t, _, c in rows if t == name]
        mine = [r for r in got if r.ticker == name]
        for column, want in (("ema9", features.ema(closes, 9)), ("ema21", features.ema(closes, 21)), ("rsi14", features.rsi(closes))):
            assert [None if r[column] is None else round(r[column], 9) for r in mine] == [None if x is None else round(x, 9) for x in want], (name, column)


def test_option_target_stop_and_atm(spark):
    day = lambda m, d: dt.date(2026, m, d)
    spot = spark.createDataFrame([("AAAA3", day(3, 1), 100.0, 101.0, 99.0, 100.0, 1, 1), ("AAAA3", day(3, 2), 98.0, 101.0, 97.0, 99.0, 1, 1), ("AAAA3", day(3, 10), 98.0, 101.0, 97.0, 99.0, 1, 1), ("AAAA3", day(3, 20), 98.0, 101.0, 97.0, 99.0, 1, 1)], src.SPOT)
    chain = spark.createDataFrame([("AAAAC7", "AAAA3", "call", day(3, 2), day(3, 17), 98.0, 1.0, 1.03, 0.98, 1.0, 1, 1)], src.OPTION)
    rows = {r.strategy_code: r for r in options.trades(spot, chain).collect()}
    hit = rows["opt_gap_baixa_1_call_atm_7dte_sl5_tp1"]
    assert hit.exit_reason == "take_profit" and hit.trade_return_pct == pytest.approx(1.0)


def test_exit_of_a_conflict_goes_to_the_stop(spark):
    rows = [(100, 101, 99, 100)] * 75 + [(100, 103, 98, 100)]
    bars = bars_of(spark, "X3", rows).select("ticker", "trade_date", "open", "high", "low", "close", "volume").selectExpr("*", "1L AS trade_count")
    got = exits.samples(bars, exits.percent_templates(("open",), ("long",), ((2.0, 1.0),))).orderBy("trade_date").collect()
    assert got[-1].exit_reason == "stop_loss_conflict" and got[-1].trade_return_pct == pytest.approx(-1.0)
    assert got[0].exit_reason == "stop_loss" and got[0].trade_return_pct == pytest.approx(-1.0)


def test_three_states_of_all_default_pairs(spark, monkeypatch):
    from itertools import combinations

    from candlework.plans import assets

    items = [16 * p for p in assets.PLACES[:5]]
    rows = [("T", dt.date(2026, 1, 1) + dt.timedelta(i), "open", items, [(t, 1.0, 1) for t in range(len(assets.NAMES))]) for i in range(60)]
    schema = "ticker string, trade_date date, entry_rule string, items array<int>, outcomes array<struct<t:int, x:double, e:int>>"
    monkeypatch.setattr(assets, "mined_rows", lambda spark, d: spark.createDataFrame(rows, schema))
    got = {r.itemset for r in assets.QUERIES["itemset_3f_default"](spark, "").collect()}
    assert got == {a + 1 + (b + 1) * 1024 + (c + 1) * 1024**2 for a, b, c in combinations(items, 3)}


def test_rows_are_dealt_to_all_cores_and_sums_equal_a_plain_count(spark):
    import random
    from collections import defaultdict
    from itertools import combinations

    from candlework.operators import counting, mining

    draw, rows, day = random.Random(5), [], dt.date(2020, 1, 1)
    for ticker, n in (("HOT", 400), ("A", 40), ("B", 3)):
        for i in range(n):
            for rule in ("open", "close"):
                items = [16 * f + draw.randrange(3) for f in range(6) if draw.random() < 0.9]
                outcomes = [(t, round(draw.choice([2.0, -1.0, -100.0, draw.uniform(-3, 3)]), 9), draw.choice([0, 1, 2, 3])) for t in ((0, 2) if rule == "open" else (1,)) if draw.random() < 0.9]
                rows.append((ticker, day + dt.timedelta(i), rule, items, outcomes))
    df = spark.createDataFrame(rows, "ticker string, trade_date date, entry_rule string, items array<int>, outcomes array<struct<t:int, x:double, e:int>>")
    assert counting.dealt(df.selectExpr("*", "unix_date(trade_date) AS day"), len(rows)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    places, pairs = [0, 1, 2, 4, 5], [(0, 2), (1, 5)]
    for size in (1, 2, 3):
        want = defaultdict(lambda: [set(), []])
        for ticker, d, rule, items, outcomes in rows:
            fit = items if size == 1 else [x for x in items if x // 16 in places]
            for s in combinations(fit, size):
                if size == 3 and not any(p in pairs for p in combinations([x // 16 for x in s], 2)):
                    continue
                for t, x, e in outcomes:
                    key = (f"t{t}", sum((x + 1) << 10 * i for i, x in enumerate(s)))
                    want[key][0].add(ticker)
                    want[key][1].append((x, e, d))
        got = mining.aggregate(df, size, places, ["t0", "t1", "t2"], ["open", "close", "open"], pairs).collect()
        assert {(r.template, r.itemset) for r in got} == set(want) and len(got) == len(want)
        for r in got:
            tickers, trades = want[r.template, r.itemset]
            assert (r.tickers, r.trades, r.profitable, r.successful) == (len(tickers), len(trades), sum(x > 0 for x, _, _ in trades), sum(x >= 0 for x, _, _ in trades))
            assert (r.take_profits, r.stop_losses, r.time_caps, r.wiped) == (*(sum(e == k for _, e, _ in trades) for k in (1, 2, 3)), sum(x <= -100 for x, _, _ in trades))
            assert r.net == pytest.approx(sum(x for x, _, _ in trades), abs=1e-8) and r.gross_loss == pytest.approx(-sum(min(x, 0) for x, _, _ in trades), abs=1e-8)
            assert (r.first_date, r.last_date) == (min(d for _, _, d in trades), max(d for _, _, d in trades))


def test_entry_lists_queries_and_sql():
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 120
