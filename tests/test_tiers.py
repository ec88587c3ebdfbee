"""Tiered reports and the option report against plain recounts."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest

from candlework.operators import option_report, patterns, tiers
from candlework.plans import assets, tiers as plans

DAY = dt.date(2020, 1, 1)
SCHEMA = "template string, itemset long, ticker string, trade_date date, exit_date date, exit_reason string, trade_return_pct double"
NAMES = ("asset_long_open_tp1_5_sl1_cap5", "asset_long_close_atr_tp2_sl1_cap5")


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    out = []
    for template in NAMES:
        for itemset in (1, 17, 18 + 1024 * 40):
            for ticker in "ABC":
                for k in range(draw.choice((1, 6, 30))):
                    x = draw.choice((1.5, 1.5, 1.5, 0.0, -1.0))
                    out.append((template, itemset, ticker, DAY + dt.timedelta(k), DAY + dt.timedelta(k + 1), "take_profit" if x > 0 else "stop_loss" if x < 0 else "time_cap", x))
    return out


@pytest.fixture(scope="module")
def trades(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def returns_of(rows):
    groups = defaultdict(list)
    for t, i, k, _, _, _, x in rows:
        groups[t, i, k].append(x)
    return groups


def test_records_and_names(spark, trades, rows):
    got = {(r.template, r.itemset, r.ticker): r for r in tiers.records(trades).collect()}
    want = returns_of(rows)
    assert got.keys() == want.keys()
    for key, xs in want.items():
        assert got[key].success == pytest.approx(100 * sum(x >= 0 for x in xs) / len(xs), abs=1e-6) and got[key].first_date == DAY
    shown = spark.createDataFrame([(t, i) for t in NAMES for i in (1, 18 + 1024 * 40, 1 + 1024 * 20 + 1024 * 1024 * 33)], "template string, itemset long")
    cut = shown.select(tiers.percent("tp"), tiers.percent("sl"), tiers.states(), tiers.feature_set(["a", "b", "c"])).collect()
    assert {tuple(r) for r in cut} == {(t, s, n, f) for t, s in ((1.5, 1.0), (0.0, 0.0)) for n, f in ((1, "a"), (2, "b c"), (3, "a b c"))}


def test_roll_ups_and_scores(trades, rows):
    records = tiers.records(trades)
    got = tiers.roll_up(tiers.qualified(records, trades.where("itemset <> 17").distinct(), {"n": 6, "av": 0.1}), "success").collect()
    want = defaultdict(list)
    for (t, i, k), xs in returns_of(rows).items():
        gain, loss = sum(x for x in xs if x > 0), -sum(x for x in xs if x < 0)
        if i != 17 and len(xs) >= 6 and round(sum(xs) / len(xs), 6) >= 0.1:
            want[k].append((-round(gain / loss, 6) if loss else -9999.0, t, i, len(xs), sum(xs), sum(xs) / len(xs)))
    assert {r.ticker for r in got} == set(want)
    for r in got:
        best, mine = min(want[r.ticker])[:3], want[r.ticker]
        assert (r.patterns, r.trades, r.best_template, r.best_itemset) == (len(mine), sum(x[3] for x in mine), best[1], best[2])
        assert r.net == pytest.approx(sum(x[4] for x in mine)) and r.mean_av == pytest.approx(sum(x[5] for x in mine) / len(mine), abs=1e-4)
    assert [(-r.patterns, -r.net) for r in got] == sorted((-r.patterns, -r.net) for r in got)
    scored = tiers.action_scores(records).collect()
    assert [r.score for r in scored] == sorted((r.score for r in scored), reverse=True)
    for r in scored:
        assert r.score == pytest.approx(10 * r.patterns + 0.05 * r.trades + 1.5 * r.mean_win + 1.2 * r.mean_tp + 20 * r.mean_av + 2 * min(r.best_pf, 20) - 0.8 * r.mean_sl, abs=0.01)


def test_accurate_leaves_out_atr_and_wide_targets(trades):
    scored = patterns.report(trades, "2020-01-10")
    none = {"n": 0}
    assert {r.template for r in tiers.accurate(scored, none).collect()} == {NAMES[0]}
    assert {r.template for r in tiers.accurate(scored, none, atr=True).collect()} == set(NAMES)
    assert tiers.accurate(scored, none, most=1.0).isEmpty() and tiers.accurate(scored.limit(0), none).isEmpty()


def test_free_tiers_lead_with_the_best(trades):
    whole = patterns.measures(trades, patterns.KEY)
    got = tiers.free(whole, strict={"n": 1}, robust={"tickers": 3}, aggressive={"win": 60.0}, top=2).collect()
    order = sorted(whole.collect(), key=lambda r: (-r.av, -r.win, -r.pf, -r.n, r.template, r.itemset))
    assert [(r.template, r.itemset) for r in order[:2]] == sorted(((r.template, r.itemset) for r in got if r.leads), key=[(r.template, r.itemset) for r in order].index)
    assert Counter(r.tier for r in got) == Counter({"robust": len(order), "aggressive": sum(r.win >= 60 for r in order)})


def test_per_stock_and_block(trades):
    low = {"n": 2}
    got = tiers.per_stock(tiers.records(trades), low).collect()
    assert [(-r.patterns, -r.best_av, r.ticker, r.place) for r in got] == sorted((-r.patterns, -r.best_av, r.ticker, r.place) for r in got)
    assert Counter(r.ticker for r in got) == Counter({r.ticker: r.patterns for r in got})
    whole = tiers.whole(trades)
    assert tiers.block(whole, low, stops=100.0, top=4).count() == 4
    assert {(r.entry_rule, r.states) for r in tiers.block(whole, low, stops=100.0, entry="open", size=2).collect()} == {("open", 2)}
    assert tiers.block(whole, low, stops=100.0, targets=(1.0, 2.0)).select("template").distinct().count() == 1
    counts = tiers.block_counts(tiers.block(whole, low, stops=100.0), ["a", "b", "c"]).collect()
    assert {(r.what, r.value): r.patterns for r in counts} == {("entry_rule", "open"): 3, ("entry_rule", "close"): 3, ("target", "1.50"): 3, ("target", "0.00"): 3, ("features", "a"): 2, ("features", "b"): 2, ("features", "b c"): 2}


def test_option_report(spark):
    rows = [("s", "A", 5.0), ("s", "A", -1.0), ("s", "B", 4.0), ("s", "B", 0.0), ("t", "C", -2.0)]
    df = spark.createDataFrame(rows, "strategy_code string, ticker string, trade_return_pct double")
    schema = "strategy_code string, tickers long, trades long, success_rate_pct double, profitable_rate_pct double, avg_return_pct double, median_return_pct double, net_return_pct double, profit_factor double, pf_is_inf boolean"
    summary = spark.createDataFrame([("s", 2, 40, 75.0, 50.0, 2.0, 2.0, 8.0, 9.0, False), ("t", 1, 1, 0.0, 0.0, -2.0, -2.0, -2.0, 0.0, False)], schema)
    got = {r.strategy_code: r for r in option_report.strategies(summary, df).collect()}
    assert (got["s"].status, got["s"].gains, got["s"].losses, got["s"].flats, got["s"].first_ticker) == ("approved", 2, 1, 1, "A")  # equal nets and trades: by name
    assert got["t"].status == "rejected" and "trades<10" in got["t"].reasons and "net<=0" in got["t"].reasons
    bars = spark.createDataFrame([("A",), ("B",)], "ticker string")
    chain = spark.createDataFrame([("A", "X"), ("A", "Y")], "underlying_root string, option_symbol string")
    assert tuple(option_report.header(summary, df, bars, chain).first()) == (2, 1, 2, 2, 1, 1, 5, 2, 2, 1)


def test_plans_state_the_miners_one_pair():
    assert {(t["tp"], t["sl"]) for t in assets.TEMPLATES} == {(2.0, 1.0)}  # spelt out in the oracle
    assert set(plans.ORACLE_SQL) == set(plans.QUERIES)
