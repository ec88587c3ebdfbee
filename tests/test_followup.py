"""Refinement by rounds, overlaps by rare tokens, reasons, the trades store and the monitor's payload."""

import datetime as dt
import json
import random

import pytest

from candlework.operators import monitor, patterns, refinement
from candlework.sinks.trades import read_trades, write_trades

DAY = dt.date(2020, 1, 1)


def plain_verdicts(candidates, pairs):
    order = sorted(candidates, key=lambda c: (*(float("inf") if x is None else -x for x in c[2:6]), c[1]))
    kept, out = [], {}
    for c in order:
        near = [k for k in kept if k[0] == c[0] and frozenset((k[1], c[1])) in pairs.get(c[0], set())]
        out[c[0], c[1]] = near[0][1] if near else None
        if not near:
            kept.append(c)
    return out


def test_verdicts_equal_a_walk_in_order(spark):
    draw = random.Random(3)
    candidates = [(t, i, draw.choice([1.0, 2.0, 3.5]), draw.choice([0.5, 1.5]), draw.choice([None, 0.1, 0.2]), 0.0, "kept") for t in ("a", "b") for i in range(60)]
    pairs = {t: {frozenset(draw.sample(range(60), 2)) for _ in range(150)} for t in ("a", "b")}
    chain = [("c", i, 100.0 - i, 0.0, 0.0, 0.0, "kept") for i in range(9)]
    pairs["c"] = {frozenset((i, i + 1)) for i in range(8)}
    rows = [(t, *sorted(p), 0.9) for t, ps in pairs.items() for p in ps] + [("a", 0, 1, 0.1)]
    schema = "template string, itemset long, robustness double, val_net double, avg_uplift double, pf_uplift double, more string"
    df = spark.createDataFrame(candidates + chain, schema)
    overlap = spark.createDataFrame(rows, "template string, first_set long, second_set long, share double")
    got = refinement.verdicts(df, overlap, 0.85)
    assert got.columns == [*df.columns, "duplicate_of"]
    assert {(r.template, r.itemset): r.duplicate_of for r in got.collect()} == plain_verdicts(candidates + chain, pairs)
    alone = refinement.verdicts(df, overlap.limit(0), 0.85).collect()
    assert len(alone) == len(candidates) + 9 and all(r.duplicate_of is None for r in alone)


def test_near_overlaps_equal_all_pairs_and_meet_fewer(spark):
    draw, sets = random.Random(6), {}
    for t in ("a", "b"):
        for i in range(40):
            base = sets.get((t, i - 1), set()) if i % 3 else set()
            sets[t, i] = {x for x in base if draw.random() < 0.9} | {"common"} | {f"k{draw.randrange(400)}" for _ in range(draw.choice([1, 5, 20]))}
    keys = spark.createDataFrame([(t, i, x) for (t, i), xs in sets.items() for x in xs], "template string, itemset long, token string")
    for share in (0.5, 0.85, 1.0):
        want = {(t, i, j, len(a & b), round(len(a & b) / min(len(a), len(b)), 6)) for (t, i), a in sets.items() for (u, j), b in sets.items() if t == u and i < j and len(a & b) >= share * min(len(a), len(b))}
        assert {tuple(r) for r in refinement.near_overlaps(keys, share).collect()} == want
    sized, probes = refinement.prefixes(keys, 0.85)
    assert probes.count() < sized.count() / 2 and probes.where("token = 'common' and size > 6").isEmpty()


def test_reasons_name_what_is_absent(spark):
    gate = refinement.GATE | {"avg_uplift": 0.5, "pf_uplift": 0.1, "trades": 4, "tickers": 2, "train": 2, "val": 2, "months": 2, "val_months": 1}
    summary = spark.createDataFrame([("t", 1, 2, 10, 5, 2.0, 3.0), ("t", 2, 1, 3, 1, 0.1, None), ("u", 3, 2, 10, 5, 2.0, 3.0), ("t", 4, 2, 10, 5, 2.0, 3.0), ("t", 5, 2, 10, 5, 2.0, 3.0)], "template string, itemset long, states int, n long, tickers long, av double, pf double")
    baseline = spark.createDataFrame([("t", 0.5, 1.0)], "template string, av double, pf double")
    good = [("t", 1, dt.date(2020, m, 3), x) for m, x in ((1, 2.0), (2, 2.0), (2, -1.0), (7, 3.0), (8, 2.0), (8, -1.0))]
    weak = [("t", 5, dt.date(2020, 1, 3), 1.0), ("t", 5, dt.date(2020, 8, 3), -1.0)]
    trades = spark.createDataFrame(good + weak, "template string, itemset long, trade_date date, trade_return_pct double")
    got = {r.itemset: (r.stage, r.reasons, r.robustness) for r in refinement.reasoned(summary, baseline, trades, "2020-06-01", gate).collect()}
    assert got[1][:2] == ("refined", "") and got[1][2] == pytest.approx(5 * 1.5 + 20 * 2 + 3 * 4 / 3 + 10 + 2)
    assert got[2] == ("prefilter", "state_size<2;avg_uplift<0.50;pf_uplift<0.10;trades<4;tickers<2", None)
    assert got[3] == ("prefilter", "missing_baseline", None) and got[4] == ("trades", "missing_trades", None)
    assert got[5][:2] == ("trades", "train_trades<2;validation_trades<2;validation_pf<1.10;validation_avg<0.00;validation_net<=0;positive_month_ratio<0.55;validation_positive_month_ratio<0.50")


def trades_of(spark):
    draw = random.Random(1)
    rows = [(f"asset_long_{e}_tp2_sl1_cap5", i, t, DAY + dt.timedelta(d), DAY + dt.timedelta(d + 2), draw.choice(["take_profit", "stop_loss", "time_cap"]), draw.choice([2.0, -1.0, 0.5])) for e in ("open", "close") for i in (33, 49, 50) for t in ("A", "B", "C") for d in range(0, 40, 3)]
    return spark.createDataFrame(rows, "template string, itemset long, ticker string, trade_date date, exit_date date, exit_reason string, trade_return_pct double")


def test_store_opens_only_wanted_buckets(spark, tmp_path):
    trades, path = trades_of(spark), str(tmp_path / "store")
    seen = write_trades(trades, path)
    assert seen["n"] == trades.count() and float(seen["net"]) == pytest.approx(trades.agg({"trade_return_pct": "sum"}).first()[0]) and seen["first_date"] == DAY
    wanted = trades.where("itemset = 49 and template like '%open%'").select("template", "itemset").distinct()
    got = read_trades(spark, path, wanted)
    assert sorted(map(tuple, got.select(*trades.columns).collect())) == sorted(map(tuple, trades.join(wanted, ["template", "itemset"], "left_semi").select(*trades.columns).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert read_trades(spark, path, wanted.limit(0)).isEmpty()


def signals_of(spark):
    own = patterns.by_ticker(trades_of(spark))
    whole = patterns.measures(trades_of(spark), patterns.KEY)
    states = spark.createDataFrame([(t, DAY + dt.timedelta(60), e, items) for t, items in (("A", [32, 48, 49]), ("B", [48]), ("Z", [32, 49])) for e in ("open", "close")], "ticker string, trade_date date, entry_rule string, items array<int>")
    return whole, own, patterns.signals(states, whole, own, [2, 3])


def test_monitor_lists_and_payload(spark):
    whole, own, fired = signals_of(spark)
    bars = spark.createDataFrame([(t, DAY + dt.timedelta(60 - i), 1.0, 2.0, 0.5, 1.5, 100) for t in ("A", "B", "Z") for i in range(70)] + [("NEW", DAY, 1.0, 1.0, 1.0, 1.0, 1)], "ticker string, trade_date date, open double, high double, low double, close double, volume long")
    n = {r.ticker: (r.signals, r.operational) for r in monitor.triggered(fired).collect()}
    assert n == {"A": (6, True), "Z": (4, True), "B": (2, False)}
    assert [r.ticker for r in monitor.best(fired).collect()] == ["A", "Z"] and {r.ticker for r in monitor.cards(fired).collect()} == {"A", "Z"}
    assert [r.confirming for r in monitor.cards(fired, "z", "open").collect()] == [2] and monitor.cards(fired, "nothing").isEmpty()
    counts = monitor.counters(whole, fired).collect()
    assert len(counts) == 6 and sum(r.triggered for r in counts) == 12 and sum(r.qualified for r in counts) == 8 and sum(r.operational for r in counts) == 10
    order = [(not r.qualified, -r.av) for r in monitor.ordered(fired).collect()]
    assert order == sorted(order)
    body = [(r.section, r.place, json.loads(r.body)) for r in monitor.payload(whole, fired, bars, own, patterns.actions(own), "2020-03-01").collect()]
    sections = {s: [b for x, _, b in body if x == s] for s, _, _ in body}
    head = sections["header"][0]
    assert (head["universe_size"], head["signals"], head["qualified"], head["operational_tickers"], head["operational"], head["triggered_tickers"]) == (3, 12, 8, 2, 10, 3)
    assert len(sections["signals"]) == 12 and len(sections["strategies"]) == 6 and [b["ticker"] for b in sections["top_triggered_tickers"]] == ["A", "Z", "B"]
    stranger = next(b for b in sections["signals"] if b["ticker"] == "Z")
    assert stranger["ticker_metrics"] is None and stranger["overall"] is None and stranger["price_snapshot"]["close"] == 1.5 and stranger["strategy_metrics"]["n"] == 42


def test_payload_without_signals(spark):
    whole, own, fired = signals_of(spark)
    bars = spark.createDataFrame([], "ticker string, trade_date date, open double, high double, low double, close double, volume long")
    rows = monitor.payload(whole, fired.limit(0), bars, own, patterns.actions(own)).collect()
    assert {r.section for r in rows} == {"header", "strategies"} and json.loads(rows[0].body)["signals"] == 0


def test_validation_window_and_recurrence(spark):
    trades = trades_of(spark)
    rows = patterns.validated(trades, "2020-01-01", "2020-01-10").collect()
    assert len(rows) == 6 and all(r.validation_n == 12 and r.n == 42 for r in rows)
    none = patterns.validated(trades, "2021-01-01", "2021-01-10").collect()
    assert all((r.validation_n, r.validation_av, r.validation_pf) == (0, 0.0, 0.0) for r in none)
    own = patterns.by_ticker(trades)
    assert sum(r.patterns for r in patterns.recurrence(own, 5, 2).collect()) == 12 and sum(r.firsts for r in patterns.recurrence(own, 5, 2).collect()) == 6
    totals = patterns.ticker_totals(own).collect()
    assert [r.patterns for r in totals] == [6, 6, 6] and [r.net for r in totals] == sorted((r.net for r in totals), reverse=True)
