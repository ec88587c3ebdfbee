"""Readers, parsers, keyed loads and pattern reports on small tables."""

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from candlework.operators import exit_grid, patterns
from candlework.sinks import keyed, text
from candlework.sources import files, reports

CODE = "asset_long_open_tp2_sl1_cap5__2f__gap_pct=down_1_2__rsi_14=low"


def test_numbers(spark):
    rows = spark.createDataFrame([(x,) for x in ("", None, "None", "INF", "nan", "1.5", " 2 ", "x")], "t string")
    got = [r[0] for r in rows.select(reports.number(F.col("t"))).collect()]
    assert got == [0.0, 0.0, 0.0, 9999.0, 9999.0, 1.5, 2.0, None]
    assert rows.where("t = 'INF'").select(reports.number(F.col("t"), float("inf"))).first()[0] == float("inf")


def test_codes(spark):
    code = F.col("c")
    df = spark.createDataFrame([(CODE,), ("plain",)], "c string")
    got = df.select(reports.template(code), reports.signature(code), reports.keys(code), reports.retarget(code, 1.5, 1.0), F.size(reports.conditions(code))).collect()
    assert tuple(got[0]) == ("asset_long_open_tp2_sl1_cap5", "gap_pct=down_1_2; rsi_14=low", "gap_pct,rsi_14", CODE.replace("tp2_sl1", "tp1_5_sl1"), 2)
    assert tuple(got[1]) == ("", "", "", "plain", 0)
    assert reports.pair("2:1") == (2.0, 1.0)
    for bad in ("2", "0:1", "2:-1", "a:b"):
        with pytest.raises(ValueError):
            reports.pair(bad)
    names = spark.createDataFrame([(" petr4 ",), ("VALE3.SA",)], "t string").select(reports.ticker(F.col("t")), reports.root(F.col("t"))).collect()
    assert [tuple(r) for r in names] == [("PETR4.SA", "PETR"), ("VALE3.SA", "VALE")]
    with pytest.raises(Exception, match="blank"):
        spark.createDataFrame([(" ",)], "t string").select(reports.ticker(F.col("t"))).collect()


def test_windows():
    day = dt.date(2026, 4, 13)
    assert reports.years(today=day) == [2025, 2026] and reports.years([2024, 2024]) == [2024]
    assert reports.missing_years([2025, 2026], ["/x/HIST_A2025.TXT"]) == [2026]
    assert reports.window(end=day) == (dt.date(2025, 4, 13), day)


def test_csv_readers(spark, tmp_path):
    (tmp_path / "s.csv").write_text("﻿code,total_trades,average_return_pct,profit_factor,first_trade_date\na,12,1.2500,INF,2025-01-02\nb,3,,,\n", encoding="utf-8")
    got = {r.code: r for r in reports.summary(spark, str(tmp_path / "s.csv")).collect()}
    assert (got["a"].total_trades, got["a"].average_return_pct, got["a"].profit_factor, got["a"].first_trade_date) == (12, 1.25, float("inf"), dt.date(2025, 1, 2))
    assert (got["b"].average_return_pct, got["b"].profit_factor, got["b"].first_trade_date) == (None, None, None)
    assert reports.registry(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "r.csv").write_text("strategy_code,status,reasons,trades\nx,rejected,trades<200,5\n")
    assert tuple(reports.registry(spark, str(tmp_path / "r.csv")).first()) == ("x", "rejected", "trades<200", 5)
    (tmp_path / "t.csv").write_text("strategy_code,ticker\nx,A\ny,B\n")
    assert [r.ticker for r in reports.trades_of(spark, str(tmp_path / "t.csv"), spark.createDataFrame([("y",), ("y",)], "strategy_code string")).collect()] == ["B"]
    loose = spark.createDataFrame([("2.0", "", "7")], "target_pct string, total_trades string, trades string")
    assert tuple(reports.tolerant(loose, ("take_profit_pct", "total_trades", "stop_loss_pct")).select("take_profit_pct", "total_trades", "stop_loss_pct").first()) == (2.0, 7.0, 0.0)


def test_history(spark):
    day = dt.date(2026, 1, 1)
    rows = [("A", day + dt.timedelta(i), 1.0 + i, None if i == 4 else 0.5) for i in range(5)] + [("B", day, 1.0, 1.0)]
    got = reports.history(spark.createDataFrame(rows, "ticker string, trade_date date, close double, adj_close double"), 3).orderBy("trade_date").collect()
    assert [(r.ticker, r.adj_close) for r in got] == [("A", 0.5), ("A", 0.5), ("A", 5.0)]


def test_universe_and_archive(spark, tmp_path):
    (tmp_path / "u.csv").write_text("﻿Ticker,Nome\nzz3,Z\naa4,A\nZZ3,again\n,none\nbb5.SA,B\n", encoding="utf-8")
    assert [r.ticker for r in files.universe_csv(spark, str(tmp_path / "u.csv"), suffix=".SA").collect()] == ["ZZ3.SA", "AA4.SA", "BB5.SA"]
    assert [r.ticker for r in files.universe_csv(spark, str(tmp_path / "u.csv"), limit=1).collect()] == ["ZZ3"]
    line = ("01" + "2026XX02" + "  " + "AAAA3".ljust(12) + "010").ljust(245)
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("readme.md", "no")
        z.writestr("f.TXT", line + "\r\n" + line.replace("2026XX02", "20260302") + "\n99\n")
    got = files.records(spark, str(tmp_path / "f.zip")).collect()
    assert [(r.trade_date, r.market, r.close) for r in got] == [(None, 10, 0.0), (dt.date(2026, 3, 2), 10, 0.0)]


def test_keyed_loads(spark, tmp_path):
    path = str(tmp_path / "bars")
    first = spark.createDataFrame([("A", 1), ("B", 2)], "ticker string, v long")
    keyed.replace_by_key(first, path, "ticker")
    keyed.replace_by_key(spark.createDataFrame([("B", 3), ("C", 4)], "ticker string, v long"), path, "ticker")
    assert sorted((r.ticker, r.v) for r in spark.read.parquet(path).collect()) == [("A", 1), ("B", 3), ("C", 4)]
    new = spark.createDataFrame([("B", 8), ("B", 9)], "ticker string, v long")
    assert sorted(map(tuple, keyed.upserted(first, new, "ticker").collect())) == [("A", 1), ("B", 9)]
    assert keyed.stale(spark, str(tmp_path / "none"))
    spark.createDataFrame([(dt.datetime(2026, 1, 5, 9),)], "last_sync timestamp").write.parquet(str(tmp_path / "meta"))
    assert keyed.stale(spark, str(tmp_path / "meta"), dt.date(2026, 1, 6)) and not keyed.stale(spark, str(tmp_path / "meta"), dt.date(2026, 1, 5))


def test_texts_and_merge(spark):
    df = spark.createDataFrame([("a|b", 1.0, 7), ("c", None, 10)], "k string, v double, n long")
    assert keyed.markdown(df.orderBy("n"), "T") == "# T\n\n| k | v | n |\n|---|---|---|\n| a\\|b | 1.0000 | 7 |\n| c |  | 10 |\n"
    assert keyed.console(df.orderBy("n")).splitlines()[2] == "a|b  1.0000   7"
    assert text.merge_same_header(df, None, df).count() == 4
    with pytest.raises(ValueError):
        text.merge_same_header(df, df.select("v", "k", "n"))


def test_pattern_measures_and_report(spark):
    day = dt.date(2026, 1, 1)
    rows = [("asset_long_open_tp2_sl1_cap5", 5, f"T{i % 4}", day + dt.timedelta(i), day, "take_profit" if i % 10 else "stop_loss_conflict", 2.0 if i % 10 else -1.0) for i in range(40)]
    trades = spark.createDataFrame(rows, "template string, itemset long, ticker string, trade_date date, exit_date date, exit_reason string, trade_return_pct double")
    m = patterns.measures(trades, patterns.KEY).first()
    assert (m.n, m.tickers, m.tp, m.sl, m.net, m.pf) == (40, 4, 90.0, 10.0, 68.0, 18.0)
    got = patterns.report(trades, "2026-01-21").first()
    assert (got.train_n, got.test_n, got.passes_train, got.passes_test, got.significant) == (20, 20, True, True, True)
    gone = trades.withColumn("trade_return_pct", F.when(F.col("ticker") == "T0", -100.0).otherwise(F.col("trade_return_pct")))
    by = {r.ticker: r.cumulative for r in patterns.by_ticker(gone).collect()}
    assert by["T0"] == -100.0 and by["T1"] == pytest.approx((1.02**10 - 1) * 100, abs=1e-3)
    assert patterns.actions(patterns.by_ticker(trades)).count() == 4


def test_exit_grid_by_hand(spark):
    day = dt.date(2026, 1, 5)
    states = spark.createDataFrame([("A", day, "open", [3, 40]), ("B", day, "open", [3]), ("C", day, "close", [3])], "ticker string, trade_date date, entry_rule string, items array<int>")
    base = spark.createDataFrame([("asset_short_open_tp2_sl1_cap5", 4)], "template string, itemset long")
    two, one = "asset_long_open_tp2_sl1_cap5", "asset_long_open_tp1_sl1_cap5"
    rows = [(two, "A", "open", "take_profit", 2.0), (two, "B", "open", "stop_loss_conflict", -1.0), (one, "A", "open", "take_profit", 1.0), (one, "B", "open", "time_cap", 0.5), ("asset_long_close_tp2_sl1_cap5", "C", "close", "take_profit", 2.0)]
    samples = spark.createDataFrame([(t, k, day, e, why, x) for t, k, e, why, x in rows], "template string, ticker string, trade_date date, entry_rule string, exit_reason string, trade_return_pct double")
    sums = exit_grid.variants(states, samples, base, [0, 2])
    got = {r.target: r for r in exit_grid.strategies(sums).collect()}
    assert set(got) == {1.0, 2.0} and {r.template for r in got.values()} == {"asset_short_open_tp2_sl1_cap5"}
    a, b = got[1.0], got[2.0]
    assert (a.n, a.tickers, a.tp, a.cap, a.win, a.av, a.pf, a.place, a.passes) == (2, 2, 50.0, 50.0, 100.0, 0.75, 9999.0, 1, False)
    assert (b.sl, b.av, b.net, b.pf, b.place) == (50.0, 0.5, 1.0, 2.0, 2)
    assert (a.score, b.score) == (50 * 2.5 + 0.75 * 35 + 64 + 8, 50 * 2.5 + 0.5 * 35 + 16 + 16 - 60)
    low = {"n": 2, "target": 2.0}
    final = exit_grid.final_tickers(sums, low, {"tp": 50.0}).collect()
    assert [(r.ticker, r.target) for r in final] == [("A", 2.0)]
    assert exit_grid.strategies(exit_grid.variants(states.limit(0), samples, base, [0, 2])).count() == 0
    assert len(exit_grid.PAIRS) == 24 and len(exit_grid.TEMPLATES) == 48
