"""Queries of the tiered reports and of the option report, with DuckDB SQL of their own.

The reports' limits are their defaults, but for the number of tickers, which these tables don't have: FEW stands for it.
"""

from __future__ import annotations

from functools import partial

from candlework.functions.sql import chain, in_duckdb, run
from candlework.operators import features, option_report, options, patterns, tiers
from candlework.plans import assets, derivatives
from candlework.plans import patterns as mined
from candlework.plans.followup import kept_steps
from candlework.sinks.spool import spool
from candlework.sources import bars

FEW = 20
ELITE, ACCURATE = patterns.ELITE | {"tickers": FEW}, patterns.ACCURATE | {"tickers": FEW}
ROBUST, AGGRESSIVE, BLOCK = patterns.ROBUST | {"tickers": FEW}, patterns.AGGRESSIVE | {"tickers": FEW}, tiers.BLOCK | {"tickers": FEW}


def _scored(t):
    return patterns.report(t, mined.SPLIT)


def _accurate(t):
    return tiers.accurate(_scored(t), ACCURATE).select(*patterns.KEY, "target", "n", "tickers", "tp", "win", "av", "pf", "test_n", "test_tp", "test_win", "test_av", "test_pf", "accuracy")


def _accurate_actions(t):
    return tiers.action_scores(tiers.records(t).join(tiers.accurate(_scored(t), ACCURATE).select(*patterns.KEY), list(patterns.KEY), "left_semi"))


def _free(t):
    return tiers.free(patterns.measures(t, patterns.KEY), robust=ROBUST, aggressive=AGGRESSIVE)


def _free_actions(t):
    return tiers.roll_up(tiers.qualified(tiers.records(t), _free(t).where("leads"), tiers.FREE_TICKER), "win")


def _elite_overall(t):
    return tiers.roll_up(tiers.qualified(tiers.records(t), _scored(t).where(patterns.passes(ELITE)), tiers.ELITE_TICKER), "success")


def _list_overall(t):
    return tiers.roll_up(tiers.qualified(tiers.records(t), tiers.whole(t).where(patterns.passes(tiers.STRATEGY_LIST)), tiers.ELITE_TICKER), "success")


def _block_counts(t):
    return tiers.block_counts(tiers.block(tiers.whole(t), BLOCK), list(features.KEYS))


def _with_trades(make, spark, d):
    return make(mined._inputs(spark, d)[1])


def _option_run(spark, d):
    spot, chains = spool(bars.spot_bars(spark, d), "bars"), bars.option_bars(spark, d)
    trades = spool(run(spark, options.trade_steps(options.grid()), "SELECT * FROM trades", bars=spot, options=chains), "option-trades")
    return run(spark, options.SUMMARY, "SELECT * FROM summary", trades=trades), trades, spot, chains


QUERIES = {
    "tier_accurate": partial(_with_trades, _accurate),
    "tier_accurate_actions": partial(_with_trades, _accurate_actions),
    "tier_free": partial(_with_trades, _free),
    "tier_free_actions": partial(_with_trades, _free_actions),
    "tier_elite_overall": partial(_with_trades, _elite_overall),
    "tier_list_overall": partial(_with_trades, _list_overall),
    "tier_block": partial(_with_trades, lambda t: tiers.block(tiers.whole(t), BLOCK)),
    "tier_block_counts": partial(_with_trades, _block_counts),
    "tier_per_stock": partial(_with_trades, lambda t: tiers.per_stock(tiers.records(t))),
    "opt_report_strategies": lambda spark, d: option_report.strategies(*_option_run(spark, d)[:2]),
    "opt_report_header": lambda spark, d: option_report.header(*_option_run(spark, d)),
}

_SUCCESS = "round(count(*) FILTER (WHERE trade_return_pct >= 0) * 100e0 / count(*), 6) AS success"
_RECORDS = [
    ("rec", f"SELECT template, itemset, ticker, {mined._ALL}, {_SUCCESS}, round(stddev_pop(trade_return_pct), 9) AS sd, min(trade_date) AS first_date, max(trade_date) AS last_date FROM ptrades GROUP BY template, itemset, ticker"),
    ("pat", f"SELECT template, itemset, count(DISTINCT ticker) AS tickers, {mined._ALL}, {_SUCCESS} FROM ptrades GROUP BY template, itemset"),
    ("accurate", f"SELECT *, round(test_win * 3 + test_tp * 2.5 + win * 1.4 + tp * 1.1 + test_av * 12 + least(test_pf, 20) * 4 + log10(greatest(test_n, 1)) * 10 - sl * 0.8 - test_sl * 1.2 + 1e-9, 4) AS accuracy FROM split2 WHERE n >= 200 AND tickers >= {FEW} AND win >= 75 AND tp >= 70 AND pf >= 2.5 AND av >= 1 AND test_n >= 25 AND test_win >= 85 AND test_tp >= 80 AND test_pf >= 4 AND test_av >= 1.5"),
    ("strict", "SELECT * FROM pat WHERE win >= 60 AND av >= 1 AND pf >= 2 AND n >= 80 AND tickers >= 8"),
    ("leaders", f"SELECT template, itemset FROM strict WHERE n >= 300 AND tickers >= {FEW} ORDER BY av DESC, win DESC, pf DESC, n DESC, template, itemset LIMIT 10"),
    ("in_block", f"SELECT template, itemset, split_part(template, '_', 3) AS entry_rule, CASE WHEN itemset < 1024 THEN 1 ELSE 2 END AS states, 2e0 AS target, 1e0 AS stop, n, tickers, tp, success, sl, av, pf, round(2.6 * tp + 1.7 * success + 18 * least(pf, 10) + 24 * av - 1.3 * sl + 14 * log10(greatest(n, 1)) + 10 * log10(greatest(tickers, 1)) + 1e-9, 4) AS score FROM pat WHERE n >= 300 AND tickers >= {FEW} AND success >= 85 AND tp >= 85 AND pf >= 2.5 AND av >= 0.45 AND sl <= 12 ORDER BY score DESC, tp DESC, pf DESC, av DESC, n DESC, template, itemset LIMIT 100"),
]


def _mean(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(28, 6))) AS DOUBLE) / count(*)"


def _overall(rate: str, chosen: str, gate: str) -> str:
    means = ", ".join(f"round({_mean(c)} + 1e-9, 4) AS mean_{c}" for c in ("av", rate))
    first = "row(-pf, template, itemset)"
    return f"SELECT ticker, count(*) AS patterns, CAST(sum(n) AS BIGINT) AS trades, CAST(sum(CAST(net AS DECIMAL(28, 6))) AS DOUBLE) AS net, {means}, max(pf) AS best_pf, arg_min(template, {first}) AS best_template, arg_min(itemset, {first}) AS best_itemset FROM rec SEMI JOIN ({chosen}) USING (template, itemset) WHERE n >= 15 AND av >= 1 AND net > 0 AND {gate} GROUP BY ticker"


_NAMES = "[" + ", ".join(f"'{k}'" for k in features.KEYS) + "]"
_BEST = "row(-win, -tp, -n, -av, template, itemset)"
_FINAL = {
    "tier_accurate": "SELECT template, itemset, 2e0 AS target, n, tickers, tp, win, av, pf, test_n, test_tp, test_win, test_av, test_pf, accuracy FROM accurate",
    "tier_accurate_actions": f"SELECT ticker, patterns, trades, round(av + 1e-9, 4) AS mean_av, round(win + 1e-9, 4) AS mean_win, round(tp + 1e-9, 4) AS mean_tp, round(sl + 1e-9, 4) AS mean_sl, best_pf, round(patterns * 10 + trades * 0.05 + win * 1.5 + tp * 1.2 + av * 20 + least(best_pf, 20) * 2 - sl * 0.8 + 1e-9, 4) AS score, best_template, best_itemset FROM (SELECT ticker, count(*) AS patterns, CAST(sum(n) AS BIGINT) AS trades, {_mean('av')} AS av, {_mean('win')} AS win, {_mean('tp')} AS tp, {_mean('sl')} AS sl, max(pf) AS best_pf, arg_min(template, {_BEST}) AS best_template, arg_min(itemset, {_BEST}) AS best_itemset FROM rec SEMI JOIN accurate USING (template, itemset) GROUP BY ticker)",
    "tier_free": f"SELECT 'robust' AS tier, template, itemset, n, tickers, win, av, net, pf, (template, itemset) IN (SELECT (template, itemset) FROM leaders) AS leads FROM strict WHERE n >= 300 AND tickers >= {FEW} UNION ALL SELECT 'aggressive', template, itemset, n, tickers, win, av, net, pf, false FROM strict WHERE win >= 70 AND av >= 1.5 AND pf >= 3 AND tickers >= {FEW}",
    "tier_free_actions": _overall("win", "SELECT * FROM leaders", "win >= 60 AND pf >= 2"),
    "tier_elite_overall": _overall("success", f"SELECT * FROM split2 WHERE n >= 200 AND tickers >= {FEW} AND tp >= 65 AND win >= 70 AND av >= 1.3 AND pf >= 2.5 AND test_tp >= 70 AND test_av >= 2", "success >= 55 AND pf >= 1.5"),
    "tier_list_overall": _overall("success", "SELECT * FROM pat WHERE success >= 58 AND pf >= 2 AND av >= 1 AND n >= 80 AND tickers >= 8", "success >= 55 AND pf >= 1.5"),
    "tier_block": "SELECT * FROM in_block",
    "tier_block_counts": "SELECT 'entry_rule' AS what, entry_rule AS value, count(*) AS patterns FROM in_block GROUP BY entry_rule UNION ALL SELECT 'target', CAST(CAST(target AS DECIMAL(9, 2)) AS VARCHAR), count(*) FROM in_block GROUP BY target UNION ALL "
    f"(SELECT 'features', f, count(*) AS k FROM (SELECT concat_ws(' ', {_NAMES}[(itemset % 1024 - 1) // 16 + 1], CASE WHEN itemset >= 1024 THEN {_NAMES}[(itemset // 1024 - 1) // 16 + 1] END) AS f FROM in_block) GROUP BY f ORDER BY k DESC, f LIMIT 15)",
    "tier_per_stock": "SELECT ticker, count(*) OVER t AS patterns, max(av) OVER t AS best_av, CAST(row_number() OVER (PARTITION BY ticker ORDER BY score DESC, template, itemset) AS INTEGER) AS place, * EXCLUDE (ticker) FROM (SELECT template, itemset, ticker, n, tp, win, av, net, pf, sharpe, round(3 * tp + 25 * av + 10 * least(pf, 8) + 5 * ln(n) + 15 * sharpe + 1e-9, 4) AS score, first_date, last_date FROM (SELECT *, round(CASE WHEN n > 1 AND sd > 0 THEN av / sd ELSE 0 END, 6) AS sharpe FROM rec) WHERE n >= 20 AND tp >= 65 AND win >= 70 AND av >= 1.5 AND pf >= 2.5) WINDOW t AS (PARTITION BY ticker)",
}
ORACLE_SQL = {name: kept_steps(in_duckdb(chain(assets.BARS + assets._BOTH + mined._TRADES + _RECORDS, final, True))) for name, final in _FINAL.items()}

_RUN = options.trade_steps(options.grid()) + options.SUMMARY
_WHY = "array_to_string(list_filter([CASE WHEN success_rate_pct < 55 THEN 'success_rate<55.00' END, CASE WHEN NOT pf_is_inf AND coalesce(profit_factor, -1) < 1.1 THEN 'profit_factor<1.10' END, CASE WHEN avg_return_pct < 0 THEN 'average_return<0.00' END, CASE WHEN trades < 10 THEN 'trades<10' END, CASE WHEN net_return_pct <= 0 THEN 'net<=0' END], lambda x: x IS NOT NULL), ';')"
_COUNTS = "count(*) AS trades, count(*) FILTER (WHERE trade_return_pct > 0) AS gains, count(*) FILTER (WHERE trade_return_pct < 0) AS losses, count(*) FILTER (WHERE trade_return_pct = 0) AS flats"
_REPORT = [
    ("judged", f"SELECT *, {_WHY} AS reasons FROM summary"),
    ("per", "SELECT strategy_code, ticker, count(*) AS k, round(CAST(sum(CAST(trade_return_pct AS DECIMAL(28, 9))) AS DOUBLE) + 0e0, 6) AS total FROM trades GROUP BY strategy_code, ticker"),
    ("firsts", "SELECT strategy_code, ticker, total, k FROM per QUALIFY row_number() OVER (PARTITION BY strategy_code ORDER BY total DESC, total / k DESC, k DESC, ticker) = 1"),
]
ORACLE_SQL["opt_report_strategies"] = derivatives.oracle(_RUN + _REPORT, f"SELECT strategy_code, CASE WHEN reasons = '' THEN 'approved' ELSE 'rejected' END AS status, reasons, j.tickers, c.trades, gains, losses, flats, success_rate_pct, profitable_rate_pct, avg_return_pct, median_return_pct, net_return_pct, profit_factor, f.ticker AS first_ticker, f.total AS first_net, f.k AS first_trades FROM judged j JOIN (SELECT strategy_code, {_COUNTS} FROM trades GROUP BY strategy_code) c USING (strategy_code) JOIN firsts f USING (strategy_code)")
ORACLE_SQL["opt_report_header"] = derivatives.oracle(_RUN + _REPORT, f"SELECT (SELECT count(DISTINCT ticker) FROM bars) AS spot_tickers, (SELECT count(DISTINCT underlying_root) FROM options) AS roots, (SELECT count(DISTINCT option_symbol) FROM options) AS contracts, (SELECT count(*) FROM judged) AS strategies, (SELECT count(*) FROM judged WHERE reasons = '') AS approved, (SELECT count(*) FROM judged WHERE reasons <> '') AS rejected, {_COUNTS} FROM trades")
