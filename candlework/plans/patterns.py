"""Queries on the trades of mined patterns, with DuckDB SQL of their own."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from candlework.functions.sql import chain, in_duckdb
from candlework.operators import counting, exit_grid, exits, features, mining, patterns
from candlework.plans import assets
from candlework.sinks.spool import spool
from candlework.sources import bars

#: Which patterns' trades are materialised: the heavy run's limits, and nearly all targets hit, for prices of these tables return to
#: their mean and tens of thousands of patterns would pass without.
GATE = "trades >= 200 AND tickers >= 20 AND success_rate_pct >= 60 AND take_profit_rate_pct >= 95 AND avg_return_pct >= 1 AND (pf_is_inf OR profit_factor >= 2)"
SPLIT, AS_OF = "1996-01-01", "1998-06-30"


#: States and trades of the tables as they are: mining is the dear part and all reports share it.
_mined: dict[tuple, tuple] = {}


def _version(spark, d):
    """The session, and path, length and time of every file: a table that is written again is another one."""
    files = spark.read.format("binaryFile").load([f"{d}/{t}.parquet" for t in ("lineitem", "part")]).select("path", "length", "modificationTime")
    return (spark.sparkContext.applicationId, *sorted(map(tuple, files.collect())))


def _inputs(spark, d):
    key = _version(spark, d)
    if key not in _mined:
        _mined.clear()
        _mined[key] = _mine(spark, d)
    return _mined[key]


def _mine(spark, d):
    spot = spool(bars.spot_bars(spark, d), "bars")
    states = spool(mining.packed_states(spool(features.values(spot), "values"), features.KEYS, features.LADDER.get), "states")
    samples = spool(exits.samples(spot, assets.TEMPLATES, tasks=counting.tasks(spark, spot.count() // 2)), "samples")
    rows = spool(mining.with_outcomes(states, samples, assets.NAMES), "mined")
    both = assets._mined(1, spark, d, rows).unionByName(assets._mined(2, spark, d, rows))
    approved = spool(both.where(GATE), "approved")
    return states, spool(patterns.trades(states, samples, approved, assets.PLACES), "pattern-trades")


def _query(make, spark, d):
    states, trades = _inputs(spark, d)
    return make(states, trades)


def _scored(trades):
    return patterns.report(trades, SPLIT)


def _ranked(states, trades):
    """R4: the miner's order, its first hundred."""
    rows = patterns.measures(trades, patterns.KEY).orderBy(F.desc("net"), F.desc("pf"), F.desc("av"), F.desc("n"), "template", "itemset").limit(100)
    return rows.select("template", "itemset", "n", "tickers", "net", "pf", "av")


MAKE = {
    "pattern_trades": lambda states, t: t.withColumn("trade_return_pct", F.round("trade_return_pct", 6)),
    "pattern_measures": lambda states, t: patterns.measures(t, patterns.KEY),
    "pattern_ranked": _ranked,
    "pattern_tickers": lambda states, t: patterns.by_ticker(t),
    "pattern_report": lambda states, t: _scored(t),
    "pattern_shortlist": lambda states, t: patterns.best_of_each_state(_scored(t).where(patterns.passes(patterns.LOW))).select("template", "itemset", "n", "score"),
    "pattern_filters": lambda states, t: patterns.filters(_scored(t)),
    "pattern_operational": lambda states, t: patterns.operational(_scored(t), patterns.by_ticker(t), {"pattern": patterns.LOW, "ticker": patterns.LOW_TICKER, "qualified": 3}),
    "pattern_actions": lambda states, t: patterns.actions(patterns.by_ticker(t)),
    "pattern_target_hits": lambda states, t: patterns.target_hits(_scored(t), patterns.by_ticker(t)),
    "pattern_signals": lambda states, t: patterns.signals(states, patterns.measures(t, patterns.KEY), patterns.by_ticker(t), assets.PLACES, AS_OF),
}
QUERIES = {name: partial(_query, make) for name, make in MAKE.items()}

#: Limits of a final exit that these tables can pass; the operator's defaults are the report's.
LOW_EXIT, LOW_EXIT_TICKER = {"n": 200, "tickers": 20, "target": 1.0, "tp": 50.0, "av": 0.1, "pf": 1.0}, {"n": 5, "tp": 50.0, "av": 0.0, "pf": 1.0}
_exits: dict[tuple, object] = {}


def _exit_sums(spark, d):
    """Sums of every approved pattern, pair and ticker: made once a session, as the patterns are."""
    states, trades = _inputs(spark, d)
    key = _version(spark, d)
    if key not in _exits:
        _exits.clear()
        spot = spool(bars.spot_bars(spark, d), "bars")
        samples = spool(exits.samples(spot, exit_grid.TEMPLATES, tasks=counting.tasks(spark, spot.count() * len(exit_grid.TEMPLATES) // 8)), "grid-samples")
        _exits[key] = spool(exit_grid.variants(states, samples, trades.select(*patterns.KEY).distinct(), assets.PLACES), "exit-sums")
    return _exits[key]


QUERIES |= {
    "pattern_exits": lambda spark, d: exit_grid.strategies(_exit_sums(spark, d)),
    "pattern_exit_tickers": lambda spark, d: exit_grid.by_ticker(_exit_sums(spark, d)),
    "pattern_exit_final": lambda spark, d: exit_grid.final_tickers(_exit_sums(spark, d), LOW_EXIT, LOW_EXIT_TICKER),
}

# The oracle: its own sums, gates and scores over the miner's DuckDB steps.
_NET = "CAST(sum(CAST(trade_return_pct AS DECIMAL(18, 9))) AS DOUBLE)"


def _over(w: str) -> dict[str, str]:
    part = f"FILTER (WHERE {w})"
    gain, loss = (f"CAST(coalesce(sum(CAST({s}trade_return_pct AS DECIMAL(18, 9))) FILTER (WHERE {w} AND trade_return_pct {o} 0), 0) AS DOUBLE)" for s, o in (("", ">"), ("-", "<")))
    net = f"CAST(coalesce(sum(CAST(trade_return_pct AS DECIMAL(18, 9))) {part}, 0) AS DOUBLE)"
    n = f"nullif(count(*) {part}, 0)"
    rate = lambda c: f"round(count(*) FILTER (WHERE {w} AND {c}) * 100.0::DOUBLE / {n}, 6)"
    return {
        "n": f"count(*) {part}",
        "tp": rate("exit_reason = 'take_profit'"),
        "win": rate("trade_return_pct > 0"),
        "sl": rate("starts_with(exit_reason, 'stop_loss')"),
        "cap": rate("exit_reason = 'time_cap'"),
        "av": f"round({net} / {n} + 0e0, 6)",
        "net": f"round({net} + 0e0, 6)",
        "pf": f"round(CASE WHEN {n} IS NULL THEN NULL WHEN {loss} > 0 THEN least({gain} / {loss}, 9999e0) WHEN {gain} > 0 THEN 9999e0 ELSE 0e0 END, 6)",
    }


def _columns(periods: dict[str, str]) -> str:
    return ", ".join(f"{x} AS {p}{name}" for p, w in periods.items() for name, x in _over(w).items())


_WINS = "count(*) FILTER (WHERE trade_return_pct > 0) AS wins"
_ALL = _columns({"": "true"})
_TRADES = [
    ("approved", f"SELECT template, itemset FROM both_sizes WHERE {GATE}"),
    ("ptrades", "SELECT s.template, x.itemset, s.ticker, s.trade_date, s.exit_date, s.exit_reason, s.trade_return_pct FROM (SELECT * FROM sets1 UNION ALL SELECT * FROM sets) x JOIN samples s ON s.ticker = x.ticker AND s.trade_date = x.trade_date AND s.entry_rule = x.entry_rule JOIN approved a ON a.template = s.template AND a.itemset = x.itemset"),
    ("whole", f"SELECT template, itemset, count(DISTINCT ticker) AS tickers, {_ALL}, {_WINS} FROM ptrades GROUP BY template, itemset"),
    ("per_ticker", f"SELECT template, itemset, ticker, {_ALL}, {_WINS}, min(trade_date) AS first_date, max(trade_date) AS last_date, round(CASE WHEN bool_or(trade_return_pct <= -100) THEN -100e0 ELSE (exp(sum(CASE WHEN trade_return_pct > -100 THEN ln(1 + trade_return_pct / 100) END)) - 1) * 100 END, 4) AS cumulative FROM ptrades GROUP BY template, itemset, ticker"),
    ("split0", f"SELECT template, itemset, count(DISTINCT ticker) AS tickers, round(stddev_pop(trade_return_pct), 9) AS sd, {_WINS}, {_columns({'': 'true', 'train_': f'trade_date < DATE {SPLIT!r}', 'test_': f'trade_date >= DATE {SPLIT!r}'})} FROM ptrades GROUP BY template, itemset"),
    ("split1", "SELECT *, round(CASE WHEN n > 1 AND sd > 0 THEN av / sd ELSE 0 END, 6) AS sharpe FROM split0"),
    (
        "split2",
        "SELECT * EXCLUDE (sd, wins), coalesce(train_n >= 15 AND train_tp >= 55 AND train_win >= 58 AND train_av >= 0.8 AND train_pf >= 1.8, false) AS passes_train, coalesce(test_n >= 10 AND test_tp >= 50 AND test_win >= 55 AND test_av >= 0.5 AND test_pf >= 1.5, false) AS passes_test, "
        "n >= 5 AND coalesce((wins * 1e0 / n - 0.5) / sqrt(0.25 / n) > 1.6448536 AND av / (nullif(sd, 0) / sqrt(n)) > 1.6448536, false) AS significant, "
        "round(3 * tp + 25 * av + 10 * least(pf, 8) + 5 * ln(n) + 2 * least(tickers, 50) + 3 * (0.5 * coalesce(test_tp, 0) + 20 * coalesce(test_av, 0)) + 15 * sharpe + 1e-9, 4) AS score FROM split1",
    ),
]
_LOW = "n >= 80 AND tickers >= 8 AND win >= 45 AND av >= 0 AND pf >= 1"
_STRICT = "win >= 60 AND av >= 1 AND pf >= 2 AND n >= 80 AND tickers >= 8"
_LATEST = [
    ("seen", f"SELECT * FROM packed WHERE trade_date <= DATE '{AS_OF}'"),
    ("held_sets", f"SELECT x.ticker, x.trade_date, x.entry_rule, x.itemset FROM (SELECT * FROM sets1 UNION ALL SELECT * FROM sets) x JOIN (SELECT ticker, max(trade_date) AS d FROM seen GROUP BY ticker) m ON m.ticker = x.ticker AND m.d = x.trade_date"),
    ("fired", "SELECT w.template, w.itemset, h.ticker, h.trade_date, w.n, w.win, w.av, w.pf, p.n AS ticker_n, p.av AS ticker_av, p.win AS ticker_win, p.pf AS ticker_pf, count(*) OVER (PARTITION BY h.ticker) AS ticker_signals FROM held_sets h JOIN whole w ON w.itemset = h.itemset AND split_part(w.template, '_', 3) = h.entry_rule LEFT JOIN per_ticker p ON p.template = w.template AND p.itemset = w.itemset AND p.ticker = h.ticker"),
    ("weighed", "SELECT *, round(50 * ticker_signals + 100 * coalesce(ticker_av, 0) + 2 * coalesce(ticker_win, 0) + 5 * least(coalesce(ticker_pf, 0), 20) + 0.3 * least(coalesce(ticker_n, 0), 120) + 30 * av + win + 1e-9, 4) AS score FROM fired"),
]
_FINAL = {
    "pattern_trades": "SELECT * REPLACE (round(trade_return_pct, 6) AS trade_return_pct) FROM ptrades",
    "pattern_measures": "SELECT * FROM whole",
    "pattern_ranked": "SELECT template, itemset, n, tickers, net, pf, av FROM whole ORDER BY net DESC, pf DESC, av DESC, n DESC, template, itemset LIMIT 100",
    "pattern_tickers": "SELECT *, av AS median FROM per_ticker",
    "pattern_report": "SELECT * FROM split2",
    "pattern_shortlist": f"SELECT template, itemset, n, score FROM split2 WHERE {_LOW} QUALIFY row_number() OVER (PARTITION BY itemset ORDER BY score DESC, template) = 1",
    "pattern_filters": "SELECT template, itemset, coalesce(n >= 200 AND tickers >= 50 AND tp >= 65 AND win >= 70 AND av >= 1.3 AND pf >= 2.5 AND test_tp >= 70 AND test_av >= 2, false) AS elite, coalesce(n >= 200 AND tickers >= 50 AND win >= 75 AND tp >= 70 AND pf >= 2.5 AND av >= 1 AND test_n >= 25 AND test_win >= 85 AND test_tp >= 80 AND test_pf >= 4 AND test_av >= 1.5, false) AS accurate, "
    f"{_STRICT} AS strict, {_STRICT} AND n >= 300 AND tickers >= 50 AS robust, {_STRICT} AND win >= 70 AND av >= 1.5 AND pf >= 3 AND tickers >= 25 AS aggressive, win >= 58 AND pf >= 2 AND av >= 1 AND n >= 80 AND tickers >= 8 AS listed, {_LOW} AS low, "
    "round(test_win * 3 + test_tp * 2.5 + win * 1.4 + tp * 1.1 + test_av * 12 + least(test_pf, 20) * 4 + log10(greatest(test_n, 1)) * 10 - sl * 0.8 - test_sl * 1.2 + 1e-9, 4) AS accuracy FROM split2",
    "pattern_operational": f"SELECT s.template, s.itemset, s.n, s.tickers, s.win, s.av, s.pf, q.qualified, round(av * 25 + (win - 50) * 1.5 + least(pf, 8) * 8 + least(log10(greatest(n, 1)), 3) * 4 + least(log10(greatest(tickers, 1)), 2) * 4 + qualified * 5.5 + 1e-9, 4) AS score FROM split2 s JOIN (SELECT template, itemset, count(*) AS qualified FROM per_ticker WHERE n >= 5 AND win >= 50 AND av >= 0 AND pf >= 1 AND net > 0 GROUP BY template, itemset HAVING count(*) >= 3) q ON q.template = s.template AND q.itemset = s.itemset WHERE {_LOW}",
    "pattern_actions": "SELECT ticker, count(*) AS patterns, CAST(sum(n) AS BIGINT) AS trades, round(CAST(sum(CAST(av AS DECIMAL(18, 6))) AS DOUBLE) / count(*) + 1e-9, 4) AS mean_av, round(CAST(sum(CAST(win AS DECIMAL(18, 6))) AS DOUBLE) / count(*) + 1e-9, 4) AS mean_win, max(pf) AS best_pf, arg_min(itemset, row(-pf, itemset)) AS best_itemset FROM per_ticker WHERE n >= 5 AND win >= 50 AND av >= 0 AND pf >= 1 GROUP BY ticker",
    "pattern_target_hits": "SELECT s.template, s.itemset, s.tp, s.tp >= 18 AS hits, coalesce(g.k, 0) AS good_tickers FROM split2 s LEFT JOIN (SELECT template, itemset, count(*) AS k FROM per_ticker WHERE n >= 15 AND tp >= 20 GROUP BY template, itemset) g ON g.template = s.template AND g.itemset = s.itemset",
    "pattern_signals": "SELECT template, itemset, ticker, trade_date, n, win, av, pf, ticker_n, ticker_av, ticker_n IS NOT NULL AS qualified, ticker_signals, score, CAST(row_number() OVER (PARTITION BY ticker ORDER BY score DESC, template, itemset) AS INTEGER) AS place FROM weighed",
}
# The exit grid: trades of the grid beside those of the miner, under other names.
_GRID = assets._rename(exits.steps(exit_grid.TEMPLATES), "_grid")
_EXITS = [
    ("pairs", "SELECT * FROM (VALUES " + ", ".join(f"('{t['template']}', {t['tp']}::DOUBLE, {t['sl']}::DOUBLE)" for t in exit_grid.TEMPLATES) + ") AS v(variant, target, stop)"),
    ("bases", "SELECT DISTINCT template, itemset FROM ptrades"),
    ("again", "SELECT b.template, b.itemset, p.target, p.stop, s.ticker, s.trade_date, s.exit_reason, s.trade_return_pct FROM bases b JOIN (SELECT * FROM sets1 UNION ALL SELECT * FROM sets) x ON x.itemset = b.itemset AND x.entry_rule = split_part(b.template, '_', 3) JOIN samples_grid s ON s.ticker = x.ticker AND s.trade_date = x.trade_date AND s.entry_rule = x.entry_rule JOIN pairs p ON p.variant = s.template"),
    ("exit_whole0", f"SELECT template, itemset, target, stop, count(DISTINCT ticker) AS tickers, {_ALL} FROM again GROUP BY template, itemset, target, stop"),
    ("exit_whole", "SELECT *, round(tp * 2.5 + av * 35 + least(pf, 8) * 8 + target * 8 - sl * 1.2 + 1e-9, 4) AS score FROM exit_whole0"),
    ("exit_ticker", f"SELECT template, itemset, target, stop, ticker, {_ALL} FROM again GROUP BY template, itemset, target, stop, ticker"),
]
_EXIT_FINAL = {
    "pattern_exits": "SELECT *, n >= 300 AND tickers >= 50 AND target >= 2 AND tp >= 50 AND av >= 1 AND pf >= 2 AS passes, CAST(row_number() OVER (PARTITION BY template, itemset ORDER BY score DESC, target, stop) AS INTEGER) AS place FROM exit_whole",
    "pattern_exit_tickers": "SELECT *, n >= 15 AND tp >= 50 AND av >= 1 AND pf >= 2 AS passes FROM exit_ticker",
    "pattern_exit_final": "SELECT t.* FROM exit_ticker t JOIN exit_whole w USING (template, itemset, target, stop) WHERE w.n >= 200 AND w.tickers >= 20 AND w.target >= 1 AND w.tp >= 50 AND w.av >= 0.1 AND w.pf >= 1 AND t.n >= 5 AND t.tp >= 50 AND t.av >= 0 AND t.pf >= 1",
}
ORACLE_SQL = {name: in_duckdb(chain(assets.BARS + assets._BOTH + _TRADES + (_LATEST if name == "pattern_signals" else []), final, True)) for name, final in _FINAL.items()}
ORACLE_SQL |= {name: in_duckdb(chain(assets.BARS + assets._BOTH + _TRADES + _GRID + _EXITS, final, True)) for name, final in _EXIT_FINAL.items()}
