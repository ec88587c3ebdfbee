"""Queries that follow a mining run: monitor, validation in a window, recurrence, the trades store, reasons, registries."""

from __future__ import annotations

import re
import uuid
from functools import partial

from pyspark.sql import functions as F

from candlework.functions.sql import chain, in_duckdb, run
from candlework.operators import monitor, options, patterns, refinement, reports, strategies
from candlework.plans import assets, derivatives, equities
from candlework.plans import patterns as mined
from candlework.sinks.spool import shared_folder, spool
from candlework.sinks.trades import read_trades, write_trades
from candlework.sources import bars

AS_OF, WINDOW, LEADERS = mined.AS_OF, ("1998-01-01", "1998-12-31"), 20


def _monitor(make, spark, d):
    states, trades = mined._inputs(spark, d)
    strategies_ = patterns.measures(trades, patterns.KEY)
    fired = patterns.signals(states, strategies_, patterns.by_ticker(trades), assets.PLACES, AS_OF)
    return make(spark, d, strategies_, fired)


def _trades(make, spark, d):
    return make(mined._inputs(spark, d)[1])


def stored(spark, d):
    """Ticker records of the patterns that lead by net, from a store of which only their buckets are read."""
    trades = mined._inputs(spark, d)[1]
    path = f"{shared_folder(spark)}/trades-{uuid.uuid4().hex}"
    write_trades(trades, path)
    first = patterns.measures(trades, patterns.KEY).orderBy(F.desc("net"), *patterns.KEY).limit(LEADERS)
    return patterns.by_ticker(read_trades(spark, path, first.select(*patterns.KEY))).drop("median")


#: The templates whose baseline is known, and the first day of the trades at hand: what is missing gives its reason.
BASED, SINCE = tuple(t["template"] for t in options.templates()[:4]), "1996-06-01"
REASONS = {"states": 2, "avg_uplift": 0.0, "pf_uplift": 0.0, "trades": 20, "tickers": 5, "train": 10, "val": 3, "pf": 1.0, "months": 6, "months_ratio": 0.2, "val_months": 2, "val_ratio": 0.2}


def reasons(spark, d):
    steps, inputs = reports.refine_steps(reports.LOW_GATE), derivatives._refine_inputs(spark, d)
    inputs["pattern_trades"] = spool(run(spark, steps[1:2], "SELECT * FROM pattern_trades", **inputs), "pattern-trades")
    steps = steps[:1] + steps[2:]
    summary = run(spark, steps, "SELECT template, itemset, 2 AS states, n, tickers, av, pf FROM split", **inputs)
    baseline = run(spark, steps, "SELECT template, base_avg AS av, base_pf AS pf FROM baseline", **inputs).where(F.col("template").isin(*BASED))
    trades = inputs["pattern_trades"].where(F.col("trade_date") >= F.lit(SINCE).cast("date"))
    return refinement.reasoned(summary, baseline, trades, reports.SPLIT, REASONS)


def near(spark, d):
    """Overlaps of at least the limit, by rare tokens; the whole table of overlaps is refine_low_overlap."""
    steps, inputs = reports.refine_steps(reports.LOW_GATE), derivatives._refine_inputs(spark, d)
    inputs["pattern_trades"] = spool(run(spark, steps[1:2], "SELECT * FROM pattern_trades", **inputs), "pattern-trades")
    keys = run(spark, steps[:1] + steps[2:], "SELECT template, itemset, concat_ws('|', ticker, CAST(trade_date AS STRING), coalesce(option_symbol, '')) AS token FROM keys", **inputs)
    return refinement.near_overlaps(spool(keys.distinct(), "keys"), reports.LOW_GATE["overlap"])


def registry(spark, d, levels=(1.0, 2.0, 3.0, 4.0, 5.0)):
    """The registry of a run over the tables: definition, status, reasons, the last day tested on, results; in its order."""
    prices = spool(bars.price_bars(spark, d), "prices")
    grid = strategies.grid(levels)
    definitions = strategies.run(spark, [("defs", strategies.values(grid))], "SELECT strategy_code, family, setup_kind, trigger_direction, threshold_pct, direction, exit_offset FROM defs")
    tested = prices.agg(F.max("trade_date").alias("tested_on"))
    rows = strategies.summarize(prices, grid).join(definitions, "strategy_code").crossJoin(tested)  # one row
    status = F.when(F.col("reasons") == "", "approved").otherwise("rejected").alias("status")
    return rows.select("strategy_code", "family", "setup_kind", "trigger_direction", "threshold_pct", "direction", "exit_offset", status, "reasons", "tested_on", "trades", "success_rate_pct", "profitable_rate_pct", "avg_return_pct", "net_return_pct", "profit_factor").orderBy("status", "strategy_code")


def untested(spark, d):
    """What a run over all levels adds to a registry made over levels 1 to 3: only codes that it doesn't list."""
    known = registry(spark, d, (1.0, 2.0, 3.0))
    return strategies.without_known(equities.QUERIES["e2_summary"](spark, d), known).select("strategy_code", "tickers", "trades", "net_return_pct", "reasons")


QUERIES = {
    "monitor_counters": partial(_monitor, lambda spark, d, s, x: monitor.counters(s, x)),
    "monitor_triggered": partial(_monitor, lambda spark, d, s, x: monitor.triggered(x)),
    "monitor_operational": partial(_monitor, lambda spark, d, s, x: monitor.best(x)),
    "monitor_cards": partial(_monitor, lambda spark, d, s, x: monitor.cards(x, "BRAND#1", "close")),
    "monitor_header": partial(_monitor, lambda spark, d, s, x: monitor.header(s, x, bars.spot_bars(spark, d), AS_OF)),
    "pattern_validation": partial(_trades, lambda t: patterns.validated(t, *WINDOW)),
    "pattern_recurrence": partial(_trades, lambda t: patterns.recurrence(patterns.by_ticker(t))),
    "pattern_ticker_totals": partial(_trades, lambda t: patterns.ticker_totals(patterns.by_ticker(t))),
    "pattern_store": stored,
    "refine_reasons": reasons,
    "refine_near": near,
    "registry_build": registry,
    "registry_untested": untested,
}

_SIGNALS = [("sig", "SELECT *, ticker_n IS NOT NULL AS qualified, ticker_signals >= 3 AS operational, round(100 * av + 2 * win + 5 * least(coalesce(pf, 0), 20) + 0.03 * n + 25 * ticker_signals + 1e-9, 4) AS op_score FROM weighed")]
_MINED = assets.BARS + assets._BOTH + mined._TRADES
_FIRST = "op_score DESC, qualified DESC, av DESC, coalesce(ticker_av, 0) DESC, template, itemset"
_W = f"trade_date BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}'"
_FINAL = {
    "monitor_counters": "SELECT w.template, w.itemset, n, tickers, win, av, net, pf, coalesce(t.triggered, 0) AS triggered, coalesce(t.qualified, 0) AS qualified, coalesce(t.operational, 0) AS operational FROM whole w LEFT JOIN (SELECT template, itemset, count(*) AS triggered, count(*) FILTER (WHERE qualified) AS qualified, count(*) FILTER (WHERE operational) AS operational FROM sig GROUP BY ALL) t ON t.template = w.template AND t.itemset = w.itemset",
    "monitor_triggered": "SELECT ticker, count(*) AS signals, count(*) >= 3 AS operational FROM sig GROUP BY ticker ORDER BY signals DESC, ticker LIMIT 20",
    "monitor_operational": f"SELECT ticker, ticker_signals AS signals, op_score AS operational_score, template, itemset FROM sig WHERE operational QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY {_FIRST}) = 1 ORDER BY signals DESC, op_score DESC, ticker LIMIT 20",
    "monitor_cards": "SELECT ticker, template, itemset, score, confirming FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS confirming, row_number() OVER (PARTITION BY ticker ORDER BY score DESC, template, itemset) AS place FROM sig WHERE operational AND ticker ILIKE '%brand#1%' AND template LIKE 'asset\\__%\\_close\\_%' ESCAPE '\\') WHERE place = 1 ORDER BY score DESC, ticker LIMIT 12",
    "monitor_header": f"SELECT u.*, (SELECT count(*) FROM whole) AS strategies, (SELECT count(*) FROM sig) AS signals, (SELECT count(*) FROM sig WHERE qualified) AS qualified, (SELECT count(DISTINCT ticker) FROM sig WHERE operational) AS operational_tickers, (SELECT count(*) FROM sig WHERE operational) AS operational, (SELECT count(DISTINCT ticker) FROM sig) AS triggered_tickers FROM (SELECT max(last) AS latest_trade_date, count(*) AS universe_size FROM (SELECT max(trade_date) FILTER (WHERE trade_date <= DATE '{AS_OF}') AS last FROM bars GROUP BY ticker HAVING count(*) >= 70) WHERE last IS NOT NULL) u",
    "pattern_validation": "SELECT template, itemset, n, win, av, pf, v_n AS validation_n, count_t AS validation_tickers, v_wins AS validation_wins, coalesce(v_win, 0) AS validation_win, coalesce(v_av, 0) AS validation_av, v_net AS validation_net, coalesce(v_pf, 0) AS validation_pf FROM "
    + f"(SELECT template, itemset, {mined._ALL}, {mined._columns({'v_': _W})}, count(DISTINCT ticker) FILTER (WHERE {_W}) AS count_t, count(*) FILTER (WHERE {_W} AND trade_return_pct > 0) AS v_wins FROM ptrades GROUP BY template, itemset)",
    "pattern_recurrence": "SELECT ticker, count(*) AS patterns, count(*) FILTER (WHERE place = 1) AS firsts FROM (SELECT ticker, row_number() OVER (PARTITION BY template, itemset ORDER BY net DESC, av DESC, n DESC, ticker) AS place FROM per_ticker WHERE n >= 5) WHERE place <= 5 GROUP BY ticker ORDER BY patterns DESC, ticker LIMIT 25",
    "pattern_ticker_totals": "SELECT ticker, count(*) AS patterns, CAST(sum(n) AS BIGINT) AS trades, CAST(sum(CAST(net AS DECIMAL(28, 6))) AS DOUBLE) AS net, round(CAST(sum(CAST(av AS DECIMAL(28, 6))) AS DOUBLE) / count(*) + 1e-9, 4) AS mean_av, max(net) AS best_net FROM per_ticker WHERE n >= 5 GROUP BY ticker",
    "pattern_store": f"SELECT p.* FROM per_ticker p JOIN (SELECT template, itemset FROM whole ORDER BY net DESC, template, itemset LIMIT {LEADERS}) USING (template, itemset)",
}
_KEPT = ("bars", "valued", "packed", "samples", "sets1", "sets", "approved", "ptrades", "whole", "per_ticker", "held_sets", "weighed")


def kept_steps(sql: str) -> str:
    """Steps that DuckDB is to work out once, as they stand."""
    return re.sub(rf"(?m)^((?:WITH RECURSIVE )?(?:{'|'.join(_KEPT)})) AS \(", r"\g<1> AS MATERIALIZED (", sql)


ORACLE_SQL = {name: kept_steps(in_duckdb(chain(_MINED + (mined._LATEST + _SIGNALS if name.startswith("monitor") else []), final, True))) for name, final in _FINAL.items()}

_D = "CAST(trade_return_pct AS DECIMAL(18, 9))"
_G = REASONS


def _part(w: str, p: str) -> str:
    gp, gl = (f"CAST(coalesce(sum({s}{_D}) FILTER (WHERE {w} AND trade_return_pct {o} 0), 0) AS DOUBLE)" for s, o in (("", ">"), ("-", "<")))
    return f"count(*) FILTER (WHERE {w}) AS {p}_n, CAST(coalesce(sum({_D}) FILTER (WHERE {w}), 0) AS DOUBLE) AS {p}_net, {gp} AS {p}_gp, {gl} AS {p}_gl"


_LATE = f"trade_date >= DATE '{reports.SPLIT}'"
_WHY = [
    ("known", "SELECT template, base_avg, coalesce(base_pf, 0) AS base_pf FROM baseline WHERE template IN (" + ", ".join(f"'{t}'" for t in BASED) + ")"),
    ("at_hand", f"SELECT * FROM pattern_trades WHERE trade_date >= DATE '{SINCE}'"),
    ("halves", f"SELECT template, itemset, {_part('NOT ' + _LATE, 'a')}, {_part(_LATE, 'b')} FROM at_hand GROUP BY template, itemset"),
    ("months_of", f"SELECT template, itemset, count(*) AS m, count(*) FILTER (WHERE x > 0) AS p, count(y) AS vm, count(*) FILTER (WHERE y > 0) AS vp FROM (SELECT template, itemset, sum({_D}) AS x, sum({_D}) FILTER (WHERE {_LATE}) AS y FROM at_hand GROUP BY template, itemset, date_trunc('month', trade_date)) GROUP BY template, itemset"),
    ("facts", "SELECT s.template, s.itemset, s.n, s.tickers, s.av, k.template IS NOT NULL AS based, s.av - k.base_avg AS up, coalesce(s.pf, 0) - k.base_pf AS pf_up, h.* EXCLUDE (template, itemset), m, p, vm, vp, CASE WHEN a_n > 0 THEN a_net / a_n ELSE 0 END AS a_av, CASE WHEN b_n > 0 THEN b_net / b_n ELSE 0 END AS b_av FROM split s LEFT JOIN known k ON k.template = s.template LEFT JOIN halves h ON h.template = s.template AND h.itemset = s.itemset LEFT JOIN months_of q ON q.template = s.template AND q.itemset = s.itemset"),
    ("first_look", f"SELECT *, list_filter([CASE WHEN NOT based THEN 'missing_baseline' END, CASE WHEN up < {_G['avg_uplift']} THEN 'avg_uplift<0.00' END, CASE WHEN pf_up < {_G['pf_uplift']} THEN 'pf_uplift<0.00' END, CASE WHEN n < 20 THEN 'trades<20' END, CASE WHEN tickers < 5 THEN 'tickers<5' END], lambda x: x IS NOT NULL) AS one FROM facts"),
    ("second_look", "SELECT *, CASE WHEN a_n IS NULL THEN ['missing_trades'] ELSE list_filter([CASE WHEN a_n < 10 THEN 'train_trades<10' END, CASE WHEN b_n < 3 THEN 'validation_trades<3' END, CASE WHEN a_gl > 0 AND a_gp / a_gl < 1 OR a_gl = 0 AND a_gp = 0 THEN 'train_pf<1.00' END, CASE WHEN b_gl > 0 AND b_gp / b_gl < 1 OR b_gl = 0 AND b_gp = 0 THEN 'validation_pf<1.00' END, CASE WHEN a_av < 0 THEN 'train_avg<0.00' END, CASE WHEN b_av < 0 THEN 'validation_avg<0.00' END, CASE WHEN a_net <= 0 THEN 'train_net<=0' END, CASE WHEN b_net <= 0 THEN 'validation_net<=0' END, CASE WHEN m < 6 THEN 'active_months<6' END, CASE WHEN p * 1e0 / m < 0.2 THEN 'positive_month_ratio<0.20' END, CASE WHEN vm < 2 THEN 'validation_active_months<2' END, CASE WHEN coalesce(vp * 1e0 / nullif(vm, 0), 0) < 0.2 THEN 'validation_positive_month_ratio<0.20' END], lambda x: x IS NOT NULL) END AS two FROM first_look"),
]
_LOW = derivatives._E4 + derivatives._PAIRS + reports.refine_steps(reports.LOW_GATE)
ORACLE_SQL["refine_reasons"] = derivatives.oracle(_LOW + _WHY, "SELECT template, itemset, n, tickers, CASE WHEN len(one) > 0 THEN 'prefilter' WHEN len(two) > 0 THEN 'trades' ELSE 'refined' END AS stage, array_to_string(CASE WHEN len(one) > 0 THEN one ELSE two END, ';') AS reasons, CASE WHEN len(one) = 0 AND len(two) = 0 THEN round(5 * up + 20 * pf_up + 3 * b_av + 10 * coalesce(vp * 1e0 / nullif(vm, 0), 0) + av, 4) END AS robustness FROM second_look", True)
ORACLE_SQL["refine_near"] = derivatives.oracle(_LOW, f"SELECT template, first_set, second_set, common, share FROM overlap WHERE share >= {reports.LOW_GATE['overlap']}", True)
ORACLE_SQL["registry_build"] = f"WITH defs AS ({strategies.values(strategies.grid())}) SELECT s.strategy_code, family, setup_kind, trigger_direction, threshold_pct, direction, exit_offset, CASE WHEN reasons = '' THEN 'approved' ELSE 'rejected' END AS status, reasons, (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem JOIN part ON p_partkey = l_partkey) AS tested_on, trades, success_rate_pct, profitable_rate_pct, avg_return_pct, net_return_pct, profit_factor FROM ({equities.ORACLE_SQL['e2_summary']}) s JOIN defs USING (strategy_code)"
ORACLE_SQL["registry_untested"] = f"SELECT strategy_code, tickers, trades, net_return_pct, reasons FROM ({equities.ORACLE_SQL['e2_summary']}) WHERE regexp_matches(strategy_code, '_[45](_|$)')"

# refine_final: the recursion that stands beside the low verdicts, with the limits of a real run.
_FULL = [(n, t.replace(f"share >= {reports.LOW_GATE['overlap']}", f"share >= {reports.GATE['overlap']}")) for n, t in derivatives._WALK]
ORACLE_SQL["refine_final"] = derivatives.oracle(derivatives._E4 + derivatives._PAIRS + reports.refine_steps() + _FULL, "SELECT c.* FROM candidates c JOIN turns w ON w.template = c.template AND w.itemset = c.itemset WHERE w.duplicate_of IS NULL", True)
