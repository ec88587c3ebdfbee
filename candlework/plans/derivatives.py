"""Queries of the option engines, the reports, the refinement and the monitor."""

from __future__ import annotations

from functools import partial

from candlework.functions import ladders
from candlework.functions.sql import chain, in_duckdb, r, run
from candlework.operators import exits, features, mining, options, refinement, reports
from candlework.plans import assets
from candlework.sinks.spool import spool
from candlework.sources import bars

BOTH = [("bars", bars.SPOT_SQL), ("options", bars.OPTION_SQL)]


def oracle(steps, final: str, recursive: bool = False, first=BOTH) -> str:
    return in_duckdb(chain(first + steps, final, recursive))


def _options(steps, final, spark, d):
    return run(spark, steps, final, bars=bars.spot_bars(spark, d), options=bars.option_bars(spark, d))


QUERIES, ORACLE_SQL = {}, {}


def option_query(name: str, steps, final: str) -> None:
    QUERIES[name] = partial(_options, steps, final)
    ORACLE_SQL[name] = oracle(steps, final)


_ALL = options.trade_steps(options.grid())
option_query("preferred_root", options.preferred_steps(), "SELECT * FROM preferred")
option_query("opt_exit_asof", options.spot_steps(), "SELECT ticker, trade_date, exit0, exit1, exit7, exit15, exit30 FROM spot")
option_query("opt_atm_pick", options.spot_steps() + options.signal_steps(options.grid()) + options.PICK, f"SELECT strategy_code, ticker, trade_date, option_symbol, {r('entry_price', 9)} AS entry_price FROM picked")
for _name, _kind in (("gap", "gap"), ("close", "close_change"), ("cum", "cumulative_return"), ("ma", "moving_average_cross")):
    option_query(f"opt_{_name}_trades", options.trade_steps([s for s in options.grid() if s["setup_kind"] == _kind and s["exit_kind"] == "time"]), options.TRADES_FINAL)
option_query("opt_target_stop", options.trade_steps([s for s in options.grid() if s["exit_kind"] == "target_stop"]), options.TRADES_FINAL)
option_query("e3_summary", _ALL + options.SUMMARY, "SELECT * FROM summary")
option_query("e4_samples", options.discovery_steps(), "SELECT template, ticker, trade_date, option_symbol, trade_return_pct FROM samples")

# E4: the option engine's states and miner
_KEYS, _LADDER = list(features.OPTION_KEYS), features.option_ladder
_PLACES = [_KEYS.index(k) for k in features.OPTION_PAIRABLE]
_TEMPLATES = [t["template"] for t in options.templates()]


def _option_states(spark, d):
    spot = bars.spot_bars(spark, d)
    values = spool(features.values(spot, 25).where("entry_rule = 'open'"), "values")
    return mining.packed_states(values, _KEYS, _LADDER)


def e4_summary(spark, d):
    samples = options.discovery_samples(bars.spot_bars(spark, d), bars.option_bars(spark, d))
    rows = spool(mining.with_columns(_option_states(spark, d), samples, _TEMPLATES), "option-rows")
    rules = ["open"] * len(_TEMPLATES)
    both = [mining.aggregate_columns(rows, mining.itemsets(k, _PLACES), _TEMPLATES, rules) for k in (1, 2)]
    return mining.named(mining.finished(both[0].unionByName(both[1])), _KEYS, _LADDER)


_E4 = features.EMA_SQL + features.steps(25) + options.discovery_steps() + mining.packed_sql(_KEYS, _LADDER, where=" WHERE entry_rule = 'open'")
_SETS = [("fit", f"SELECT * FROM single WHERE item // 16 IN ({', '.join(map(str, _PLACES))})"), ("sets", "SELECT ticker, trade_date, entry_rule, CAST(item + 1 AS BIGINT) AS itemset FROM single UNION ALL SELECT a.ticker, a.trade_date, a.entry_rule, CAST(a.item + 1 + (b.item + 1) * 1024 AS BIGINT) FROM fit a JOIN fit b ON a.ticker = b.ticker AND a.trade_date = b.trade_date WHERE a.item < b.item")]


def _decoded() -> str:
    names = [(16 * i + s + 1, f"{k}={c}") for i, k in enumerate(_KEYS) for s, c in enumerate(ladders.codes(_LADDER(k)))]
    table = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in names) + ") AS v(i, name)"
    return f"SELECT template || '__' || CASE WHEN b.i IS NULL THEN '1f__' ELSE '2f__' END || a.name || coalesce('__' || b.name, '') AS pattern_code, CASE WHEN b.i IS NULL THEN 1 ELSE 2 END AS state_size, s.* EXCLUDE (itemset) FROM summary s JOIN ({table}) a ON a.i = itemset % 1024 LEFT JOIN ({table}) b ON b.i = itemset // 1024"


QUERIES["e4_summary"] = e4_summary
ORACLE_SQL["e4_summary"] = oracle(_E4 + _SETS + mining.SUMMARY_SQL, _decoded(), True)

# E5
_PAIRS = [("fit", _SETS[0][1]), ("sets", "SELECT a.ticker, a.trade_date, a.entry_rule, CAST(a.item + 1 + (b.item + 1) * 1024 AS BIGINT) AS itemset FROM fit a JOIN fit b ON a.ticker = b.ticker AND a.trade_date = b.trade_date WHERE a.item < b.item")]


def _refine_inputs(spark, d):
    sets = spool(_option_states(spark, d), "option-states")
    sets = sets.select("ticker", "trade_date", "entry_rule", mining.itemsets(2, _PLACES).alias("x")).selectExpr("ticker", "trade_date", "entry_rule", "explode(x) AS itemset")
    return {"sets": sets, "samples": spool(options.discovery_samples(bars.spot_bars(spark, d), bars.option_bars(spark, d)), "option-samples")}


def _refine(final, spark, d):
    return run(spark, reports.refine_steps(), final, **_refine_inputs(spark, d))


def refine_final(spark, d):
    inputs = _refine_inputs(spark, d)
    steps = reports.refine_steps()
    return reports.greedy(run(spark, steps, "SELECT * FROM candidates", **inputs), run(spark, steps, "SELECT * FROM overlap", **inputs))


for _name, _final in {"baseline": "SELECT * FROM baseline", "refine_split": "SELECT * FROM split", "refine_monthly": "SELECT * FROM monthly", "refine_gate": "SELECT * FROM refined", "refine_overlap": "SELECT * FROM overlap"}.items():
    QUERIES[_name] = partial(_refine, _final)
    ORACLE_SQL[_name] = oracle(_E4 + _PAIRS + reports.refine_steps(), _final, True)
QUERIES["refine_final"] = refine_final


def refine_low(what, spark, d):
    """The refinement behind limits that these tables can pass: overlaps, and which candidate stands for which."""
    steps = reports.refine_steps(reports.LOW_GATE)
    inputs = _refine_inputs(spark, d)
    inputs["pattern_trades"] = spool(run(spark, steps[1:2], "SELECT * FROM pattern_trades", **inputs), "pattern-trades")
    steps = steps[:1] + steps[2:]
    chosen = spool(run(spark, steps, "SELECT * FROM candidates", **inputs), "candidates")
    shared = run(spark, steps[steps.index(next(s for s in steps if s[0] == "keys")) :], "SELECT * FROM overlap", pattern_trades=inputs["pattern_trades"], candidates=chosen)
    if what == "overlap":
        return shared
    return refinement.verdicts(chosen, shared, reports.LOW_GATE["overlap"]).select("template", "itemset", "robustness", "val_net", "bucket", "duplicate_of")


# The oracle walks each template's candidates in order, one a round, with those that it kept so far.
_WALK = [
    ("near", f"SELECT template, first_set AS a, second_set AS b FROM overlap WHERE share >= {reports.LOW_GATE['overlap']} UNION ALL SELECT template, second_set, first_set FROM overlap WHERE share >= {reports.LOW_GATE['overlap']}"),
    ("near_of", "SELECT template, a, list(b) AS bs FROM near GROUP BY template, a"),
    ("queue", "SELECT c.template, c.itemset, coalesce(n.bs, []) AS bs, row_number() OVER (PARTITION BY c.template ORDER BY robustness DESC, val_net DESC, avg_uplift DESC, pf_uplift DESC NULLS LAST, itemset) AS place FROM candidates c LEFT JOIN near_of n ON n.template = c.template AND n.a = c.itemset"),
    ("turns", "SELECT template, itemset, place, [itemset] AS kept, CAST(NULL AS BIGINT) AS duplicate_of FROM queue WHERE place = 1 UNION ALL SELECT q.template, q.itemset, q.place, CASE WHEN len(list_filter(w.kept, lambda x: list_contains(q.bs, x))) = 0 THEN list_append(w.kept, q.itemset) ELSE w.kept END, list_filter(w.kept, lambda x: list_contains(q.bs, x))[1] FROM turns w JOIN queue q ON q.template = w.template AND q.place = w.place + 1"),
]
QUERIES |= {"refine_low_overlap": partial(refine_low, "overlap"), "refine_low_verdicts": partial(refine_low, "verdicts")}
_LOW = _E4 + _PAIRS + reports.refine_steps(reports.LOW_GATE)
ORACLE_SQL["refine_low_overlap"] = oracle(_LOW, "SELECT * FROM overlap", True)
ORACLE_SQL["refine_low_verdicts"] = oracle(_LOW + _WALK, "SELECT c.template, c.itemset, c.robustness, c.val_net, c.bucket, w.duplicate_of FROM candidates c JOIN turns w ON w.template = c.template AND w.itemset = c.itemset", True)

# Reports on the trades of all percent and ATR templates
_REPORTED = exits.percent_templates() + exits.atr_templates()


def _report(final, spark, d):
    return run(spark, reports.stat_steps(), final, samples=spool(exits.samples(bars.spot_bars(spark, d), _REPORTED), "samples"))


for _name, _final in reports.FINALS.items():
    QUERIES[_name] = partial(_report, _final)
    ORACLE_SQL[_name] = oracle(exits.steps(_REPORTED) + reports.stat_steps(), _final)

# Exit grid: 24 target and stop pairs, long at the open, five bars
_GRID = exits.percent_templates(("open",), ("long",), tuple((float(t), float(s)) for t in (1, 2, 3, 4, 6, 8) for s in (1, 2, 3, 4)))
_GRID_FINAL = f"SELECT template, n, tickers, tp, win, av, pf, {r('2.5 * tp + 35 * av + 8 * least(pf, 8) - 1.2 * sl_rate')} AS variant_score FROM full_m"
QUERIES["exit_grid"] = lambda spark, d: run(spark, reports.stat_steps()[:1], _GRID_FINAL, samples=spool(exits.samples(bars.spot_bars(spark, d), _GRID), "samples"))
ORACLE_SQL["exit_grid"] = oracle(exits.steps(_GRID) + reports.stat_steps()[:1], _GRID_FINAL)

# Monitor


def _monitor(final, spark, d):
    rows = assets.mined_rows(spark, d)
    summary = assets._mined(2, spark, d, rows)
    states = spool(mining.packed_states(spool(features.values(bars.spot_bars(spark, d)), "values"), features.KEYS, features.LADDER.get), "states")
    latest = states.selectExpr("ticker", "trade_date", "entry_rule", "items", "max(trade_date) OVER (PARTITION BY ticker) AS newest").where("trade_date = newest").selectExpr("ticker", "trade_date", "entry_rule", "explode(items) AS item")
    return run(spark, reports.monitor_steps([]), final, summary=summary, latest_items=latest)


_LATEST = [("newest", "SELECT ticker, max(trade_date) AS trade_date FROM packed GROUP BY ticker"), ("latest_items", "SELECT s.* FROM single s JOIN newest n ON n.ticker = s.ticker AND n.trade_date = s.trade_date")]
for _name, _final in reports.MONITOR_FINALS.items():
    QUERIES[_name] = partial(_monitor, _final)
    ORACLE_SQL[_name] = in_duckdb(chain(assets.BARS + assets._BASE + assets._TWO + reports.monitor_steps(_LATEST), _final, True))
