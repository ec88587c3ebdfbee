"""Queries of the asset features, exits and itemset miner."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from candlework.functions import metrics
from candlework.functions.sql import chain, in_duckdb, r
from candlework.operators import counting, exits, features, mining
from candlework.sinks.spool import spool
from candlework.sources import bars

BARS = [("bars", bars.SPOT_SQL)]
#: Templates of the mining queries: both entries and directions, target 2 and stop 1, five bars.
TEMPLATES = exits.percent_templates(pairs=((2.0, 1.0),))
NAMES, RULES = [t["template"] for t in TEMPLATES], [t["entry"] for t in TEMPLATES]
PLACES = [features.KEYS.index(k) for k in features.PAIRABLE]
TOP_PAIRS = 5
#: Gates of promoted pairs: a few pairs behind looser ones, and the miner's own defaults.
FEW = {"trades": 20, "win": 50.0, "factor": 1.0, "most": TOP_PAIRS}
DEFAULT = {"trades": mining.PRE_TRADES, "win": mining.PRE_WIN, "factor": mining.PRE_FACTOR, "most": mining.PRE_PAIRS}
GATE = metrics.reasons(success=0.0, factor=1.10, average=0.0, trades=80, tickers=8, take_profit=0.0)


def oracle(steps, final: str, recursive: bool = True) -> str:
    return in_duckdb(chain(BARS + steps, final, recursive))


def _feature(key, option, spark, sf_dir):
    return features.state_counts(bars.spot_bars(spark, sf_dir), key, option)


def _exits(templates, spark, sf_dir):
    return exits.samples(bars.spot_bars(spark, sf_dir), templates).selectExpr(*[x for x in ("template", "ticker", "trade_date", "exit_date", "exit_reason", f"{r('entry_price', 9)} AS entry_price", f"{r('exit_price', 9)} AS exit_price", f"trade_return_pct")])


def mined_rows(spark, sf_dir, templates=None):
    spot = spool(bars.spot_bars(spark, sf_dir), "bars")
    states = mining.packed_states(spool(features.values(spot), "values"), features.KEYS, features.LADDER.get)
    templates = templates or TEMPLATES
    traded = exits.samples(spot, templates, tasks=counting.tasks(spark, spot.count() * len(templates) // 8))
    return spool(mining.with_outcomes(states, spool(traded, "samples"), [t["template"] for t in templates]), "mined")


def _mined(size, spark, sf_dir, rows=None):
    rows = mined_rows(spark, sf_dir) if rows is None else rows
    return mining.finished(mining.aggregate(rows, size, PLACES, NAMES, RULES))


def promoted(spark, sf_dir):
    return mining.promoted_pairs(_mined(2, spark, sf_dir)).withColumn("score", F.round("score", 6))


def three(gates, spark, sf_dir):
    rows = mined_rows(spark, sf_dir)
    best = mining.promoted_pairs(_mined(2, spark, sf_dir, rows), **gates)
    pairs = [(x.a, x.b) for x in best.collect()]  # bounded by most; shapes the next plan
    return mining.finished(mining.aggregate(rows, 3, PLACES, NAMES, RULES, pairs))


def summary(spark, sf_dir):
    rows = mined_rows(spark, sf_dir)
    both = _mined(1, spark, sf_dir, rows).unionByName(_mined(2, spark, sf_dir, rows))
    return mining.named(both, features.KEYS, features.LADDER.get)


QUERIES = {f"feat_{k}": partial(_feature, k, False) for k in features.KEYS}
QUERIES |= {f"ofeat_{k}": partial(_feature, k, True) for k in features.OPTION_KEYS}
ORACLE_SQL = {f"feat_{k}": oracle(features.EMA_SQL + features.STEPS, features.state_count_final(k)) for k in features.KEYS}
ORACLE_SQL |= {f"ofeat_{k}": oracle(features.EMA_SQL + features.steps(25), features.state_count_final(k, True)) for k in features.OPTION_KEYS}

for _d in ("long", "short"):
    for _e in ("open", "close"):
        _t = exits.percent_templates((_e,), (_d,))
        QUERIES[f"exits_percent_{_d}_{_e}"] = partial(_exits, _t)
        ORACLE_SQL[f"exits_percent_{_d}_{_e}"] = oracle(exits.steps(_t), exits.SAMPLES_FINAL, False)
for _e in ("open", "close"):
    _t = exits.atr_templates((_e,), ("long", "short"))
    QUERIES[f"exits_atr_{_e}"] = partial(_exits, _t)
    ORACLE_SQL[f"exits_atr_{_e}"] = oracle(exits.steps(_t), exits.SAMPLES_FINAL, False)

_BASE = features.EMA_SQL + features.STEPS + exits.steps(TEMPLATES) + mining.packed_sql(features.KEYS, features.LADDER.get)
_PROMOTED = "SELECT a, b, max(score) AS score FROM (SELECT CAST((itemset % 1024 - 1) // 16 AS INTEGER) AS a, CAST((itemset // 1024 % 1024 - 1) // 16 AS INTEGER) AS b, CASE WHEN pf_is_inf THEN 1e9 ELSE profitable_rate_pct + 10 * profit_factor END AS score FROM {source} WHERE trades >= {trades} AND profitable_rate_pct >= {win} AND (pf_is_inf OR profit_factor >= {factor})) GROUP BY a, b ORDER BY score DESC, a, b LIMIT {most}"
_TWO = mining.itemsets_sql(2, PLACES) + mining.SUMMARY_SQL

QUERIES |= {
    "itemset_1f": partial(_mined, 1),
    "itemset_2f": partial(_mined, 2),
    "promoted_pairs": promoted,
    "itemset_3f_promoted": partial(three, FEW),
    "itemset_3f_default": partial(three, DEFAULT),
    "e6_summary": summary,
    "e6_gate": lambda spark, d: summary(spark, d).where(f"{GATE} = ''"),
}


def _rename(steps, suffix: str):
    """The same steps under other names, to stand beside themselves."""
    import re

    names = "|".join(n for n, _ in steps)
    return [(n + suffix, re.sub(rf"\b(FROM|JOIN) ({names})\b", rf"\g<1> \g<2>{suffix}", t)) for n, t in steps]


def _decoded(source: str) -> str:
    names = [(16 * i + s + 1, f"{k}={c}") for i, k in enumerate(features.KEYS) for s, c in enumerate(mining.ladders.codes(features.LADDER[k]))]
    table = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in names) + ") AS v(i, name)"
    return f"SELECT template || '__' || CASE WHEN b.i IS NULL THEN '1f__' ELSE '2f__' END || a.name || coalesce('__' || b.name, '') AS pattern_code, CASE WHEN b.i IS NULL THEN 1 ELSE 2 END AS state_size, s.* EXCLUDE (itemset) FROM {source} s JOIN ({table}) a ON a.i = itemset % 1024 LEFT JOIN ({table}) b ON b.i = itemset // 1024"


ORACLE_SQL |= {
    "itemset_1f": oracle(_BASE + mining.itemsets_sql(1, PLACES) + mining.SUMMARY_SQL, "SELECT * FROM summary"),
    "itemset_2f": oracle(_BASE + _TWO, "SELECT * FROM summary"),
    "promoted_pairs": oracle(_BASE + _TWO + [("best", _PROMOTED.format(source="summary", trades=50, win=55.0, factor=1.5, most=150))], "SELECT a, b, round(score, 6) AS score FROM best"),
    "itemset_3f_promoted": oracle(_BASE + _rename(_TWO, "2") + [("promoted", _PROMOTED.format(source="summary2", trades=20, win=50.0, factor=1.0, most=TOP_PAIRS))] + mining.itemsets_sql(3, PLACES) + mining.SUMMARY_SQL, "SELECT * FROM summary"),
}
ORACLE_SQL["itemset_3f_default"] = oracle(_BASE + _rename(_TWO, "2") + [("promoted", _PROMOTED.format(source="summary2", **DEFAULT))] + mining.itemsets_sql(3, PLACES) + mining.SUMMARY_SQL, "SELECT * FROM summary")
_BOTH = _BASE + _rename(mining.itemsets_sql(1, PLACES) + mining.SUMMARY_SQL, "1") + _TWO + [("both_sizes", "SELECT * FROM summary1 UNION ALL SELECT * FROM summary")]
ORACLE_SQL |= {"e6_summary": oracle(_BOTH, _decoded("both_sizes")), "e6_gate": oracle(_BOTH + [("decoded", _decoded("both_sizes"))], f"SELECT * FROM decoded WHERE {GATE} = ''")}
