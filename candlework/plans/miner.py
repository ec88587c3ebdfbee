"""The whole asset miner: 20 percent and 24 ATR templates, every accumulator, two states and three together.

Its DuckDB SQL has sums, gates and scores of its own; only features and exits are the steps of plans/assets.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from candlework.functions import metrics
from candlework.operators import exits, features, mining
from candlework.plans import assets

TEMPLATES = exits.percent_templates() + exits.atr_templates()
GATE = metrics.reasons(success=0.0, factor=1.10, average=0.0, trades=80, tickers=8, take_profit=0.0)


def sums(spark, d, sizes, templates, gates=None):
    """Complete measures of all itemsets of these sizes; three states grow from pairs that pass ``gates``."""
    names, rules = [t["template"] for t in templates], [t["entry"] for t in templates]
    rows, out, promoted = assets.mined_rows(spark, d, templates), None, None
    for size in sizes:
        raw = mining.aggregate(rows, size, assets.PLACES, names, rules, promoted)
        out = raw if out is None else out.unionByName(raw)
        if size == 2 and gates:
            best = mining.promoted_pairs(mining.finished(raw), **gates)
            promoted = [(x.a, x.b) for x in best.collect()]  # bounded by most; shapes the next plan
    return out.selectExpr(*mining.complete())


def single(spark, d):
    """One state, all 44 templates."""
    return sums(spark, d, (1,), TEMPLATES)


def gated(spark, d):
    """One and two states of all 44 templates: what passes the miner's gate, by template and features."""
    keys = [F.col("template"), *(F.expr(f"CAST(floor(((itemset div {1024**j}) % 1024 - 1) / 16e0) AS INT) AS f{j}") for j in (0, 1))]
    good = sums(spark, d, (1, 2), TEMPLATES).where(f"{GATE} = ''")
    exact = lambda c, digits: F.sum(F.col(c).cast(f"decimal(28,{digits})")).cast("double")
    rows = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("patterns"), F.sum("trades").alias("trades"), F.max("tickers").alias("tickers"), F.sum("take_profits").alias("take_profits"), F.sum("stop_losses").alias("stop_losses"), F.sum("time_caps").alias("time_caps"), exact("net_return_pct", 6).alias("net"), exact("growth_log", 6).alias("growth"), F.max("avg_return_pct").alias("best_avg"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))
    return rows


def progressive(spark, d):
    """One, two and three states together, three from promoted pairs; behind the miner's gate, named."""
    rows = sums(spark, d, (1, 2, 3), assets.TEMPLATES, assets.FEW).where(f"{GATE} = ''")
    return mining.named(rows, features.KEYS, features.LADDER.get)


QUERIES = {"mine_single": single, "mine_gated": gated, "mine_progressive": progressive}

_X = "CAST(trade_return_pct AS DECIMAL(18, 9))"
_TICKERS = "SELECT ticker, 1::BIGINT << CAST(row_number() OVER (ORDER BY ticker) - 1 AS BIGINT) AS bit FROM (SELECT DISTINCT ticker FROM bars)"


def _complete(sets: str, name: str) -> list[tuple[str, str]]:
    """Own sums: tickers as bits, returns as decimals, logs of ten digits as whole numbers."""
    return [
        (name + "0", f"SELECT s.template, x.itemset, bit_count(bit_or(b.bit)) AS tickers, count(*) AS trades, count(*) FILTER (WHERE trade_return_pct > 0) AS profitable, count(*) FILTER (WHERE trade_return_pct >= 0) AS successful, count(*) FILTER (WHERE exit_reason = 'take_profit') AS take_profits, count(*) FILTER (WHERE starts_with(exit_reason, 'stop_loss')) AS stop_losses, count(*) FILTER (WHERE exit_reason = 'time_cap') AS time_caps, sum({_X}) AS net, sum(greatest({_X}, 0)) AS gain, sum(s.lg) AS logs, count(*) FILTER (WHERE trade_return_pct <= -100) AS wiped, min(s.trade_date) AS first_date, max(s.trade_date) AS last_date FROM {sets} x JOIN logged s ON s.ticker = x.ticker AND s.trade_date = x.trade_date AND s.entry_rule = x.entry_rule JOIN ticker_bits b ON b.ticker = s.ticker GROUP BY s.template, x.itemset"),
        (
            name,
            "SELECT template, itemset, CAST(tickers AS BIGINT) AS tickers, trades, profitable, successful, take_profits, stop_losses, time_caps, "
            + ", ".join(f"round({n} * 100.0::DOUBLE / trades, 6) AS {rate}" for n, rate in (("successful", "success_rate_pct"), ("profitable", "profitable_rate_pct"), ("take_profits", "take_profit_rate_pct"), ("stop_losses", "stop_loss_rate_pct"), ("time_caps", "time_cap_rate_pct")))
            + ", round(CAST(net AS DOUBLE) / trades + 0e0, 6) AS avg_return_pct, round(CAST(net AS DOUBLE) + 1e-10, 6) AS net_return_pct, round(CASE WHEN gain > net THEN CAST(gain AS DOUBLE) / CAST(gain - net AS DOUBLE) END + 0e0, 6) AS profit_factor, gain = net AND gain > 0 AS pf_is_inf, "
            f"CASE WHEN wiped = 0 THEN round(logs / 1e10 + 0e0, 6) END AS growth_log, CASE WHEN wiped > 0 THEN -100e0 WHEN logs / 1e10 <= {mining.FOLDS} THEN round((exp(logs / 1e10) - 1) * 100 + 0e0, 1) END AS cumulative_return_pct, first_date, last_date FROM {name}0",
        ),
    ]


_LOGGED = [("logged", "SELECT *, CASE WHEN trade_return_pct > -100 THEN CAST(round(ln(1 + trade_return_pct / 100) * 1e10) AS BIGINT) ELSE 0 END AS lg FROM samples"), ("ticker_bits", _TICKERS)]
_PASSED = "success_rate_pct >= 0 AND (pf_is_inf OR coalesce(profit_factor, -1) >= 1.1) AND avg_return_pct >= 0 AND trades >= 80 AND take_profit_rate_pct >= 0 AND tickers >= 8 AND net_return_pct > 0"
_ROWS = features.EMA_SQL + features.STEPS + exits.steps(TEMPLATES) + mining.packed_sql(features.KEYS, features.LADDER.get) + _LOGGED
_ONE = assets._rename(mining.itemsets_sql(1, assets.PLACES), "1")
_EACH = ("sets12", "SELECT * FROM sets1 UNION ALL SELECT * FROM sets")
_THREE = mining.itemsets_sql(3, assets.PLACES)
ORACLE_SQL = {
    "mine_single": assets.oracle(_ROWS + _ONE + _complete("sets1", "whole"), "SELECT * FROM whole"),
    "mine_gated": assets.oracle(_ROWS + _ONE + mining.itemsets_sql(2, assets.PLACES) + [_EACH] + _complete("sets12", "whole"), f"SELECT template, CAST((itemset % 1024 - 1) // 16 AS INTEGER) AS f0, CAST(CASE WHEN itemset >= 1024 THEN (itemset // 1024 - 1) // 16 ELSE -1 END AS INTEGER) AS f1, count(*) AS patterns, CAST(sum(trades) AS BIGINT) AS trades, max(tickers) AS tickers, CAST(sum(take_profits) AS BIGINT) AS take_profits, CAST(sum(stop_losses) AS BIGINT) AS stop_losses, CAST(sum(time_caps) AS BIGINT) AS time_caps, CAST(sum(CAST(net_return_pct AS DECIMAL(28, 6))) AS DOUBLE) AS net, CAST(sum(CAST(growth_log AS DECIMAL(28, 6))) AS DOUBLE) AS growth, max(avg_return_pct) AS best_avg, min(first_date) AS first_date, max(last_date) AS last_date FROM whole WHERE {_PASSED} GROUP BY ALL"),
}
_FOUR = features.EMA_SQL + features.STEPS + exits.steps(assets.TEMPLATES) + mining.packed_sql(features.KEYS, features.LADDER.get) + _LOGGED
_GROW = [("promoted", f"SELECT a, b FROM (SELECT (itemset % 1024 - 1) // 16 AS a, (itemset // 1024 - 1) // 16 AS b, max(CASE WHEN pf_is_inf THEN 1e9 ELSE profitable_rate_pct + 10 * profit_factor END) AS score FROM pairs_whole WHERE trades >= 20 AND profitable_rate_pct >= 50 AND (pf_is_inf OR profit_factor >= 1) GROUP BY 1, 2) ORDER BY score DESC, a, b LIMIT {assets.TOP_PAIRS}")]
_NAMES = ", ".join(f"({16 * i + s + 1}, '{k}={c}')" for i, k in enumerate(features.KEYS) for s, c in enumerate(mining.ladders.codes(features.LADDER[k])))
ORACLE_SQL["mine_progressive"] = assets.oracle(
    _FOUR + _ONE + assets._rename(mining.itemsets_sql(2, assets.PLACES), "2") + _complete("sets2", "pairs_whole") + _GROW + _THREE + [("every", "SELECT * FROM sets1 UNION ALL SELECT * FROM sets")] + _complete("every", "others") + [("names", f"SELECT * FROM (VALUES {_NAMES}) AS v(i, name)"), ("all_sizes", "SELECT * FROM others UNION ALL SELECT * FROM pairs_whole")],
    f"SELECT s.* EXCLUDE (itemset), CASE WHEN b.i IS NULL THEN 1 WHEN c.i IS NULL THEN 2 ELSE 3 END AS state_size, template || '__' || CASE WHEN b.i IS NULL THEN '1f__' WHEN c.i IS NULL THEN '2f__' ELSE '3f__' END || concat_ws('__', a.name, b.name, c.name) AS pattern_code FROM all_sizes s JOIN names a ON a.i = itemset % 1024 LEFT JOIN names b ON b.i = itemset // 1024 % 1024 LEFT JOIN names c ON c.i = itemset // 1048576 WHERE {_PASSED}",
)
