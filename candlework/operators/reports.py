"""Post-processing of strategy trades: train and test, significance, scores, filters, roll-ups, refinement.

Everything reads ``samples`` (template, ticker, trade_date, trade_return_pct, exit_reason, and what the filters name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from candlework.functions import metrics
from candlework.functions.sql import r
from candlework.operators import refinement

SPLIT = "1999-01-01"


def _metrics(name: str, group: str, where: str = "") -> tuple[str, str]:
    """Metrics with the reports' conventions: a profit factor of nothing is 0; Sharpe is 0 below two trades."""
    sharpe = "CASE WHEN count(*) > 1 AND round(stddev_pop(trade_return_pct), 9) > 0 THEN avg(trade_return_pct) / stddev_pop(trade_return_pct) ELSE 0e0 END"
    pf = metrics.profit_factor("gp", "gl", "0e0")
    inner = f"SELECT {group}, count(*) AS n, count(DISTINCT ticker) AS tickers, sum(CASE WHEN exit_reason = 'take_profit' THEN 1 ELSE 0 END) * 1e2 / count(*) AS tp, sum(CASE WHEN trade_return_pct > 0 THEN 1 ELSE 0 END) * 1e2 / count(*) AS win, sum(CASE WHEN exit_reason LIKE 'stop_loss%' THEN 1 ELSE 0 END) * 1e2 / count(*) AS sl_rate, avg(trade_return_pct) AS av, sum(trade_return_pct) AS net, stddev_pop(trade_return_pct) AS sd, {sharpe} AS sharpe, sum(CASE WHEN trade_return_pct > 0 THEN trade_return_pct ELSE 0 END) AS gp, sum(CASE WHEN trade_return_pct < 0 THEN -trade_return_pct ELSE 0 END) AS gl, sum(CASE WHEN trade_return_pct > 0 THEN 1 ELSE 0 END) AS wins FROM samples{where} GROUP BY {group}"
    return name, f"SELECT {group}, CAST(n AS BIGINT) AS n, CAST(tickers AS BIGINT) AS tickers, CAST(wins AS BIGINT) AS wins, {r('tp')} AS tp, {r('win')} AS win, {r('sl_rate')} AS sl_rate, {r('av')} AS av, {r('net')} AS net, {r('sd')} AS sd, {r('sharpe')} AS sharpe, {r('least(coalesce(' + pf + ', 9999e0), 9999e0)')} AS pf FROM ({inner})"


def _cdf(z: str) -> str:
    """The normal distribution by a five-term polynomial, clamped at 8 (fixed values)."""
    k = f"(1 / (1 + 0.2316419e0 * abs({z})))"
    tail = f"exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {k} * (0.319381530e0 + {k} * (-0.356563782e0 + {k} * (1.781477937e0 + {k} * (-1.821255978e0 + {k} * 1.330274429e0))))"
    return f"CASE WHEN {z} >= 8 THEN 1e0 WHEN {z} <= -8 THEN 0e0 WHEN {z} >= 0 THEN 1 - ({tail}) ELSE {tail} END"


def stat_steps(split: str = SPLIT):
    score = "3 * f.tp + 25 * f.av + 10 * least(f.pf, 8) + 5 * ln(greatest(f.n, 1)) + 2 * least(f.tickers, 50) + 3 * (0.5 * coalesce(t.tp, 0) + 20 * coalesce(t.av, 0)) + 15 * f.sharpe"
    return [
        _metrics("full_m", "template"),
        _metrics("train_m", "template", f" WHERE trade_date < DATE '{split}'"),
        _metrics("test_m", "template", f" WHERE trade_date >= DATE '{split}'"),
        _metrics("ticker_m", "template, ticker"),
        ("z", "SELECT template, n, CASE WHEN n < 5 THEN NULL ELSE (wins * 1e0 / n - 0.5e0) / sqrt(0.25e0 / n) END AS z_win, CASE WHEN n < 5 OR sd <= 0 THEN NULL ELSE av / (sd / sqrt(n)) END AS z_mean FROM full_m"),
        ("pvalues", f"SELECT template, n, {r('CASE WHEN z_win IS NULL THEN 1e0 ELSE 1 - (' + _cdf('z_win') + ') END')} AS p_win, {r('CASE WHEN z_mean IS NULL THEN 1e0 ELSE 1 - (' + _cdf('z_mean') + ') END')} AS p_mean FROM z"),
        ("scored", f"SELECT f.template, f.n, f.tickers, f.tp, f.win, f.sl_rate, f.av, f.net, f.pf, f.sharpe, t.n AS test_n, t.tp AS test_tp, t.av AS test_av, p.p_win, p.p_mean, {r(score)} AS score, split_part(f.template, '_', 2) AS direction, split_part(f.template, '_', 3) AS entry_rule FROM full_m f LEFT JOIN test_m t ON t.template = f.template JOIN pvalues p ON p.template = f.template"),
    ]


_LOG10 = "log10"
FINALS = {
    "stat_metrics": "SELECT f.*, a.n AS train_n, a.tp AS train_tp, a.av AS train_av, a.pf AS train_pf, b.n AS test_n, b.tp AS test_tp, b.av AS test_av, b.pf AS test_pf FROM full_m f LEFT JOIN train_m a ON a.template = f.template LEFT JOIN test_m b ON b.template = f.template",
    "stat_pvalues": "SELECT * FROM pvalues",
    "stat_score": "SELECT * FROM scored ORDER BY score DESC, template",
    "shortlist_dedup": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY direction, entry_rule ORDER BY score DESC, template) AS place FROM scored WHERE p_win < 0.9 AND n >= 200) WHERE place = 1",
    "elite": "SELECT template, score, test_av, tp FROM scored WHERE n >= 200 AND tickers >= 20 AND tp >= 20 AND win >= 40 AND test_tp >= 20 ORDER BY score DESC, test_av DESC, tp DESC",
    "block_score": f"SELECT template, {r(f'2.6 * tp + 1.7 * win + 18 * least(pf, 10) + 24 * av - 1.3 * sl_rate + 14 * {_LOG10}(greatest(n, 1)) + 10 * {_LOG10}(greatest(tickers, 1))')} AS block_score FROM scored ORDER BY block_score DESC, template LIMIT 100",
    "block_frequency": "SELECT entry_rule, direction, CAST(count(*) AS BIGINT) AS strategies FROM scored GROUP BY entry_rule, direction",
    "high_accuracy": "SELECT m.template, m.ticker, m.n, m.tp, m.win, m.av, m.pf FROM ticker_m m JOIN scored s ON s.template = m.template WHERE s.win >= 40 AND m.n >= 15 AND m.win >= 45",
    "actions_rollup": f"SELECT ticker, CAST(count(*) AS BIGINT) AS strategies_count, CAST(sum(n) AS BIGINT) AS trades, {r('avg(av)')} AS average_of_averages, max(pf) AS best_pf, min(CASE WHEN best = 1 THEN template END) AS best_template FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY pf DESC, template) AS best FROM ticker_m WHERE n >= 12) GROUP BY ticker",
    "per_stock": f"SELECT ticker, template, n, tp, win, av, pf, {r('3 * tp + 25 * av + 10 * least(pf, 8) + 5 * ln(n) + 15 * sharpe')} AS score FROM ticker_m WHERE n >= 20 AND win >= 45 AND av >= 0",
    "operational_filter": "SELECT s.template, s.n, CAST(count(*) AS BIGINT) AS qualified_tickers, CAST(sum(m.n) AS BIGINT) AS qualified_trades FROM scored s JOIN ticker_m m ON m.template = s.template WHERE s.n >= 300 AND m.n >= 15 AND m.net > 0 AND m.win >= 40 GROUP BY s.template, s.n HAVING count(*) >= 3",
    "free_report": "SELECT template, n, tickers, win, av, pf, CASE WHEN n >= 300 AND tickers >= 20 THEN 'robust' WHEN win >= 50 THEN 'aggressive' ELSE 'strict' END AS tier FROM scored WHERE n >= 80 AND tickers >= 8 AND win >= 40",
    "target_hit": "SELECT template, n, tp, tp >= 18 AS flagged FROM scored UNION ALL SELECT template || '@' || ticker, n, tp, n >= 15 AND tp >= 20 FROM ticker_m",
    "temporal_validation": f"SELECT b.template, b.n AS test_n, b.win AS test_win, b.av AS test_av, f.n AS full_n, f.win AS full_win, {r('b.av - f.av')} AS drift FROM test_m b LEFT JOIN full_m f ON f.template = b.template",
    "tier_elite": "SELECT ticker, CAST(count(*) AS BIGINT) AS patterns, CAST(sum(n) AS BIGINT) AS trades FROM ticker_m WHERE n >= 15 AND win >= 45 AND net > 0 GROUP BY ticker",
    "list_report": "SELECT template, n, tickers, win, av, pf FROM scored WHERE win >= 40 AND n >= 80 AND tickers >= 8",
}


# Refinement of mined patterns: uplift over the baseline, train and validation, months, overlap.

#: Thresholds of a refinement on the synthetic tables; the defaults of real runs are in GATE.
GATE = {"avg_uplift": 1.0, "pf_uplift": 0.2, "trades": 300, "tickers": 30, "train": 150, "val": 40, "pf": 1.10, "months": 6, "months_ratio": 0.55, "val_months": 2, "val_ratio": 0.5, "overlap": 0.85}
LOW_GATE = {"avg_uplift": 0.0, "pf_uplift": 0.0, "trades": 20, "tickers": 5, "train": 10, "val": 3, "pf": 1.0, "months": 6, "months_ratio": 0.2, "val_months": 2, "val_ratio": 0.2, "overlap": 0.5}
TEST_GATE = GATE | {"avg_uplift": 0.5, "pf_uplift": 0.05, "trades": 60, "tickers": 10, "train": 20, "val": 10}


def refine_steps(gate: dict = TEST_GATE, split: str = SPLIT):
    """From ``sets`` (two-state itemsets) and ``samples`` to ``refined``: metrics, reasons and the robustness score."""
    pf = lambda p: metrics.profit_factor(f"{p}gp", f"{p}gl")
    x = "CAST(trade_return_pct AS DECIMAL(18, 9))"  # returns have nine digits: their sums are exact in any order
    total = lambda what: f"CAST(sum({what}) AS DOUBLE)"
    gp, gl = total(f"CASE WHEN trade_return_pct > 0 AND {{w}} THEN {x} ELSE 0 END"), total(f"CASE WHEN trade_return_pct < 0 AND {{w}} THEN -{x} ELSE 0 END")
    val, train = f"trade_date >= DATE '{split}'", f"trade_date < DATE '{split}'"
    g = gate
    strong = lambda x: f"coalesce({x}, 0) < {g['pf']}"
    tests = [(f"avg_uplift < {g['avg_uplift']}", "avg_uplift"), (f"coalesce(pf_uplift, 0) < {g['pf_uplift']}", "pf_uplift"), (f"n < {g['trades']}", "trades"), (f"tickers < {g['tickers']}", "tickers"), (f"train_n < {g['train']}", "train_trades"), (f"val_n < {g['val']}", "validation_trades"), (strong("train_pf"), "train_pf"), (strong("val_pf"), "validation_pf"), (f"months < {g['months']}", "months"), (f"positive_months * 1e0 / months < {g['months_ratio']}", "positive_months"), (f"val_months < {g['val_months']}", "validation_months"), (f"val_positive * 1e0 / nullif(val_months, 0) < {g['val_ratio']}", "validation_positive_months")]
    # the robustness is of six-digit numbers and can end in a five: a nudge lets such a tie go up in any engine
    why = "concat_ws(';', " + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for t, n in tests) + ")"
    return [
        ("baseline", f"SELECT template, CAST(count(*) AS BIGINT) AS base_n, {r(total(x) + ' / count(*)')} AS base_avg, {r(metrics.profit_factor(gp.format(w='true'), gl.format(w='true')))} AS base_pf, min(trade_date) AS first_date, max(trade_date) AS last_date FROM samples GROUP BY template"),
        ("pattern_trades", "SELECT s.template, g.itemset, s.ticker, s.trade_date, s.option_symbol, s.trade_return_pct FROM sets g JOIN samples s ON s.ticker = g.ticker AND s.trade_date = g.trade_date AND s.entry_rule = g.entry_rule"),
        ("split_raw", f"SELECT template, itemset, count(*) AS n, count(DISTINCT ticker) AS tickers, {total(x)} / count(*) AS av, {total(x)} AS net, {gp.format(w='true')} AS gp, {gl.format(w='true')} AS gl, sum(CASE WHEN {train} THEN 1 ELSE 0 END) AS train_n, {gp.format(w=train)} AS train_gp, {gl.format(w=train)} AS train_gl, sum(CASE WHEN {val} THEN 1 ELSE 0 END) AS val_n, {gp.format(w=val)} AS val_gp, {gl.format(w=val)} AS val_gl, {total(f'CASE WHEN {val} THEN {x} END')} / nullif(sum(CASE WHEN {val} THEN 1 ELSE 0 END), 0) AS val_av, {total(f'CASE WHEN {val} THEN {x} ELSE 0 END')} AS val_net FROM pattern_trades GROUP BY template, itemset"),
        ("split", f"SELECT template, itemset, CAST(n AS BIGINT) AS n, CAST(tickers AS BIGINT) AS tickers, {r('av')} AS av, {r('net')} AS net, {r(pf(''))} AS pf, CAST(train_n AS BIGINT) AS train_n, {r(pf('train_'))} AS train_pf, CAST(val_n AS BIGINT) AS val_n, {r(pf('val_'))} AS val_pf, {r('val_av')} AS val_av, {r('val_net')} AS val_net FROM split_raw"),
        ("by_month", f"SELECT template, itemset, extract(year FROM trade_date) * 100 + extract(month FROM trade_date) AS month, {total(x)} AS net, max(CASE WHEN {val} THEN 1 ELSE 0 END) AS late FROM pattern_trades GROUP BY template, itemset, extract(year FROM trade_date) * 100 + extract(month FROM trade_date)"),
        ("monthly", "SELECT template, itemset, CAST(count(*) AS BIGINT) AS months, CAST(sum(CASE WHEN net > 0 THEN 1 ELSE 0 END) AS BIGINT) AS positive_months, CAST(sum(late) AS BIGINT) AS val_months, CAST(sum(CASE WHEN net > 0 THEN late ELSE 0 END) AS BIGINT) AS val_positive FROM by_month GROUP BY template, itemset"),
        ("lifted", f"SELECT s.*, m.months, m.positive_months, m.val_months, m.val_positive, {r('s.av - b.base_avg')} AS avg_uplift, {r('s.pf - b.base_pf')} AS pf_uplift FROM split s JOIN monthly m ON m.template = s.template AND m.itemset = s.itemset LEFT JOIN baseline b ON b.template = s.template"),
        ("refined", f"SELECT *, {why} AS reasons, {r('5 * avg_uplift + 20 * coalesce(pf_uplift, 0) + 3 * coalesce(val_av, 0) + 10 * coalesce(val_positive * 1e0 / nullif(val_months, 0), 0) + net / greatest(n, 1) + 1e-9')} AS robustness, CASE WHEN avg_uplift >= 1 AND pf_uplift >= 0.2 THEN 'specific' ELSE 'broad' END AS bucket FROM lifted"),
        ("candidates", "SELECT * FROM refined WHERE reasons = ''"),
        ("keys", "SELECT DISTINCT t.template, t.itemset, t.ticker, t.trade_date, t.option_symbol FROM pattern_trades t JOIN candidates c ON c.template = t.template AND c.itemset = t.itemset"),
        ("key_counts", "SELECT template, itemset, count(*) AS n FROM keys GROUP BY template, itemset"),
        ("meet", "SELECT a.template, a.itemset AS first_set, b.itemset AS second_set, count(*) AS common FROM keys a JOIN keys b ON a.template = b.template AND a.ticker = b.ticker AND a.trade_date = b.trade_date AND coalesce(a.option_symbol, '') = coalesce(b.option_symbol, '') WHERE a.itemset < b.itemset GROUP BY a.template, a.itemset, b.itemset"),
        ("overlap", f"SELECT m.template, first_set, second_set, CAST(common AS BIGINT) AS common, {r('common * 1e0 / least(x.n, y.n)')} AS share FROM meet m JOIN key_counts x ON x.template = m.template AND x.itemset = first_set JOIN key_counts y ON y.template = m.template AND y.itemset = second_set"),
    ]


def greedy(candidates: DataFrame, overlap: DataFrame, share: float = GATE["overlap"]) -> DataFrame:
    """Candidates that stay (see refinement.verdicts)."""
    return refinement.verdicts(candidates, overlap, share).where("duplicate_of IS NULL").drop("duplicate_of")


# Monitor: which strategies fire on each ticker's latest bar.


def monitor_steps(states: list[tuple[str, str]], top: int = 40):
    """From ``valued`` and ``summary`` (two-state itemsets) to ``fired``: all conditions of a strategy hold."""
    return [
        *states,
        ("chosen", f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY avg_return_pct DESC, template, itemset) AS place FROM summary WHERE trades >= 30 AND profitable_rate_pct >= 45) WHERE place <= {top}"),
        ("conditions", "SELECT template, itemset, CAST(itemset % 1024 - 1 AS INT) AS item FROM chosen UNION ALL SELECT template, itemset, CAST(floor(itemset / 1024e0) % 1024 - 1 AS INT) AS item FROM chosen"),
        ("fired", "SELECT c.template, c.itemset, l.ticker, l.trade_date FROM latest_items l JOIN conditions c ON c.item = l.item JOIN chosen k ON k.template = c.template AND k.itemset = c.itemset WHERE k.template LIKE '%_' || l.entry_rule || '_%' GROUP BY c.template, c.itemset, l.ticker, l.trade_date HAVING count(*) = 2"),
        ("signals", f"SELECT f.template, f.itemset, f.ticker, f.trade_date, k.trades, k.avg_return_pct, k.profitable_rate_pct, k.profit_factor, {r('100 * k.avg_return_pct + 2 * k.profitable_rate_pct + 5 * least(coalesce(k.profit_factor, 20), 20) + 0.03 * k.trades + 25 * count(*) OVER (PARTITION BY f.ticker)')} AS score, CAST(count(*) OVER (PARTITION BY f.ticker) AS BIGINT) AS ticker_signals FROM fired f JOIN chosen k ON k.template = f.template AND k.itemset = f.itemset"),
    ]


MONITOR_FINALS = {
    "monitor_signals": "SELECT * FROM signals",
    "monitor_confluence": f"SELECT ticker, CAST(count(*) AS BIGINT) AS signals, {r('avg(avg_return_pct)')} AS avg_return_pct FROM signals GROUP BY ticker HAVING count(*) >= 3 ORDER BY signals DESC, ticker LIMIT 20",
    "monitor_best": "SELECT ticker, template, itemset, score FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY score DESC, template, itemset) AS place FROM signals) WHERE place = 1",
}
