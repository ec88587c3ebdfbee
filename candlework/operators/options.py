"""At-the-money option backtests: signals on the underlying, contract choice, timed and target/stop exits."""

from __future__ import annotations

from pyspark.sql import DataFrame

from candlework.functions import metrics
from candlework.functions.sql import BY_BAR, r, run
from candlework.operators.strategies import values

HOLDS = (0, 1, 7, 15, 30)


def grid(cost: float = 0.0) -> list[dict]:
    """The 136 strategies."""
    out: list[dict] = []

    def add(code, kind, trigger, threshold, side, dte, entry, hold, lookback=0, fast=0, slow=0, tp=None, sl=None):
        out.append({"strategy_code": code, "setup_kind": kind, "trigger_direction": trigger, "threshold_pct": threshold, "option_side": side, "dte": dte, "entry_rule": entry, "holding_days": hold, "lookback": lookback, "fast": fast, "slow": slow, "tp": float(tp or 0), "sl": float(sl or 0), "exit_kind": "target_stop" if tp else "time", "cost": cost})

    gaps = (("down", "baixa", "call"), ("up", "alta", "put"))
    for t in (1, 2):
        for dte in (7, 15):
            for trigger, word, side in gaps:
                add(f"opt_gap_{word}_{t}_{side}_atm_{dte}dte_d0", "gap", trigger, float(t), side, dte, "open", 0)
                for sl, tps in ((5, (1, 2, 3, 4, 5, 6)), (3, (6, 8, 10, 12)), (5, (8, 10, 12, 15))):
                    for tp in tps:
                        add(f"opt_gap_{word}_{t}_{side}_atm_{dte}dte_sl{sl}_tp{tp}", "gap", trigger, float(t), side, dte, "open", dte, tp=tp, sl=sl)
    for t in (2, 3):
        for dte in (15, 30):
            add(f"opt_close_queda_{t}_call_atm_{dte}dte_d1", "close_change", "down", float(t), "call", dte, "close", 1)
    for back, t, hold in ((2, 3, 7), (3, 5, 15), (5, 8, 30)):
        for trigger, word, side in (("down", "queda", "call"), ("up", "alta", "put")):
            add(f"opt_multi_{back}d_{word}_{t}_{side}_atm_{hold}dte_h{hold}", "cumulative_return", trigger, float(t), side, hold, "close", hold, lookback=back)
    for fast, slow, hold in ((5, 20, 7), (10, 20, 15), (20, 50, 30)):
        for trigger, word, side in (("up", "bull", "call"), ("down", "bear", "put")):
            add(f"opt_ma_{fast}x{slow}_{word}_{side}_atm_{hold}dte_h{hold}", "moving_average_cross", trigger, 0.0, side, hold, "close", hold, fast=fast, slow=slow)
    return out


#: The ticker with the largest volume stands for its root; ties go to the first by name.
PREFERRED = [
    ("volumes", "SELECT ticker, {root} AS root, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY ticker"),
    ("preferred", "SELECT root, ticker, volume FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY volume DESC, ticker) AS i FROM volumes) WHERE i = 1"),
]


def preferred_steps(root: str = "ticker"):
    return [(n, t.format(root=root)) for n, t in PREFERRED]


def spot_steps(root: str = "ticker"):
    """Underlying bars with all that signals look at, and the first bar at or after each holding time."""
    mas = ", ".join(f"CASE WHEN rn >= {n} THEN avg(close) OVER ({BY_BAR} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS ma{n}, CASE WHEN rn >= {n + 1} THEN avg(close) OVER ({BY_BAR} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END AS pma{n}" for n in (5, 10, 20, 50))
    lags = ", ".join(f"lag(close, {k}) OVER ({BY_BAR}) AS c{k}" for k in (1, 2, 3, 5))
    ahead = ", ".join(f"min(trade_date) OVER (PARTITION BY ticker ORDER BY day DESC RANGE BETWEEN UNBOUNDED PRECEDING AND {h} PRECEDING) AS exit{h}" for h in HOLDS)
    return preferred_steps(root) + [
        ("u0", f"SELECT p.root, b.ticker, trade_date, open, close, days_between(trade_date, DATE '1970-01-05') AS day, row_number() OVER (PARTITION BY b.ticker ORDER BY trade_date) AS rn FROM bars b JOIN preferred p ON p.ticker = b.ticker"),
        ("spot", f"SELECT *, {lags}, {mas}, {ahead} FROM u0"),
    ]


def _by(column: str, pairs) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN {x}" for k, x in pairs) + " END"


def signal_steps(strategies: list[dict], start: str | None = None, end: str | None = None):
    ma = [(n, f"ma{n}") for n in (5, 10, 20, 50)]
    pma = [(n, f"pma{n}") for n in (5, 10, 20, 50)]
    base = _by("lookback", [(k, f"c{k}") for k in (2, 3, 5)])
    fast, slow, pfast, pslow = _by("fast", ma), _by("slow", ma), _by("fast", pma), _by("slow", pma)
    pct = lambda a, b: r(f"(({a}) / CASE WHEN ({b}) > 0 THEN ({b}) END - 1) * 100", 9)
    chg = f"CASE setup_kind WHEN 'gap' THEN {pct('open', 'c1')} WHEN 'close_change' THEN {pct('close', 'c1')} WHEN 'cumulative_return' THEN {pct('close', base)} ELSE {pct(fast, slow)} END"
    prev = pct(pfast, pslow)
    fires = "CASE WHEN setup_kind = 'moving_average_cross' THEN (trigger_direction = 'up' AND prev <= 0 AND chg > 0) OR (trigger_direction = 'down' AND prev >= 0 AND chg < 0) WHEN trigger_direction = 'down' THEN chg <= -threshold_pct ELSE chg >= threshold_pct END"
    window = (f" AND trade_date >= DATE '{start}'" if start else "") + (f" AND exit_date <= DATE '{end}' AND days_between(DATE '{end}', trade_date) >= holding_days" if end else "")
    return [
        ("strategies", values(strategies)),
        ("s_all", f"SELECT spot.*, s.*, {chg} AS chg, CASE WHEN setup_kind = 'moving_average_cross' THEN {prev} END AS prev, CASE WHEN setup_kind = 'gap' THEN open ELSE close END AS spot_price, {_by('holding_days', [(h, f'exit{h}') for h in HOLDS])} AS planned FROM spot CROSS JOIN strategies s WHERE rn >= 2"),
        ("signals", f"SELECT strategy_code, option_side, dte, entry_rule, exit_kind, holding_days, tp, sl, cost, root, ticker, trade_date, exit_date, chg, spot_price FROM (SELECT *, planned AS exit_date FROM s_all) WHERE exit_date IS NOT NULL AND {fires}{window}"),
    ]


#: What a choice of contract turns on; many strategies share it, so each choice is made once.
CHOICE = ("root", "trade_date", "option_side", "dte", "entry_rule", "exit_date")
#: The contract: nearest target DTE at or over it, nearest strike, most traded, first symbol.
PICK = [
    ("wanted", f"SELECT DISTINCT {', '.join(CHOICE)}, spot_price FROM signals"),
    (
        "eligible",
        f"SELECT w.*, o.option_symbol, o.expiration_date, CASE WHEN w.entry_rule = 'open' THEN o.open ELSE o.close END AS entry_price, row_number() OVER (PARTITION BY {', '.join('w.' + c for c in CHOICE)} ORDER BY days_between(o.expiration_date, o.trade_date) - w.dte, abs(o.strike_price - w.spot_price), o.trade_count DESC, o.volume DESC, o.option_symbol) AS place FROM wanted w JOIN options o ON o.underlying_root = w.root AND o.trade_date = w.trade_date AND o.option_side = w.option_side WHERE days_between(o.expiration_date, o.trade_date) >= w.dte AND o.expiration_date >= w.exit_date AND CASE WHEN w.entry_rule = 'open' THEN o.open ELSE o.close END > 0",
    ),
    ("best", f"SELECT {', '.join(CHOICE)}, option_symbol, expiration_date, entry_price FROM eligible WHERE place = 1"),
    ("picked", "SELECT g.*, b.option_symbol, b.expiration_date, b.entry_price FROM signals g JOIN best b ON " + " AND ".join(f"b.{c} = g.{c}" for c in CHOICE)),
]
#: Exits: a timed one needs the contract's bar on the exit day; target and stop walk its bars on days of the underlying.
#: A position's bars are walked once for all pairs of target and stop.
EXIT = [
    ("timed", "SELECT p.*, x.trade_date AS out_date, x.close AS exit_price, 'time_exit' AS exit_reason, (x.close / p.entry_price - 1) * 100 AS move FROM picked p JOIN options x ON x.option_symbol = p.option_symbol AND x.trade_date = p.exit_date WHERE p.exit_kind = 'time' AND x.close > 0"),
    ("pairs", "SELECT DISTINCT tp, sl FROM strategies WHERE exit_kind = 'target_stop'"),
    ("positions", "SELECT DISTINCT root, trade_date, entry_rule, exit_date, option_symbol, entry_price FROM picked WHERE exit_kind = 'target_stop'"),
    ("path", "SELECT p.root, p.trade_date, p.entry_rule, p.exit_date, p.option_symbol, p.entry_price, x.trade_date AS seen, x.high, x.low, x.close FROM positions p JOIN options x ON x.option_symbol = p.option_symbol JOIN u0 ON u0.root = p.root AND u0.trade_date = x.trade_date WHERE x.trade_date <= p.exit_date AND (x.trade_date > p.trade_date OR (x.trade_date = p.trade_date AND p.entry_rule = 'open'))"),
    ("tested", "SELECT path.*, q.tp, q.sl, high >= entry_price * (1 + q.tp / 100) AS at_target, low <= entry_price * (1 - q.sl / 100) AS at_stop FROM path CROSS JOIN pairs q"),
    ("ended", "SELECT root, trade_date, entry_rule, exit_date, option_symbol, tp, sl, coalesce(min(CASE WHEN at_target OR at_stop THEN seen END), max(seen)) AS out_date, min_by(at_target, CASE WHEN at_target OR at_stop THEN seen END) AS at_target, min_by(at_stop, CASE WHEN at_target OR at_stop THEN seen END) AS at_stop, max_by(close, seen) AS last_close FROM tested GROUP BY root, trade_date, entry_rule, exit_date, option_symbol, tp, sl"),
    ("touched", "SELECT p.*, e.out_date, e.at_target, e.at_stop, e.last_close FROM picked p JOIN ended e ON e.root = p.root AND e.trade_date = p.trade_date AND e.entry_rule = p.entry_rule AND e.exit_date = p.exit_date AND e.option_symbol = p.option_symbol AND e.tp = p.tp AND e.sl = p.sl WHERE p.exit_kind = 'target_stop'"),
    (
        "trades",
        f"SELECT strategy_code, ticker, trade_date AS trigger_date, out_date AS exit_date, option_symbol, expiration_date, chg AS trigger_change_pct, entry_price, exit_price, exit_reason, {r('(exit_price / entry_price - 1) * 100 - cost', 9)} AS trade_return_pct, {r('move', 9)} AS asset_move_pct FROM (SELECT strategy_code, ticker, trade_date, out_date, option_symbol, expiration_date, chg, entry_price, exit_price, exit_reason, cost, move FROM timed UNION ALL SELECT strategy_code, ticker, trade_date, out_date, option_symbol, expiration_date, chg, entry_price, CASE WHEN at_stop THEN entry_price * (1 - sl / 100) WHEN at_target THEN entry_price * (1 + tp / 100) ELSE last_close END, CASE WHEN at_stop AND at_target THEN 'stop_loss_conflict' WHEN at_target THEN 'take_profit' WHEN at_stop THEN 'stop_loss' ELSE 'time_stop' END, cost, CASE WHEN at_stop THEN -sl WHEN at_target THEN tp ELSE (last_close / entry_price - 1) * 100 END FROM touched)",
    ),
]
TRADES_FINAL = f"SELECT strategy_code, ticker, trigger_date, exit_date, option_symbol, exit_reason, {r('entry_price', 9)} AS entry_price, {r('exit_price', 9)} AS exit_price, trade_return_pct FROM trades"


def trade_steps(strategies: list[dict], start: str | None = None, end: str | None = None, root: str = "ticker"):
    return spot_steps(root) + signal_steps(strategies, start, end) + PICK + EXIT


def trades(bars: DataFrame, options: DataFrame, strategies: list[dict] | None = None, start: str | None = None, end: str | None = None, root: str = "ticker", final: str = TRADES_FINAL) -> DataFrame:
    return run(bars.sparkSession, trade_steps(strategies or grid(), start, end, root), final, bars=bars, options=options)


def templates(dtes=(7, 15, 30), cost: float = 0.0) -> list[dict]:
    return [{"template": f"disc_{side}_atm_{dte}dte_d0", "option_side": side, "dte": dte, "cost": cost} for dte in dtes for side in ("call", "put")]


def discovery_steps(definitions: list[dict] | None = None, root: str = "ticker"):
    """From bars and options to ``samples``: one at-the-money contract per bar and template, open to close."""
    return preferred_steps(root) + [
        ("d_templates", values(definitions or templates())),
        (
            "d_eligible",
            "SELECT t.template, t.cost, b.ticker, b.trade_date, o.option_symbol, o.open AS entry_price, o.close AS exit_price, row_number() OVER (PARTITION BY t.template, b.ticker, b.trade_date ORDER BY days_between(o.expiration_date, o.trade_date) - t.dte, abs(o.strike_price - b.open), o.trade_count DESC, o.volume DESC, o.option_symbol) AS place FROM bars b JOIN preferred p ON p.ticker = b.ticker JOIN options o ON o.underlying_root = p.root AND o.trade_date = b.trade_date JOIN d_templates t ON t.option_side = o.option_side WHERE days_between(o.expiration_date, o.trade_date) >= t.dte AND o.open > 0 AND o.close > 0 AND b.open > 0",
        ),
        ("samples", f"SELECT template, 'open' AS entry_rule, ticker, trade_date, option_symbol, 'd0_close' AS exit_reason, entry_price, exit_price, {r('(exit_price / entry_price - 1) * 100 - cost', 9)} AS trade_return_pct FROM d_eligible WHERE place = 1"),
    ]


def discovery_samples(bars: DataFrame, options: DataFrame, definitions: list[dict] | None = None, final: str = "SELECT * FROM samples") -> DataFrame:
    return run(bars.sparkSession, discovery_steps(definitions), final, bars=bars, options=options)


SUMMARY = [
    ("raw", f"SELECT strategy_code, CAST(count(DISTINCT ticker) AS BIGINT) AS tickers, {metrics.sums()}, avg(asset_move_pct) AS avg_move, median(trade_return_pct) AS med FROM trades GROUP BY strategy_code"),
    ("summary", f"SELECT strategy_code, tickers, {metrics.finished()}, {r('avg_move')} AS avg_asset_move_pct, {r('med')} AS median_return_pct FROM raw"),
]
