"""Next-day trigger ranking and the strategy grid on adjusted bars."""

from __future__ import annotations

from pyspark.sql import DataFrame

from candlework.functions import metrics
from candlework.functions.sql import BY_BAR, r, run

#: Adjusted bars: all prices by adj_close / close (1 if close is 0). Needs ``bars``.
ADJUSTED = (
    "adj",
    "SELECT ticker, trade_date, open * f AS open, high * f AS high, low * f AS low, adj_close AS close FROM (SELECT *, CASE WHEN close = 0 THEN 1e0 ELSE adj_close / close END AS f FROM bars)",
)
NEIGHBOURS = (
    "near",
    f"SELECT *, lag(close) OVER ({BY_BAR}) AS pc, lead(close) OVER ({BY_BAR}) AS next_close, lead(trade_date) OVER ({BY_BAR}) AS next_date, count(*) OVER (PARTITION BY ticker) AS n_bars FROM adj",
)


def level(x: float) -> str:
    return f"{x:.1f}".rstrip("0").rstrip(".")


def grid(levels=(1.0, 2.0, 3.0, 4.0, 5.0), least: float = 0.0) -> list[dict]:
    """Ten setups per level."""
    out = []
    for t in levels:
        for trigger, word in (("down", "queda"), ("up", "alta")):
            for side in ("long", "short"):
                suffix = "reversao" if (trigger == "down") == (side == "long") else "continuacao"
                out.append((f"close_{word}_{level(t)}_{suffix}", "close_to_close", "close_change", trigger, t, side, 1))
            side = "long" if trigger == "down" else "short"
            out += [(f"intraday_{word}_{level(t)}_close_d{k}", "intraday_touch", "intraday_touch", trigger, t, side, k) for k in (0, 1)]
            out.append((f"gap_{'baixa' if trigger == 'down' else 'alta'}_{level(t)}_close_d0", "gap_open", "gap_open", trigger, t, side, 0))
    names = ("strategy_code", "family", "setup_kind", "trigger_direction", "threshold_pct", "direction", "exit_offset")
    return [dict(zip(names, x, strict=True), least=least) for x in out]


def values(rows: list[dict]) -> str:
    """A literal table of both dialects."""
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    names = list(rows[0])
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(lit(row[n]) for n in names) + ')' for row in rows)}) AS t({', '.join(names)})"


def rank_steps(trigger: float, target: float, mode: str = "auto", least: float = 0.0):
    """The ranking of tickers by what the day after a trigger brings."""
    up = mode == "up" or (mode == "auto" and target >= 0)
    hit = f"ret >= {target}" if up else f"ret <= {target}"
    fires = f"chg >= {trigger}" if trigger >= 0 else f"chg <= {trigger}"
    return [
        ADJUSTED,
        NEIGHBOURS,
        ("moves", f"SELECT ticker, {r('(close / nullif(pc, 0) - 1) * 100', 9)} AS chg, {r('(next_close / nullif(close, 0) - 1) * 100', 9)} AS ret FROM near WHERE pc IS NOT NULL AND next_close IS NOT NULL"),
        ("ranked", f"SELECT ticker, CAST(count(*) AS BIGINT) AS occurrences, CAST(sum(CASE WHEN {hit} THEN 1 ELSE 0 END) AS BIGINT) AS successful, {r(f'sum(CASE WHEN {hit} THEN 1 ELSE 0 END) * 1e2 / count(*)')} AS success_rate_pct, {r('avg(ret)')} AS avg_next_return_pct, {r('median(ret)')} AS median_next_return_pct FROM moves WHERE {fires} GROUP BY ticker"),
    ]


RANK_FINAL = "SELECT * FROM ranked ORDER BY success_rate_pct DESC, avg_next_return_pct DESC, occurrences DESC, ticker"


def rank(bars: DataFrame, trigger: float, target: float = 0.0, mode: str = "auto") -> DataFrame:
    return run(bars.sparkSession, rank_steps(trigger, target, mode), RANK_FINAL, bars=bars)


def trade_steps(definitions: list[dict]):
    """Every strategy on every bar. The trigger of a touch is its trigger price."""
    price = "CASE WHEN setup_kind = 'intraday_touch' THEN pc * (1 + CASE WHEN trigger_direction = 'down' THEN -threshold_pct ELSE threshold_pct END / 100) WHEN setup_kind = 'gap_open' THEN open ELSE close END"
    signed = "CASE WHEN trigger_direction = 'down' THEN -1e0 ELSE 1e0 END"
    seen = f"CASE WHEN setup_kind = 'intraday_touch' THEN {signed} * threshold_pct WHEN setup_kind = 'gap_open' THEN {r('(open / nullif(pc, 0) - 1) * 100', 9)} ELSE {r('(close / nullif(pc, 0) - 1) * 100', 9)} END"
    fires = f"CASE WHEN setup_kind = 'intraday_touch' THEN (trigger_direction = 'down' AND low <= entry_price) OR (trigger_direction = 'up' AND high >= entry_price) ELSE {signed} * trigger_change_pct >= threshold_pct END"
    return [
        ADJUSTED,
        NEIGHBOURS,
        ("defs", values(definitions)),
        ("tried", f"SELECT d.*, n.*, {seen} AS trigger_change_pct, {price} AS entry_price, CASE WHEN exit_offset = 0 THEN close ELSE next_close END AS exit_price, CASE WHEN exit_offset = 0 THEN trade_date ELSE next_date END AS exit_date FROM near n CROSS JOIN defs d WHERE pc IS NOT NULL AND n_bars >= 2 + exit_offset"),
        ("trades", f"SELECT strategy_code, family, ticker, trade_date AS trigger_date, exit_date, direction, trigger_change_pct, entry_price, exit_price, least, (exit_price / nullif(entry_price, 0) - 1) * 100 AS asset_move_pct, {r('CASE WHEN direction = ' + chr(39) + 'short' + chr(39) + ' THEN -1 ELSE 1 END * (exit_price / nullif(entry_price, 0) - 1) * 100', 9)} AS trade_return_pct FROM tried WHERE exit_price IS NOT NULL AND {fires}"),
    ]


TRADES_FINAL = f"SELECT strategy_code, ticker, trigger_date, exit_date, direction, trigger_change_pct, {r('entry_price', 9)} AS entry_price, {r('exit_price', 9)} AS exit_price, trade_return_pct, trade_return_pct > 0 AS is_profitable, trade_return_pct >= least AS is_successful FROM trades"


def summary_steps(group: str = "strategy_code", least: float = 0.0):
    extra = "CAST(count(DISTINCT ticker) AS BIGINT) AS tickers, " if group == "strategy_code" else ""
    keep = "tickers, " if extra else ""
    return [
        ("raw", f"SELECT {group}, {extra}{metrics.sums(least=least)}, avg(asset_move_pct) AS avg_move, median(trade_return_pct) AS med, {metrics.cumulative()} AS cumulative FROM trades GROUP BY {group}"),
        ("summary", f"SELECT {group}, {keep}{metrics.finished()}, {r('avg_move')} AS avg_asset_move_pct, {r('med')} AS median_return_pct, {r('cumulative', 4)} AS cumulative_return_pct FROM raw"),
    ]


GATE = metrics.reasons(success=55.0, factor=1.0, average=0.10, trades=200)
TICKER_GATE = metrics.reasons(success=55.0, factor=1.0, average=0.5, trades=15)


def grid_trades(bars: DataFrame, definitions: list[dict] | None = None) -> DataFrame:
    return run(bars.sparkSession, trade_steps(definitions or grid()), TRADES_FINAL, bars=bars)


def summarize(bars: DataFrame, definitions: list[dict] | None = None, group: str = "strategy_code", where: str = "", gate: str = GATE) -> DataFrame:
    """Metrics per strategy (or strategy and ticker) with the gate's reasons; approved where they are empty."""
    return run(bars.sparkSession, trade_steps(definitions or grid()) + summary_steps(group), f"SELECT *, {gate} AS reasons FROM summary {where}", bars=bars)


def merge_registry(old: DataFrame, new: DataFrame) -> DataFrame:
    """The union of two registries; a new row replaces the old one of its code."""
    return old.join(new.select("strategy_code"), "strategy_code", "left_anti").unionByName(new)


def without_known(definitions: DataFrame, registry: DataFrame) -> DataFrame:
    return definitions.join(registry.select("strategy_code").distinct(), "strategy_code", "left_anti")
