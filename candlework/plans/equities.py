"""Queries of the ranking and the strategy grid."""

from __future__ import annotations

from candlework.functions.sql import chain, in_duckdb
from candlework.operators import strategies as st
from candlework.sources import bars

BARS = [("bars", bars.PRICE_SQL)]


def oracle(steps, final: str) -> str:
    return in_duckdb(chain(BARS + steps, final))


def _registry(final: str) -> str:
    return oracle(st.trade_steps(st.grid()) + st.summary_steps(), final)


ENTRY = "strategy_code, CASE WHEN reasons = '' THEN 'approved' ELSE 'rejected' END AS status, reasons, trades"
ADJ_FINAL = "SELECT ticker, trade_date, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close FROM adj"


def adj_bars(spark, sf_dir):
    return st.run(spark, [st.ADJUSTED], ADJ_FINAL, bars=bars.price_bars(spark, sf_dir))


def _summary(spark, sf_dir, **how):
    return st.summarize(bars.price_bars(spark, sf_dir), **how)


def _entries(spark, sf_dir, levels, **how):
    return _summary(spark, sf_dir, definitions=st.grid(levels), **how).selectExpr("strategy_code", "CASE WHEN reasons = '' THEN 'approved' ELSE 'rejected' END AS status", "reasons", "trades")


def registry_merge(spark, sf_dir):
    """Levels 1 to 3 tested before under a laxer gate, 3 to 5 now: a new row wins."""
    lax = st.metrics.reasons(success=10.0, factor=0.5, average=-5.0, trades=10, positive=False)
    return st.merge_registry(_entries(spark, sf_dir, (1.0, 2.0, 3.0), gate=lax), _entries(spark, sf_dir, (3.0, 4.0, 5.0)))


def known_anti(spark, sf_dir):
    rows = lambda levels: st.run(spark, [("defs", st.values(st.grid(levels)))], "SELECT strategy_code, direction, threshold_pct FROM defs")
    return st.without_known(rows((1.0, 2.0, 3.0, 4.0, 5.0)), rows((2.0, 3.0)))


QUERIES = {
    "adj_bars": adj_bars,
    "e1_rank_down": lambda spark, d: st.rank(bars.price_bars(spark, d), -2.0),
    "e1_rank_up": lambda spark, d: st.rank(bars.price_bars(spark, d), 2.0, 0.0, "down"),
    "e2_trades": lambda spark, d: st.grid_trades(bars.price_bars(spark, d)),
    "e2_summary": lambda spark, d: _summary(spark, d),
    "e2_gate": lambda spark, d: _summary(spark, d, where=f"WHERE {st.GATE} = ''"),
    "e2_ticker_summary": lambda spark, d: _summary(spark, d, group="strategy_code, ticker", gate=st.TICKER_GATE),
    "e2_ticker_gate": lambda spark, d: _summary(spark, d, group="strategy_code, ticker", gate=st.TICKER_GATE, where=f"WHERE {st.TICKER_GATE} = ''"),
    "registry_merge": registry_merge,
    "known_anti": known_anti,
}

_GRID = st.trade_steps(st.grid())
_LAX = st.metrics.reasons(success=10.0, factor=0.5, average=-5.0, trades=10, positive=False)
ORACLE_SQL = {
    "adj_bars": oracle([st.ADJUSTED], ADJ_FINAL),
    "e1_rank_down": oracle(st.rank_steps(-2.0, 0.0), st.RANK_FINAL),
    "e1_rank_up": oracle(st.rank_steps(2.0, 0.0, "down"), st.RANK_FINAL),
    "e2_trades": oracle(_GRID, st.TRADES_FINAL),
    "e2_summary": oracle(_GRID + st.summary_steps(), f"SELECT *, {st.GATE} AS reasons FROM summary"),
    "e2_gate": oracle(_GRID + st.summary_steps(), f"SELECT *, {st.GATE} AS reasons FROM summary WHERE {st.GATE} = ''"),
    "e2_ticker_summary": oracle(_GRID + st.summary_steps("strategy_code, ticker"), f"SELECT *, {st.TICKER_GATE} AS reasons FROM summary"),
    "e2_ticker_gate": oracle(_GRID + st.summary_steps("strategy_code, ticker"), f"SELECT *, {st.TICKER_GATE} AS reasons FROM summary WHERE {st.TICKER_GATE} = ''"),
    "registry_merge": _registry(
        f"SELECT strategy_code, CASE WHEN reasons = '' THEN 'approved' ELSE 'rejected' END AS status, reasons, trades FROM (SELECT strategy_code, trades, CASE WHEN regexp_matches(strategy_code, '_[12](_|$)') THEN {_LAX} ELSE {st.GATE} END AS reasons FROM summary)"
    ),
    "known_anti": "WITH defs AS (" + st.values(st.grid()) + ") SELECT strategy_code, direction, threshold_pct FROM defs WHERE threshold_pct NOT IN (2.0, 3.0)",
}
