"""The trade metrics aggregate, and gates that give their reasons."""

from __future__ import annotations

from candlework.functions.sql import r

#: Raw sums of a group of trades; all are algebraic, so they combine map side. ``{x}`` is the return in percent.
SUMS = (
    ("trades", "count(*)"),
    ("profitable", "sum(CASE WHEN {x} > 0 THEN 1 ELSE 0 END)"),
    ("successful", "sum(CASE WHEN {x} >= {least} THEN 1 ELSE 0 END)"),
    ("net", "sum({x})"),
    ("gross_profit", "sum(CASE WHEN {x} > 0 THEN {x} ELSE 0 END)"),
    ("gross_loss", "sum(CASE WHEN {x} < 0 THEN -{x} ELSE 0 END)"),
)
EXITS = (
    ("take_profits", "sum(CASE WHEN exit_reason = 'take_profit' THEN 1 ELSE 0 END)"),
    ("stop_losses", "sum(CASE WHEN exit_reason LIKE 'stop_loss%' THEN 1 ELSE 0 END)"),
    ("time_caps", "sum(CASE WHEN exit_reason = 'time_cap' THEN 1 ELSE 0 END)"),
)


def profit_factor(profit: str = "gross_profit", loss: str = "gross_loss", empty: str = "NULL") -> str:
    """Profit over loss; null where there is no loss (see pf_is_inf). ``empty``: neither; the reports take 0."""
    return f"CASE WHEN {loss} > 0 THEN {profit} / {loss} WHEN {profit} > 0 THEN NULL ELSE {empty} END"


def cumulative(x: str = "trade_return_pct") -> str:
    """Compounded return, a plain product (it may turn negative), from algebraic sums."""
    m = f"(1 + {x} / 100)"
    sign = f"CASE WHEN sum(CASE WHEN {m} < 0 THEN 1 ELSE 0 END) % 2 = 1 THEN -1 ELSE 1 END"
    return f"(CASE WHEN sum(CASE WHEN {m} = 0 THEN 1 ELSE 0 END) > 0 THEN -1 ELSE {sign} * exp(sum(CASE WHEN {m} <> 0 THEN ln(abs({m})) ELSE 0 END)) - 1 END * 100)"


def clamped_cumulative(x: str = "trade_return_pct") -> str:
    """Compounded return, -100 once a trade loses everything."""
    m = f"(1 + {x} / 100)"
    return f"(CASE WHEN min({m}) <= 0 THEN -1 ELSE exp(sum(CASE WHEN {m} > 0 THEN ln({m}) ELSE 0 END)) - 1 END * 100)"


def sums(x: str = "trade_return_pct", least: float = 0.0, exits: bool = False) -> str:
    return ", ".join(f"CAST({text.format(x=x, least=least)} AS {'DOUBLE' if name in ('net', 'gross_profit', 'gross_loss') else 'BIGINT'}) AS {name}" for name, text in SUMS + (EXITS if exits else ()))


def finished(exits: bool = False, empty: str = "NULL") -> str:
    """Rates from the raw sums."""
    rates = [("successful", "success_rate_pct"), ("profitable", "profitable_rate_pct")] + ([("take_profits", "take_profit_rate_pct"), ("stop_losses", "stop_loss_rate_pct"), ("time_caps", "time_cap_rate_pct")] if exits else [])
    out = ["trades", "profitable", "successful"] + (["take_profits", "stop_losses", "time_caps"] if exits else [])
    out += [f"{r(f'{n} * 1e2 / trades')} AS {name}" for n, name in rates]
    out += [f"{r('net / trades')} AS avg_return_pct", f"{r('net')} AS net_return_pct", f"{r(profit_factor(empty=empty))} AS profit_factor", "(gross_loss = 0 AND gross_profit > 0) AS pf_is_inf"]
    return ", ".join(out)


def reasons(success: float = 0.0, factor: float = 1.0, average: float = 0.0, trades: int = 1, tickers: int | None = None, take_profit: float | None = None, positive: bool = True) -> str:
    """Why a summary fails its gate, joined by ';'. Empty: approved. No loss passes the factor, no trade result fails it."""
    tests = [(f"success_rate_pct < {success}", f"success_rate<{success:.2f}"), (f"NOT pf_is_inf AND coalesce(profit_factor, -1) < {factor}", f"profit_factor<{factor:.2f}"), (f"avg_return_pct < {average}", f"average_return<{average:.2f}"), (f"trades < {trades}", f"trades<{trades}")]
    if take_profit is not None:
        tests.append((f"take_profit_rate_pct < {take_profit}", f"take_profit_rate<{take_profit:.2f}"))
    if tickers is not None:
        tests.append((f"tickers < {tickers}", f"tickers<{tickers}"))
    if positive:
        tests.append(("net_return_pct <= 0", "net<=0"))
    return "concat_ws(';', " + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for test, name in tests) + ")"
