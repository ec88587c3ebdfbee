"""First-touch exits: percent and ATR targets and stops with a time cap, long and short.

The bars ahead come from lead() over the one window that already sorts each ticker, so a path is a row and the
first touch is a chain of cases: no join and no arrays. A bar that touches both goes to the stop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from candlework.functions.sql import BY_BAR, r, run
from candlework.operators.strategies import level, values

CAP = 10


def percent_templates(entries=("open", "close"), directions=("long", "short"), pairs=((1.0, 1.0), (2.0, 1.0), (3.0, 1.5), (4.0, 2.0), (6.0, 3.0)), cap: int = 5, cost: float = 0.0) -> list[dict]:
    name = lambda x: level(x).replace(".", "_")
    return [{"template": f"asset_{d}_{e}_tp{name(t)}_sl{name(s)}_cap{cap}", "entry": e, "direction": d, "tp": t, "sl": s, "cap": cap, "mode": "percent", "cost": cost} for e in entries for d in directions for t, s in pairs]


def atr_templates(entries=("open", "close"), directions=("long",), pairs=((1.0, 1.0), (1.5, 1.0), (1.5, 1.5), (2.0, 1.0), (2.0, 1.5), (2.0, 2.0)), caps=(5, 10), cost: float = 0.0) -> list[dict]:
    name = lambda x: level(x).replace(".", "_")
    return [{"template": f"asset_{d}_{e}_atr_tp{name(t)}_sl{name(s)}_cap{cap}", "entry": e, "direction": d, "tp": t, "sl": s, "cap": cap, "mode": "atr", "cost": cost} for e in entries for d in directions for t, s in pairs for cap in caps]


def _touch() -> str:
    """4 * bar + outcome: 0 target, 1 stop, 2 both, 3 the cap; null if there is no bar."""
    cases = []
    for k in range(CAP + 1):
        on = f"cap >= {k}" + (" AND entry = 'open'" if k == 0 else "")
        target = f"((direction = 'long' AND h{k} >= target) OR (direction = 'short' AND l{k} <= target))"
        stop = f"((direction = 'long' AND l{k} <= stop) OR (direction = 'short' AND h{k} >= stop))"
        cases += [f"WHEN {on} AND {target} AND {stop} THEN {4 * k + 2}", f"WHEN {on} AND {stop} THEN {4 * k + 1}", f"WHEN {on} AND {target} THEN {4 * k}"]
    cases += [f"WHEN cap >= {k} AND c{k} IS NOT NULL" + (" AND entry = 'open'" if k == 0 else "") + f" THEN {4 * k + 3}" for k in range(CAP, -1, -1)]
    return "CASE " + " ".join(cases) + " END"


def _of(k: str, name: str) -> str:
    return f"CASE {k} " + " ".join(f"WHEN {i} THEN {name}{i}" for i in range(CAP + 1)) + " END"


def steps(templates: list[dict], start: str | None = None, end: str | None = None):
    """From ``bars`` to ``samples``: a row per entry bar and template. Dates bound entries only, not paths."""
    ahead = ", ".join(f"lead(high, {k}) OVER ({BY_BAR}) AS h{k}, lead(low, {k}) OVER ({BY_BAR}) AS l{k}, lead(close, {k}) OVER ({BY_BAR}) AS c{k}, lead(trade_date, {k}) OVER ({BY_BAR}) AS d{k}" for k in range(CAP + 1))
    dates = "".join(f" AND trade_date {op} DATE '{x}'" for op, x in ((">=", start), ("<=", end)) if x)
    tr = "CASE WHEN pc > 0 THEN greatest(high - low, abs(high - pc), abs(low - pc)) / pc * 100 ELSE 0e0 END"
    sign = "CASE WHEN direction = 'long' THEN 1 ELSE -1 END"
    return [
        ("x0", f"SELECT *, lag(close) OVER ({BY_BAR}) AS pc, row_number() OVER ({BY_BAR}) AS rn, count(*) OVER (PARTITION BY ticker) AS n_bars FROM bars"),
        ("x1", f"SELECT *, {tr} AS tr FROM x0"),
        ("x2", f"SELECT ticker, trade_date, open, close, rn, n_bars, pc, CASE WHEN rn >= 14 THEN avg(tr) OVER ({BY_BAR} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END AS atr, {ahead} FROM x1"),
        ("templates", values(templates)),
        ("x3", f"SELECT b.*, t.*, CASE WHEN entry = 'open' THEN open ELSE close END AS entry_price FROM x2 b CROSS JOIN templates t WHERE b.rn >= CASE WHEN t.entry = 'open' THEN 3 ELSE 2 END AND n_bars >= 70 AND pc > 0{dates}"),
        ("x4", f"SELECT *, entry_price * (1 + {sign} * tp / 100 * CASE WHEN mode = 'atr' THEN atr ELSE 1 END) AS target, entry_price * (1 - {sign} * sl / 100 * CASE WHEN mode = 'atr' THEN atr ELSE 1 END) AS stop FROM x3 WHERE entry_price > 0 AND (mode = 'percent' OR atr > 0)"),
        ("x5", f"SELECT *, {_touch()} AS touch FROM x4"),
        ("x6", "SELECT *, CAST(floor(touch / 4e0) AS INT) AS bar, touch % 4 AS kind FROM x5 WHERE touch IS NOT NULL"),
        ("x7", f"SELECT *, CASE kind WHEN 0 THEN target WHEN 3 THEN {_of('bar', 'c')} ELSE stop END AS exit_price, {_of('bar', 'd')} AS exit_date, CASE kind WHEN 0 THEN 'take_profit' WHEN 1 THEN 'stop_loss' WHEN 2 THEN 'stop_loss_conflict' ELSE 'time_cap' END AS exit_reason FROM x6"),
        ("samples", f"SELECT template, entry AS entry_rule, direction, ticker, trade_date, exit_date, exit_reason, entry_price, exit_price, {r(sign + ' * (exit_price / entry_price - 1) * 100', 9)} AS asset_move_pct, {r(sign + ' * (exit_price / entry_price - 1) * 100 - cost', 9)} AS trade_return_pct FROM x7"),
    ]


SAMPLES_FINAL = f"SELECT template, ticker, trade_date, exit_date, exit_reason, {r('entry_price', 9)} AS entry_price, {r('exit_price', 9)} AS exit_price, trade_return_pct FROM samples"


def samples(bars: DataFrame, templates: list[dict], start: str | None = None, end: str | None = None, tasks: int | None = None) -> DataFrame:
    """A row per entry bar and template. ``tasks``: parts in which bars meet templates; else as few as their bytes ask for."""
    spark, plan = bars.sparkSession, steps(templates, start, end)
    if tasks is None:
        return run(spark, plan, "SELECT * FROM samples", bars=bars)
    cut = [name for name, _ in plan].index("templates")
    ahead = run(spark, plan[:cut], f"SELECT * FROM {plan[cut - 1][0]}", bars=bars).repartition(tasks, "ticker", "trade_date")
    return run(spark, plan[cut:], "SELECT * FROM samples", **{plan[cut - 1][0]: ahead})
