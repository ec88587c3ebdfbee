"""Window features of daily bars and their states, per (ticker, trade_date, entry rule).

All windows are full or null. A close entry looks at its own bar, an open entry at the bar before; the gap is always that
of the entry bar. Features are computed once per bar in one window pass; an open entry lags them by one bar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from candlework.functions import ladders
from candlework.functions.sql import BY_BAR, change, full, lag, last, r, ratio, run

#: (key, ladder, pairable, expression on the anchor bar), in library order. None: made from the entry bar.
FEATURES: list[tuple[str, str, bool, str | None]] = [
    ("gap_pct", "signed_pct", True, None),
    ("gap_vs_range20", "relative", True, None),
    *[(f"prev_ret_{k}d", "signed_pct", True, f"ret{k}") for k in (1, 2, 3, 5, 10, 20)],
    *[(f"prev_ret_{k}d_z20", "relative", False, ratio(f"ret{k}", "std20")) for k in (1, 3, 5)],
    ("close_vs_sma5", "distance", False, change("c", "sma5")),
    ("close_vs_sma20", "distance", True, change("c", "sma20")),
    ("close_vs_sma50", "distance", True, change("c", "sma50")),
    ("sma5_vs_sma20", "distance", True, change("sma5", "sma20")),
    ("sma20_vs_sma50", "distance", True, change("sma20", "sma50")),
    ("sma20_slope_5d", "distance", True, change("sma20", "sma20_back5")),
    ("sma50_slope_10d", "distance", True, change("sma50", "sma50_back10")),
    ("atr14_pct", "ratio", False, "CASE WHEN atr14 > 0 THEN atr14 / greatest(rng, 1e-4) END"),
    ("gap_vs_atr14", "relative", True, None),
    ("range_ratio_20d", "ratio", False, ratio("rng", "rng20")),
    ("compression_3v20", "ratio", True, ratio("rng3", "rng20")),
    ("vol_ratio_5v20", "ratio", False, ratio("std5", "std20")),
    ("volume_ratio_20d", "ratio", True, ratio("v", "v20")),
    ("volume_ratio_5v20", "ratio", False, ratio("v5", "v20")),
    ("dollar_volume_ratio_20d", "ratio", False, ratio("dv", "dv20")),
    ("intraday_return_prev", "signed_pct", True, change("c", "o")),
    ("body_ratio_prev", "fraction", False, ratio("abs(c - o)", "h - l")),
    ("close_location_prev", "close_position", False, ratio("c - l", "h - l")),
    ("lower_wick_ratio_prev", "fraction", False, ratio("least(o, c) - l", "h - l")),
    ("upper_wick_ratio_prev", "fraction", False, ratio("h - greatest(o, c)", "h - l")),
    *[(f"range_position_{n}d", "close_position", True, f"CASE WHEN hi{n} > lo{n} THEN (c - lo{n}) / (hi{n} - lo{n}) WHEN hi{n} = lo{n} THEN 5e-1 END") for n in (5, 10, 20)],
    *[(f"drawdown_{n}d", "drawdown", n < 20, change("c", f"hi{n}")) for n in (5, 10, 20)],
    *[(f"rebound_{n}d", "rebound", False, change("c", f"lo{n}")) for n in (5, 10)],
    ("streak_direction", "streak", True, "streak"),
    ("positive_days_5d", "positive_5", True, "pos5"),
    ("positive_days_10d", "positive_10", True, "pos10"),
    ("rsi_14", "rsi", True, "rsi14"),
    ("bb_position_20", "close_position", True, "CASE WHEN cstd20 > 0 THEN (c - (sma20 - 2 * cstd20)) / (4 * cstd20) END"),
    ("close_vs_ema9", "distance", True, change("c", "ema9")),
    ("close_vs_ema21", "distance", True, change("c", "ema21")),
    ("day_of_week", "weekday", True, None),
    ("atr_return_1d", "relative", True, ratio("ret1", "atr14")),
    ("atr_return_5d", "relative", True, ratio("ret5", "atr14")),
    ("volume_spike_1d", "ratio", True, ratio("v", "vmax5")),
]
KEYS = [f[0] for f in FEATURES]
LADDER = {f[0]: f[1] for f in FEATURES}
PAIRABLE = [f[0] for f in FEATURES if f[2]]

#: The option engine's library: (key, pairable); its anchor is always the bar before, two ladders are its own.
OPTION_PAIRABLE = ("gap_pct", "gap_vs_range20", "prev_ret_1d", "prev_ret_3d", "prev_ret_5d", "close_vs_sma20", "volume_ratio_20d", "compression_3v20")
OPTION_KEYS = ("gap_pct", "gap_vs_range20", "prev_ret_1d", "prev_ret_2d", "prev_ret_3d", "prev_ret_5d", "prev_ret_1d_z20", "close_vs_sma5", "close_vs_sma20", "sma5_vs_sma20", "sma20_slope_5d", "volume_ratio_20d", "range_ratio_20d", "compression_3v20", "vol_ratio_5v20", "body_ratio_prev", "close_location_prev", "lower_wick_ratio_prev", "upper_wick_ratio_prev", "range_position_20d")


def option_ladder(key: str) -> str:
    return {"signed_pct": "option_signed_pct", "distance": "option_distance"}.get(LADDER[key], LADDER[key])


def _streak() -> str:
    """Up or down closes in a row, five at most; a flat day ends it."""
    up = " ".join(f"WHEN coalesce(s{k}, 0) <> s0 THEN {k} * s0" for k in range(1, 5))
    return f"CASE WHEN coalesce(s0, 0) = 0 THEN 0 {up} ELSE 5 * s0 END"


#: Steps from ``bars`` and ``ema`` (ticker, trade_date, ema9, ema21, rsi14) to anchor values.
BASE = [
    ("s0", f"SELECT ticker, trade_date, open AS o, high AS h, low AS l, close AS c, CAST(volume AS DOUBLE) AS v, row_number() OVER ({BY_BAR}) AS rn, lag(close) OVER ({BY_BAR}) AS pc, count(*) OVER (PARTITION BY ticker) AS n_bars FROM bars"),
    ("s1", "SELECT s0.*, CASE WHEN pc > 0 THEN (c / pc - 1) * 100 ELSE 0e0 END AS dret, CASE WHEN c > 0 THEN (h - l) / c * 100 ELSE 0e0 END AS rng, CASE WHEN pc > 0 THEN greatest(h - l, abs(h - pc), abs(l - pc)) / pc * 100 ELSE 0e0 END AS tr, c * v AS dv, CASE WHEN c > pc THEN 1 ELSE 0 END AS up, CASE WHEN pc IS NULL THEN NULL WHEN c > pc THEN 1 WHEN c < pc THEN -1 ELSE 0 END AS s0, ema9, ema21, rsi14 FROM s0 LEFT JOIN ema ON s0.ticker = ema.ticker AND s0.trade_date = ema.trade_date".replace("SELECT s0.*", "SELECT s0.ticker, s0.trade_date, o, h, l, c, v, rn, pc, n_bars")),
    (
        "s2",
        "SELECT ticker, trade_date, rn, n_bars, o, h, l, c, v, pc, rng, dv, ema9, ema21, rsi14, s0, "
        + ", ".join(
            [f"{full(n, f'avg(c) {last(n)}')} AS sma{n}" for n in (5, 20, 50)]
            + [f"{full(n, r(f'stddev_pop(dret) {last(n)}', 9))} AS std{n}" for n in (5, 20)]
            + [f"{full(20, r(f'stddev_pop(c) {last(20)}', 9))} AS cstd20", f"{full(14, f'avg(tr) {last(14)}')} AS atr14"]
            + [f"{full(n, f'avg(rng) {last(n)}')} AS rng{n}" for n in (3, 20)]
            + [f"{full(n, f'avg(v) {last(n)}')} AS v{n}" for n in (5, 20)]
            + [f"{full(20, f'avg(dv) {last(20)}')} AS dv20", f"{full(6, f'max(v) {last(5, 1)}')} AS vmax5"]
            + [f"{full(n, f'max(h) {last(n)}')} AS hi{n}" for n in (5, 10, 20)]
            + [f"{full(n, f'min(l) {last(n)}')} AS lo{n}" for n in (5, 10, 20)]
            + [f"{full(n + 1, f'sum(up) {last(n)}')} AS pos{n}" for n in (5, 10)]
            + [f"{change('c', lag('c', k))} AS ret{k}" for k in (1, 2, 3, 5, 10, 20)]
            + [f"{lag('s0', k)} AS s{k}" for k in range(1, 5)]
        )
        + " FROM s1",
    ),
    ("s3", f"SELECT *, {full(25, lag('sma20', 5))} AS sma20_back5, {full(60, lag('sma50', 10))} AS sma50_back10, {_streak()} AS streak FROM s2"),
    ("anchor", f"SELECT ticker, trade_date, rn, n_bars, o, h, l, c, pc, rng20, atr14, {change('o', 'pc')} AS gap, " + ", ".join(f"{x} AS a_{k}" for k, _, _, x in FEATURES if x) + " FROM s3"),
]


def _values(close: bool) -> str:
    """All features of one entry rule; a close entry anchors on its bar, an open one on the bar before."""
    at = (lambda x: x) if close else lag
    made = {"gap_pct": "gap", "gap_vs_range20": ratio("gap", at("rng20")), "gap_vs_atr14": ratio("gap", at("atr14")), "day_of_week": "(days_between(trade_date, DATE '1970-01-05') % 7 + 7) % 7"}
    cols = ", ".join(f"{r(made.get(k) or at('a_' + k), 9)} AS {k}" for k in KEYS)
    return f"SELECT ticker, trade_date, rn, n_bars, '{'close' if close else 'open'}' AS entry_rule, o, c, pc, atr14, {cols} FROM anchor"


def steps(min_bars: int = 70) -> list[tuple[str, str]]:
    """Down to ``valued``: all features of every entry bar of tickers with enough bars."""
    return BASE + [
        ("at_open", _values(False)),
        ("at_close", _values(True)),
        ("valued", f"SELECT * FROM at_open WHERE rn >= 3 AND pc > 0 AND n_bars >= {min_bars} AND o > 0 UNION ALL SELECT * FROM at_close WHERE rn >= 2 AND pc > 0 AND n_bars >= {min_bars} AND c > 0"),
    ]


STEPS = steps()
#: Bars that the option engine asks of a ticker, and features that read the sequential averages.
OPTION_BARS, SEQUENTIAL = 25, ("rsi_14", "close_vs_ema9", "close_vs_ema21")

#: DuckDB's way to the sequential averages: a recursion over each ticker's bars.
EMA_SQL = [
    ("numbered", f"SELECT ticker, trade_date, close AS c, row_number() OVER ({BY_BAR}) AS rn, close - lag(close) OVER ({BY_BAR}) AS d FROM bars"),
    ("seeds", "SELECT *, avg(c) OVER w9 AS m9, avg(c) OVER w21 AS m21, avg(greatest(d, 0)) OVER w14 AS g14, avg(greatest(-d, 0)) OVER w14 AS l14 FROM numbered WINDOW w9 AS (PARTITION BY ticker ORDER BY rn ROWS 8 PRECEDING), w21 AS (PARTITION BY ticker ORDER BY rn ROWS 20 PRECEDING), w14 AS (PARTITION BY ticker ORDER BY rn ROWS 13 PRECEDING)"),
    ("walk", "SELECT ticker, trade_date, rn, CAST(NULL AS DOUBLE) AS e9, CAST(NULL AS DOUBLE) AS e21, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS q FROM seeds WHERE rn = 1 UNION ALL SELECT s.ticker, s.trade_date, s.rn, CASE WHEN s.rn = 9 THEN s.m9 ELSE (s.c - w.e9) * 2e-1 + w.e9 END, CASE WHEN s.rn = 21 THEN s.m21 ELSE (s.c - w.e21) * (2e0 / 22) + w.e21 END, CASE WHEN s.rn = 15 THEN s.g14 ELSE (w.g * 13 + greatest(s.d, 0)) / 14 END, CASE WHEN s.rn = 15 THEN s.l14 ELSE (w.q * 13 + greatest(-s.d, 0)) / 14 END FROM walk w JOIN seeds s ON s.ticker = w.ticker AND s.rn = w.rn + 1"),
    ("ema", "SELECT ticker, trade_date, e9 AS ema9, e21 AS ema21, CASE WHEN rn < 15 THEN NULL WHEN q = 0 THEN 1e2 ELSE 100 - 100 / (1 + g / q) END AS rsi14 FROM walk"),
]


def ema(values: list[float], period: int) -> list[float | None]:
    """The plain recursion that ``sequential`` stands for: seeded by the mean of the first values; null before."""
    out: list[float | None] = [None] * len(values)
    if len(values) >= period:
        now = sum(values[:period]) / period
        out[period - 1] = now
        for i in range(period, len(values)):
            now += (values[i] - now) * 2 / (period + 1)
            out[i] = now
    return out


def rsi(closes: list[float], period: int = 14) -> list[float | None]:
    """Wilder's index by its recursion; null for the first bars, 100 without losses."""
    out: list[float | None] = [None] * len(closes)
    moves = [b - a for a, b in zip(closes, closes[1:], strict=False)]
    gain = loss = 0.0
    for i, m in enumerate(moves):
        up, down = max(m, 0.0), max(-m, 0.0)
        if i < period:
            gain, loss = gain + up / period, loss + down / period
        else:
            gain, loss = (gain * (period - 1) + up) / period, (loss * (period - 1) + down) / period
        if i >= period - 1:
            out[i + 1] = 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
    return out


#: Bars of a block, and earlier blocks whose end still weighs in a double: the slowest average keeps (13 / 14) ** 64 = 0.0087 of a value over one.
SPAN, BACK = 64, 8
#: name -> (first bar, its seed, what later bars add, the share that a bar leaves of what was before)
AVERAGES = {
    "e9": (9, "avg(c) OVER (PARTITION BY ticker ORDER BY rn ROWS 8 PRECEDING)", "c * 2 / 10", 8 / 10),
    "e21": (21, "avg(c) OVER (PARTITION BY ticker ORDER BY rn ROWS 20 PRECEDING)", "c * 2 / 22", 20 / 22),
    "g": (15, "avg(greatest(d, 0e0)) OVER (PARTITION BY ticker ORDER BY rn ROWS 13 PRECEDING)", "greatest(d, 0e0) / 14", 13 / 14),
    "q": (15, "avg(greatest(-d, 0e0)) OVER (PARTITION BY ticker ORDER BY rn ROWS 13 PRECEDING)", "greatest(-d, 0e0) / 14", 13 / 14),
}


def _scan_steps() -> list[tuple[str, str]]:
    """An average is x -> keep * x + added, bar by bar. Such maps compose, so a block of bars is one of them:
    its own sum first, then what the ends of the blocks before it leave."""
    ends = lambda n, keep: " + ".join(f"{keep ** (SPAN * k)!r} * coalesce(lag(p_{n}, {k}) OVER (PARTITION BY ticker ORDER BY block), 0e0)" if k else f"p_{n}" for k in range(BACK))
    return [
        ("a0", f"SELECT ticker, trade_date, CAST(close AS DOUBLE) AS c, row_number() OVER ({BY_BAR}) AS rn, close - lag(close) OVER ({BY_BAR}) AS d FROM bars"),
        ("a1", f"SELECT ticker, trade_date, rn, CAST(floor((rn - 1) / {SPAN}e0) AS INT) AS block, CAST((rn - 1) % {SPAN} AS INT) AS at, " + ", ".join(f"CASE WHEN rn = {first} THEN {seed} WHEN rn > {first} THEN {added} ELSE 0e0 END AS v_{n}" for n, (first, seed, added, _) in AVERAGES.items()) + " FROM a0"),
        ("a2", "SELECT ticker, trade_date, rn, block, at, " + ", ".join(f"sum(v_{n} * power({1 / keep!r}D, at)) OVER (PARTITION BY ticker, block ORDER BY at) * power({keep!r}D, at) AS p_{n}" for n, (_, _, _, keep) in AVERAGES.items()) + " FROM a1"),
        ("a3", "SELECT ticker, block + 1 AS block, " + ", ".join(f"{ends(n, keep)} AS i_{n}" for n, (_, _, _, keep) in AVERAGES.items()) + f" FROM a2 WHERE at = {SPAN - 1}"),
        ("a4", "SELECT x.ticker, x.trade_date, x.rn, " + ", ".join(f"p_{n} + coalesce(i_{n}, 0e0) * power({keep!r}D, at + 1) AS {n}" for n, (_, _, _, keep) in AVERAGES.items()) + " FROM a2 x LEFT JOIN a3 y ON y.ticker = x.ticker AND y.block = x.block"),
    ]


_SCANNED = "SELECT ticker, trade_date, CASE WHEN rn >= 9 THEN e9 END AS ema9, CASE WHEN rn >= 21 THEN e21 END AS ema21, CASE WHEN rn < 15 THEN NULL WHEN q = 0 THEN 1e2 ELSE 100 - 100 / (1 + g / q) END AS rsi14 FROM a4"


def sequential(bars: DataFrame) -> DataFrame:
    """ema9, ema21 and rsi14 of every bar: recursions, as a scan over blocks of each ticker's days (see ema and rsi)."""
    return run(bars.sparkSession, _scan_steps(), _SCANNED, bars=bars)


def state_count_final(key: str, option: bool = False) -> str:
    ladder = option_ladder(key) if option else LADDER[key]
    where = " WHERE entry_rule = 'open'" if option else ""
    return f"SELECT ticker, entry_rule, {ladders.code(ladder, key)} AS state, CAST(count(*) AS BIGINT) AS n, min(trade_date) AS first_date, max(trade_date) AS last_date, {r(f'min({key})', 5)} AS lowest, {r(f'max({key})', 5)} AS highest FROM valued{where} GROUP BY 1, 2, 3"


def values(bars: DataFrame, min_bars: int = 70) -> DataFrame:
    return run(bars.sparkSession, steps(min_bars), "SELECT * FROM valued", bars=bars, ema=sequential(bars))


def state_counts(bars: DataFrame, key: str, option: bool = False) -> DataFrame:
    """How often a ticker is in each state of a feature. The recursion over a ticker's days runs only for features that read it.

    Tickers need 70 bars, for the option engine 25.
    """
    spark = bars.sparkSession
    ema = sequential(bars) if key in SEQUENTIAL else spark.createDataFrame([], "ticker string, trade_date date, ema9 double, ema21 double, rsi14 double")
    return run(spark, steps(OPTION_BARS) if option else STEPS, state_count_final(key, option), bars=bars, ema=ema)
