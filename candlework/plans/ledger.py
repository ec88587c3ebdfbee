"""Queries of scans by universe, profiles, orders, gates of the option engines and pattern codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlework.functions import metrics
from candlework.functions.sql import chain
from candlework.plans import assets, derivatives, equities
from candlework.sources import bars, reports

UNIVERSE = ("Brand#11", "Brand#23", "Brand#42", "Brand#99")
HISTORY = 250
#: Gates of the option engines (fixed values).
E3_GATE = metrics.reasons(success=55.0, factor=1.0, average=0.10, trades=200)
E4_GATE = metrics.reasons(success=0.0, factor=1.15, average=0.0, trades=50, tickers=5)


def spot_universe(spark, d):
    """Spot bars of the tickers of a universe: names match in upper case, unknown ones find nothing."""
    names = spark.createDataFrame([(x,) for x in UNIVERSE], "ticker string").select(F.upper("ticker").alias("name"))
    spot = bars.spot_bars(spark, d)
    return spot.join(names, F.upper("ticker") == F.col("name"), "left_semi").select("ticker", "trade_date", F.round("close", 6).alias("close"), "volume")


def history_window(spark, d):
    return reports.history(bars.price_bars(spark, d), HISTORY).select("ticker", "trade_date", F.round("close", 6).alias("close"), F.round("adj_close", 6).alias("adj_close"))


def option_probes(spark, d):
    return bars.option_bars(spark, d).agg(F.count_distinct("underlying_root").alias("roots"), F.count_distinct("option_symbol").alias("symbols"), F.count_distinct("trade_date").alias("days"))


def table_profile(spark, d):
    """Rows, tickers, first and last day of each stored table."""
    tables = {"spot": bars.spot_bars(spark, d), "options": bars.option_bars(spark, d).withColumnRenamed("underlying_root", "ticker")}
    out = None
    for name, df in tables.items():
        row = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.count_distinct("ticker").alias("tickers"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date")).select("name", "n", "tickers", "first_date", "last_date")
        out = row if out is None else out.unionByName(row)
    return out


def _factor():
    return F.when(F.col("pf_is_inf"), 1e300).otherwise(F.coalesce("profit_factor", F.lit(-1e300)))


def ordered(df: DataFrame, keys: list, ties: list[str], group: str | None = None) -> DataFrame:
    """``place`` in a report's order; of all rows (few: one a strategy) or within ``group``."""
    over = Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))
    return df.withColumn("place", F.row_number().over(over.orderBy(*keys, *ties)))


def e2_ranked(spark, d):
    rows = ordered(equities.QUERIES["e2_summary"](spark, d), [F.desc("net_return_pct"), _factor().desc(), F.desc("success_rate_pct"), F.desc("avg_return_pct")], ["strategy_code"])
    return rows.select("strategy_code", "net_return_pct", "place")


def e2_tickers_ranked(spark, d):
    rows = ordered(equities.QUERIES["e2_ticker_summary"](spark, d), [F.desc("net_return_pct"), F.desc("avg_return_pct"), F.desc("trades")], ["ticker"], "strategy_code")
    return rows.select("strategy_code", "ticker", "net_return_pct", "place")


def e3_ranked(spark, d):
    rows = ordered(derivatives.QUERIES["e3_summary"](spark, d), [F.desc("net_return_pct"), _factor().desc(), F.desc("avg_return_pct"), F.desc("success_rate_pct")], ["strategy_code"])
    return rows.select("strategy_code", "net_return_pct", "place")


def e4_ranked(spark, d):
    """The first hundred patterns in the miner's order."""
    rows = derivatives.QUERIES["e4_summary"](spark, d)
    return rows.orderBy(F.desc("net_return_pct"), _factor().desc(), F.desc("avg_return_pct"), F.desc("trades"), "pattern_code").limit(100).select("pattern_code", "net_return_pct", "trades")


def pattern_codes(spark, d):
    """Pattern codes taken apart again: template, states, features, the code for another exit, the sentence of a signal."""
    code = F.col("pattern_code")
    template = reports.template(code)
    rows = assets.QUERIES["e6_summary"](spark, d).select("pattern_code")
    return rows.select(
        "pattern_code",
        template.alias("template"),
        reports.signature(code).alias("signature"),
        reports.keys(code).alias("feature_keys"),
        F.size(reports.conditions(code)).alias("states"),
        reports.retarget(code, 3.0, 1.5).alias("other_code"),
        reports.sentence(F.split_part(template, F.lit("_"), F.lit(2)), F.split_part(template, F.lit("_"), F.lit(3)), F.lit(2.0), F.lit(1.0), F.lit(5)).alias("how"),
    )


QUERIES = {
    "spot_universe": spot_universe,
    "history_window": history_window,
    "option_probes": option_probes,
    "table_profile": table_profile,
    "e2_ranked": e2_ranked,
    "e2_tickers_ranked": e2_tickers_ranked,
    "e3_ranked": e3_ranked,
    "e3_gate": lambda spark, d: derivatives.QUERIES["e3_summary"](spark, d).withColumn("reasons", F.expr(E3_GATE)).select("strategy_code", "trades", "reasons"),
    "e4_ranked": e4_ranked,
    "e4_gate": lambda spark, d: derivatives.QUERIES["e4_summary"](spark, d).where(f"{E4_GATE} = ''").select("pattern_code", "trades", "tickers"),
    "pattern_codes": pattern_codes,
}

_PF = "CASE WHEN pf_is_inf THEN 1e300 ELSE coalesce(profit_factor, -1e300) END"
_BASE = chain([("bars", bars.SPOT_SQL), ("prices", bars.PRICE_SQL), ("options", bars.OPTION_SQL)], "")
_PASSED = "success_rate_pct >= 0 AND (pf_is_inf OR coalesce(profit_factor, -1) >= 1.15) AND avg_return_pct >= 0 AND trades >= 50 AND tickers >= 5 AND net_return_pct > 0"
ORACLE_SQL = {
    "spot_universe": _BASE + "SELECT ticker, trade_date, round(close, 6) AS close, volume FROM bars WHERE ticker IN ('Brand#11', 'Brand#23', 'Brand#42') OR upper(ticker) IN ('BRAND#11', 'BRAND#23', 'BRAND#42', 'BRAND#99')",
    "history_window": _BASE + f"SELECT ticker, trade_date, round(close, 6) AS close, round(adj_close, 6) AS adj_close FROM prices QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) <= {HISTORY} AND count(*) OVER (PARTITION BY ticker) >= 3",
    "option_probes": _BASE + "SELECT count(DISTINCT underlying_root) AS roots, count(DISTINCT option_symbol) AS symbols, count(DISTINCT trade_date) AS days FROM options",
    "table_profile": _BASE + "SELECT 'spot' AS name, count(*) AS n, count(DISTINCT ticker) AS tickers, min(trade_date) AS first_date, max(trade_date) AS last_date FROM bars UNION ALL SELECT 'options', count(*), count(DISTINCT underlying_root), min(trade_date), max(trade_date) FROM options",
    "e2_ranked": f"SELECT strategy_code, net_return_pct, CAST(row_number() OVER (ORDER BY net_return_pct DESC, {_PF} DESC, success_rate_pct DESC, avg_return_pct DESC, strategy_code) AS INTEGER) AS place FROM ({equities.ORACLE_SQL['e2_summary']})",
    "e2_tickers_ranked": f"SELECT strategy_code, ticker, net_return_pct, CAST(row_number() OVER (PARTITION BY strategy_code ORDER BY net_return_pct DESC, avg_return_pct DESC, trades DESC, ticker) AS INTEGER) AS place FROM ({equities.ORACLE_SQL['e2_ticker_summary']})",
    "e3_ranked": f"SELECT strategy_code, net_return_pct, CAST(row_number() OVER (ORDER BY net_return_pct DESC, {_PF} DESC, avg_return_pct DESC, success_rate_pct DESC, strategy_code) AS INTEGER) AS place FROM ({derivatives.ORACLE_SQL['e3_summary']})",
    "e3_gate": "SELECT strategy_code, trades, array_to_string(list_filter([CASE WHEN success_rate_pct < 55 THEN 'success_rate<55.00' END, CASE WHEN NOT pf_is_inf AND coalesce(profit_factor, -1) < 1 THEN 'profit_factor<1.00' END, CASE WHEN avg_return_pct < 0.1 THEN 'average_return<0.10' END, CASE WHEN trades < 200 THEN 'trades<200' END, CASE WHEN net_return_pct <= 0 THEN 'net<=0' END], lambda x: x IS NOT NULL), ';') AS reasons " + f"FROM ({derivatives.ORACLE_SQL['e3_summary']})",
    "e4_ranked": f"SELECT pattern_code, net_return_pct, trades FROM ({derivatives.ORACLE_SQL['e4_summary']}) ORDER BY net_return_pct DESC, {_PF} DESC, avg_return_pct DESC, trades DESC, pattern_code LIMIT 100",
    "e4_gate": f"SELECT pattern_code, trades, tickers FROM ({derivatives.ORACLE_SQL['e4_summary']}) WHERE {_PASSED}",
    "pattern_codes": "SELECT pattern_code, template, replace(tail, '__', '; ') AS signature, array_to_string(list_transform(string_split(tail, '__'), lambda x: string_split(x, '=')[1]), ',') AS feature_keys, CAST(len(string_split(tail, '__')) AS INTEGER) AS states, replace(pattern_code, '_tp2_sl1_', '_tp3_sl1_5_') AS other_code, "
    "CASE string_split(template, '_')[2] WHEN 'long' THEN 'Comprar' ELSE 'Vender' END || ' no ' || string_split(template, '_')[3] || ', alvo de +2.0% e stop de -1.0% com limite maximo de 5 dias.' AS how FROM (SELECT pattern_code, regexp_extract(pattern_code, '^(.*)__[0-9]f__(.*)$', 1) AS template, regexp_extract(pattern_code, '^(.*)__[0-9]f__(.*)$', 2) AS tail " + f"FROM ({assets.ORACLE_SQL['e6_summary']}))",
}
