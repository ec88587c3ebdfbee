"""The detailed report of an option run: a status for every strategy, its gains and losses, its first ticker, one header row.

Returns of nine digits are summed as decimals, so no figure turns on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlework.functions import metrics

# The report's gate.
GATE = metrics.reasons(success=55.0, factor=1.10, average=0.0, trades=10)


def outcomes(trades: DataFrame, *group: str) -> DataFrame:
    """Per group: trades, gains, losses, flats (a return of zero) and net."""
    x = F.col("trade_return_pct")
    net = F.round(F.sum(x.cast("decimal(28,9)")).cast("double") + 0.0, 6)
    return trades.groupBy(*group).agg(F.count(F.lit(1)).alias("trades"), F.count_if(x > 0).alias("gains"), F.count_if(x < 0).alias("losses"), F.count_if(x == 0).alias("flats"), net.alias("net"))


def first_tickers(trades: DataFrame) -> DataFrame:
    """Each strategy's first ticker by net, average and trades; ties by name."""
    rows = outcomes(trades, "strategy_code", "ticker").withColumn("av", F.col("net") / F.col("trades"))
    order = Window.partitionBy("strategy_code").orderBy(F.desc("net"), F.desc("av"), F.desc("trades"), "ticker")
    return rows.withColumn("place", F.row_number().over(order)).where("place = 1").select("strategy_code", F.col("ticker").alias("first_ticker"), F.col("net").alias("first_net"), F.col("trades").alias("first_trades"))


def statuses(summary: DataFrame) -> DataFrame:
    reasons = F.expr(GATE)
    return summary.withColumn("reasons", reasons).withColumn("status", F.when(F.col("reasons") == "", "approved").otherwise("rejected"))


def strategies(summary: DataFrame, trades: DataFrame) -> DataFrame:
    """Approved first, then by net: what the run says of each strategy."""
    rows = statuses(summary).drop("trades").join(outcomes(trades, "strategy_code").drop("net"), "strategy_code").join(first_tickers(trades), "strategy_code")
    cols = ["strategy_code", "status", "reasons", "tickers", "trades", "gains", "losses", "flats", "success_rate_pct", "profitable_rate_pct", "avg_return_pct", "median_return_pct", "net_return_pct", "profit_factor", "first_ticker", "first_net", "first_trades"]
    return rows.select(*cols).orderBy("status", F.desc("net_return_pct"), "strategy_code")


def header(summary: DataFrame, trades: DataFrame, bars: DataFrame, options: DataFrame) -> DataFrame:
    """One row: what lies in the tables, strategies by status, trades by outcome."""
    tables = bars.agg(F.count_distinct("ticker").alias("spot_tickers")).crossJoin(options.agg(F.count_distinct("underlying_root").alias("roots"), F.count_distinct("option_symbol").alias("contracts")))
    tested = statuses(summary).agg(F.count(F.lit(1)).alias("strategies"), F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("status") == "rejected").alias("rejected"))
    return tables.crossJoin(tested).crossJoin(outcomes(trades).drop("net"))  # rows of aggregates, one each
