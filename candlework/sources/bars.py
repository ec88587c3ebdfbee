"""Bars and option chains derived from the star schema, and the schemas of real ones.

Engine functions take DataFrames with these schemas, so real bars go in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPOT = "ticker string, trade_date date, open double, high double, low double, close double, volume bigint, trade_count bigint"
ADJUSTABLE = "ticker string, trade_date date, open double, high double, low double, close double, adj_close double, volume bigint"
OPTION = "option_symbol string, underlying_root string, option_side string, trade_date date, expiration_date date, strike_price double, open double, high double, low double, close double, volume bigint, trade_count bigint"

_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount")


def _ohlc(price: str):
    order = F.struct(*_ORDER)
    return (
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum("l_quantity").cast("bigint").alias("volume"),
        F.count(F.lit(1)).alias("trade_count"),
    )


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*_ORDER, "l_tax", F.to_date("l_shipdate").alias("trade_date"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice")
    return items.join(parts, "l_partkey")


def spot_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = _sales(spark, sf_dir).withColumn("price", F.col("p_retailprice") * (1 - F.col("l_discount")))
    return sales.groupBy(F.col("p_brand").alias("ticker"), "trade_date").agg(*_ohlc("price"))


def price_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot bars with an adjusted close that depends on the day alone."""
    return spot_bars(spark, sf_dir).withColumn("adj_close", F.col("close") * (1 - F.dayofmonth("trade_date") % 5 / F.lit(100.0)))


def option_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("l_suppkey") % 2 == 0, "call").otherwise("put")
    strike = (F.round(F.col("p_retailprice") / 50) * 50).cast("int")
    months = F.when(F.col("l_suppkey") % 3 == 0, 3).when(F.col("l_suppkey") % 3 == 1, 4).otherwise(6)
    expiry = F.date_add(F.add_months(F.trunc("trade_date", "quarter"), months), -1)
    rows = _sales(spark, sf_dir).select("*", side.alias("option_side"), strike.alias("strike"), expiry.alias("expiration_date"), (1 + 10 * F.col("l_discount") + 20 * F.col("l_tax")).alias("premium"))
    symbol = F.concat_ws("|", "p_brand", "option_side", F.col("expiration_date").cast("string"), F.col("strike").cast("string"))
    keys = (symbol.alias("option_symbol"), F.col("p_brand").alias("underlying_root"), "option_side", "trade_date", "expiration_date", F.col("strike").cast("double").alias("strike_price"))
    return rows.groupBy(*keys).agg(*_ohlc("premium"))


def _duck_ohlc(price: str) -> str:
    key = f"row({', '.join(_ORDER)})"
    return f"arg_min({price}, {key}) AS open, max({price}) AS high, min({price}) AS low, arg_max({price}, {key}) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume, count(*) AS trade_count"


#: The same in DuckDB.
SPOT_SQL = f"SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS trade_date, {_duck_ohlc('p_retailprice * (1 - l_discount)')} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"
PRICE_SQL = f"SELECT *, close * (1 - extract(day FROM trade_date) % 5 / 100.0) AS adj_close FROM ({SPOT_SQL})"
OPTION_SQL = (
    "SELECT p_brand || '|' || option_side || '|' || CAST(expiration_date AS VARCHAR) || '|' || CAST(strike AS VARCHAR) AS option_symbol, p_brand AS underlying_root, option_side, trade_date, expiration_date, CAST(strike AS DOUBLE) AS strike_price, "
    + _duck_ohlc("premium")
    + " FROM (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN 'call' ELSE 'put' END AS option_side, CAST(l_shipdate AS DATE) AS trade_date, CAST(round(p_retailprice / 50) * 50 AS INTEGER) AS strike, CAST(date_trunc('quarter', l_shipdate) + to_months(CASE l_suppkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 6 END) - INTERVAL 1 DAY AS DATE) AS expiration_date, 1 + 10 * l_discount + 20 * l_tax AS premium FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ALL"
)
OPTION_SQL = OPTION_SQL.replace("GROUP BY ALL", "GROUP BY p_brand, option_side, expiration_date, strike, trade_date")
