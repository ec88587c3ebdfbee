"""A store of pattern trades, read by pattern: only the buckets that hold a wanted pattern are opened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Buckets of a store, and parts that a bucket is written in: one pattern may hold a third of all trades.
BUCKETS, PARTS = 64, 4


def bucket(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64("template", "itemset"), F.lit(buckets)).cast("int")


def write_trades(trades: DataFrame, path: str, buckets: int = BUCKETS) -> dict:
    """Writes a folder a bucket; returns n, net, first and last day, counted in the same pass."""
    seen = Observation()
    counted = trades.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.col("trade_return_pct").cast("decimal(28,9)")).alias("net"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))
    part = F.pmod(F.xxhash64("ticker", "trade_date"), F.lit(PARTS))
    counted.withColumn("bucket", bucket(buckets)).repartition(F.col("bucket"), part).write.mode("overwrite").partitionBy("bucket").parquet(path)
    return seen.get


def read_trades(spark: SparkSession, path: str, patterns: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """All trades of ``patterns`` (template, itemset)."""
    wanted = [r.bucket for r in patterns.select(bucket(buckets).alias("bucket")).distinct().collect()]  # at most ``buckets`` numbers
    return spark.read.parquet(path).where(F.col("bucket").isin(wanted)).drop("bucket").join(patterns.select("template", "itemset").distinct(), ["template", "itemset"], "left_semi")
