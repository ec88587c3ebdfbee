"""Readers of the exchange's fixed-width file and of ticker universes."""

from __future__ import annotations

import io
import zipfile
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places in a record (from 1) and lengths: fixed values of the format.
FIELDS = {"day": (3, 8), "symbol": (13, 12), "market": (25, 3), "open": (57, 13), "high": (70, 13), "low": (83, 13), "close": (109, 13), "trade_count": (148, 5), "volume": (153, 18), "strike": (189, 13), "expiry": (203, 8)}
PRICES = ("open", "high", "low", "close", "strike")


def _number(text: Column) -> Column:
    """Blank is 0."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")).try_cast("bigint"), F.lit(0))


def _zipped(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the first .txt member of each archive; an archive is one task's work and is read line by line."""

    def lines(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = [n for n in archive.namelist() if n.lower().endswith(".txt")]
                    if not names:
                        raise ValueError("no .txt in the archive")
                    with archive.open(names[0]) as member:
                        while some := list(islice(member, 50_000)):
                            yield pd.DataFrame({"value": [x.decode("latin-1").rstrip("\r\n") for x in some]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "value string")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Data records (start 01, 245 characters at least) with typed fields; prices have two implied decimals.

    A path that ends in .zip is read from its first .txt member. A field that can't be read is null (numbers: 0).
    """
    text = _zipped(spark, path) if path.lower().endswith(".zip") else spark.read.option("encoding", "ISO-8859-1").text(path)
    lines = text.where("value LIKE '01%' AND length(value) >= 245")
    part = {name: F.substring("value", at, n) for name, (at, n) in FIELDS.items()}
    columns = {name: (_number(x) / 100.0).cast("double") for name, x in part.items() if name in PRICES} | {name: _number(part[name]) for name in ("trade_count", "volume")}
    return lines.select(
        F.try_to_timestamp(part["day"], F.lit("yyyyMMdd")).cast("date").alias("trade_date"),
        F.upper(F.trim(part["symbol"])).alias("symbol"),
        part["market"].try_cast("int").alias("market"),
        F.try_to_timestamp(F.nullif(F.trim(part["expiry"]), F.lit("")), F.lit("yyyyMMdd")).cast("date").alias("expiration_date"),
        *[x.alias(n) for n, x in columns.items()],
    )


def spot(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Bars of the cash market (10) of symbols in ``universe`` (ticker)."""
    known = universe.select(F.upper("ticker").alias("ticker")).distinct()
    bars = rows.where("market = 10").select(F.col("symbol").alias("ticker"), "trade_date", "open", "high", "low", "close", "volume", "trade_count")
    return bars.join(known, "ticker", "left_semi")


def options(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Bars of calls (70) and puts (80) whose first four characters are a root of ``universe``; a blank expiry is left out."""
    roots = universe.select(F.substring(F.upper("ticker"), 1, 4).alias("underlying_root")).distinct()
    side = F.when(F.col("market") == 70, "call").otherwise("put")
    bars = rows.where("market IN (70, 80) AND expiration_date IS NOT NULL").select(F.col("symbol").alias("option_symbol"), F.substring("symbol", 1, 4).alias("underlying_root"), side.alias("option_side"), "trade_date", "expiration_date", F.col("strike").alias("strike_price"), "open", "high", "low", "close", "volume", "trade_count")
    return bars.join(roots, "underlying_root", "left_semi")


def universe_csv(spark: SparkSession, path: str, limit: int | None = None, suffix: str = "") -> DataFrame:
    """Distinct tickers of a CSV with a Ticker column, in the file's order, the first ``limit``; ``suffix`` is added where it lacks."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[c.removeprefix("\ufeff").strip() for c in df.columns])
    if "Ticker" not in df.columns:
        raise ValueError(f"no column Ticker in {path}")
    bare = F.upper(F.trim("Ticker"))
    name = F.when(bare.endswith(suffix), bare).otherwise(F.concat(bare, F.lit(suffix)))
    rows = df.where(bare != "").select(name.alias("ticker"), F.monotonically_increasing_id().alias("place"))
    first = rows.groupBy("ticker").agg(F.min("place").alias("place")).orderBy("place")
    return (first if limit is None else first.limit(limit)).select("ticker")


def universe_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct tickers of a list: comments and blank lines go, a leading dash too; the first token counts."""
    token = F.regexp_extract("value", r"^[\s\-]*([^\s`|,;]+)", 1)
    return spark.read.text(path).where(~F.trim("value").startswith("#")).select(F.upper(token).alias("ticker")).where("ticker <> ''").distinct()
