"""Readers of what earlier runs wrote, and the small parsers of pattern codes and texts."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands for an infinite number where only finite ones can be written.
INFINITE = 9999.0
#: Names under which reports carry the same measure, best first: fixed values.
ALIASES = {
    "take_profit_pct": ("take_profit_pct", "target_pct"),
    "stop_loss_pct": ("stop_loss_pct", "stop_pct"),
    "total_trades": ("total_trades", "trades"),
    "success_rate_pct": ("success_rate_pct", "profitable_rate_pct"),
    "profitable_trade_rate_pct": ("profitable_trade_rate_pct", "profitable_rate_pct"),
    "average_success_rate_pct": ("average_success_rate_pct", "average_profitable_trade_rate_pct"),
    "elite_strategies_count": ("elite_strategies_count", "strategies_count"),
}


def number(text: Column, infinite: float = INFINITE) -> Column:
    """Blank, null and None are 0; what is not finite is ``infinite``; anything else that is no number is null."""
    bare = F.trim(text)
    value = F.when(F.upper(bare).isin("INF", "+INF", "INFINITY"), F.lit(float("inf"))).otherwise(bare.try_cast("double"))
    finite = F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(infinite)).otherwise(value)
    return F.when(F.coalesce(bare, F.lit("")).isin("", "None"), F.lit(0.0)).otherwise(finite)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every column a text; a byte order mark is no part of the first name."""
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    return df.toDF(*[c.removeprefix("\ufeff") for c in df.columns])


def summary(spark: SparkSession, path: str, labels: tuple[str, ...] = ("code", "label", "family")) -> DataFrame:
    """A summary written by an earlier run, typed again: counts and measures are numbers, INF infinite, blank null."""
    df = texts(spark, path)

    def typed(c: str) -> Column:
        if c.endswith("_date"):
            return F.to_date(F.nullif(F.trim(c), F.lit(""))).alias(c)
        if re.search(r"(_pct|_factor|_return|score)$", c):
            return F.when(F.coalesce(F.trim(c), F.lit("")) == "", None).otherwise(number(F.col(c), float("inf"))).alias(c)
        if re.search(r"(^total_|trades$|tickers|_count$|_days$|^state_size$|occurrences)", c) and c not in labels:
            return F.trim(c).try_cast("double").cast("bigint").alias(c)
        return F.col(c)

    return df.select(*[typed(c) for c in df.columns])


def registry(spark: SparkSession, path: str) -> DataFrame:
    """strategy_code, status, reasons and trades of tested strategies; no file is an empty registry."""
    schema = "strategy_code string, status string, reasons string, trades bigint"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    df = texts(spark, path)
    return df.select("strategy_code", "status", F.coalesce("reasons", F.lit("")).alias("reasons"), F.col("trades").try_cast("bigint").alias("trades"))


def tolerant(df: DataFrame, wanted: tuple[str, ...], names: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """Numbers under their first name, from whichever column holds them: the first that is there and not blank."""
    out = []
    for w in wanted:
        there = [F.nullif(F.trim(c), F.lit("")) for c in names.get(w, (w,)) if c in df.columns]
        out.append(number(F.coalesce(*there) if there else F.lit(None).cast("string")).alias(w))
    return df.withColumns({w: c for w, c in zip(wanted, out, strict=True)})


def trades_of(spark: SparkSession, path: str, codes: DataFrame) -> DataFrame:
    """Rows of a trades CSV whose strategy_code is in ``codes``, in one pass."""
    return texts(spark, path).join(codes.select("strategy_code").distinct(), "strategy_code", "left_semi")


def history(bars: DataFrame, window: int, least: int = 3) -> DataFrame:
    """The last ``window`` bars of each ticker that has ``least``; a missing adjusted close is the close."""
    from pyspark.sql import Window

    newest = Window.partitionBy("ticker").orderBy(F.desc("trade_date"))
    rows = bars.withColumn("adj_close", F.coalesce("adj_close", "close")).withColumn("i", F.row_number().over(newest)).where(F.col("i") <= window)
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ticker"))).where(F.col("n") >= least).drop("i", "n")


def years(given: list[int] | None = None, today: dt.date | None = None) -> list[int]:
    """The years of a load: those asked for, else the last one and this one."""
    now = (today or dt.date.today()).year
    return sorted(set(given)) if given else [now - 1, now]


def missing_years(wanted: list[int], files: list[str]) -> list[int]:
    """Years that no file's stem names."""
    stems = [re.sub(r"\.[^.]*$", "", f.rsplit("/", 1)[-1]) for f in files]
    return [y for y in wanted if not any(str(y) in s for s in stems)]


def window(days: int = 365, end: dt.date | None = None) -> tuple[dt.date, dt.date]:
    """First and last day of a study: the last year up to today unless an end is given."""
    end = end or dt.date.today()
    return end - dt.timedelta(days), end


def pair(text: str) -> tuple[float, float]:
    """Target and stop of "2:1"; both are over 0."""
    parts = text.split(":")
    if len(parts) != 2:
        raise ValueError(f"not target:stop: {text!r}")
    target, stop = map(float, parts)
    if target <= 0 or stop <= 0:
        raise ValueError(f"target and stop must be over 0: {text!r}")
    return target, stop


def ticker(text: Column, suffix: str = ".SA") -> Column:
    """Upper case with the market's suffix; blank raises."""
    bare = F.upper(F.trim(text))
    return F.when(bare == "", F.raise_error(F.lit("blank ticker"))).when(bare.endswith(suffix), bare).otherwise(F.concat(bare, F.lit(suffix)))


def root(text: Column, suffix: str = ".SA") -> Column:
    return F.substring(F.regexp_replace(F.upper(F.trim(text)), re.escape(suffix) + "$", ""), 1, 4)


def conditions(code: Column) -> Column:
    """The states of a pattern code as (key, state), in order."""
    tail = F.regexp_extract(code, r"__[0-9]+f__(.*)$", 1)
    parts = F.filter(F.split(tail, "__"), lambda p: p.rlike("^[^=]+=.+$"))
    return F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_extract(p, "^[^=]+=(.*)$", 1).alias("state")))


def template(code: Column) -> Column:
    return F.regexp_extract(code, r"^(.*?)__[0-9]+f__", 1)


def signature(code: Column) -> Column:
    """What a pattern asks for, whatever its template: its states joined by ;"""
    return F.array_join(F.transform(conditions(code), lambda c: F.concat_ws("=", c["key"], c["state"])), "; ")


def keys(code: Column) -> Column:
    return F.array_join(F.transform(conditions(code), lambda c: c["key"]), ",")


def retarget(code: Column, target: float, stop: float) -> Column:
    """A pattern code with another target and stop in its template."""
    show = lambda x: f"{x:.1f}".rstrip("0").rstrip(".").replace(".", "_")
    return F.regexp_replace(code, "_tp[0-9]+(_[0-9]+)?_sl[0-9]+(_[0-9]+)?", f"_tp{show(target)}_sl{show(stop)}")


def sentence(direction: Column, entry: Column, target: Column, stop: Column, days: Column) -> Column:
    """How a signal is traded, in words (fixed text)."""
    return F.format_string("%s no %s, alvo de +%.1f%% e stop de -%.1f%% com limite maximo de %d dias.", F.when(direction == "long", "Comprar").otherwise("Vender"), entry, target, stop, days)
