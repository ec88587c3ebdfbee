"""The monitor's payload: signals in their order, counters of strategies, triggered and operational tickers, as nested JSON.

Built on patterns.signals. Lists that are cut (top tickers) are sorted and limited, never gathered; the
payload is a row a signal, strategy or ticker, each a JSON object of its section, so it can be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlework.operators.patterns import KEY, NUDGE

#: Signals that make a ticker operational, and how long the lists of tickers are (fixed values).
LEAST, TOP, CARDS = 3, 20, 12


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def ordered(signals: DataFrame) -> DataFrame:
    """Signals in their order: qualified first, then by the strategy's and the ticker's own average."""
    return signals.orderBy(F.desc("qualified"), F.desc("av"), _zero("ticker_av").desc(), "ticker", *KEY)


def marked(signals: DataFrame) -> DataFrame:
    """Signals with whether their ticker is operational and the score that picks a ticker's best."""
    score = 100 * F.col("av") + 2 * F.col("win") + 5 * F.least(_zero("pf"), F.lit(20.0)) + 0.03 * F.col("n") + 25 * F.col("ticker_signals")
    return signals.withColumn("operational", F.col("ticker_signals") >= LEAST).withColumn("operational_score", F.round(score + NUDGE, 4))


def counters(strategies: DataFrame, signals: DataFrame) -> DataFrame:
    """Every monitored strategy with its triggered, qualified and operational signals; most triggered first."""
    fired = marked(signals).groupBy(*KEY).agg(F.count(F.lit(1)).alias("triggered"), F.count_if("qualified").alias("qualified"), F.count_if("operational").alias("operational"))
    none = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("triggered", "qualified", "operational")}
    rows = strategies.select(*KEY, "n", "tickers", "win", "av", "net", "pf").join(fired, list(KEY), "left").withColumns(none)
    return rows.orderBy(F.desc("triggered"), F.desc("av"), F.desc("net"), *KEY)


def triggered(signals: DataFrame, top: int = TOP) -> DataFrame:
    """The tickers with most signals, ties by name."""
    rows = signals.groupBy("ticker").agg(F.count(F.lit(1)).alias("signals"))
    return rows.withColumn("operational", F.col("signals") >= LEAST).orderBy(F.desc("signals"), "ticker").limit(top)


def best(signals: DataFrame, top: int = TOP) -> DataFrame:
    """The best signal of each operational ticker, ties in the order of signals; the tickers with most signals first."""
    first = F.min(F.struct((-F.col("operational_score")).alias("s"), (~F.col("qualified")).alias("q"), (-F.col("av")).alias("a"), (-_zero("ticker_av")).alias("t"), *KEY))
    rows = marked(signals).where("operational").groupBy("ticker").agg(F.count(F.lit(1)).alias("signals"), first.alias("best"))
    return rows.select("ticker", "signals", (-F.col("best.s")).alias("operational_score"), F.col("best.template").alias("template"), F.col("best.itemset").alias("itemset")).orderBy(F.desc("signals"), F.desc("operational_score"), "ticker").limit(top)


def cards(signals: DataFrame, text: str = "", entry: str | None = None, top: int = CARDS) -> DataFrame:
    """What the viewer shows first: the best signal of each operational ticker by ``score`` and how many confirm it.

    ``entry`` keeps signals of one entry rule; ``text`` must stand in ticker or template, in any case.
    """
    rows = marked(signals).where("operational")
    if text:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "ticker", "template")), F.lit(text.lower())))
    if entry:
        rows = rows.where(F.split_part("template", F.lit("_"), F.lit(3)) == entry)
    one = rows.groupBy("ticker").agg(F.min(F.struct((-F.col("score")).alias("s"), *KEY)).alias("b"), F.count(F.lit(1)).alias("confirming"))
    return one.select("ticker", F.col("b.template").alias("template"), F.col("b.itemset").alias("itemset"), (-F.col("b.s")).alias("score"), "confirming").orderBy(F.desc("score"), "ticker").limit(top)


def header(strategies: DataFrame, signals: DataFrame, bars: DataFrame, as_of: str | None = None, least_bars: int = 70) -> DataFrame:
    """One row of counts. A ticker belongs to the universe if it has enough bars and one up to ``as_of``."""
    seen = F.lit(True) if as_of is None else F.col("trade_date") <= F.lit(as_of).cast("date")
    tickers = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(seen, F.col("trade_date"))).alias("last")).where(f"n >= {least_bars} and last is not null")
    universe = tickers.agg(F.max("last").alias("latest_trade_date"), F.count(F.lit(1)).alias("universe_size"))
    available = strategies.agg(F.count(F.lit(1)).alias("strategies"))
    by_ticker = marked(signals).groupBy("ticker").agg(F.count(F.lit(1)).alias("s"), F.count_if("qualified").alias("q"), F.max("operational").alias("o"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    fired = by_ticker.agg(zero(F.sum("s")).alias("signals"), zero(F.sum("q")).alias("qualified"), F.count_if("o").alias("operational_tickers"), zero(F.sum(F.when(F.col("o"), F.col("s")))).alias("operational"), F.count(F.lit(1)).alias("triggered_tickers"))
    return universe.crossJoin(available).crossJoin(fired)  # three single rows


def payload(strategies: DataFrame, signals: DataFrame, bars: DataFrame, tickers: DataFrame, overall: DataFrame, as_of: str | None = None) -> DataFrame:
    """section, place and body (JSON): header, top_triggered_tickers, top_operational_tickers, strategies, signals.

    ``tickers`` are per-pattern ticker records, ``overall`` the tickers' roll-up (patterns.actions); an absent one is null in
    the object. place counts within the cut lists and the header; other sections are ordered by what is in the body.
    """
    json = lambda section, df, place=None: df.select(F.lit(section).alias("section"), (F.lit(None).cast("int") if place is None else place).alias("place"), F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("body"))
    whole = overall.select("ticker", F.struct(*[c for c in overall.columns if c != "ticker"]).alias("overall"))
    listed = lambda df, order: df.join(whole, "ticker", "left").withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))  # noqa: E731  TOP rows
    top = listed(triggered(signals), (F.desc("signals"), "ticker"))
    first = listed(best(signals), (F.desc("signals"), F.desc("operational_score"), "ticker"))
    metrics = F.struct("n", "tickers", "win", "av", "net", "pf").alias("metrics")
    own = tickers.select(*KEY, "ticker", F.struct("n", "tp", "win", "av", "net", "pf", "first_date", "last_date").alias("ticker_metrics"))
    price = bars.select("ticker", "trade_date", F.struct("open", "high", "low", "close", "volume").alias("price_snapshot"))
    full = marked(signals).select(*KEY, "ticker", "trade_date", "qualified", "operational", "ticker_signals").join(strategies.select(*KEY, metrics.alias("strategy_metrics")), list(KEY)).join(own, [*KEY, "ticker"], "left").join(whole, "ticker", "left").join(price, ["ticker", "trade_date"], "left")
    full = full.withColumn("signal_id", F.concat_ws("-", "ticker", "trade_date", "template", "itemset"))
    counted = counters(strategies, signals).select(*KEY, metrics, "triggered", "qualified", "operational")
    out = json("header", header(strategies, signals, bars, as_of), F.lit(1))
    for section, df in (("top_triggered_tickers", top), ("top_operational_tickers", first)):
        out = out.unionByName(json(section, df, F.col("place")))
    return out.unionByName(json("strategies", counted)).unionByName(json("signals", full))
