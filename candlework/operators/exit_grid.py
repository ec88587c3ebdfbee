"""Other targets and stops for the states of mined patterns.

Each base (a template and an itemset) keeps its states and its entry; every bar on which the states hold is traded
again, long, with each pair of the grid and five bars at most. A base that sold is traded long too, as in the report that this
stands for. Sums are taken per ticker first, as decimals; both levels are finished from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlework.operators import counting, exits, mining
from candlework.operators.patterns import KEY, NUDGE, passes

# The grid of targets and stops, and the limits of what is final.
PAIRS = (
    (1.0, 1.0), (1.0, 2.0), (1.0, 3.0), (1.0, 4.0),
    (2.0, 1.0), (2.0, 2.0), (2.0, 3.0), (2.0, 4.0),
    (3.0, 1.0), (3.0, 1.5), (3.0, 2.0), (3.0, 3.0), (3.0, 4.0),
    (4.0, 2.0), (4.0, 3.0), (4.0, 4.0),
    (5.0, 2.5), (5.0, 3.0), (5.0, 4.0),
    (6.0, 3.0), (6.0, 4.0),
    (7.0, 3.5), (7.0, 4.0),
    (8.0, 4.0),
)
FINAL = {"n": 300, "tickers": 50, "target": 2.0, "tp": 50.0, "av": 1.0, "pf": 2.0}
FINAL_TICKER = {"n": 15, "tp": 50.0, "av": 1.0, "pf": 2.0}

TEMPLATES = exits.percent_templates(("open", "close"), ("long",), PAIRS)


def variants(states: DataFrame, samples: DataFrame, base: DataFrame, places: list[int], sizes=(1, 2)) -> DataFrame:
    """Sums per base, target, stop and ticker. ``samples`` are trades of TEMPLATES, ``base`` has template and itemset."""
    named = base.select(*KEY, F.split_part("template", F.lit("_"), F.lit(3)).alias("entry_rule"))
    sets = F.explode(F.concat(*[mining.itemsets(k, places) for k in sizes])).alias("itemset")
    held = counting.spread(states).select("ticker", "trade_date", "entry_rule", sets).join(named, ["itemset", "entry_rule"])
    pair = F.create_map(*[F.lit(x) for t in TEMPLATES for x in (t["template"], F.struct(F.lit(t["tp"]).alias("target"), F.lit(t["sl"]).alias("stop")))])
    trades = samples.select("ticker", "trade_date", "entry_rule", pair[F.col("template")].alias("p"), "exit_reason", F.col("trade_return_pct").cast("decimal(18,9)").alias("x"))
    x, why = F.col("x"), F.col("exit_reason")
    count = lambda when, name: F.count_if(when).alias(name)
    total = lambda when, y, name: F.sum(F.when(when, y).otherwise(F.lit(0).cast("decimal(18,9)"))).alias(name)
    sums = [F.count(F.lit(1)).alias("n"), count(why == "take_profit", "tps"), count(F.startswith(why, F.lit("stop_loss")), "sls"), count(why == "time_cap", "caps"), count(x > 0, "wins"), F.sum(x).alias("net"), total(x > 0, x, "gp"), total(x < 0, -x, "gl")]
    return held.join(trades, ["ticker", "trade_date", "entry_rule"]).groupBy(*KEY, F.col("p.target").alias("target"), F.col("p.stop").alias("stop"), "ticker").agg(*sums)


def _measures(extra: list[Column]) -> list[Column]:
    net, gp, gl = (F.col(c).cast("double") for c in ("net", "gp", "gl"))
    pf = F.when(gl > 0, F.least(gp / gl, F.lit(9999.0))).when(gp > 0, 9999.0).otherwise(0.0)
    rates = [F.round(F.col(c) * 100.0 / F.col("n"), 6).alias(a) for c, a in (("tps", "tp"), ("sls", "sl"), ("caps", "cap"), ("wins", "win"))]
    return [*KEY, "target", "stop", *extra, "n", *rates, F.round(net / F.col("n") + 0.0, 6).alias("av"), F.round(net + 0.0, 6).alias("net"), F.round(pf, 6).alias("pf")]


def by_ticker(sums: DataFrame, limits: dict = FINAL_TICKER) -> DataFrame:
    """Measures of every base, pair and ticker, and whether the ticker is over its limits."""
    return sums.select(*_measures([F.col("ticker")])).withColumn("passes", passes(limits))


def strategies(sums: DataFrame, limits: dict = FINAL) -> DataFrame:
    """Measures of every base and pair, the score, whether it is final, and its place among the pairs of its base.

    The place goes by score; ties to the smaller target, then the smaller stop.
    """
    total = sums.groupBy(*KEY, "target", "stop").agg(F.count(F.lit(1)).alias("tickers"), *[F.sum(c).alias(c) for c in ("n", "tps", "sls", "caps", "wins", "net", "gp", "gl")])
    rows = total.select(*_measures([F.col("tickers")]))
    score = F.col("tp") * 2.5 + F.col("av") * 35 + F.least(F.col("pf"), F.lit(8.0)) * 8 + F.col("target") * 8 - F.col("sl") * 1.2
    order = Window.partitionBy(*KEY).orderBy(F.desc("score"), "target", "stop")
    return rows.withColumn("score", F.round(score + NUDGE, 4)).withColumn("passes", passes(limits)).withColumn("place", F.row_number().over(order))


def final_tickers(sums: DataFrame, limits: dict = FINAL, ticker_limits: dict = FINAL_TICKER) -> DataFrame:
    """Ticker rows over their limits, of bases and pairs that are final."""
    final = strategies(sums, limits).where("passes").select(*KEY, "target", "stop")
    return by_ticker(sums, ticker_limits).where("passes").drop("passes").join(final, [*KEY, "target", "stop"], "left_semi")
