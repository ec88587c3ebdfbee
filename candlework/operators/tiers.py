"""Reports in tiers on the trades of mined patterns: accurate, free, elite, listed, block and per ticker.

Each picks patterns by its limits, then tickers of these patterns by theirs, then sums what is left per ticker. Inputs are
``patterns.report`` or ``patterns.measures`` (one row a pattern) and ``records`` (one row a pattern and ticker). Orders are
whole, ties by template and itemset, so reruns agree; only lists that are a top-k by their nature are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlework.operators import patterns
from candlework.operators.patterns import KEY, NUDGE, passes

# The defaults of the reports.
MOST_TARGET, TOP, TOP_BLOCK, TOP_SETS = 3.0, 10, 100, 15
FREE_TICKER = {"n": 15, "win": 60.0, "av": 1.0, "pf": 2.0}
ELITE_TICKER = {"n": 15, "success": 55.0, "av": 1.0, "pf": 1.5}
STRATEGY_LIST = {"success": 58.0, "pf": 2.0, "av": 1.0, "n": 80, "tickers": 8}
PER_STOCK = {"n": 20, "tp": 65.0, "win": 70.0, "av": 1.5, "pf": 2.5}
BLOCK = {"n": 300, "tickers": 50, "success": 85.0, "tp": 85.0, "pf": 2.5, "av": 0.45}
BLOCK_STOPS = 12.0


def _exact(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(28,6)")).cast("double")


def _more(least: float) -> dict[str, Column]:
    """A trade succeeds if it returns ``least`` percent."""
    return {"success": F.round(F.count_if(F.col("trade_return_pct") >= least) * 100.0 / F.count(F.lit(1)), 6)}


def records(trades: DataFrame, least: float = 0.0) -> DataFrame:
    """One row a pattern and ticker: measures, success rate, standard deviation, first and last day."""
    more = {"sd": F.round(F.stddev_pop("trade_return_pct"), 9), "first_date": F.min("trade_date"), "last_date": F.max("trade_date")}
    return patterns.measures(trades, (*KEY, "ticker"), **_more(least), **more).drop("tickers")


def whole(trades: DataFrame, least: float = 0.0) -> DataFrame:
    """One row a pattern: measures and success rate."""
    return patterns.measures(trades, KEY, **_more(least))


def percent(which: str) -> Column:
    """The target (tp) or stop (sl) in percent that a template's name states; 0 where it is a number of ATRs."""
    text = F.regexp_extract("template", f"_{which}([0-9]+(_[0-9]+)?)_", 1)
    return F.when(F.contains("template", F.lit("_atr_")), 0.0).otherwise(F.regexp_replace(text, "_", ".").try_cast("double"))


def accurate(scored: DataFrame, limits: dict = patterns.ACCURATE, most: float = MOST_TARGET, atr: bool = False) -> DataFrame:
    """Patterns with a target of at most ``most`` percent that pass, by accuracy. ATR targets count only if asked for."""
    fits = (F.col("target") > 0) | F.lit(atr)
    rows = scored.withColumns({"target": percent("tp"), "accuracy": patterns.accuracy()}).where(fits & (F.col("target") <= most) & passes(limits))
    return rows.orderBy(*[F.desc(c) for c in ("accuracy", "test_win", "test_tp", "win", "n")], *KEY)


def action_scores(rows: DataFrame) -> DataFrame:
    """Per ticker over its pattern rows: means, a score, and the pattern with the best win, hit rate, trades and average."""
    first = F.min(F.struct(*[(-F.col(c)).alias(c) for c in ("win", "tp", "n", "av")], *KEY)).alias("first")
    sums = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("patterns"), F.sum("n").alias("trades"), *[_exact(c).alias(c) for c in ("av", "win", "tp", "sl")], F.max("pf").alias("best_pf"), first)
    means = sums.withColumns({c: F.col(c) / F.col("patterns") for c in ("av", "win", "tp", "sl")})
    score = F.col("patterns") * 10 + F.col("trades") * 0.05 + F.col("win") * 1.5 + F.col("tp") * 1.2 + F.col("av") * 20 + F.least("best_pf", F.lit(20.0)) * 2 - F.col("sl") * 0.8
    shown = [F.round(F.col(c) + NUDGE, 4).alias(f"mean_{c}") for c in ("av", "win", "tp", "sl")]
    return means.select("ticker", "patterns", "trades", *shown, "best_pf", F.round(score + NUDGE, 4).alias("score"), F.col("first.template").alias("best_template"), F.col("first.itemset").alias("best_itemset")).orderBy(F.desc("score"), "ticker")


def _best_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*[F.desc(c) for c in ("av", "win", "pf", "n")], *KEY)


def free(patterns_: DataFrame, strict: dict = patterns.STRICT, robust: dict = patterns.ROBUST, aggressive: dict = patterns.AGGRESSIVE, top: int = TOP) -> DataFrame:
    """Strict patterns that are robust or aggressive, a row for each tier; ``leads`` marks the first ``top`` of the robust."""
    base = patterns_.where(passes(strict))
    sturdy = base.where(passes(robust))
    leads = _best_first(sturdy).limit(top).select(*KEY, F.lit(True).alias("leads"))
    marked = sturdy.join(F.broadcast(leads), list(KEY), "left").withColumn("leads", F.coalesce("leads", F.lit(False)))  # top rows
    bold = base.where(passes(aggressive)).withColumn("leads", F.lit(False))
    both = marked.withColumn("tier", F.lit("robust")).unionByName(bold.withColumn("tier", F.lit("aggressive")))
    return both.select("tier", *KEY, "n", "tickers", "win", "av", "net", "pf", "leads")


def qualified(rows: DataFrame, chosen: DataFrame, limits: dict) -> DataFrame:
    """The chosen patterns' ticker rows that pass and earn."""
    return rows.join(chosen.select(*KEY), list(KEY), "left_semi").where(passes(limits) & (F.col("net") > 0))


def roll_up(rows: DataFrame, rate: str) -> DataFrame:
    """Per ticker: patterns, trades, sum of nets, means of average and ``rate``, best profit factor and whose (ties: first pattern)."""
    first = F.min(F.struct((-F.col("pf")).alias("pf"), *KEY)).alias("first")
    sums = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("patterns"), F.sum("n").alias("trades"), *[_exact(c).alias(c) for c in ("net", "av", rate)], first)
    mean = lambda c: F.round(F.col(c) / F.col("patterns") + NUDGE, 4).alias(f"mean_{c}")
    out = sums.select("ticker", "patterns", "trades", "net", mean("av"), mean(rate), (-F.col("first.pf")).alias("best_pf"), F.col("first.template").alias("best_template"), F.col("first.itemset").alias("best_itemset"))
    return out.orderBy(F.desc("patterns"), F.desc("net"), F.desc("trades"), "ticker")


def per_stock(rows: DataFrame, limits: dict = PER_STOCK) -> DataFrame:
    """Ticker rows that pass, with their score; tickers with most patterns first, then by best average, a ticker's rows by score."""
    sharpe = F.when((F.col("n") > 1) & (F.col("sd") > 0), F.col("av") / F.col("sd")).otherwise(0.0)
    kept = rows.where(passes(limits)).withColumn("sharpe", F.round(sharpe, 6))
    score = 3 * F.col("tp") + 25 * F.col("av") + 10 * F.least("pf", F.lit(8.0)) + 5 * F.ln("n") + 15 * F.col("sharpe")
    kept = kept.withColumn("score", F.round(score + NUDGE, 4))
    of = kept.groupBy("ticker").agg(F.count(F.lit(1)).alias("patterns"), F.max("av").alias("best_av"))
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("score"), *KEY))
    out = kept.withColumn("place", place).join(of, "ticker")
    return out.select("ticker", "patterns", "best_av", "place", *KEY, "n", "tp", "win", "av", "net", "pf", "sharpe", "score", "first_date", "last_date").orderBy(F.desc("patterns"), F.desc("best_av"), "ticker", "place")


def block(patterns_: DataFrame, limits: dict = BLOCK, stops: float = BLOCK_STOPS, entry: str | None = None, size: int | None = None, targets: tuple[float, float] = (0.0, 99.0), stop: float = 99.0, top: int = TOP_BLOCK) -> DataFrame:
    """The first ``top`` patterns by the operational score, of one entry rule or size if asked for."""
    cols = {"entry_rule": F.split_part("template", F.lit("_"), F.lit(3)), "states": states(), "target": percent("tp"), "stop": percent("sl")}
    fits = passes(limits) & (F.col("sl") <= stops) & F.col("target").between(*targets) & (F.col("stop") <= stop)
    fits = fits if entry is None else fits & (F.col("entry_rule") == entry)
    fits = fits if size is None else fits & (F.col("states") == size)
    score = 2.6 * F.col("tp") + 1.7 * F.col("success") + 18 * F.least("pf", F.lit(10.0)) + 24 * F.col("av") - 1.3 * F.col("sl") + 14 * F.log10(F.greatest("n", F.lit(1))) + 10 * F.log10(F.greatest("tickers", F.lit(1)))
    rows = patterns_.withColumns(cols).where(fits).withColumn("score", F.round(score + NUDGE, 4))
    kept = rows.orderBy(*[F.desc(c) for c in ("score", "tp", "pf", "av", "n")], *KEY).limit(top)
    return kept.select(*KEY, "entry_rule", "states", "target", "stop", "n", "tickers", "tp", "success", "sl", "av", "pf", "score")


def states() -> Column:
    """How many states an itemset holds: items are its digits to the base of 1024."""
    return F.lit(1) + (F.col("itemset") >= 1 << 10).cast("int") + (F.col("itemset") >= 1 << 20).cast("int")


def feature_set(names: list[str]) -> Column:
    """The features of an itemset by name; an item is 16 * feature + state + 1."""
    known, item = F.array(*[F.lit(n) for n in names]), lambda shift: F.shiftright("itemset", shift).bitwiseAND(F.lit(1023))
    name = lambda shift: F.when(item(shift) > 0, F.get(known, F.shiftright(item(shift) - 1, 4).cast("int")))
    return F.concat_ws(" ", name(0), name(10), name(20))


def block_counts(rows: DataFrame, names: list[str], most: int = TOP_SETS) -> DataFrame:
    """How often entry rules, targets and (the ``most`` commonest) sets of features occur in a block: what, value, patterns."""
    tables = []
    for what, value in {"entry_rule": F.col("entry_rule"), "target": F.col("target").cast("decimal(9,2)").cast("string"), "features": feature_set(names)}.items():
        counts = rows.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("patterns")).select(F.lit(what).alias("what"), "value", "patterns")
        tables.append(counts.orderBy(F.desc("patterns"), "value").limit(most) if what == "features" else counts)
    return tables[0].unionByName(tables[1]).unionByName(tables[2])
