"""Trades of mined patterns, and the reports that are made from them.

A pattern is a template and an itemset. ``trades`` has template, itemset, ticker, trade_date, exit_date, exit_reason and
trade_return_pct of every trade of the patterns that a gate approved. Returns have nine digits and are summed as
decimals, so that sums do not turn on the order of addition. Reports take their thresholds as parameters: REPORT,
ELITE, ACCURATE, OPERATIONAL and LISTED are the defaults, LOW a preset that tables of noise can pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlework.operators import counting, mining

KEY = ("template", "itemset")
#: Scores of six-digit numbers can end in a five; with this added such a tie goes up in any engine.
NUDGE = 1e-9

# The defaults of the reports.
REPORT = {"train": {"n": 15, "tp": 55.0, "win": 58.0, "av": 0.80, "pf": 1.8}, "test": {"n": 10, "tp": 50.0, "win": 55.0, "av": 0.50, "pf": 1.5}, "ticker": {"n": 12, "tp": 60.0, "win": 60.0, "av": 1.0, "pf": 2.0}, "p": 0.05}
SHORTLIST = {"tp": 60.0, "win": 60.0, "av": 1.0, "pf": 2.0}
ELITE = {"n": 200, "tickers": 50, "tp": 65.0, "win": 70.0, "av": 1.3, "pf": 2.5, "test_tp": 70.0, "test_av": 2.0}
ACCURATE = {"n": 200, "tickers": 50, "win": 75.0, "tp": 70.0, "pf": 2.5, "av": 1.0, "test_n": 25, "test_win": 85.0, "test_tp": 80.0, "test_pf": 4.0, "test_av": 1.5}
OPERATIONAL = {"pattern": {"n": 300, "tickers": 50, "win": 65.0, "av": 1.5, "pf": 2.5}, "ticker": {"n": 15, "win": 65.0, "av": 1.5, "pf": 2.5}, "qualified": 3}
STRICT = {"win": 60.0, "av": 1.0, "pf": 2.0, "n": 80, "tickers": 8}
ROBUST = {"n": 300, "tickers": 50}
AGGRESSIVE = {"win": 70.0, "av": 1.5, "pf": 3.0, "n": 80, "tickers": 25}
LISTED = {"win": 58.0, "pf": 2.0, "av": 1.0, "n": 80, "tickers": 8}
#: For tables in which nothing is to be found.
LOW = {"n": 80, "tickers": 8, "win": 45.0, "av": 0.0, "pf": 1.0}
LOW_TICKER = {"n": 5, "win": 50.0, "av": 0.0, "pf": 1.0}


def passes(limits: dict, prefix: str = "") -> Column:
    """Every named measure is at its limit or over it; null is not."""
    out = F.lit(True)
    for name, least in limits.items():
        out = out & F.coalesce(F.col(prefix + name) >= least, F.lit(False))
    return out


def trades(states: DataFrame, samples: DataFrame, approved: DataFrame, places: list[int], sizes=(1, 2)) -> DataFrame:
    """All trades of approved patterns: states are exploded once and meet approved itemsets before they meet samples."""
    sets = F.concat(*[mining.itemsets(k, places) for k in sizes])
    wanted = approved.select(*KEY)
    exploded = counting.spread(states).select("ticker", "trade_date", "entry_rule", F.explode(sets).alias("itemset")).join(wanted, "itemset")
    keep = ["template", "ticker", "trade_date", "entry_rule", "exit_date", "exit_reason", "trade_return_pct"]
    return exploded.join(samples.select(*keep), ["template", "ticker", "trade_date", "entry_rule"]).select(*KEY, "ticker", "trade_date", "exit_date", "exit_reason", "trade_return_pct")


def _sum(x: Column, when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, x.cast("decimal(18,9)"))).cast("double"), F.lit(0.0))


def measures(df: DataFrame, group: tuple[str, ...], periods: dict[str, Column] | None = None, **more: Column) -> DataFrame:
    """Per group and period (a prefix and a condition): n, tp, win, sl, cap (rates), av, net and pf; ``more`` aggregates by name.

    A profit factor without losses is 9999, of nothing 0; of a period without trades all but n and net are null.
    """
    x, sums, out = F.col("trade_return_pct"), [F.count_distinct("ticker").alias("tickers")], []
    for name, when in (periods or {"": F.lit(True)}).items():
        sums += [F.count_if(when).alias(f"{name}n"), F.count_if(when & (F.col("exit_reason") == "take_profit")).alias(f"{name}tps"), F.count_if(when & F.startswith("exit_reason", F.lit("stop_loss"))).alias(f"{name}sls"), F.count_if(when & (F.col("exit_reason") == "time_cap")).alias(f"{name}caps"), F.count_if(when & (x > 0)).alias(f"{name}wins"), _sum(x, when).alias(f"{name}net0"), _sum(x, when & (x > 0)).alias(f"{name}gp"), _sum(-x, when & (x < 0)).alias(f"{name}gl")]
        n = F.nullif(F.col(f"{name}n"), F.lit(0))
        pf = F.when(n.isNull(), None).when(F.col(f"{name}gl") > 0, F.least(F.col(f"{name}gp") / F.col(f"{name}gl"), F.lit(9999.0))).when(F.col(f"{name}gp") > 0, 9999.0).otherwise(0.0)
        out += [F.col(f"{name}n"), F.col(f"{name}wins")]
        out += [F.round(F.col(f"{name}{c}") * 100.0 / n, 6).alias(f"{name}{alias}") for c, alias in (("tps", "tp"), ("wins", "win"), ("sls", "sl"), ("caps", "cap"))]
        out += [F.round(F.col(f"{name}net0") / n + 0.0, 6).alias(f"{name}av"), F.round(F.col(f"{name}net0") + 0.0, 6).alias(f"{name}net"), F.round(pf, 6).alias(f"{name}pf")]
    sums += [c.alias(name) for name, c in more.items()]
    return df.groupBy(*group).agg(*sums).select(*group, "tickers", *out, *more)


def by_ticker(df: DataFrame) -> DataFrame:
    """The ticker report of patterns: measures, compounded return (-100 once a trade loses all), first and last date.

    Its median column holds the average, as in the report that it stands for.
    """
    whole = measures(df, (*KEY, "ticker")).drop("tickers")
    m = 1 + F.col("trade_return_pct") / 100
    more = df.groupBy(*KEY, "ticker").agg(F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"), F.min(m).alias("least"), F.sum(F.when(m > 0, F.ln(m))).alias("logs"))
    compounded = F.when(F.col("least") <= 0, -100.0).otherwise((F.exp("logs") - 1) * 100)
    return whole.join(more.select(*KEY, "ticker", "first_date", "last_date", F.round(compounded, 4).alias("cumulative")), [*KEY, "ticker"]).withColumn("median", F.col("av"))


def report(df: DataFrame, split: str, limits: dict = REPORT) -> DataFrame:
    """Whole, train and test measures of every pattern, two one-sided tests at their normal quantile, the score."""
    late = F.col("trade_date") >= F.lit(split).cast("date")
    wide = measures(df, KEY, {"": F.lit(True), "train_": ~late, "test_": late})
    spread = df.groupBy(*KEY).agg(F.stddev_pop("trade_return_pct").alias("sd"))
    wide = wide.join(spread, list(KEY)).withColumn("sd", F.round("sd", 9))
    z_win = (F.col("wins") / F.col("n") - 0.5) / F.sqrt(0.25 / F.col("n"))
    z_mean = F.col("av") / (F.nullif(F.col("sd"), F.lit(0.0)) / F.sqrt("n"))
    edge = quantile(1 - limits["p"])
    sharpe = F.when((F.col("n") > 1) & (F.col("sd") > 0), F.col("av") / F.col("sd")).otherwise(0.0)
    score = 3 * F.col("tp") + 25 * F.col("av") + 10 * F.least(F.col("pf"), F.lit(8.0)) + 5 * F.ln("n") + 2 * F.least(F.col("tickers"), F.lit(50)) + 3 * (0.5 * F.coalesce("test_tp", F.lit(0.0)) + 20 * F.coalesce("test_av", F.lit(0.0))) + 15 * F.col("sharpe")
    flags = {"passes_train": passes(limits["train"], "train_"), "passes_test": passes(limits["test"], "test_"), "significant": (F.col("n") >= 5) & F.coalesce((z_win > edge) & (z_mean > edge), F.lit(False))}
    return wide.withColumns({"sharpe": F.round(sharpe, 6), **flags}).withColumn("score", F.round(score + NUDGE, 4)).drop("sd", "wins", "train_wins", "test_wins")


def quantile(p: float) -> float:
    from statistics import NormalDist

    return round(NormalDist().inv_cdf(p), 7)


def best_of_each_state(scored: DataFrame) -> DataFrame:
    """Of patterns with the same states the one with the best score; ties to the first template."""
    order = Window.partitionBy("itemset").orderBy(F.desc("score"), "template")
    return scored.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def accuracy() -> Column:
    """The score that weighs hits of the test period most."""
    score = F.col("test_win") * 3 + F.col("test_tp") * 2.5 + F.col("win") * 1.4 + F.col("tp") * 1.1 + F.col("test_av") * 12 + F.least(F.col("test_pf"), F.lit(20.0)) * 4 + F.log10(F.greatest("test_n", F.lit(1))) * 10 - F.col("sl") * 0.8 - F.col("test_sl") * 1.2
    return F.round(score + NUDGE, 4)


def filters(scored: DataFrame) -> DataFrame:
    """Which named filters each pattern passes, and the accuracy score."""
    tests = {"elite": ELITE, "accurate": ACCURATE, "strict": STRICT, "robust": STRICT | ROBUST, "aggressive": STRICT | AGGRESSIVE, "listed": LISTED, "low": LOW}
    return scored.select(*KEY, *[passes(limits).alias(name) for name, limits in tests.items()], accuracy().alias("accuracy"))


def operational(scored: DataFrame, tickers: DataFrame, limits: dict = OPERATIONAL) -> DataFrame:
    """Patterns over the limits with as many tickers over theirs, and a score of both."""
    good = tickers.where(passes(limits["ticker"]) & (F.col("net") > 0)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("qualified"))
    rows = scored.where(passes(limits["pattern"])).join(good.where(F.col("qualified") >= limits["qualified"]), list(KEY))
    score = F.col("av") * 25 + (F.col("win") - 50) * 1.5 + F.least(F.col("pf"), F.lit(8.0)) * 8 + F.least(F.log10(F.greatest("n", F.lit(1))), F.lit(3.0)) * 4 + F.least(F.log10(F.greatest("tickers", F.lit(1))), F.lit(2.0)) * 4 + F.col("qualified") * 5.5
    return rows.select(*KEY, "n", "tickers", "win", "av", "pf", "qualified", F.round(score + NUDGE, 4).alias("score"))


def actions(tickers: DataFrame, least: dict = LOW_TICKER) -> DataFrame:
    """Per ticker, over its pattern rows that pass: how many, their trades, mean of averages and of win rates, best profit factor and whose."""
    rows = tickers.where(passes(least))
    best = F.max(F.struct("pf", (-F.col("itemset")).alias("i"), F.col("template").alias("t")))
    out = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("patterns"), F.sum("n").alias("trades"), F.sum(F.col("av").cast("decimal(18,6)")).cast("double").alias("s"), F.sum(F.col("win").cast("decimal(18,6)")).cast("double").alias("w"), best.alias("best"))
    return out.select("ticker", "patterns", "trades", F.round(F.col("s") / F.col("patterns") + NUDGE, 4).alias("mean_av"), F.round(F.col("w") / F.col("patterns") + NUDGE, 4).alias("mean_win"), F.col("best.pf").alias("best_pf"), (-F.col("best.i")).alias("best_itemset"))


def target_hits(scored: DataFrame, tickers: DataFrame, hit: float = 18.0, ticker_n: int = 15, ticker_hit: float = 20.0) -> DataFrame:
    """How often each pattern reaches its target, and how many of its tickers do so over their limit."""
    good = tickers.where((F.col("n") >= ticker_n) & (F.col("tp") >= ticker_hit)).groupBy(*KEY).agg(F.count(F.lit(1)).alias("good_tickers"))
    return scored.join(good, list(KEY), "left").select(*KEY, "tp", (F.col("tp") >= hit).alias("hits"), F.coalesce("good_tickers", F.lit(0).cast("long")).alias("good_tickers"))


def signals(states: DataFrame, scored: DataFrame, tickers: DataFrame, places: list[int], as_of: str | None = None, sizes=(1, 2)) -> DataFrame:
    """Patterns whose states all hold on a ticker's last bar up to ``as_of``, with the pattern's and the ticker's own record.

    A ticker is qualified if it has traded the pattern. The score weighs both; ``place`` ranks a ticker's signals.
    """
    seen = states if as_of is None else states.where(F.col("trade_date") <= F.lit(as_of).cast("date"))
    newest = seen.groupBy("ticker").agg(F.max("trade_date").alias("trade_date"))
    last = seen.join(newest, ["ticker", "trade_date"])
    held = last.select("ticker", "trade_date", "entry_rule", F.explode(F.concat(*[mining.itemsets(k, places) for k in sizes])).alias("itemset"))
    fired = held.join(scored.select(*KEY, "n", "win", "av", "pf"), "itemset").where(F.contains("template", F.concat(F.lit("_"), "entry_rule", F.lit("_"))))
    own = tickers.select(*KEY, "ticker", F.col("n").alias("ticker_n"), F.col("win").alias("ticker_win"), F.col("av").alias("ticker_av"), F.col("pf").alias("ticker_pf"))
    rows = fired.join(own, [*KEY, "ticker"], "left").withColumn("qualified", F.col("ticker_n").isNotNull()).withColumn("ticker_signals", F.count(F.lit(1)).over(Window.partitionBy("ticker")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    score = 50 * F.col("ticker_signals") + 100 * zero("ticker_av") + 2 * zero("ticker_win") + 5 * F.least(zero("ticker_pf"), F.lit(20.0)) + 0.3 * F.least(F.coalesce("ticker_n", F.lit(0)), F.lit(120)) + 30 * F.col("av") + F.col("win")
    order = Window.partitionBy("ticker").orderBy(F.desc("score"), "template", "itemset")
    return rows.withColumn("score", F.round(score + NUDGE, 4)).withColumn("place", F.row_number().over(order)).select(*KEY, "ticker", "trade_date", "n", "win", "av", "pf", "ticker_n", "ticker_av", "qualified", "ticker_signals", "score", "place")


def validated(df: DataFrame, start: str, end: str) -> DataFrame:
    """Every pattern's measures over all days beside those of entries from ``start`` to ``end``; without any of these: zeros.

    States look back over the whole series; only entries are bounded, so nothing later than an entry is seen.
    """
    inside = F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    late = measures(df.where(inside), KEY).select(*KEY, *[F.col(c).alias(f"validation_{c}") for c in ("n", "tickers", "wins", "win", "av", "net", "pf")])
    whole = measures(df, KEY).select(*KEY, "n", "win", "av", "pf")
    counts, rates = ("n", "tickers", "wins"), ("win", "av", "net", "pf")
    zeros = {f"validation_{c}": F.coalesce(f"validation_{c}", F.lit(0).cast("long")) for c in counts} | {f"validation_{c}": F.coalesce(f"validation_{c}", F.lit(0.0)) for c in rates}
    return whole.join(late, list(KEY), "left").withColumns(zeros)


def leading(tickers: DataFrame, least: int, most: int) -> DataFrame:
    """The first ``most`` tickers of each pattern with ``least`` trades: by net, average and trades."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("net"), F.desc("av"), F.desc("n"), "ticker")
    return tickers.where(F.col("n") >= least).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def recurrence(tickers: DataFrame, least: int = 5, most: int = 5, top: int = 25) -> DataFrame:
    """The tickers that lead most patterns, and how often each is the first of them."""
    rows = leading(tickers, least, most).groupBy("ticker").agg(F.count(F.lit(1)).alias("patterns"), F.count_if(F.col("place") == 1).alias("firsts"))
    return rows.orderBy(F.desc("patterns"), "ticker").limit(top)


def ticker_totals(tickers: DataFrame, least: int = 5) -> DataFrame:
    """All patterns of a ticker together: how many, trades, sum of nets, mean of averages, best net; the largest sum first."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(28,6)")).cast("double")
    rows = tickers.where(F.col("n") >= least).groupBy("ticker").agg(F.count(F.lit(1)).alias("patterns"), F.sum("n").alias("trades"), exact("net").alias("net"), exact("av").alias("avs"), F.max("net").alias("best_net"))
    return rows.select("ticker", "patterns", "trades", "net", F.round(F.col("avs") / F.col("patterns") + NUDGE, 4).alias("mean_av"), "best_net").orderBy(F.desc("net"), F.desc("patterns"), F.desc("trades"), "ticker")
