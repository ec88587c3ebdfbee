"""Itemset mining: which combinations of one to three states go with good trades.

Every (ticker, date, entry rule) is one row with its states packed as small integers (16 * feature + step) and the
outcomes of all templates that traded then. Sums over all itemsets come from matrix products (see counting); they are
whole numbers, so they don't turn on the order of addition. Names are decoded only for what is returned. Three-state
sets grow only from promoted pairs of features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlework.functions import ladders, metrics
from candlework.functions.sql import r
from candlework.operators import counting

PRE_TRADES, PRE_WIN, PRE_FACTOR, PRE_PAIRS = 50, 55.0, 1.5, 150


def packed_states(values: DataFrame, keys: list[str], ladder) -> DataFrame:
    """ticker, trade_date, entry_rule and items: 16 * place + step of every defined feature, in library order."""
    items = [F.expr(ladders.position(ladder(k), k)) + 16 * i for i, k in enumerate(keys)]
    return values.select("ticker", "trade_date", "entry_rule", F.array_compact(F.array(*items)).alias("items"))


def with_outcomes(states: DataFrame, samples: DataFrame, templates: list[str]) -> DataFrame:
    """States with outcomes: (t, x, e) of every template that traded: its number, the return, how it went out."""
    number = (F.array_position(F.array(*map(F.lit, templates)), F.col("template")) - 1).cast("int")
    reason = F.when(F.col("exit_reason") == "take_profit", counting.TARGET).when(F.startswith("exit_reason", F.lit("stop_loss")), counting.STOP).when(F.col("exit_reason") == "time_cap", counting.CAP).otherwise(0)
    traded = samples.where("trade_return_pct is not null").select("ticker", "trade_date", "entry_rule", F.struct(number.alias("t"), F.col("trade_return_pct").alias("x"), reason.alias("e")).alias("o")).where("o.t >= 0")
    outcomes = traded.groupBy("ticker", "trade_date", "entry_rule").agg(F.collect_list("o").alias("outcomes"))  # one a template at most
    return states.join(outcomes, ["ticker", "trade_date", "entry_rule"])


def with_columns(states: DataFrame, samples: DataFrame, templates: list[str]) -> DataFrame:
    """States with, per template, columns of the return and whether the target was hit; null where there was no trade."""
    wide = samples.groupBy("ticker", "trade_date", "entry_rule").agg(*[x for i, t in enumerate(templates) for x in (F.max(F.when(F.col("template") == t, F.col("trade_return_pct"))).alias(f"r{i}"), F.max(F.when(F.col("template") == t, (F.col("exit_reason") == "take_profit").cast("int"))).alias(f"h{i}"))])
    return states.join(wide, ["ticker", "trade_date", "entry_rule"])


def itemsets(size: int, pairable: list[int], promoted: list[tuple[int, int]] | None = None):
    """A column of packed itemsets (10 bits an item, first item lowest, plus one) of just ``size`` states."""
    if size == 1:
        return F.transform("items", lambda x: (x + 1).cast("long"))
    fit = F.filter("items", lambda x: F.floor(x / 16).cast("int").isin(pairable))
    pair = lambda xs: F.flatten(F.transform(xs, lambda x, i: F.transform(F.slice(xs, i + 2, F.size(xs)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pack = lambda a, b: (a + 1).cast("long") + (b + 1).cast("long") * 1024
    if size == 2:
        return F.transform(pair(fit), lambda p: pack(p["a"], p["b"]))
    known = [a * 64 + b for a, b in promoted or []]
    good = F.filter(pair(fit), lambda p: (F.floor(p["a"] / 16) * 64 + F.floor(p["b"] / 16)).cast("int").isin(known))
    three = F.flatten(F.transform(good, lambda p: F.transform(F.filter(fit, lambda c: (c != p["a"]) & (c != p["b"])), lambda c: F.array_sort(F.array(p["a"], p["b"], c)))))
    return F.array_distinct(F.transform(three, lambda t: pack(t[0], t[1]) + (t[2] + 1).cast("long") * (1 << 20)))


def aggregate(rows: DataFrame, size: int, pairable: list[int], templates: list[str], rule_of: list[str], promoted: list[tuple[int, int]] | None = None, least: float = 0.0) -> DataFrame:
    """Raw sums per template and itemset of ``size`` states, with distinct tickers. ``rows``: see with_outcomes."""
    expand = {1: counting.singles, 2: counting.pairs}.get(size) or counting.triples(promoted or [])
    dated = rows.select("*", F.unix_date("trade_date").alias("day"))
    total = counting.totals(dated, expand, pairable, rule_of, least, rows.count())
    units = lambda c: F.expr(f"{c} / {counting.UNIT:.0f}e0")
    name = F.element_at(F.array(*map(F.lit, templates)), F.col("template") + 1)
    kept = ("itemset", "tickers", "trades", "profitable", "successful", "take_profits", "stop_losses", "time_caps")
    return total.select(name.alias("template"), *kept, units("net").alias("net"), units("gross_profit").alias("gross_profit"), units("(gross_profit - net)").alias("gross_loss"), "logs", "wiped", F.date_from_unix_date("first").alias("first_date"), F.date_from_unix_date("last").alias("last_date"))


def aggregate_columns(rows: DataFrame, sets, templates: list[str], rule_of: list[str], least: float = 0.0) -> DataFrame:
    """Raw sums per template and itemset, with distinct tickers, from columns: for few templates and small libraries. Sums are doubles."""
    exploded = rows.select("ticker", "entry_rule", F.explode(sets).alias("itemset"), *[c for i in range(len(templates)) for c in (f"r{i}", f"h{i}")])
    each, names = [], []
    for i in range(len(templates)):
        x = F.col(f"r{i}")
        each += [F.count(x).alias(f"trades{i}"), F.count(F.when(x > 0, 1)).alias(f"profitable{i}"), F.count(F.when(x >= least, 1)).alias(f"successful{i}"), F.sum(x).alias(f"net{i}"), F.sum(F.when(x > 0, x)).alias(f"gross_profit{i}"), F.sum(F.when(x < 0, -x)).alias(f"gross_loss{i}"), F.sum(f"h{i}").alias(f"take_profits{i}")]
        names.append(("trades", "profitable", "successful", "net", "gross_profit", "gross_loss", "take_profits"))
    by_ticker = exploded.groupBy("entry_rule", "itemset", "ticker").agg(*each)
    total = by_ticker.groupBy("entry_rule", "itemset").agg(*[x for i in range(len(templates)) for x in (F.count(F.when(F.col(f"trades{i}") > 0, 1)).alias(f"tickers{i}"), *[F.sum(f"{n}{i}").alias(f"{n}{i}") for n in names[i]])])
    fields = ("tickers", *names[0])
    unpivoted = total.select("entry_rule", "itemset", F.explode(F.array(*[F.struct(F.lit(t).alias("template"), F.lit(rule).alias("rule"), *[F.coalesce(F.col(f"{n}{i}"), F.lit(0)).cast("double" if n in ("net", "gross_profit", "gross_loss") else "long").alias(n) for n in fields]) for i, (t, rule) in enumerate(zip(templates, rule_of, strict=True))])).alias("x"))
    return unpivoted.where("x.rule = entry_rule and x.trades > 0").select("x.template", "itemset", *[f"x.{n}" for n in fields])


def finished(raw: DataFrame) -> DataFrame:
    return raw.selectExpr("template", "itemset", "tickers", "trades", "profitable", "successful", "take_profits", *[x.strip() for x in (f"{r('successful * 1e2 / trades')} AS success_rate_pct", f"{r('profitable * 1e2 / trades')} AS profitable_rate_pct", f"{r('take_profits * 1e2 / trades')} AS take_profit_rate_pct", f"{r('net / trades')} AS avg_return_pct", f"{r('net')} AS net_return_pct", f"{r(metrics.profit_factor())} AS profit_factor", "gross_loss = 0 AND gross_profit > 0 AS pf_is_inf")])


#: Net returns have nine digits and can end in a five: with this added such a tie goes up in any engine.
NUDGE = "1e-10"
#: Compounding over this many e-folds is not spelt out: the log stands for it.
FOLDS = 16


def complete() -> list[str]:
    """All that is reported of an itemset, from raw sums: one text for both engines."""
    growth = f"logs / {counting.LOG_UNIT:.0f}e0"
    rates = [f"{r(f'{n} * 1e2 / trades')} AS {rate}" for n, rate in (("successful", "success_rate_pct"), ("profitable", "profitable_rate_pct"), ("take_profits", "take_profit_rate_pct"), ("stop_losses", "stop_loss_rate_pct"), ("time_caps", "time_cap_rate_pct"))]
    return ["template", "itemset", "tickers", "trades", "profitable", "successful", "take_profits", "stop_losses", "time_caps", *rates, f"{r('net / trades')} AS avg_return_pct", f"{r(f'net + {NUDGE}')} AS net_return_pct", f"{r(metrics.profit_factor())} AS profit_factor", "gross_loss = 0 AND gross_profit > 0 AS pf_is_inf", f"CASE WHEN wiped > 0 THEN NULL ELSE {r(growth)} END AS growth_log", f"CASE WHEN wiped > 0 THEN -1e2 WHEN {growth} <= {FOLDS} THEN {r(f'(exp({growth}) - 1) * 100', 1)} END AS cumulative_return_pct", "first_date", "last_date"]


def promoted_pairs(summary: DataFrame, trades: int = PRE_TRADES, win: float = PRE_WIN, factor: float = PRE_FACTOR, most: int = PRE_PAIRS) -> DataFrame:
    """Feature pairs whose best two-state set passes; states and templates are ignored. At most ``most``, ties by place."""
    a, b = F.floor((F.col("itemset") % 1024 - 1) / 16).cast("int"), F.floor((F.floor(F.col("itemset") / 1024) % 1024 - 1) / 16).cast("int")
    good = summary.where((F.col("trades") >= trades) & (F.col("profitable_rate_pct") >= win) & (F.col("pf_is_inf") | (F.col("profit_factor") >= factor)))
    score = F.when(F.col("pf_is_inf"), 1e9).otherwise(F.col("profitable_rate_pct") + 10 * F.col("profit_factor"))
    return good.select(a.alias("a"), b.alias("b"), score.alias("score")).groupBy("a", "b").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "a", "b").limit(most)


def named(summary: DataFrame, keys: list[str], ladder) -> DataFrame:
    """pattern_code (template__Nf__key=state__...) and state_size in front of each row."""
    names = F.create_map(*[F.lit(x) for i, k in enumerate(keys) for s, c in enumerate(ladders.codes(ladder(k))) for x in (16 * i + s + 1, f"{k}={c}")])
    parts = F.array(*[F.floor(F.col("itemset") / (1 << 10 * j)).cast("long") % 1024 for j in range(3)])
    items = F.transform(F.filter(parts, lambda p: p > 0), lambda p: F.element_at(names, p.cast("int")))
    return summary.withColumn("items", items).withColumn("state_size", F.size("items")).withColumn("pattern_code", F.concat_ws("__", "template", F.concat(F.col("state_size").cast("string"), F.lit("f")), F.array_join("items", "__"))).drop("items", "itemset")


# DuckDB's way: unnested items and self-joins over the same packed states.


def packed_sql(keys: list[str], ladder, source: str = "valued", where: str = "") -> list[tuple[str, str]]:
    items = ", ".join(f"{ladders.position(ladder(k), k)} + {16 * i}" for i, k in enumerate(keys))
    return [
        ("packed", f"SELECT ticker, trade_date, entry_rule, list_filter([{items}], lambda x: x IS NOT NULL) AS items FROM {source}{where}"),
        ("single", "SELECT ticker, trade_date, entry_rule, unnest(items) AS item FROM packed"),
    ]


def itemsets_sql(size: int, pairable: list[int]) -> list[tuple[str, str]]:
    if size == 1:
        return [("sets", "SELECT ticker, trade_date, entry_rule, CAST(item + 1 AS BIGINT) AS itemset FROM single")]
    fit = f"(SELECT * FROM single WHERE item // 16 IN ({', '.join(map(str, pairable))}))"
    keys = "USING (ticker, trade_date, entry_rule)"
    if size == 2:
        return [("fit", fit[1:-1]), ("sets", f"SELECT ticker, trade_date, entry_rule, CAST(a.item + 1 + (b.item + 1) * 1024 AS BIGINT) AS itemset FROM fit a JOIN fit b {keys} WHERE a.item < b.item")]
    return [("fit", fit[1:-1]), ("sets", f"SELECT ticker, trade_date, entry_rule, CAST(a.item + 1 + (b.item + 1) * 1024 + (c.item + 1) * 1048576 AS BIGINT) AS itemset FROM fit a JOIN fit b {keys} JOIN fit c {keys} WHERE a.item < b.item AND b.item < c.item AND (EXISTS (SELECT 1 FROM promoted p WHERE (p.a = a.item // 16 AND p.b = b.item // 16) OR (p.a = a.item // 16 AND p.b = c.item // 16) OR (p.a = b.item // 16 AND p.b = c.item // 16)))")]


SUMMARY_SQL = [
    ("raw", f"SELECT template, itemset, count(DISTINCT ticker) AS tickers, {metrics.sums()}, CAST(sum(CASE WHEN exit_reason = 'take_profit' THEN 1 ELSE 0 END) AS BIGINT) AS take_profits FROM sets JOIN samples USING (ticker, trade_date, entry_rule) GROUP BY template, itemset"),
    ("summary", f"SELECT template, itemset, tickers, trades, profitable, successful, take_profits, {r('successful * 1e2 / trades')} AS success_rate_pct, {r('profitable * 1e2 / trades')} AS profitable_rate_pct, {r('take_profits * 1e2 / trades')} AS take_profit_rate_pct, {r('net / trades')} AS avg_return_pct, {r('net')} AS net_return_pct, {r(metrics.profit_factor())} AS profit_factor, gross_loss = 0 AND gross_profit > 0 AS pf_is_inf FROM raw"),
]
