"""Refinement of mined patterns beyond one task: overlaps by prefix, duplicates by rounds, reasons with what is absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlework.sinks.spool import spool

#: Order of candidates: the larger first, ties to the smaller itemset.
BEST = ("robustness", "val_net", "avg_uplift", "pf_uplift")


def _rank(prefix: str = "") -> Column:
    """Smaller is better; an undefined measure comes last."""
    return F.struct(*[F.coalesce(-F.col(prefix + c), F.lit(float("inf"))).alias(c) for c in BEST], F.col(prefix + "itemset").alias("itemset"))


def verdicts(candidates: DataFrame, overlap: DataFrame, share: float) -> DataFrame:
    """All candidates and duplicate_of: null if one stays, else the best kept one of its template that it overlaps by ``share``.

    They are seen best first; what does not stay hides nobody. Only edges travel: in each round those that no undecided
    better neighbour is left to judge stay, and their neighbours go. Rounds follow the longest chain of ever worse
    neighbours, not the number of candidates.
    """
    ends = candidates.select("template", "itemset", _rank().alias("rank"))
    a, b = (ends.select("template", F.col("itemset").alias(x), F.col("rank").alias(f"{x}_rank")) for x in ("first_set", "second_set"))
    met = overlap.where(F.col("share") >= share).join(a, ["template", "first_set"]).join(b, ["template", "second_set"])
    ahead = F.col("first_set_rank") < F.col("second_set_rank")
    side = lambda x, y: F.when(ahead, F.col(x)).otherwise(F.col(y))
    edges = spool(met.select("template", side("first_set", "second_set").alias("better"), side("second_set", "first_set").alias("worse"), F.least("first_set_rank", "second_set_rank").alias("rank")), "edges")
    undecided, hidden = edges.select("template", "better", "worse"), None
    while not undecided.isEmpty():
        stays = undecided.select("template", "better").distinct().join(undecided.select("template", F.col("worse").alias("better")), ["template", "better"], "left_anti")
        goes = spool(undecided.join(stays, ["template", "better"], "left_semi").select("template", F.col("worse").alias("itemset")).distinct(), "hidden")
        hidden = goes if hidden is None else hidden.unionByName(goes)
        for end in ("better", "worse"):
            undecided = undecided.join(goes.select("template", F.col("itemset").alias(end)), ["template", end], "left_anti")
        undecided = spool(undecided.select("template", "better", "worse"), "undecided")
    if hidden is None:
        return candidates.withColumn("duplicate_of", F.lit(None).cast("long"))
    kept = edges.join(hidden.select("template", F.col("itemset").alias("better")), ["template", "better"], "left_anti")
    of = kept.groupBy("template", F.col("worse").alias("itemset")).agg(F.min("rank").alias("rank"))
    of = of.join(hidden, ["template", "itemset"], "left_semi").select("template", "itemset", F.col("rank.itemset").alias("duplicate_of"))
    return candidates.join(of, ["template", "itemset"], "left").select(*candidates.columns, "duplicate_of")


def prefixes(keys: DataFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """``keys`` (template, itemset, token) with each set's size, and of each set the rarest tokens one of which a
    larger set must have to share ``share`` of it."""
    rarity = keys.groupBy("template", "token").agg(F.count(F.lit(1)).alias("sets"))
    size = keys.groupBy("template", "itemset").agg(F.count(F.lit(1)).alias("size"))
    sized = spool(keys.join(rarity, ["template", "token"]).join(size, ["template", "itemset"]), "sized")
    place = F.row_number().over(Window.partitionBy("template", "itemset").orderBy("sets", "token"))
    need = F.ceil(share * F.col("size") - 1e-9)
    probes = sized.withColumn("place", place).where(F.col("place") <= F.col("size") - need + 1).drop("place", "sets")
    return sized.drop("sets"), probes


def near_overlaps(keys: DataFrame, share: float) -> DataFrame:
    """template, first_set, second_set, common and share of all pairs of sets of which the smaller lies in the other by ``share`` or more.

    Only pairs that meet in a rare token of the smaller set are counted out; tokens that most sets have are last in line.
    """
    sized, probes = prefixes(keys, share)
    other = sized.select("template", "token", F.col("itemset").alias("other"), F.col("size").alias("other_size"))
    smaller = (F.col("size") < F.col("other_size")) | ((F.col("size") == F.col("other_size")) & (F.col("itemset") < F.col("other")))
    pairs = probes.join(other, ["template", "token"]).where(smaller).select("template", "itemset", "other", "size").distinct()
    common = pairs.join(sized.select("template", "itemset", "token"), ["template", "itemset"]).join(other.drop("other_size"), ["template", "other", "token"], "left_semi").groupBy("template", "itemset", "other", "size").agg(F.count(F.lit(1)).alias("common"))
    part = F.round(F.col("common") / F.col("size"), 6)
    return common.where(F.col("common") >= F.ceil(share * F.col("size") - 1e-9)).select("template", F.least("itemset", "other").alias("first_set"), F.greatest("itemset", "other").alias("second_set"), "common", part.alias("share"))


#: The defaults of a real run.
GATE = {"states": 2, "avg_uplift": 1.0, "pf_uplift": 0.2, "trades": 300, "tickers": 30, "train": 150, "val": 40, "pf": 1.10, "months": 6, "months_ratio": 0.55, "val_months": 2, "val_ratio": 0.5}


def _reasons(*tests: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(True)), name) for when, name in tests]))


def reasoned(summary: DataFrame, baseline: DataFrame, trades: DataFrame, split: str, gate: dict = GATE) -> DataFrame:
    """Every pattern of ``summary`` with how far it came and why it went: stage, reasons, and the measures it was judged by.

    ``summary`` has template, itemset, states, n, tickers, av, pf; ``baseline`` template, av, pf; ``trades`` template,
    itemset, trade_date, trade_return_pct. A pattern whose template has no baseline is rejected for that, one
    without a trade in ``trades`` for missing_trades. No profit factor counts as 0 in an uplift and fails its own test.
    """
    late, x = F.col("trade_date") >= F.lit(split).cast("date"), F.col("trade_return_pct").cast("decimal(18,9)")
    total = lambda when, y: F.coalesce(F.sum(F.when(when, y)).cast("double"), F.lit(0.0))
    sums = [s for p, when in (("train", ~late), ("val", late)) for s in (F.count_if(when).alias(f"{p}_n"), total(when, x).alias(f"{p}_net"), total(when & (x > 0), x).alias(f"{p}_gp"), total(when & (x < 0), -x).alias(f"{p}_gl"))]
    month = trades.groupBy("template", "itemset", F.trunc("trade_date", "month").alias("month")).agg(F.sum(x).alias("net"), F.sum(F.when(late, x)).alias("late_net"))
    months = month.groupBy("template", "itemset").agg(F.count(F.lit(1)).alias("months"), F.count_if(F.col("net") > 0).alias("positive"), F.count("late_net").alias("val_months"), F.count_if(F.col("late_net") > 0).alias("val_positive"))
    seen = trades.groupBy("template", "itemset").agg(*sums).join(months, ["template", "itemset"])
    base = baseline.select("template", F.col("av").alias("base_av"), F.coalesce("pf", F.lit(0.0)).alias("base_pf"), F.lit(True).alias("based"))
    rows = summary.join(base, "template", "left").join(seen, ["template", "itemset"], "left")
    for p in ("train", "val"):
        rows = rows.withColumn(f"{p}_pf", F.when(F.col(f"{p}_gl") > 0, F.col(f"{p}_gp") / F.col(f"{p}_gl")).when(F.col(f"{p}_gp") > 0, F.lit(float("inf"))))
        rows = rows.withColumn(f"{p}_av", F.when(F.col(f"{p}_n") > 0, F.col(f"{p}_net") / F.col(f"{p}_n")).otherwise(0.0))
    rows = rows.withColumn("avg_uplift", F.col("av") - F.col("base_av")).withColumn("pf_uplift", F.coalesce("pf", F.lit(0.0)) - F.col("base_pf"))
    g, part = gate, lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    based = F.col("based").isNotNull()
    before = _reasons((~based, "missing_baseline"), (based & (F.col("states") < g["states"]), f"state_size<{g['states']}"), (based & (F.col("avg_uplift") < g["avg_uplift"]), f"avg_uplift<{g['avg_uplift']:.2f}"), (based & (F.col("pf_uplift") < g["pf_uplift"]), f"pf_uplift<{g['pf_uplift']:.2f}"), (F.col("n") < g["trades"], f"trades<{g['trades']}"), (F.col("tickers") < g["tickers"], f"tickers<{g['tickers']}"))
    after = _reasons(
        (F.col("train_n") < g["train"], f"train_trades<{g['train']}"),
        (F.col("val_n") < g["val"], f"validation_trades<{g['val']}"),
        (F.col("train_pf") < g["pf"], f"train_pf<{g['pf']:.2f}"),
        (F.col("val_pf") < g["pf"], f"validation_pf<{g['pf']:.2f}"),
        (F.col("train_av") < 0, "train_avg<0.00"),
        (F.col("val_av") < 0, "validation_avg<0.00"),
        (F.col("train_net") <= 0, "train_net<=0"),
        (F.col("val_net") <= 0, "validation_net<=0"),
        (F.col("months") < g["months"], f"active_months<{g['months']}"),
        (part("positive", "months") < g["months_ratio"], f"positive_month_ratio<{g['months_ratio']:.2f}"),
        (F.col("val_months") < g["val_months"], f"validation_active_months<{g['val_months']}"),
        (part("val_positive", "val_months") < g["val_ratio"], f"validation_positive_month_ratio<{g['val_ratio']:.2f}"),
    )
    judged = rows.withColumn("before", before).withColumn("after", F.when(F.col("train_n").isNull(), F.array(F.lit("missing_trades"))).otherwise(after))
    passed = F.size("before") == 0
    stage = F.when(~passed, "prefilter").when(F.size("after") > 0, "trades").otherwise("refined")
    robust = 5 * F.col("avg_uplift") + 20 * F.col("pf_uplift") + 3 * F.col("val_av") + 10 * part("val_positive", "val_months") + F.col("av")
    return judged.select("template", "itemset", "n", "tickers", stage.alias("stage"), F.array_join(F.when(passed, F.col("after")).otherwise(F.col("before")), ";").alias("reasons"), F.when(passed & (F.size("after") == 0), F.round(robust, 4)).alias("robustness"))
