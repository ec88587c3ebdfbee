"""URL filters: longest-match rules, and logistic regression on hashed character n-grams for the rest.

The model is trained on the driver from a small labelled URL table (at most TRAIN_ROWS rows, picked by hash),
whose features are made by the same column expression that scores the pages. Scoring is one narrow pass of built-in
functions: the weights are a constant array of BUCKETS numbers.
"""

from __future__ import annotations

import math
import random
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlework.llm.common import read

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
SIZES, BUCKETS = (3, 4, 5), 4096
#: The bound of the labelled sample, passes over it, step and L2 penalty.
TRAIN_ROWS, EPOCHS, STEP, PENALTY = 2000, 30, 4.0, 1e-5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Null or a url without "://" has both empty. Only A-Z is lower-cased, in the host."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none. Ties go to the earlier rule."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column, sizes=SIZES, buckets: int = BUCKETS) -> Column:
    """Buckets of the character n-grams of host and path, repeats included."""
    s = F.concat(F.lit("^"), host, path, F.lit("$"))

    def of(n: int) -> Column:
        places = F.when(F.length(s) >= n, F.sequence(F.lit(1), F.length(s) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.pmod(F.xxhash64(F.substring(s, i, F.lit(n))), F.lit(buckets)).cast("int"))

    return F.concat(*map(of, sizes))


def train(rows: list[tuple[list[int], int]], buckets: int = BUCKETS) -> list[float]:
    """Weights, the last one the bias, of labelled bucket lists (1: block). One class alone gives a constant."""
    weights = [0.0] * (buckets + 1)
    labels = {y for _, y in rows}
    if len(labels) < 2:
        weights[-1] = 10.0 if labels == {1} else -10.0
        return weights
    draw = random.Random(1)
    rows = sorted(rows)
    for epoch in range(EPOCHS):
        draw.shuffle(rows)
        step = STEP / (1 + epoch)
        for x, y in rows:
            scale = 1 / math.sqrt(max(1, len(x)))
            z = weights[-1] + scale * sum(map(weights.__getitem__, x))
            error = y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            for b in x:
                weights[b] += step * (error * scale - PENALTY * weights[b])
            weights[-1] += step * error
    return weights


def labelled(urls: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """A bounded labelled table made from the distinct urls that a rule judges, the first by hash: buckets and label."""
    host, path = host_and_path(F.col("url"))
    judged = urls.select("url", host.alias("host"), path.alias("path"))
    judged = judged.select("url", (rule_for(F.col("host"), F.col("path"))[1] == "block").cast("int").alias("y"), F.xxhash64("url").alias("h"))
    # a task hands on no more than its first ``rows`` urls, short strings; a repeated url counts once
    picked = judged.where("y is not null").groupBy("h", "url").agg(F.first("y").alias("y")).orderBy("h", "url").limit(rows)
    return picked.select(grams(*host_and_path(F.col("url"))).alias("x"), "y")


def score(x: Column, weights: list[float]) -> Column:
    table = F.expr("cast(split('" + ",".join(f"{w:.7g}" for w in weights) + "', ',') as array<double>)")  # folded to a constant
    total = F.aggregate(x, F.lit(0.0), lambda a, b: a + F.element_at(table, b + 1))
    return F.lit(weights[-1]) + total / F.sqrt(F.greatest(F.size(x), F.lit(1)).cast("double"))


def judge(pages: DataFrame, weights: list[float], rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row; a rule's verdict first, else the model's."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"))
    model = F.when(score(grams(F.col("host"), F.col("path")), weights) > 0, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", "rule", F.when(F.col("says").isNotNull(), F.col("says")).otherwise(model).alias("verdict"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, train([(list(r.x), r.y) for r in labelled(pages).collect()]))
