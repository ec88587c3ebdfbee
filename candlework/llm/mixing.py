"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Targets. Sources share a budget of words by weight; a target stops at ``MOST`` times its source's size and the
excess is shared anew by weight among the others until none is above. That is one level: sources sorted by
size over weight are full up to some point, and the rest share what is left.

Copies. A source that owes lam = target / size takes floor(lam) whole copies of every document for certain. For
the rest each document has inclusion probability p = lam - floor(lam): documents are ranked by their random odds over
their inclusion odds, (u / (1 - u)) / (p / (1 - p)) with u a hash of doc_id, and taken in that order up to the
fixed number of words. p differs from source to source and is one number within a source on purpose: a mix is
to hold each document of a source, and so each of its words, with the same chance; sampling by size, say, would
shift a source to its long documents. A document that would go over is passed by and the order goes on with
those that fit (PASSES times); last, one more document is taken if that brings the source nearer to its
target, the one that brings it nearest.

Scale. Nothing is ranked as a whole: ranks fall into BUCKETS by value, words are summed per source and
bucket (partial aggregates), and only the one bucket in which a source's target falls is sorted. So a
source with a third of all rows needs no more than about 1/BUCKETS of them in a task. Equal rows are counted first
and are one row from then on. The few rows that stand for sources are broadcast after a check of their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlework.llm.common import n_words, read, spool

WEIGHTS, MOST, SHARE = (1, 2, 3), 3, 1.0
BUCKETS, PASSES, SEED = 4096, 3, 7
#: Sources up to which their rows (a few numbers each) are broadcast.
SMALL_SOURCES = 10_000
COLUMNS = ("doc_id", "source", "size", "tag", "n", "source_size", "target", "k", "whole", "rank", "bucket")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = SHARE) -> DataFrame:
    """For (source, source_size): target and k, the source's place by code point, null last. Weights repeat in that order."""
    everything = Window.partitionBy(F.lit(0))  # one row per source
    placed = (
        sizes.withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("k") - 1, F.lit(len(weights))) + 1).cast("double"))
        .withColumn("full", F.lit(float(most)) * F.col("source_size"))
    )
    by_fill = Window.partitionBy(F.lit(0)).orderBy(F.col("full") / F.col("weight"), "k")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        placed.withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("owed", F.col("budget") - F.coalesce(F.sum("full").over(before), F.lit(0.0)))
        .withColumn("among", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("owed") / F.col("among"))
        .withColumn("capped", F.col("full") <= F.col("level") * F.col("weight"))
    )
    level = level.withColumn("rest", F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return level.select("source", "source_size", "k", F.when(F.col("capped"), F.col("full")).otherwise(F.col("rest") * F.col("weight")).alias("target"))


def uniform(*keys: Column, seed: int = SEED) -> Column:
    """A number in (0, 1) that depends on the keys alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def _small(df: DataFrame) -> DataFrame:
    """A row per source: broadcast if they are few, for they meet every document."""
    return F.broadcast(df) if df.count() <= SMALL_SOURCES else df


def units(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """Equal rows (doc_id, size, source, tag) as one, n of them, with source_size, target, whole copies of each and extra ones of all."""
    sized = spool(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag")).groupBy("doc_id", "source", "size", "tag").agg(F.count(F.lit(1)).alias("n")), "sizes")
    sources = targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most, share)
    lam = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("whole", F.floor(lam + F.lit(1e-12))).withColumn("p", F.greatest(lam - F.col("whole"), F.lit(0.0)))
    sources = spool(sources.withColumn("open", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))), "targets")
    u = uniform(F.col("doc_id"), seed=seed)
    rank = (u / (1 - u)) / (F.greatest(F.col("p"), F.lit(1e-12)) / (1 - F.least(F.col("p"), F.lit(1 - 1e-12))))
    right = _small(sources.withColumnRenamed("source", "name"))
    table = sized.join(right, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("rank", rank).withColumn("bucket", F.least(F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS), F.lit(BUCKETS - 1)))
    table = spool(table.select(*COLUMNS, F.lit(0).cast("long").alias("extra")), "ranked")
    need = sources.select("k", "open")
    for _ in range(PASSES):
        table = spool(_take(table, _left(table, need)), "picked")
    left = _left(table, need)
    gap = F.abs(F.col("size") - F.col("open"))
    free = table.where("extra < n").join(_small(left), "k").where(gap < F.col("open"))
    closing = free.groupBy("k").agg(F.min(F.struct(gap.alias("gap"), "rank", "doc_id", "size", "tag")).alias("last"))
    final = table.join(_small(closing.select(F.col("k").alias("at"), "last")), (F.col("k") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("last.doc_id")) & (F.col("size") == F.col("last.size")) & (F.col("tag") == F.col("last.tag")), "left")
    return final.select("doc_id", "size", "source", "tag", "n", "source_size", "target", "whole", (F.col("extra") + F.col("at").isNotNull().cast("int")).alias("extra"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source, tag (hash of the text), source_size, target and copies of every row; taken = copies * size.

    Null text has size 0; such documents get their whole copies and nothing is owed for them. Null is a source. Rows
    with one doc_id share their random number, null too. Equal rows are so many documents: the mix takes as many of them as it
    needs. Extra columns are left out; an empty table gives an empty one.
    """
    rows = units(docs, **options).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return rows.select("doc_id", "size", "source", "tag", "source_size", "target", (F.col("whole") + (F.col("i") <= F.col("extra")).cast("int")).cast("long").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as mix() says, all columns as they are."""
    taken = spool(units(docs, **options).select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), F.col("source").alias("__source"), F.col("n").alias("__n"), F.col("whole").alias("__whole"), F.col("extra").alias("__extra")), "copies")
    wide = docs.withColumn("__text_tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = (F.col("__text_tag") == F.col("__tag")) & F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source"))
    lone = wide.join(taken.where("__n = 1"), same).withColumn("__copies", F.col("__whole") + F.col("__extra"))
    # of rows that are equal in these, those that are equal in all columns are counted, and the extra copies dealt to them in some order
    key = ["__id", "__source", "__tag"]
    many = wide.join(taken.where("__n > 1"), same).groupBy(*docs.columns, *key, "__whole", "__extra").agg(F.count(F.lit(1)).alias("__m"))
    upto = Window.partitionBy(*key).orderBy(F.xxhash64(*docs.columns)).rowsBetween(Window.unboundedPreceding, -1)
    free = F.col("__extra") - F.coalesce(F.sum("__m").over(upto), F.lit(0))
    many = many.withColumn("__copies", F.col("__whole") * F.col("__m") + F.greatest(F.lit(0), F.least(free, F.col("__m"))))
    rows = lone.select(*docs.columns, "__copies").unionByName(many.select(*docs.columns, "__copies")).where("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)


def _left(table: DataFrame, need: DataFrame) -> DataFrame:
    """Words each source still owes."""
    got = table.where("extra > 0").groupBy("k").agg(F.sum(F.col("size") * F.col("extra")).alias("got"))
    return need.join(got, "k", "left").select("k", (F.col("open") - F.coalesce("got", F.lit(0))).alias("open"))


def _take(table: DataFrame, left: DataFrame) -> DataFrame:
    """Pick, in rank order among documents that fit, up to what is open; never over it. Of equal rows as many as fit."""
    table = table.join(_small(left), "k")
    free = F.col("n") - F.col("extra")
    fits = (free > 0) & (F.col("size") > 0) & (F.col("size") <= F.col("open"))
    sums = table.where(fits).groupBy("k", "bucket", "open").agg(F.sum(F.col("size") * free).alias("words"))
    upto = Window.partitionBy("k").orderBy("bucket")  # at most BUCKETS rows a source
    edge = sums.withColumn("upto", F.sum("words").over(upto)).where(F.col("upto") > F.col("open")).groupBy("k").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("e"))
    table = table.join(_small(edge.select(F.col("k").alias("at"), F.col("e.bucket").alias("edge"), F.col("e.before").alias("before"))), F.col("k") == F.col("at"), "left").withColumn("fits", fits)
    at_edge = F.coalesce(F.col("fits") & (F.col("bucket") == F.col("edge")), F.lit(False))
    within = F.col("fits") & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge")))
    clear = table.where(~at_edge).select(*COLUMNS, F.when(within, F.col("n")).otherwise(F.col("extra")).alias("extra"))
    order = Window.partitionBy("k").orderBy("rank", "doc_id", "size", "tag").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("open") - F.col("before") - F.coalesce(F.sum(F.col("size") * free).over(order), F.lit(0))
    more = F.least(free, F.greatest(F.lit(0).cast("long"), F.floor(room / F.col("size"))))
    tight = table.where(at_edge).select(*COLUMNS, (F.col("extra") + more).alias("extra"))
    return clear.unionByName(tight)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
