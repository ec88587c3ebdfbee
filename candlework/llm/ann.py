"""Nearest neighbours by multi-index hashing.

A rotation learned on a bounded sample (principal axes, then iterative quantization) turns each vector into a 64-bit code.
Codes are split into eight substrings and each is indexed. Of two codes within 8 * d + t bits, either one of the first
t + 1 substrings differs in at most d bits or another in at most d - 1, so probing table after table at growing distance
finds every code within a Hamming radius. Their vectors are compared in double precision; the angle of the k-th best so far
says how far codes of vectors as near may lie, and probing stops at that radius. So near vectors (clusters, copies) end a
search early, and where all are far from each other nearly everything is visited; no share of candidates is fixed.

Layout. Equal vectors are one entry that keeps the smallest ids its group can place in a result, so a vector that a
third of all rows share is searched once. The index is cut into shards and the distinct query vectors into
blocks; each (shard, block) pair is a task, and each query's best of all shards are merged. Ids of a
query vector join last, and each drops itself.

The sample, SAMPLE rows by hash, only shapes the rotation; every row is indexed.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlework.llm.common import read, release, spool

K, QUERY_EVERY = 20, 20
BITS, PARTS = 64, 8
SAMPLE, ROUNDS = 4096, 30
#: Standard deviations that the radius goes beyond the bits expected to differ. Recall at 20, codes scored, on 32,768 vectors of check_l:
#: 0.990 and 34 % at 1.3, 1.000 and 54 % at 2.0, 1.000 and 72 % at 2.5; on 6,000 in 100 clusters 1.000 and 1 % at each.
MARGIN = 2.0
SHARD, BLOCK, LEAST_BLOCK = 32768, 32768, 256
#: Most bytes that the vectors of a shard, or of a block, take as doubles, and queries whose products with a shard are made at once.
VECTOR_BYTES, TOGETHER = 1 << 24, 32


def learn_rotation(sample: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits) whose signs are the code."""
    dims = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(dims)
    x = sample - mean
    rng = np.random.default_rng(1)
    width = min(dims, bits)
    axes = np.linalg.svd(x, full_matrices=False)[2][:width].T if len(x) >= width else np.linalg.qr(rng.normal(size=(dims, width)))[0]
    if width < bits:  # more bits than dimensions: a tight frame of rotated axes
        spread = np.concatenate([np.linalg.qr(rng.normal(size=(width, width)))[0] for _ in range(math.ceil(bits / width))], axis=1)[:, :bits]
        return mean, axes @ spread
    y = x @ axes
    r = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(ROUNDS if len(x) else 0):
        u, _, v = np.linalg.svd(np.sign(y @ r).T @ y)
        r = (u @ v).T
    return mean, axes @ r


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return np.packbits((x - mean) @ projection > 0, axis=1).view(">u8").reshape(-1).astype(np.uint64) if len(x) else np.zeros(0, np.uint64)


class Index:
    """Eight tables from substring to entries, and the codes themselves."""

    def __init__(self, code: np.ndarray):
        self.code = code
        width = BITS // PARTS
        self.keys = [((code >> np.uint64(i * width)) & np.uint64((1 << width) - 1)).astype(np.uint8) for i in range(PARTS)]
        self.order = [np.argsort(k, kind="stable").astype(np.int32) for k in self.keys]
        self.edge = [np.concatenate([[0], np.cumsum(np.bincount(k, minlength=1 << width))]) for k in self.keys]
        self.balls = [np.array([sum(1 << b for b in c) for c in combinations(range(width), d)], np.uint8) for d in range(width + 1)]

    def search(self, code: int, score, cosine, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Entries found, their scores, and how many codes were visited.

        ``score`` gives entries' inner products, ``cosine`` the cosines of their centred vectors to the query's. Table after
        table is probed at growing distance: once tables 0 to t are probed at distance d, every code within 8 * d + t
        bits has been visited. Codes within that radius are scored; the k-th best so far says by its angle how many bits
        one as near may differ in (bits differ in a share angle / pi of planes), and probing ends when the radius is that.
        """
        n, width, need = len(self.code), BITS // PARTS, BITS
        seen, visited = np.zeros(n, bool), 0
        waiting, distance = np.zeros(0, np.int32), np.zeros(0, np.uint8)  # visited, beyond the radius so far
        scored, scores = np.zeros(0, np.int32), np.zeros(0)
        for d in range(width + 1):
            tables = min(PARTS, need - PARTS * d + 1)
            if tables <= 0:
                break
            fresh = []
            for i in range(tables):
                value = np.uint8((code >> (i * width)) & ((1 << width) - 1))
                if 10 * len(self.balls[d]) < 1 << width:
                    got = np.concatenate([self.order[i][self.edge[i][v] : self.edge[i][v + 1]] for v in (value ^ self.balls[d]).tolist()])
                    got = got[~seen[got]]
                else:  # of so many buckets, reading the table's keys costs less than taking them out one by one
                    got = np.flatnonzero((np.bitwise_count(value ^ self.keys[i]) == d) & ~seen).astype(np.int32)
                seen[got] = True
                fresh.append(got)
            visited += sum(map(len, fresh))
            waiting = np.concatenate([waiting, *fresh])
            distance = np.concatenate([distance, np.bitwise_count(self.code[waiting[len(distance) :]] ^ np.uint64(code))])
            radius = min(PARTS * d + tables - 1, need) if visited < n else need
            pick = distance <= radius
            if pick.any():
                scored, scores = np.concatenate([scored, waiting[pick]]), np.concatenate([scores, score(waiting[pick])])
                waiting, distance = waiting[~pick], distance[~pick]
            if len(scored) >= k:
                at = np.argpartition(-scores, k - 1)[:k]
                share = np.arccos(np.clip(cosine(scored[at]).min(), -1.0, 1.0)) / np.pi
                need = min(need, int(np.ceil(BITS * share + MARGIN * np.sqrt(BITS * share * (1 - share)))))
            if visited == n and (distance > need).all():
                break
        return scored, scores, visited


def scorer(x: np.ndarray, vector: np.ndarray):
    """Inner products of chosen rows. Of many rows, one product over all costs less than taking the rows out."""
    return lambda i: (x @ vector)[i] if 8 * len(i) > len(x) else x[i] @ vector


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v (floats as they are, else doubles): rows with an id and a vector that is not null, not zero and all finite. Repeated rows count once."""
    kept = vectors.schema["embedding"].dataType.elementType.typeName() == "float"  # half the bytes to write and shuffle
    v = F.col("embedding") if kept else F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(fine).dropDuplicates(["vec_id", "v"])


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """A column of vectors as rows of doubles, without an object for each."""
    return np.concatenate([c.flatten().to_numpy().astype(np.float64) for c in column.chunks] or [np.zeros(0)]).reshape(-1, dims)


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by inner product, ties to smaller vec_id.

    ``queries`` is (vec_id) of rows that ask. Only vectors of the table's commonest length take part (ties: the shorter).
    A task gives one row for each query, with k + 1 ids and scores and no vector, so what it holds is bounded by a shard and a block.
    """
    good = spool(usable(vectors), "vectors")
    total = good.count()
    every = max(1, total // SAMPLE)
    common = good.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = common.dims if common else 1
    good = good.where(F.size("v") == dims)
    rows = [r.v for r in good.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).select("v").limit(2 * SAMPLE).collect()]
    mean, projection = learn_rotation(np.array(rows, np.float64).reshape(-1, dims))
    asks = good.join(queries.distinct(), "vec_id", "left_semi")
    keyed = good.withColumn("key", F.xxhash64("v"))
    first = Window.partitionBy("key", "v").orderBy("vec_id")
    entries = spool(keyed.withColumn("i", F.row_number().over(first)).where(F.col("i") <= k + 1).groupBy("key", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    wanted = spool(asks.select(F.xxhash64("v").alias("key"), "v").distinct().withColumn("ask", F.monotonically_increasing_id()), "queries")
    n, q = entries.count(), wanted.count()
    fit = max(1, VECTOR_BYTES // (8 * max(dims, 1)))  # long vectors: fewer in a task
    shards = max(1, -(-n // min(SHARD, fit)))
    tasks = max(1, min(-(-q // LEAST_BLOCK), vectors.sparkSession.sparkContext.defaultParallelism // shards))  # for small tables
    blocks = max(tasks, -(-q // min(BLOCK, fit)))
    share = lambda key, parts: F.pmod(F.shiftrightunsigned(key, 17), F.lit(parts)).cast("int")
    left = entries.withColumn("shard", share(F.col("key"), shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("shard", "block", "v", "ids")
    right = wanted.withColumn("block", share(F.col("key"), blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("shard", "block", "v", "ask")

    def pair(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        found, ends = [(np.zeros(0, np.int64), np.zeros(0))], [0]
        if len(ours) and len(theirs):
            x, y = matrix(ours["v"], dims), matrix(theirs["v"], dims)
            index = Index(codes(x, mean, projection))
            ids, upto = np.concatenate([c.flatten().to_numpy() for c in ours["ids"].chunks]), np.cumsum([0, *pc.list_value_length(ours["ids"]).to_pylist()])
            centred = x - mean
            centred /= np.maximum(np.sqrt((centred**2).sum(axis=1, keepdims=True)), 1e-300)
            away = y - mean
            away /= np.maximum(np.sqrt((away**2).sum(axis=1, keepdims=True)), 1e-300)
            for j, code in enumerate(codes(y, mean, projection).tolist()):
                if j % TOGETHER == 0:
                    products = y[j : j + TOGETHER] @ x.T
                at, rough, _ = index.search(code, products[j % TOGETHER].__getitem__, lambda i: centred[i] @ away[j], k + 1)  # noqa: B023
                if len(at) > 2 * k + 2:
                    at = at[rough >= np.partition(rough, -(k + 1))[-(k + 1)] - 1e-9 * max(1.0, float(np.abs(rough).max()))]
                many = upto[at + 1] - upto[at]
                exact = np.repeat((x[at] * y[j]).sum(axis=1), many)
                named = ids[np.repeat(upto[at + 1] - np.cumsum(many), many) + np.arange(int(many.sum()))]
                best = np.lexsort((named, -exact))[: k + 1]
                found.append((named[best], exact[best]))
                ends.append(ends[-1] + len(best))
        vec_ids, scores = (np.concatenate(a) for a in zip(*found, strict=True))
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(a)) for a in (vec_ids, scores)]
        table = pa.table([theirs["ask"] if len(lists[0]) else pa.array([], pa.int64()), *lists], names=["ask", "vec_ids", "scores"])
        release()
        return table

    near = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(pair, "ask long, vec_ids array<long>, scores array<double>")
    each = near.select("ask", F.explode(F.arrays_zip("vec_ids", "scores")).alias("b")).select("ask", F.col("b.vec_ids").alias("vec_id"), F.col("b.scores").alias("score"))
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    best = each.withColumn("i", F.row_number().over(order)).where(F.col("i") <= k + 1).groupBy("ask").agg(F.sort_array(F.collect_list(F.struct("i", "vec_id", "score"))).alias("best"))
    asked = asks.select(F.col("vec_id").alias("query_id"), "v", F.xxhash64("v").alias("key")).join(wanted, ["key", "v"]).select("query_id", "ask").join(best, "ask")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    return asked.select("query_id", F.posexplode(others)).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.pmod("vec_id", F.lit(QUERY_EVERY)) == 0).select("vec_id"))
