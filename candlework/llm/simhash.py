"""SimHash near-duplicates, found exactly by vantage-point trees.

A fingerprint has a bit set where more than half of the text's shingle hashes have it. Two texts are linked when
their fingerprints differ in at most ``radius`` bits.

Over 64 random bits distances crowd around 32, and a triangle bound of 4 prunes little. So the 64 bits are
seen as ``PARTS`` parts: two fingerprints within ``radius`` agree on some part within radius // PARTS bits. Each part has
a vantage-point tree of its own, searched with that smaller radius: inside a node, points nearer to the
vantage point than the split radius go in, others go out, and those outside by no more than the search radius
are also copied in, which by the triangle inequality is all that a pair across the border needs. The top of each tree is
grown on a bounded sample and routes every fingerprint to shards; within a shard the tree goes on down to
small leaves, where full fingerprints are compared. No candidate is dropped: the result is exact.

Only distinct fingerprints take part, each with the smallest doc_id that has it, so exact copies cost
nothing. A leaf yields a spanning forest of its links instead of all pairs; a shard that is too large is
compared block against block. Links then meet in components().

The pipeline's near-dedup (groups) asks for texts that are 0.8 similar, which 64 bits can't tell: it searches wide
fingerprints of 512 bits in the same way, 32 parts with a vantage-point tree each, and judges what is near on the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlework.llm.common import parts, read, release, spool
from candlework.llm.components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Parts of a fingerprint, each with its tree.
PARTS = 4
#: Fingerprints that the routing trees are grown on, in a shard, and in a leaf.
SAMPLE, SHARD, LEAF = 4096, 1 << 18, 512
_CHUNK = 1 << 12


def shingles(text: str | None, size: int) -> Iterator[bytes]:
    """Word shingles of a text in lower case (A-Z only), space-joined, repeats included; a shorter text is one."""
    words = (text or "").encode().lower().split()
    if len(words) < size:
        yield from [b" ".join(words)] if words else []
        return
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    for i in range(0, len(words) - size + 1, _CHUNK):
        last = min(i + _CHUNK, len(words) - size + 1)
        yield from (joined[a:b] for a, b in zip(starts[i:last].tolist(), (ends[i + size - 1 : last + size - 1] - 1).tolist(), strict=True))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    ones, total = np.zeros(64, np.int64), 0
    digest = xxhash.xxh64_digest
    for some in batched(shingles(text, size), _CHUNK):
        raw = np.frombuffer(b"".join([digest(s, SEED) for s in some]), np.uint8)
        ones += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        total += len(some)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big") if total else 0


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every whole text."""

    def run(batches):
        for batch in parts(batches):
            fp = np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def part_masks(parts: int) -> list[int]:
    cut = [64 * i // parts for i in range(parts + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cut, cut[1:], strict=False)]


def _split(x: np.ndarray, reach: int):
    """A vantage point, a split radius and who goes in and out; None if that would not thin the node out."""
    v = x[len(x) // 2]
    d = np.bitwise_count(x ^ v)
    best = None
    counts = np.bincount(d, minlength=66)
    upto = np.cumsum(counts)
    for r in range(int(d.max())):
        inside, outside = int(upto[min(r + reach, 65)]), int(len(x) - upto[r])
        cost = inside**2 + outside**2
        if outside < len(x) and (best is None or cost < best[0]):
            best = (cost, r)
    if best is None or best[0] > 0.9 * len(x) ** 2:
        return None
    r = best[1]
    return v, r, d <= r + reach, d > r


def grow(x: np.ndarray, reach: int, leaf: float) -> tuple | int:
    """A routing tree over sampled part values: nested (vantage, radius, in, out), leaves are None."""
    if len(x) <= leaf or (s := _split(x, reach)) is None:
        return None
    v, r, inside, outside = s
    return int(v), int(r), grow(x[inside], reach, leaf), grow(x[outside], reach, leaf)


def route(tree, x: np.ndarray, reach: int, at: np.ndarray, number: int = 1):
    """(leaf number, positions) of all points of x that each leaf has to see."""
    if tree is None or not len(at):
        yield number, at
        return
    v, r, inside, outside = tree
    d = np.bitwise_count(x[at] ^ np.uint64(v))
    yield from route(inside, x, reach, at[d <= r + reach], 2 * number)
    yield from route(outside, x, reach, at[d > r], 2 * number + 1)


def leaves(x: np.ndarray, reach: int, at: np.ndarray, leaf: int = LEAF):
    """Positions of the points of each leaf of a tree grown on x itself."""
    stack = [at]
    while stack:
        at = stack.pop()
        if len(at) <= leaf or (s := _split(x[at], reach)) is None:
            yield at
        else:
            stack += [at[s[2]], at[s[3]]]


def forest(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (root, member) that join just what links of at most ``radius`` bits join."""
    n, linked = len(fp), []
    for i in range(0, n, 128):
        near = np.bitwise_count(fp[i : i + 128, None] ^ fp[None, :]) <= radius
        linked.append(np.count_nonzero(near, axis=1) > 1)
    rest = np.flatnonzero(np.concatenate(linked)) if linked else np.zeros(0, np.int64)
    out: list[tuple[int, int]] = []
    while len(rest):
        root, rest = int(rest[0]), rest[1:]
        front = np.array([root])
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for i in range(0, len(front), 64):
                near |= (np.bitwise_count(fp[front[i : i + 64], None] ^ fp[rest][None, :]) <= radius).any(axis=0)
            front, rest = rest[near], rest[~near]
            out += [(root, int(j)) for j in front]
    return out


def _others(near, rest: np.ndarray) -> np.ndarray:
    """How many others of ``rest`` are near to each of it."""
    counts = [np.count_nonzero(near(rest[i : i + 128, None], rest[None, :]), axis=1) for i in range(0, len(rest), 128)]
    return np.concatenate(counts) - 1 if counts else np.zeros(0, np.int64)


def cover(near, n: int, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (centre, member) of points that are near, and who has partners that are in no pair with it.

    ``near(i, j)`` compares arrays of the points 0 to n - 1, which come in order of preference. Level 0 picks
    centres greedily (no two are near) and gives each other point its first centre only, so a group of copies
    costs a star. Each further level picks centres among those that are none yet and pairs them with all that are near and
    no centres. Points with a pair that was not returned are open at both ends.
    """
    rest = np.arange(n)
    rest = rest[_others(near, rest) > 0]
    centres, members = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not levels:
        owner = np.full(len(rest), -1)
        degree, stars = _others(near, rest), np.zeros(len(rest), np.int64)
        while (owner < 0).any():
            i = int(np.argmax(owner < 0))
            mine = np.flatnonzero((owner < 0) & near(rest[i], rest))
            owner[mine] = i
            stars[i] += len(mine) - 1
        member = owner != np.arange(len(rest))
        stars[member] = 1
        return rest[owner[member]], rest[member], rest[degree > stars]
    for _ in range(levels):
        free, centre, found = np.ones(len(rest), bool), np.zeros(len(rest), bool), []
        while free.any():
            i = int(np.argmax(free))
            close = np.flatnonzero(near(rest[i], rest))
            centre[i], free[close] = True, False
            found.append((i, close))
        for i, close in found:
            members.append(rest[close[~centre[close]]])
            centres.append(np.full(len(members[-1]), rest[i]))
        rest = rest[~centre]
    return np.concatenate(centres), np.concatenate(members), rest[_others(near, rest) > 0]


def _searched(nodes: DataFrame, radius: int, parts: int, shard: int, found) -> DataFrame:
    """``found(fp, node, part)`` of every leaf of every part's tree, as rows (u, v); ``nodes`` has fp and node."""
    reach, masks, total = radius // parts, part_masks(parts), nodes.count()
    every = max(1, total // SAMPLE)
    sample = np.array([r.fp for r in nodes.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").limit(2 * SAMPLE).collect()], np.int64).view(np.uint64)  # bounded; only shapes the trees
    leaf = max(8.0, len(sample) * shard / 2 / max(total, 1))
    trees = [grow(sample & np.uint64(m), reach, leaf) for m in masks]

    def deal(batches):
        for batch in batches:
            fp, node = batch["fp"].to_numpy(np.int64), batch["node"].to_numpy(np.int64)
            u = fp.view(np.uint64)
            for k, m in enumerate(masks):
                for number, at in route(trees[k], u & np.uint64(m), reach, np.arange(len(u))):
                    if len(at):
                        yield pd.DataFrame({"part": k, "leaf": str(number), "fp": fp[at], "node": node[at]})

    dealt = nodes.mapInPandas(deal, "part int, leaf string, fp long, node long")
    dealt = spool(dealt, "shards")
    sizes = dealt.groupBy("part", "leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard)).cast("int").alias("cut"))
    own = F.pmod(F.xxhash64("node"), F.col("cut")).cast("int")
    blocks = (
        dealt.join(sizes, ["part", "leaf"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
        .select("part", F.concat_ws("/", "leaf", F.least("own", "other"), F.greatest("own", "other")).alias("leaf"), "fp", "node")
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        fp, node = pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["node"].to_numpy(np.int64)
        part = int(pdf["part"].iloc[0])
        x = fp & np.uint64(masks[part])
        rows = [found(fp[at], node[at], part) for at in map(np.sort, leaves(x, reach, np.arange(len(x))))]
        return pd.concat(rows, ignore_index=True).drop_duplicates() if rows else pd.DataFrame({"u": [], "v": []}, dtype="Int64")

    return blocks.groupBy("part", "leaf").applyInPandas(compare, "u long, v long")


def links(nodes: DataFrame, radius: int = RADIUS, parts: int = PARTS, shard: int = SHARD) -> DataFrame:
    """(u, v) between representatives of distinct fingerprints that join just what all links would join."""

    def found(fp, node, part):
        return pd.DataFrame([(node[i], node[j]) for i, j in forest(fp, radius)], columns=["u", "v"], dtype="Int64")

    return _searched(nodes, radius, parts, shard, found)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row.

    A text without words (null, empty) has fingerprint zero and is linked like any other. Rows that share a
    doc_id count as one node; null ids take part through their fingerprint only. Extra columns are left out.
    """
    fps = spool(fingerprints(docs, size), "fingerprints")
    nodes = spool(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    named = nodes.where("node is not null")
    roots = components(links(named, radius, parts).unionByName(_shared_ids(fps, named)))
    root = named.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(root, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shared_ids(fps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links for a doc_id that stands on texts with different fingerprints."""
    spread = fps.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a != b").select("doc_id")
    return fps.join(spread, "doc_id", "left_semi").join(nodes, "fp").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


#: Of drop_near_duplicates: five words and a similarity of 0.8.
DROP_SHINGLE, DROP_SIMILARITY = 5, 0.8
#: Minhashes of a text: bands of so many rows. Two texts that are 0.8 similar agree on some band but for 3 in 100,000.
BANDS, BAND_ROWS = 20, 4
#: How far below the similarity asked for an estimate may be: over four standard errors, so 1 pair in 100,000 is lost.
SLACK = 0.2
#: Likeliest smaller partners of a text that are judged, in each bucket, before all are.
FIRST_PARTNERS = 2
#: Rows of buckets in a task.
SLOT = 1 << 16


def similarity(a: str | None, b: str | None, size: int = DROP_SHINGLE) -> float:
    """Shared shingles over all shingles of two texts; two texts without words are equal."""
    x, y = _shingle_set(a, size), _shingle_set(b, size)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


@lru_cache(4)
def _shingle_set(text: str | None, size: int) -> frozenset[bytes]:
    return frozenset(map(bytes, shingles(text, size)))


_MIX = np.random.default_rng(SEED).integers(1 << 62, size=(2, BANDS * BAND_ROWS, 1), dtype=np.uint64)


def minhashes(text: str | None, size: int = DROP_SHINGLE) -> np.ndarray | None:
    """The least of every shingle's hash under each of BANDS x BAND_ROWS orders; None for a text without words."""
    found = list(_shingle_set(text, size))
    if not found:
        return None
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    digest = xxhash.xxh3_64_digest
    for i in range(0, len(found), 2048):
        h = np.frombuffer(b"".join([digest(s, SEED) for s in found[i : i + 2048]]), np.uint64)
        mixed = (h ^ _MIX[0]) * (_MIX[1] | np.uint64(1))
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * np.uint64(0x9E3779B97F4A7C15)).min(axis=1))
    return least


def _classes(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, high and low (a 128-bit hash of the words in a row), keys (of each band) and sig (a byte of each minhash)."""

    def run(batches):
        for batch in batches:
            names, keys, sigs = [], [], []
            for t in batch.column("text").to_pylist():
                names.append(xxhash.xxh3_128_digest(b" ".join((t or "").encode().lower().split())))
                least = minhashes(t, size)
                if least is None:
                    keys.append([])
                    sigs.append(b"")
                else:
                    raw = least.tobytes()
                    keys.append([xxhash.xxh3_64_intdigest(raw[8 * BAND_ROWS * b : 8 * BAND_ROWS * (b + 1)], b) - (1 << 63) for b in range(BANDS)])
                    sigs.append((least >> np.uint64(40)).astype(np.uint8).tobytes())
            name = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(name[:, 0].copy()), pa.array(name[:, 1].copy()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "high", "low", "keys", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, high long, low long, keys array<long>, sig binary")


def likely(sig: np.ndarray, there: np.ndarray, least: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (earlier point, point that is still there) whose signatures agree in a share of at least ``least``.

    At most ``most`` earlier points, the likeliest, for each.
    """
    rows, turned = np.flatnonzero(there), np.ascontiguousarray(sig.T)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in (rows[i : i + 128] for i in range(0, len(rows), 128)):
        same = np.zeros((len(at), int(at[-1])), np.uint8)
        for k in range(len(turned)):
            same += turned[k, at, None] == turned[k, None, : at[-1]]
        same[np.arange(at[-1]) >= at[:, None]] = 0
        for i, row in zip(at, same, strict=True):
            found = np.flatnonzero(row >= least * len(turned))
            if most and len(found) > most:
                found = found[np.argpartition(row[found], -most)[-most:]]
            a.append(found)
            b.append(np.full(len(found), i))
    return np.concatenate(a), np.concatenate(b)


def _likely_pairs(members: DataFrame, least: float, most: int | None) -> DataFrame:
    """(u, v), u < v, of ``likely`` within each key of ``members`` (key, node, there, sig)."""
    slots = max(1, -(-members.count() // SLOT))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "node"])
        node, there = pdf["node"].to_numpy(np.int64), pdf["there"].to_numpy(bool)
        sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)
        cut = np.flatnonzero(np.diff(pdf["key"].to_numpy(np.int64))) + 1
        out = [np.zeros((0, 2), np.int64)]
        for i, j in zip([0, *cut], [*cut, len(pdf)], strict=True):
            a, b = likely(sig[i:j], there[i:j], least, most)
            out.append(np.stack([node[i + a], node[i + b]], axis=1))
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["u", "v"])

    return members.withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(slots))).groupBy("slot").applyInPandas(run, "u long, v long").distinct()


def drop_near_duplicates(docs: DataFrame, size: int = DROP_SHINGLE, least: float = DROP_SIMILARITY) -> DataFrame:
    """The rows that stay, all columns as they are: one document of each group of near-duplicates.

    Texts of the same words are one class, of which the smallest doc_id stays. A class goes if its shingles are at least
    ``least`` similar to those of any with a smaller doc_id, be that one there or gone, so what goes does not turn
    on the order of comparisons. Pairs that agree on a band of minhashes are judged on their texts: first each with
    the smallest of its bucket, then who is still there with its likeliest smaller partners, then with all of them. Equal
    rows are one. Rows without a doc_id stay; a doc_id on texts of different words is compared with no other.
    """
    named = spool(_classes(docs.where("doc_id is not null"), size), "classes")
    classes = spool(named.groupBy("high", "low").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"), F.first("sig").alias("sig")), "class-nodes")
    several = named.groupBy("doc_id").agg(F.min(F.struct("high", "low")).alias("a"), F.max(F.struct("high", "low")).alias("b")).where("a != b").select(F.col("doc_id").alias("node"))
    left = classes.join(several, "node", "left_anti")
    every = left.select(F.explode("keys").alias("key"), "node")
    buckets = spool(every.join(every.groupBy("key").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "key"), "buckets")
    texts = spool(docs.join(buckets.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "texts")

    def judge(batches):
        for batch in batches:
            same = [similarity(a, b, size) >= least for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("v").filter(pa.array(same, pa.bool_()))], names=["node"])

    def judged(two: DataFrame) -> DataFrame:
        both = two.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("b")), "v")
        return spool(both.select("v", "a", "b").mapInArrow(judge, "node long").distinct(), "gone")

    gone = judged(buckets.where("first != node").select(F.col("first").alias("u"), F.col("node").alias("v")).distinct())
    for most in (FIRST_PARTNERS, None):
        state = buckets.join(gone.withColumn("gone", F.lit(True)), "node", "left").withColumn("there", F.isnull("gone") & (F.col("node") != F.col("first")))
        open_ = state.groupBy("key").agg(F.max("there").alias("open")).where("open").select("key")
        members = spool(state.join(open_, "key", "left_semi").join(left.select("node", "sig"), "node").select("key", "node", "there", "sig"), "open")
        gone = gone.unionByName(judged(_likely_pairs(members, least - SLACK, most)))
    stay = classes.join(gone, "node", "left_anti")
    kept_ids = stay.select(F.col("node").alias("doc_id")).distinct()
    # a doc_id on several texts stays when any of its classes is first there
    kept = docs.where("doc_id is null").unionByName(docs.join(kept_ids, "doc_id", "left_semi").select(docs.columns))
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return kept
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(kept.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"]))


#: Sketches (kept beside the fingerprints for their tests). One permutation of a text's shingles in so many bins, a byte of the least in each: estimates a similarity with a standard
#: error of 0.013 at most. FOLD bins in a row are one in a first, coarser look, of 0.027.
BINS, FOLD = 1024, 4
#: How far below the similarity asked for these estimates may be: over three and a half standard errors.
SKETCH_SLACK, COARSE_SLACK = 0.05, 0.1
#: Of groups: a fingerprint of so many words of 64 bits, in parts of 16 bits. Two texts that are 0.8 similar differ in a bit with
#: probability 0.152; 3 in 100,000 such pairs are within WIDE_REACH bits on no part, and as many differ in over WIDE_RADIUS bits.
WORDS, WIDE_REACH, WIDE_RADIUS = 8, 1, 110
WIDE_PARTS = 4 * WORDS
_STEPS = (np.arange(WORDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
#: Points that meet in a task (some 100 bytes each), and points times parts that are on their way to tasks at a time: as many parts
#: as that allows are searched together, at least LEAST_PARTS.
WIDE_SHARD, FLIGHT, LEAST_PARTS = 1 << 18, 1 << 21, 2
#: Bins of a tally of shingles.
TALLY = 256
#: Nearest partners in other groups that are judged for each open text, round by round; the last judges all.
ROUNDS = (2, 8, None)


def sketch(text: str | None, size: int = DROP_SHINGLE) -> bytes:
    """A byte for each bin that a shingle falls into, zero for the others."""
    digest, out = xxhash.xxh3_64_digest, np.zeros(BINS, np.uint8)
    h = np.sort(np.frombuffer(b"".join([digest(s, SEED + 1) for s in _shingle_set(text, size)]), ">u8"))
    at, first = np.unique(h >> np.uint64(54), return_index=True)
    out[at.astype(np.int64)] = 1 + (h[first] & np.uint64(0xFFFF)).astype(np.int64) % 255
    return out.tobytes()


def folded(sig: np.ndarray) -> np.ndarray:
    """The sketches with FOLD bins joined: the first that is not empty holds the least of them."""
    parts = sig.reshape(len(sig), -1, FOLD)
    return np.take_along_axis(parts, (parts > 0).argmax(axis=2)[:, :, None], axis=2)[:, :, 0]


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of sketches, each of a with each of b."""
    same = np.zeros((len(a), len(b)), np.int16)
    x, y = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for p, q in zip(x, y, strict=True):
        same += (p[:, None] == q[None, :]) & (p[:, None] > 0)
    u, v = (a > 0).astype(np.float32), (b > 0).astype(np.float32)
    either = u.sum(axis=1)[:, None] + v.sum(axis=1)[None, :] - u @ v.T
    return same / np.maximum(either, 1)


def estimate_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities of sketches, row by row."""
    same, either = ((a == b) & (a > 0)).sum(axis=1), ((a > 0) | (b > 0)).sum(axis=1)
    return same / np.maximum(either, 1)


def _rows_of_texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), "text")


def wide_fingerprint(text: str | None, size: int = DROP_SHINGLE) -> bytes:
    """SimHash of WORDS x 64 bits over a text's distinct shingles: a bit is 1 if more than half of their hashes have it."""
    found, ones = list(_shingle_set(text, size)), np.zeros(64 * WORDS, np.int64)
    digest = xxhash.xxh3_64_digest
    for i in range(0, len(found), _CHUNK):
        h = np.frombuffer(b"".join([digest(s, SEED) for s in found[i : i + _CHUNK]]), np.uint64)[:, None] + _STEPS
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((h ^ (h >> np.uint64(31))).view(np.uint8), axis=1)
        for j in range(0, len(bits), 255):  # as many fit into a byte
            ones += bits[j : j + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(found)).tobytes()


def _printed(rows: DataFrame, size: int) -> DataFrame:
    """doc_id, tag, high and low (a 128-bit hash of the words in a row), sig (the wide fingerprint)."""

    def run(batches):
        for batch in parts(batches):
            texts = batch.column("text").to_pylist()
            name = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join((t or "").encode().lower().split())) for t in texts), np.int64).reshape(-1, 2)
            columns = [batch.column("doc_id"), batch.column("tag"), pa.array(name[:, 0].copy()), pa.array(name[:, 1].copy()), pa.array([wide_fingerprint(t, size) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "high", "low", "sig"])

    return rows.mapInArrow(run, "doc_id long, tag long, high long, low long, sig binary")


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WORDS)


def tally(text: str | None, size: int = DROP_SHINGLE) -> bytes:
    """How many of a text's distinct shingles fall into each of TALLY bins, a byte each; 255 all over if one has more than a byte holds."""
    h = np.frombuffer(b"".join([xxhash.xxh3_64_digest(s, SEED + 2) for s in _shingle_set(text, size)]), np.uint64)
    counts = np.bincount((h % np.uint64(TALLY)).astype(np.int64), minlength=TALLY)
    return (counts if counts.max() < 255 else np.full(TALLY, 255)).astype(np.uint8).tobytes()


def possible(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Whether texts of tallies ``a`` and ``b`` with ``n`` and ``m`` distinct shingles may be ``least`` similar, row by row.

    They share at most the lesser count of each bin. The quotient is rounded as that of ``similarity``, so no pair is lost.
    """
    free = (a[:, 0] == 255) | (b[:, 0] == 255)
    both = np.where(free, np.minimum(n, m), np.minimum(a, b).sum(axis=1, dtype=np.int64))
    return both / np.maximum(n + m - both, 1) >= least


def _tallied(still: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """``still`` with tally and n, a text's tally and how many distinct shingles it has."""

    def run(batches):
        for batch in parts(batches):
            found = [(tally(t, size), len(_shingle_set(t, size))) for t in batch.column("text").to_pylist()]
            columns = [pa.array([c for c, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "tag", "root", "sig")), *columns], names=["node", "tag", "root", "sig", "tally", "n"])

    rows = still.join(texts.select(F.col("doc_id").alias("node"), "tag", "text"), ["node", "tag"])
    return rows.select("node", "tag", "root", "sig", "text").mapInArrow(run, "node long, tag long, root long, sig binary, tally binary, n long")


def partners(sig: np.ndarray, node: np.ndarray, root: np.ndarray, part: int, radius: int, most: int | None, may=None):
    """Pairs (p, q) of points of different roots within ``radius`` bits and within WIDE_REACH of ``part``, and who has more.

    A vantage-point tree over the part's bits leads to leaves, where points are compared. Of each point, most 0: the partner of
    the smallest node only; else the ``most`` nearest (None: all), a pair only by the first part on which it agrees. Both ends of a pair
    that is not returned for that number are open. ``may(p, q)`` tells which pairs of points count at all.
    """
    pieces = sig.view(np.uint16)
    x, open_ = np.ascontiguousarray(pieces[:, part]), np.zeros(len(sig), bool)
    out = [np.zeros((0, 2), np.int64)]
    for at in leaves(x, WIDE_REACH, np.arange(len(x))):
        mine, step = x[at], max(1, (1 << 20) // len(at))
        for i in range(0, len(at), step):
            rows = at[i : i + step]
            p, q = np.nonzero(np.bitwise_count(x[rows][:, None] ^ mine[None, :]) <= WIDE_REACH)
            p, q = rows[p], at[q]
            other = root[p] != root[q]
            p, q = p[other], q[other]
            bits = np.concatenate([np.zeros(0, np.uint16), *(np.bitwise_count(sig[p[j : j + (1 << 16)]] ^ sig[q[j : j + (1 << 16)]]).sum(axis=1, dtype=np.uint16) for j in range(0, len(p), 1 << 16))])
            good = np.flatnonzero(bits <= radius)
            if may is not None:
                good = good[may(p[good], q[good])]
            if most != 0:
                good = np.concatenate([np.zeros(0, np.int64), *(g[(np.bitwise_count(pieces[p[g]] ^ pieces[q[g]]) <= WIDE_REACH).argmax(axis=1) == part] for g in (good[j : j + (1 << 16)] for j in range(0, len(good), 1 << 16)))])
            p, q, bits = p[good], q[good], bits[good]
            if most is not None:
                order = np.lexsort((node[q] if most == 0 else bits, p))
                p, q = p[order], q[order]
                more = np.arange(len(p)) - np.searchsorted(p, p) >= max(most, 1)
                open_[p[more]] = open_[q[more]] = True
                p, q = p[~more], q[~more]
            out.append(np.sort(np.stack([p, q], axis=1), axis=1))
    return np.unique(np.concatenate(out), axis=0), np.flatnonzero(open_)


def candidates(points: DataFrame, most: int | None, radius: int = WIDE_RADIUS, shard: int = WIDE_SHARD, least: float = DROP_SIMILARITY, flight: int = FLIGHT) -> DataFrame:
    """(u, ut, v, vt): see ``partners``, over all parts; open points are rows (u, ut) without v. ``points`` has node, tag, root, sig
    and may have tally and n (see ``possible``).

    The top of each part's vantage-point tree is grown on a bounded sample and routes every point to shards. A shard of too many
    points is compared block against block. Parts are searched a few at a time, each time written, so that the points on their way
    to the shards take disk for so many parts only.
    """
    total, carried = points.count(), [c for c in ("node", "tag", "root", "sig", "tally", "n") if c in points.columns]
    every = max(1, total // SAMPLE)
    drawn = points.where(F.pmod(F.xxhash64("node", "tag"), F.lit(every)) == 0).select("sig").limit(2 * SAMPLE).collect()  # bounded; only shapes the trees
    sample = np.frombuffer(b"".join(r.sig for r in drawn), np.uint16).reshape(-1, WIDE_PARTS)
    leaf = max(8.0, len(sample) * shard / 2 / max(total, 1))
    trees = [grow(np.ascontiguousarray(sample[:, k]), WIDE_REACH, leaf) for k in range(WIDE_PARTS)]

    def routed(batch, some=range(WIDE_PARTS)):
        pieces = _signatures(batch.column("sig")).view(np.uint16)
        for k in some:
            for number, at in route(trees[k], pieces[:, k].astype(np.uint64), WIDE_REACH, np.arange(len(pieces))):
                if len(at):
                    yield k, str(number), at

    def count(batches):
        sizes: Counter = Counter()
        for batch in batches:
            for k, number, at in routed(batch):
                sizes[k, number] += len(at)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sizes], pa.int32()), pa.array([m for _, m in sizes], pa.string()), pa.array(list(sizes.values()), pa.int64())], names=["part", "leaf", "n"])

    sizes = points.select("sig").mapInArrow(count, "part int, leaf string, n long").groupBy("part", "leaf").agg(F.sum("n").alias("n"))
    cuts = {(r.part, r.leaf): -(-r.n // shard) for r in sizes.where(F.col("n") > shard).collect()}  # at most one row for each shard's worth of points

    def search(some: range) -> DataFrame:
        def deal(batches):
            for batch in batches:
                own = batch.column("node").to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + batch.column("tag").to_numpy().view(np.uint64)
                cells: dict[int, list[tuple[str, np.ndarray]]] = {k: [] for k in some}
                for k, number, at in routed(batch, some):
                    cut = cuts.get((k, number), 1)
                    block = (own[at] >> np.uint64(20)) % np.uint64(cut)
                    cells[k] += [(f"{number}/{a}/{b}", at[(block == a) | (block == b)]) for b in range(cut) for a in range(b + 1)]
                for k, found in cells.items():
                    at = np.concatenate([a for _, a in found] or [np.zeros(0, np.int64)])
                    names = pa.array(np.repeat(np.array([c for c, _ in found], object), [len(a) for _, a in found]).tolist(), pa.string())
                    taken = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), names, *(taken.column(c) for c in carried)], names=["part", "cell", *carried])

        dealt = points.select(carried).mapInArrow(deal, "part int, cell string, " + ", ".join(f"{c} {'binary' if c in ('sig', 'tally') else 'long'}" for c in carried))
        return dealt.groupBy("part", "cell").applyInArrow(compare, "u long, ut long, v long, vt long").distinct()

    def compare(table: pa.Table) -> pa.Table:
        node, tag, root = (table.column(c).to_numpy() for c in ("node", "tag", "root"))
        may = None
        if "tally" in carried:
            counts, n = np.frombuffer(b"".join(table.column("tally").to_pylist()), np.uint8).reshape(-1, TALLY), table.column("n").to_numpy()

            def may(p, q):
                return np.concatenate([np.zeros(0, bool), *(possible(counts[p[i : i + (1 << 12)]], counts[q[i : i + (1 << 12)]], n[p[i : i + (1 << 12)]], n[q[i : i + (1 << 12)]], least) for i in range(0, len(p), 1 << 12))])

        pairs, more = partners(_signatures(table.column("sig")), node, root, table.column("part")[0].as_py(), radius, most, may)
        none = pa.nulls(len(more), pa.int64())
        u, v = pairs.T
        columns = [pa.chunked_array([pa.array(a[i]), pa.array(a[more]) if end else none]) for i, end in ((u, True), (v, False)) for a in (node, tag)]
        found = pa.table(columns, names=["u", "ut", "v", "vt"])
        release()
        return found

    step = min(WIDE_PARTS, max(LEAST_PARTS, flight // max(total, 1)))
    if step == WIDE_PARTS:
        return search(range(WIDE_PARTS))
    return reduce(DataFrame.unionByName, [spool(search(range(k, min(k + step, WIDE_PARTS))), "found") for k in range(0, WIDE_PARTS, step)]).distinct()


def groups(docs: DataFrame, size: int = DROP_SHINGLE, least: float = DROP_SIMILARITY) -> DataFrame:
    """(node, root): texts whose shingles are at least ``least`` similar are linked; root is the smallest doc_id reachable.

    Only doc_ids in a group with others have a row. Texts of the same words are one, with its smallest doc_id as its node; a
    doc_id on several texts joins them. Texts without words are equal. Rows without a doc_id take no part.
    Wide fingerprints propose pairs, found by a vantage-point tree for each part, and texts judge them: first each with the
    partner of the smallest doc_id, then those who have more partners, in other groups, with the nearest of them, at last with all of
    them. Pairs within a group are never made, nor those that ``possible`` rules out: tallies of
    the shingles show that for nearly all that are not similar. So a large group of near-copies costs a few links for each text.
    """
    rows = _rows_of_texts(docs)
    named = spool(_printed(rows, size), "printed")
    classes = spool(named.groupBy("high", "low").agg(F.min(F.struct("doc_id", "tag", "sig")).alias("rep")), "classes")
    members = named.select("doc_id", "high", "low").distinct().join(classes.select("high", "low", F.col("rep.doc_id").alias("node")), ["high", "low"])
    links = spool(members.where("doc_id != node").select(F.col("node").alias("u"), F.col("doc_id").alias("v")), "copies")
    points = classes.select(F.col("rep.doc_id").alias("node"), F.col("rep.tag").alias("tag"), F.col("rep.sig").alias("sig"))
    first = spool(candidates(points.withColumn("root", F.col("node")), 0), "candidates")
    ends = first.select(F.col("u").alias("doc_id"), F.col("ut").alias("tag")).unionByName(first.where("v is not null").select(F.col("v").alias("doc_id"), F.col("vt").alias("tag")))
    texts = spool(rows.join(ends.distinct(), ["doc_id", "tag"], "left_semi").dropDuplicates(["doc_id", "tag"]), "texts")

    def judge(batches):
        for batch in parts(batches, "a"):
            same = [similarity(a, b, size) >= least for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(same, pa.bool_()))

    def judged(two: DataFrame) -> DataFrame:
        a = texts.select(F.col("doc_id").alias("u"), F.col("tag").alias("ut"), F.col("text").alias("a"))
        b = texts.select(F.col("doc_id").alias("v"), F.col("tag").alias("vt"), F.col("text").alias("b"))
        return spool(two.join(a, ["u", "ut"]).join(b, ["v", "vt"]).select("u", "v", "a", "b").mapInArrow(judge, "u long, v long").distinct(), "alike")

    links = links.unionByName(judged(first.where("v is not null")))
    found = first
    for most in ROUNDS:
        more = found.where("v is null").select(F.col("u").alias("node"), F.col("ut").alias("tag"))
        if more.isEmpty():
            break
        still = spool(points.join(more, ["node", "tag"], "left_semi").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node")), "open")
        found = spool(candidates(spool(_tallied(still, texts, size), "tallied"), most, least=least), "candidates")
        links = links.unionByName(judged(found.where("v is not null")))
    return components(links)


def one_of_each(docs: DataFrame, size: int = DROP_SHINGLE, least: float = DROP_SIMILARITY) -> DataFrame:
    """One document of each group of near-duplicates (see groups), the smallest doc_id, all columns as they are.

    Of rows that share that doc_id one with the smallest text stays, null first. Rows without a doc_id stay all.
    """
    gone = groups(docs, size, least).where("node != root").select(F.col("node").alias("doc_id"))
    stay = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return stay
    least_text = stay.join(again, "doc_id", "left_semi").select(docs.columns)
    first = least_text.groupBy("doc_id").agg(F.min(F.struct("text")).alias("t")).select("doc_id", F.col("t.text").alias("__text"))
    same = least_text.join(first, "doc_id").where(F.col("text").eqNullSafe(F.col("__text"))).select(docs.columns).dropDuplicates(["doc_id"])
    return stay.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(same)
