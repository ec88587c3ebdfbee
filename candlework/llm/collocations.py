"""Phrase collocations by hashed bucket counts: each pass counts n-grams exactly and the next length in buckets.

Pass k reads all texts. It counts the n-grams of k words that can be frequent, and adds those of k + 1 words to a table of
2 ** BITS buckets. After the pass two bitmaps are broadcast, of 2 ** BITS bits each, whatever the input: which buckets
reached the threshold, and in which buckets the frequent n-grams of k words lie. The next pass counts an n-gram only
if its bucket is set and both n-grams of one word less are set (Apriori). Bits can only let too much through; what is
counted is counted by its word hashes and cut at the threshold, so results are exact at any number of bits.

Words are hashed to 64 bits together with their language; should two words of the corpus share a hash, the next seed is
taken. Text is split and hashed on arrays of bytes; only a batch's distinct words become strings. A text longer than a slice
is cut where pieces end. Counts combine in each task before they are shuffled; those of n-grams travel as arrays, one for
each of PARTS ranges of their hash, and are summed on arrays range by range. Only what is frequent becomes rows.

Null text is an empty one; null lang is ``und``, the same as a lang of that name. Other columns are not read. Repeated rows
count as often as they stand. Nothing is returned for a lang without a frequent phrase.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlework.llm.common import parts, read, release, spool

BLANKS, ENDS = b" \t", b".,;:!?\n\x0b\x0c\r"
LEAST, LONGEST, KEEP, SHARE = 10, 3, 2000, 50
#: Buckets are 2 ** BITS counters of a byte in a task and as many bits in a broadcast: 64 MB and 8 MB.
BITS = 26
#: Bytes of text at a time, and rows of counts that a task holds before it hands them on.
SLICE, HELD = 1 << 21, 1 << 19
SALTS = 32
#: Ranges of hashes; the distinct candidates of one range are held at a time.
PARTS = 1024

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)], _KIND[list(ENDS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _joined(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from that of its words but the last, and the last."""
    return _mixed(g * np.uint64(0x9E3779B97F4A7C15) + h)


class Words:
    """The words of one slice: hash, whether the next one is in the same piece, and where each lies."""

    def __init__(self, raw: bytes, ends: np.ndarray, langs: np.ndarray, seeds: np.ndarray):
        """``ends``: end of each text in ``raw``; ``langs``: number of its language; ``seeds``: a hash of each language."""
        self.low = _LOWER[np.frombuffer(raw, np.uint8)]
        kind = _KIND[self.low]
        inside = np.concatenate(([False], kind == 0, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.size = edges[::2], edges[1::2] - edges[::2]
        if not len(self.start):
            self.hash, self.next, self.lang = np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, np.int64)
            return
        first = np.concatenate(([0], np.cumsum(self.size)[:-1]))
        letters = self.low[kind == 0].astype(np.uint64) + np.uint64(1)
        place = np.arange(len(letters)) - np.repeat(first, self.size)
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(self.size.max()), 0x5851F42D4C957F2D, np.uint64))))
        self.lang = langs[np.searchsorted(ends, self.start, side="right")]
        self.hash = _mixed(_mixed(np.add.reduceat(letters * power[place], first) + self.size.astype(np.uint64)) ^ seeds[self.lang])
        piece = np.searchsorted(np.flatnonzero(kind == 2), self.start)
        self.next = np.concatenate((piece[1:] == piece[:-1], [False]))

    def strings(self, at: np.ndarray) -> pa.Array:
        size = self.size[at]
        upto = np.concatenate(([0], np.cumsum(size)))
        byte = np.arange(upto[-1]) - np.repeat(upto[:-1], size) + np.repeat(self.start[at], size)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(upto.astype(np.int32)), pa.py_buffer(self.low[byte].tobytes()))


def _seeds(langs: list[str], seed: int) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{x}".encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)


def _slices(batches: Iterable[pa.RecordBatch], seed: int) -> Iterator[tuple[Words, list[str]]]:
    for batch in parts(batches, size=SLICE):
        coded = pc.fill_null(batch.column("lang"), "und").dictionary_encode()
        names, langs = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        texts = pc.fill_null(batch.column("text"), "")
        raw = "\n".join(texts.to_pylist()).encode()
        ends = np.cumsum(pc.binary_length(texts).to_numpy() + 1)
        seeds = _seeds(names, seed)
        if len(raw) <= 2 * SLICE:
            yield Words(raw, ends, langs, seeds), names
            continue
        at = 0  # a long text: parts that end where a piece ends
        stops = np.flatnonzero(_KIND[np.frombuffer(raw, np.uint8)] == 2) + 1
        while at < len(raw):
            k = int(np.searchsorted(stops, at + SLICE, side="right")) - 1
            stop = int(stops[k]) if k >= 0 and stops[k] > at else int(stops[k + 1]) if k + 1 < len(stops) else len(raw)
            yield Words(raw[at:stop], ends - at, langs, seeds), names
            at = stop


def _counted(order: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """After sorting by ``order``: the place of one row of each run of equal ``columns``, and its length."""
    by = np.argsort(order, kind="stable")
    new = np.ones(len(by), bool)
    for c in columns:
        s = c[by]
        new[1:] &= s[1:] == s[:-1]
    new[1:] = ~new[1:]
    at = np.flatnonzero(new)
    return by[at], np.diff(np.concatenate((at, [len(by)])))


class Buckets:
    """Counters of a byte that stop at 255, handed on as the buckets of each block that are not zero."""

    def __init__(self, bits: int):
        self.bits, self.table = bits, np.zeros(1 << bits, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        b, n = np.unique(hashes >> np.uint64(64 - self.bits), return_counts=True)
        self.table[b] = np.minimum(self.table[b].astype(np.int64) + n, 255)

    def rows(self) -> Iterator[dict]:
        for block in range(1 << (self.bits - 16)):
            counts = self.table[block << 16 : (block + 1) << 16]
            at = np.flatnonzero(counts)
            if len(at):
                yield {"block": block, "places": at.astype("<u2").tobytes(), "counts": counts[at].tobytes()}


def _bit(bitmap: Broadcast, hashes: np.ndarray, bits: int) -> np.ndarray:
    at = hashes >> np.uint64(64 - bits)
    return (bitmap.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _held(rows: list[pa.Table], keys: list[str]) -> pa.Table:
    grouped = pa.concat_tables(rows).group_by(keys, use_threads=False).aggregate([("n", "sum")])
    return grouped.rename_columns([c.removesuffix("_sum") for c in grouped.column_names])


_BLOCK = "block int, places binary, counts binary"
_GRAMS = "part int, grams binary, sums binary, " + _BLOCK
_WORDS = "lang string, word string, h1 long, n long, " + _BLOCK


def _typed(schema: str) -> tuple[list[str], list[pa.DataType]]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    split = [c.split() for c in schema.split(", ")]
    return [c for c, _ in split], [kinds[t] for _, t in split]


def _schema(k: int) -> str:
    return _WORDS if k == 1 else _GRAMS


def _pass(k: int, longest: int, bits: int, seed: int, frequent: Broadcast | None, buckets: Broadcast | None):
    names, types = _typed(_schema(k))
    keys = ["lang", "word", "h1"] if k == 1 else [f"h{i}" for i in range(1, k + 1)]

    def counts(w: Words, langs: list[str], upcoming: Buckets | None) -> pa.Table | None:
        grams, valid = w.hash, np.ones(len(w.hash), bool)
        able = valid
        for i in range(1, k):
            if i == k - 1:
                able = _bit(frequent, grams, bits) & valid
            valid = valid & np.concatenate((w.next[i - 1 :], np.zeros(i - 1, bool)))
            grams = _joined(grams, np.concatenate((w.hash[i:], np.zeros(i, np.uint64))))
        if k > 1:
            able = able & np.concatenate((able[1:], [False])) & valid
            able[able] = _bit(buckets, grams[able], bits)
        if upcoming is not None:
            more = able[:-1] & able[1:] & np.concatenate((w.next[k - 1 :], np.zeros(k - 1, bool)))[:-1]
            at = np.flatnonzero(more)
            upcoming.add(_joined(grams[at], w.hash[at + k]))
        at = np.flatnonzero(able)
        if not len(at):
            return None
        columns = [w.hash[at + i] for i in range(k)]
        one, n = _counted(grams[at], columns)
        data = {f"h{i + 1}": pa.array(c[one].view(np.int64)) for i, c in enumerate(columns)}
        if k == 1:
            data = {"lang": pa.array(langs, pa.string()).take(pa.array(w.lang[at[one]])), "word": w.strings(at[one])} | data
        return pa.table(data | {"n": pa.array(n)})

    def row(**values) -> pa.RecordBatch:
        return pa.record_batch([pa.array([values.get(c)], t) for c, t in zip(names, types, strict=True)], names=names)

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if k == 1:
            for piece in table.to_batches(max_chunksize=1 << 14):
                yield pa.record_batch([*(piece.column(c) for c in names[:4]), *(pa.nulls(len(piece), t) for t in types[4:])], names=names)
            return
        columns = [table[c].to_numpy().view(np.uint64) for c in keys]
        part = _hash(columns) >> np.uint64(54)
        by = np.argsort(part, kind="stable")
        grams, sums = np.stack([c[by] for c in columns], axis=1).astype("<u8"), table["n"].to_numpy()[by].astype("<i8")
        cuts = np.searchsorted(part[by], np.arange(PARTS + 1))
        for p in np.flatnonzero(np.diff(cuts)):
            yield row(part=int(p), grams=grams[cuts[p] : cuts[p + 1]].tobytes(), sums=sums[cuts[p] : cuts[p + 1]].tobytes())

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, upcoming, empty = [], Buckets(bits) if k < longest else None, True
        for w, langs in _slices(batches, seed):
            if not len(w.hash):
                continue
            empty = False
            found = counts(w, langs, upcoming)
            if found is not None:
                held.append(found)
            if sum(map(len, held)) > 2 * HELD:
                held = [_held(held, keys)]
                if len(held[0]) > HELD:
                    yield from out(held.pop())
        if held:
            yield from out(_held(held, keys))
        if upcoming is not None and not empty:
            for block in upcoming.rows():
                yield row(**block)
        release()

    return work


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    g = columns[0]
    for h in columns[1:]:
        g = _joined(g, h)
    return g


def _summed(k: int, least: int):
    """Sums the counts of a sorted partition, one range of hashes at a time, and hands on what is frequent."""

    def merged(grams: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        g, n = np.concatenate(grams), np.concatenate(sums)
        by = np.lexsort(g.T)
        g, n = g[by], n[by]
        at = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]).any(1))))
        return g[at], np.add.reduceat(n, at)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, grams, sums, size, kept = None, [], [], 0, 0

        def done() -> Iterator[pa.RecordBatch]:
            g, n = merged(grams, sums)
            g, n = g[n >= least].view(np.int64), n[n >= least]
            if len(n):
                yield pa.record_batch([*(pa.array(g[:, i]) for i in range(k)), pa.array(n)], names=[*(f"h{i}" for i in range(1, k + 1)), "n"])

        for batch in batches:
            for p, g, n in zip(*(batch.column(c).to_pylist() for c in ("part", "grams", "sums")), strict=True):
                if p != part:
                    if grams:
                        yield from done()
                    part, grams, sums, size, kept = p, [], [], 0, 0
                grams.append(np.frombuffer(g, "<u8").reshape(-1, k))
                sums.append(np.frombuffer(n, "<i8"))
                size += len(sums[-1])
                if size > 2 * kept + HELD:
                    g, n = merged(grams, sums)
                    grams, sums, size, kept = [g], [n], len(n), len(n)
        if grams:
            yield from done()
        release()

    return work


def _set_bits(least: int):
    """Sums the blocks of a sorted partition and turns each into bits: ``least`` reached or not."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros(1 << 16, np.int64)
        made = lambda: pa.record_batch([pa.array([block], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()])], names=["block", "bits"])
        for batch in batches:
            for b, places, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "places", "counts")), strict=True):
                if b != block:
                    if block is not None:
                        yield made()
                    block = b
                    total[:] = 0
                total[np.frombuffer(places, "<u2")] += np.frombuffer(counts, np.uint8)
        if block is not None:
            yield made()

    return work


def _bitmap(blocks: DataFrame, least: int, bits: int) -> Broadcast:
    """A broadcast of 2 ** bits bits, from the rows that the buckets of all tasks make."""
    spark = blocks.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = np.zeros(1 << (bits - 3), np.uint8)
    summed = blocks.repartition(n, "block").sortWithinPartitions("block").mapInArrow(_set_bits(least), "block int, bits binary")
    for r in summed.collect():  # 2 ** (bits - 16) rows of 8 KB at most
        whole[r.block << 13 : (r.block + 1) << 13] = np.frombuffer(r.bits, np.uint8)
    return spark.sparkContext.broadcast(whole)


def _marked(grams: DataFrame, k: int, bits: int) -> Broadcast:
    """A bitmap of the buckets in which these n-grams lie."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(bits)
        for batch in batches:
            buckets.add(_hash([batch.column(f"h{i}").to_numpy().view(np.uint64) for i in range(1, k + 1)]))
        for row in buckets.rows():
            yield pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int32()), ("places", pa.binary()), ("counts", pa.binary())]))

    return _bitmap(grams.select(*[f"h{i}" for i in range(1, k + 1)]).mapInArrow(work, _BLOCK), 1, bits)


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = BITS) -> tuple[DataFrame, list[DataFrame]]:
    """Totals (lang, total) and for each length k the n-grams with n >= least: h1 to hk, n; words also with lang and word."""
    if not 16 <= bits <= 30:
        raise ValueError("bits: 16 to 30")
    texts, seed = docs.select("lang", "text"), 0
    while True:
        rows = spool(texts.mapInArrow(_pass(1, longest, bits, seed, None, None), _schema(1)), "grams-1")
        words = spool(rows.where("n is not null").groupBy("lang", "word", "h1").agg(F.sum("n").alias("n")), "words")
        if words.groupBy("h1").count().where("count > 1").isEmpty():
            break
        seed += 1
    totals, found = words.groupBy("lang").agg(F.sum("n").alias("total")), [words.where(F.col("n") >= least)]
    for k in range(2, longest + 1):
        before = _marked(found[-1], k - 1, bits)
        buckets = _bitmap(rows.where("block is not null").select("block", "places", "counts"), least, bits)
        rows = spool(texts.mapInArrow(_pass(k, longest, bits, seed, before, buckets), _schema(k)), f"grams-{k}")
        parts = rows.where("part is not null").select("part", "grams", "sums").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")
        keys = ", ".join(f"h{i} long" for i in range(1, k + 1))
        found.append(spool(parts.sortWithinPartitions("part").mapInArrow(_summed(k, least), f"{keys}, n long"), f"frequent-{k}"))
    return totals, found


def _keyed(grams: DataFrame, first: int, size: int, name: str) -> DataFrame:
    """n-grams of ``size`` words, to be joined at word ``first`` of longer ones; their count under ``name``."""
    return grams.select(*[F.col(f"h{i}").alias(f"h{first + i - 1}") for i in range(1, size + 1)], F.col("n").alias(name))


def _floor_score(a: Column, left: Column, right: Column) -> Column:
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, keep: int = KEEP, share: int = SHARE, bits: int = BITS) -> DataFrame:
    """The first ``keep`` phrases of each lang: lang, rank, phrase, a, l, r, n, score."""
    totals, found = frequent(docs, least, longest, bits)
    words = found[0].select("lang", "word", "h1", "n")
    out = None
    for k in range(2, longest + 1):
        rows, keys = found[k - 1].withColumnRenamed("n", "a"), [f"h{i}" for i in range(1, k + 1)]
        for m in range(k + 1, longest + 1):  # phrases that lie in a longer one too often are dropped
            inside = None
            for first in range(1, m - k + 2):
                part = found[m - 1].select(*[F.col(f"h{first + i}").alias(f"h{i + 1}") for i in range(k)], "n")
                inside = part if inside is None else inside.unionByName(part)
            most = inside.groupBy(*keys).agg(F.max("n").alias("longer"))
            rows = rows.join(most, keys, "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).drop("longer")
        for cut in range(1, k):
            rows = rows.join(_keyed(found[cut - 1], 1, cut, f"l{cut}"), keys[:cut]).join(_keyed(found[k - cut - 1], cut + 1, k - cut, f"r{cut}"), keys[cut:])
        cuts = F.array_min(F.array(*[F.struct(_floor_score(F.col("a"), F.col(f"l{c}"), F.col(f"r{c}")).alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")) for c in range(1, k)]))
        rows = rows.select(*keys, "a", cuts.alias("cut"))
        for i, key in enumerate(keys):
            text = words.select(F.col("h1").alias(key), F.col("word").alias(f"w{i}"), *([] if i else ["lang"]))
            rows = rows.join(text, key)
        rows = rows.select("lang", F.concat_ws(" ", *[f"w{i}" for i in range(k)]).alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
        out = rows if out is None else out.unionByName(rows)
    order = (F.desc("score"), F.desc("a"), "phrase")
    salted = out.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= keep)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= keep)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


#: In DuckDB every n-gram is counted; no buckets.
OP11_SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
runs AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces),
one AS MATERIALIZED (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(ws) AS w FROM runs) GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS n FROM one GROUP BY lang),
two AS MATERIALIZED (SELECT lang, ws[i] AS x, ws[i + 1] AS y, count(*) AS n FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM runs) GROUP BY ALL HAVING count(*) >= {LEAST}),
three AS MATERIALIZED (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z, count(*) AS n FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM runs WHERE len(ws) > 2) GROUP BY ALL HAVING count(*) >= {LEAST}),
inside AS (SELECT lang, x, y, max(n) AS n FROM (SELECT lang, x, y, n FROM three UNION ALL SELECT lang, y, z, n FROM three) GROUP BY ALL),
cuts AS (
  SELECT t.lang, t.x || ' ' || t.y AS phrase, 1 AS cut, t.n AS a, p.n AS l, q.n AS r FROM two t JOIN one p ON p.lang = t.lang AND p.w = t.x JOIN one q ON q.lang = t.lang AND q.w = t.y LEFT JOIN inside i ON i.lang = t.lang AND i.x = t.x AND i.y = t.y WHERE i.n IS NULL OR 100 * i.n < {SHARE} * t.n
  UNION ALL SELECT t.lang, concat_ws(' ', t.x, t.y, t.z), 1, t.n, p.n, q.n FROM three t JOIN one p ON p.lang = t.lang AND p.w = t.x JOIN two q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
  UNION ALL SELECT t.lang, concat_ws(' ', t.x, t.y, t.z), 2, t.n, p.n, q.n FROM three t JOIN two p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN one q ON q.lang = t.lang AND q.w = t.z),
scored AS (SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, CAST(t.n AS BIGINT) AS n, score FROM ranked JOIN totals t USING (lang) WHERE rank <= {KEEP}
"""
