"""Spelling variants: words one edit apart, found through forward and reversed dictionaries.

Let u be the shorter word of a pair, or either if they are equally long, L its length and e the length of what both
begin with. If one edit makes one of the other it is at place e: so they share e letters in front and L - e - 1 or more
at the end. The places 0 to L are halved: if e is in the upper half, the first half of u is intact and both
stand in one block of the forward dictionary (same first letters); else the last half is, and they stand in
one block of the reversed dictionary. A block of more than BLOCK words is subdivided in the same way: the places
that are left are halved again, so its words meet by a longer shared beginning, or by the beginning and an ending. A span
of one place can't be halved; its words differ in one letter, so the alphabet bounds them.

A word enters as the shorter one (L letters) and as the longer one (L - 1). A pair is reported only in the span
that holds its e, so exactly once. Blocks go by a 64-bit hash of span, beginning and ending; a collision adds words to a
block and no pair, for every pair is verified on its letters. Blocks are ranges of sorted partitions and are scanned as they
come; a task holds one batch and one block. All words are kept, whatever their length.

A null text has no runs, a null doc_id counts as an empty text in front of the colon; repeated rows count as often as they
stand; other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlework.llm.common import read, release, spool

#: The shortest word and fewest occurrences, and how many times more frequent a form has to be.
LETTERS, LEAST, TIMES = 7, 2, 10
#: Words of a block that are compared with one another; larger blocks are subdivided.
BLOCK = 48
#: Longer words are compared one by one instead of in a matrix.
WIDE = 64


def runs(docs: DataFrame, letters: int = LETTERS) -> DataFrame:
    """word and n: maximal runs of letters of all texts, A-Z lower-cased, one letter lost where 31 divides the run's hash in its document."""
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(rf"[A-Za-zÀ-ÿ]{{{letters},}}"), 0)).alias("run"))
    low = found.select("doc", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    h = F.crc32(F.concat_ws(":", "doc", "run"))
    hashed = low.select("run", F.when(h % 31 == 0, (h % F.length("run")).cast("int")).alias("gone"))
    word = F.when(F.col("gone").isNull(), F.col("run")).otherwise(F.concat(F.expr("substring(run, 1, gone)"), F.expr("substring(run, gone + 2)")))
    return hashed.select(word.alias("word")).where(F.length("word") >= letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows of (word, n, short, low, high) with the block of their span [low, high)."""
    ending = F.expr("right(word, greatest(short - high, 0))")
    return rows.withColumn("key", F.xxhash64("short", "low", "high", F.expr("left(word, low)"), ending))


def _halves(rows: DataFrame) -> DataFrame:
    mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    spans = F.array(F.struct(F.col("low").alias("low"), mid.alias("high")), F.struct(mid.alias("low"), F.col("high").alias("high")))
    return rows.select("word", "n", "short", F.inline(spans).alias("low", "high"))


def near_pairs(words: DataFrame, block: int = BLOCK, letters: int = LETTERS) -> DataFrame:
    """(u, nu, v, nv) for every two words that one inserted, deleted or replaced letter makes equal, each pair once."""
    roles = F.filter(F.array(F.length("word"), F.length("word") - 1), lambda k: k >= letters)
    rows = words.select("word", "n", F.explode(roles).alias("short")).withColumn("low", F.lit(0)).withColumn("high", F.col("short") + 1)
    spark, parts = words.sparkSession, []
    while True:
        rows = spool(_keyed(_halves(rows)), "spans")
        # a span of one place is bounded by the alphabet and is not halved again
        hot = spool(rows.where("high - low > 1").groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > block).select("key"), "hot-blocks")
        if hot.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(hot, "key", "left_anti").select(*rows.columns))
        rows = rows.join(hot, "key").select("word", "n", "short", "low", "high")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return every.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_scan, "u string, nu long, v string, nv long")


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        keys = held["key"].to_numpy()
        open_from = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last block may go on
        if open_from:
            yield from _pairs(held.slice(0, open_from))
            held = held.slice(open_from).combine_chunks()
    if held is not None and len(held):
        yield from _pairs(held)
    release()


def _pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The near pairs within each run of equal keys."""
    key = rows["key"].to_numpy()
    alone = np.ones(len(key), bool)
    alone[1:] &= key[1:] != key[:-1]
    alone[:-1] &= key[:-1] != key[1:]
    rows = rows.filter(pa.array(~alone))
    key, short, low, high, n = (rows[c].to_numpy() for c in ("key", "short", "low", "high", "n"))
    words = rows["word"].to_pylist()
    if not words:
        return
    size = np.fromiter(map(len, words), np.int64, len(words))
    wide = size > WIDE
    width = int(size[~wide].max(initial=1))
    clipped = [w if len(w) <= WIDE else "" for w in words]
    ahead = np.array(clipped, f"U{width}").view(np.uint32).reshape(len(words), width)
    back = np.array([w[::-1] for w in clipped], f"U{width}").view(np.uint32).reshape(len(words), width)
    us, vs, step = [], [], 0
    i = np.arange(len(words))
    while True:
        step += 1
        i = i[i + step < len(words)]
        i = i[key[i] == key[i + step]]
        if not len(i):
            break
        j = i + step
        fits = (np.abs(size[i] - size[j]) <= 1) & (np.minimum(size[i], size[j]) == short[i]) & (short[i] == short[j]) & (low[i] == low[j])
        a, b = i[fits], j[fits]
        slow = wide[a] | wide[b]
        if slow.any():
            found = [(x, y) for x, y in zip(a[slow], b[slow], strict=True) if _one_edit(words[x], words[y], int(low[x]), int(high[x]))]
            us += [x for x, _ in found]
            vs += [y for _, y in found]
            a, b = a[~slow], b[~slow]
        for at in range(0, len(a), 1 << 16):
            x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            least, most = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
            front = _shared(ahead[x], ahead[y], least)
            near = (front >= low[x]) & (front < high[x]) & (front < most)
            x, y, front, least, most = x[near], y[near], front[near], least[near], most[near]
            near = front + _shared(back[x], back[y], least) >= most - 1
            us += x[near].tolist()
            vs += y[near].tolist()
    for at in range(0, len(us), 1 << 14):
        u, v = us[at : at + (1 << 14)], vs[at : at + (1 << 14)]
        yield pa.record_batch([pa.array([words[x] for x in u], pa.string()), pa.array(n[u]), pa.array([words[x] for x in v], pa.string()), pa.array(n[v])], names=["u", "nu", "v", "nv"])


def _shared(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many letters two rows begin with, ``most`` at most."""
    differ = a != b
    return np.minimum(np.where(differ.any(1), differ.argmax(1), a.shape[1]), most)


def _one_edit(u: str, v: str, low: int, high: int) -> bool:
    least, most, front, back = min(len(u), len(v)), max(len(u), len(v)), 0, 0
    while front < least and u[front] == v[front]:
        front += 1
    while back < least and u[-1 - back] == v[-1 - back]:
        back += 1
    return low <= front < high and front < most and front + back >= most - 1


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of ``words`` (word, n)."""
    pairs = near_pairs(words)
    both = pairs.select(F.inline(F.array(F.struct(F.col("u").alias("word"), F.col("v").alias("other"), F.col("nv").alias("m")), F.struct(F.col("v").alias("word"), F.col("u").alias("other"), F.col("nu").alias("m")))))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("other"))).alias("best"))
    rows = words.join(best, "word", "left")
    takes = -F.col("best.m") >= times * F.col("n")
    rows = spool(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("best.other")).alias("form"), F.when(takes, -F.col("best.m")).alias("form_n")), "forms")
    # n grows tenfold from word to form, so the logarithm of the largest n bounds a chain; each round doubles what is followed
    root = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        followed = spool(root.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        root = followed.select("word", "root")
        if followed.where("moved").isEmpty():
            break
    return rows.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spool(runs(read(spark, sf_dir, "documents")).where(F.col("n") >= LEAST), "words"))


#: In DuckDB near words are those that agree once a letter is taken out of one or both. The hash is worked out bit by bit.
OP12_SQL = rf"""
WITH RECURSIVE crc AS (SELECT range AS b, list_reduce(list_prepend(range, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256)),
table_ AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM crc),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS run FROM documents),
counted AS (SELECT doc, run, count(*) AS k FROM runs WHERE length(run) >= {LETTERS} GROUP BY ALL),
bytes AS (SELECT doc, run, k, list_transform(regexp_extract_all(hex(encode(doc || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM counted),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) AS h FROM bytes, table_),
spelt AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spelt WHERE length(word) >= {LETTERS} GROUP BY word HAVING sum(k) >= {LEAST}),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
cut AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM places),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT DISTINCT a.word, b.word, b.n FROM words a JOIN cut b ON a.word = b.rest
  UNION SELECT DISTINCT b.word, a.word, a.n FROM words a JOIN cut b ON a.word = b.rest),
best AS (SELECT word, count(*) AS n_near, arg_min(other, row(-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * n THEN other END AS form, CASE WHEN m >= {TIMES} * n THEN m END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
walk AS (SELECT word, word AS at FROM formed UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN walk w ON w.word = f.word JOIN formed last ON last.word = w.at AND last.form IS NULL
"""
