"""Removal of repeated byte strings with suffix arrays.

A byte goes when a string of ``length`` bytes that covers it starts anywhere else in the corpus, the same document
included; strings never cross documents and are judged on the input.

Routing. The smallest hash among the short grams of a string (its anchor) depends on the string alone, so equal
strings have equal anchors. Each document is cut into runs of strings with a common anchor gram; runs whose
gram occurs once in the corpus hold no repeated string (in periodic text it occurs again within the run). Runs with the same bytes form a class: its
strings all repeat, and one member stands for it. What remains, runs that share a gram but not their bytes, is sorted.

Sorting. The runs of many grams are joined into one text and its suffix array is built in two stages: only
suffixes smaller than their successors are sorted directly, by their first ``length`` bytes; all others are induced by
one scan over the buckets of first bytes. Adjacent suffixes whose common prefix reaches ``length`` repeat.

Skew. A gram with more than HOT runs of different bytes, or HOT_BYTES of them (a passage in a large part of all
documents, whose surroundings differ, or long periodic texts) is not sorted in one task: its strings are counted by a 128-bit hash of all their bytes,
so nothing is capped. Classes, too, are counted by partial aggregates and joined back, never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlework.llm.common import parts, read, spool

LENGTH, GRAM = 200, 24
#: Runs with different bytes under one gram, and their bytes, over which strings are routed anew.
HOT, HOT_BYTES = 2000, 1 << 23
#: Bytes joined for one suffix array.
SHARD_BYTES = 1 << 20
_BLOCK = 1 << 19
_MULT = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, int(n).bit_length())
    if size not in _powers:
        inverse = pow(_MULT, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[size] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, m, np.uint64)]), dtype=np.uint64) for m in (_MULT, inverse))
    return _powers[size]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` bytes in a row."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    up, down = _power_table(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
        h = (total[size:] - total[:-size]) * down[: len(data) - size + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return h


def runs(data: bytes, length: int = LENGTH, gram: int = GRAM):
    """(gram hash, first start, last start, places) of strings with a common anchor gram; every start is in one run.

    Neighbouring runs of one gram (periodic text) are one run, in which the gram has several places.
    """
    out_h, out_lo, out_hi, out_n = [], [], [], []
    raw = np.frombuffer(data, np.uint8)
    width = length - gram + 1
    for base in range(0, len(raw) - length + 1, _BLOCK):
        h = gram_hashes(raw[base : base + _BLOCK + length - 1], gram)
        key = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype=np.uint64)
        least, have = key, 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: len(key) - width + 1], least[width - have :])
        place = (least & np.uint64(0xFFFFF)).astype(np.int64)
        anchor = h[place]
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        out_h.append(anchor[first])
        out_lo.append(first + base)
        out_hi.append(np.concatenate([first[1:], [len(anchor)]]) - 1 + base)
        out_n.append(np.add.reduceat(np.concatenate([[1], place[1:] != place[:-1]]), first))
    if not out_h:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(map(np.concatenate, (out_h, out_lo, out_hi, out_n)))


def symbols(text: np.ndarray, depth: int) -> tuple[np.ndarray, int]:
    """A number for the next bytes of every position, in their order, and how many bytes it stands for.

    Zeros follow the text. Eight bytes are a number as they are; the ranks of so many as fit are joined into one.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(depth + 72, np.uint8)])
    words = np.zeros(n + depth + 64, np.uint64)
    for k in range(8):
        words |= padded[k : k + len(words)].astype(np.uint64) << np.uint64(56 - 8 * k)
    if depth < 16:
        return words, 8
    known, rank = np.unique(words, return_inverse=True)
    bits = max(1, (len(known) - 1).bit_length())
    take = max(1, min(64 // bits, depth // 8, 8))
    rank, wide = rank.reshape(-1).astype(np.uint64), np.zeros(n + depth, np.uint64)
    for k in range(take):
        wide |= rank[8 * k : 8 * k + len(wide)] << np.uint64(bits * (take - 1 - k))
    return wide, 8 * take


def _direct(words: np.ndarray, step: int, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ``at`` sorted by their first ``depth`` bytes, ``step`` at a time; only ties go on."""
    if not len(at):
        return at
    order = at[np.argsort(words[at], kind="stable")]
    group = np.cumsum(np.concatenate([[0], words[order][1:] != words[order][:-1]]))
    live = np.arange(len(order))
    for k in range(step, depth, step):
        size = np.bincount(group)
        more = size[group] > 1
        live, group = live[more], group[more]
        if not len(live):
            break
        w = words[order[live] + k]
        by = np.lexsort((w, group))
        order[live] = order[live][by]
        w = w[by]
        change = np.concatenate([[False], (w[1:] != w[:-1]) | (group[1:] != group[:-1])])
        group = np.cumsum(change)
    return order


def suffix_array(text: np.ndarray, depth: int, words: np.ndarray, width: int) -> np.ndarray:
    """All suffixes of ``text`` in the order of their first ``depth`` bytes at least, in two stages; words from symbols()."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    step = np.concatenate([np.sign(np.diff(text.astype(np.int16))), [-1]])  # the last is larger than the empty suffix
    turn = np.where(step != 0, np.arange(n), n)
    small = step[np.minimum.accumulate(turn[::-1])[::-1]] > 0
    direct = _direct(words, width, np.flatnonzero(small), depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    same = np.concatenate([[False], text[1:] == text[:-1]])
    start = np.maximum.accumulate(np.where(same, 0, np.arange(n)))  # of the run of equal bytes that a position is in
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        large = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        back = large - start[large]  # equal bytes before it: larger suffixes still, by how many
        if back.any():
            times = back + 1
            which = np.repeat(np.arange(len(large)), times)
            g = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            by = np.lexsort((which, g))
            large = large[which[by]] - g[by]
        bucket = np.concatenate([large, direct[bounds[c] : bounds[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = text[before]
        before, first = before[first > c], first[first > c]
        if len(before):
            by = np.argsort(first, kind="stable")
            before, first = before[by], first[by]
            cut = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            for a, b in zip(cut, np.append(cut[1:], len(first)), strict=True):
                waiting[first[a]].append(before[a:b])
    return np.concatenate(out)


def common_prefix_reaches(text: np.ndarray, words: np.ndarray, width: int, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes at a and b agree on their first ``length`` bytes (both have them)."""
    live = np.arange(len(a))
    places = [*range(0, length - width, width), length - width] if width <= length else []
    for j in places:
        live = live[words[a[live] + j] == words[b[live] + j]]
    for j in range(0 if places else length):
        live = live[text[a[live] + j] == text[b[live] + j]]
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def repeated(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, which of its strings of ``length`` bytes start elsewhere too, in any piece."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    inside = np.zeros(len(text) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, np.maximum(starts, starts + sizes - length + 1), -1)
    valid = np.cumsum(inside)[:-1] > 0
    words, width = symbols(text, length)
    order = suffix_array(text, length, words, width)
    order = order[valid[order]]
    same = common_prefix_reaches(text, words, width, order[:-1], order[1:], length)
    found = np.zeros(len(text), bool)
    found[order[:-1][same]] = True
    found[order[1:][same]] = True
    return [found[s : s + max(0, n - length + 1)] for s, n in zip(starts, sizes, strict=True)]


def _spans(flags: np.ndarray, base: int) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return [(base + int(a), base + int(b) - 1) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _keyed(docs: DataFrame) -> DataFrame:
    """id and tag name a row; rows equal in both are the same text under the same doc_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("tag"), text.cast("binary").alias("data"))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(id, tag, lo, hi): starts of strings that occur elsewhere too, as inclusive ranges that may overlap."""
    spark = docs.sparkSession

    def anchors(batches):
        for i, t, data in _rows(batches, "data"):
            h, lo, hi, places = runs(data, length, gram)
            if len(h):
                view = memoryview(data)
                sh = np.array([xxhash.xxh3_64_intdigest(view[a : b + length]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), i), pa.int64()), pa.array(np.full(len(h), t), pa.int64()), pa.array(h.view(np.int64)), pa.array(sh.view(np.int64)), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(places > 1)], names=["id", "tag", "h", "sh", "lo", "hi", "own"])

    found = spool(_keyed(docs).mapInArrow(_merged(anchors), "id long, tag long, h long, sh long, lo int, hi int, own boolean"), "runs")
    classes = found.groupBy("h", "sh").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own"), F.min(F.struct("id", "tag", "lo", "hi")).alias("rep"))
    shared = found.groupBy("h").agg(F.count(F.lit(1)).alias("runs"), F.max("own").alias("own")).where("runs > 1 or own")
    classes = spool(classes.join(shared.select("h"), "h", "left_semi"), "classes")
    several = classes.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.max(F.col("own") & (F.col("n") == 1)).alias("own"), F.sum(F.col("rep.hi") - F.col("rep.lo") + length).alias("bytes")).where("m > 1 or own")
    whole = found.join(classes.where("n > 1").select("h", "sh"), ["h", "sh"], "left_semi").select("id", "tag", "lo", "hi")

    wanted = classes.join(several, "h").select("rep.*", "h", ((F.col("m") > hot) | (F.col("bytes") > HOT_BYTES)).alias("hot"))
    wanted = wanted.groupBy("id", "tag").agg(F.collect_list(F.struct("lo", "hi", "h", "hot")).alias("wanted"))

    def cut(batches):
        for i, t, data, ask in _rows(batches, "data"):
            rows = []
            for x in ask:
                if not x["hot"]:
                    rows.append((i, t, x["h"], x["lo"], data[x["lo"] : x["hi"] + length], None))
                    continue
                for p in range(x["lo"], x["hi"] + 1):
                    w = xxhash.xxh3_128_digest(data[p : p + length])
                    rows.append((i, t, int.from_bytes(w[:8], "big", signed=True), p, None, int.from_bytes(w[8:], "big", signed=True)))
            yield _batch(rows, [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()], ["id", "tag", "h", "lo", "data", "w"])

    asked = _keyed(docs).join(wanted, ["id", "tag"]).select("id", "tag", "data", "wanted")  # equal rows answer twice, which is harmless: all their strings repeat
    pieces = spool(asked.mapInArrow(_merged(cut, 5_000), "id long, tag long, h long, lo int, data binary, w long"), "pieces")

    def sort(batches):
        held, size = [], 0

        def flush():
            flags = repeated([x[4] for x in held], length)
            rows = [(i, t, a, b) for (i, t, _, lo, _), f in zip(held, flags, strict=True) for a, b in _spans(f, lo)]
            return _batch(rows, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], ["id", "tag", "lo", "hi"])

        for row in _rows(batches, "data"):
            if size > SHARD_BYTES and held[-1][2] != row[2]:
                yield flush()
                held, size = [], 0
            held.append(row)
            size += len(row[4])
        if held:
            yield flush()

    spans = "id long, tag long, lo int, hi int"
    plain = pieces.where("data is not null").drop("w").repartition("h").sortWithinPartitions("h").mapInArrow(sort, spans)
    single = pieces.where("data is null").select("id", "tag", "h", "w", "lo")
    twice = single.groupBy("h", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = single.join(twice, ["h", "w"], "left_semi").select("id", "tag", "lo", F.col("lo").alias("hi"))
    return whole.unionByName(plain).unionByName(again)


def _rows(batches, text: str) -> Iterator[tuple]:
    """The rows of batches, of which a bounded part is Python objects at a time."""
    for part in parts(batches, text):
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _merged(f, rows: int = 50_000):
    """Join small batches of f into larger ones."""

    def g(batches):
        held, n = [], 0
        for b in f(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return g


def _marked(docs: DataFrame, length: int) -> DataFrame:
    """id, tag and the merged byte spans [a, b) to remove, for rows that have any."""
    found = repeats(docs, length).groupBy("id", "tag").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
    return spool(found, "spans")


def merge_spans(spans: list[dict], length: int) -> list[tuple[int, int]]:
    """Byte spans covered by strings that start in sorted ranges."""
    out: list[list[int]] = []
    for s in spans:
        a, b = s["lo"], s["hi"] + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remaining(data: bytes, cut: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in cut for x in span), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Every row with doc_id, the bytes that remain and what went: data binary, n_bytes, n_removed, n_spans.

    Null text is empty. Rows that are equal, text and doc_id, repeat each other like any two rows.
    """
    marked = _marked(docs, length)

    def cut(batches):
        for part in parts(batches, "data"):
            rows = []
            for i, data, spans in zip(*(c.to_pylist() for c in part.columns), strict=True):
                gone = merge_spans(spans or [], length)
                rows.append((i, remaining(data, gone), len(data), sum(b - a for a, b in gone), len(gone)))
            yield _batch(rows, [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()], ["id", "data", "n_bytes", "n_removed", "n_spans"])

    kept = _keyed(docs).join(marked, ["id", "tag"], "left").select("id", "data", "spans").mapInArrow(cut, "id long, data binary, n_bytes long, n_removed long, n_spans long")
    return kept.select(F.when(F.col("id") != -(1 << 63), F.col("id")).alias("doc_id"), "data", "n_bytes", "n_removed", "n_spans")


def clean_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All rows and columns, the text without its repeated strings (null stays null) and n_chars, if there, set anew.

    A character of which only some bytes go, goes whole.
    """
    marked = _marked(docs, length)
    columns = docs.columns
    wide = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__tag": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    joined = wide.join(marked.select(F.col("id").alias("__id"), F.col("tag").alias("__tag"), F.col("spans").alias("__spans")), ["__id", "__tag"], "left").drop("__id", "__tag")
    schema = docs.schema

    def cut(batches):
        for batch in parts(batches):
            spans = batch.column("__spans").to_pylist()
            texts = [remaining(t.encode(), merge_spans(s, length)).decode(errors="ignore") if t is not None and s else t for t, s in zip(batch.column("text").to_pylist(), spans, strict=True)]
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in columns], names=columns)

    return joined.mapInArrow(cut, schema)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("data", 256).alias("kept_sha256"))


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
