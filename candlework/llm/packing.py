"""Best-fit packing with certified bin counts.

Documents are cut into pieces of at most ``capacity`` tokens (only longer ones are cut; the first piece takes
the remainder). Pieces are dealt to groups by hash and each group packs its own by best fit decreasing. A
dual feasible function turns piece lengths into a lower bound on the sequences that any packing needs; a
group that meets its bound is certified and done. Of a group with a gap, full sequences stay; the
documents of those with room go to an exchange, where sequences of many groups meet in other groups and
are packed again by best fit decreasing. A repacking that needs more sequences than it was given is
discarded. Rounds end when all that is left fits one group, or when a round saves less than a share LEAST_SAVED
of the sequences it was given.

Each group holds about ``group_rows`` pieces of 48 bytes, whatever the input and however little a round
settles. A hot source doesn't matter: pieces are dealt by the hash of document and piece number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlework.llm.common import read, spool
from candlework.llm.tokens import crc, encoded, public_path

CAPACITY, END_ID, TOKENIZER = 1024, 2, "byte_bpe_50k.json"
GROUP_ROWS, LEAST_SAVED = 50_000, 0.001
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, released boolean, bins long, bound long"


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The bin of each item, and the number of bins. Bins by room left; a bit mask finds the tightest that fits."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, mask, bins = np.empty(len(lengths), np.int64), 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
        else:
            b, left, bins = bins, capacity, bins + 1
        left -= size
        if left:
            room[left].append(b)
            mask |= 1 << left
        out[i] = b
    return out, bins


def bin_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best lower bound on bins from two families of dual feasible functions.

    The first drops items under k, takes those over capacity - k as whole bins and the rest at their size;
    the second rounds sizes to multiples of 1/m, exact multiples of 1/(m+1) staying as they are.
    """
    if not len(lengths):
        return 0
    sizes = np.arange(capacity + 1, dtype=np.int64)
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    n, mass = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * sizes)])
    k = np.arange(0, capacity // 2 + 1)
    big = n[-1] - n[capacity - k + 1]
    best = int((big + -(-(mass[capacity - k + 1] - mass[k]) // capacity)).max())
    for m in range(1, 33):
        scaled = sizes * (m + 1)
        value = np.where(scaled % capacity == 0, sizes * m, scaled // capacity * capacity)  # times m * capacity
        best = max(best, int(-(-int((value * count).sum()) // (m * capacity))))
    return best


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int | None = END_ID, tokenizer: str | None = None) -> DataFrame:
    """One row per piece of every document. Null text is empty; a document without tokens has no piece."""
    path = tokenizer or public_path(TOKENIZER)

    def cut(batches):
        for batch, ids in encoded(batches, path, end_id):
            rows = []
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                n = len(x) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n else [0]
                rows += [(doc_id, i, a, b - a, crc(x[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def _round(df: DataFrame, group, number: int, capacity: int, last: bool) -> DataFrame:
    """Pack each group. df may have sequence_id, an arrangement to fall back on."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True]).reset_index(drop=True)
        size = pdf["length"].to_numpy(np.int64)
        where, bins = best_fit_decreasing(size, capacity)
        if "sequence_id" in pdf:
            old, ids = pd.factorize(pdf["sequence_id"])
            if len(ids) < bins:
                where, bins = old.astype(np.int64), len(ids)
        bound = bin_bound(size, capacity)
        order = np.argsort(where, kind="stable")
        before = np.cumsum(size[order]) - size[order]
        first = np.concatenate([[True], np.diff(where[order]) != 0])
        offset = np.empty(len(size), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        used = np.bincount(where, weights=size, minlength=bins).astype(np.int64)
        out = pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
        out["sequence_id"] = (number << 56) + (int(pdf["g"].iloc[0]) << 24) + where
        out["offset"] = offset
        out["released"] = (used[where] < capacity) & (bins > bound) & (not last)
        out["bins"], out["bound"] = bins, bound
        return out

    return df.withColumn("g", group).groupBy("g").applyInPandas(pack, PACKED)


def pack(items: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Sequences for pieces (columns of PIECES, lengths from 1 to ``capacity``).

    Adds sequence_id, offset, and of the group that settled the row its bins and the certified bound.
    An empty table gives an empty one; rows that are equal are packed as so many pieces.
    """
    items = spool(items, "pieces")
    number, settled, left = 0, [], items.count()
    groups = max(1, -(-left // group_rows))
    group = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups))
    given = None
    while True:
        last = groups == 1
        done = spool(_round(items, group, number, capacity, last), "packed")
        open_ = done.where("released")
        bins = done.groupBy(F.shiftright("sequence_id", 24).alias("g")).agg(F.max("bins").alias("bins")).agg(F.sum("bins")).first()[0] or 0
        if last or (given is not None and given - bins < LEAST_SAVED * given):
            settled.append(done)
            break
        settled.append(done.where("not released"))
        left, given = open_.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
        if not left:
            break
        items = open_.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id")
        number, groups = number + 1, -(-left // group_rows)
        group = F.pmod(F.xxhash64(F.lit(number), "sequence_id"), F.lit(groups))  # an old sequence moves whole
    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    return out.drop("released")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(read(spark, sf_dir, "documents")))
