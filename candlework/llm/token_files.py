"""Token ids as compressed binary files, written in ascending doc_id order and read back.

A file set is two tables in a folder of any store that Spark reaches: ``table`` (the shared frequencies, a row
per id that occurs) and ``blocks`` (a row per block: its shard, number, documents and the block's bytes, see
rans.py). A block holds whole documents, about ``block_tokens`` of them; blocks are independent, so any of
them decodes alone, and long blocks from any of their checkpoints.

The corpus is tokenized once and spooled (16-bit ids where they fit, compressed); frequencies count every
token. Rows are then dealt by ranges of doc_id, as many shards as the size needs, so ascending order is the
order of (shard, block, place). Only sums per shard and the frequency table (at most the vocabulary's size)
pass through the driver.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlework.llm import rans
from candlework.llm.common import read, shared_folder, spool
from candlework.llm.tokens import crc, encoded, public_path

TOKENIZER, END_ID = "word_bpe_49k.json", 2
BLOCK_TOKENS, SHARD_TOKENS = 1 << 19, 1 << 23
BLOCKS = "shard int, block int, doc_ids array<long>, doc_tokens array<long>, n_tokens long, data binary"


_SQUEEZE, _EXPAND = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _packed(ids: bytes) -> bytes:
    x = np.frombuffer(ids, "<u4")
    narrow = not len(x) or int(x.max()) < 1 << 16
    return (b"\2" if narrow else b"\4") + _SQUEEZE.compress((x.astype("<u2") if narrow else x).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(_EXPAND.decompress(data[1:]), "<u2" if data[0] == 2 else "<u4").astype(np.int64)


def tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = END_ID) -> DataFrame:
    """doc_id, n_tokens and packed ids of every whole text; null is empty."""
    path = tokenizer or public_path(TOKENIZER)

    def encode(batches):
        for batch, ids in encoded(batches, path, end_id):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(list(map(_packed, ids)), pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def frequencies(toks: DataFrame) -> DataFrame:
    """id and count over all tokens. Each task adds up its own first."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                c = np.bincount(_unpacked(data))
                if len(c) > len(total):
                    total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
                total[: len(c)] += c
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    return toks.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(toks: DataFrame, folder: str, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the file set of a token table (see tokens) into ``folder``.

    Rows come in the order of doc_id, null first; those of one doc_id by their number of tokens, then by ``tie`` (any
    stored number of the row, so that many rows of one doc_id can be dealt to several tasks), then by their ids. Repeated
    rows are written as often as they are there; an empty table gives a set without blocks.
    """
    spark = toks.sparkSession
    total, rows = toks.agg(F.sum("n_tokens"), F.count(F.lit(1))).first()
    frequencies(toks).write.parquet(f"{folder}/table")
    known = _table(spark, folder)
    shared = spark.sparkContext.broadcast((known.ids, known.freq.astype(np.int64)))
    shards = max(1, -(-(total or 0) // shard_tokens))

    def blocks(batches):
        from pyspark import TaskContext

        table, shard = rans.Table(*shared.value), TaskContext.get().partitionId()
        number, size, docs = 0, 0, []

        def block():
            ids = np.concatenate([i for _, i in docs]) if docs else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([[d for d, _ in docs]], pa.list_(pa.int64())), pa.array([[len(i) for _, i in docs]], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([rans.encode(ids, table)], pa.binary())],
                names=["shard", "block", "doc_ids", "doc_tokens", "n_tokens", "data"],
            )

        for batch in batches:
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = _unpacked(data)
                if docs and size + len(ids) > block_tokens:
                    yield block()
                    number, size, docs = number + 1, 0, []
                docs.append((doc_id, ids))
                size += len(ids)
        if docs:
            yield block()

    order = [F.col("doc_id").asc_nulls_first(), "n_tokens", *({"tie"} & {*toks.columns})]
    dealt = toks.repartitionByRange(shards, *order) if rows else toks
    dealt.sortWithinPartitions(*order, "ids").select("doc_id", "ids").mapInArrow(blocks, BLOCKS).write.parquet(f"{folder}/blocks")


def _table(spark: SparkSession, folder: str) -> rans.Table:
    rows = spark.read.schema("id long, n long").parquet(f"{folder}/table").collect()  # at most the vocabulary
    return rans.Table.of_counts(np.array([r.id for r in rows], np.int64), np.array([r.n for r in rows], np.int64))


def read_back(spark: SparkSession, folder: str) -> DataFrame:
    """Decode a file set: a row per document with where it starts in the whole, its length and its ids' crc32."""
    known = _table(spark, folder)
    shared = spark.sparkContext.broadcast((known.ids, known.freq.astype(np.int64)))
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("shard", "block", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("within"))
    starts = sizes.join(shards, "shard").select("shard", "block", (F.col("before") + F.col("within")).alias("base"))

    def decode(batches):
        table = rans.Table(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                base, docs, lengths, data = (batch.column(c)[i].as_py() for c in ("base", "doc_ids", "doc_tokens", "data"))
                ids = rans.decode(data, table).astype("<u4")
                ends = np.cumsum(np.array(lengths, np.int64))
                crcs = [crc(ids[b - n : b].tobytes()) for b, n in zip(ends, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(base + ends - np.array(lengths, np.int64), pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.join(starts, ["shard", "block"]).select("base", "doc_ids", "doc_tokens", "data").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write(spool(tokens(read(spark, sf_dir, "documents")).withColumn("tie", F.monotonically_increasing_id()), "ids"), folder)
    return read_back(spark, folder)
