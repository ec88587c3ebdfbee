"""A static range asymmetric numeral system over token ids, in NumPy.

One frequency table, scaled to 2**20, serves every block. A block interleaves many states ("lanes"): token i
belongs to lane i mod lanes, all lanes step together, and each step is a few array operations. States are 64
bits wide and renormalise by 32-bit words. A block holds checkpoints (step, word position, states), from
any of which decoding can start, and checksums of its words and its ids.

Block: magic "RNS1", then little-endian uint32 fields: tokens, lanes, steps between checkpoints, checkpoints,
words, crc32 of words, crc32 of ids; then per checkpoint its word position (uint32); then per checkpoint its
states (uint64 each); then the words (uint32). Checkpoint 0 is the start.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BITS = 20
LOW = np.uint64(1 << 31)
MAGIC = b"RNS1"
HEAD = struct.Struct("<4s7I")
LANES, EVERY = 2048, 64


class Table:
    """Scaled frequencies of ids that occur, every one at least 1, with their sum 2**20."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids.astype(np.uint32), freq.astype(np.uint64)
        assert int(self.freq.sum()) == 1 << BITS or not len(ids)
        self.start = np.cumsum(self.freq) - self.freq
        self.slot = np.repeat(np.arange(len(ids), dtype=np.uint32), freq.astype(np.int64))
        self.index = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.uint32)
        self.index[ids] = np.arange(len(ids), dtype=np.uint32)

    @classmethod
    def of_counts(cls, ids: np.ndarray, counts: np.ndarray) -> Table:
        order = np.argsort(ids)
        ids, counts = np.asarray(ids)[order].astype(np.int64), np.asarray(counts)[order].astype(np.float64)
        if not len(ids):
            return cls(ids, np.zeros(0, np.int64))
        if len(ids) > 1 << BITS:
            raise ValueError("more distinct ids than slots")
        spare = (1 << BITS) - len(ids)
        freq = 1 + np.floor(counts / counts.sum() * spare).astype(np.int64)
        freq[np.argmax(freq)] += (1 << BITS) - freq.sum()
        return cls(ids, freq)


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = EVERY) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    symbols = table.index[ids]
    freq, start = table.freq[symbols], table.start[symbols]
    x = np.full(lanes, LOW, np.uint64)
    steps = -(-n // lanes)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    sent = 0
    for step in range(steps - 1, -1, -1):
        f, c = freq[step * lanes : (step + 1) * lanes], start[step * lanes : (step + 1) * lanes]
        y = x[: len(f)]
        full = y >= f << np.uint64(63 - BITS)
        out = y[full]
        if len(out):
            words.append((out & np.uint64(0xFFFFFFFF)).astype("<u4"))
            sent += len(out)
            y[full] = out >> np.uint64(32)
        q = y // f
        y[:] = (q << np.uint64(BITS)) + (y - q * f) + c
        if step % every == 0:
            marks.append((sent, x.copy()))
    if not marks:
        marks.append((0, x))
    marks.reverse()
    body = np.concatenate(words[::-1]).tobytes() if words else b""
    places = np.array([sent - s for s, _ in marks], "<u4").tobytes()
    states = np.concatenate([s for _, s in marks]).astype("<u8").tobytes()
    return HEAD.pack(MAGIC, n, lanes, every, len(marks), sent, zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + places + states + body


def decode(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids from checkpoint ``first`` to before ``last``; a whole block's ids are checked."""
    magic, n, lanes, every, marks, n_words, word_crc, id_crc = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block")
    at = HEAD.size
    places = np.frombuffer(block, "<u4", marks, at)
    states = np.frombuffer(block, "<u8", marks * lanes, at + 4 * marks).reshape(marks, lanes)
    words = np.frombuffer(block, "<u4", n_words, at + 4 * marks + 8 * marks * lanes)
    if zlib.crc32(words.tobytes()) != word_crc:
        raise ValueError("words are damaged")
    steps = -(-n // lanes)
    begin, end = first * every, steps if last is None or last >= marks else last * every
    x, at = states[first].astype(np.uint64), int(places[first])
    out = np.empty((max(0, end - begin), lanes), np.uint32)
    mask = np.uint64((1 << BITS) - 1)
    for step in range(begin, end):
        width = min(lanes, n - step * lanes)
        y = x[:width]
        low = y & mask
        s = table.slot[low]
        out[step - begin, :width] = s
        y[:] = table.freq[s] * (y >> np.uint64(BITS)) + low - table.start[s]
        short = y < LOW
        k = int(np.count_nonzero(short))
        if k:
            y[short] = (y[short] << np.uint64(32)) | words[at : at + k].astype(np.uint64)
            at += k
    ids = table.ids[out.reshape(-1)[: min(n, end * lanes) - begin * lanes]]
    if first == 0 and end == steps and zlib.crc32(ids.astype("<u4").tobytes()) != id_crc:
        raise ValueError("ids are damaged")
    return ids
