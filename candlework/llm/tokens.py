"""Token ids by a tokenizer file, with a per-worker cache of words.

A byte-pair tokenizer never merges across the boundary before a word, so the ids of a text are the ids of
its words in a row. Words repeat; each new one goes to the library once, many to a call, and is kept as the
little-endian bytes of its ids. A text with white space that words can't stand for, or with the string of a special
token, goes to the library whole, so the ids always equal those of one plain call.

Tokenizer files are looked up by path on the executors; they are never copied.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from candlework.llm.common import parts

#: Known words, of about 50 bytes each, over which a worker forgets those it has used once.
CACHE_WORDS = 1_500_000
#: Rows and bytes of texts that are encoded together.
SLICE_ROWS, SLICE_BYTES = 4096, 1 << 23
#: New words in one call of the library.
CALL_WORDS = 2000
#: What keeps a word from being cut out of its text.
ODD = re.compile(r"[^\S\n]|[\x00\x01]")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_of(path: str, special_as_text: bool = False):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = special_as_text
    return made


def _gather(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches ids[first : first + size], one after another."""
    before = np.cumsum(size) - size
    total = int(size.sum())
    kind = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
    at = np.repeat((first - before).astype(kind), size)
    at += np.arange(total, dtype=kind)
    return ids[at]


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes. Null is empty.

    The string of a special token in a text gives that token, as in a plain call; with ``special_as_text`` it is
    text like any other.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, special_as_text: bool = False):
        self.tokenizer = tokenizer_of(path, special_as_text)
        self.cache_words = cache_words
        kind = json.loads(self.tokenizer.to_str())
        pre = kind.get("pre_tokenizer") or {}
        spaced = kind.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        ended = bool(kind["model"].get("end_of_word_suffix"))
        normal = kind.get("normalizer") or {}
        self.lowers = any(n["type"] == "Lowercase" for n in normal.get("normalizers", [normal] if normal else []))
        self.specials = [] if special_as_text else [t["content"] for t in kind["added_tokens"]]
        self.cut = self._spaced if spaced else self._ended if ended else None
        #: What stands between words in a call: of one id that no word has.
        self.between = "\n" if spaced else " \x01 "
        self.skip = int(bool(spaced))
        if self.cut and len(mark := self._library([self.between])[0]) == 1:
            self.mark = mark[0]
        else:
            self.cut = None
        # known words, where their ids are, which can't be cut out of a text, and in how many calls each was used
        self.words, self.ids = pa.array([], pa.string()), np.zeros(0, "<u4")
        self.first, self.size, self.odd, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int32)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, texts: pa.Array) -> pa.ListArray:
        """Words after a space as they are, the first of a line with a line feed before it; so the first line has one too many."""
        return pc.split_pattern(pc.binary_join_element_wise("", pc.replace_substring(texts, "\n", " \n"), "\n"), " ")

    def _ended(self, texts: pa.Array) -> pa.ListArray:
        """Words in any white space; where the tokenizer lower-cases anyway, A-Z are lowered before, so that fewer are distinct."""
        return pc.ascii_split_whitespace(pc.ascii_lower(texts) if self.lowers else texts)

    def _odd(self, words: pa.Array) -> np.ndarray:
        """Which are not one word that stands for itself in any text."""
        odd = pc.is_in(words, pa.array(["", "\n"] if self.skip else [""])).to_numpy(zero_copy_only=False)
        joined = "\n".join(words.to_pylist())
        if ODD.search(joined) or any(s.lower() in joined.lower() for s in self.specials):
            odd |= np.array([bool(ODD.search(w)) or any(s.lower() in w.lower() for s in self.specials) for w in words.to_pylist()], bool)
        return odd

    def _learn(self, words: pa.Array) -> None:
        """Add new words, many to a call of the library."""
        odd = self._odd(words)
        plain = words.filter(pa.array(~odd))
        if self.skip:
            plain = pc.if_else(pc.starts_with(plain, "\n"), plain, pc.binary_join_element_wise("\n ", plain, ""))
        edges = [*range(0, len(plain), CALL_WORDS), len(plain)]
        calls = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), plain), "" if self.skip else self.between).to_pylist() if len(plain) else []
        at, firsts, sizes, parts = len(self.ids), [], [], []
        for text, a, b in zip(calls, edges, edges[1:], strict=False):
            (ids,) = self._library([text])
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) != b - a - (not self.skip):
                raise AssertionError("words of one call can't be told apart")
            begin = marks if self.skip else np.concatenate([[0], marks + 1])
            end = np.concatenate([marks[1:] if self.skip else marks, [len(ids)]])
            firsts.append(at + begin)
            sizes.append(end - begin)
            parts.append(ids)
            at += len(ids)
        first, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if parts:
            first[~odd], size[~odd] = np.concatenate(firsts), np.concatenate(sizes)
        if self.skip:  # the line feed belongs to words that begin with one
            spaced = ~odd & ~pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
            first[spaced] += 1
            size[spaced] -= 1
        self.words = pa.concat_arrays([self.words, words])
        self.ids = np.concatenate([self.ids, *parts])
        self.first, self.size, self.odd = np.concatenate([self.first, first]), np.concatenate([self.size, size]), np.concatenate([self.odd, odd])
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int32)])

    def _forget(self) -> None:
        """Keep the words that were used in several calls; none, if those are too many still."""
        stay = self.used > 1
        if 2 * np.count_nonzero(stay) > self.cache_words:
            stay[:] = False
        self.words, self.odd = self.words.filter(pa.array(stay)), self.odd[stay]
        self.ids, self.size = _gather(self.ids, self.first[stay], self.size[stay]), self.size[stay]
        self.first, self.used = np.cumsum(self.size) - self.size, np.zeros(len(self.size), np.int32)

    def _places(self, words: pa.Array) -> np.ndarray:
        """The numbers of distinct words, new ones learned."""
        if len(self.words) > self.cache_words:
            self._forget()
        at = pc.index_in(words, value_set=self.words)
        out, known = pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64), len(self.words)
        new = pc.is_null(at)
        if at.null_count:
            self._learn(words.filter(new))
            out[new.to_numpy(zero_copy_only=False)] = known + np.arange(at.null_count)
        self.used[out] += 1
        return out

    def encode(self, texts: Iterable[str | None] | pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if self.cut is None or not len(texts):
            return [x.tobytes() for x in self._library(texts.to_pylist())]
        cut = self.cut(texts)
        keyed = cut.flatten().dictionary_encode()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy())])
        place = self._places(keyed.dictionary)[keyed.indices.to_numpy()]
        size = self.size[place]
        raw = _gather(self.ids, self.first[place], size).tobytes()
        edge = 4 * np.concatenate([[0], np.cumsum(size)])[ends]
        out = [raw[a + 4 * self.skip : b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        lone = np.zeros(len(texts), bool)
        lone[np.searchsorted(ends[1:], np.flatnonzero(self.odd[place]), side="right")] = True
        for special in self.specials:
            lone |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        whole = np.flatnonzero(lone).tolist()
        for i, x in zip(whole, self._library([texts[i].as_py() for i in whole]), strict=True):
            out[i] = x.tobytes()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int | None, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch with the ids of its texts, ``end_id`` appended to each."""
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    for part in parts(batches, text, SLICE_ROWS, SLICE_BYTES):
        yield part, [x + end for x in encoder(path).encode(part.column(text))]


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
