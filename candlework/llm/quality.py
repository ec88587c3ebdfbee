"""Quality rules as a short-circuit cascade.

Each rule rejects a text by one measure. On a bounded sample every rule is run alone, which gives its cost
(CPU seconds a text) and its selectivity (share rejected); rules are then ordered by rejection per cost, so a
cheap rule that rejects much comes first and a text leaves at the first rule that rejects it. A verdict is
the conjunction of all rules, so the order changes the time and never the result.

Null text is no text: no words, rejected by the base rule. Everything else is judged in one narrow pass,
without a shuffle; extra columns are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlework.llm.common import parts, read

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Texts of which costs and selectivities are measured.
SAMPLE = 2000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Text:
    """A text whose measures are made when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    def __getattr__(self, name: str):
        value = _MAKE[name](self)
        self.__dict__[name] = value
        return value


def _repeat_words(t: Text) -> int:
    """Words covered by windows of five words that are found twice or more. Hashes propose, words decide."""
    words = t.words
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    code = np.array([seen.setdefault(w, len(seen)) for w in words], np.uint64)
    if len(seen) == len(words):
        return 0
    h = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        h = (h ^ (code[k : k + n] + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    at = np.flatnonzero(maybe)
    rows = np.stack([code[at + k] for k in range(WINDOW)], axis=1)
    _, inverse, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    found = at[counts[inverse.reshape(-1)] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge)))


def _dup_lines(t: Text) -> int:
    lines = [x for x in t.text.split("\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


_MAKE: dict[str, Callable[[Text], object]] = {
    "words": lambda t: t.text.encode().split(),  # bytes split at just the six of SPACE
    "n_words": lambda t: len(t.words),
    "word_chars": lambda t: len(t.text) - sum(map(t.text.count, SPACE)),
    "n_symbols": lambda t: sum(map(t.text.count, SYMBOLS)),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "n_lines": lambda t: sum(1 for x in t.text.split("\n") if x.strip(SPACE)),
    "n_shouts": lambda t: t.text.count("!"),
}

#: Each says whether to reject. Limits are shares of words, lines or characters.
RULES: dict[str, Callable[[Text], bool]] = {
    "too_short": lambda t: t.n_words < 10,
    "repeated_words": lambda t: 100 * t.n_repeat_words > 20 * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words,
    "repeated_lines": lambda t: t.n_dup_lines > 2 and 2 * t.n_dup_lines > t.n_lines,
    "shouting": lambda t: 10 * t.n_shouts > 3 * t.n_words,
}
BASE = ("too_short", "repeated_words")


def costs(docs: DataFrame, rules: dict[str, Callable[[Text], bool]] = RULES, sample: int = SAMPLE) -> list[tuple[str, float, float]]:
    """Of each rule its CPU seconds a text and the share it rejects, on about ``sample`` texts picked by hash."""
    every = max(1, docs.count() // sample)
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]):
        spent, rejected, n = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0), 0
        for part in parts(batches):
            for text in part.column(0).to_pylist():
                n += 1
                for name, rule in rules.items():
                    t0 = time.thread_time()
                    rejected[name] += rule(Text(text))
                    spent[name] += time.thread_time() - t0
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"rule": list(rules), "spent": list(spent.values()), "rejected": list(rejected.values()), "n": n}), preserve_index=False)

    rows = picked.mapInArrow(run, "rule string, spent double, rejected long, n long").groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("rejected").alias("rejected"), F.sum("n").alias("n")).collect()
    return [(r.rule, r.spent / max(r.n, 1), r.rejected / max(r.n, 1)) for r in rows]


def ranked(measured: list[tuple[str, float, float]]) -> list[str]:
    """Rules by rejection per cost, most first; ties by name."""
    return [name for name, cost, share in sorted(measured, key=lambda x: (-x[2] / max(x[1], 1e-9), x[0]))]


def _order(docs: DataFrame, rules) -> list[str]:
    order = ranked(costs(docs, rules))
    return order + [r for r in rules if r not in order]  # an empty table measures nothing


def keep(docs: DataFrame, rules: dict[str, Callable[[Text], bool]] = RULES) -> DataFrame:
    """The rows that no rule rejects, all columns as they are."""
    order = [rules[r] for r in _order(docs, rules)]

    def run(batches):
        for batch in parts(batches):
            good = [not any(rule(t) for rule in order) for t in map(Text, batch.column("text").to_pylist())]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, rules: dict[str, Callable[[Text], bool]] = RULES, base: tuple[str, ...] = BASE) -> DataFrame:
    """doc_id, the measures, whether a base rule rejects, whether all keep, and the rule that rejected first."""
    order = [r for r in _order(docs, rules) if r not in base]

    def run(batches):
        for batch in parts(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                t = Text(text)
                by = next((r for r in (*base, *order) if rules[r](t)), None)
                rows.append([*(getattr(t, m) for m in MEASURES), by in base, by is None, by])
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", *MEASURES, "base_failed", "kept", "rejected_by"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", base_failed boolean, kept boolean, rejected_by string")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents")).drop("rejected_by")  # which rule comes first follows measured times
