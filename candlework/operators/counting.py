"""Sums of trades over every itemset, from products of one-hot states with columns of outcomes.

Rows are dealt by ranges of (entry rule, ticker, day), so a partition holds whole stretches of tickers and any ticker
can be split. A task takes up to BLOCK rows of one rule at a time. For the rows that hold a given state (or a given pair
of states) the transposed one-hot matrix of all later states times the matrix of outcomes gives every measure of every
template for all itemsets that begin so: a row costs a few million multiplications instead of thousands of hash
lookups. Only sums leave the task. Returns are whole numbers of 1e-9 percent and their logs of 1e-10, so sums are exact
and don't turn on the order of addition; a block is cut smaller where a sum could pass 2 ** 53.

Distinct tickers: one that lies wholly inside a block is counted there; the block's first and last may go on elsewhere,
so they leave as a bit per template and are put together by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlework.sinks.spool import spool

#: Rows of one entry rule that a task holds, and rows that a range is meant to have.
BLOCK, RANGE = 16_384, 32_768
UNIT, LOG_UNIT = 1e9, 1e10
#: Additive measures, in the order of the matrix columns.
SUMS = ("trades", "profitable", "successful", "take_profits", "stop_losses", "time_caps", "net", "gross_profit", "logs", "wiped")
#: Exit reasons as numbers; others are 0.
TARGET, STOP, CAP = 1, 2, 3
_SCHEMA = "template int, itemset long, tickers long, " + ", ".join(f"{n} long" for n in SUMS) + ", first int, last int, ticker string, templates long"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in _SCHEMA.split(", ")]
FAR = np.iinfo(np.int32).max


class Rows:
    """A block: one-hot states, outcome columns, days, and where tickers begin. Sorted by ticker."""

    def __init__(self, table: pa.Table, templates: list[int], least: float):
        """``templates``: numbers of the entry rule's templates."""
        n, at = len(table), {t: i for i, t in enumerate(templates)}
        items = table["items"].combine_chunks()
        self.row, self.item = np.repeat(np.arange(n), np.diff(items.offsets.to_numpy())), items.flatten().to_numpy()
        out = table["outcomes"].combine_chunks()
        row, x = np.repeat(np.arange(n), np.diff(out.offsets.to_numpy())), out.flatten()
        t, value, reason = (x.field(f).to_numpy(zero_copy_only=False) for f in ("t", "x", "e"))
        own = np.isin(t, templates)
        row, value, reason = row[own], value[own], reason[own]
        col = np.array([at[k] for k in t[own]], np.int64)
        units, m = np.rint(value * UNIT), 1 + value / 100
        logs = np.rint(np.log(np.where(m > 0, m, 1.0)) * LOG_UNIT)
        made = {"trades": np.ones(len(row)), "profitable": value > 0, "successful": value >= least, "take_profits": reason == TARGET, "stop_losses": reason == STOP, "time_caps": reason == CAP, "net": units, "gross_profit": np.maximum(units, 0), "logs": logs, "wiped": m <= 0}
        self.outcomes = np.zeros((n, len(SUMS), len(templates)))
        for i, name in enumerate(SUMS):
            self.outcomes[row, i, col] = made[name]
        self.width = len(templates)
        self.traded = self.outcomes[:, 0, :] > 0
        self.largest = float(np.abs(self.outcomes).max(initial=1))
        self.day = table["day"].to_numpy(zero_copy_only=False).astype(np.int32)
        tickers = table["ticker"].to_numpy(zero_copy_only=False).astype(object)
        self.ticker_at = np.flatnonzero(np.concatenate(([True], tickers[1:] != tickers[:-1]))) if n else np.empty(0, np.int64)
        self.tickers = tickers[self.ticker_at]

    def hot(self, items: np.ndarray) -> np.ndarray:
        """Rows by ``items``: 1 where the row has the item."""
        place = np.full(int(max(self.item.max(initial=0), items.max(initial=0))) + 1, -1)
        place[items] = np.arange(len(items))
        col = place[self.item]
        out = np.zeros((len(self.day), len(items)), np.uint8)
        out[self.row[col >= 0], col[col >= 0]] = 1
        return out

    def sums(self, rows: np.ndarray, hot: np.ndarray) -> dict[str, np.ndarray]:
        """All measures of the given rows for each column of ``hot`` (their rows of it) and template."""
        step = max(1, int((1 << 52) // self.largest))
        weights = self.outcomes[rows].reshape(len(rows), -1)
        total = np.zeros((hot.shape[1], weights.shape[1]), np.int64)
        for at in range(0, len(rows), step):
            total += (hot[at : at + step].T.astype(np.float64) @ weights[at : at + step]).astype(np.int64)
        total = total.reshape(hot.shape[1], len(SUMS), self.width)
        out = {n: total[:, i, :] for i, n in enumerate(SUMS)}
        out |= self._days(rows, hot)
        return out | self._tickers(rows, hot)

    def _days(self, rows: np.ndarray, hot: np.ndarray) -> dict[str, np.ndarray]:
        """First and last day. Rows that trade the same templates, of which there are few kinds, go together."""
        kinds, of = np.unique(self.traded[rows], axis=0, return_inverse=True)
        first, last = np.full((hot.shape[1], self.width), FAR, np.int32), np.full((hot.shape[1], self.width), -FAR, np.int32)
        for k, trades in enumerate(kinds):
            mine = np.flatnonzero(of.reshape(-1) == k)
            days, on = self.day[rows[mine]][:, None], hot[mine] > 0
            low, high = np.where(on, days, FAR).min(0), np.where(on, days, -FAR).max(0)
            first[:, trades] = np.minimum(first[:, trades], low[:, None])
            last[:, trades] = np.maximum(last[:, trades], high[:, None])
        return {"first": first, "last": last}

    def _tickers(self, rows: np.ndarray, hot: np.ndarray) -> dict[str, np.ndarray]:
        """Tickers that lie wholly inside, and which templates the first and the last one trade (bits)."""
        inside, edges = np.zeros((hot.shape[1], self.width), np.int64), []
        bit = np.int64(1) << np.arange(self.width, dtype=np.int64)
        cuts = np.searchsorted(rows, np.concatenate((self.ticker_at, [len(self.day)])))
        for k in range(len(self.ticker_at)):
            part = slice(cuts[k], cuts[k + 1])
            if cuts[k] == cuts[k + 1]:
                continue
            there = (hot[part].T.astype(np.float32) @ self.traded[rows[part]].astype(np.float32)) > 0
            if 0 < k < len(self.ticker_at) - 1:
                inside += there
            else:
                edges.append((self.tickers[k], there.astype(np.int64) @ bit))
        return {"tickers": inside, "edges": edges}


def singles(rows: Rows, pairable: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, one-hot columns of these rows, the columns' items and the packed rest of the itemset."""
    items = np.unique(rows.item)
    every = np.arange(len(rows.day))
    yield every, rows.hot(items), items.astype(np.int64) + 1, np.zeros(1, np.int64)


def pairs(rows: Rows, pairable: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    items = np.unique(rows.item[np.isin(rows.item // 16, pairable)])
    hot = rows.hot(items)
    for i, a in enumerate(items):
        later = np.flatnonzero(items // 16 > a // 16)
        if len(later):
            held = np.flatnonzero(hot[:, i])
            yield held, hot[np.ix_(held, later)], (items[later].astype(np.int64) + 1) << 10, np.array([int(a) + 1])


def triples(promoted: list[tuple[int, int]]):
    """Sets of three that hold a promoted pair of features; one that holds several comes with the first of them."""
    order = {p: i for i, p in enumerate(promoted)}

    def of(rows: Rows, pairable: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        items = np.unique(rows.item[np.isin(rows.item // 16, pairable)])
        hot, feature = rows.hot(items), items // 16
        for (fa, fb), mine in order.items():
            first = [fc for fc in np.unique(feature) if fc not in (fa, fb) and all(order.get(p, mine) >= mine for p in (tuple(sorted((fa, fc))), tuple(sorted((fb, fc)))))]
            other = np.flatnonzero(np.isin(feature, first))
            if not len(other):
                continue
            for i in np.flatnonzero(feature == fa):
                with_a = np.flatnonzero(hot[:, i])
                for j in np.flatnonzero(feature == fb):
                    held = with_a[hot[with_a, j] > 0]
                    if len(held):
                        yield held, hot[np.ix_(held, other)], _packed(int(items[i]), int(items[j]), items[other]), np.zeros(1, np.int64)

    return of


def _packed(a: int, b: int, others: np.ndarray) -> np.ndarray:
    three = np.sort(np.stack((np.full(len(others), a), np.full(len(others), b), others)), axis=0).astype(np.int64) + 1
    return three[0] + (three[1] << 10) + (three[2] << 20)


def _records(rows: Rows, templates: list[int], found: Iterable) -> Iterator[pa.RecordBatch]:
    waiting: list[list] = []

    def batch() -> pa.RecordBatch:
        columns = [np.concatenate([w[i] for w in waiting]) if i != len(_NAMES) - 2 else [x for w in waiting for x in w[i]] for i in range(len(_NAMES))]
        waiting.clear()
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)

    size = 0
    number = np.array(templates, np.int32)
    for held, hot, items, rest in found:
        sums = rows.sums(held, hot)
        itemset = items + rest[0]
        i, t = np.nonzero(sums["trades"])
        if not len(i):
            continue
        none = np.zeros(len(i), np.int64)
        waiting.append([number[t], itemset[i], sums["tickers"][i, t], *(sums[n][i, t] for n in SUMS), sums["first"][i, t], sums["last"][i, t], [None] * len(i), none])
        size += len(i)
        for ticker, bits in sums["edges"]:
            k = np.flatnonzero(bits)
            zero = np.zeros(len(k), np.int64)
            waiting.append([np.full(len(k), -1, np.int32), itemset[k], *[zero] * (1 + len(SUMS)), np.zeros(len(k), np.int32), np.zeros(len(k), np.int32), [ticker] * len(k), bits[k]])
            size += len(k)
        if size > 1 << 14:
            yield batch()
            size = 0
    if waiting:
        yield batch()


def _task(expand: Callable, pairable: list[int], by_rule: dict[str, list[int]], least: float):
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def ready(whole: bool) -> Iterator[pa.Table]:
            nonlocal held
            while held is not None and len(held):
                rules = held["entry_rule"].to_numpy(zero_copy_only=False).astype(object)
                same = int(np.argmax(rules != rules[0])) if (rules != rules[0]).any() else len(held)
                if same == len(held) and same < BLOCK and not whole:
                    return
                cut = min(same, BLOCK)
                part, held = held.slice(0, cut), held.slice(cut)
                yield part

        def results(whole: bool) -> Iterator[pa.RecordBatch]:
            for part in ready(whole):
                templates = by_rule.get(part["entry_rule"][0].as_py())
                if templates:
                    rows = Rows(part, templates, least)
                    for b in _records(rows, templates, expand(rows, pairable)):
                        rule = pa.array([part["entry_rule"][0].as_py()] * len(b), pa.string())
                        yield pa.record_batch([rule, *b.columns], names=["entry_rule", *_NAMES])

        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            yield from results(False)
        yield from results(True)

    return work


def tasks(spark: SparkSession, rows: int) -> int:
    """How many parts for so many rows of work: a part for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // RANGE))


def dealt(rows: DataFrame, n_rows: int) -> DataFrame:
    """Rows in ranges of rule, ticker and day; as many ranges as there are cores, or more if rows ask for it."""
    by = ("entry_rule", "ticker", "day")
    return rows.repartitionByRange(tasks(rows.sparkSession, n_rows), *by).sortWithinPartitions(*by)


def spread(states: DataFrame) -> DataFrame:
    """Rows dealt out by what they will be expanded to, not by their few bytes."""
    return states.repartition(tasks(states.sparkSession, states.count()), "ticker", "entry_rule", "trade_date")


def totals(rows: DataFrame, expand: Callable, pairable: list[int], rule_of: list[str], least: float, n_rows: int) -> DataFrame:
    """template (its number), itemset, tickers, SUMS, first and last day. ``rows``: entry_rule, ticker, day, items, outcomes (t, x, e)."""
    by_rule: dict[str, list[int]] = {}
    for t, rule in enumerate(rule_of):
        by_rule.setdefault(rule, []).append(t)
    if max(map(len, by_rule.values())) > 62:
        raise ValueError("at most 62 templates of one entry rule at a time")
    out = dealt(rows.select("entry_rule", "ticker", "day", "items", "outcomes"), n_rows).mapInArrow(_task(expand, pairable, by_rule, least), "entry_rule string, " + _SCHEMA)
    summed = [F.sum(n).alias(n) for n in ("tickers", *SUMS)] + [F.min("first").alias("first"), F.max("last").alias("last")]
    out = spool(out, "itemset-sums")
    inside = out.where("ticker is null").groupBy("template", "itemset").agg(*summed)
    edge = out.where("ticker is not null").groupBy("entry_rule", "itemset", "ticker").agg(F.bit_or("templates").alias("templates"))
    wide = max(map(len, by_rule.values()))
    bits = edge.groupBy("entry_rule", "itemset").agg(*[F.sum(F.expr(f"(templates >> {i}) & 1")).alias(f"b{i}") for i in range(wide)])
    numbers = F.create_map(*[x for rule, ts in by_rule.items() for x in (F.lit(rule), F.array(*map(F.lit, ts)))])
    more = bits.select("itemset", F.inline(F.arrays_zip(F.element_at(numbers, F.col("entry_rule")).alias("template"), F.array(*[f"b{i}" for i in range(wide)]).alias("more")))).where("template is not null and more > 0")
    joined = inside.join(more, ["template", "itemset"], "left")
    return joined.withColumn("tickers", F.col("tickers") + F.coalesce("more", F.lit(0))).drop("more")

