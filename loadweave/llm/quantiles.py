"""Problem 7: percentiles of very large columns from mergeable relative-error summaries.

Relative-rank compactors: a summary is a ladder of levels; an item of level h stands for 2^h values. A full level is
sorted, its protected tail (the high ranks) is kept, and of the rest every other item moves up, odd or even by a hash
coin. How much of a level is compacted follows its own counter, so the sections next to the protected tail are touched
exponentially less often. A level has one section more each time its counter doubles, so even the rarest section is
touched no more often than its distance from the protected end allows, however many values come; a ladder of n values
holds about k * log2(n / k)^2 numbers. The rank error of a value is therefore relative to its distance from the
protected end: within `eps` * (n - rank + 1), with eps = 0.32 / k (README: measured up to 100 million values in one
ladder and in merged ones), and zero up to 384 values.

Summaries are built where the rows lie: each task folds its rows into one summary per group and day before anything is
shuffled, so a group that holds a third of all rows sends a few hundred numbers a task. Summaries of single days (or
files) are rows of a table and can be written, joined later and merged in any order.

Defined results: only finite numbers between `lowest` and `highest` count; rows without group, month or day are left
out; a group without valid values has no row; ties and repeated rows count as often as they come.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadweave.functions import readings as R

#: sections of a new level
SECTIONS = 6
SUMMARY_SCHEMA = "household string, month int, day date, n long, levels array<array<double>>, counters array<int>"


class Ladder:
    """A relative-compactor summary that protects the high ranks. The coin is a hash of the compacted values, so runs
    repeat and ladders with other values toss independently."""

    __slots__ = ("k", "levels", "counters", "n")

    def __init__(self, k: int = 32, levels: list[np.ndarray] | None = None, counters: list[int] | None = None, n: int = 0):
        self.k, self.levels, self.counters, self.n = k, levels or [np.zeros(0)], counters or [0], n

    def sections(self, h: int) -> int:
        """One more than the bits of the counter, so the trailing ones of a counter never exceed them."""
        return max(SECTIONS, self.counters[h].bit_length() + 1)

    def capacity(self, h: int = 0) -> int:
        return 2 * self.k * self.sections(h)

    def add(self, values: np.ndarray) -> None:
        """Add values in pieces no larger than a level, so that a level never grows beyond twice its capacity."""
        step = self.capacity()
        for i in range(0, len(values), step):
            piece = values[i : i + step]
            self.n += len(piece)
            self.levels[0] = np.concatenate([self.levels[0], piece])
            self._settle()

    def merge(self, other: Ladder) -> None:
        """Levels are joined weight by weight; counters are or-ed, which keeps the rarer sections protected."""
        self.n += other.n
        for h, (v, c) in enumerate(zip(other.levels, other.counters, strict=True)):
            if h == len(self.levels):
                self.levels.append(np.zeros(0))
                self.counters.append(0)
            self.levels[h] = np.concatenate([self.levels[h], v])
            self.counters[h] |= c
        self._settle()

    def _settle(self) -> None:
        h = 0
        while h < len(self.levels):
            if len(self.levels[h]) > self.capacity(h):
                self._compact(h)
            h += 1

    def _compact(self, h: int) -> None:
        v = np.sort(self.levels[h])
        # sections freed this time: one more than the trailing ones of the counter, at most all
        state = self.counters[h]
        freed = 1
        while state & 1:
            state >>= 1
            freed += 1
        keep = self.capacity(h) - freed * self.k
        low = len(v) - keep
        low -= low % 2
        coin = (zlib.crc32(v[:low].tobytes(), h) >> 11) & 1
        up, self.levels[h] = v[:low][coin::2], v[low:]
        self.counters[h] += 1
        if h + 1 == len(self.levels):
            self.levels.append(np.zeros(0))
            self.counters.append(0)
        self.levels[h + 1] = np.concatenate([self.levels[h + 1], up])

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        v = np.concatenate(self.levels)
        w = np.concatenate([np.full(len(x), 1 << h, dtype=np.int64) for h, x in enumerate(self.levels)])
        o = np.argsort(v, kind="stable")
        return v[o], np.cumsum(w[o])

    def quantiles(self, q: list[float]) -> list[float]:
        """For each q the smallest kept value whose cumulative weight reaches q * n (at least 1)."""
        v, c = self.items()
        return [float(v[min(len(v) - 1, int(np.searchsorted(c, max(1.0, x * c[-1] - 1e-9))))]) for x in q]


def relative_error(k: int) -> float:
    """The stated error: rank error over (n - rank + 1)."""
    return 0.32 / k


def _emit(store: dict, what: list[str]) -> pa.RecordBatch:
    keys = list(store)
    own = [store[x] for x in keys]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([x[0] for x in keys], pa.string()),
            pa.array([x[1] for x in keys], pa.int32()),
            pa.array([x[2] for x in keys], pa.date32()),
            pa.array([s.n for s in own], pa.int64()),
            pa.array([[lv.tolist() for lv in s.levels] for s in own], pa.list_(pa.list_(pa.float64()))),
            pa.array([s.counters for s in own], pa.list_(pa.int32())),
        ],
        names=what,
    )


NAMES = ["household", "month", "day", "n", "levels", "counters"]


def daily_summaries(readings: DataFrame, k: int = 32, lowest: float = 0.0, highest: float = 11.5, open_groups: int = 2000) -> DataFrame:
    """One or more summaries per household, month and day: each task sends one for each group it met.

    A task keeps at most `open_groups` summaries open and sends them all when more come, so its memory is bounded.
    """
    rows = R.with_household(readings.select("LCLid", "source_file", "kwh", "month", "date"), "_hh", R.learn_files(readings))
    rows = rows.select("_hh", "month", "date", R.number(F.col("kwh")).alias("_v")).where(f"_hh is not null and month is not null and date is not null and _v between {lowest!r} and {highest!r}")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            hh = batch.column(0).dictionary_encode()
            hc, hv = hh.indices.to_numpy(zero_copy_only=False), hh.dictionary.to_pylist()
            month = batch.column(1).to_numpy(zero_copy_only=False)
            day = batch.column(2).cast(pa.int32()).to_numpy(zero_copy_only=False)
            v = batch.column(3).to_numpy(zero_copy_only=False)
            o = np.lexsort((day, month, hc))
            hc, month, day, v = hc[o], month[o], day[o], v[o]
            cut = np.flatnonzero((np.diff(hc) != 0) | (np.diff(month) != 0) | (np.diff(day) != 0)) + 1
            edges = np.r_[0, cut, len(v)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                key = (hv[hc[a]], int(month[a]), int(day[a]))
                ladder = store.get(key)
                if ladder is None:
                    if len(store) >= open_groups:
                        yield _emit(store, NAMES)
                        store = {}
                    ladder = store[key] = Ladder(k)
                ladder.add(v[a:b])
        if store:
            yield _emit(store, NAMES)

    return rows.mapInArrow(fold, SUMMARY_SCHEMA)


def _merged(summaries: DataFrame, keys: list[str], k: int, close, schema: str) -> DataFrame:
    """Merge the summaries of each key: rows are clustered and sorted by key, a ladder is closed when the next key begins."""
    columns = [*keys, "n", "levels", "counters"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, done = None, None, {}
        for batch in batches:
            names = list(zip(*[batch.column(c).to_pylist() for c in keys], strict=True))
            n, counters = batch.column("n").to_pylist(), batch.column("counters").to_pylist()
            lists = batch.column("levels")
            outer, inner = lists.offsets.to_numpy(), lists.values.offsets.to_numpy()
            flat = lists.values.values.to_numpy(zero_copy_only=False)
            for i, name in enumerate(names):
                other = Ladder(k, [flat[inner[j] : inner[j + 1]] for j in range(outer[i], outer[i + 1])], counters[i], n[i])
                if name == at:
                    own.merge(other)
                    continue
                if own is not None:
                    done[at] = own
                    if len(done) >= 500:
                        yield close(done)
                        done = {}
                at, own = name, other
        if own is not None:
            done[at] = own
            yield close(done)

    return summaries.select(*columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


def merge_days(summaries: DataFrame, k: int = 32) -> DataFrame:
    """Exactly one summary per household, month and day, from the parts that the tasks sent."""
    return _merged(summaries, ["household", "month", "day"], k, lambda done: _emit(done, NAMES), SUMMARY_SCHEMA)


def monthly_percentiles(summaries: DataFrame, quantiles: list[float], k: int = 32) -> DataFrame:
    """household, month, n and per quantile q: value and rank_error, the stated bound (0: exact).

    Given one summary per day, a group merges at most 31 rows a year, however many readings it has.
    """

    def close(done: dict) -> pa.RecordBatch:
        rows = [(h, m, s.n, p, x, 0 if len(s.levels) == 1 else math.ceil(relative_error(k) * (s.n - p * s.n + 1))) for (h, m), s in done.items() for p, x in zip(quantiles, s.quantiles(quantiles), strict=True)]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["household", "month", "n", "q", "value", "rank_error"])

    return _merged(summaries, ["household", "month"], k, close, "household string, month int, n long, q double, value double, rank_error long")
