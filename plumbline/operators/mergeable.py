"""Statistics of weighted rows whose partial results merge, so that no task needs a whole resample.

A statistic keeps a state of a fixed number of numbers. Each batch of rows adds what it
holds, states of one group are merged as they meet, and the last one gives the value:
what a task holds is bounded by a batch and the states, whatever a group's size.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import clean


class Statistic(ABC):
    """columns: how many columns of a row it needs."""

    columns = 1

    @abstractmethod
    def create(self) -> np.ndarray:
        """The state of no rows."""

    @abstractmethod
    def add(self, state: np.ndarray, values: Sequence[np.ndarray], weight: np.ndarray) -> np.ndarray:
        """The state after rows, given as columns, that count `weight` times each."""

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The state of both states' rows; sums, unless a statistic says otherwise."""
        return a + b

    @abstractmethod
    def finish(self, state: np.ndarray) -> float:
        """The value; NaN if there is none."""


class Ratio(Statistic):
    """The sum of the first column over that of the second."""

    columns = 2

    def create(self) -> np.ndarray:
        return np.zeros(2)

    def add(self, state, values, weight):
        return state + np.array([weight @ values[0], weight @ values[1]])

    def finish(self, state):
        return float(state[0] / state[1]) if state[1] else float("nan")


class TrimmedMean(Statistic):
    """The mean without a share of the weight at either end, from counts and sums between cuts.

    Exact where no bin is cut that holds different values: always, if each value has a bin.
    Elsewhere a cut bin counts with its mean, so the error is at most the width of the two
    cut bins times their share of the weight.
    """

    def __init__(self, cuts: Sequence[float], share: float = 0.1):
        if not 0 <= share < 0.5:
            raise ValueError("share must be at least 0 and less than one half")
        self.cuts, self.share = np.asarray(cuts, float), share

    @classmethod
    def of(cls, df: DataFrame, column: str, share: float = 0.1, bins: int = 4096) -> TrimmedMean:
        """With cuts at the column's values if there are at most `bins` of them, else at that many quantiles."""
        x = df.select(clean(column).alias("x")).filter("x is not null")
        some = [r["x"] for r in x.distinct().limit(bins + 1).collect()]  # bounded by bins
        if len(some) > bins:
            some = x.agg(F.percentile_approx("x", [i / bins for i in range(1, bins)], 10 * bins)).first()[0]
        return cls(sorted(set(some)), share)

    def create(self) -> np.ndarray:
        return np.zeros(2 * (len(self.cuts) + 1))

    def add(self, state, values, weight):
        n = len(self.cuts) + 1
        at = np.searchsorted(self.cuts, values[0], "left")  # up to and with the cut
        return state + np.concatenate([np.bincount(at, weight, n), np.bincount(at, weight * values[0], n)])

    def finish(self, state):
        count, total = np.split(state, 2)
        n = count.sum()
        if not n:
            return float("nan")
        upto = np.cumsum(count)
        kept = np.clip(np.minimum(upto, n * (1 - self.share)) - np.maximum(upto - count, n * self.share), 0, None)
        mean = np.divide(total, count, out=np.zeros_like(total), where=count > 0)
        return float(kept @ mean / kept.sum())


class Extremes(Statistic):
    """The range of a column: a statistic whose states do not add up."""

    def create(self) -> np.ndarray:
        return np.array([np.inf, -np.inf])

    def add(self, state, values, weight):
        own = values[0][weight > 0]
        return self.merge(state, np.array([own.min(initial=np.inf), own.max(initial=-np.inf)]))

    def merge(self, a, b):
        return np.array([min(a[0], b[0]), max(a[1], b[1])])

    def finish(self, state):
        return float(state[1] - state[0]) if state[0] <= state[1] else float("nan")


#: Groups whose states a task holds before it passes them on, times the state's numbers.
HELD = 1 << 20


def aggregate(rows: DataFrame, by: str, columns: Sequence[str], weight: str, statistic: Statistic) -> DataFrame:
    """(by, stat) per group of a whole-number column: null where the statistic has no value. Rows with a null in a column are left out."""
    if len(columns) != statistic.columns:
        raise ValueError(f"the statistic needs {statistic.columns} columns, not {len(columns)}")
    own = rows.select(F.col(by).cast("long").alias("g"), F.col(weight).cast("double").alias("w"), *(clean(c).alias(f"x{i}") for i, c in enumerate(columns)))
    own = own.filter(F.expr(" and ".join(f"x{i} is not null" for i in range(len(columns)))))
    most = max(1, HELD // len(statistic.create()))

    def states(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate([np.zeros(0), *held.values()])
        size = len(statistic.create())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * size), pa.array(flat))
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), lists], names=["g", "state"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            g = batch.column("g").to_numpy()
            order = np.argsort(g, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(g[order])) + 1, len(g)) if len(g) else []
            values = [batch.column(f"x{i}").to_numpy()[order] for i in range(len(columns))]
            w, start = batch.column("w").to_numpy()[order], 0
            for end in ends:
                key = int(g[order[start]])
                held[key] = statistic.add(held.get(key, statistic.create()), [v[start:end] for v in values], w[start:end])
                start = end
                if len(held) > most:
                    yield states(held)
                    held = {}
        if held:
            yield states(held)

    def merge(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column("state")
            flat = lists.flatten().to_numpy().reshape(len(batch), -1) if len(batch) else []
            for key, state in zip(batch.column("g").to_pylist(), flat, strict=True):
                if key not in held and len(held) >= most:  # sorted by key: earlier groups are complete
                    yield values_of(held)
                    held = {}
                held[key] = statistic.merge(held[key], state) if key in held else state
        yield values_of(held)

    def values_of(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([statistic.finish(s) for s in held.values()], pa.float64(), from_pandas=True)], names=["g", "stat"])

    partial = own.mapInArrow(add, "g long, state array<double>")
    # a group's states number as many as tasks, and each is small
    merged = partial.repartition("g").sortWithinPartitions("g").mapInArrow(merge, "g long, stat double")
    return merged.withColumnRenamed("g", by)
