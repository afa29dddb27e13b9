"""Percentiles of numeric columns by relative-error quantile sketches.

A sketch is a list of compactors. Level h holds values that each stand for 2**h
measurements. A full level sorts its values and promotes every other one of its lowest
values, in a number of sections that follows the binary count of its compactions; its
largest values are never among them. So the upper tail keeps its own values and the error
of a rank shrinks with its distance from the top: at percentile q it is at most
``error_of(q)`` times the number of measurements, and 0 while nothing has been compacted.

Sketches of parts, days or clusters merge level by level, with the same error.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallforge.session import cut_lineage

#: Values in a section, and sections that a level has at least.
SECTION, SECTIONS = 64, 3
PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)
SKETCH_TYPE = "n bigint, levels array<array<double>>, compactions array<bigint>"


def error_of(q: float) -> float:
    """Error of the rank at percentile ``q``, as a share of the measurements: three standard
    deviations of a relative compactor with these sections."""
    return 3 * math.sqrt(0.0512 / SECTIONS) / SECTION * (1 - q)


def _coin(seed: int, level: int, done: int) -> int:
    """Whether a compaction promotes the odd or the even values: drawn for every second one, of
    which the next is the complement, so that two in a row cancel."""
    x = (seed * 0x9E3779B97F4A7C15 + level * 0xBF58476D1CE4E5B9 + (done >> 1) * 0x94D049BB133111EB) & (1 << 64) - 1
    x = (x ^ x >> 31) * 0xD6E8FEB86659FD93 & (1 << 64) - 1
    return (x >> 40 ^ done) & 1


class Sketch:
    """``seed`` keeps the coins of sketches that are built apart independent."""

    def __init__(self, n: int = 0, levels=(), compactions=(), seed: int = 0):
        self.seed = seed
        self.n, self.levels, self.compactions = int(n), [np.asarray(x, float) for x in levels], list(map(int, compactions))

    @staticmethod
    def capacity(compactions: int) -> int:
        """Twice the sections that this many compactions call for."""
        return 2 * SECTION * max(SECTIONS, compactions.bit_length())

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self._put(0, values)
        self._shrink()

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        for level, values in enumerate(other.levels):
            self._put(level, values)
            # the joint schedule of two compactors is the union of their bits
            self.compactions[level] |= other.compactions[level]
        self._shrink()

    def _put(self, level: int, values: np.ndarray) -> None:
        while len(self.levels) <= level:
            self.levels.append(np.empty(0))
            self.compactions.append(0)
        self.levels[level] = np.concatenate((self.levels[level], values))

    def _shrink(self) -> None:
        level = 0
        while level < len(self.levels):
            while len(self.levels[level]) > (most := self.capacity(self.compactions[level])):
                values, done = np.sort(self.levels[level]), self.compactions[level]
                sections = (done ^ (done + 1)).bit_length()  # trailing ones, and one
                keep = max(most // 2, most - sections * SECTION)
                lowest = len(values) - keep
                lowest -= lowest & 1
                self._put(level + 1, values[_coin(self.seed, level, done) : lowest : 2])
                self.levels[level] = values[lowest:]
                self.compactions[level] = done + 1
            level += 1

    def quantiles(self, at) -> list[float | None]:
        """The smallest kept value whose rank reaches the share; None of no measurements."""
        values = np.concatenate(self.levels) if self.levels else np.empty(0)
        if not len(values):
            return [None] * len(at)
        weights = np.repeat([1 << h for h in range(len(self.levels))], [len(x) for x in self.levels])
        order = np.argsort(values, kind="stable")
        ranks = np.cumsum(weights[order])
        # measured from the top, where the ranks are exact
        least = np.ceil(np.asarray(at) * self.n - 1e-9) + (ranks[-1] - self.n)
        where = np.searchsorted(ranks, np.maximum(least, 1))
        return values[order][np.minimum(where, len(values) - 1)].tolist()

    def row(self) -> tuple:
        return self.n, [x.tolist() for x in self.levels], self.compactions


def _fold(keys: list[str], take, give):
    """Rows that come sorted by ``keys`` -> one row a key. ``take(sketch, rows)`` adds rows of
    one key, which may come in several batches; one sketch is held at a time."""

    def run(batches):
        # each task's sketches, and each key's, have coins of their own
        current, sketch, seed = None, None, TaskContext.get().partitionId() << 32
        for batch in batches:
            if not len(batch):
                continue
            ids = batch[keys]
            new = (ids.ne(ids.shift()) & ~(ids.isna() & ids.shift().isna())).any(axis=1).to_numpy()
            new[0] = True
            bounds = [*np.flatnonzero(new), len(batch)]
            out, heads = [], ids.iloc[bounds[:-1]].itertuples(index=False, name=None)
            for head, a, b in zip(heads, bounds, bounds[1:], strict=False):
                head = tuple(None if pd.isna(x) else x for x in head)
                if head != current:
                    if sketch is not None:
                        out.append((*current, *give(sketch)))
                    current, sketch, seed = head, Sketch(seed=seed), seed + 1
                take(sketch, batch, a, b)
            if out:
                yield pd.DataFrame(out, columns=[*keys, *SKETCH_COLUMNS])
        if sketch is not None:
            yield pd.DataFrame([(*current, *give(sketch))], columns=[*keys, *SKETCH_COLUMNS])

    return run


SKETCH_COLUMNS = ["n", "levels", "compactions"]


def _take_values(sketch: Sketch, batch: pd.DataFrame, a: int, b: int) -> None:
    sketch.add(batch["value"].to_numpy()[a:b])


def _take_sketches(sketch: Sketch, batch: pd.DataFrame, a: int, b: int) -> None:
    for row in batch.iloc[a:b][SKETCH_COLUMNS].itertuples(index=False, name=None):
        sketch.merge(Sketch(*row))


def _types(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def measurements(df: DataFrame, id_col: str, value: Column, *keys: Column) -> DataFrame:
    """(keys, value) of each id once. Null, NaN and negative values are no measurements; rows
    that share an id are taken to be equal; rows of a null id count each for itself."""
    rows = df.select(F.col(id_col).alias("id"), *keys, value.cast("double").alias("value"))
    rows = rows.where("value >= 0 AND NOT isnan(value)")
    return rows.where("id IS NOT NULL").dropDuplicates(["id"]).unionByName(rows.where("id IS NULL")).drop("id")


def sketch_values(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value) -> mergeable sketches, one or more of each key.

    Each task sketches its own rows, whatever their keys, so a key that holds much of the
    data is spread over all tasks and only sketches are shuffled.
    """
    build = _fold(keys, _take_values, Sketch.row)
    return values.sortWithinPartitions(*keys).mapInPandas(build, f"{_types(values, keys)}, {SKETCH_TYPE}")


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One sketch of each key; null is a key."""
    merge = _fold(keys, _take_sketches, Sketch.row)
    rows = sketches.select(*keys, *SKETCH_COLUMNS).repartition(*keys)
    return rows.sortWithinPartitions(*keys, "n", "levels").mapInPandas(merge, f"{_types(sketches, keys)}, {SKETCH_TYPE}")


def percentiles(sketches: DataFrame, keys: list[str], at=PERCENTILES) -> DataFrame:
    """(keys, n, exact, then of each percentile its value and the bound of its rank's error)."""
    at = list(at)
    names = [f"p{100 * q:g}".replace(".", "_") for q in at]

    def run(batches):
        for batch in batches:
            found = [Sketch(*r) for r in batch[SKETCH_COLUMNS].itertuples(index=False, name=None)]
            out = batch[keys].copy()
            out["n"] = [s.n for s in found]
            out["exact"] = [not any(s.compactions) for s in found]
            values = [s.quantiles(at) for s in found]
            for i, (name, q) in enumerate(zip(names, at, strict=True)):
                out[name] = [v[i] for v in values]
                out[f"{name}_error"] = np.where(out["exact"], 0.0, error_of(q))
            yield out

    columns = ", ".join(f"{n} double, {n}_error double" for n in names)
    return sketches.mapInPandas(run, f"{_types(sketches, keys)}, n bigint, exact boolean, {columns}")


def percentiles_by_day(values: DataFrame, keys: list[str], day: str = "day", at=PERCENTILES) -> DataFrame:
    """Percentiles of each key and day, and of each key over all days (day null, all_days true).

    The days' sketches are written once; the second result is merged from them, as results of
    days that were sketched at other times would be.
    """
    by_day = cut_lineage(merge_sketches(sketch_values(values, [*keys, day]), [*keys, day]))
    overall = percentiles(merge_sketches(by_day, keys), keys, at)
    return (
        percentiles(by_day, [*keys, day], at)
        .withColumn("all_days", F.lit(False))
        .unionByName(overall.withColumn(day, F.lit(None).cast("date")).withColumn("all_days", F.lit(True)))
    )
