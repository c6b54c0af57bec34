"""Blocks of rows against streams of rows: the exact similarity kernel of retrieval and matching.

Both sides are dealt into a grid of groups by hashes of their ids, a fixed number for a number of cores. A task holds
the sources of its group and reads the candidates as a stream, in pieces that meet the sources as matrices, and keeps
only what each source needs of all candidates seen so far. So what is shuffled and what leaves grow in proportion to
the two tables, though every pair is scored; neither side is broadcast or collected, and there is no cross join of
rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that meet at once, of sources and of candidates: a matrix of all their scores is 16 MB.
SOURCES, CANDIDATES = 1024, 2048
#: Sources that a group has at most, about, and those for which another group is made while there are cores.
HELD, LEAST = 32768, 64
#: Indices of sparse vectors that are multiplied at once as dense slices, and those up to which slices are kept.
SLICE, KEPT = 1024, 64


def dense(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long vectors as a matrix of doubles; different lengths raise."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = set(column.value_lengths().to_pylist())
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(lengths, key=str)}")
    width = lengths.pop() if lengths else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def normalized(m: np.ndarray, zero: float) -> np.ndarray:
    """Rows at length 1; a zero row is divided by ``zero`` (1 leaves it, NaN makes it NaN)."""
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(n == 0, zero, n)


@dataclass(frozen=True)
class Sparse:
    """A column of sparse structs as entries in the order of rows and indices; entries of one index are summed."""

    key: np.ndarray
    value: np.ndarray
    row: np.ndarray
    index: np.ndarray
    start: np.ndarray
    used: np.ndarray
    longest: float
    kept: dict

    @classmethod
    def of(cls, c: pa.Array | pa.ChunkedArray) -> Sparse:
        c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        i, v = c.field("indices"), c.field("values")
        size = np.asarray(i.value_lengths().fill_null(0))
        key = (np.repeat(np.arange(len(c), dtype=np.int64), size) << 32) + (np.asarray(i.flatten(), np.int64) + (1 << 31))
        key, at = np.unique(key, return_inverse=True)
        value = np.bincount(at, np.asarray(v.flatten(), np.float64), len(key))
        row, index = key >> 32, (key & 0xFFFFFFFF) - (1 << 31)
        norms = np.sqrt(np.bincount(row, value * value, max(1, len(c))))
        return cls(key, value, row, index, np.searchsorted(row, np.arange(len(c) + 1)), np.unique(index), float(norms.max()), {})

    def slice(self, part: np.ndarray) -> np.ndarray:
        """The components at some indices, as a dense matrix."""
        last = self.kept.get("part")
        if last is not None and np.array_equal(last[0], part):
            return last[1]
        out = np.zeros((len(self.start) - 1, len(part)))
        at = np.minimum(np.searchsorted(part, self.index), len(part) - 1)
        hit = part[at] == self.index
        out[self.row[hit], at[hit]] = self.value[hit]
        if len(part) <= KEPT:
            self.kept["part"] = part, out
        return out

    def add_products(self, other: Sparse, factor: float, total: np.ndarray) -> None:
        """Adds factor times the inner products of all pairs to a matrix."""
        used = np.intersect1d(self.used, other.used, True)
        # by slices of shared indices, so the two dense slices stay small
        for s in range(0, len(used), SLICE):
            part = used[s : s + SLICE]
            total += (factor * self.slice(part)) @ other.slice(part).T

    def products(self, other: Sparse, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Inner products of some pairs of rows, each summed in the order of its indices wherever it stands."""
        size = self.start[r + 1] - self.start[r]
        pair = np.repeat(np.arange(len(r)), size)
        if not len(pair) or not len(other.key):
            return np.zeros(len(r))
        at = np.arange(len(pair)) + np.repeat(self.start[r] - (np.cumsum(size) - size), size)
        key = (c[pair] << 32) + (self.key[at] & 0xFFFFFFFF)
        found = np.minimum(np.searchsorted(other.key, key), len(other.key) - 1)
        hit = other.key[found] == key
        return np.bincount(pair[hit], self.value[at[hit]] * other.value[found[hit]], len(r))


@dataclass(frozen=True)
class Dense:
    """A column of equally long vectors: components by position, squares of norms, and rows at length 1 (zero: NaN)."""

    by_position: np.ndarray
    squares: np.ndarray
    unit: np.ndarray

    @classmethod
    def of(cls, c: pa.Array | pa.ChunkedArray) -> Dense:
        m = dense(c)
        t = np.ascontiguousarray(m.T)
        return cls(t, sum((x * x for x in t), np.zeros(len(m))), normalized(m, np.nan))

    def cosines(self, other: Dense, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Cosines of some pairs of rows, each summed in the order of its components wherever it stands."""
        total = np.zeros(len(r))
        for x, y in zip(self.by_position, other.by_position, strict=True):
            total += x[r] * y[c]
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.clip(total / np.sqrt(self.squares[r] * other.squares[c]), -1, 1)


def first(row: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions of each row's best entries in order, ties by id; NaN is the largest, as in a database."""
    rank = np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids
    order = np.lexsort((rank, -np.where(np.isnan(score), np.inf, score), ~np.isnan(score), row))
    r = row[order]
    return order[np.arange(len(r)) - np.searchsorted(r, r) < most]


def least(key: np.ndarray, most: int) -> np.ndarray:
    """Each row's value at place ``most``, as a column; minus infinity if there are no more values than that."""
    return np.partition(key, key.shape[1] - most, 1)[:, [key.shape[1] - most]] if key.shape[1] > most else np.full((len(key), 1), -np.inf)


def best(score: np.ndarray, passed: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's best passed scores in order, ties by the columns' ids; NaN is the largest, as in a
    database."""
    key = np.where(passed, np.where(np.isnan(score), np.inf, score), -np.inf)
    r, c = np.nonzero(passed & (key >= least(key, most)))
    at = first(r, score[r, c], ids[c], most)
    return r[at], c[at]


def grid(n_sources: int, tasks: int) -> tuple[int, int]:
    """Groups of sources and of candidates. A row goes to all groups of the other side, so both are kept few."""
    s = min(-(-tasks // max(1, round(math.sqrt(tasks) / 2))), -(-n_sources // LEAST))
    s = max(1, s, -(-n_sources // HELD))
    return s, max(1, -(-tasks // s))


def streamed(sources: DataFrame, candidates: DataFrame, fold: Callable[[pa.Table], object], schema: str) -> DataFrame:
    """The result of every group of the grid. Both frames have ``id`` and the same further columns; fold(sources) makes
    an object with add(candidates), called for one piece after the other, and result(). Ids are source_id and
    candidate_id there."""
    spark, piece = sources.sparkSession, CANDIDATES
    s, c = grid(sources.count(), 2 * spark.sparkContext.defaultParallelism)
    columns = [x for x in sources.columns if x != "id"]

    def number(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    kinds = [x.schema["id"].dataType for x in (sources, candidates)]
    left = sources.select(each(c).alias("_c"), number(s).alias("_s"), F.lit(False).alias("_later"), F.col("id").alias("source_id"), F.lit(None).cast(kinds[1]).alias("candidate_id"), *columns)
    right = candidates.select(number(c).alias("_c"), each(s).alias("_s"), F.lit(True).alias("_later"), F.lit(None).cast(kinds[0]).alias("source_id"), F.col("id").alias("candidate_id"), *columns)
    both = left.unionByName(right).withColumn("_g", F.col("_s") * c + F.col("_c")).drop("_s", "_c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, mine, folded = None, [], None
        for batch in batches:
            place = np.asarray(batch.column("_g")) * 2 + np.asarray(batch.column("_later").cast(pa.int8()))
            cuts = [0, *(np.flatnonzero(np.diff(place)) + 1), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                rows = batch.slice(lo, hi - lo)
                if place[lo] // 2 != group:
                    if folded is not None:
                        yield from folded.result().to_batches()
                    group, mine, folded = place[lo] // 2, [], None
                if place[lo] % 2 == 0:
                    mine.append(rows)
                elif mine or folded is not None:
                    if folded is None:
                        folded, mine = fold(pa.Table.from_batches(mine)), []
                    for i in range(0, hi - lo, piece):
                        folded.add(pa.Table.from_batches([rows.slice(i, piece)]))
        if folded is not None:
            yield from folded.result().to_batches()

    # each group is a partition of its own; sources come before candidates
    return both.repartitionById(s * c, "_g").sortWithinPartitions("_g", "_later").mapInArrow(run, schema)
