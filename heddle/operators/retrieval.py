"""Two-space hybrid retrieval: one row of a collection against all rows of the other, for many rows at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from heddle.functions import sparse, vector
from heddle.operators import kernel

VECTORS = ("problem_dense", "problem_sparse", "capability_dense", "capability_sparse")
SCORES = ("problem_score", "capability_score", "final_score")


@dataclass(frozen=True)
class Weights:
    """Shares of the spaces, the floor under problem scores, and the sign of shared words.

    With sign -1 shared words lower a score, as the distance operator that the scores are defined with does; +1 is
    the opposite reading.
    """

    problem_dense: float = 0.8
    problem_sparse: float = 0.2
    capability_dense: float = 0.5
    capability_sparse: float = 0.5
    problem: float = 0.9
    capability: float = 0.1
    floor: float = 0.2
    sign: int = -1


def limits(retrieve: int | None = None, rerank: int | None = None, top_k: int | None = None) -> tuple[int, int]:
    """(retrieved, reranked) rows from optional requests: 50 and 20 if nothing is asked for, at least 1, and no more
    reranked than retrieved."""
    n = retrieve or top_k or 50
    k = rerank or min(n, top_k or 20)
    n = max(1, n)
    return n, min(max(1, k), n)


def usable_sources(rows: DataFrame) -> DataFrame:
    """Rows that can be searched with: both dense vectors; missing sparse vectors are empty."""
    out = rows.where(F.col("problem_dense").isNotNull() & F.col("capability_dense").isNotNull())
    for c in ("problem_sparse", "capability_sparse"):
        out = out.withColumn(c, F.coalesce(c, sparse.empty()))
    return out


def usable_candidates(rows: DataFrame) -> DataFrame:
    """Rows that can be found: all four vectors."""
    out = rows
    for c in VECTORS:
        out = out.where(F.col(c).isNotNull())
    return out


def scores(a: str, b: str, w: Weights = Weights()) -> dict[str, Column]:
    """The three scores of joined rows with prefixes a and b, as expressions."""

    def space(name: str, dense: float, words: float) -> Column:
        return F.lit(dense) * vector.cosine_db(f"{a}.{name}_dense", f"{b}.{name}_dense") + F.lit(words) * (w.sign * sparse.inner_product(f"{a}.{name}_sparse", f"{b}.{name}_sparse"))

    problem, capability = space("problem", w.problem_dense, w.problem_sparse), space("capability", w.capability_dense, w.capability_sparse)
    return {"problem_score": problem, "capability_score": capability, "final_score": F.lit(w.problem) * problem + F.lit(w.capability) * capability}


class _Side:
    """Rows of one side as matrices and entries, by space."""

    def __init__(self, rows: pa.Table, ids: str):
        self.n, self.ids = rows.num_rows, rows.column(ids).combine_chunks().to_numpy(zero_copy_only=False)
        self.dense = {s: kernel.Dense.of(rows.column(f"{s}_dense")) for s in ("problem", "capability")}
        self.sparse = {s: kernel.Sparse.of(rows.column(f"{s}_sparse")) for s in ("problem", "capability")}


class _Fold:
    """What the sources of a group need of its candidates, in blocks of sources.

    A piece's scores come from matrix products, whose last digits depend on where a row stands. So pairs that are close
    to a limit are scored again one by one, by sums in a fixed order: equal vectors then have equal scores anywhere.
    """

    #: Pairs that are scored again at once.
    AGAIN = 1 << 16

    def __init__(self, sources: pa.Table, w: Weights, size: int):
        self.w = w
        self.spaces = (("problem", w.problem_dense, w.problem_sparse), ("capability", w.capability_dense, w.capability_sparse))
        self.blocks = [_Side(sources.slice(i, size), "source_id") for i in range(0, sources.num_rows, size)]

    def near(self, a: _Side, b: _Side) -> tuple[np.ndarray, np.ndarray, float]:
        """Problem and final scores of all pairs, and a bound of their error."""
        total, bound = {}, 1.0
        for name, dense, words in self.spaces:
            x, y = a.dense[name].unit, b.dense[name].unit
            if x.shape[1] != y.shape[1]:
                raise ValueError("vectors of different lengths")
            total[name] = (dense * x) @ y.T
            a.sparse[name].add_products(b.sparse[name], words * self.w.sign, total[name])
            bound += abs(dense) + abs(words) * a.sparse[name].longest * b.sparse[name].longest
        return total["problem"], self.w.problem * total["problem"] + self.w.capability * total["capability"], 1e-11 * bound

    def exact(self, a: _Side, b: _Side, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The three scores of some pairs, as rows."""
        out = np.empty((3, len(r)))
        for i in range(0, len(r), self.AGAIN):
            x, y = r[i : i + self.AGAIN], c[i : i + self.AGAIN]
            p, q = (dense * a.dense[s].cosines(b.dense[s], x, y) + words * self.w.sign * a.sparse[s].products(b.sparse[s], x, y) for s, dense, words in self.spaces)
            out[:, i : i + self.AGAIN] = p, q, self.w.problem * p + self.w.capability * q
        return out


class _Best(_Fold):
    """The best candidates of every source."""

    def __init__(self, sources: pa.Table, w: Weights, size: int, most: int, kinds: tuple[pa.DataType, pa.DataType]):
        super().__init__(sources, w, size)
        self.most, self.kinds = most, kinds
        self.found: list[list[tuple]] = [[] for _ in self.blocks]
        self.waiting = [0] * len(self.blocks)
        self.limit = [np.full((b.n, 1), -np.inf) for b in self.blocks]
        self.last = [np.zeros(b.n, self.blocks[0].ids.dtype) for b in self.blocks]

    def fewer(self, rows: pa.Table) -> pa.Table:
        """Without copies that as many others with smaller ids stand before."""
        seen: dict[bytes, list[int]] = {}
        dense = np.hstack([kernel.dense(rows.column(f"{s}_dense")) for s in ("problem", "capability")])
        keys = [dense[i].tobytes() for i in range(rows.num_rows)]
        for i, k in enumerate(keys):
            seen.setdefault(k, []).append(i)
        if max(map(len, seen.values())) <= self.most:
            return rows
        seen = {}
        words = [rows.column(f"{s}_sparse").to_pylist() for s in ("problem", "capability")]
        for i, k in enumerate(keys):
            seen.setdefault(k + repr((words[0][i], words[1][i])).encode(), []).append(i)
        ids = rows.column("candidate_id").to_pylist()
        return rows.take(pa.array(sorted(i for x in seen.values() for i in sorted(x, key=ids.__getitem__)[: self.most])))

    def add(self, candidates: pa.Table) -> None:
        b = _Side(self.fewer(candidates), "candidate_id")
        for k, a in enumerate(self.blocks):
            problem, final, error = self.near(a, b)
            low = self.limit[k]
            if np.isneginf(low).any():
                sure = np.where(problem < self.w.floor + error, -np.inf, np.where(np.isnan(final), np.inf, final))
                low = np.maximum(low, kernel.least(sure, self.most))
            r, c = np.nonzero(~(problem < self.w.floor - error) & ~(final < low - 2 * error))
            # of NaN, only smaller ids come before a last one that is NaN
            full = np.isposinf(self.limit[k][r, 0])
            if full.any():
                on = ~full
                on[full] = np.isnan(final[r[full], c[full]]) & (b.ids[c[full]] < self.last[k][r[full]])
                r, c = r[on], c[on]
            scores = self.exact(a, b, r, c)
            on = ~(scores[0] < self.w.floor)
            self.found[k].append((r[on], b.ids[c[on]], *scores[:, on]))
            self.waiting[k] += int(on.sum())
            if self.waiting[k] > a.n * self.most // 2:
                self.settle(k)

    def settle(self, k: int) -> None:
        """Cuts what was found for a block to the best."""
        row, ids, *scores = (np.concatenate(x) for x in zip(*self.found[k]))
        at = kernel.first(row, scores[2], ids, self.most)
        row, ids, scores = row[at], ids[at], [x[at] for x in scores]
        self.found[k], self.waiting[k] = [(row, ids, *scores)], 0
        end = np.flatnonzero(np.append(row[1:] != row[:-1], True)) if len(row) else np.zeros(0, int)
        end = end[np.bincount(row, minlength=self.blocks[k].n)[row[end]] == self.most]
        last = scores[2][end]
        self.limit[k][row[end], 0] = np.where(np.isnan(last), np.inf, last)
        self.last[k] = np.zeros(self.blocks[k].n, ids.dtype)
        self.last[k][row[end]] = ids[end]

    def result(self) -> pa.Table:
        out = []
        for k, a in enumerate(self.blocks):
            self.settle(k)
            row, ids, *scores = self.found[k][0]
            out.append(pa.table({"source_id": pa.array(a.ids[row], self.kinds[0]), "candidate_id": pa.array(ids, self.kinds[1]), **dict(zip(SCORES, scores, strict=True))}))
        return pa.concat_tables(out)


class _Passing(_Fold):
    """How many candidates pass the floor for every source, and the best final score of those."""

    def __init__(self, sources: pa.Table, w: Weights, size: int, kind: pa.DataType):
        super().__init__(sources, w, size)
        self.kind = kind
        self.count = [np.zeros(b.n, np.int64) for b in self.blocks]
        self.most = [np.full(b.n, -np.inf) for b in self.blocks]

    def add(self, candidates: pa.Table) -> None:
        b = _Side(candidates, "candidate_id")
        for k, a in enumerate(self.blocks):
            problem, final, error = self.near(a, b)
            passed = ~(problem < self.w.floor)
            r, c = np.nonzero(np.abs(problem - self.w.floor) <= error)
            passed[r, c] = ~(self.exact(a, b, r, c)[0] < self.w.floor)
            self.count[k] += passed.sum(1)
            self.most[k] = np.maximum(self.most[k], np.where(passed, final, -np.inf).max(1))  # NaN, the largest, stays NaN

    def result(self) -> pa.Table:
        at = [np.flatnonzero(n) for n in self.count]
        return pa.concat_tables(
            pa.table({"source_id": pa.array(a.ids[i], self.kind), "passed": n[i], "best": m[i]}) for a, i, n, m in zip(self.blocks, at, self.count, self.most, strict=True)
        )


def _sides(sources: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    return usable_sources(sources).select("id", *VECTORS), usable_candidates(candidates).select("id", *VECTORS)


def search(sources: DataFrame, candidates: DataFrame, most: int = 50, w: Weights = Weights()) -> DataFrame:
    """source_id, candidate_id, the three scores, and rank: the best candidates of every source whose problem score
    reaches the floor, ties by candidate id.

    Both frames have ``id`` and the four vectors. Only these five columns are read.
    """
    left, right = _sides(sources, candidates)
    kinds, size = tuple(to_arrow_type(x.schema["id"].dataType) for x in (left, right)), kernel.SOURCES
    schema = f"source_id {left.schema['id'].dataType.simpleString()}, candidate_id {right.schema['id'].dataType.simpleString()}, problem_score double, capability_score double, final_score double"
    return ranked(kernel.streamed(left, right, lambda rows: _Best(rows, w, size, most, kinds), schema), most)


def passing(sources: DataFrame, candidates: DataFrame, w: Weights = Weights()) -> DataFrame:
    """source_id, passed and best: how many candidates reach the floor for every source that any does, and the best
    final score. A group of candidates gives one row a source, not its pairs."""
    left, right = _sides(sources, candidates)
    kind, size = to_arrow_type(left.schema["id"].dataType), kernel.SOURCES
    found = kernel.streamed(left, right, lambda rows: _Passing(rows, w, size, kind), f"source_id {left.schema['id'].dataType.simpleString()}, passed bigint, best double")
    return found.groupBy("source_id").agg(F.sum("passed").alias("passed"), F.max("best").alias("best"))


def search_by_expressions(sources: DataFrame, candidates: DataFrame, most: int = 50, w: Weights = Weights()) -> DataFrame:
    """The same by JVM expressions over all pairs: for small sides, and as a check of the kernel."""
    s = scores("s", "c", w)
    pairs = usable_sources(sources).alias("s").join(usable_candidates(candidates).alias("c"), F.lit(True))
    made = pairs.select(F.col("s.id").alias("source_id"), F.col("c.id").alias("candidate_id"), *(s[x].alias(x) for x in SCORES))
    return ranked(made.where(F.col("problem_score") >= w.floor), most)


def ranked(found: DataFrame, most: int) -> DataFrame:
    """Rank from 1 within each source, by final score and then id."""
    order = Window.partitionBy("source_id").orderBy(F.col("final_score").desc(), "candidate_id")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= most)
