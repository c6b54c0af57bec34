"""Exact top-k inner products with a KD-tree per shard.

Components become floor(256 * x). A coarse KD-tree of median splits, fitted on a bounded sample, deals all vectors into at
most LEAVES regions, and a region into shards of some SHARD vectors by a hash of the row; so a third of all vectors
may be equal. A region's box is tight over all of its vectors. A shard's tree splits at medians of its widest
dimension, by position, so ties and equal vectors do no harm, and every node has a tight bounding box. For a query the
best inner product in a box is the sum over dimensions of the larger of q * low and q * high. The search takes nodes
best bound first and ends at the first whose bound is below the k-th score so far. Each query is first searched in
one shard of its own region; the k-th score found there is held against the boxes of all regions, and goes with the
query to the shards of those whose box allows as much. Vectors go to no block of queries that has none for them.

Queries are a stated set, and go in blocks of BLOCK, so a task holds one shard and one block. The sample has at most
SAMPLE vectors and VALUES components; it decides where vectors go, never what is found.

Edge cases: vectors that are null, empty or hold null, NaN or infinite components (or such that 256 * x is infinite)
take no part, nor do rows without an id; vectors of another length are no candidates of a query; equal scores are
ordered by id; rows that repeat an id are vectors of their own, of which none is a candidate of a query with that id;
very large components are worked on as Python's integers, so the order is exact, and a score beyond 64 bits is given as
the largest or smallest long; very long vectors are whole; further columns are left out, whatever their names; an empty
table, or one without queries, gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.scratch import Scratch

SHARD, BLOCK, LEAF = 8192, 4096, 128
#: Regions of the coarse tree, and vectors and components of the sample that it is fitted on, at most.
LEAVES, SAMPLE, VALUES = 256, 1 << 14, 1 << 21
#: Integers up to here are exact as doubles.
EXACT = 1 << 53
#: Scores strictly within are given as they are; others also as digits, shifted to be positive, in one width.
LONG, WIDTH = (1 << 63) - 1, 660


class Tree:
    """A shard's vectors in tree order. Node i of level d covers a range of rows; leaves are the last level."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        order = np.arange(len(ids))
        self.spans, self.children = [(0, len(ids))], [(-1, -1)]
        i = 0
        while i < len(self.spans):
            a, b = self.spans[i]
            if b - a > LEAF:
                part = vectors[order[a:b]]
                dim = int(np.argmax(part.max(0) - part.min(0)))
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, dim], mid)]
                self.children[i] = (len(self.spans), len(self.spans) + 1)
                self.spans += [(a, a + mid), (a + mid, b)]
                self.children += [(-1, -1), (-1, -1)]
            i += 1
        self.vectors, self.ids = vectors[order], ids[order]
        self.low = np.array([self.vectors[a:b].min(0) for a, b in self.spans])
        self.high = np.array([self.vectors[a:b].max(0) for a, b in self.spans])

    def search(self, query: np.ndarray, bound: np.ndarray, own: int, k: int, least: float) -> list[tuple[int, int]]:
        """The k best (score, -id) but for those of id own and those below least; more are given if ties need it."""
        best: list[tuple[int, int]] = []  # a heap with the k-th on top
        nodes = [(-bound[0], 0)]
        while nodes:
            b, i = heapq.heappop(nodes)
            if -b < least:
                break
            left, right = self.children[i]
            if left >= 0:
                for c in (left, right):
                    if bound[c] >= least:
                        heapq.heappush(nodes, (-bound[c], c))
                continue
            s, e = self.spans[i]
            scores = self.vectors[s:e] @ query
            for j in np.flatnonzero(scores >= least).tolist():
                if self.ids[s + j] == own:
                    continue
                found = (int(scores[j]), -int(self.ids[s + j]))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
            if len(best) == k:
                least = max(least, best[0][0])
        return best


def bounds(low: np.ndarray, high: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """The best inner product that each box allows each query."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def split(sample: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Nodes of a coarse tree as (dimension, value, left, right), the first being the root: vectors below the value go
    left. A link below 0 is the region ~link; equal vectors aren't split. No nodes: all is region 0."""
    nodes: list[tuple[int, float, int, int]] = []
    regions = 0

    def grow(part: np.ndarray, n: int) -> int:
        nonlocal regions
        dim = int(np.argmax(part.max(0) - part.min(0))) if len(part) > 1 and n > 1 else 0
        value = float(np.median(part[:, dim])) if len(part) > 1 and n > 1 else 0.0
        below = part[:, dim] < value
        if n > 1 and not below.any():  # the median is the least value
            below = part[:, dim] <= value
            value = float(np.nextafter(value, np.inf))
        if n < 2 or not below.any() or below.all():
            regions += 1
            return -regions
        at = len(nodes)
        nodes.append((dim, value, 0, 0))
        nodes[at] = (dim, value, grow(part[below], n // 2), grow(part[~below], n - n // 2))
        return at

    if len(sample):
        grow(sample, leaves)
    return nodes


def regions_of(vectors: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    """The region of each vector."""
    out = np.zeros(len(vectors), np.int32)
    todo = [(0, np.arange(len(vectors)))] if nodes else []
    while todo:
        at, rows = todo.pop()
        dim, value, left, right = nodes[at]
        below = vectors[rows, dim] < value
        for link, some in ((left, rows[below]), (right, rows[~below])):
            if link < 0:
                out[some] = ~link
            elif len(some):
                todo.append((link, some))
    return out


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _exact(*matrices: np.ndarray) -> tuple[bool, list[np.ndarray]]:
    """Whether sums of products stay exact as doubles, and the matrices, of Python's integers if not. The last is
    multiplied by the others."""
    *sides, q = (float(np.abs(m).max(initial=0)) for m in matrices)
    if max(sides) < EXACT and q < EXACT and max(sides) * q * matrices[-1].shape[1] < EXACT:
        return True, list(matrices)
    return False, [np.array([[int(x) for x in v] for v in m], object).reshape(m.shape) for m in matrices]


def _digits(score: int) -> str | None:
    """A score that isn't strictly within 64 bits, in digits that sort as scores do."""
    return None if -LONG < score < LONG else str(score + 10**WIDTH).zfill(WIDTH + 1)


def _least(scores: pa.ChunkedArray, digits: pa.ChunkedArray, small: bool) -> list[float]:
    """Scores below which nothing is wanted; with small, all scores to compare with are exact as doubles."""
    out: list[float] = []
    for s, d in zip(scores.to_pylist(), digits.to_pylist(), strict=True):
        x = float("-inf") if s is None else int(d) - 10**WIDTH if d else s
        out.append((float("inf") if x > EXACT else float("-inf") if x < -EXACT else x) if small else x)
    return out


def _fit(rows: DataFrame, n: int) -> dict[int, list[tuple[int, float, int, int]]]:
    """A coarse tree for each length of vectors that the sample has."""
    longest = rows.agg(F.max("dim")).first()[0] or 1
    wanted = max(1, min(SAMPLE, VALUES // longest))
    taken = rows.where(F.pmod(F.xxhash64("row"), F.lit(max(n, 1))) < wanted).select("dim", "v").limit(wanted).toArrow()
    dims = taken.column("dim").to_numpy()
    return {int(d): split(_matrix(taken.filter(pa.array(dims == d)).column("v"), int(d)), min(LEAVES, -(-n // SHARD))) for d in np.unique(dims)}


def _placed(df: DataFrame, trees: dict[int, list[tuple[int, float, int, int]]]) -> DataFrame:
    """Rows with their region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            out = np.zeros(len(dims), np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                out[at] = regions_of(_matrix(batch.column("v").take(pa.array(at)), int(d)), trees.get(int(d), []))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "region"])

    return df.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in df.schema)}, region int")


def topk(vectors: DataFrame, queries: DataFrame, scratch: Scratch, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best vectors of every row of queries (rows of the same columns)."""

    def taken(df: DataFrame) -> DataFrame:
        x = F.transform(F.col(embedding), lambda c: c.cast("double") * 256.0)
        good = f"size({embedding}) > 0 and {vec_id} is not null and forall({embedding}, c -> c is not null and not isnan(c) and abs(cast(c as double)) * 256 < double('Infinity'))"
        whole = F.transform(x, lambda c: F.when(F.abs(c) < float(EXACT), F.floor(c).cast("double")).otherwise(c))
        return df.where(good).select(F.col(vec_id).cast("bigint").alias("id"), whole.alias("v"), F.size(embedding).alias("dim"), F.monotonically_increasing_id().alias("row"))

    rows = scratch.put(taken(vectors), "vectors")
    asked = scratch.put(taken(queries).withColumnRenamed("row", "query"), "queries")
    trees = _fit(rows, rows.count())
    parts = max(1, -(-asked.count() // BLOCK))
    rows = scratch.put(_placed(rows, trees), "placed")
    ends = rows.select("dim", "region", F.posexplode("v").alias("at", "x")).groupBy("dim", "region", "at").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    boxes = ends.groupBy("dim", "region").agg(F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("b"))
    sizes = rows.groupBy("dim", "region").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
    boxes = scratch.put(boxes.join(sizes, ["dim", "region"]).select("dim", "region", "shards", F.col("b.low").alias("low"), F.col("b.high").alias("high")), "boxes")
    sizes = boxes.select("dim", "region", "shards")
    sharded = rows.join(sizes, ["dim", "region"]).select("dim", "region", F.pmod(F.xxhash64("row"), "shards").cast("int").alias("shard"), "id", "v")
    part = F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int")
    home = F.pmod(F.xxhash64("query", F.lit(1)), "shards").cast("int")
    asked = scratch.put(_placed(asked, trees).join(sizes, ["dim", "region"], "left").select("query", "id", "v", "dim", part.alias("part"), F.col("region").alias("home_region"), F.coalesce(home, F.lit(-1)).alias("home")), "asked")
    group = ("dim", "region", "shard", "part")

    def meet(key: tuple, shard: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int, str | None]] = []
        if shard.num_rows and block.num_rows:
            dim = key[0].as_py()
            small, (v, q) = _exact(_matrix(shard.column("v"), dim), _matrix(block.column("v"), dim))
            tree = Tree(v, shard.column("id").to_numpy())
            least = _least(block.column("least"), block.column("digits"), small)
            for i, (n, own) in enumerate(zip(block.column("query").to_pylist(), block.column("id").to_pylist(), strict=True)):
                if i % 256 == 0:
                    bound = bounds(tree.low, tree.high, q[i : i + 256])
                out += [(n, own, -j, max(-LONG, min(LONG, s)), _digits(s)) for s, j in tree.search(q[i], bound[i % 256], own, k, least[i])]
        columns = list(zip(*out, strict=True)) or [()] * 5
        types = (*[pa.int64()] * 4, pa.string())
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("query", "query_id", "vec_id", "score", "digits"), columns, types, strict=True)})

    def searched(sent: DataFrame) -> DataFrame:
        """What queries find in the shards that they are sent to; a shard goes only to blocks that are."""
        met = sharded.join(sent.groupBy(*(F.col(c).alias(c) for c in group)).agg(F.lit(1)).select(*group), ["dim", "region", "shard"])
        return met.groupBy(*group).cogroup(sent.groupBy(*group)).applyInArrow(meet, "query bigint, query_id bigint, vec_id bigint, score bigint, digits string")

    def allowed(key: tuple, block: pa.Table, box: pa.Table) -> pa.Table:
        """The regions, but for the home shard, whose box allows a query its k-th score or more."""
        found: tuple[np.ndarray, np.ndarray] = (np.zeros(0, int), np.zeros(0, int))
        if block.num_rows and box.num_rows:
            dim = key[0].as_py()
            small, (low, high, q) = _exact(_matrix(box.column("low"), dim), _matrix(box.column("high"), dim), _matrix(block.column("v"), dim))
            least = _least(block.column("least"), block.column("digits"), small)
            some = [bounds(low, high, q[i : i + 256]) >= np.array(least[i : i + 256], float if small else object)[:, None] for i in range(0, len(q), 256)]
            found = np.nonzero(np.concatenate(some).astype(bool))
        return block.take(pa.array(found[0])).append_column("region", box.column("region").take(pa.array(found[1]))).append_column("shards", box.column("shards").take(pa.array(found[1])))

    unknown = [F.lit(None).cast("bigint").alias("least"), F.lit(None).cast("string").alias("digits")]
    columns = ("query", "id", "v", *group, "least", "digits")
    near = asked.select("query", "id", "v", "dim", "part", F.col("home_region").alias("region"), F.col("home").alias("shard"), *unknown).where("shard >= 0")
    first = scratch.put(searched(near.select(*columns)), "first")
    worst = F.min(F.struct("score", F.coalesce("digits", F.lit("")).alias("digits")))  # digits of one score or none
    kth = first.groupBy("query").agg(worst.alias("worst"), F.count("*").alias("n")).where(F.col("n") == k).select("query", F.col("worst.score").alias("least"), F.nullif("worst.digits", F.lit("")).alias("digits"))
    known = asked.join(kth, "query", "left")
    names = {f.name: f.dataType.simpleString() for f in known.schema}
    offered = boxes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    reached = known.groupBy("dim", "part").cogroup(offered.groupBy("dim", "part")).applyInArrow(allowed, ", ".join(f"{c} {t}" for c, t in names.items()) + ", region int, shards int")
    far = reached.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).where("region != home_region or shard != home")
    rest = searched(scratch.put(far.select(*columns), "far"))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("digits").desc(), "vec_id")
    ranked = first.union(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
