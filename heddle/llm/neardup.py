"""MinHash near-duplicates with an LSH forest.

A document's set holds the hashes of its runs of ``k`` words (lower-cased A-Z); with fewer words, its whole
sequence is one. Documents with equal sets are one class at once. Each class has ``TREES * DEPTH`` min-hashes,
in blocks of DEPTH; tree t sorts the classes by the signature that begins at block t. In that order, classes
whose common prefix is at least DEPTH hashes long form a region; they are compared by a sketch of 128 bits of
other min-hashes, all with all in a small region, and in a large one first with the neighbours in windows of REGION
rows, where the sorted order puts the longest common prefixes side by side: the depth adapts to the region.
Pairs whose sketches are near enough only connect classes into units. A region that is large, or that a border of
partitions cuts, and whose rows are then still in several units has all rows outside of its largest unit compared with
all of its rows, block by block; so no pair is missed for its region's size. A unit's links are then confirmed on the
full sets, made again from the texts, by a search that compares every reached class with all unreached ones.

At a similarity of 0.85 a region of some tree holds a pair with probability 1 - (1 - 0.85^5)^24 = 1 - 8e-7, at 0.8
with 1 - 7e-5, and the sketch passes it unless it errs by more than five standard deviations.

No task holds more than UNIT sets or HELD shingles. A larger unit is confirmed in steps. First each class meets those
of one region, then those of other regions where their components are still apart. Then whatever isn't in the unit's largest component by then meets the whole
unit, block by block, so that every pair in different components is compared: the result is that of one search.

Scale: the trees are sorted by range over the whole key, so a group of near copies that holds a third of all rows
is spread over many tasks; edges per region are a spanning forest, not pairs; classes absorb exact copies before
anything else by an aggregation that combines on the map side; a large region's and a large unit's last step cost as
many blocks as the few classes outside of their largest unit or component need. Texts are fetched by id and a hash of the text, so a third of
all rows without an id spread like any others.

Edge cases: a null text, or one without words, has an empty set, which links with nothing; a null id is no
smallest id, so a row without one gets its component's id, or null if nothing there has an id, and is kept only in
that case; rows that repeat an id are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.components import components
from heddle.llm.scratch import Scratch
from heddle.llm.textkit import LOWER, U64, Words, blocks, mix, window_hashes

TREES, DEPTH = 24, 5
#: Rows of a region that are compared all with all, and rows that its next window takes over from the last.
REGION, OVERLAP = 512, 64
#: Rows of a block of a region that is compared further, some more or less.
BLOCK = 8192
#: Classes, and their shingles in all, that one task confirms.
UNIT, HELD = 4096, 4 << 20
#: Bits of the sketch, and by how many standard deviations more of them may differ than in the mean.
BITS, DEVIATIONS = 128, 5.0
_rng = np.random.default_rng(85)
_A = _rng.integers(1, 1 << 62, TREES * DEPTH + BITS, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_B = _rng.integers(1, 1 << 62, TREES * DEPTH + BITS, dtype=np.int64).astype(U64)


def sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingle hashes of each document, document by document."""
    words = Words(LOWER[data], offsets)
    n, docs, h = words.counts(), words.docs(), words.hashes()
    at = np.flatnonzero(words.left() >= k)
    keys, owner = window_hashes(h, k)[at], docs[at]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = [window_hashes(h[a:b], b - a, 7)[:1] for a, b in zip(words.first[short], words.first[short + 1], strict=True)]
        keys, owner = np.concatenate([keys, *whole]), np.concatenate([owner, short])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    once = np.ones(len(keys), bool)
    once[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[once], owner[once]
    return keys, np.searchsorted(owner, np.arange(len(n) + 1))


def prints(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    out = []
    for salt in (U64(0x1234567), U64(0x7654321)):
        total = np.concatenate((np.zeros(1, U64), np.cumsum(mix(keys ^ salt), dtype=U64)))
        out.append(mix(total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(min-hashes as 32-bit words, sketch as two 64-bit words) of each non-empty set."""
    n = len(first) - 1
    mins = np.zeros((n, len(_A)), np.uint32)
    some = np.flatnonzero(first[1:] > first[:-1])
    if len(some):
        starts = first[:-1][some]
        for j in range(len(_A)):
            mins[some, j] = np.minimum.reduceat(((keys * _A[j] + _B[j]) >> U64(32)).astype(np.uint32), starts)
    bits = np.packbits(mix(mins[:, TREES * DEPTH :].astype(U64)) & U64(1), axis=1).view(U64)
    return mins[:, : TREES * DEPTH], bits


def signed(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, hash (of the text), n, print1, print2, mins (packed) and bits (packed) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(2)):
                keys, first = sets(data, offsets, k)
                p, q = prints(keys, first)
                mins, bits = signatures(keys, first)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(2)), pa.array(np.diff(first)), pa.array(p), pa.array(q), pa.array([x.tobytes() for x in mins], pa.binary()), pa.array([x.tobytes() for x in bits], pa.binary())], names=["id", "hash", "n", "print1", "print2", "mins", "bits"])

    return docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(text).alias("hash"), text).mapInArrow(run, "id bigint, hash bigint, n bigint, print1 bigint, print2 bigint, mins binary, bits binary")


def differing(percent: int) -> int:
    """How many bits of the sketches of two sets of a similarity may differ: one does with probability (1 - s) / 2."""
    p = (1 - percent / 100) / 2
    return int(BITS * p + DEVIATIONS * (BITS * p * (1 - p)) ** 0.5)


def planted(classes: DataFrame) -> DataFrame:
    """tree, prefix, rest (of the order), cls and bits: every class in every tree. classes: cls, mins, bits."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                mins = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, TREES * DEPTH)
                n = len(mins)
                prefix = np.zeros((n, TREES), U64)
                for t in range(TREES):
                    prefix[:, t] = window_hashes(mins[:, t * DEPTH : (t + 1) * DEPTH].astype(U64).reshape(-1), DEPTH, t)[::DEPTH]
                # the order beyond the prefix: the next hashes, a byte each, from the following blocks
                byte = mins.astype(np.uint8)
                rest = [np.roll(byte, -(t + 1) * DEPTH, 1)[:, :8] for t in range(TREES)]
                rest = np.ascontiguousarray(np.stack(rest, 1)).view(">u8").astype(U64)[:, :, 0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(np.arange(TREES, dtype=np.int8), n)),
                        pa.array(prefix.reshape(-1).view(np.int64)),
                        pa.array((rest.reshape(-1) ^ U64(1 << 63)).view(np.int64)),
                        part.column(0).take(pa.array(np.repeat(np.arange(n), TREES))),
                        part.column(2).take(pa.array(np.repeat(np.arange(n), TREES))),
                    ],
                    names=["tree", "prefix", "rest", "cls", "bits"],
                )

    return classes.select("cls", "mins", "bits").mapInArrow(plant, "tree tinyint, prefix bigint, rest bigint, cls bigint, bits binary")


def forest(classes: DataFrame, parts: int, differ: int) -> DataFrame:
    """(a, b, region, tree): for each region's window, edges of its classes to the first one they are connected with.

    For a region that a window or a partition may not hold whole, each such first one is given as well, as a row with
    the region's prefix and tree and without b. Other rows have no tree. Rows with a equal to b are not given.
    """

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the region that isn't complete yet
        start, firsts = True, []
        for batch in batches:
            rows = np.empty(batch.num_rows, _ROW)
            for c in ("tree", "prefix", "cls"):
                rows[c] = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            rows["bits"] = _bits(batch.column(batch.schema.get_field_index("bits")))
            rows = np.concatenate([*held, rows])
            cut = np.flatnonzero((rows["prefix"][1:] != rows["prefix"][:-1]) | (rows["tree"][1:] != rows["tree"][:-1])) + 1
            last = int(cut[-1]) if len(cut) else 0
            yield from _edges(rows[:last], cut[:-1], differ, start, False, firsts)
            start = start and not last
            tail = rows[last:]
            while len(tail) >= 2 * REGION:
                yield from _edges(tail[:REGION], np.zeros(0, int), differ, True, True, firsts)
                tail = tail[REGION - OVERLAP :]
            held = [tail]
            yield from _given(firsts)
        if held:
            yield from _edges(held[0], np.zeros(0, int), differ, True, True, firsts)
            yield from _given(firsts)

    ordered = planted(classes).repartitionByRange(parts, "tree", "prefix", "rest", "cls").sortWithinPartitions("tree", "prefix", "rest", "cls")
    return ordered.mapInArrow(grow, "a bigint, b bigint, region bigint, tree tinyint")


def _bits(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), U64).reshape(-1, 2)


_ROW = np.dtype([("tree", np.int8), ("prefix", np.int64), ("cls", np.int64), ("bits", U64, (2,))])


def _edges(rows: np.ndarray, cut: np.ndarray, differ: int, start: bool = False, stop: bool = False, firsts: list[np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Edges within each region of complete regions' rows. firsts gets the rows that others of a window are connected
    with, for large regions, and for the first or last if it may have rows elsewhere (start, stop)."""
    if not len(rows):
        return
    begin, end = np.concatenate(([0], cut)), np.append(cut, len(rows))
    wide = end - begin > REGION
    wide[0] |= start
    wide[-1] |= stop
    made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    two = begin[(end - begin == 2) & ~wide]
    if len(two):
        x, y = rows[two], rows[two + 1]
        near = np.bitwise_count(x["bits"] ^ y["bits"]).sum(1) <= differ
        made.append((x["cls"][near], y["cls"][near], x["prefix"][near]))
    for s, e, w in zip(begin.tolist(), end.tolist(), wide.tolist(), strict=True):
        if e - s < 3 and not w:
            continue
        for i in range(s, max(s + 1, e - OVERLAP), REGION - OVERLAP):
            part = rows[i : min(i + REGION, e)]
            near = np.bitwise_count(part["bits"][:, None, :] ^ part["bits"][None, :, :]).sum(2) <= differ
            label = np.full(len(part), -1)
            for v in range(len(part)):
                if label[v] >= 0:
                    continue
                reached = front = near[v] & (label < 0)
                while front.any():
                    more = near[front].any(0) & (label < 0) & ~reached
                    reached, front = reached | more, more
                label[reached] = v
            own = label == np.arange(len(part))
            other = np.flatnonzero(~own)
            if len(other):
                made.append((part["cls"][other], part["cls"][label[other]], part["prefix"][other] + i - s))
            if w and firsts is not None:
                firsts.append(part[own])
    if made:
        a, b, region = (np.concatenate(x) for x in zip(*made, strict=True))
        two = a != b
        yield pa.RecordBatch.from_arrays([pa.array(a[two]), pa.array(b[two]), pa.array(region[two]), pa.nulls(int(two.sum()), pa.int8())], names=["a", "b", "region", "tree"])


def _given(firsts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows of forest() for first ones, which are taken off the list."""
    if firsts:
        f = np.concatenate(firsts)
        firsts.clear()
        cls, prefix, tree = (pa.array(np.ascontiguousarray(f[c])) for c in ("cls", "prefix", "tree"))
        yield pa.RecordBatch.from_arrays([cls, pa.nulls(len(f), pa.int64()), prefix, tree], names=["a", "b", "region", "tree"])


def across(classes: DataFrame, near: DataFrame, units: DataFrame, differ: int, scratch: Scratch) -> DataFrame | None:
    """(a, b, region): edges between different units (v, root) within the regions of which forest() gives the first
    ones, a region being a block's. None if all of those are of one unit each."""

    def of(df: DataFrame, cls: str) -> DataFrame:
        return df.join(units, F.col(cls) == F.col("v"), "left").withColumn("unit", F.coalesce("root", cls))

    firsts = near.where("tree is not null").select("tree", F.col("region").alias("prefix"), "a")
    open_ = scratch.put(of(firsts, "a").groupBy("tree", "prefix").agg(F.min("unit").alias("x"), F.max("unit").alias("y")).where("x < y").select("tree", "prefix"), "open")
    if open_.isEmpty():
        return None
    rows = scratch.put(of(planted(classes).join(open_, ["tree", "prefix"]), "cls").select("tree", "prefix", "cls", "bits", "unit"), "wide")
    sizes = rows.groupBy("tree", "prefix", "unit").agg(F.count("*").alias("n"))
    regions = sizes.groupBy("tree", "prefix").agg(F.max_by("unit", F.struct("n", "unit")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    regions = scratch.put(regions.select("tree", "prefix", "main", _parts(F.col("all") - F.col("most"), BLOCK).alias("rests"), _parts(F.col("all"), BLOCK).alias("alls")), "regions")
    both = rows.join(regions, ["tree", "prefix"])
    rest = both.where("unit != main").withColumn("i", _of("cls", F.col("rests"))).withColumn("j", F.explode(F.expr("sequence(0, alls - 1)")))
    every = both.withColumn("j", _of("cls", F.col("alls"))).withColumn("i", F.explode(F.expr("sequence(0, rests - 1)")))
    key = ("tree", "prefix", "i", "j")
    sides = [x.select(*key, "cls", "bits", "unit", F.lit(y).alias("whole")) for x, y in ((rest, False), (every, True))]

    def meet(block: pa.Table) -> pa.Table:
        whole = block.column("whole").to_numpy(zero_copy_only=False).astype(bool)
        bits, cls = _bits(block.column("bits")), block.column("cls").to_numpy()
        _, unit = np.unique(block.column("unit").to_numpy(), return_inverse=True)
        root = np.arange(unit.max(initial=-1) + 1)  # of each unit, by what this block has connected
        here, there = np.flatnonzero(~whole), np.flatnonzero(whole)
        made: list[tuple[int, int]] = []
        for s in range(0, len(here), 64):
            some = here[s : s + 64]
            close = np.bitwise_count(bits[some][:, None, :] ^ bits[there][None, :, :]).sum(2) <= differ
            for x, row in zip(some.tolist(), close, strict=True):
                met = there[row]
                apart = met[root[unit[met]] != root[unit[x]]]
                while len(apart):
                    made.append((int(cls[x]), int(cls[apart[0]])))
                    root[root == root[unit[apart[0]]]] = root[unit[x]]
                    apart = apart[root[unit[apart]] != root[unit[x]]]
        a, b = (np.array([m[c] for m in made], np.int64) for c in (0, 1))
        return pa.table({"a": a, "b": b, "region": np.full(len(a), _number(block), np.int64)})

    return scratch.put(sides[0].union(sides[1]).groupBy(*key).applyInArrow(meet, "a bigint, b bigint, region bigint"), "met")


def _number(block: pa.Table) -> int:
    """A number for a block of a region."""
    key = np.array([block.column(c)[0].as_py() for c in ("tree", "prefix", "i", "j")], np.int64).view(U64)
    return int(window_hashes(key, 4)[:1].view(np.int64)[0])


def gathered(classes: DataFrame, parts: int, differ: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(a, b, region), the edges between classes with sketches near enough, and (v, root), the units they make."""
    near = scratch.put(forest(classes, parts, differ), "near")
    edges = near.where("b is not null").select("a", "b", "region")
    units = scratch.put(components(edges, scratch, "units"), "unit_of")
    more = across(classes, near, units, differ, scratch)
    if more is not None:
        edges = edges.union(more)
        # units that an edge has joined, by their roots; a class without an edge before is one of its own
        of = [units.select(F.col("v").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b")]
        joined = more.join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        over = scratch.put(components(joined, scratch, "over"), "over_of").select(F.col("v").alias("old"), F.col("root").alias("new"))
        before = units.join(over, F.col("root") == F.col("old"), "left").select("v", F.coalesce("new", "root").alias("root"))
        alone = over.join(units, F.col("old") == F.col("v"), "left_anti").select(F.col("old").alias("v"), F.col("new").alias("root"))
        units = scratch.put(before.union(alone), "units_of_all")
    return edges, units


def linked(sets_: list[np.ndarray], percent: int) -> np.ndarray:
    """A label for each set: the first of those it is connected with by links of at least the percentage."""
    m = len(sets_)
    size = np.fromiter(map(len, sets_), np.int64, m)
    values = np.concatenate(sets_) if m else np.zeros(0, U64)
    _, ids = np.unique(values, return_inverse=True)
    owner = np.repeat(np.arange(m), size)
    first = np.concatenate(([0], np.cumsum(size)))
    label, state = np.full(m, -1), {}

    def index(open_: np.ndarray) -> None:  # postings of the sets that no search has reached
        some = open_[owner]
        order = np.argsort(ids[some], kind="stable")
        state["owner"], key = owner[some][order], ids[some][order]
        state["at"] = np.searchsorted(key, np.arange(ids.max(initial=-1) + 2))
        state["open"] = int(open_.sum())

    free = np.ones(m, bool)
    index(free)
    for v in range(m):
        if not free[v]:
            continue
        free[v], label[v], front = False, v, [v]
        while front:
            x = front.pop()
            left = int(free.sum())
            if not left:
                break
            if left < state["open"] // 2:
                index(free)
            mine = ids[first[x] : first[x + 1]]
            a, b = state["at"][mine], state["at"][mine + 1]
            n = b - a
            ends = np.cumsum(n)
            met = state["owner"][np.repeat(a - ends + n, n) + np.arange(ends[-1])] if len(n) and ends[-1] else np.zeros(0, np.int64)
            common = np.bincount(met, minlength=m)
            near = np.flatnonzero(free & (100 * common >= percent * (size + size[x] - common)) & (common > 0))
            free[near], label[near] = False, v
            front += near.tolist()
    return label


def _parts(held: Column, most: int) -> Column:
    return F.ceil(held / most).cast("int")


def _of(key: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key), parts).cast("int")


def _unit(first: str, region: Column, i: Column, j: Column) -> Column:
    return F.struct(F.col(first).alias("first"), region.cast("bigint").alias("region"), i.cast("int").alias("i"), j.cast("int").alias("j")).alias("unit")


def by_region(edges: DataFrame) -> DataFrame:
    """(cls, unit): the stars of edges (a, b, region, weight of a); one of too much weight is cut, its centre in each part."""
    size = edges.groupBy("region", "b").agg(F.sum("weight").alias("held")).withColumn("parts", _parts(F.col("held"), HELD))
    zero = F.lit(0)
    arms = edges.join(size, ["region", "b"]).select(F.col("a").alias("cls"), _unit("b", F.col("region"), _of("a", F.col("parts")), zero))
    centres = size.withColumn("i", F.explode(F.expr("sequence(0, parts - 1)"))).select(F.col("b").alias("cls"), _unit("b", F.col("region"), F.col("i"), zero))
    return arms.union(centres)


def apart(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The edges between different components."""
    of_a = roots.select(F.col("v").alias("a"), F.col("root").alias("root_a"))
    of_b = roots.select(F.col("v").alias("b"), F.col("root").alias("root_b"))
    return edges.join(of_a, "a").join(of_b, "b").where("root_a != root_b").select(*edges.columns)


def remaining(large: DataFrame, roots: DataFrame) -> DataFrame:
    """(cls, unit): pairs of blocks, of a large unit's classes outside of its largest component and of all its classes."""
    at = large.join(roots.select("v", F.col("root").alias("of")), "v", "left").withColumn("of", F.coalesce("of", "v"))
    held = at.groupBy("root", "of").agg(F.sum("weight").alias("held"))
    units = held.groupBy("root").agg(F.max_by("of", F.struct("held", "of")).alias("main"), F.sum("held").alias("all"), F.max("held").alias("most")).where("all > most")
    units = units.withColumn("rests", _parts(F.col("all") - F.col("most"), HELD // 2)).withColumn("alls", _parts(F.col("all"), HELD // 2))
    both = at.join(units, "root")
    rest = both.where("of != main").withColumn("i", _of("v", F.col("rests"))).withColumn("j", F.explode(F.expr("sequence(0, alls - 1)")))
    every = both.withColumn("j", _of("v", F.col("alls"))).withColumn("i", F.explode(F.expr("sequence(0, rests - 1)")))
    named = [x.select(F.col("v").alias("cls"), _unit("root", F.lit(-1), F.col("i"), F.col("j"))) for x in (rest, every)]
    return named[0].union(named[1]).distinct()


def link(docs: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; text_hash is that of its text, and first says whether it
    is the one row that stands for its component: that with the least id, the first of several."""
    spark = docs.sparkSession
    rows = scratch.put(signed(docs, k, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "signed")
    classes = (
        rows.where("n > 0")
        .groupBy("print1", "print2")
        .agg(
            F.min("row").alias("cls"),
            # the row that stands for the class: that with the least id, the first of several
            F.min(F.struct(F.col("id").isNull().alias("without"), "id", "row", "hash")).alias("rep"),
            F.count("*").alias("copies"),
            F.first("n").alias("n"),
            F.first("mins").alias("mins"),
            F.first("bits").alias("bits"),
        )
    )
    classes = scratch.put(classes.withColumns({"least": F.col("rep.id"), "hash": F.col("rep.hash")}), "classes")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    near, units = gathered(classes, parts, differing(percent), scratch)
    weight = F.greatest(F.col("n"), F.lit(HELD // UNIT))
    weighed = units.join(classes.select(F.col("cls").alias("v"), weight.alias("weight")), "v")
    sized = scratch.put(weighed.join(weighed.groupBy("root").agg(F.sum("weight").alias("held")), "root"), "sized")
    members = sized.where(F.col("held") <= HELD).select(F.col("v").alias("cls"), _unit("root", F.lit(0), F.lit(0), F.lit(0)))
    large = sized.where(F.col("held") > HELD).select("v", "root", "weight")
    split = not large.isEmpty()
    # a class's text is that of a row with its least id; fingerprints tell it from others of the same hash
    texts = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(text).alias("of"), F.col(text).alias("text"))
    if not rows.where("n > 0").groupBy("id", "hash").agg(F.count("*").alias("same")).where("same > 1").isEmpty():
        texts = scratch.put(texts.groupBy("id", "of").agg(F.first("text").alias("text")), "texts")  # rows that repeat id and text, once

    def confirm(key: tuple, table: pa.Table) -> pa.Table:
        found: dict[int, np.ndarray] = {}
        cls, p, q = (table.column(c).to_numpy() for c in ("cls", "print1", "print2"))
        for i, j, data, offsets in blocks(table.column("text")):
            keys, first = sets(data, offsets, k)
            r, s = prints(keys, first)
            for x in np.flatnonzero((r == p[i:j]) & (s == q[i:j])).tolist():
                found[int(cls[i + x])] = keys[first[x] : first[x + 1]]
        names = sorted(found)
        label = linked([found[c] for c in names], percent)
        names = np.array(names, np.int64)
        return pa.table({"a": names, "b": names[label] if len(names) else names})

    def confirmed(members: DataFrame, name: str) -> DataFrame:
        """(a, b): every member, and the first of those that it is connected with in its unit."""
        known = members.join(classes.select("cls", "print1", "print2", "least", "hash"), "cls")
        brought = known.join(texts, F.expr("hash = of and least <=> id")).select("unit", "cls", "print1", "print2", "text")
        return scratch.put(brought.groupBy("unit").applyInArrow(confirm, "a bigint, b bigint"), name)

    if split:
        edges = scratch.put(near.join(large.select(F.col("v").alias("a"), "weight"), "a"), "edges")
        # a text goes to one region at first, to others only where its component and theirs are still apart
        one = edges.groupBy("a").agg(F.min(F.struct("region", "b", "weight")).alias("e")).select("a", "e.*")
        links = confirmed(members.union(by_region(one)), "links1")
        for name, more in (("links2", lambda roots: by_region(apart(edges, roots))), ("links3", lambda roots: remaining(large, roots))):
            roots = scratch.put(components(links, scratch, f"of_{name}"), f"before_{name}")
            links = links.union(confirmed(more(roots), name))
        roots = components(links, scratch, "of_all")
    else:
        links = confirmed(members, "links1")
        roots = links.select(F.col("a").alias("v"), F.col("b").alias("root"))
    of = classes.select("cls", "print1", "print2", "rep", "copies").join(roots, F.col("cls") == F.col("v"), "left").withColumn("root", F.coalesce("root", "cls"))
    groups = of.groupBy("root").agg(F.min("rep").alias("chosen"), F.sum("copies").alias("all"))
    known = scratch.put(of.join(groups.where("all > 1"), "root").select("print1", "print2", "chosen"), "known")
    for name in ("near", "unit_of", "open", "wide", "regions", "met", "over_of", "units_of_all", "sized", "edges", "texts", "links1", "links2", "links3"):
        scratch.drop(name)
    done = rows.select("id", "n", "print1", "print2", "row", "hash").join(known, ["print1", "print2"], "left")
    in_group = (F.col("n") > 0) & F.col("chosen").isNotNull()
    own = F.when(in_group, F.col("chosen.id")).otherwise(F.col("id"))
    found = done.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("hash").alias("text_hash"), F.when(in_group, F.col("row") == F.col("chosen.row")).otherwise(True).alias("first"))
    return found.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"), "text_hash", "first")
