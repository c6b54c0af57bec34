"""Mixing sources to target weights with a low-discrepancy schedule; DataFrame operations only.

Each source's documents are shuffled by a hash of their keys and laid end to end on a line of tokens (words),
which is cut into blocks of equal length. Slot t of the schedule has the golden-ratio point t * PHI modulo 2^32; the
cumulative weights say in which source's interval it falls, so sources alternate as evenly as the weights let
them. A slot's rank within its source is the block it takes, going round again where a source is repeated. The
last slot of a source takes what is missing from its target, so the words taken are the target, rounded. The slots are
the order of the mix: a document's first_slot is the first one that takes words of it, and ``slots`` are those that take
its block whole.

A source's weight in the schedule is the number of slots it needs. The largest gap between n golden-ratio
points is below 1.9 / n, so three times as many points as slots give every source enough of them. Points and weights
are integers, so every engine gives the same.

Scale: the line of tokens comes from sums by hash bucket within a source and then within a bucket, so a source
with a third of all rows is spread over BUCKETS tasks. Rows of equal keys and size have one place on the line, which
they take one after another, numbered within each of the table's partitions; so a third of all rows without an id are
one row of a bucket. The schedule has some SLOTS rows at any input size; targets are one row a source, in one task.

Edge cases: null and empty texts, and those of white space, have size 0 and nothing taken; a null source is a
source, the last; a very long text spans as many blocks as it needs; ties of a hash are ordered by keys and size;
repeated rows are documents of their own; further columns are passed on, whatever their names but for those of the
result, which give way; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.scratch import Scratch

#: Weights by a source's place in code-point order, repeated.
WEIGHTS = (5, 2, 1)
#: The most of a source's size that may be taken.
REPEATS = 3
#: Slots of the schedule, about.
SLOTS = 1 << 16
#: Bits of the hash by which documents are shuffled, and those that name a bucket.
BITS, BUCKET_BITS = 60, 12
#: Bits of a point, and those of the cells in which points meet the intervals of weights.
POINT_BITS, CELL_BITS = 32, 10
#: The golden ratio's fraction of 2^32.
PHI = 2654435769
WORD = r"[^\x20\x09-\x0D]+"


def sizes(text: str = "text") -> Column:
    """The number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(documents: DataFrame) -> DataFrame:
    """source, source_size, target of rows (source, size): weights by rank, no target above REPEATS times the size.

    Capped sources are those with the least size for their weight: in that order, the first prefix whose rest,
    shared by weight, caps no more is the answer. One row a source is all that meets in one task.
    """
    total = documents.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    ranked = total.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (F.col("k") % len(WEIGHTS)).cast("int") + 1)
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(REPEATS))
    order = Window.orderBy(F.col("most") / F.col("weight"), "k")
    everything = Window.partitionBy()
    shares = (
        ranked.withColumn("capped", F.sum("most").over(order))
        .withColumn("free", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
        .withColumn("all", F.sum("source_size").over(everything))
        .withColumn("capped_before", F.col("capped") - F.col("most"))
        .withColumn("free_before", F.col("free") + F.col("weight"))
        .withColumn("level", (F.col("all") - F.col("capped_before")) / F.col("free_before"))
    )
    # the level at the first source, in order, that it doesn't cap, holds for all; without one, all are capped
    found = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("k"), F.col("level")))).over(everything)
    level = found["level"]
    target = F.when(level.isNull(), F.col("most")).otherwise(F.least(F.col("most"), level * F.col("weight")))
    return shares.select("source", "source_size", "k", target.alias("target"))


def schedule(goals: DataFrame) -> DataFrame:
    """The slots: source key k, rank, block, and the words that a slot takes of its block.

    goals: rows of targets() with ``tokens``, the words of a block.
    """
    size, want = F.col("source_size"), F.col("want")
    need = (
        goals.withColumn("want", F.least(F.round("target"), size * REPEATS).cast("bigint"))
        .where("want > 0")
        .withColumn("blocks", F.expr("cast((source_size + tokens - 1) div tokens as bigint)"))
        .withColumn("slots", F.expr("(want div source_size) * blocks + ((want % source_size) + tokens - 1) div tokens"))
    )
    everything = Window.partitionBy()
    part = (
        need.withColumn("all", F.sum("slots").over(everything))
        .withColumn("sum", F.sum("slots").over(Window.orderBy("k")))
        .withColumn("to", F.expr(f"(sum << {POINT_BITS}) div all"))
        .withColumn("from", F.expr(f"((sum - slots) << {POINT_BITS}) div all"))
    )
    width = POINT_BITS - CELL_BITS
    cells = part.withColumn("cell", F.explode(F.expr(f"sequence(from >> {width}, (to - 1) >> {width})")))
    points = goals.agg(F.count("*").alias("n")).select(F.explode(F.sequence(F.lit(0).cast("bigint"), 3 * (SLOTS + 2 * REPEATS * (F.col("n") + 1)))).alias("t"))
    points = points.withColumn("u", F.expr(f"(t * {PHI}) & {(1 << POINT_BITS) - 1}")).withColumn("cell", F.expr(f"u >> {width}"))
    drawn = points.join(cells, "cell").where("u >= from and u < to")
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("t")) - 1).where("rank < slots")
    return (
        ranked.withColumn("block", F.expr("cast(rank % blocks as bigint)"))
        .withColumn("length", F.expr("least(tokens, source_size - block * tokens)"))
        .withColumn("before", F.expr("(rank div blocks) * source_size + block * tokens"))
        .withColumn("takes", F.greatest(F.lit(0), F.least(F.col("length"), want - F.col("before"))))
        .select("k", "t", "rank", "block", "length", "takes")
    )


def shuffled(keys: list[str]) -> Column:
    """A hash of BITS bits of a row's keys."""
    text = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("bigint")


def line(documents: DataFrame) -> DataFrame:
    """row and at of documents (row, k, hash, key, size): where each starts on its source's line of tokens."""
    bucket = F.expr(f"hash >> {BITS - BUCKET_BITS}")
    places = documents.groupBy("k", bucket.alias("bucket"), "hash", "key", "size").agg((F.count("*") * F.col("size")).alias("words"))
    parts = places.groupBy("k", "bucket").agg(F.sum("words").alias("part"))
    parts = parts.withColumn("skip", F.sum("part").over(Window.partitionBy("k").orderBy("bucket")) - F.col("part")).drop("part")
    own = Window.partitionBy("k", "bucket").orderBy("hash", "key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = places.withColumn("own", F.sum("words").over(own) - F.col("words")).join(parts, ["k", "bucket"]).select("k", "hash", "key", "size", (F.col("skip") + F.col("own")).alias("start"))
    # equal rows stand one after another: by the table's partition, then within it
    same = ["k", "hash", "key", "size"]
    piece = F.expr("row >> 33")
    numbered = documents.withColumn("piece", piece).withColumn("number", F.row_number().over(Window.partitionBy(*same, "piece").orderBy("row")) - 1)
    counts = documents.groupBy(*same, piece.alias("piece")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("ahead", F.sum("n").over(Window.partitionBy(*same).orderBy("piece")) - F.col("n"))

    def equal(x: str, y: str, names: list[str]) -> Column:
        return F.expr(" and ".join(f"{x}.{c} <=> {y}.{c}" for c in names))

    placed = counts.alias("c").join(starts.alias("s"), equal("c", "s", same)).select("c.*", "start")
    met = numbered.alias("d").join(placed.alias("p"), equal("d", "p", [*same, "piece"]))
    return met.select("d.row", (F.col("start") + (F.col("ahead") + F.col("number")) * F.col("d.size")).alias("at"))


def mix(documents: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """documents (source, size, and others, of which keys name a row) with source_size, target, taken, first_slot and
    slots."""
    made = ("source_size", "target", "taken", "first_slot", "slots")
    others = [c for c in documents.columns if c not in made]
    held = F.struct(*(F.col(f"`{c}`") for c in others)).alias("own")
    names = F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys))).alias("key")
    rows = scratch.put(documents.select(F.monotonically_increasing_id().alias("row"), held, "source", F.col("size").cast("bigint").alias("size"), names, shuffled(keys).alias("hash")), "sizes")
    goals = targets(rows.select("source", "size"))
    tokens = F.greatest(F.lit(1), F.ceil(F.sum("source_size").over(Window.partitionBy()) / SLOTS)).cast("bigint")
    goals = scratch.put(goals.withColumn("tokens", tokens), "goals")
    full = F.col("takes") == F.col("length")
    taken = (
        schedule(goals)
        .groupBy("k", "block")
        .agg(
            F.array_sort(F.collect_list(F.when(full, F.col("t")))).alias("slots"),
            F.max(F.when(~full, F.col("takes")).otherwise(0)).alias("rest"),
            F.max(F.when(~full, F.col("t"))).alias("last"),
        )
    )
    known = rows.join(goals.withColumnRenamed("source", "of"), F.expr("source <=> of")).drop("of")
    known = scratch.put(known.select("row", "own", "k", "hash", "key", "size", "source_size", "target", "tokens"), "known")
    at = line(known.select("row", "k", "hash", "key", "size").where("size > 0"))
    placed = known.where("size > 0").select("row", "k", "size", "tokens").join(at, "row")
    spans = placed.withColumn("block", F.explode(F.expr("sequence(at div tokens, (at + size - 1) div tokens)")))
    block_at = F.col("block") * F.col("tokens")
    begin, end = F.greatest(F.col("at"), block_at), F.least(F.col("at") + F.col("size"), block_at + F.col("tokens"))
    partial = F.greatest(F.lit(0), F.least(end, block_at + F.col("rest")) - begin)
    met = spans.join(taken, ["k", "block"]).withColumn("part", F.size("slots") * (end - begin) + partial).where("part > 0")
    first = F.coalesce(F.get("slots", F.lit(0)), F.col("last"))
    sums = met.groupBy("row").agg(F.sum("part").alias("taken"), F.min(first).alias("first_slot"), F.min_by("slots", "block").alias("slots"))
    done = known.select("row", "own", "source_size", "target").join(sums, "row", "left")
    return done.select("own.*", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "first_slot", F.coalesce("slots", F.expr("cast(array() as array<bigint>)")).alias("slots"))
