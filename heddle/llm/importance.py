"""Importance resampling: documents like a target, by the ratio of two hashed n-gram models.

Words and pairs of words (lower-cased A-Z) are hashed into BUCKETS; the target's model and that of all texts are the
shares of the buckets, smoothed. A document's weight is the mean log ratio of its n-grams, times SCALE; the
resampled part are the documents with the largest weight plus Gumbel noise, which draws without replacement in
proportion to exp(weight). The noise is a hash of the id and a seed, so reruns agree.

The target is a bounded sample of labelled documents: the SAMPLE first good ones by a hash of their id. The model of
all texts and the weights cover every document.

Scale: the models are two arrays of BUCKETS counts, summed on executors. The largest keys are found by counting keys
in bins of fixed width; only the one bin where the number is reached is ordered, in ranges of some RANGE rows, which
rows of one key and id are spread over as well.

Edge cases: a null text, or one without words, has no n-grams and weight 0 before noise; all rows without an id have
the same noise, as have rows that repeat an id, so those of equal text have equal keys; ties are ordered by id, and
of rows of one key and id as many are drawn as are wanted; a very long text counts whole; further columns are left out, whatever their names; without a target all weights are 0; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.scratch import Scratch
from heddle.llm.textkit import LOWER, Words, blocks, window_hashes

BUCKETS = 1 << 14
#: Good labelled documents that make the target's model, at most.
SAMPLE = 20_000
#: What the mean log ratio is multiplied by: the number of n-grams that a weight stands for.
SCALE = 200.0
#: The share of all documents that is drawn.
SHARE = 0.8
#: Keys are binned to 1 / FINE, between -LIMIT and LIMIT.
FINE, LIMIT = 64, 4096
#: Rows of the bin at the cut that are ordered in one task.
RANGE = 1 << 20


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, owners) of all words and pairs of consecutive documents."""
    words = Words(LOWER[data], offsets)
    h, docs = words.hashes(), words.docs()
    two = words.left() >= 2
    keys = np.concatenate((h, window_hashes(h, 2)[two]))
    return (keys >> np.uint64(64 - 14)).astype(np.int64), np.concatenate((docs, docs[two]))


def counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the buckets in the target (rows whose ``target`` is true) and in all rows' ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            chosen = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in blocks(batch.column(0)):
                b, owner = grams(data, offsets)
                total[0] += np.bincount(b[chosen[i:j][owner]], minlength=BUCKETS)
                total[1] += np.bincount(b, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total[0]), pa.array(total[1])], names=["bucket", "target", "raw"])

    made = docs.select("text", "target").mapInArrow(run, "bucket bigint, target bigint, raw bigint")
    out = np.zeros((2, BUCKETS))
    for r in made.groupBy("bucket").agg(F.sum("target").alias("t"), F.sum("raw").alias("r")).collect():  # BUCKETS rows
        out[:, r["bucket"]] = r["t"], r["r"]
    return out[0], out[1]


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The log of the two smoothed models' ratio; 0 everywhere without a target."""
    if not target.sum():
        return np.zeros(BUCKETS)
    smooth = 1.0 + raw / max(raw.sum(), 1.0) * BUCKETS  # towards all texts, so what the sample lacks says little
    p = (target + smooth) / (target + smooth).sum()
    q = (raw + 1.0) / (raw + 1.0).sum()
    return np.log(p / q)


def weights(docs: DataFrame, ratio: np.ndarray, keys: list[str]) -> DataFrame:
    """keys and ``weight`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(len(keys))):
                b, owner = grams(data, offsets)
                n = np.bincount(owner, minlength=j - i)
                w = np.bincount(owner, ratio[b], minlength=j - i) / np.maximum(n, 1) * SCALE
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(keys))), pa.array(w)], names=[*keys, "weight"])

    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys)
    return docs.select(*keys, "text").mapInArrow(run, f"{own}, weight double")


def resample(docs: DataFrame, good: DataFrame, scratch: Scratch, share: float = SHARE, seed: int = 1) -> DataFrame:
    """doc_id, weight, key and kept of every row (doc_id, text). good: the ids (doc_id) of the target's documents."""
    sample = good.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = scratch.put(sample.withColumn("target", F.lit(True)), "sample")
    marked = docs.join(F.broadcast(sample), "doc_id", "left")  # at most SAMPLE ids
    ratio = log_ratio(*counts(marked))
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    keyed = weights(docs, ratio, ["doc_id"]).withColumn("key", F.col("weight") - F.log(-F.log(uniform)))
    clipped = F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("key")))
    keyed = scratch.put(keyed.select("*", F.floor(clipped * FINE).alias("bin"), F.monotonically_increasing_id().alias("row")), "keyed")
    wanted = round(keyed.count() * share)
    bins = keyed.groupBy("bin").agg(F.count("*").alias("n"))
    above = bins.withColumn("above", F.sum("n").over(Window.orderBy(F.col("bin").desc())) - F.col("n"))  # 2 * LIMIT * FINE bins
    cut = above.where(F.col("above") < wanted).orderBy("bin").limit(1).collect()  # one row
    if not cut:
        return keyed.select("doc_id", "weight", "key", F.lit(False).alias("kept"))
    at, before, inside = cut[0]["bin"], cut[0]["above"], cut[0]["n"]
    order = [F.col("key").desc(), F.col("doc_id"), F.col("row")]
    ranges = keyed.where(F.col("bin") == at).repartitionByRange(-(-inside // RANGE), *order).withColumn("range", F.spark_partition_id())
    ranges = scratch.put(ranges, "ranges")
    sizes = ranges.groupBy("range").agg(F.count("*").alias("size"))
    starts = sizes.select("range", (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("start"))  # a row a range
    placed = ranges.join(starts, "range").withColumn("place", F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy(*order)))
    some = placed.select("doc_id", "weight", "key", (F.col("place") <= wanted - before).alias("kept"))
    return some.union(keyed.where(F.col("bin") != at).select("doc_id", "weight", "key", (F.col("bin") > at).alias("kept")))
