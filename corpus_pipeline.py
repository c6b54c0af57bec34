"""The corpus pipeline: documents through quality rules, near-duplicates, repeated substrings, mixing and encoding.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written and reread as the next stage's docs.
All but the last return the columns of ``documents``. What a stage decides takes effect: documents that the rules
reject are gone and lines that many documents of a source repeat are cut out, one document of each near-duplicate group
stays, later copies of passages are cut out of the texts, a source's documents are repeated or left out and put in order
by the mix, and the last stage encodes what is left.

Texts that a stage leaves without words are dropped by the substring stage. ``n_chars`` follows the text. The mix
takes a document once for each whole time that its words were taken, and once more for a rest of at least half.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import bpe, mixing, neardup, quality, substrings
from heddle.llm.queries import VOCABULARY
from heddle.llm.scratch import Scratch
from heddle.session import attach, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a window that is cut out where an earlier document has it.
WINDOW = 40
#: Bytes of text in a part of the mixed documents, at most about; a small table has four parts for each core.
PART = 64 << 20
#: Bytes of text that a worker encodes at once; it then gives memory back, as later stages use the same workers.
ENCODED = 1 << 20

_open: list[Scratch] = []


def _begin(spark: SparkSession, stage: str) -> Scratch:
    """A stage's intermediate tables. Those of the stage before go: its result is written when the next begins."""
    while _open:
        _open.pop().remove()
    _open.append(Scratch(attach(spark), f"pipeline-{stage}"))
    return _open[-1]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the line frequencies reject, without the lines above the limits."""
    rated = quality.assess(docs, _begin(spark, "quality"), ["doc_id", "lang", "source", "n_chars"])
    size = F.when(F.col("removed_words") > 0, F.char_length("kept_text").cast("bigint")).otherwise(F.col("n_chars"))
    return rated.where("kept").select("doc_id", F.col("kept_text").alias("text"), "lang", "source", size.alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity of at least 0.8: the one with the smallest id. Rows
    of equal id and text are one document; a group without ids keeps one of its rows."""
    found = neardup.link(docs.select("doc_id", "text"), _begin(spark, "neardup"), 5, 80)
    kept = found.where("first").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("of")).distinct()
    hashed = docs.select(*COLUMNS, F.xxhash64("text").alias("hash"))
    left = hashed.join(kept, F.expr("hash = of and doc_id <=> id"), "left_semi")
    one = F.min(F.struct("source", "lang", "n_chars", "text")).alias("one")  # combined before its shuffle
    return left.groupBy("doc_id", "hash").agg(one).select("doc_id", "one.*").select(*COLUMNS)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of WINDOW words that a document with a smaller id has; a document of which nothing is
    left goes, and one that has no words stays as it is."""
    _begin(spark, "substrings")
    cut = substrings.remove(docs, WINDOW, keep=("text", "lang", "source"), spacing=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    left = cut.where("n_words > n_removed or n_words = 0").select("doc_id", text.alias("text"), "lang", "source")
    return left.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of the schedule's slots."""
    scratch = _begin(spark, "mix")
    sized = docs.select(*COLUMNS, mixing.sizes().alias("size"))
    keyed = scratch.put(sized.withColumn("key", F.monotonically_increasing_id()), "docs")
    mixed = mixing.mix(keyed.select("key", "doc_id", "source", "size"), ["doc_id"], scratch)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.greatest("size", F.lit(1)))).otherwise(0).cast("int")
    # a copy stands where the slots take the document's first block, or else where they first take words of it
    each = mixed.withColumn("times", times).where("times > 0").select("key", "slots", "first_slot", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy"))
    placed = each.select("key", F.coalesce(F.get("slots", F.col("copy")), "first_slot").alias("slot"), "copy")
    parts = max(4 * spark.sparkContext.defaultParallelism, -(-keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // PART))
    return keyed.join(placed, "key").repartitionByRange(parts, "slot", "key", "copy").sortWithinPartitions("slot", "key", "copy").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the packed ids of every document, with a digest of what they decode to."""
    _begin(spark, "encode")
    coded = bpe.round_trip(docs.select("doc_id", "source", "text"), VOCABULARY, public_tokenizers.PATTERN, lean=ENCODED)
    return coded.select("doc_id", "source", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("mixed_sources", mixed_sources),
    ("encoded", encoded),
]

#: MinHash links and byte-pair merges can't be written as SQL; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written before the next begins."""
    scratch = Scratch(attach(spark), "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
