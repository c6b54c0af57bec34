"""Quality rules: per-document counts, and lines that many documents of a host repeat.

A pass over the texts counts words, symbols and repetitions and hashes normalised lines (ASCII capitals as small
letters, white space and its amount ignored). A line is above the limit on a host if the distinct documents that
hold it number at least ``LINE_DOCS`` and ``LINE_SHARE`` of the host's distinct documents. A second pass
removes such lines; a document of which less than ``KEPT_SHARE`` of its words is left is depleted and rejected.

Copies aren't boilerplate: documents are distinct if their words in order are (ASCII capitals as small letters, white
space ignored), by a 64-bit hash. So a passage spread by copying one document a thousand times is left to
deduplication, while a line standing in different documents is seen. Near copies are different documents.

Scale: what leaves the first pass is a few numbers and line hashes a document. Counting pre-aggregates by (host, line,
digest) before its shuffle. A line above the limit stands in 1 % of the host's documents, so a host has at most 100
times as many such lines as its documents have on average; its list is joined to the documents for the second pass.
Spark broadcasts the lists if they are small and splits large hosts if not.

Edge cases: a null text has no words and is rejected by the base rules like any under 20 words; a null host is a
host; rows are independent otherwise, so repeated ids are kept apart; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.scratch import Scratch
from heddle.llm.textkit import LOWER, U64, Words, blocks, mix, range_hashes, run_hashes, window_hashes

#: A document has at least so many words.
MIN_WORDS = 20
#: Words of a window, and the share of words (percent) that repeated windows may cover.
WINDOW, REPEAT_PERCENT = 8, 30
#: Documents, and share of a host's documents, from which a line is above the limit.
LINE_DOCS, LINE_SHARE = 20, 0.01
#: A document keeps at least this share of its words.
KEPT_SHARE = 0.2

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ODD = U64(0x9E3779B97F4A7C15)
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def covered(keys: np.ndarray, fits: np.ndarray, k: int) -> np.ndarray:
    """Which positions lie in a window (at a position that fits) whose key another such window has."""
    at = np.flatnonzero(fits)
    order = np.argsort(keys[at], kind="stable")
    ordered = keys[at][order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(keys) + k + 1, np.int64)
    starts = at[order[twice]]
    edge[starts] += 1
    np.subtract.at(edge, starts + k, 1)
    return np.cumsum(edge[: len(keys)]) > 0


def measure_block(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray | list[np.ndarray]]:
    """The counts of each document, its digest, its distinct lines' hashes, and all its lines that have words."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    docs = words.docs()
    out: dict = {"n_words": words.counts()}
    edge = np.zeros(len(data) + 1, np.int8)
    edge[words.start] += 1
    edge[words.end] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    out["word_chars"] = _sums(inside & ((data & 0xC0) != 0x80), offsets)
    out["n_symbols"] = _sums(_SYMBOL[data], offsets)
    h = words.hashes()
    keys = mix(window_hashes(h, WINDOW) ^ (docs.astype(U64) * _ODD))
    out["n_repeat_words"] = _sums(covered(keys, words.left() >= WINDOW, WINDOW), words.first)
    # lines: from a document's start or a line's end to the next one
    feeds = np.flatnonzero(data == 10)
    line_doc = np.concatenate((np.arange(n), np.searchsorted(offsets, feeds, "right") - 1))
    start = np.concatenate((offsets[:-1], feeds + 1))
    order = np.lexsort((start, line_doc))
    start, line_doc = start[order], line_doc[order]
    number = np.arange(len(line_doc)) - np.searchsorted(line_doc, line_doc)
    end = np.minimum(np.append(feeds, len(data))[np.searchsorted(feeds, start)], offsets[line_doc + 1])
    first, last = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    full = last > first
    start, end, first, last, line_doc, number = start[full], end[full], first[full], last[full], line_doc[full], number[full]
    exact = mix(range_hashes(data, start, end) ^ (line_doc.astype(U64) * _ODD))
    _, once = np.unique(exact, return_index=True)
    out["n_dup_lines"] = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[once], minlength=n)
    small = Words(LOWER[data], offsets).hashes() if len(words) else h
    normal = run_hashes(small, first, last)
    # a line that a document repeats is one line
    _, once = np.unique(mix(normal ^ (line_doc.astype(U64) * _ODD)), return_index=True)
    order = np.lexsort((once, line_doc[once]))
    out["lines"] = normal[once][order].view(np.int64)
    out["line_offsets"] = np.searchsorted(line_doc[once][order], np.arange(n + 1)).astype(np.int32)
    out["line_doc"], out["line_number"], out["line_hash"], out["line_words"] = line_doc, number, normal, last - first
    out["digest"] = run_hashes(small, words.first[:-1], words.first[1:]).view(np.int64)
    return out


def measure(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys with the counts, digest and lines of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(len(keys))):
                m = measure_block(data, offsets)
                lines = pa.ListArray.from_arrays(pa.array(m["line_offsets"]), pa.array(m["lines"]))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(keys))), *(pa.array(m[c], pa.int64()) for c in [*MEASURES, "digest"]), lines], names=[*keys, *MEASURES, "digest", "lines"])

    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys)
    made = ", ".join(f"{c} bigint" for c in [*MEASURES, "digest"])
    return docs.select(*keys, text).mapInArrow(run, f"{own}, {made}, lines array<bigint>")


def _without(texts: pa.Array, doc: np.ndarray, number: np.ndarray) -> pa.Array:
    """Texts without the lines of these numbers."""
    if not len(doc):
        return texts
    out = texts.cast(pa.binary()).to_pylist()
    edges = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        gone = set(number[a:b].tolist())
        out[doc[a]] = b"\n".join(x for k, x in enumerate(out[doc[a]].split(b"\n")) if k not in gone)
    return pa.array(out, pa.binary()).view(pa.string())


def judge(docs: DataFrame, above: DataFrame, keys: list[str], host: str = "source", text: str = "text") -> DataFrame:
    """keys with the counts, ``removed_words`` and ``kept_text`` of every row; above has (_host, _above), the hashes of
    each host's lines above the limit."""
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks(batch.column(k)):
                m = measure_block(data, offsets)
                lists = batch.column(k + 1).slice(i, j - i)
                of = np.repeat(np.arange(j - i), np.asarray(lists.value_lengths().fill_null(0)))
                bad = mix(np.asarray(lists.flatten(), np.int64).view(U64) ^ (of.astype(U64) * _ODD))
                doc = m["line_doc"]
                hit = np.isin(mix(m["line_hash"] ^ (doc.astype(U64) * _ODD)), bad)
                removed = np.bincount(doc[hit], m["line_words"][hit], j - i).astype(np.int64)
                kept = _without(batch.column(k).slice(i, j - i), doc[hit], m["line_number"][hit])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(k)), *(pa.array(m[c], pa.int64()) for c in MEASURES), pa.array(removed), kept], names=[*keys, *MEASURES, "removed_words", "kept_text"])

    own = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys)
    made = ", ".join(f"{c} bigint" for c in [*MEASURES, "removed_words"])
    joined = docs.select(*keys, F.col(text).alias("_text"), F.col(host).alias("_of")).join(above, F.expr("_of <=> _host"), "left")
    return joined.select(*keys, "_text", "_above").mapInArrow(run, f"{own}, {made}, kept_text string")


def assess(docs: DataFrame, scratch: Scratch, keys: list[str], host: str = "source", text: str = "text") -> DataFrame:
    """keys, host, the counts, ``removed_words``, ``kept_text`` (without the lines above the limit), ``base_failed`` and
    ``kept`` of every row."""
    keys = [*keys, *([] if host in keys else [host])]
    measured = scratch.put(measure(docs, [host], text).select(F.col(host).alias("host"), "digest", "lines"), "measured")
    hosts = measured.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    lines = measured.select("host", "digest", F.explode("lines").alias("line")).distinct()
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= LINE_DOCS)
    above = counts.alias("c").join(hosts.alias("h"), F.expr("c.host <=> h.host")).where(F.col("n") >= F.col("docs") * LINE_SHARE).select(F.col("c.host").alias("_host"), "line")
    above = scratch.put(above.groupBy("_host").agg(F.collect_list("line").alias("_above")), "above")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return judge(docs, above, keys, host, text).withColumn("base_failed", base).withColumn("kept", ~base & (left >= F.col("n_words") * KEPT_SHARE))
