"""Removal of word windows that an earlier document has, by recompression.

A document's words are compressed in rounds. A round first names every maximal run of one symbol, then every pair
of a left and a right symbol (a symbol's side is a bit of its name); a name is a hash of what it stands for, so it
is the same in every document and on every executor, and naming is global without a dictionary or a shuffle for each
round. Two equal stretches of words hold the same symbols inside, whatever stands around them; only at their ends may
a run or a pair reach beyond.

*Revealing.* Each symbol of round ``rounds(window)`` carries its context, the words on which it depends. A window takes
the least of the symbols whose context it holds, with AROUND more words on either side, as its anchor. Equal windows
have equal anchors, so windows are compared only where their anchor stands in two documents. A window that holds no
symbol's context (long runs, mostly) is its own anchor.

*Verifying.* A window is compressed to the end, round by round: what may reach beyond its ends (the run at either end,
then a right symbol at the left end and a left symbol at the right one) is popped, and what is left are the symbols
inside, which all windows of these words share. The popped names, of all rounds, are the window's own form: equal
windows have the same, and different ones differ, as the words can be spelt out from it. It is kept as 128 bits.

Plan: texts are dealt once into chunks of some CHUNK bytes by a hash of id, text and place in the table; that exchange
is reused by the three passes over the chunks, so the table must give its rows in a stable order, as files do.
1. Each chunk sends its distinct anchors to buckets by name. A bucket answers with one bit for an anchor: whether
   another chunk or document has it too.
2. Each chunk sends the forms of the windows of such anchors, each with its smallest id there, again to buckets, which
   answer with one bit: whether a smaller id elsewhere has the window.
3. Each chunk marks and removes words.
A window that a third of all documents share is sent once a chunk, and nothing is ever paired with anything. Only
hashes and bits go between chunks and buckets. A lost executor costs its shuffle files, which Spark makes again.

Edge cases: a null or empty text has no words; texts of fewer words than a window lose nothing; a null id counts
as larger than all others, so such a row removes nothing elsewhere but loses what rows with ids have; rows with
one id are judged each against smaller ids, repeated rows alike; a very long text is a chunk of its own, whose arrays
are some 60 bytes a word; columns of the table that aren't asked for are left out, and may have any name; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.llm.textkit import SPACE, U64, Words, blocks, mix, run_hashes, window_hashes

#: Bytes of text in a chunk, and hashes in a bucket, about.
CHUNK, BUCKET = 4 << 20, 1 << 20
#: Words added to a symbol's context on either side, to make an anchor rarer.
AROUND = 2
_MUL, _MUL2 = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
_NONE = np.iinfo(np.int64).max


def rounds(window: int) -> int:
    """Rounds after which a symbol and its context still fit into a window."""
    return max(1, int(np.log2(max(window, 1) / 6.0))) if window > 6 else 1


def compress(name: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Round k of the symbols of consecutive documents: where each run begins, the runs' names, whether a run joins the
    next one, and whether it is a right symbol."""
    salt = U64((2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    again = (doc[1:] == doc[:-1]) & (name[1:] == name[:-1])
    first = np.flatnonzero(np.concatenate((np.ones(min(len(name), 1), bool), ~again)))
    run = name[first]
    if len(first) < len(name):
        size = np.diff(np.append(first, len(name)))
        many = size > 1
        run[many] = mix(run[many] * U64(_MUL) + size[many].astype(U64) + salt)
    side = (mix(run + salt) >> U64(63)).astype(bool)
    joins = np.zeros(len(run), bool)
    joins[:-1] = ~side[:-1] & side[1:] & (doc[first[1:]] == doc[first[:-1]])
    return first, run, joins, side


def paired(run: np.ndarray, joins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The names of the next round's symbols, and at which run each begins."""
    salt = U64((2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    new = run.copy()
    at = np.flatnonzero(joins)
    new[at] = mix(run[at] * U64(_MUL) + run[at + 1] + salt + U64(1))
    begins = np.ones(len(run), bool)
    begins[at + 1] = False
    at = np.flatnonzero(begins)
    return new[at], at


def forms(h: np.ndarray, doc: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the form of each window of words that begins at ``at``: the names popped at its ends, round by round."""
    one, two = np.full(len(at), U64(window)), np.full(len(at), U64(window + 1))
    live = np.arange(len(at))  # windows of which something is left: symbols i to before j of the round
    i, j, name, k = at, at + window, h, 0

    def pop(which: np.ndarray, what: np.ndarray) -> None:
        one[which] = mix(one[which] * U64(_MUL) + what)
        two[which] = mix((two[which] ^ what) * U64(_MUL2))

    while len(live):
        first, run, joins, side = compress(name, doc, k)
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(name))))
        a, b = of[i], of[j - 1]
        same = a == b
        ends = np.append(first, len(name))
        # the runs at either end, as far as the window has them; their round and side tell popped names apart
        left = np.minimum(ends[a + 1], j) - i
        pop(live, mix(name[i] + left.astype(U64) * U64(4 * k + 1)))
        right = j - first[b]
        rest = np.flatnonzero(~same)
        pop(live[rest], mix(name[j[rest] - 1] + right[rest].astype(U64) * U64(4 * k + 2)))
        live, i, j = live[rest], a[rest] + 1, b[rest]
        # a right symbol first and a left symbol last may belong to what was popped
        some = i < j
        live, i, j = live[some], i[some], j[some]
        begins = side[i]
        pop(live[begins], mix(run[i[begins]] + U64(4 * k + 3)))
        i = i + begins
        some = i < j
        live, i, j = live[some], i[some], j[some]
        closes = ~side[j - 1]
        pop(live[closes], mix(run[j[closes] - 1] + U64(4 * k + 4)))
        j = j - closes
        some = i < j
        live, i, j = live[some], i[some], j[some]
        doc = doc[first]
        name, begin = paired(run, joins, k)
        doc = doc[begin]
        place = np.zeros(len(run) + 1, np.int64)
        place[begin] = 1
        place = np.cumsum(place) - 1
        i, j = place[i], np.where(j < len(run), place[np.minimum(j, len(run) - 1)], len(name))
        k += 1
    return one, two


def recompress(h: np.ndarray, doc: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, from, to) of the symbols after some rounds; from and to bound the context, and lie outside of the
    document where it depends on the document's ends."""
    name, lo, hi = h, np.arange(len(h)), np.arange(len(h))

    def beside(lo: np.ndarray, hi: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From where each symbol's left neighbour depends on words, and up to where its right one does."""
        same = doc[1:] == doc[:-1]
        return np.concatenate((lo[:1] - 1, np.where(same, lo[:-1], lo[1:] - 1))), np.concatenate((np.where(same, hi[1:], hi[:-1] + 1), hi[-1:] + 1))

    for k in range(times):
        first, run, joins, side = compress(name, doc, k)
        # a run depends on the neighbours that end it
        left, right = beside(lo, hi, doc)
        lo, hi, doc = left[first], right[np.append(first[1:], len(name)) - 1], doc[first]
        # one that is left alone depends on the neighbour it could have joined
        before, after = beside(lo, hi, doc)
        lo, hi = np.where(~joins & side, before, lo), np.where(joins | ~side, after, hi)
        name, begin = paired(run, joins, k)
        lo, hi, doc = lo[begin], hi[begin], doc[begin]
    return name, lo, hi


def _least_inside(lo: np.ndarray, hi: np.ndarray, key: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The least key of the symbols (in order of lo) within each window, and whether there is one."""
    most = int(max(lo[-1], hi.max(), at[-1] + window)) + 1 if len(lo) and len(at) else 0
    begin = np.concatenate(([0], np.cumsum(np.bincount(lo, minlength=most))))[at] if most else np.zeros(len(at), np.int64)
    best = np.full(len(at), U64(0xFFFFFFFFFFFFFFFF))
    found = np.zeros(len(at), bool)
    if not most:
        return best, found
    if not np.any(hi[1:] < hi[:-1]):  # a window's symbols are a range: the least of two spans of a power of two
        size = np.concatenate(([0], np.cumsum(np.bincount(hi, minlength=most))))[at + window] - begin
        found = size > 0
        span, k = key, 1
        while True:
            here = np.flatnonzero((size >= k) & (size < 2 * k))
            i = begin[here]
            best[here] = np.minimum(span[i], span[i + size[here] - k])
            if not np.any(size >= 2 * k):
                return best, found
            span = np.minimum(span[:-k], span[k:])
            k *= 2
    for j in range(window):  # rare runs; what doesn't fit a window is passed over
        i = begin + j
        live = i < len(lo)
        i = np.minimum(i, len(lo) - 1)
        live &= lo[i] < at + window
        if not live.any():
            break
        live &= hi[i] < at + window
        np.minimum(best, key[i], out=best, where=live)
        found |= live
    return best, found


class Windows:
    """The windows of a chunk's documents: ``at`` (their first words), ``anchor`` and ``doc``."""

    def __init__(self, words: Words, ids: np.ndarray, window: int):
        self.h, docs = words.hashes(), words.docs()
        self.at = np.flatnonzero(words.left() >= window)
        self.doc = ids[docs[self.at]]
        self.window = window
        if not len(self.at):
            self.anchor = np.zeros(0, U64)
            return
        self.docs = docs
        name, lo, hi = recompress(self.h, docs, rounds(window))
        lo, hi = lo - AROUND, hi + AROUND
        inside = (lo >= 0) & (hi < len(self.h))
        inside[inside] &= docs[lo[inside]] == docs[hi[inside]]
        inside &= hi - lo < window
        lo, hi = lo[inside], hi[inside]
        order = np.argsort(lo, kind="stable") if np.any(np.diff(lo) < 0) else slice(None)
        lo, hi = lo[order], hi[order]
        key = mix(run_hashes(self.h, lo, hi + 1) ^ name[inside][order])
        best, found = _least_inside(lo, hi, key, self.at, window)
        alone = ~found
        if alone.any():
            best[alone] = mix(window_hashes(self.h, window, 3)[self.at[alone]])
        self.anchor = best & ~U64(1)

    def forms(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The forms of some windows."""
        at = self.at[which]
        return forms(self.h, self.docs, at, self.window) if len(at) else (np.zeros(0, U64), np.zeros(0, U64))


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of distinct sorted keys by bucket, and (bucket, from, to) in it."""
    bucket = ((keys >> U64(1)) % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=buckets)
    ends = np.cumsum(size)
    return order, [(b, int(ends[b] - size[b]), int(ends[b])) for b in np.flatnonzero(size).tolist()]


def _least(keys: np.ndarray, more: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (key, more) in order, the least doc of each, whether it has several docs, and which of them each row has."""
    order = np.lexsort((docs, more, keys)) if more is not keys else np.lexsort((docs, keys))
    ordered, rest, of = keys[order], more[order], docs[order]
    head = np.ones(len(order), bool)
    head[1:] = (ordered[1:] != ordered[:-1]) | (rest[1:] != rest[:-1])
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(order))[: len(first)] - 1
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(head) - 1
    return ordered[first], rest[first], of[first], of[first] != of[last], at


class Chunk:
    """A chunk's texts and windows, made anew in each pass."""

    def __init__(self, table: pa.Table, window: int):
        ids = table.column("id").combine_chunks()
        self.ids = ids.fill_null(_NONE).to_numpy(zero_copy_only=False)
        self.parts = []
        for i, j, data, offsets in blocks(table.column("text")):
            words = Words(data, offsets, SPACE)
            self.parts.append((i, j, data, words, Windows(words, self.ids[i:j], window)))
        self.anchors = np.concatenate([w.anchor for *_, w in self.parts] or [np.zeros(0, U64)])
        self.docs = np.concatenate([w.doc for *_, w in self.parts] or [np.zeros(0, np.int64)])

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, and whether several documents here have them."""
        change = np.ones(len(self.anchors), bool)
        change[1:] = (self.anchors[1:] != self.anchors[:-1]) | (self.docs[1:] != self.docs[:-1])
        anchors = self.anchors[change]
        keys, _, _, several, _ = _least(anchors, anchors, self.docs[change])
        return keys, several

    def shared(self, masks: dict[int, bytes], buckets: int) -> np.ndarray:
        """Which windows have an anchor that stands elsewhere too."""
        keys, _ = self.names()
        marked = _marked(keys, masks, buckets)
        return marked[np.searchsorted(keys, self.anchors)] if len(keys) else np.zeros(0, bool)

    def forms(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The forms of some of the chunk's windows."""
        out, at = [(np.zeros(0, U64), np.zeros(0, U64))], 0
        for *_, w in self.parts:
            out.append(w.forms(shared[at : at + len(w.at)]))
            at += len(w.at)
        one, two = zip(*out, strict=True)
        return np.concatenate(one), np.concatenate(two)


def _marked(keys: np.ndarray, masks: dict[int, bytes], buckets: int) -> np.ndarray:
    order, spans = _by_bucket(keys, buckets)
    marked = np.zeros(len(keys), bool)
    for b, i, j in spans:
        if b in masks:
            marked[order[i:j]] = np.unpackbits(np.frombuffer(masks[b], np.uint8), count=j - i).astype(bool)
    return marked


_SENT = "bucket int, chunk int, keys binary, more binary, docs binary"
_MASK = "chunk int, step int, bucket int, mask binary"


def _sent(chunk: int, keys: np.ndarray, buckets: int, more: np.ndarray | None = None, docs: np.ndarray | None = None, flags: np.ndarray | None = None) -> pa.Table:
    order, spans = _by_bucket(keys, buckets)
    keys = keys if flags is None else keys | flags.astype(U64)

    def cut(values: np.ndarray | None) -> pa.Array:
        values = None if values is None else values[order]
        return pa.array([None if values is None else values[i:j].tobytes() for _, i, j in spans], pa.binary())

    return pa.table({"bucket": pa.array([b for b, _, _ in spans], pa.int32()), "chunk": pa.array([chunk] * len(spans), pa.int32()), "keys": cut(keys), "more": cut(more), "docs": cut(docs)})


def _answers(table: pa.Table, step: int) -> pa.Table:
    """For each chunk that sent something, a bit for each key: whether it stands elsewhere (step 1), or does so in a
    smaller document (step 2)."""

    def all_of(column: str, kind: type = U64) -> list[np.ndarray]:
        return [np.frombuffer(x.as_buffer(), kind) for c in table.column(column).chunks for x in c]

    sent = all_of("keys")
    sizes = [len(x) for x in sent]
    raw = np.concatenate(sent)
    if step == 1:
        keys = raw & ~U64(1)
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        group = np.cumsum(np.concatenate(([True], ordered[1:] != ordered[:-1]))) - 1
        yes = np.zeros(len(keys), bool)
        yes[order] = ((np.bincount(group) > 1) | (np.bincount(group, (raw & U64(1))[order].astype(float)) > 0))[group]
    else:
        docs = np.concatenate(all_of("docs", np.int64))
        _, _, least, _, at = _least(raw, np.concatenate(all_of("more")), docs)
        yes = least[at] < docs
    ends = np.cumsum(sizes)
    return pa.table(
        {
            "chunk": table.column("chunk"),
            "step": pa.array([step] * len(sizes), pa.int32()),
            "bucket": table.column("bucket"),
            "mask": pa.array([np.packbits(yes[e - s : e]).tobytes() for s, e in zip(sizes, ends, strict=True)], pa.binary()),
        }
    )


def _masks(table: pa.Table, step: int) -> dict[int, bytes]:
    return {b: m for s, b, m in zip(table.column("step").to_pylist(), table.column("bucket").to_pylist(), table.column("mask").to_pylist(), strict=True) if s == step}


def dealt(docs: DataFrame, chunks: int, doc_id: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    """chunk, id, text and own (the columns to keep) of every row."""
    place = F.monotonically_increasing_id()
    return docs.select(F.pmod(F.xxhash64(doc_id, text, place), F.lit(chunks)).cast("int").alias("chunk"), F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"), F.struct(doc_id, *keep).alias("own"))


def remove(docs: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), spacing: bool = False) -> DataFrame:
    """doc_id, the columns in ``keep``, n_words, n_removed and kept_text of every row: the kept words joined by one
    space, or each with the white space that follows it in the text (spacing)."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    chunks = max(1, -(-total // CHUNK))
    buckets = max(1, -(-total // (16 * BUCKET)))
    parts = dealt(docs, chunks, doc_id, text, keep)
    by_chunk = parts.groupBy("chunk")

    def first(key: tuple, table: pa.Table) -> pa.Table:
        keys, several = Chunk(table, window).names()
        return _sent(key[0].as_py(), keys, buckets, flags=several)

    def second(key: tuple, table: pa.Table, masks: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _sent(0, np.zeros(0, U64), buckets)
        chunk = Chunk(table, window)
        shared = chunk.shared(_masks(masks, 1), buckets)
        keys, more, least, _, _ = _least(*chunk.forms(shared), chunk.docs[shared])
        return _sent(key[0].as_py(), keys, buckets, more, least)

    schema = T.StructType([T.StructField("own", parts.schema["own"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def third(key: tuple, table: pa.Table, masks: pa.Table) -> pa.Table:
        chunk = Chunk(table, window)
        shared = chunk.shared(_masks(masks, 1), buckets)
        owners = chunk.docs[shared]
        keys, _, least, _, at = _least(*chunk.forms(shared), owners)
        earlier = _marked(keys, _masks(masks, 2), buckets)
        gone = np.zeros(len(shared), bool)
        gone[shared] = earlier[at] | (least[at] < owners)
        n, removed, kept, begin = [], [], [], 0
        for _, _, data, words, w in chunk.parts:
            edge = np.zeros(len(words) + window + 1, np.int32)
            starts = w.at[gone[begin : begin + len(w.at)]]
            begin += len(w.at)
            edge[starts] += 1
            edge[starts + window] -= 1
            off = np.cumsum(edge[: len(words)]) > 0
            n.append(words.counts())
            lost = np.concatenate(([0], np.cumsum(off)))
            removed.append(lost[words.first[1:]] - lost[words.first[:-1]])
            kept += _texts(data, words, ~off, spacing)
        return pa.table({"own": table.column("own"), "n_words": np.concatenate(n), "n_removed": np.concatenate(removed), "kept_text": pa.array(kept, pa.string())})

    answers = by_chunk.applyInArrow(first, _SENT).groupBy("bucket").applyInArrow(lambda t: _answers(t, 1), _MASK)
    more = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(second, _SENT).groupBy("bucket").applyInArrow(lambda t: _answers(t, 2), _MASK)
    done = by_chunk.cogroup(answers.unionByName(more).groupBy("chunk")).applyInArrow(third, schema)
    return done.select("own.*", "n_words", "n_removed", "kept_text")


def _texts(data: np.ndarray, words: Words, kept: np.ndarray, spacing: bool) -> list[str]:
    """Each document's kept words, with what follows them or joined by one space."""
    first = np.concatenate(([0], np.cumsum(kept)))[words.first]
    until = words.end
    if spacing:  # up to the next word of the document, or to its end
        until = np.append(words.start[1:], len(data))
        tails = words.first[1:][words.counts() > 0] - 1
        until[tails] = words.offsets[1:][words.counts() > 0]
    start, end = words.start[kept], until[kept]
    size = end - start + (not spacing)
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    at = np.repeat(start - (ends - size), size) + np.arange(len(out))
    body = np.ones(len(out), bool)
    if not spacing:
        body[ends - 1] = False
    out[body] = data[at[body]]
    whole = out.tobytes()
    cut = np.concatenate(([0], ends))
    return [whole[cut[a] : max(cut[b] - (not spacing), cut[a])].decode().rstrip(" \t\n\v\f\r") if spacing else whole[cut[a] : max(cut[b] - 1, cut[a])].decode() for a, b in zip(first[:-1], first[1:], strict=True)]
