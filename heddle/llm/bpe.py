"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut into pre-tokens by the vocabulary's pattern. A pre-token starts as one symbol a byte, in a linked
list. Each adjacent pair whose joined bytes are in the vocabulary waits in the bucket of its rank; a bitmap of
three levels of 64-bit words says which buckets hold something, so find-first-set gives the lowest rank without
a search. An entry whose pair has meanwhile changed is stale and skipped. A merge touches two neighbours, which
makes a pre-token of n bytes cost n queue steps however long it is. A long pre-token has a queue of its own; the
short ones that a block of texts newly needs share one queue, whose buckets are NumPy arrays, so a step merges a
rank's leftmost pair of each of them at once.

Edge cases: a null text is an empty text, and has no ids; ids that the vocabulary lacks can't be decoded and
raise; rows are independent, so repeated rows, empty tables and extra columns (kept as they are, unless one
has the name of a result, which it then gives up) need nothing special.
"""

from __future__ import annotations

import base64
import heapq
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from heddle.llm.textkit import blocks, release

#: Bytes, about, of each generation of a worker's two caches; memory is bounded by four times that.
CACHED = 8 << 20
#: Longer pre-tokens and chunks (characters) aren't kept, and have a queue of their own.
CACHED_CHARS = 48
#: Bytes of text whose new pre-tokens share a queue, and bytes of pre-tokens in it at most.
SHARED, QUEUED = 4 << 20, 1 << 20
#: Characters of a longer text, and ids, that are worked on at once.
SEGMENT = 1 << 18
#: A fixed value: the pattern (that of the byte-level vocabularies) for which texts may be cut at single spaces first.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: lines of base64 bytes and a rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


class Codec:
    """A vocabulary with its pattern; encodes texts to packed ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.spaced = pattern == SPACED
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        self.known = np.zeros(size, bool)
        for token, rank in ranks.items():
            tokens[rank] = token
            self.known[rank] = True
        self.lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = [ranks.get(bytes([i]), -1) for i in range(256)]
        #: The rank of two joined symbols, by the left one's rank << 24 | the right one's.
        self.joined = {ranks[t[:i]] << 24 | ranks[t[i:]]: rank for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.left_right = np.fromiter(sorted(self.joined), np.int64, len(self.joined))
        self.joined_rank = np.fromiter(map(self.joined.__getitem__, self.left_right.tolist()), np.int32, len(self.joined))
        self.byte_rank = np.array(self.single, np.int32)
        # The queue's bitmap: which ranks have a bucket, which words of that have a bit, and which words of those.
        self.low, self.mid = [0] * ((size >> 6) + 1), [0] * ((size >> 12) + 1)
        self.known_pieces, self.known_chunks = _Known(), _Known()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        joined, low, mid, top = self.joined.get, self.low, self.mid, 0
        n = len(piece)
        symbols = [self.single[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair: list[int | None] = [None] * n
        buckets: dict[int, list[int]] = {}
        fresh = [(i, joined(symbols[i] << 24 | symbols[i + 1])) for i in range(n - 1)]
        while True:
            for i, rank in fresh:  # into the bucket of its rank, which the bitmap then shows
                pair[i] = rank
                if rank is None:
                    continue
                if rank in buckets:
                    heapq.heappush(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    low[rank >> 6] |= 1 << (rank & 63)
                    mid[rank >> 12] |= 1 << (rank >> 6 & 63)
                    top |= 1 << (rank >> 12)
            if not top:
                break
            w = (top & -top).bit_length() - 1  # find first set, level by level
            w = w << 6 | (mid[w] & -mid[w]).bit_length() - 1
            rank = w << 6 | (low[w] & -low[w]).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heapq.heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[w] ^= 1 << (rank & 63)
                if not low[w]:
                    mid[w >> 6] ^= 1 << (w & 63)
                    if not mid[w >> 6]:
                        top ^= 1 << (w >> 6)
            fresh = ()
            if pair[i] != rank:  # stale: a neighbour's merge has changed or taken this pair
                continue
            j = after[i]
            symbols[i] = rank
            symbols[j] = pair[j] = None
            k = after[i] = after[j]
            pair[i] = None
            if k < n:
                before[k] = i
                fresh = ((i, joined(rank << 24 | symbols[k])),)
            if (h := before[i]) >= 0:
                fresh = (*fresh, (h, joined(symbols[h] << 24 | rank)))
        return [s for s in symbols if s is not None]

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of joined symbols, -1 where the vocabulary hasn't got them."""
        if not len(self.left_right):
            return np.full(len(left), -1, np.int32)
        key = left.astype(np.int64) << 24 | right
        at = np.minimum(np.searchsorted(self.left_right, key), len(self.left_right) - 1)
        return np.where(self.left_right[at] == key, self.joined_rank[at], np.int32(-1))

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many short pre-tokens, merged through one queue."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        symbol = self.byte_rank[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces), dtype=np.int32), n)
        last = np.zeros(total, bool)
        last[ends - 1] = True
        first = np.zeros(total, bool)
        first[ends - n] = True
        after, before = np.arange(1, total + 1, dtype=np.int32), np.arange(-1, total - 1, dtype=np.int32)
        pair = np.full(total, -1, np.int32)
        at = np.flatnonzero(~last)
        pair[at] = self._ranks_of(symbol[at], symbol[at + 1])
        buckets: dict[int, list[np.ndarray]] = {}
        low, mid, top = self.low, self.mid, 0
        fresh = at
        while True:
            fresh = fresh[pair[fresh] >= 0]
            if len(fresh):
                ranks = pair[fresh]
                order = np.argsort(ranks, kind="stable")
                fresh, ranks = fresh[order], ranks[order]
                cuts = np.flatnonzero(np.diff(ranks)) + 1
                for rank, entries in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(fresh, cuts) if len(cuts) else [fresh], strict=True):
                    if rank in buckets:
                        buckets[rank].append(entries)
                    else:
                        buckets[rank] = [entries]
                        low[rank >> 6] |= 1 << (rank & 63)
                        mid[rank >> 12] |= 1 << (rank >> 6 & 63)
                        top |= 1 << (rank >> 12)
            if not top:
                break
            w = (top & -top).bit_length() - 1
            w = w << 6 | (mid[w] & -mid[w]).bit_length() - 1
            rank = w << 6 | (low[w] & -low[w]).bit_length() - 1
            found = buckets.pop(rank)
            i = found[0] if len(found) == 1 else np.concatenate(found)
            i = np.unique(i[pair[i] == rank])  # the others are stale
            leftmost = np.ones(len(i), bool)
            leftmost[1:] = owner[i[1:]] != owner[i[:-1]]
            rest, i = i[~leftmost], i[leftmost]
            if len(rest):
                buckets[rank] = [rest]
            else:
                low[w] ^= 1 << (rank & 63)
                if not low[w]:
                    mid[w >> 6] ^= 1 << (w & 63)
                    if not mid[w >> 6]:
                        top ^= 1 << (w >> 6)
            j = after[i]
            symbol[i] = rank
            symbol[j] = pair[j] = -1
            after[i] = after[j]
            last[i] = last[j]
            pair[i] = -1
            more = i[~last[i]]
            k = after[more]
            before[k] = more
            pair[more] = self._ranks_of(symbol[more], symbol[k])
            back = i[~first[i]]
            h = before[back]
            pair[h] = self._ranks_of(symbol[h], symbol[back])
            fresh = np.concatenate((more, h))
        kept = symbol >= 0
        packed = symbol[kept].astype("<u4").tobytes()
        cut = (np.cumsum(np.bincount(owner[kept], minlength=len(pieces))) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *cut], cut)]

    def _packed(self, pieces: Counter[str]) -> dict[str, bytes]:
        """The packed ids of pre-tokens; those seen more than once are kept for later blocks."""
        found = self.known_pieces.of(pieces)
        new = [p for p in pieces if p not in found]
        short = [p for p in new if len(p) <= CACHED_CHARS]
        size = i = 0
        for j, piece in enumerate(short, 1):
            size += len(piece)
            if size >= QUEUED or j == len(short):
                found.update(zip(short[i:j], self.merge_all([p.encode() for p in short[i:j]]), strict=True))
                size, i = 0, j
        for p in new:
            if len(p) > CACHED_CHARS:
                found[p] = np.array(self.merge(p.encode()), "<u4").tobytes()
            elif pieces[p] > 1:
                self.known_pieces.put(p, found[p])
        return found

    def _block(self, texts: list[str]) -> list[bytes]:
        """Ids of some texts, each distinct chunk and pre-token of which is encoded once."""
        if not self.spaced:
            cut = [self.pieces(t) for t in texts]
            found = self._packed(Counter(p for pieces in cut for p in pieces))
            return [b"".join(map(found.__getitem__, pieces)) for pieces in cut]
        # No match of the pattern crosses a single space between two characters that aren't white space, so the
        # chunks between such spaces are encoded by themselves; any other text is matched as a whole.
        chunks: Counter[str] = Counter()
        for text in texts:
            chunks.update(text.split(" ")[1:])
        odd = {c for c in chunks if not c or c[0].isspace() or c[-1].isspace()}
        cut = []  # the pre-tokens of whole texts, or those in front of the first chunk
        whole = []
        for text in texts:
            head, *rest = text.split(" ")
            whole.append(bool(head) and head[-1].isspace() or not odd.isdisjoint(rest))
            cut.append(self.pieces(text if whole[-1] else head))
        done = self.known_chunks.of(chunks)
        new = {c: self.pieces(" " + c) for c in chunks if c not in done and c not in odd}
        pieces = Counter(p for c in (cut, new.values()) for own in c for p in own)
        found = self._packed(pieces)
        for chunk, own in new.items():
            done[chunk] = b"".join([found[p] for p in own])
            if chunks[chunk] > 1 and len(chunk) <= CACHED_CHARS:
                self.known_chunks.put(chunk, done[chunk])
        out = []
        for text, own, all_of_it in zip(texts, cut, whole, strict=True):
            front = map(found.__getitem__, own)
            out.append(b"".join(front if all_of_it else [*front, *map(done.__getitem__, text.split(" ")[1:])]))
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts, as encode() gives them, for a block of texts that is held at once."""
        texts = [t or "" for t in texts]
        return [self.encode(t) for t in texts] if any(len(t) > SEGMENT for t in texts) else self._block(texts)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; a long one is cut at single spaces if it can be."""
        out, at = [], 0
        while self.spaced and len(text) - at > SEGMENT:
            to = text.find(" ", at + SEGMENT)
            while to >= 0 and (text[to - 1].isspace() or text[to + 1 : to + 2].isspace() or to + 1 == len(text)):
                to = text.find(" ", to + 1)
            if to < 0:
                break
            out += self._block([text[at:to]])
            at = to
        return b"".join([*out, *self._block([text[at:]])])

    def decode(self, ids: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        if len(ids) > 4 * SEGMENT:
            return b"".join(self.decode(ids[i : i + 4 * SEGMENT]) for i in range(0, len(ids), 4 * SEGMENT))
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        if len(at) and (at.max() >= len(self.known) or not self.known[at].all()):
            raise ValueError("an id isn't in the vocabulary")
        n = self.lengths[at]
        ends = np.cumsum(n)
        return self.bytes[np.repeat(self.starts[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


class _Known(dict):
    """Packed ids by text: a young generation and the one before it, each of CACHED bytes, about."""

    old: dict[str, bytes] = {}
    held = 0

    def of(self, keys: Iterable[str]) -> dict[str, bytes]:
        """Those of some keys that are known; what only the old generation has becomes young again."""
        found = {k: self[k] for k in keys if k in self}
        for k in keys:
            if k in self.old and k not in found:
                found[k] = self.old[k]
        for k, v in found.items():
            if k not in self:
                self.put(k, v)
        return found

    def put(self, key: str, value: bytes) -> None:
        size = 2 * len(key) + len(value) + 180
        if self.held + size > CACHED:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self.held += size
        self[key] = value


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file; one per worker and vocabulary."""
    if (path, pattern) not in _codecs:
        _codecs.clear()
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def _mapped(df: DataFrame, makes: dict[str, T.DataType], f: Callable[[pa.RecordBatch], Iterator[tuple[int, int, dict[str, pa.Array]]]]) -> DataFrame:
    """df with columns that f makes of slices of its batches."""
    own = [c for c in df.columns if c not in makes]
    schema = T.StructType([*(df.schema[c] for c in own), *(T.StructField(c, t) for c, t in makes.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, made in f(batch):
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).slice(i, j - i) for c in own), *(made[c] for c in makes)], names=[*own, *makes])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``: the text's ids, packed as little-endian unsigned 32-bit integers."""

    def run(batch: pa.RecordBatch):
        c = codec(path, pattern)
        texts = batch.column(batch.schema.get_field_index(text))
        for i, j, _, _ in blocks(texts, SHARED):
            yield i, j, {out: pa.array(c.encode_all(texts.slice(i, j - i).to_pylist()), pa.binary())}

    return _mapped(df, {out: T.BinaryType()}, run)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the bytes that packed ids stand for (null: none)."""

    def run(batch: pa.RecordBatch):
        c = codec(path, pattern)
        packed = batch.column(batch.schema.get_field_index(ids))
        for i, j, _, _ in blocks(packed):
            yield i, j, {out: pa.array([c.decode(x or b"") for x in packed.slice(i, j - i).to_pylist()], pa.binary())}

    return _mapped(df, {out: T.BinaryType()}, run)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", lean: int = 0) -> DataFrame:
    """``encode`` and ``decode`` in one pass over the rows, for uses that want both columns.

    lean: bytes of text that are worked on at once, after which a worker gives back the memory that it has freed (0:
    SHARED, and a worker keeps that). The results are the same.
    """

    def run(batch: pa.RecordBatch):
        c = codec(path, pattern)
        texts = batch.column(batch.schema.get_field_index(text))
        for i, j, _, _ in blocks(texts, lean or SHARED):
            packed = c.encode_all(texts.slice(i, j - i).to_pylist())
            yield i, j, {ids: pa.array(packed, pa.binary()), decoded: pa.array(map(c.decode, packed), pa.binary())}
            if lean:
                del packed
                release()

    return _mapped(df, {ids: T.BinaryType(), decoded: T.BinaryType()}, run)
