"""Models as plug-ins, run by Arrow batch with one instance a Python worker.

An encoder turns texts into (dense, lexical weights) pairs, a reranker turns (query, text) pairs into scores. The two
classes here need no weights: they are deterministic, so plans and results can be tested, and any object with the
same methods takes their place.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import sparse
from heddle.functions.scalar import MAX_CHARS, cap_text

#: Texts that go to a model at once.
BATCH = 16


class Encoder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> list[tuple[list[float], dict[int, float]]]: ...


class Reranker(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class HashEncoder:
    """Words hashed into dim signed components, and word shares as weights of hashed indices. Words that cancel each
    other out leave the first one's component, so only a text without words has a zero vector."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> list[tuple[list[float], dict[int, float]]]:
        out = []
        for text in texts:
            words = re.findall(r"\w+", text.lower())
            v, weights = [0.0] * self.dim, {}
            for w in words:
                h = zlib.crc32(w.encode())
                v[h % self.dim] += 1.0 if h >> 31 else -1.0
                i = h % sparse.DIMENSION
                weights[i] = weights.get(i, 0.0) + 1.0 / len(words)
            if words and not any(v):
                h = zlib.crc32(words[0].encode())
                v[h % self.dim] = 1.0 if h >> 31 else -1.0
            out.append((v, weights))
        return out


class OverlapReranker:
    """The logistic function of twice the shared distinct words less one."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        words = [(set(filter(None, a.lower().split(" "))), set(filter(None, b.lower().split(" ")))) for a, b in pairs]
        return [1.0 / (1.0 + math.exp(-(2.0 * len(a & b) - 1.0) / 10.0)) for a, b in words]


#: Instances that a worker keeps.
KEPT = 4
_made: dict[bytes, object] = {}


def _instance(key: bytes, make: Callable[[], object]) -> object:
    """One instance a worker of what a factory makes; key is the same for all copies of the factory."""
    if key not in _made:
        while len(_made) >= KEPT:
            del _made[next(iter(_made))]
        _made[key] = make()
    return _made[key]


def _key(make: Callable[[], object]) -> bytes:
    return hashlib.sha256(cloudpickle.dumps(make)).digest()


HYBRID = f"struct<dense:array<float>,sparse:{sparse.TYPE}>"


def embed(text: Column | str, make: Callable[[], Encoder] = HashEncoder, cap: bool = True, most: int = MAX_CHARS, size: int = BATCH) -> Column:
    """A struct of a text's dense and sparse vectors. Texts are capped to ``most`` unless cap is false; null embeds as
    empty; a model gets ``size`` texts at once."""
    key = _key(make)

    @F.pandas_udf("struct<dense:array<float>,tokens:array<int>,weights:array<double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _instance(key, make)
        for texts in batches:
            dense, tokens, weights = [], [], []
            for i in range(0, len(texts), size):
                for v, w in model.encode(texts.iloc[i : i + size].tolist()):
                    dense.append(v)
                    tokens.append(list(w))
                    weights.append(list(w.values()))
            yield pd.DataFrame({"dense": dense, "tokens": tokens, "weights": weights})

    out = run(cap_text(text, most) if cap else F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.struct(out["dense"].alias("dense"), sparse.from_weights(F.map_from_arrays(out["tokens"], out["weights"])).alias("sparse"))


def rerank_score(query: Column | str, text: Column | str, make: Callable[[], Reranker] = OverlapReranker, most: int = MAX_CHARS, size: int = BATCH, cap: bool = True) -> Column:
    """A pair's score; both texts are capped unless cap is false, which is for texts that are already; null is empty."""
    key = _key(make)

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _instance(key, make)
        for queries, texts in batches:
            scores: list[float] = []
            for i in range(0, len(queries), size):
                got = model.score(list(zip(queries.iloc[i : i + size], texts.iloc[i : i + size], strict=True)))
                scores += [float(x) for x in (got if hasattr(got, "__iter__") else [got])]
            yield pd.Series(scores)

    return run(*(cap_text(x, most) if cap else F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in (query, text)))


def embed_table(df: DataFrame, column: str, make: Callable[[], Encoder] = HashEncoder, **how: object) -> DataFrame:
    """df with ``dense`` and ``sparse`` of one text column, the model run once a row; how: as for embed()."""
    return df.withColumn("_e", embed(column, make, **how)).withColumn("dense", F.col("_e.dense")).withColumn("sparse", F.col("_e.sparse")).drop("_e")
