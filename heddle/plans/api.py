"""The service's routes as functions over frames; requests are checked as the service checks them."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, fields

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import vector
from heddle.functions.models import Encoder, HashEncoder, OverlapReranker, Reranker, embed_table
from heddle.operators import matching, reranking, retrieval


class NotFound(ValueError):
    """Something that a request names isn't there or can't be used."""


class InvalidRequest(ValueError):
    """A request that doesn't say what it has to."""


@dataclass(frozen=True)
class Settings:
    embed_model: str = "hash"
    rerank_model: str = "overlap"
    device: str = "cpu"
    max_chars: int = 2048
    embed_batch: int = 16
    rerank_batch: int = 16

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """Settings by the session's ``spark.heddle.<name>``, or else the environment's HEDDLE_<NAME>, or else the defaults."""
        found = {}
        for f in fields(cls):
            value = spark.conf.get(f"spark.heddle.{f.name}", None) or os.environ.get(f"HEDDLE_{f.name.upper()}")
            if value:
                found[f.name] = type(f.default)(value)
        return cls(**found)

    @property
    def half_precision(self) -> bool:
        return "cuda" in self.device.strip().lower()


def engine_info(settings: Settings = Settings()) -> dict[str, object]:
    return {"status": "ok", "device": settings.device, "fp16": settings.half_precision, "embed_model": settings.embed_model, "rerank_model": settings.rerank_model, "spark": pyspark.__version__}


def embed(texts: DataFrame, column: str = "text", normalize: bool = True, return_sparse: bool = False, make: Callable[[], Encoder] = HashEncoder, settings: Settings | None = None) -> DataFrame:
    """texts with ``dense`` (at length 1 if asked), ``dim`` and, if asked, ``sparse``. At least one text is needed. Texts
    are capped only where sparse vectors are asked for; else the model gets them whole."""
    s = settings or Settings.of(texts.sparkSession)
    if texts.isEmpty():
        raise InvalidRequest("at least one text is needed")
    out = embed_table(texts, column, make, cap=return_sparse, most=s.max_chars, size=s.embed_batch)
    if normalize:
        out = out.withColumn("dense", vector.l2_normalize("dense"))
    out = out.withColumn("dim", F.size("dense"))
    return out if return_sparse else out.drop("sparse")


def semantic_match(job: object, cv: object, responsibilities: DataFrame, experiences: DataFrame) -> DataFrame:
    """The report for one pair; raises NotFound for a side without chunks, or without any that can be compared."""
    for name, key, chunks in (("job", job, responsibilities), ("cv", cv, experiences)):
        own = chunks.where(F.col("parent") == F.lit(key))
        if own.isEmpty():
            raise NotFound(f"{name} {key} has no chunks")
        if matching.usable(own).isEmpty():
            raise NotFound(f"{name} {key} has no chunks with a vector")
    spark = responsibilities.sparkSession
    kinds = responsibilities.schema["parent"].dataType, experiences.schema["parent"].dataType
    pair = spark.range(1).select(F.lit(job).cast(kinds[0]).alias("job"), F.lit(cv).cast(kinds[1]).alias("cv"))
    return matching.report(pair, responsibilities, experiences)


def find_top_candidates(kind: str, key: object, jobs: DataFrame, cvs: DataFrame, retrieve_top_n: int | None = None, rerank_top_k: int | None = None, top_k: int | None = None, make: Callable[[], Reranker] = OverlapReranker, settings: Settings | None = None) -> DataFrame:
    """The ranked other side of one job or CV, in one row of counts and items (0 and none if nothing passes the floor).

    Raises InvalidRequest for another kind, no key, or a limit outside of 1 to 200; NotFound for a source that is
    missing, lacks a dense vector, or has no problem text.
    """
    if kind not in ("job", "cv"):
        raise InvalidRequest("type must be job or cv")
    if key is None or key == "":
        raise InvalidRequest(f"{kind}_id is needed")
    for x in (retrieve_top_n, rerank_top_k, top_k):
        if x is not None and not 1 <= x <= 200:
            raise InvalidRequest("limits are from 1 to 200")
    n, k = retrieval.limits(retrieve_top_n, rerank_top_k, top_k)
    own, other = (jobs, cvs) if kind == "job" else (cvs, jobs)
    source = own.where(F.col("id") == F.lit(key)).limit(1)
    if retrieval.usable_sources(source).isEmpty():
        raise NotFound(f"{kind} {key} is missing or lacks vectors")
    if source.where(F.coalesce("problem_text", F.lit("")) != "").isEmpty():
        raise NotFound(f"{kind} {key} has no problem text")
    s = settings or Settings.of(own.sparkSession)
    found = retrieval.search(source, other, n)
    ranked = reranking.rerank(found, source, other, k, make, s.max_chars, s.rerank_batch)
    return reranking.results(found, ranked, source)


def hybrid_search(sources: DataFrame, candidates: DataFrame, retrieve_top_n: int | None = None, rerank_top_k: int | None = None, make: Callable[[], Reranker] = OverlapReranker, settings: Settings | None = None) -> DataFrame:
    """The same for all rows of sources at once that can be searched with."""
    n, k = retrieval.limits(retrieve_top_n, rerank_top_k)
    s = settings or Settings.of(sources.sparkSession)
    found = retrieval.search(sources, candidates, n)
    return reranking.results(found, reranking.rerank(found, sources, candidates, k, make, s.max_chars, s.rerank_batch), retrieval.usable_sources(sources))


def explain_skills(df: DataFrame, required: str, owned: str) -> DataFrame:
    """An extension: matched and missing skills (exact strings) and the share that is matched; 1 if none is required."""
    matched, missing = F.array_intersect(required, owned), F.array_except(required, owned)
    need = F.size(F.array_distinct(required))
    return df.withColumns({"matched": matched, "missing": missing, "coverage": F.when(need == 0, 1.0).otherwise(F.size(matched) / need), "critical_gap": F.size(missing) > 0})
