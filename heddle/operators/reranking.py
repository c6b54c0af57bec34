"""The second stage of retrieval: a pair model over the first K retrieved rows of every source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.models import BATCH, OverlapReranker, Reranker, rerank_score
from heddle.functions.scalar import MAX_CHARS, cap_text
from heddle.operators.retrieval import SCORES


def rerank(found: DataFrame, source_texts: DataFrame, candidate_texts: DataFrame, most: int = 20, make: Callable[[], Reranker] = OverlapReranker, max_chars: int = MAX_CHARS, size: int = BATCH) -> DataFrame:
    """source_id, candidate_id, score, position, rank (of retrieval) and the retrieval scores.

    found: rows of a search. The text frames have id and problem_text. The model runs above the cut, so it sees at
    most ``most`` pairs a source; equal scores keep the order of retrieval.
    """
    cut = found.where(F.col("rank") <= most)
    # capped before the joins, so no whole text is shuffled; the source's last, as the ranking goes by source
    texts = cut.join(candidate_texts.select(F.col("id").alias("candidate_id"), cap_text("problem_text", max_chars).alias("text")), "candidate_id", "left")
    texts = texts.join(source_texts.select(F.col("id").alias("source_id"), cap_text("problem_text", max_chars).alias("query")), "source_id", "left")
    scored = texts.withColumn("score", rerank_score("query", "text", make, max_chars, size, cap=False))
    order = Window.partitionBy("source_id").orderBy(F.col("score").desc(), "rank")
    return scored.withColumn("position", F.row_number().over(order).cast("bigint")).select("source_id", "candidate_id", "score", "position", "rank", *SCORES)


def results(found: DataFrame, reranked: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """One row a source: how many rows were retrieved and reranked, and the reranked ones in order with details.

    Sources (a frame with ``id``) of which nothing was found have counts of 0 and no items; without that frame they
    have no row.
    """
    details = F.struct(F.col("score").alias("professional_match_score"), F.col("problem_score").alias("retrieval_problem_score"), F.col("capability_score").alias("retrieval_capability_score"), F.col("final_score").alias("retrieval_final_score"))
    items = reranked.withColumn("item", F.struct("position", F.col("candidate_id").cast("string").alias("id"), "score", details.alias("details")))
    lists = items.groupBy("source_id").agg(F.count("*").alias("total_reranked"), F.transform(F.array_sort(F.collect_list("item")), lambda x: x.dropFields("position")).alias("items"))
    out = found.groupBy("source_id").agg(F.count("*").alias("total_retrieved")).join(lists, "source_id")
    if sources is None:
        return out
    every = sources.select(F.col("id").alias("source_id")).distinct().join(out, "source_id", "left")
    return every.select("source_id", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("total_retrieved", "total_reranked")), F.coalesce("items", F.array().cast(lists.schema["items"].dataType)).alias("items"))
