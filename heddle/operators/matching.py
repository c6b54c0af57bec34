"""Chunk-level semantic match: every chunk of one parent against every chunk of another, for pairs of parents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.scalar import has_text, level_sentence, match_level, percent
from heddle.operators import kernel

#: Scores from which a responsibility counts as well and as partly matched, and the shares of the total.
WELL, PARTLY = 0.75, 0.60
OVERALL, COVERAGE = 0.7, 0.3
TOP = 3


def usable(chunks: DataFrame) -> DataFrame:
    """Chunks with a vector and some text."""
    return chunks.where(F.col("vec").isNotNull() & has_text("content"))


def ordered(chunks: DataFrame) -> DataFrame:
    """Usable chunks with their position within their parent: by idx, then id."""
    order = Window.partitionBy("parent").orderBy("idx", "id")
    return usable(chunks).withColumn("position", F.row_number().over(order).cast("bigint") - 1)


def existing(parents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Parents (a column ``parent``) that have any chunk, even one without a vector."""
    return parents.join(chunks.select("parent"), "parent", "left_semi")


def similarities(pairs: DataFrame, responsibilities: DataFrame, experiences: DataFrame) -> DataFrame:
    """job, cv, resp_id, resp_idx, exp_id, exp_idx, score for all chunks of every pair (job, cv).

    Chunks have id, parent, content, vec and idx. Pairs of which a side has no usable chunk give no rows. A pair's
    chunks meet in one task as two matrices; zero vectors are similar to nothing.
    """
    fresh = [F.col("job").alias("job"), F.col("cv").alias("cv")]  # the sides must not share columns
    left = pairs.join(usable(responsibilities).select(F.col("parent").alias("job"), "id", "idx", "vec"), "job").select(*fresh, "id", "idx", "vec")
    right = pairs.join(usable(experiences).select(F.col("parent").alias("cv"), "id", "idx", "vec"), "cv").select(*fresh, "id", "idx", "vec")
    kinds = {"job": left.schema["job"], "cv": left.schema["cv"], "resp_id": left.schema["id"], "exp_id": right.schema["id"]}
    t = {k: v.dataType.simpleString() for k, v in kinds.items()}
    schema = f"job {t['job']}, cv {t['cv']}, resp_id {t['resp_id']}, resp_idx bigint, exp_id {t['exp_id']}, exp_idx bigint, score double"

    def pair(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        n, m = a.num_rows, b.num_rows
        score = np.zeros((n, m))
        if n and m:
            x, y = kernel.dense(a.column("vec")), kernel.dense(b.column("vec"))
            if x.shape[1] != y.shape[1]:
                raise ValueError("vectors of different lengths")
            score = kernel.normalized(x, 1.0) @ kernel.normalized(y, 1.0).T
        i, j = pa.array(np.repeat(np.arange(n), m)), pa.array(np.tile(np.arange(m), n))
        return pa.table(
            {
                "job": pa.array([key[0].as_py()] * (n * m), key[0].type),
                "cv": pa.array([key[1].as_py()] * (n * m), key[1].type),
                "resp_id": a.column("id").combine_chunks().take(i),
                "resp_idx": a.column("idx").cast(pa.int64()).combine_chunks().take(i),
                "exp_id": b.column("id").combine_chunks().take(j),
                "exp_idx": b.column("idx").cast(pa.int64()).combine_chunks().take(j),
                "score": score.reshape(-1),
            }
        )

    return left.groupBy("job", "cv").cogroup(right.groupBy("job", "cv")).applyInArrow(pair, schema)


def top(scored: DataFrame, k: int = TOP, consistent: bool = False) -> DataFrame:
    """The k best experiences of every responsibility, with place. Of equal scores the last comes first, as an
    ascending order read backwards gives; consistent: the first, as in best()."""
    ties = [F.col("exp_idx"), F.col("exp_id")] if consistent else [F.col("exp_idx").desc(), F.col("exp_id").desc()]
    order = Window.partitionBy("job", "cv", "resp_id").orderBy(F.col("score").desc(), *ties)
    return scored.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= k)


def best(scored: DataFrame) -> DataFrame:
    """The best experience of every responsibility; of equal scores the first."""
    order = Window.partitionBy("job", "cv", "resp_id").orderBy(F.col("score").desc(), "exp_idx", "exp_id")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") == 1).drop("place")


def share(least: float) -> Column:
    return F.coalesce(F.avg(F.when((F.col("score") >= least) & ~F.isnan("score"), 1.0).otherwise(0.0)), F.lit(0.0))


def metrics(bests: DataFrame) -> DataFrame:
    """job, cv, total, overall_score, coverage_score, strong_match_ratio and final_score of rows of best()."""
    overall, coverage = F.coalesce(F.avg("score"), F.lit(0.0)), share(PARTLY)
    return bests.groupBy("job", "cv").agg(
        F.count("*").alias("total"),
        overall.alias("overall_score"),
        coverage.alias("coverage_score"),
        share(WELL).alias("strong_match_ratio"),
        (OVERALL * overall + COVERAGE * coverage).alias("final_score"),
    )


def category(score: Column | str = "score") -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(F.isnan(s), "unmatched").when(s >= WELL, "well").when(s >= PARTLY, "partial").otherwise("unmatched")


def categories(bests: DataFrame) -> DataFrame:
    """job, cv, how many responsibilities are well, partly and not matched, and their ids in order."""
    kind = category()

    def ids(of: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(kind == of, F.struct("resp_idx", "resp_id")))), lambda x: x["resp_id"])

    return bests.groupBy("job", "cv").agg(
        F.count("*").alias("total"),
        *(F.count_if(kind == of).alias(f"{of}_count") for of in ("well", "partial", "unmatched")),
        *(ids(of).alias(f"{of}_ids") for of in ("well", "partial", "unmatched")),
    )


def report(pairs: DataFrame, responsibilities: DataFrame, experiences: DataFrame, consistent: bool = False) -> DataFrame:
    """One row for every pair with all that a match says: metrics with percents, each responsibility's best and top
    matches with texts, levels and sentences, the three categories, and counts."""
    scored = similarities(pairs, responsibilities, experiences)
    texts_r = usable(responsibilities).select(F.col("parent").alias("job"), F.col("id").alias("resp_id"), F.col("content").alias("resp_content"))
    texts_e = usable(experiences).select(F.col("parent").alias("cv"), F.col("id").alias("exp_id"), F.col("content").alias("exp_content"))
    tops = top(scored, TOP, consistent).join(texts_e, ["cv", "exp_id"])
    level = match_level("score")
    item = F.struct("place", F.col("exp_id").alias("chunk_id"), F.col("exp_content").alias("content"), "score", percent("score").alias("score_percent"), level.alias("match_level"))
    tops = tops.withColumn("item", item).groupBy("job", "cv", "resp_id").agg(F.transform(F.array_sort(F.collect_list("item")), lambda x: x.dropFields("place")).alias("top_3_matches"))
    bests = best(scored).join(texts_r, ["job", "resp_id"]).join(texts_e, ["cv", "exp_id"]).withColumn("percent", percent("score")).withColumn("level", level).withColumn("category", category())
    one = F.struct(
        "resp_idx",
        F.col("resp_id").alias("responsibility_chunk_id"),
        F.col("resp_content").alias("responsibility_content"),
        F.struct(F.col("exp_id").alias("experience_chunk_id"), F.col("exp_content").alias("experience_content"), "score", F.col("percent").alias("score_percent"), F.col("level").alias("match_level"), level_sentence("level").alias("explanation")).alias("best_match"),
        "top_3_matches",
        "category",
    )
    whole = bests.join(tops, ["job", "cv", "resp_id"]).withColumn("one", one)
    rows = whole.groupBy("job", "cv").agg(F.array_sort(F.collect_list("one"), lambda x, y: F.when(x["resp_idx"] < y["resp_idx"], -1).when(x["resp_idx"] > y["resp_idx"], 1).when(x["responsibility_chunk_id"] < y["responsibility_chunk_id"], -1).otherwise(1)).alias("matches"))
    counts = scored.groupBy("job", "cv").agg(F.count_distinct("exp_id").alias("total_experiences"))
    out = metrics(best(scored)).join(rows, ["job", "cv"]).join(counts, ["job", "cv"])

    def of(kind: str) -> Column:
        return F.transform(
            F.filter("matches", lambda m: m["category"] == kind),
            lambda m: F.struct(
                m["responsibility_chunk_id"].alias("responsibility_chunk_id"),
                m["responsibility_content"].alias("responsibility_content"),
                m["best_match"]["experience_chunk_id"].alias("best_experience_chunk_id"),
                m["best_match"]["experience_content"].alias("best_experience_content"),
                m["best_match"]["score"].alias("best_score"),
                m["best_match"]["match_level"].alias("match_level"),
            ),
        )

    names = {"well": "well_matched_responsibilities", "partial": "partially_matched_responsibilities", "unmatched": "unmatched_responsibilities"}
    for kind, name in names.items():
        out = out.withColumn(name, of(kind))
    for c in ("overall_score", "coverage_score", "strong_match_ratio", "final_score"):
        out = out.withColumn(c.removesuffix("_score") + "_percent", percent(c))
    return out.withColumns({f"{kind}_count": F.size(name) for kind, name in names.items()}).withColumn("responsibility_matches", F.transform("matches", lambda m: m.dropFields("resp_idx", "category"))).drop("matches")
