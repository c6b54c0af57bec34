"""Collections derived from the driver's tables, on which the queries run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import sparse
from heddle.session import table

#: Weights of a vector against its neighbour in the experience chunks, by id modulo 6.
BLEND = (0.2, 0.35, 0.45, 0.55, 0.7, 1.0)
SHIFT = 7


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, problem and capability vectors (the halves of an embedding), dense and sparse."""
    p, c = F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), p.alias("problem_dense"), sparse.from_dense(p).alias("problem_sparse"), c.alias("capability_dense"), sparse.from_dense(c).alias("capability_sparse"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return halves(spark, sf_dir).where("id % 2 = 0")


def cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return halves(spark, sf_dir).where("id % 2 = 1")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, problem_text and capability_text: parts of the document of the same id."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("problem_text"), F.col("lang").alias("capability_text"))


def responsibilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten chunks a job."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.expr("vec_id div 10").alias("parent"), F.lit("r").alias("content"), F.col("embedding").alias("vec"), F.expr("cast(vec_id % 10 as int)").alias("idx"))


def experiences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten chunks a CV, each a blend of a vector and the one SHIFT places on, so that all levels occur."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.count("*").alias("n"))
    w = F.element_at(F.array(*(F.lit(x) for x in BLEND)), (F.col("a.vec_id") % len(BLEND)).cast("int") + 1)

    def blend(x: Column, y: Column) -> Column:
        return w * x.cast("double") + (1 - w) * y.cast("double")

    near = e.alias("a").join(F.broadcast(n)).join(e.alias("b"), F.expr(f"b.vec_id = (a.vec_id + {SHIFT}) % n"))  # one row
    return near.select(F.col("a.vec_id").alias("id"), F.expr("a.vec_id div 10").alias("parent"), F.lit("e").alias("content"), F.zip_with("a.embedding", "b.embedding", blend).alias("vec"), F.expr("cast(a.vec_id % 10 as int)").alias("idx"))


def same_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs (job, cv) of equal numbers."""
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 10").alias("job")).distinct().withColumn("cv", F.col("job"))


def backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with texts, of which some lack a vector and some a text."""
    j = jobs(spark, sf_dir).join(texts(spark, sf_dir), "id", "left")
    return j.withColumns(
        {
            "problem_sparse": F.expr("if(id % 11 = 0, null, problem_sparse)"),
            "problem_text": F.expr("if(id % 13 = 0, '', problem_text)"),
            "capability_dense": F.expr("if(id % 17 = 0, null, capability_dense)"),
        }
    )


def chunk_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of which every third lacks a vector and every seventh a text."""
    return responsibilities(spark, sf_dir).withColumns({"vec": F.expr("if(id % 3 = 0, null, vec)"), "content": F.expr("if(id % 7 = 0, '', concat('chunk ', id))")})
