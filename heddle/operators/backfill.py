"""Filling in missing vectors: what is pending, one pass over it, and the state of a table.

A pass reads the pending rows once, embeds them, and merges what is valid; rows that can't be embedded or checked
are returned as rejected and don't hold up the rest, nor are they tried again within the pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions import sparse
from heddle.functions.models import Encoder, HashEncoder, embed
from heddle.functions.scalar import has_text, is_vectorless, shown

VECTORS = ("problem_dense", "problem_sparse", "capability_dense", "capability_sparse")
#: Which columns the two spaces are embedded from. "reference" is shifted by one column; "intended" isn't.
BINDINGS = {"reference": ("title", "problem_text"), "intended": ("problem_text", "capability_text")}


def pending_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with text and no vector."""
    return chunks.where(F.col("vec").isNull() & has_text("content"))


def pending(rows: DataFrame) -> DataFrame:
    """Rows with both texts of which any vector is missing; all four are then made anew."""
    return rows.where(is_vectorless(*VECTORS) & has_text("problem_text") & has_text("capability_text"))


def _good(v: Column, dim: int) -> Column:
    return v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))


def embed_chunks(chunks: DataFrame, make: Callable[[], Encoder] = HashEncoder) -> tuple[DataFrame, DataFrame]:
    """(updates, rejected): id and vec of pending chunks; rejected ones have a reason instead."""
    dim = make().dim
    made = pending_chunks(chunks).select("id", embed("content", make)["dense"].alias("vec"))
    return made.where(_good(F.col("vec"), dim)), made.where(~_good(F.col("vec"), dim)).select("id", F.lit("vector").alias("reason"))


def embed_rows(rows: DataFrame, make: Callable[[], Encoder] = HashEncoder, binding: str = "reference") -> tuple[DataFrame, DataFrame]:
    """(updates, rejected): id and the four vectors of pending rows; sparse ones are cleaned for storage."""
    first, second = BINDINGS[binding]
    dim = make().dim
    made = pending(rows).select("id", embed(first, make).alias("p"), embed(second, make).alias("c"))
    flat = made.select("id", F.col("p.dense").alias("problem_dense"), sparse.clean("p.sparse").alias("problem_sparse"), F.col("c.dense").alias("capability_dense"), sparse.clean("c.sparse").alias("capability_sparse"))
    good = F.col("id").isNotNull() & _good(F.col("problem_dense"), dim) & _good(F.col("capability_dense"), dim)
    return flat.where(good), flat.where(~good).select("id", F.when(F.col("id").isNull(), "id").otherwise("vector").alias("reason"))


def merge(target: DataFrame, updates: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """target with the columns of updates where a row of the same id has them; ids of updates are distinct."""
    new = updates.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = target.join(new, target["id"] == new["_id"], "left")
    return joined.select(*(F.when(F.col("_id").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns))


def store(target: DataFrame, updates: DataFrame, columns: tuple[str, ...], path: str) -> int:
    """Writes the merged table as a new version and returns how many rows were updated, counted as they pass."""
    from pyspark.sql import Observation

    seen = Observation()
    merge(target, updates.observe(seen, F.count(F.lit(1)).alias("n")), columns).write.mode("errorifexists").parquet(path)
    return seen.get["n"]


def run_all(tables: dict[str, DataFrame], path: str, step: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = embed_rows, columns: tuple[str, ...] = VECTORS) -> dict[str, dict[str, object]]:
    """One pass over each table in turn, which writes its new version under path; for every table how many rows were
    processed, or the error that it ended with. A table's failure leaves the others alone. ``total`` sums them up."""
    done: dict[str, dict[str, object]] = {}
    for name, rows in tables.items():
        try:
            done[name] = {"processed": store(rows, step(rows)[0], columns, f"{path}/{name}"), "error": None}
        except Exception as e:  # whatever it was, the next table is tried, and the caller is told
            done[name] = {"processed": 0, "error": f"{type(e).__name__}: {e}"}
    return done | {"total": {"processed": sum(x["processed"] for x in done.values()), "error": None}}


def status_text(tables: dict[str, DataFrame]) -> DataFrame:
    """table, completed and pending as shown, with percents, and missing_text, null if there is none."""
    s = status(tables)

    def line(c: str) -> Column:
        return F.concat(F.col(c).cast("string"), F.lit(" ("), shown(f"{c}_percent"), F.lit(")")).alias(c)

    return s.select("table", "total", line("completed"), line("pending"), F.when(F.col("missing_text") > 0, F.col("missing_text")).alias("missing_text"))


def status(tables: dict[str, DataFrame]) -> DataFrame:
    """table, total, completed, pending, completed_percent, pending_percent and missing_text of every table: one pass
    over each. A row may be completed and lack text, so the last column overlaps the others."""
    done = ~is_vectorless(*VECTORS)
    parts = []
    for name, df in tables.items():
        agg = df.agg(F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(~has_text("problem_text") | ~has_text("capability_text")).alias("missing_text"))
        parts.append(agg.select(F.lit(name).alias("table"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)

    def percent(n: Column) -> Column:
        return F.coalesce(F.try_divide(n.cast("double"), F.col("total")) * 100, F.lit(0.0))

    out = out.withColumn("pending", F.col("total") - F.col("completed"))
    return out.select("table", "total", "completed", "pending", percent(F.col("completed")).alias("completed_percent"), percent(F.col("pending")).alias("pending_percent"), "missing_text")
