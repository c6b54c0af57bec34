"""Dense vectors as ``array<float>`` columns: JVM-side expressions for small inputs and checks.

Bulk similarity goes through the block kernel in ``heddle.operators.kernel``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return F.transform(F.col(v) if isinstance(v, str) else v, lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products in double; raises where lengths differ, which would otherwise give null without a word."""
    a, b = doubles(a), doubles(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).when(a.isNull() | b.isNull(), None).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.transform(doubles(v), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def cosine_safe(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity where a zero vector is similar to nothing: 0."""

    def own(v: Column | str) -> Column:
        n = norm(v)
        return F.when(n == 0.0, F.lit(1.0)).otherwise(n)

    return dot(a, b) / (own(a) * own(b))


def cosine_db(a: Column | str, b: Column | str) -> Column:
    """One minus a database's cosine distance: NaN where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0.0, F.lit(float("nan"))).otherwise(dot(a, b) / F.when(n == 0.0, F.lit(1.0)).otherwise(n))


def l2_normalize(v: Column | str) -> Column:
    """The vector at length 1, as floats; a zero vector stays."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: (x / F.when(n == 0.0, F.lit(1.0)).otherwise(n)).cast("float"))


def parse_dense(text: Column | str) -> Column:
    """``[a,b,...]``, or the same without brackets, as a vector; a part that isn't a number raises."""
    t = F.btrim(F.col(text) if isinstance(text, str) else text)
    inner = F.regexp_replace(t, r"^\[|\]$", "")
    return F.when(F.length(F.btrim(inner)) == 0, F.array().cast("array<float>")).otherwise(F.transform(F.split(inner, ","), lambda x: F.btrim(x).cast("float")))


def dense_text(v: Column | str) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(doubles(v), lambda x: x.cast("string")), ","), F.lit("]"))
