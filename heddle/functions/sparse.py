"""Sparse vectors as ``struct<indices array<int>, values array<double>>`` columns, and their text forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The dimension that text forms name, the older one that only empty texts name, and the least weight kept.
DIMENSION = 30522
OLD_DIMENSION = 30000
THRESHOLD = 0.01

TYPE = "struct<indices:array<int>,values:array<double>>"


def _of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def build(pairs: Column) -> Column:
    """A sparse vector of an array of structs (i, v)."""
    return F.struct(F.transform(pairs, lambda p: p["i"]).cast("array<int>").alias("indices"), F.transform(pairs, lambda p: p["v"]).cast("array<double>").alias("values"))


def empty() -> Column:
    return F.struct(F.array().cast("array<int>").alias("indices"), F.array().cast("array<double>").alias("values"))


def from_weights(weights: Column | str, threshold: float = THRESHOLD) -> Column:
    """Lexical weights (a map of tokens) above a threshold, by index as a number; null is empty; NaN is dropped."""
    kept = F.map_filter(_of(weights), lambda k, v: (v.cast("double") > threshold) & ~F.isnan(v.cast("double")))
    pairs = F.array_sort(F.transform(F.map_entries(kept), lambda e: F.struct(e["key"].cast("int").alias("i"), e["value"].cast("double").alias("v"))))
    return F.coalesce(F.when(_of(weights).isNotNull(), build(pairs)), empty())


def from_dense(v: Column | str, threshold: float = THRESHOLD) -> Column:
    """The components above a threshold, at their positions from 0."""
    pairs = F.transform(_of(v), lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("v")))
    return build(F.filter(pairs, lambda p: (p["v"] > threshold) & ~F.isnan(p["v"])))


def clean(sparse: Column | str) -> Column:
    """What may be stored: pairs up to the shorter array, indices within the dimension, positive values."""
    s = _of(sparse)
    n = F.least(F.size(s["indices"]), F.size(s["values"]))
    pairs = F.zip_with(F.slice(s["indices"], F.lit(1), n), F.slice(s["values"], F.lit(1), n), lambda i, v: F.struct(i.alias("i"), v.cast("double").alias("v")))
    good = F.filter(pairs, lambda p: p["i"].isNotNull() & p["v"].isNotNull() & (p["i"] >= 0) & (p["i"] < DIMENSION) & (p["v"] > 0) & ~F.isnan(p["v"]))
    return F.coalesce(F.when(n >= 0, build(good)), empty())


def from_json_text(text: Column | str) -> Column:
    """What a JSON text of indices and values holds, for storing: cleaned, and empty if it is malformed."""
    return clean(decode(text))


def encode_text(sparse: Column | str) -> Column:
    """``{i:v,...}/dimension`` with six decimals, rounded as Python and C format them: the JVM takes exact ties up."""

    @F.pandas_udf("array<string>")
    def six(rows: pd.Series) -> pd.Series:
        return rows.map(lambda values: ["%.6f" % v for v in values])

    c = clean(sparse)
    pairs = F.zip_with(c["indices"], six(c["values"]), lambda i, v: F.concat(i.cast("string"), F.lit(":"), v))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}/" + str(DIMENSION)))


def encode_json(sparse: Column | str) -> Column:
    """The JSON form, values rounded to six decimals as Python rounds."""

    @F.pandas_udf("array<double>")
    def six(rows: pd.Series) -> pd.Series:
        return rows.map(lambda values: [round(float(v), 6) for v in values])

    c = clean(sparse)
    return F.to_json(F.struct(c["indices"].alias("indices"), six(c["values"]).alias("values")))


def decode(text: Column | str) -> Column:
    """Either text form as a sparse vector; null, an empty form or anything malformed is the empty vector. Parts
    without a colon are passed over; a JSON object may lack one of its lists, and may hold numbers as texts."""
    t = F.btrim(_of(text))
    read = F.from_json(t, "struct<indices:array<string>,values:array<string>,_corrupt_record:string>")
    indices = F.coalesce(F.transform(read["indices"], lambda x: F.btrim(x).try_cast("int")), F.array().cast("array<int>"))
    values = F.coalesce(F.transform(read["values"], lambda x: F.btrim(x).try_cast("double")), F.array().cast("array<double>"))
    whole = read["_corrupt_record"].isNull() & ~F.exists(indices, lambda x: x.isNull()) & ~F.exists(values, lambda x: x.isNull())
    as_json = F.when(whole, F.struct(indices.alias("indices"), values.alias("values")))
    inner = F.btrim(F.split(t, "/").getItem(0), F.lit("{}"))
    parts = F.filter(F.split(inner, ","), lambda p: F.contains(p, F.lit(":")))
    pairs = F.transform(parts, lambda p: F.struct(F.btrim(F.substring_index(p, ":", 1)).try_cast("int").alias("i"), F.btrim(F.substr(p, F.locate(":", p) + 1)).try_cast("double").alias("v")))
    from_text = F.when(~F.exists(pairs, lambda p: p["i"].isNull() | p["v"].isNull()), build(pairs))
    found = F.when(t.startswith('{"'), as_json).otherwise(from_text)
    empty_forms = ["", "{}", f"{{}}/{DIMENSION}", f"{{}}/{OLD_DIMENSION}"]
    return F.coalesce(F.when(t.isNotNull() & ~t.isin(empty_forms), found), empty())


def inner_product(a: Column | str, b: Column | str) -> Column:
    """Sum of products over shared indices."""
    a, b = _of(a), _of(b)
    probe = F.map_from_arrays(b["indices"], b["values"])
    terms = F.zip_with(a["indices"], a["values"], lambda i, v: v * F.coalesce(F.element_at(probe, i), F.lit(0.0)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def negative_inner_product(a: Column | str, b: Column | str) -> Column:
    """What a database's inner-product distance gives; it is added to scores, so shared words lower them."""
    return -inner_product(a, b)
