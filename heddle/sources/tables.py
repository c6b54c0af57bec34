"""Where rows come from: table schemas, readers, column inspection, and the text forms of stored vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions import sparse, vector

#: The schemas of parents and of chunks.
PARENT = "id string, title string, problem_text string, capability_text string, " + ", ".join(f"{s}_dense array<float>, {s}_sparse {sparse.TYPE}" for s in ("problem", "capability"))
CHUNK = "id string, parent string, content string, vec array<float>, idx int"


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def read_jdbc(spark: SparkSession, url: str | None, query: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16) -> DataFrame:
    """A database's query; split by ranges of a numeric key if its bounds are given."""
    if not url:
        raise ValueError("a database url is needed")
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q").option("fetchsize", 10_000)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def vector_columns(df: DataFrame) -> list[tuple[str, str]]:
    """(name, type) of columns whose name contains ``vector``, by name."""
    return sorted((f.name, f.dataType.simpleString()) for f in df.schema if "vector" in f.name)


def sparse_form(df: DataFrame) -> str:
    """How a table stores sparse vectors: ``json`` if the first sparse column by name that tells is a struct or map,
    ``text`` if it is a string, and text if none tells."""
    for name, _ in vector_columns(df):
        if "sparse" not in name:
            continue
        kind = df.schema[name].dataType
        if isinstance(kind, T.StructType | T.MapType):
            return "json"
        if isinstance(kind, T.StringType):
            return "text"
    return "text"


def decoded(df: DataFrame, dense: tuple[str, ...] = (), sparse_columns: tuple[str, ...] = ()) -> DataFrame:
    """df with text columns of vectors as arrays and structs."""
    return df.withColumns({c: vector.parse_dense(c) for c in dense} | {c: sparse.decode(c) for c in sparse_columns})


def encoded(df: DataFrame, dense: tuple[str, ...] = (), sparse_columns: tuple[str, ...] = (), form: str = "text") -> DataFrame:
    """df with vectors in their text forms."""
    write = sparse.encode_json if form == "json" else sparse.encode_text
    return df.withColumns({c: vector.dense_text(c) for c in dense} | {c: write(c) for c in sparse_columns})


def lookup(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of some ids (a column ``id``) that have both dense vectors."""
    return rows.join(ids.select("id").distinct(), "id", "left_semi").where(F.col("problem_dense").isNotNull() & F.col("capability_dense").isNotNull())
