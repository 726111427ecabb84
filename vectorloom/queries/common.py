"""What the queries share: the payload that is derived from the embeddings, and pieces of SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.search import Columns
from ..session import table

E = Columns("vec_id", "embedding", None)
P = Columns("vec_id", "embedding", "metadata")


def rounded(c: Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def payload() -> Column:
    """A payload of every JSON type, from the id and the label; null for each 17th row."""
    v = F.col("vec_id")
    t = lambda c: c.cast("string")
    note = F.when(v % 4 == 0, ', "note": ""').when(v % 4 == 1, F.concat(F.lit(', "note": "Note '), t(v), F.lit('"'))).when(v % 4 == 2, ', "note": null').otherwise("")
    tags = F.when(v % 4 == 0, "[]").when(v % 4 == 1, '["t0"]').when(v % 4 == 2, '["t0", "t1"]').otherwise('["t0", "t1", "t2"]')
    text = F.concat(
        F.lit('{"label": '), t(F.col("label")), F.lit(', "category": "cat_'), t(v % 10), F.lit('", "active": '), t(v % 2 == 0), F.lit(', "price": '), t(v % 100), F.lit(".5"),
        F.lit(', "location": {"lat": '), t(v * 7 % 180 - 90), F.lit('.0, "lon": '), t(v * 13 % 360 - 180), F.lit('.0}, "tags": '), tags, note, F.lit("}"),
    )
    return F.when(v % 17 != 0, text)


def with_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).withColumn("metadata", payload())


def first_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return list(embeddings(spark, sf_dir).where(F.col("vec_id") == vec_id).select("embedding").first()[0])


# SQL: e holds the vectors in double precision, q the query vector
E_SQL = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS d FROM embeddings), q AS (SELECT d AS q FROM e WHERE vec_id = 0)"


def d_sql(by: str, a: str = "d", b: str = "q") -> str:
    return {
        "cosine": f"(1 - coalesce(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0), 0))",
        "euclidean": f"list_distance({a}, {b})",
        "dot_product": f"(-list_dot_product({a}, {b}))",
        "manhattan": f"list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))",
    }[by]


def r_sql(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"
